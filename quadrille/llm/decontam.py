"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ in ``budget(m)`` edits.  It is cut into budget + 1 pieces, of which at
least one must survive unchanged in any copy within the budget.  One Aho-Corasick pass over a document finds
all exact piece hits; each hit fixes a window of the document in which Myers' bit-parallel algorithm computes
the smallest edit distance between the whole item and any substring (Myers 1999, with Hyyro's free start).
So every document that holds an item within its budget is found, and no other.

Both sides go through the same ``normal``: case folded character by character, white space collapsed to one blank.
Items shorter than ``MIN_CHARS`` characters are found everywhere by chance: they are found where they make up a
whole line, without edits.  The items are sent to the workers in chunks of at most ``CHUNK_CHARS`` characters, one
scan each, so a larger benchmark costs more passes, not memory; a worker process makes a chunk's automaton once.

Cases.  Null or empty texts and items match nothing.  Items that are equal are all reported.  Repeated documents are each reported.  Null ids are
reported as null.  Empty tables give an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textkit as tk

#: Edits allowed as a share of an item's characters, and the shortest item that is looked for inside lines.
RATE, MIN_CHARS, CHUNK_CHARS = 0.08, 20, 1 << 24


def normal(text: str | None) -> str:
    return " ".join((text or "").casefold().split())


def budget(chars: int, rate: float = RATE) -> int:
    return int(chars * rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces of nearly equal length that make up the item."""
    cut = [i * len(item) // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def peq(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance between the item and a substring of text, and the first end at which it is met."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        vp = hn | (full & ~(d0 | hp))
        vn = hp & d0
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """The automaton of all pieces of one chunk of items."""

    def __init__(self, items: list[tuple], rate: float = RATE, min_chars: int = MIN_CHARS):
        self.items, self.auto = [], ahocorasick.Automaton()
        self.lines: dict[str, list[int]] = {}
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            short = len(text) < min_chars
            m, e = len(text), 0 if short else budget(len(text), rate)
            self.items.append((item_id, text, m, e, {} if short else peq(text)))
            if short:
                self.lines.setdefault(text, []).append(len(self.items) - 1)
                continue
            for offset, piece in pieces(text, e):
                at.setdefault(piece, []).append((len(self.items) - 1, offset))
        for piece, where in at.items():
            self.auto.add_word(piece, (len(piece), where))
        self.auto.make_automaton()

    def whole_lines(self, raw: str) -> list[tuple[int, int, int]]:
        found, end = {}, -1
        for line in map(normal, raw.splitlines() if self.lines else ()):
            end += len(line) + 1 if line else 0
            for k in self.lines.get(line, ()):
                found.setdefault(k, end)
        return [(k, 0, end) for k, end in found.items()]

    def matches(self, raw: str) -> list[tuple[int, int, int]]:
        """(item position, distance, end in the normalised text) of each item in a text; the best distance, then the first end."""
        found, text = self.whole_lines(raw), normal(raw)
        if not len(self.auto):
            return found
        windows: dict[int, list[list[int]]] = {}
        for last, (length, where) in self.auto.iter(text):
            begin = last - length + 1
            for k, offset in where:
                m, e = self.items[k][2:4]
                low, high = max(0, begin - offset - e), min(len(text), begin - offset + m + e)
                mine = windows.setdefault(k, [])
                if mine and low <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], high)
                    mine[-1][0] = min(mine[-1][0], low)
                else:
                    mine.append([low, high])
        for k, mine in windows.items():
            _, item, m, e, masks = self.items[k]
            best: tuple[int, int] | None = None
            for low, high in mine:
                part = text[low:high]
                exact = part.find(item)
                d, end = (0, exact + m) if exact >= 0 else myers(masks, m, part)
                if d <= e and (best is None or (d, low + end) < best):
                    best = d, low + end
            if best:
                found.append((k, *best))
        return found


def item_chunks(items: DataFrame, id_col: str, text_col: str, chunk_chars: int) -> Iterator[list[tuple]]:
    """Normalised items in chunks of bounded size; the benchmark is streamed through the driver, not held."""
    chunk: list[tuple] = []
    held = 0
    for row in items.select(id_col, text_col).toLocalIterator():
        text = normal(row[1])
        if not text:
            continue
        if chunk and held + len(text) > chunk_chars:
            yield chunk
            chunk, held = [], 0
        chunk.append((row[0], text))
        held += len(text)
    if chunk:
        yield chunk


_made: dict[str, Matcher] = {}


def _matcher(sent, name: str, rate: float, min_chars: int) -> Matcher:
    """The automaton of a chunk, made once by each worker process; it holds one at a time."""
    if name not in _made:
        _made.clear()
        _made[name] = Matcher(sent.value, rate, min_chars)
    return _made[name]


def _scan(sent, rate: float, min_chars: int, target: pa.Schema):
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(sent, name, rate, min_chars)
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, distance, end in matcher.matches(text):
                    rows.append(i)
                    out.append((matcher.items[k][0], distance, matcher.items[k][3], end))
            if rows:
                columns = [batch.column(0).take(pa.array(rows)), *(pa.array([o[j] for o in out], target.field(j + 1).type) for j in range(4))]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return scan


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, edits_allowed, end_char): each item in each document within its budget.

    ``end_char`` is where the best match ends in the normalised text.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", items.schema[item_id].dataType), T.StructField("distance", T.IntegerType()), T.StructField("edits_allowed", T.IntegerType()), T.StructField("end_char", T.LongType())])
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    chunks = item_chunks(items, item_id, item_text, chunk_chars)
    parts = [source.mapInArrow(_scan(spark.sparkContext.broadcast(c), rate, min_chars, to_arrow_schema(schema)), schema) for c in chunks]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _leaked(sent, rate: float, min_chars: int):
    name = uuid.uuid4().hex

    @F.arrow_udf("boolean")
    def leaked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = _matcher(sent, name, rate, min_chars)
        for batch in batches:
            yield pa.array([bool(t) and bool(matcher.matches(t)) for t in batch.to_pylist()], pa.bool_())
        tk.release()

    return leaked


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The rows of docs that hold no test item within its budget, with their columns; no shuffle."""
    for chunk in item_chunks(items, item_id, item_text, chunk_chars):
        docs = docs.where(~_leaked(docs.sparkSession.sparkContext.broadcast(chunk), rate, min_chars)(F.col(text_col).cast("string")))
    return docs
