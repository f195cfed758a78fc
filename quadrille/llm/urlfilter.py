"""URL filter over a sorted digest array.

A list of hosts, domains and URLs is kept as files in the shared folder: 64-bit xxhash keys in ascending
order, and the full strings in the same order.  Workers map the keys into memory, probe all candidates of a
batch with one vectorised binary search, and compare the stored string of each hit, so a digest collision
never blocks anything.  The list is sorted and written by the executors in ranges of the digest: the driver
holds one line for each file.  (A folder that isn't a mounted file system is read instead of mapped.)

A URL's candidates are its canonical form, its host with its port, its host, and the host's parent domains of at
least two labels; the longest listed one is the match.  They and their keys are made by Spark's expressions.  Entries
are made canonical like URLs, and lose a leading ``*.`` or dot, so they may be written in any of these forms.

Cases.  Null and empty URLs match nothing.  Null and empty list entries are left out, repeated ones, also those
that are equal only in canonical form, count once.  An empty list matches nothing.  Repeated rows are each judged.  Every column of the rows is kept, and
the match's column gets a name that is free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh

def canonical(url: Column) -> Column:
    """Host in lower case, path and query; without scheme, fragment, user, default port and closing slashes."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^[^@]*@|:(?:80|443)?$", "")
    return F.regexp_replace(F.concat(host, F.regexp_extract(bare, "[/?].*$", 0)), "/+$", "")


CANONICAL_SQL = (
    "regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^[^/?]*', 0)), '^[^@]*@|:(?:80|443)?$', '', 'g') || regexp_extract({bare}, '[/?].*$', 0), '/+$', '')"
).replace("{bare}", "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')")


def hosts(form: Column) -> Column:
    """The host of a canonical form, without its port, and its parent domains of at least two labels, longest first."""
    labels = F.split(F.regexp_replace(F.regexp_extract(form, "^[^/?]*", 0), ":[0-9]*$", ""), "[.]")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def candidates(form: Column) -> Column:
    """The canonical form, the host with its port, the host and its parent domains, longest first."""
    return F.array_distinct(F.concat(F.array(form, F.regexp_extract(form, "^[^/?]*", 0)), hosts(form)))


@dataclass(frozen=True)
class DigestArray:
    """Files (path, lowest key) in ascending order of their keys."""

    files: tuple[tuple[str, int], ...]

    def open(self) -> "Reader":
        if self not in _opened:
            _opened.clear()  # one list at a time
            _opened[self] = Reader(self)
        return _opened[self]


_opened: dict[DigestArray, "Reader"] = {}


def _buffer(path: str) -> pa.Buffer:
    fs, inner = pa.fs.FileSystem.from_uri(path)
    if isinstance(fs, pa.fs.LocalFileSystem):
        with pa.memory_map(inner) as mapped:
            return mapped.read_buffer()
    with fs.open_input_file(inner) as f:
        return f.read_buffer()


class Reader:
    def __init__(self, array: DigestArray):
        self.low = np.array([low for _, low in array.files], np.int64)
        self.parts = []
        for path, _ in array.files:
            keys = np.frombuffer(_buffer(f"{path}.keys"), np.int64)
            offsets = np.frombuffer(_buffer(f"{path}.offsets"), np.int64)
            self.parts.append((keys, offsets, _buffer(f"{path}.strings")))

    def listed(self, keys: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Which texts, of these keys, are on the list."""
        out = np.zeros(len(keys), bool)
        if not len(self.low):
            return out
        part = np.searchsorted(self.low, keys, "right") - 1
        for p in np.unique(part[part >= 0]):
            mine = np.flatnonzero(part == p)
            held, offsets, strings = self.parts[p]
            at = np.searchsorted(held, keys[mine])
            hit = np.flatnonzero(held[np.minimum(at, len(held) - 1)] == keys[mine])
            for i in hit:
                j, key = at[i], keys[mine[i]]
                while j < len(held) and held[j] == key and not out[mine[i]]:
                    out[mine[i]] = strings[offsets[j] : offsets[j + 1]].to_pybytes() == texts[mine[i]].as_py().encode()
                    j += 1
        return out


def write_array(keys: np.ndarray, texts: list[bytes], path: str) -> None:
    """One file of the array; keys in ascending order."""
    fs, inner = pa.fs.FileSystem.from_uri(path)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    for end, data in (("keys", keys.astype(np.int64).tobytes()), ("offsets", offsets.tobytes()), ("strings", b"".join(texts))):
        with fs.open_output_stream(f"{inner}.{end}") as f:
            f.write(data)


def build(entries: DataFrame, column: str, scratch: Scratch) -> DigestArray:
    """The digest array of the distinct entries, written by the executors to the shared folder."""
    folder = scratch.path()
    folder = folder if "://" in folder else f"file://{folder}"
    fs, inner = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(inner, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, texts = [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            texts.extend(t.encode() for t in batch.column(1).to_pylist())
        if texts:
            path = f"{folder}/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"  # an attempt that is lost leaves files that nobody reads
            write_array(np.concatenate(keys), texts, path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([int(keys[0][0])])], ["path", "low"])

    listed = entries.select(canonical(F.regexp_replace(F.trim(F.col(column).cast("string")), "^[*]?[.]", "")).alias("entry")).where("entry is not null and entry <> ''").distinct()
    ranged = listed.select(F.xxhash64("entry").alias("key"), "entry").repartitionByRange("key").sortWithinPartitions("key")
    files = ranged.mapInArrow(write, "path string, low bigint").collect()
    return DigestArray(tuple(sorted(((r.path, r.low) for r in files), key=lambda r: r[1])))


def match(rows: DataFrame, array: DigestArray, url_col: str = "url", name: str = "matched_entry") -> DataFrame:
    """rows with the longest listed candidate of each URL, or null; no shuffle."""

    @F.arrow_udf("string")
    def longest(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        reader = array.open()
        for texts, keys in columns:
            first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))])
            flat = texts.flatten()
            on = np.flatnonzero(reader.listed(keys.flatten().to_numpy(), flat))
            at = np.searchsorted(on, first)
            hit = [int(on[a]) if a < b else None for a, b in zip(at, at[1:])]
            yield flat.take(pa.array(hit, pa.int64()))

    made = fresh(rows, "candidates")
    with_made = rows.withColumn(made, F.array_sort(candidates(canonical(F.nullif(F.trim(F.col(url_col).cast("string")), F.lit("")))), lambda a, b: F.length(b) - F.length(a)))
    return with_made.withColumn(fresh(rows, name), longest(F.col(made), F.transform(made, lambda c: F.xxhash64(c)))).drop(made)


def blocked(pages: DataFrame, entries: DataFrame, url_col: str = "url", entry_col: str = "entry", scratch: Scratch | None = None) -> DataFrame:
    """pages with ``matched_entry``: what of the list blocks the page, or null."""
    return match(pages, build(entries, entry_col, scratch or Scratch(pages.sparkSession)), url_col)


def downgraded(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """A list made from all pages: the URLs served over plain http, and the hosts and domains of which more than half are.

    Pages are counted by host before hosts meet their domains.
    """
    plain = F.lower(url_col).startswith("http://")
    form = canonical(F.col(url_col))
    by_host = pages.select(plain.alias("plain"), hosts(form).alias("hosts")).where("hosts is not null").groupBy("hosts").agg(F.count("*").alias("n"), F.count_if("plain").alias("m"))
    domains = by_host.select(F.explode("hosts").alias("entry"), "n", "m").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("2 * m > n").select("entry")
    return pages.where(plain).select(form.alias("entry")).unionByName(domains)


def oracle_sql() -> str:
    """The rows of the query in DuckDB's SQL: each page with the longest listed candidate."""
    return f"""
WITH page AS (
  SELECT page_id, url, starts_with(lower(url), 'http://') AS plain, {CANONICAL_SQL} AS form FROM pages
), part AS (
  SELECT *, regexp_extract(form, '^[^/?]*', 0) AS place, string_split(regexp_replace(regexp_extract(form, '^[^/?]*', 0), ':[0-9]*$', ''), '.') AS labels FROM page
), parent AS (
  SELECT page_id, plain, array_to_string(labels[i:], '.') AS c FROM part, unnest(range(1, greatest(2, len(labels)))) AS u(i)
), listed AS (
  SELECT form AS entry FROM page WHERE plain AND form <> ''
  UNION
  SELECT c FROM parent WHERE c <> '' GROUP BY c HAVING 2 * count(*) FILTER (plain) > count(*)
), candidate AS (
  SELECT page_id, form AS c FROM part UNION SELECT page_id, place FROM part UNION SELECT page_id, c FROM parent
), best AS (
  SELECT page_id, max_by(c, length(c)) AS matched_entry FROM candidate JOIN listed ON c = entry GROUP BY page_id
)
SELECT p.page_id, p.url, b.matched_entry, b.matched_entry IS NOT NULL AS blocked FROM page p LEFT JOIN best b USING (page_id)
"""
