"""Mining of tables in which one row holds all that is said of a subject: no triple is made, and none has to be told from its copies.

Literals, and links to what can't be a subject, are counted row by row.  Other links are counted by (fact, class, object),
and only these counts meet the types of those subjects that can be objects.  An IRI that is one head before a whole number
is grouped and joined as that number; its text isn't made.  What isn't such a row is mined as quads, and both are added up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..storage import shuffled
from . import mining


#: Types of columns whose values differ where their texts do.
WHOLE = ("tinyint", "smallint", "int", "bigint")
#: An IRI as a key: its number, the place of its head among the numbered ones or -1, and the text that isn't in these.
_KEY = ["k", "t", "o"]


@dataclass
class Stars:
    """A table, the expression of its rows' subject, and the facts of a row: (graph, predicate, kind, datatype, expression of the object)."""

    rows: DataFrame
    subject: str
    facts: list[tuple[str, str, str, str | None, str]]

    def of_graph(self, graph: str) -> Stars:
        return Stars(self.rows, self.subject, [f for f in self.facts if f[0] == graph])

    @property
    def classes(self) -> list[str]:
        return [o for _, p, _, _, o in self.facts if p == terms.TYPE]

    @property
    def there(self) -> DataFrame:
        """The rows that have a subject: where it is put together from columns, those with all of them, so that it isn't made for the test."""
        parts = re.findall(r"'[^']*'|\w+", self.subject[7:-1]) if re.fullmatch(r"concat\(('[^']*'|\w+)(, ('[^']*'|\w+))*\)", self.subject) else []
        needed = [F.col(x).isNotNull() for x in parts if x in self.rows.columns]
        return self.rows.where(reduce(lambda a, b: a & b, needed) if needed else F.expr(self.subject).isNotNull())

    def typed(self) -> DataFrame:
        """The rows that have a subject, with all its classes."""
        return self.there.withColumn("_cs", F.array_distinct(F.array(*map(F.expr, self.classes))))

    def numbered(self, text: str) -> tuple[str, str] | None:
        """(head, column) of an expression that is one head before a whole number: then IRIs with this head are equal where the numbers are."""
        found = re.fullmatch(r"concat\('([^']*)', (\w+)\)", text)
        return (found[1], found[2]) if found and dict(self.rows.dtypes).get(found[2]) in WHOLE else None


def head(text: str) -> str:
    """What every value of an expression begins with, as far as its text shows it."""
    found = re.match(r"concat\('([^']*)'|'([^']*)'$", text)
    return (found[1] or found[2]) if found else ""


def may_meet(a: str, b: str) -> bool:
    """Whether IRIs with these heads can be equal."""
    return a.startswith(b) or b.startswith(a)


def _new(objects: list[str]) -> list[Column]:
    """For each object of a row, whether none before it is the same."""
    return [reduce(lambda a, b: a & b, (~F.expr(o).eqNullSafe(F.expr(before)) for before in objects[:i]), F.lit(True)) for i, o in enumerate(objects)]


def _heads(star: Stars, literal: bool, by_graph: bool) -> dict[tuple, list[str]]:
    """(graph?, predicate, kind, datatype) -> objects, each expression once."""
    out: dict[tuple, list[str]] = {}
    for g, p, kind, dt, o in star.facts:
        if (kind == "literal") == literal:
            out.setdefault((g if by_graph else None, p, kind, dt), []).append(o)
    return {k: list(dict.fromkeys(v)) for k, v in out.items()}


def _classes(star: Stars) -> tuple[list[Column], Column]:
    """(the classes that differ from row to row, as c0 and on; all classes of a row, by means of these)."""
    own = [x for x in dict.fromkeys(star.classes) if not re.fullmatch("'[^']*'", x)]
    return [F.expr(x).alias(f"c{n}") for n, x in enumerate(own)], F.array_distinct(F.array(*(F.col(f"c{own.index(x)}") if x in own else F.expr(x) for x in star.classes)))


def _of(number: str, values: list) -> Column:
    """The value with this number, from 0 on; null if there is none."""
    return F.get(F.array(*map(F.lit, values)), F.col(number)) if values else F.lit(None)


def mine_graph(stars: list[Stars], rest: DataFrame | None, graph: str) -> DataFrame:
    """The patterns of one graph as a scope: its own facts, and the types that it says."""
    return mine([s.of_graph(graph) for s in stars], None if rest is None else rest.where(F.col("g") == graph))


def _text_key(text: Column, known: list[str]) -> list[Column]:
    """The key of any text: the same as the one of a numbered IRI that is equal to it."""
    k, t = F.lit(0).cast("bigint"), F.lit(-1)
    for i, h in enumerate(known):
        tail = text.substr(F.lit(len(h) + 1), F.length(text))
        number = tail.try_cast("bigint")
        same = text.startswith(h) & (number.cast("string") == tail)
        k, t = F.when(same, number).otherwise(k), F.when(same, F.lit(i)).otherwise(t)
    return [k.alias("k"), t.alias("t"), F.when(t >= 0, F.lit("")).otherwise(text).alias("o")]


def _key(star: Stars, text: str, known: list[str]) -> list[Column]:
    """The key of an expression over the star's rows; known are the heads of numbered IRIs, none of which begins with another."""
    found = star.numbered(text)
    if found and found[0] in known:
        return [F.col(found[1]).cast("bigint").alias("k"), F.lit(known.index(found[0])).alias("t"), F.lit("").alias("o")]
    return _text_key(F.expr(text), [h for h in known if may_meet(h, head(text))] and known)


def mine(stars: list[Stars], rest: DataFrame | None = None, by_graph: bool = False) -> DataFrame:
    """The patterns of the stars and of the quads in rest, whose subjects are others: as ``mining.mine``, or with by_graph as ``mining.mine_datasets``."""
    stars = [s for s in stars if s.classes]
    heads = list(dict.fromkeys(h for s in stars for literal in (True, False) for h in _heads(s, literal, by_graph)))
    objects = {head(o) for s in stars for _, _, kind, _, o in s.facts if kind != "literal"}
    near = lambda o: rest is not None or any(may_meet(head(o), head(s.subject)) for s in stars)
    numbered = {n[0] for s in stars for text in (s.subject, *(o for _, _, kind, _, o in s.facts if kind != "literal")) if (n := s.numbered(text))}
    known = sorted(h for h in numbered if not any(may_meet(h, x) for x in numbered - {h}))
    named = {x: _of("h", [h[n] for h in heads]).cast("string") for n, x in enumerate(("g", "p", "o_kind", "dt"))}
    kept = [f"c{n}" for n in range(max([1, *(len(_classes(s)[0]) for s in stars)]))]  # what differs between the classes of rows, until counts are few
    ids, text = ["i", "h", *kept, "g", "p", "o_kind"], lambda x: F.lit(None).cast("string").alias(x)
    done, counted = [], []
    for i, star in enumerate(stars):
        own, cs = _classes(star)
        varying, each = kept[: len(own)], []
        sizes = {h: reduce(lambda a, b: a + b, (n.cast("bigint") for n in _new(said))) for h, said in _heads(star, True, by_graph).items()}
        for h, said in _heads(star, False, by_graph).items():
            for o, new in zip(said, _new(said)):
                if near(o):
                    each.append((heads.index(h), o, new))
                else:
                    sizes[h] = sizes.get(h, F.lit(0).cast("bigint")) + new.cast("bigint")
        if sizes:
            sums = [f"n{n}" for n in range(len(sizes))]
            per = star.there.select(*own, *(n.alias(x) for x, n in zip(sums, sizes.values()))).groupBy(F.lit(i).alias("i"), *varying).agg(*(F.sum(x).alias(x) for x in sums))
            per = per.select(F.explode(cs).alias("c"), *sums).select("c", F.inline(F.array(*(F.struct(F.lit(heads.index(h)).alias("h"), F.col(x).alias("n")) for x, h in zip(sums, sizes)))))
            object_class = F.when(named["o_kind"] == "literal", "Literal").otherwise("Resource")
            done.append(per.where(named["o_kind"] != "bnode").select(named["g"].alias("g"), "c", named["p"].alias("p"), object_class.alias("oc"), named["dt"].alias("dt"), "n"))
        if each:
            numbers = [n if (n := star.numbered(o)) and n[0] in known else None for _, o, _ in each]
            key = ["k"] if all(numbers) else _KEY
            facts = (F.when(new, F.struct(F.lit(f).alias("f"), *_key(star, o, known)[: len(key)])) for f, (_, o, new) in enumerate(each))
            per = star.there.select(*own, F.explode(F.array(*facts)).alias("l")).where("l is not null").select(*varying, "l.*").groupBy(*varying, "f", *key).agg(F.count("*").alias("n"))
            of_head = [F.col("t"), F.col("o")] if len(key) > 1 else [_of("f", [known.index(n[0]) for n in numbers]).alias("t"), F.lit("").alias("o")]
            counted.append(per.select(F.lit(i).alias("i"), _of("f", [h for h, *_ in each]).alias("h"), *varying, *map(text, [*kept[len(own) :], "g", "p", "o_kind"]), "k", *of_head, "n"))
    of = [s.typed().select(*_key(s, s.subject, known), F.col("_cs").alias("ocs")) for s in stars if rest is not None or any(may_meet(head(s.subject), x) for x in objects)]
    if rest is not None:
        types = mining.types(rest)
        joined = mining.typed(mining.by_subject(rest.select(*(["g"] if by_graph else [F.lit(None).cast("string").alias("g")]), "s", "p", "o", "o_kind", "dt", *([] if by_graph else ["lang"]))).distinct(), types)
        linked = joined.where("o_kind <> 'literal'").groupBy("g", "c", "p", "o", "o_kind").agg(F.count("*").alias("n"))
        counted.append(linked.select(F.lit(-1).alias("i"), F.lit(-1).alias("h"), F.col("c").alias("c0"), *map(text, kept[1:]), "g", "p", "o_kind", *_text_key(F.col("o"), known), "n"))
        done.append(joined.where("o_kind = 'literal'").groupBy("g", "c", "p", "dt").agg(F.count("*").alias("n")).select("g", "c", "p", F.lit("Literal").alias("oc"), "dt", "n"))
        of.append(types.groupBy("s").agg(F.collect_list("c").alias("ocs")).select(*_text_key(F.col("s"), known), "ocs"))
    if counted:
        met = reduce(DataFrame.union, counted)
        met = met.join(shuffled(reduce(DataFrame.union, of)), _KEY, "left") if of else met.withColumn("ocs", F.lit(None).cast("array<string>"))
        met = met.select(*ids, F.explode_outer("ocs").alias("oc"), "n").groupBy(*ids, "oc").agg(F.sum("n").alias("n"))
        all_of = reduce(lambda x, n: F.when(F.col("i") == n, _classes(stars[n])[1]).otherwise(x), range(len(stars)), F.array("c0"))
        met = met.select(F.explode(all_of).alias("c"), *(F.coalesce(x, named[x]).alias(x) for x in ("g", "p", "o_kind")), "oc", "n").where("oc is not null or o_kind = 'iri'")
        done.append(met.select("g", "c", "p", F.coalesce("oc", F.lit("Resource")).alias("oc"), text("dt"), "n"))
    found = reduce(DataFrame.union, done).groupBy("g", "c", "p", "oc", "dt").agg(F.sum("n").alias("count"))
    out = found.select(F.col("g").alias("dataset"), F.col("c").alias("subject_class"), F.col("p").alias("property_uri"), F.col("oc").alias("object_class"), F.col("dt").alias("datatype"), "count")
    return out if by_graph else out.drop("dataset")
