"""Class mappings derived from instance mappings, with evidence and confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..storage import broadcast_if_small, written

#: Only these predicates say that two entities may share a class.
MAPPING_PREDICATES = tuple(terms.SKOS + m for m in ("exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch")) + (terms.OWL + "sameAs", terms.RDFS + "seeAlso")


def mapping_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("predicate").isin(*MAPPING_PREDICATES))


def evidence(edges: DataFrame, index: DataFrame, confidence: Callable[[Column], Column] = terms.confidence) -> DataFrame:
    """One row for each pair of classes that mapped entities link.

    ``instance_count`` counts an edge once for each pair of graphs that type its ends, ``distinct_edges`` once.
    ``predicate`` is the commonest, ties by name.
    """
    index = index.select("entity", "graph", "class")
    source = index.select(F.col("entity").alias("source"), F.col("graph").alias("sg"), F.col("class").alias("source_class"))
    target = index.select(F.col("entity").alias("target"), F.col("graph").alias("tg"), F.col("class").alias("target_class"))
    pair = ["source_class", "target_class"]
    met = edges.select("source", "predicate", "target").join(source, "source").join(target, "target")
    met = written(met.groupBy(*pair, "predicate", "source", "target").agg(F.count("*").alias("n"), F.collect_set("sg").alias("sg"), F.collect_set("tg").alias("tg")))  # once for each edge and pair
    graphs = lambda c: F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))), ", ")
    per = met.groupBy(*pair, "predicate").agg(F.sum("n").alias("n"), F.count("*").alias("edges"), graphs("sg").alias("sg"), graphs("tg").alias("tg"))
    joint = lambda c: F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.split(c, ", "))))), ", ")
    found = per.groupBy(*pair).agg(F.sum("n").alias("instance_count"), F.sum("edges").alias("distinct_edges"), joint("sg").alias("source_graphs"), joint("tg").alias("target_graphs"), F.min(F.struct((-F.col("n")).alias("n"), "predicate"))["predicate"].alias("predicate"))
    ends = [met.select(*pair, end).distinct().groupBy(*pair).agg(F.count("*").alias(f"distinct_{end}s")) for end in ("source", "target")]
    return found.join(ends[0], pair).join(ends[1], pair).select(*pair, "instance_count", "distinct_edges", "distinct_sources", "distinct_targets", "source_graphs", "target_graphs", "predicate").withColumn("confidence", confidence(F.col("instance_count")))


def derive(found: DataFrame, min_instance_count: int = 1, min_confidence: float = 0.0) -> DataFrame:
    """The pairs that reach both thresholds, surest first."""
    return found.where((F.col("instance_count") >= min_instance_count) & (F.col("confidence") >= min_confidence)).orderBy(F.desc("confidence"), "source_class", "target_class")


def stats(found: DataFrame) -> DataFrame:
    """One row: pairs, classes, instances, and mean, median and largest confidence to four places."""
    return found.agg(
        F.count("*").alias("n_pairs"),
        F.countDistinct("source_class").alias("n_source_classes"),
        F.countDistinct("target_class").alias("n_target_classes"),
        F.sum("instance_count").alias("n_instances"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        F.round(F.median("confidence"), 4).alias("median_confidence"),
        F.round(F.max("confidence"), 4).alias("max_confidence"),
    )


def predicate_distribution(found: DataFrame) -> DataFrame:
    return found.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate")


def to_mapping(found: DataFrame) -> DataFrame:
    """The evidence as mapping edges of the strategy ``class_derived``."""
    return found.select(F.lit("class_derived").alias("strategy"), "source_class", "target_class", "predicate", F.col("source_graphs").alias("source_dataset"), F.col("target_graphs").alias("target_dataset"), "confidence")


def infer(edges: DataFrame, inversion: bool = True, transitivity: bool = True, generalisation: bool = False, cutoff: int = 3) -> DataFrame:
    """(source, predicate, target, hops): the edges and what follows from them, each at its fewest hops.

    Inversion turns an edge round (broad and narrow change places).  Transitivity chains edges of one
    transitive predicate up to ``cutoff`` long.  Generalisation adds the weaker predicate.
    """
    s = terms.SKOS
    known = edges.select("source", "predicate", "target").distinct().withColumn("hops", F.lit(1))
    least = lambda df: df.groupBy("source", "predicate", "target").agg(F.min("hops").alias("hops"))
    if generalisation:
        weaker = F.when(F.col("predicate") == s + "exactMatch", s + "closeMatch").when(F.col("predicate").isin(s + "closeMatch", s + "broadMatch", s + "narrowMatch"), s + "relatedMatch")
        known = least(known.unionByName(known.withColumn("predicate", weaker).where("predicate is not null")))
    if inversion:
        turned = F.when(F.col("predicate") == s + "broadMatch", s + "narrowMatch").when(F.col("predicate") == s + "narrowMatch", s + "broadMatch").otherwise(F.col("predicate"))
        known = least(known.unionByName(known.select(F.col("target").alias("source"), turned.alias("predicate"), F.col("source").alias("target"), "hops")))
    if transitivity and cutoff > 1:
        step = known.where(F.col("predicate").isin(s + "exactMatch", s + "broadMatch", s + "narrowMatch", terms.OWL + "sameAs")).select("source", "predicate", "target").distinct()
        level = step
        for hops in range(2, cutoff + 1):
            level = level.withColumnRenamed("target", "via").join(step.select(F.col("source").alias("via"), "predicate", "target"), ["via", "predicate"]).where("source <> target").select("source", "predicate", "target").distinct()
            known = known.unionByName(level.withColumn("hops", F.lit(hops)))
        known = least(known)
    return known


def compose(quads: DataFrame, path: list[str], start: DataFrame | None = None) -> DataFrame:
    """Chained joins along a path of predicates: (n0, n1, ..., nk), from the subjects of ``start`` (column iri) if given."""
    out = None
    for i, predicate in enumerate(path):
        step = quads.where(F.col("p") == predicate).select(F.col("s").alias(f"n{i}"), F.col("o").alias(f"n{i + 1}")).distinct()
        if out is None:
            out = step if start is None else step.join(broadcast_if_small(start.select(F.col("iri").alias("n0")).distinct()), "n0", "left_semi")
        else:
            out = out.join(step, f"n{i}")
    return out.select(*(f"n{i}" for i in range(len(path) + 1)))
