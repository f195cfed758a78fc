"""Schema mining over quads(g, s, s_kind, p, o, o_kind, dt, lang).

A pattern is (subject_class, property_uri, object_class, datatype) with a count.  ``scope`` limits mining to
named graphs: then the graph is part of every join, and a triple counts once for each graph that holds it.
Without a scope the graphs are one: a triple counts once.

Plan.  The quads are hash-partitioned by subject, by their buckets where they are stored so, else once; the distinct
triples and the join with the subject's types reuse that partitioning.  Literals are aggregated there and never shuffled by object.  Links are first
counted by (class, property, object), which takes the skew out of popular objects, and only those counts
meet the objects' types.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..storage import broadcast_if_small, clustered, shuffled

KEY = ["subject_class", "property_uri", "object_class", "datatype"]
Scope = Sequence[str] | None


def in_scope(quads: DataFrame, scope: Scope) -> DataFrame:
    """The distinct triples of the scope, with their graph when there is one."""
    columns = ["s", "p", "o", "o_kind", "dt", "lang"]
    if scope is not None:
        quads, columns = quads.where(F.col("g").isin(list(scope))), ["g", *columns]
    return by_subject(quads.select(*columns)).distinct()


def by_subject(df: DataFrame) -> DataFrame:
    """df partitioned by s: as it is stored, else by a shuffle."""
    return df if clustered(df, "s") else df.repartition("s")


def side(of: DataFrame, **names: str) -> DataFrame:
    """Types as the side of a join, renamed: a table in memory for each bucket where they lie in buckets, else sorted."""
    return of.withColumnsRenamed(names).hint("shuffle_hash" if clustered(of, "s") else "merge")


def typed(triples: DataFrame, of: DataFrame, scoped: bool = False) -> DataFrame:
    """The triples with each type c of their subject; within a graph if scoped, which isn't a key of the join, so that the partitioning by s serves it."""
    right = side(of, s="_s", g="_g")
    met = F.col("s") == F.col("_s")
    return triples.join(right, met & (F.col("g") <= F.col("_g")) & (F.col("g") >= F.col("_g")) if scoped else met).drop("_s", "_g")


def types(quads: DataFrame, scope: Scope = None) -> DataFrame:
    """Distinct (g?, s, c) for every rdf:type triple."""
    typed = quads.where(F.col("p") == terms.TYPE)
    if scope is not None:
        return typed.where(F.col("g").isin(list(scope))).select("g", "s", F.col("o").alias("c")).distinct()
    return typed.select("s", F.col("o").alias("c")).distinct()


def classes(quads: DataFrame, scope: Scope = None) -> DataFrame:
    """(class), every class with an instance."""
    return types(quads, scope).select(F.col("c").alias("class")).distinct()


def _parts(quads: DataFrame, scope: Scope, only: DataFrame | None, of: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    graph = [] if scope is None else ["g"]
    of = types(quads, scope) if of is None else of
    wanted = of if only is None else of.join(broadcast_if_small(only.select(F.col("class").alias("c"))), "c", "left_semi")
    joined = typed(in_scope(quads, scope), wanted, bool(graph))
    literal = joined.where("o_kind = 'literal'").groupBy("c", "p", "dt").agg(F.count("*").alias("count"))
    linked = joined.where("o_kind <> 'literal'").groupBy(*graph, "c", "p", "o", "o_kind").agg(F.count("*").alias("n"))
    return literal, linked, of, graph


def _literal(literal: DataFrame) -> DataFrame:
    return literal.select(F.col("c").alias("subject_class"), F.col("p").alias("property_uri"), F.lit("Literal").alias("object_class"), F.col("dt").alias("datatype"), "count")


def _links(linked: DataFrame, of: DataFrame, graph: list[str], kind: str) -> DataFrame:
    met = linked.join(side(of, s="o", c="oc"), [*graph, "o"], {"typed": "inner", "all": "left"}.get(kind, "left_anti"))
    object_class = F.lit("Resource") if kind == "untyped" else F.coalesce("oc", F.lit("Resource"))
    met = met.where("o_kind = 'iri'") if kind == "untyped" else met.where("oc is not null or o_kind = 'iri'")
    return met.groupBy(F.col("c").alias("subject_class"), F.col("p").alias("property_uri"), object_class.alias("object_class")).agg(F.sum("n").alias("count")).withColumn("datatype", F.lit(None).cast("string")).select(*KEY, "count")


def typed_object_patterns(quads: DataFrame, scope: Scope = None, only: DataFrame | None = None) -> DataFrame:
    """Patterns whose object has a type."""
    _, linked, of, graph = _parts(quads, scope, only)
    return _links(linked, of, graph, "typed")


def literal_patterns(quads: DataFrame, scope: Scope = None, only: DataFrame | None = None) -> DataFrame:
    """Patterns whose object is a literal, by datatype."""
    return _literal(_parts(quads, scope, only)[0])


def untyped_uri_patterns(quads: DataFrame, scope: Scope = None, only: DataFrame | None = None) -> DataFrame:
    """Patterns whose object is an IRI without a type."""
    _, linked, of, graph = _parts(quads, scope, only)
    return _links(linked, of, graph, "untyped")


def mine(quads: DataFrame, scope: Scope = None, only: DataFrame | None = None, untyped_as_classes: bool = False, properties: Sequence[str] | None = None, of: DataFrame | None = None) -> DataFrame:
    """All patterns with counts in one plan: (subject_class, property_uri, object_class, datatype, count).

    ``properties`` limits mining to these; the filter reaches the scan, and types are read whatever they are.
    ``of`` has the types (g?, s, c) where they aren't those in quads.
    """
    if properties is not None:
        found = mine(quads.where(F.col("p").isin(list(properties)) | (F.col("p") == terms.TYPE)), scope, only, untyped_as_classes, of=of)
        return found.where(F.col("property_uri").isin(list(properties)))
    literal, linked, of, graph = _parts(quads, scope, only, of)
    found = _literal(literal).unionByName(_links(linked, of, graph, "all"))
    if untyped_as_classes:
        renamed = F.when(F.col("object_class") == "Resource", terms.OWL + "Class").otherwise(F.col("object_class"))
        found = found.withColumn("object_class", renamed)
    return found


def mine_by_typesets(quads: DataFrame) -> DataFrame:
    """The same patterns by way of type sets: for data where subjects have many types.

    Triples are counted between sets of types; only the counts are expanded to classes.
    """
    sets = types(quads).groupBy("s").agg(F.sort_array(F.collect_set("c")).alias("cs"))
    joined = in_scope(quads, None).join(side(sets), "s")
    literal = joined.where("o_kind = 'literal'").groupBy("cs", "p", "dt").agg(F.count("*").alias("n"))
    linked = joined.where("o_kind <> 'literal'").groupBy("cs", "p", "o", "o_kind").agg(F.count("*").alias("n"))
    met = linked.join(side(sets, s="o", cs="ocs"), "o", "left").where("ocs is not null or o_kind = 'iri'")
    met = met.groupBy("cs", "p", F.coalesce("ocs", F.array(F.lit("Resource"))).alias("ocs")).agg(F.sum("n").alias("n"))
    both = literal.select("cs", "p", F.array(F.lit("Literal")).alias("ocs"), "dt", "n").unionByName(met.withColumn("dt", F.lit(None).cast("string")))
    wide = both.select(F.explode("cs").alias("subject_class"), F.col("p").alias("property_uri"), "ocs", F.col("dt").alias("datatype"), "n")
    wide = wide.select("subject_class", "property_uri", F.explode("ocs").alias("object_class"), "datatype", "n")
    return wide.groupBy(*KEY).agg(F.sum("n").alias("count"))


def mine_with_fallback(quads: DataFrame, scope: Scope) -> tuple[DataFrame, bool]:
    """Patterns of the scope; of all graphs when the scope has classes but no pattern (as for ontology graphs)."""
    found = mine(quads, scope)
    if scope is not None and found.isEmpty() and not classes(quads, scope).isEmpty():
        return mine(quads), True
    return found, False


def mine_datasets(quads: DataFrame) -> DataFrame:
    """(dataset, *pattern): patterns of every graph at once, objects typed in any graph."""
    of = types(quads)
    triples = typed(by_subject(quads.select("g", "s", "p", "o", "o_kind", "dt")).distinct(), of)
    literal = triples.where("o_kind = 'literal'").groupBy("g", "c", "p", "dt").agg(F.count("*").alias("count"))
    literal = literal.select(F.col("g").alias("dataset"), F.col("c").alias("subject_class"), F.col("p").alias("property_uri"), F.lit("Literal").alias("object_class"), F.col("dt").alias("datatype"), "count")
    linked = triples.where("o_kind <> 'literal'").groupBy("g", "c", "p", "o", "o_kind").agg(F.count("*").alias("n"))
    met = linked.join(side(of, s="o", c="oc"), "o", "left").where("oc is not null or o_kind = 'iri'")
    met = met.groupBy(F.col("g").alias("dataset"), F.col("c").alias("subject_class"), F.col("p").alias("property_uri"), F.coalesce("oc", F.lit("Resource")).alias("object_class")).agg(F.sum("n").alias("count"))
    return literal.unionByName(met.withColumn("datatype", F.lit(None).cast("string")))


def class_instance_counts(quads: DataFrame, scope: Scope = None, approximate: bool = False) -> DataFrame:
    """(class, instances), largest first; ``approximate`` trades exactness for a constant state per class."""
    count = F.approx_count_distinct("s") if approximate else F.countDistinct("s")
    return types(quads, scope).groupBy(F.col("c").alias("class")).agg(count.alias("instances")).orderBy(F.desc("instances"), "class")


def class_properties(quads: DataFrame, scope: Scope = None) -> DataFrame:
    """Distinct (class, property_uri)."""
    graph = [] if scope is None else ["g"]
    return typed(in_scope(quads, scope), types(quads, scope), bool(graph)).select(F.col("c").alias("class"), F.col("p").alias("property_uri")).distinct()


def property_object_classes(quads: DataFrame, scope: Scope = None) -> DataFrame:
    """Distinct (class, property_uri, object_class) of typed objects."""
    return typed_object_patterns(quads, scope).select(F.col("subject_class").alias("class"), "property_uri", "object_class").distinct()


def schema_classes(patterns: DataFrame) -> DataFrame:
    """Every subject class and every object class that isn't a sentinel."""
    objects = patterns.where(~F.col("object_class").isin(*terms.SENTINELS)).select(F.col("object_class").alias("class"))
    return patterns.select(F.col("subject_class").alias("class")).union(objects).distinct().orderBy("class")


def schema_properties(patterns: DataFrame) -> DataFrame:
    return patterns.select("property_uri").distinct().orderBy("property_uri")


def dropped_sample(patterns: DataFrame, n: int = 20) -> DataFrame:
    """The first n of the patterns that aren't valid, by name."""
    return split_valid(patterns)[1].orderBy(*KEY).limit(n)


def class_count_page(counts: DataFrame, offset: int, size: int) -> DataFrame:
    """A page of classes, those with most instances first, ties by name."""
    return counts.orderBy(F.desc("instances"), "class").offset(offset).limit(size)


def _sound(patterns: DataFrame) -> Column:
    return terms.is_iri(F.col("subject_class")) & terms.is_iri(F.col("property_uri")) & (F.col("object_class").isin(*terms.SENTINELS) | terms.is_iri(F.col("object_class")))


def split_valid(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns of IRIs only, the others)."""
    sound = _sound(patterns)
    return patterns.where(sound), patterns.where(~sound)


def without_services(patterns: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Patterns that stay clear of the service namespaces and of ``extra``."""
    served = lambda c: reduce(lambda a, b: a | b, (c.startswith(p) for p in (*terms.SERVICE_NAMESPACES, *extra)))
    object_class = F.col("object_class")
    return patterns.where(~(served(F.col("subject_class")) | served(F.col("property_uri")) | (~object_class.isin(*terms.SENTINELS) & served(object_class))))


def labels(quads: DataFrame, scope: Scope = None) -> DataFrame:
    """(uri, label): the best label of every labelled subject; one pass, no chain of outer joins."""
    rank = F.create_map(*(F.lit(x) for i, p in enumerate(terms.LABEL_PROPERTIES) for x in (p, i)))[F.col("p")]
    found = quads.where(F.col("p").isin(*terms.LABEL_PROPERTIES) & (F.col("o_kind") == "literal"))
    if scope is not None:
        found = found.where(F.col("g").isin(list(scope)))
    return found.groupBy(F.col("s").alias("uri")).agg(F.min(F.struct(rank.alias("r"), F.col("o").alias("label"))).alias("best")).select("uri", "best.label")


def with_labels(patterns: DataFrame, label: DataFrame) -> DataFrame:
    """patterns with subject_label, property_label and object_label; the local name where there is none."""
    used = patterns.select(F.explode(F.array("subject_class", "property_uri", "object_class")).alias("uri")).distinct()
    small = label.join(broadcast_if_small(used), "uri", "left_semi")
    for column, out in (("subject_class", "subject_label"), ("property_uri", "property_label"), ("object_class", "object_label")):
        part = small.select(F.col("uri").alias(column), F.col("label").alias(out))
        patterns = patterns.join(part, column, "left").withColumn(out, F.coalesce(out, terms.local_name(F.col(column))))
    return patterns
