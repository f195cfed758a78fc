"""Entities and classes: prefix lookup, IRI alternatives, the class index and prefix probing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..storage import broadcast_if_small, shuffled
from . import mining

RESOLVERS = "bioregistry\\.io|n2t\\.net|identifiers\\.org"


def prefix_map(registry: DataFrame) -> DataFrame:
    """(prefix, ns) in lower case from a registry (prefix, ns, synonyms, priority): a name that several entries claim is the one's that has it as its own, then of least priority, then of first namespace."""
    own = registry.select(F.lower("prefix").alias("prefix"), F.struct(F.lit(0).alias("rank"), "priority", "ns").alias("r"))
    more = registry.select(F.explode("synonyms").alias("name"), "priority", "ns").select(F.lower("name").alias("prefix"), F.struct(F.lit(1).alias("rank"), "priority", "ns").alias("r"))
    return own.unionByName(more).groupBy("prefix").agg(F.min("r").alias("r")).select("prefix", "r.ns")


def longest_prefix(iris: DataFrame, prefixes: DataFrame, column: str = "iri") -> DataFrame:
    """iris with (prefix, ns, resource) of the longest namespace each starts with; null when none does.

    Instead of comparing every IRI with every namespace, an IRI is cut to each length that a namespace has
    and looked up: an equi-join whose size is the IRIs times the few lengths.
    """
    lengths = sorted(r.n for r in prefixes.select(F.length("ns").alias("n")).distinct().collect())
    found = iris.select(column).distinct()
    heads = F.array_distinct(F.array(*(F.when(F.length(column) >= n, F.left(F.col(column), F.lit(n))) for n in lengths))) if lengths else F.array().cast("array<string>")
    best = found.withColumn("ns", F.explode(heads)).join(broadcast_if_small(prefixes), "ns")
    best = best.groupBy(column).agg(F.max_by(F.struct("prefix", "ns", "resource"), F.struct(F.length("ns"), "prefix")).alias("hit"))
    return iris.join(shuffled(best), column, "left").select(*iris.columns, "hit.prefix", "hit.ns", "hit.resource")


def compact(iris: DataFrame, prefixes: DataFrame, column: str = "iri") -> DataFrame:
    """iris with (curie, prefix, ns): by the registry, else by the IRI's shape."""
    hit = longest_prefix(iris, prefixes, column)
    uri, ns = F.col(column), terms.namespace(F.col(column))
    local = F.substr(uri, F.length("ns") + 1)
    known = F.col("ns").isNotNull() & (local != "")
    return hit.select(
        *iris.columns,
        F.when(known, F.concat("prefix", F.lit(":"), local)).otherwise(terms.structural_curie(uri)).alias("curie"),
        F.when(known, F.col("prefix")).otherwise(terms.prefix_of(ns)).alias("prefix"),
        F.when(known, F.col("ns")).otherwise(ns).alias("ns"),
    )


def alternatives(iris: DataFrame, prefixes: DataFrame, column: str = "iri") -> DataFrame:
    """(iri, alt): every way to write an entity with the namespaces of its resource, the IRI itself among them."""
    hit = longest_prefix(iris.select(column).distinct(), prefixes, column)
    local = F.substr(F.col(column), F.length("ns") + 1)
    named = hit.where("ns is not null").select(column, local.alias("local"), "resource")
    others = named.join(broadcast_if_small(prefixes.select("resource", F.col("ns").alias("alt_ns")).distinct()), "resource").select(F.col(column).alias("iri"), F.concat("alt_ns", "local").alias("alt"))
    return others.unionByName(iris.select(F.col(column).alias("iri"), F.col(column).alias("alt"))).distinct()


def uri_formats(prefixes: DataFrame, resource: str, with_resolvers: bool = False) -> list[str]:
    """The namespaces of a resource in order, without those of resolver services; an unknown resource is an error."""
    found = prefixes.where(F.col("resource") == resource)
    if found.isEmpty():
        raise ValueError(f"unknown resource: {resource}")
    if not with_resolvers:
        found = found.where(~F.col("ns").rlike(RESOLVERS))
    return [r.ns for r in found.select("ns").distinct().orderBy("ns").collect()]


def classes_for_prefix(quads: DataFrame, prefix: str) -> DataFrame:
    """(class) of the subjects whose IRI starts with prefix; the comparison reaches the Parquet scan."""
    return quads.where((F.col("p") == terms.TYPE) & F.col("s").startswith(prefix)).select(F.col("o").alias("class")).distinct()


def classes_for_iris(quads: DataFrame, iris: DataFrame, by_graph: bool = False) -> DataFrame:
    """(iri, class), or (iri, graph, class), of the given IRIs."""
    wanted = broadcast_if_small(iris.select(F.col("iri").alias("s")).distinct())
    found = quads.where(F.col("p") == terms.TYPE).join(wanted, "s", "left_semi")
    columns = [F.col("s").alias("iri"), *([F.col("g").alias("graph")] if by_graph else []), F.col("o").alias("class")]
    return found.select(*columns).distinct()


def all_classes(quads: DataFrame) -> DataFrame:
    """(iri, class) of every typed subject."""
    return mining.types(quads).select(F.col("s").alias("iri"), F.col("c").alias("class"))


def class_index(quads: DataFrame, entities: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(entity, graph, class): the classes of each entity, found under any of its alternative IRIs."""
    alt = alternatives(entities.select(F.col("entity").alias("iri")), prefixes)
    typed = quads.where(F.col("p") == terms.TYPE).select("g", "s", "o")
    return alt.join(shuffled(typed), F.col("alt") == F.col("s")).select(F.col("iri").alias("entity"), F.col("g").alias("graph"), F.col("o").alias("class")).distinct()


def nested_index(index: DataFrame) -> DataFrame:
    """(entity, graphs map<graph, sorted classes>, all_classes): the index as one row for each entity."""
    per = index.groupBy("entity", "graph").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    return per.groupBy("entity").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("graph", "classes")))).alias("graphs"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("all_classes"))


def lookup_cost(entities: DataFrame, alt: DataFrame, index: DataFrame) -> DataFrame:
    """One row: entities asked and found, alternatives and the mean fan-out."""
    asked = entities.select("entity").distinct().agg(F.count("*").alias("n_entities"))
    spread = alt.groupBy("iri").count().agg(F.sum("count").cast("bigint").alias("n_alternatives"), F.round(F.avg("count"), 4).alias("mean_alternatives"))
    found = index.agg(F.countDistinct("entity").alias("n_found"), F.countDistinct("class").alias("n_classes"), F.countDistinct("graph").alias("n_graphs"))
    return asked.crossJoin(spread).crossJoin(found)


def enrich_stats(entities: DataFrame, index: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, (prefix, n) of the entities that weren't found)."""
    per = entities.select("entity").distinct().join(shuffled(index.groupBy("entity").agg(F.countDistinct("class").alias("n"))), "entity", "left")
    totals = per.agg(
        F.count("*").alias("n_nodes"),
        F.count("n").alias("n_found"),
        F.round(100 * F.count("n") / F.count("*"), 2).alias("percent_found"),
        F.round(F.avg("n"), 4).alias("mean_classes"),
        F.max("n").alias("max_classes"),
    )
    missing = longest_prefix(per.where("n is null").select("entity"), prefixes, "entity")
    return totals, missing.groupBy(F.coalesce("prefix", F.lit("<unknown>")).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix")


def probe(quads: DataFrame, prefixes: DataFrame, datasets: list[str] | None = None) -> DataFrame:
    """(resource, dataset, uri_format, matched_class): the classes under each namespace, all resources in one plan."""
    typed = quads.where(F.col("p") == terms.TYPE)
    if datasets is not None:
        typed = typed.where(F.col("g").isin(datasets))
    typed = typed.select("s", F.col("g").alias("dataset"), F.col("o").alias("matched_class"))
    formats = prefixes.where(~F.col("ns").rlike(RESOLVERS)).select("resource", "ns").distinct()
    lengths = sorted(r.n for r in formats.select(F.length("ns").alias("n")).distinct().collect())
    typed = typed.withColumn("s", F.left("s", F.lit(lengths[-1] if lengths else 0))).distinct()  # no longer than the longest namespace, few are left
    heads = F.array_distinct(F.array(*(F.left("s", F.lit(n)) for n in lengths))) if lengths else F.array().cast("array<string>")
    hits = typed.withColumn("ns", F.explode(heads)).join(broadcast_if_small(formats), "ns")
    return hits.select("resource", "dataset", F.col("ns").alias("uri_format"), "matched_class").distinct()


def probe_edges(hits: DataFrame, predicate: str = terms.SKOS + "narrowMatch") -> DataFrame:
    """Class pairs that share a resource, once for each unordered pair: the first by order of format, dataset and class.

    A pair of one dataset and class with itself is left out; one class in two datasets is a pair.
    """
    order = ["uri_format", "dataset", "matched_class"]
    key = F.struct(*order)
    both = hits.select("resource", key.alias("a")).join(hits.select("resource", key.alias("b")), "resource").where("a < b and not (a.dataset = b.dataset and a.matched_class = b.matched_class)")
    end = lambda x: F.struct(F.col(f"{x}.dataset"), F.col(f"{x}.matched_class"))
    first = both.groupBy("resource", F.least(end("a"), end("b")).alias("low"), F.greatest(end("a"), end("b")).alias("high")).agg(F.min(F.struct("a", "b")).alias("r"))
    return first.select(
        "resource",
        F.col("r.a.matched_class").alias("source_class"), F.col("r.b.matched_class").alias("target_class"), F.lit(predicate).alias("predicate"),
        F.col("r.a.dataset").alias("source_dataset"), F.col("r.b.dataset").alias("target_dataset"), F.col("r.a.uri_format").alias("source_uri_format"), F.col("r.b.uri_format").alias("target_uri_format"),
    )


def resolve_iris(quads: DataFrame, iris: DataFrame) -> DataFrame:
    """(iri, found, classes, label) of each IRI."""
    asked = iris.select("iri").distinct()
    typed = classes_for_iris(quads, asked).groupBy("iri").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    known = quads.join(broadcast_if_small(asked.withColumnRenamed("iri", "s")), "s", "left_semi")
    label = mining.labels(known).withColumnRenamed("uri", "iri")
    seen = known.select(F.col("s").alias("iri"), F.lit(True).alias("seen")).distinct()
    return asked.join(shuffled(seen), "iri", "left").join(shuffled(typed), "iri", "left").join(shuffled(label), "iri", "left").select("iri", F.coalesce("seen", F.lit(False)).alias("found"), "classes", "label")
