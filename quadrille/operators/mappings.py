"""Mapping edges: (strategy, source_class, target_class, predicate, source_dataset, target_dataset, confidence, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms

EDGE = ["source_class", "target_class", "predicate", "source_dataset", "target_dataset"]


def valid(edges: DataFrame) -> DataFrame:
    """The edges whose ends and predicate are IRIs and whose confidence is null or within [0, 1]."""
    sound = terms.is_iri(F.col("source_class")) & terms.is_iri(F.col("target_class")) & terms.is_iri(F.col("predicate"))
    return edges.where(sound & (F.col("confidence").isNull() | F.col("confidence").between(0.0, 1.0)))


def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both sets of edges once each, the existing one first where they differ only in what isn't their key."""
    both = existing.withColumn("rank", F.lit(0)).unionByName(new.withColumn("rank", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*EDGE, "rank")]
    return both.groupBy(*EDGE).agg(F.min_by(F.struct(*rest), F.struct("rank", *(F.col(c).isNull() for c in rest), *rest)).alias("r")).select(*EDGE, "r.*")


#: What each strategy says of itself in a mapping document beside its name: (required, optional) fields.
PROVENANCE = {
    "instance_matcher": (("resource",), ("uri_formats_queried",)),
    "sssom_import": (("sssom_source", "sssom_file"), ("mapping_set_id", "mapping_set_title", "license", "curie_map")),
    "semra_import": (("semra_source",), ("semra_prefix", "evidence")),
    "inferenced": (("inference_types", "source_files"), ("evidence", "stats")),
    "class_derived": (("source_mapping_type", "source_files"), ("derivation_stats", "enrichment_stats", "class_index_endpoint")),
}


def about(strategy: str, **fields) -> dict:
    """The provenance of a mapping document; a required field that is missing, or one that the strategy doesn't have, is an error."""
    required, optional = PROVENANCE[strategy]
    lacking, odd = [f for f in required if fields.get(f) is None], sorted(set(fields) - {*required, *optional})
    if lacking or odd:
        raise ValueError(f"{strategy}: " + "; ".join([f"needs {', '.join(lacking)}"] * bool(lacking) + [f"doesn't have {', '.join(odd)}"] * bool(odd)))
    return {"strategy": strategy} | {f: fields[f] for f in (*required, *optional) if fields.get(f) not in (None, [], {}, "")}


def ordered_union(existing: list[str], new: list[str]) -> list[str]:
    """existing, then what new adds, in order."""
    return list(dict.fromkeys([*existing, *new]))


def merge_context(existing: dict[str, str], new: dict[str, str]) -> dict[str, str]:
    """Prefixes of both, the existing one first."""
    return {**new, **existing}


def strategy_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("strategy").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "strategy")


def predicate_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate")


def of_strategies(edges: DataFrame, strategies: list[str] | None) -> DataFrame:
    return edges if strategies is None else edges.where(F.col("strategy").isin(strategies))
