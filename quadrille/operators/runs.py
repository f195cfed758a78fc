"""Whole runs: queries with their outcome, mining of many sources, exports of tables, logs.

Rows stay DataFrames; what is put together on the driver is as large as a list of sources, a log or a schema.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from . import graphs, mining


@dataclass
class QueryResult:
    """What a query gave: a DataFrame, or the error that it met."""

    columns: list[str] = field(default_factory=list)
    rows: DataFrame | None = None
    n_rows: int = 0
    milliseconds: float = 0.0
    error: str | None = None

    def cells(self, key: str) -> DataFrame:
        """(key, column, value, kind): one row for each cell; kind is uri, literal or unbound."""
        others = [c for c in self.columns if c != key]
        cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
        flat = self.rows.select(F.col(f"`{key}`").alias("key"), F.explode(F.array(*(cell(c) for c in others))).alias("c")).select("key", "c.*")
        return flat.withColumn("kind", F.when(F.col("value").isNull(), "unbound").when(terms.is_iri(F.col("value")), "uri").otherwise("literal"))


def run_query(spark: SparkSession, text: str, **views: DataFrame) -> QueryResult:
    """Runs SQL over the views; an error is part of the result."""
    began = time.perf_counter()
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        rows = spark.sql(text)
        out = QueryResult(rows.columns, rows, rows.count())
    except PySparkException as error:
        out = QueryResult(error=str(error).splitlines()[0])
    out.milliseconds = round(1000 * (time.perf_counter() - began), 3)
    return out


def ask(df: DataFrame) -> bool:
    """Whether there is any row."""
    return not df.isEmpty()


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """df, if it has the columns; else an error that names those it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def duration(start: Column, end: Column) -> Column:
    """Seconds between two times, to three places."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6, 3)


def iso(time_: Column) -> Column:
    return F.date_format(time_, "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: What a source may set for its own mining, and what holds where it doesn't.
SETTINGS = {"counts": True, "untyped_as_classes": False, "use_graph": False, "graph_uris": ()}


def overrides(source: dict, **defaults) -> dict:
    """The settings of one source: its own, then those given, then the usual ones; a source that doesn't use its graphs has none."""
    out = {k: source[k] if source.get(k) is not None else defaults.get(k, usual) for k, usual in SETTINGS.items()}
    return out | {"graph_uris": list(out["graph_uris"]) if out["use_graph"] else []}


def mine_sources(sources: Iterable[dict], open_quads: Callable[[dict], DataFrame | tuple[DataFrame, DataFrame]], sink: Callable[[str, DataFrame], None], progress: Callable[[str, int, int, str | None], None] | None = None, **defaults) -> DataFrame:
    """Mines one source after the other with its own settings and gives each one's patterns to sink.

    ``open_quads`` gives a source's quads, or them and the types that hold for them.  A source that fails doesn't stop the others.  ``progress`` hears (name, number, total, error).  Returns the run's
    report: (name, ok, error, seconds).
    """
    listed, report = list(sources), []
    for number, source in enumerate(listed, 1):
        began, error = time.perf_counter(), None
        try:
            use = overrides(source, **defaults)
            opened = open_quads(source)
            quads, of = opened if isinstance(opened, tuple) else (opened, None)
            found = mining.mine(quads, use["graph_uris"] or None, untyped_as_classes=use["untyped_as_classes"], of=of)
            sink(source["name"], found if use["counts"] else found.drop("count"))
        except Exception as failure:  # reported, whatever it was
            error = f"{type(failure).__name__}: {str(failure).splitlines()[0] if str(failure) else ''}"
        report.append((source["name"], error is None, error, round(time.perf_counter() - began, 3)))
        if progress:
            progress(source["name"], number, len(listed), error)
    return SparkSession.active().createDataFrame(report, "name string, ok boolean, error string, seconds double")


def mine_file(spark: SparkSession, path: str, prefixes: DataFrame, folder: str, name: str, graph: str | None = None, formats: tuple[str, ...] = ("jsonld", "void")) -> tuple[DataFrame, dict[str, str]]:
    """From an RDF file to its patterns and their exports: (patterns, format -> path).  The ending of path tells its format."""
    from ..sources import documents, rdf
    from . import convert

    low = path.rstrip("/").lower().removesuffix(".gz")
    quads = rdf.read(spark, path, graph) if low.endswith((".nt", ".nq")) else documents.read(spark, path, graph)
    found = mining.split_valid(mining.mine(quads))[0]
    return found, convert.export(found, prefixes, folder, name, formats)


def graph_tables(patterns: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The tables of a graph of datasets: edges of its three layers, nodes, predicates of edges, counts of strategies and predicates."""
    from . import mappings

    links = graphs.schema_links(patterns)
    where = graphs.class_datasets(patterns)
    layer = lambda strategy: graphs.weights(graphs.mapping_links(edges.where(F.col("strategy") == strategy), where))
    layers = graphs.layered(graphs.weights(links), layer("instance_matcher"), layer("class_derived"))
    return {
        "layers": layers,
        "nodes": graphs.inventory(patterns),
        "edge_predicates": graphs.predicate_weights(links),
        "strategy_counts": mappings.strategy_counts(edges),
        "predicate_counts": mappings.predicate_counts(edges),
    }


def export_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each table as Parquet under folder: name -> path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in tables}


def export_schema(patterns: DataFrame, folder: str, kind: str = "csv") -> str:
    """The table of patterns as CSV with a header, or as lines of JSON."""
    path, out = f"{folder}/schema_{kind}", patterns.write.mode("overwrite")
    out.option("header", True).option("escape", '"').csv(path) if kind == "csv" else out.json(path)
    return path


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines; what is there stays."""
    rows.write.mode("append").json(path)


def metadata(spark: SparkSession, path: str, **facts) -> None:
    """The facts of a run as one JSON document."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def accumulated(queries: DataFrame) -> DataFrame:
    """(purpose, sent, failed, total_time_s, mean_s, max_s) of single queries (purpose, ok, seconds)."""
    return queries.groupBy("purpose").agg(
        F.count("*").alias("sent"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.round(F.sum("seconds"), 3).alias("total_time_s"),
        F.round(F.avg("seconds"), 4).alias("mean_s"),
        F.max("seconds").alias("max_s"),
    )


def save_index(index: DataFrame, path: str) -> DataFrame:
    """The class index as Parquet, sorted by entity so that a lookup reads few row groups; the table read back."""
    index.repartition("entity").sortWithinPartitions("entity").write.mode("overwrite").parquet(path)
    return load_index(index.sparkSession, path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.parquet(path), ("entity", "graph", "class"))


def classes_of(index: DataFrame, entity: str) -> dict[str, list[str]]:
    """The classes of one entity by graph; empty if it isn't in the index."""
    rows = index.where(F.col("entity") == entity).groupBy("graph").agg(F.sort_array(F.collect_set("class")).alias("classes")).orderBy("graph").collect()
    return {r.graph: list(r.classes) for r in rows}


_KINDS = {"SELECT": ("sh:SPARQLSelectExecutable", "sh:select"), "CONSTRUCT": ("sh:SPARQLConstructExecutable", "sh:construct"), "ASK": ("sh:SPARQLAskExecutable", "sh:ask")}


def query_ids(log: DataFrame) -> DataFrame:
    """The log (type, query, ...) with an id of twelve hexadecimal digits of the type and the query; of equal ids one row stays."""
    named = log.withColumn("id", F.substring(F.md5(F.concat("type", F.lit(":"), "query")), 1, 12))
    rest = [c for c in named.columns if c != "id"]
    return named.groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", "r.*")


def queries_as_turtle(log: DataFrame, base: str) -> DataFrame:
    """(id, value): each distinct query of the log (type, query, description?, endpoint?) as a statement in Turtle."""
    rows = query_ids(log)
    text = lambda c: F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    kind = F.lit("sh:SPARQLExecutable")
    verb = F.lit("sh:select")
    for name, (cls, predicate) in _KINDS.items():
        kind = F.when(F.col("type") == name, F.lit(f"sh:SPARQLExecutable , {cls}")).otherwise(kind)
        verb = F.when(F.col("type") == name, predicate).otherwise(verb)
    note = F.coalesce(F.concat(F.lit(' ; rdfs:comment "'), text("description"), F.lit('"')), F.lit("")) if "description" in rows.columns else F.lit("")
    where = F.coalesce(F.concat(F.lit(" ; schema:target [ a sd:Service ; sd:endpoint <"), F.col("endpoint"), F.lit("> ]")), F.lit("")) if "endpoint" in rows.columns else F.lit("")
    body = F.concat(F.lit(f"<{base}"), F.col("id"), F.lit("> a "), kind, note, F.lit(" ; "), verb, F.lit(' """'), text("query"), F.lit('"""'), where, F.lit(" ."))
    return rows.select("id", body.alias("value"))


TURTLE_HEAD = "\n".join(f"@prefix {p}: <{ns}> ." for p, ns in (("rdfs", terms.RDFS), ("sh", "http://www.w3.org/ns/shacl#"), ("sd", "http://www.w3.org/ns/sparql-service-description#"), ("schema", "https://schema.org/")))
