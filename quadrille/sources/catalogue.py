"""Catalogues of datasets: YAML, JSON-LD and CSV in, one table out; SSSOM mapping files; run reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import terms
from ..storage import broadcast_if_small

TEXT = ["name", "endpoint", "void_iri", "description", "license", "homepage", "domain", "endpoint_down", "sparql_engine", "sparql_strategy", "void_uri_base", "local_provider", "prefix", "logo", "version"]
LISTS = ["graph_uris", "keywords", "downloads", "synonyms"]
SWITCHES = {"use_graph": False, "two_phase": True, "counts": True, "unsafe_paging": False}
NUMBERS = ["chunk_size", "class_batch_size", "class_chunk_size", "timeout", "delay"]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TEXT] + [T.StructField(c, T.ArrayType(T.StringType())) for c in LISTS] + [T.StructField(c, T.BooleanType()) for c in SWITCHES] + [T.StructField(c, T.DoubleType()) for c in NUMBERS] + [T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])


def _text(value) -> str | None:
    return value if isinstance(value, str) or value is None else json.dumps(value) if isinstance(value, (dict, list)) else str(value).lower() if isinstance(value, bool) else str(value)


def _list(value) -> list[str]:
    if value is None or value == "":
        return []
    return [_text(v) for v in value] if isinstance(value, (list, tuple)) else [v.strip() for v in str(value).split("|")]


def coerced(entry: dict) -> dict:
    """An entry in the table's types: scalars become lists, words become switches, downloads of every format are
    gathered, what has no column goes to ``extra``."""
    out = {c: _text(entry.get(c)) for c in TEXT}
    out["name"] = out["name"] or ""
    out["downloads"] = [u for k, v in entry.items() if k.startswith("download") for u in _list(v)]
    out |= {c: _list(entry.get(c)) for c in LISTS if c != "downloads"}
    if not out["keywords"]:
        out["keywords"] = next((_list(v) for k, v in entry.items() if k.endswith("_keywords")), [])
    for c, usual in SWITCHES.items():
        v = entry.get(c)
        out[c] = usual if v in (None, "") else v if isinstance(v, bool) else str(v).strip().lower() in ("true", "1", "yes")
    for c in NUMBERS:
        try:
            out[c] = float(entry[c])
        except (KeyError, TypeError, ValueError):
            out[c] = None
    out["extra"] = {k: _text(v) for k, v in entry.items() if k not in out and not k.startswith(("download", "@")) and v is not None}
    return out


def _from_node(node: dict) -> dict:
    """A JSON-LD node as an entry: local names of its keys; the source's own name before any other."""
    entry = {}
    for key, value in node.items():
        local = key.rsplit(":", 1)[-1].rsplit("/", 1)[-1]
        value = value.get("@id", value.get("@value", value)) if isinstance(value, dict) else value
        entry.setdefault("".join("_" + c.lower() if c.isupper() else c for c in local), value)
    own = entry.get("source_name") or entry.get("name")
    entry.setdefault("endpoint", entry.get("sparql_endpoint"))
    return entry | {"name": own}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue at path, whose ending tells its format.  A catalogue is a configuration file: it is parsed on the driver."""
    low = path.lower()
    if low.endswith((".yaml", ".yml")):
        import yaml

        loaded = yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) or []
        entries = loaded.get("sources", loaded) if isinstance(loaded, dict) else loaded
        entries = [{"name": k, **v} for k, v in entries.items()] if isinstance(entries, dict) else entries
    elif low.endswith((".json", ".jsonld")):
        loaded = json.loads(spark.read.text(path, wholetext=True).first().value)
        entries = [_from_node(n) for n in loaded.get("@graph", [])]
    elif low.endswith((".csv", ".tsv")):
        rows = spark.read.option("header", True).option("sep", "\t" if low.endswith(".tsv") else ",").csv(path)
        entries = [{("name" if k == "dataset_name" else "endpoint" if k == "endpoint_url" else k): v for k, v in r.asDict().items()} for r in rows.collect()]
    else:
        raise ValueError(f"a catalogue ends in .yaml, .json, .jsonld, .csv or .tsv: {path}")
    return spark.createDataFrame([coerced(e) for e in entries], SCHEMA)


def named(sources: DataFrame, pattern: str) -> DataFrame:
    """The sources whose name matches a regular expression, in either case."""
    return sources.where(F.col("name").rlike(f"(?i){pattern}"))


def in_domain(sources: DataFrame, domain: str) -> DataFrame:
    return sources.where(F.col("domain") == domain)


def usable(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources with a live endpoint, the others with a reason)."""
    none, down = F.coalesce(F.col("endpoint"), F.lit("")) == "", F.coalesce(F.lower("endpoint_down"), F.lit("false")) == "true"
    return sources.where(~none & ~down), sources.where(none | down).withColumn("reason", F.when(none, "no endpoint").otherwise("endpoint down"))


def on_ports(sources: DataFrame, ports: dict[str, int]) -> DataFrame:
    """The sources with a local port, which becomes their endpoint."""
    table = sources.sparkSession.createDataFrame(list(ports.items()) or [("", 0)], "name string, port int")
    return sources.drop("endpoint").join(broadcast_if_small(table), "name").withColumn("endpoint", F.concat(F.lit("http://localhost:"), F.col("port").cast("string"))).drop("port")


def modes(sources: DataFrame) -> DataFrame:
    """(name, mode, format): whether a source is remote, local or both, and its first download's RDF format."""
    live = F.when(F.coalesce(F.lower("endpoint_down"), F.lit("false")) != "true", F.col("endpoint"))
    known = F.filter(F.transform("downloads", terms.data_format), lambda x: x.isNotNull())
    return sources.select("name", terms.source_mode(live, F.col("downloads")).alias("mode"), F.get(known, 0).alias("format"))


def smallest(sources: DataFrame, n: int = 3) -> DataFrame:
    """n sources for a trial: those with a single download first, then by name."""
    return sources.where(F.size("downloads") > 0).orderBy(F.size("downloads") != 1, "name").limit(n)


def resolve(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, prefix) by a registry (prefix, provider): the name, its first part, the local provider, then the
    dataset that lists the name's first part among its providers; null when none fits."""
    known = registry.select(F.lower("prefix").alias("k"), "prefix").groupBy("k").agg(F.min("prefix").alias("prefix"))
    offered = registry.where("provider is not null").select(F.concat_ws(".", F.lower("provider"), F.lower("prefix")).alias("k"), "prefix").groupBy("k").agg(F.min("prefix").alias("prefix"))
    low = F.lower("name")
    keys = F.array(F.struct(F.lit(1).alias("r"), low.alias("k")), F.struct(F.lit(2).alias("r"), F.substring_index(low, ".", 1).alias("k")), F.struct(F.lit(3).alias("r"), F.lower("local_provider").alias("k")))
    tried = sources.select("name", F.explode(keys).alias("t")).select("name", "t.r", "t.k").join(known, "k")
    tried = tried.unionByName(sources.select("name", F.lit(4).alias("r"), low.alias("k")).join(offered, "k"))
    best = tried.groupBy("name").agg(F.min_by("prefix", "r").alias("found"))
    return sources.select("name").join(best, "name", "left").select("name", F.col("found").alias("prefix"))


def to_jsonld(sources: DataFrame, registry: DataFrame | None = None) -> str:
    """The catalogue as JSON-LD; with a registry (prefix, title, homepage, ...), enriched by each source's prefix."""
    rows = sources if registry is None else sources.join(registry.select(F.col("prefix").alias("rp"), F.struct(*[c for c in registry.columns if c != "prefix"]).alias("registry")), F.col("prefix") == F.col("rp"), "left").drop("rp")
    drop = lambda d: {k: v for k, v in d.items() if v not in (None, [], {}, "")}
    graph = [{"@id": f"src:{r['name']}", "@type": "void:Dataset", **drop({k: drop(v) if isinstance(v, dict) else v for k, v in r.items()})} for r in (x.asDict(True) for x in rows.orderBy("name").collect())]
    context = {"void": terms.VOID, "src": "https://example.org/source/", "@vocab": "https://example.org/source-field/", "endpoint": {"@id": "void:sparqlEndpoint", "@type": "@id"}}
    return json.dumps({"@context": context, "@graph": graph}, ensure_ascii=False, indent=2)


def read_sssom(spark: SparkSession, path: str, prefixes: DataFrame, dataset: str) -> DataFrame:
    """Mapping edges of SSSOM files: tab-separated, ``#`` lines of metadata first, CURIEs expanded by the file's
    ``curie_map`` and then by the registry; a dataset is named after its prefix."""
    head = [r.value[1:] for r in spark.read.text(path).where("value like '#%'").collect()]
    import yaml

    meta = yaml.safe_load("\n".join(head)) or {}
    own = {k: str(v) for k, v in (meta.get("curie_map") or {}).items()}
    context = {r.prefix: r.ns for r in prefixes.collect()} | own | {"skos": terms.SKOS, "owl": terms.OWL, "rdfs": terms.RDFS}
    table = F.create_map(*(F.lit(x) for kv in context.items() for x in kv))
    rows = spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(path)
    for missing in {"subject_id", "predicate_id", "object_id"} - set(rows.columns):
        raise ValueError(f"{path} has no column {missing}")
    confidence = F.col("confidence").try_cast("double") if "confidence" in rows.columns else F.lit(None).cast("double")
    prefix = lambda c: F.when(F.col(c).contains(":"), F.substring_index(c, ":", 1)).otherwise(F.lit(dataset))
    from ..operators import mappings

    return mappings.valid(rows.select(F.lit("sssom_import").alias("strategy"), terms.expand(F.col("subject_id"), table).alias("source_class"), terms.expand(F.col("object_id"), table).alias("target_class"), terms.expand(F.col("predicate_id"), table).alias("predicate"), prefix("subject_id").alias("source_dataset"), prefix("object_id").alias("target_dataset"), confidence.alias("confidence")))


def read_semra(spark: SparkSession, path: str, prefixes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Mapping edges of a SeMRA dump: lines of JSON, each (subject, predicate, object) as CURIEs or as {prefix,
    identifier}, with evidence whose largest confidence is the edge's.  ``keep`` are the subjects' prefixes to keep."""
    ref = lambda c: F.coalesce(F.concat(F.get_json_object(c, "$.prefix"), F.lit(":"), F.get_json_object(c, "$.identifier")), F.col(c))
    shape = "subject string, predicate string, object string, evidence array<struct<confidence:double>>"
    rows = spark.read.schema(shape).json(path).where("subject is not null and predicate is not null and object is not null")
    context = {r.prefix: r.ns for r in prefixes.collect()} | {"skos": terms.SKOS, "owl": terms.OWL, "rdfs": terms.RDFS}
    table = F.create_map(*(F.lit(x) for kv in context.items() for x in kv))
    prefix = lambda c: F.lower(F.substring_index(ref(c), ":", 1))
    if keep is not None:
        rows = rows.where(prefix("subject").isin([k.lower() for k in keep]))
    from ..operators import mappings

    return mappings.valid(rows.select(F.lit("semra_import").alias("strategy"), *(terms.expand(ref(c), table).alias(n) for c, n in (("subject", "source_class"), ("object", "target_class"), ("predicate", "predicate"))), prefix("subject").alias("source_dataset"), prefix("object").alias("target_dataset"), F.array_max(F.transform("evidence", lambda e: e["confidence"])).alias("confidence")))


REPORT = "dataset_name string, strategy string, total_duration_s double, pattern_count bigint, class_count bigint, abort_reason string, query_stats map<string,struct<sent:bigint,failed:bigint,total_time_s:double>>, phases array<struct<name:string,started_at:string,finished_at:string,duration_s:double,items_discovered:bigint,error:string>>, machine map<string,string>, benchmark map<string,double>"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Run reports under path (``*_report.json``), with the folder they lie in as ``label``."""
    rows = spark.read.schema(REPORT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_report.json").json(path)
    return rows.withColumn("label", F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1))


def read_triple_counts(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, n_triples) of store statistics (``*.meta-data.json``)."""
    rows = spark.read.schema("`num-triples` struct<normal:bigint>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta-data.json").json(path)
    return rows.select(F.regexp_extract("_metadata.file_name", "^(.*)\\.meta-data\\.json$", 1).alias("dataset"), F.col("`num-triples`.normal").alias("n_triples"))


def schema_files(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """(dataset, path) of ``*_schema.jsonld`` under path; ``wanted`` are file patterns that some part of the path matches."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_schema.jsonld").load(path).select("path")
    if wanted:
        like = "^(?:" + "|".join("".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in w) for w in wanted) + ")$"
        found = found.where(F.exists(F.split("path", "/"), lambda part: part.rlike(like)))
    return found.select(F.regexp_extract("path", "([^/]+)_schema\\.jsonld$", 1).alias("dataset"), "path")
