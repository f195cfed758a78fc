"""Formats and catalogues: what is written is read again, and must be the rows that SQL makes of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..operators import convert, derive, graphs, lookup, mappings, mining, runs
from ..sources import catalogue as sources
from ..sources import documents, jsonld, rdf
from ..storage import new_folder
from . import dataset
from .mapping_queries import _ALL, _edges
from .mining_queries import PATTERNS, mined
from .registry import query, sql
from .term_queries import _BY_IRI, _LINK_ROWS, CURIES, HITS, IRIS, NAMED

_B, _V = dataset.BASE, dataset.VOC


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.split_valid(mined(spark, sf_dir))[0]


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_LINKML = (PATTERNS, dataset.PREFIXES_SQL, IRIS, HITS, CURIES, _BY_IRI.split(", byiri")[0], NAMED, "byiri" + _BY_IRI.split(", byiri")[1], _LINK_ROWS)
_FIRST = "lfirst AS (SELECT subject_class, subject_name, property_uri, property_name, min(object_name) FILTER (object_class <> 'Literal') AS target FROM lrows GROUP BY ALL)"
_SLOTS = """lslots AS (SELECT property_name, CASE WHEN property_name IN (SELECT subject_name FROM lrows UNION SELECT object_name FROM lrows WHERE object_class <> 'Literal') THEN 'has_' ELSE '' END || property_name AS slot,
  arg_min(property_uri, (subject_class, property_uri)) AS slot_uri, arg_max(coalesce(target, 'string'), (subject_class, property_uri)) AS "range", arg_min(subject_name, (subject_class, property_uri)) AS owner FROM lfirst GROUP BY property_name)"""


@query(sql('SELECT slot, slot_uri, "range", owner FROM lslots', *_LINKML, _FIRST, _SLOTS))
def linkml_yaml_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of the schema's LinkML, read from its YAML."""
    import yaml

    loaded = yaml.safe_load(convert.to_linkml(_valid(spark, sf_dir), dataset.prefixes(spark)))
    return _rows(spark, [(k, s["slot_uri"], s["range"], s["owner"]) for k, s in loaded["slots"].items()], "slot string, slot_uri string, range string, owner string")


@query(sql("""SELECT subject_class AS target_class, slot_uri AS path, CASE "range" WHEN 'string' THEN 'datatype' ELSE 'iri' END AS kind, row_number() OVER (PARTITION BY subject_class ORDER BY property_uri, property_name) - 1 AS "order"
  FROM (SELECT subject_class, property_name, min(property_uri) AS property_uri FROM lfirst GROUP BY ALL) JOIN lslots USING (property_name)""", *_LINKML, _FIRST, _SLOTS))
def shacl_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The property shapes of the schema's SHACL, read from its Turtle."""
    text = convert.to_shacl(_valid(spark, sf_dir), dataset.prefixes(spark))
    shapes = _rows(spark, [(x,) for x in text.split("\n\n")], "shape string")
    part = F.explode(F.regexp_extract_all("shape", F.lit(r"sh:property \[([^\]]*)\]"), F.lit(1))).alias("p")
    rows = shapes.select(F.regexp_extract("shape", "sh:targetClass <([^>]*)>", 1).alias("target_class"), part)
    return rows.select("target_class", F.regexp_extract("p", "sh:path <([^>]*)>", 1).alias("path"), F.when(F.col("p").contains("sh:datatype"), "datatype").otherwise("iri").alias("kind"), F.regexp_extract("p", "sh:order ([0-9]+)", 1).cast("bigint").alias("order"))


@query(sql("SELECT DISTINCT s.curie AS subject_curie, p.curie AS property_curie, object_class = 'Literal' AND count(*) FILTER (object_class <> 'Literal') OVER (PARTITION BY subject_class, property_uri) = 0 AS literal FROM (SELECT * FROM lrows QUALIFY row_number() OVER (PARTITION BY subject_class, property_uri ORDER BY object_class <> 'Literal' DESC) = 1) JOIN curies s ON s.iri = subject_class JOIN curies p ON p.iri = property_uri", *_LINKML))
def rdfconfig_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_curie, property_curie, literal) of the RDF-config model, read from its file."""
    model = convert.to_rdfconfig(_valid(spark, sf_dir), dataset.prefixes(spark))["model"].splitlines()
    rows, subject, prop = [], None, None
    for line in model:
        if line.startswith("- "):
            subject = line[2:].split(" ", 1)[1][:-1]
        elif line.startswith("  - "):
            prop = line[4:-1]
        else:
            rows.append((subject, prop, line.endswith('_value"')))
    return _rows(spark, rows, "subject_curie string, property_curie string, literal boolean")


@query(sql("SELECT DISTINCT strategy, source_class, target_class, predicate FROM mapping", *_ALL))
def mapping_jsonld_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping edges of both strategies as documents with their provenance, read again."""
    edges, names = _edges(spark, sf_dir), dataset.prefixes(spark)
    about = {"instance_matcher": mappings.about("instance_matcher", resource="customer", uri_formats_queried=[_B + "customer/"]), "class_derived": mappings.about("class_derived", source_mapping_type="sssom_import", source_files=["edges.jsonld"])}
    texts = [(k, jsonld.write_mapping(edges.where(F.col("strategy") == k), names, a)) for k, a in about.items()]
    return jsonld.read_mappings(_rows(spark, texts, "path string, doc string")).select("strategy", "source_class", "target_class", "predicate").distinct()


_PROVENANCE = {
    "instance_matcher": {"resource": "customer", "uri_formats_queried": ["http://alt.example.net/c/"]},
    "sssom_import": {"sssom_source": "trade", "sssom_file": "trade.sssom.tsv", "mapping_set_id": "urn:set:1", "curie_map": {"cust": _B + "customer/"}},
    "semra_import": {"semra_source": "trade", "semra_prefix": "customer"},
    "inferenced": {"inference_types": ["inversion"], "source_files": ["a.jsonld"], "stats": {"input": 2}},
    "class_derived": {"source_mapping_type": "semra_import", "source_files": ["b.jsonld"]},
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS strategy, '{f}' AS field, count(*) AS n FROM nation GROUP BY ALL" for k, v in _PROVENANCE.items() for f in v))
def mapping_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy, field, n): what the documents of the five strategies say of themselves; n is the number of edges they hold."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    edges = nation.select(F.concat(F.lit(_B + "nation/"), "n_nationkey").alias("source_class"), F.concat(F.lit(_B + "region/"), "n_regionkey").alias("target_class"), F.lit(terms.SKOS + "broadMatch").alias("predicate"), F.lit("nations").alias("source_dataset"), F.lit("regions").alias("target_dataset"), F.lit(0.5).alias("confidence"))
    texts = [(k, jsonld.write_mapping(edges, dataset.prefixes(spark), mappings.about(k, **v))) for k, v in _PROVENANCE.items()]
    docs = _rows(spark, texts, "path string, doc string")
    held = jsonld.read_mappings(docs).groupBy("strategy").agg(F.count("*").alias("n"))
    said = docs.select(F.explode(F.from_json(F.get_json_object("doc", "$['@about']"), "map<string,string>")).alias("field", "value"), F.get_json_object("doc", "$['@about'].strategy").alias("strategy"))
    return said.where(~F.col("field").isin("generated_by", "pattern_count", "strategy")).join(held, "strategy").select("strategy", "field", "n")


@query(sql(f"SELECT n_nationkey AS node_pos, '{_B}nation/' || n_nationkey AS id, (SELECT array_to_string(list_sort(list(DISTINCT c)), ', ') FROM utypes WHERE s = '{_B}nation/' || n_nationkey) AS types FROM nation UNION ALL SELECT n_nationkey, '{_B}region/' || n_regionkey, (SELECT array_to_string(list_sort(list(DISTINCT c)), ', ') FROM utypes WHERE s = '{_B}region/' || n_regionkey) FROM nation"))
def enriched_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a document and the targets nested in them, with their classes."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    target = F.create_map(F.lit("@id"), F.concat(F.lit("reg:"), "n_regionkey"))
    node = F.struct(F.col("n_nationkey").alias("k"), F.to_json(F.struct(F.concat(F.lit("nat:"), "n_nationkey").alias("@id"), target.alias("v:inRegion"))).alias("j"))
    graph = F.array_join(F.transform(F.array_sort(F.collect_list(node)), lambda x: x["j"]), ",")
    context = f'{{"@context": {{"nat": "{_B}nation/", "reg": "{_B}region/", "v": "{_V}"}}, "@graph": ['
    docs = nation.agg(graph.alias("g")).select(F.lit("memory").alias("path"), F.concat(F.lit(context), "g", F.lit("]}")).alias("doc"))
    index = mining.types(dataset.quads(spark, sf_dir)).select(F.col("s").alias("entity"), F.lit("all").alias("graph"), F.col("c").alias("class"))
    return jsonld.enrich(docs, index).select(F.col("node_pos").cast("bigint").alias("node_pos"), "id", F.array_join("types", ", ").alias("types"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a catalogue: endpoints, graphs, keywords and downloads by their keys."""
    n, key = spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("n_nationkey")
    return n.select(
        F.lower(F.regexp_replace("n_name", " ", "_")).alias("name"),
        F.when(key % 5 != 0, F.concat(F.lit("https://sparql.example.org/"), key)).alias("endpoint"),
        F.when(key % 3 == 0, "true").alias("endpoint_down"),
        F.concat(F.lit(_B + "graph/"), "n_regionkey", F.lit("|" + _B + "graph/all")).alias("graph_uris"),
        F.when(key % 2 == 0, F.concat(F.lit("https://example.org/"), key, F.lit(".nt.gz"))).alias("download_nt"),
        F.when(key % 4 == 0, F.concat(F.lit("https://example.org/"), key, F.lit(".owl"))).alias("download_owl"),
        F.when(key % 7 == 0, "no").alias("counts"),
        (key * 10).cast("string").alias("chunk_size"),
        F.concat(F.lit("d"), "n_regionkey").alias("domain"),
    )


_CATALOGUE = f"""WITH cat AS (SELECT n_nationkey AS k, lower(replace(n_name, ' ', '_')) AS name, CASE WHEN n_nationkey % 5 <> 0 THEN 'https://sparql.example.org/' || n_nationkey END AS endpoint, n_nationkey % 3 = 0 AS down,
  '{_B}graph/' || n_regionkey || ', {_B}graph/all' AS graph_uris, concat_ws(', ', CASE WHEN n_nationkey % 2 = 0 THEN 'https://example.org/' || n_nationkey || '.nt.gz' END, CASE WHEN n_nationkey % 4 = 0 THEN 'https://example.org/' || n_nationkey || '.owl' END) AS downloads,
  n_nationkey % 7 <> 0 AS counts, n_nationkey * 10.0::DOUBLE AS chunk_size, 'd' || n_regionkey AS domain FROM nation) """
_CAT_COLUMNS = ["name", "endpoint", "graph_uris", "downloads", "counts", "chunk_size"]


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.array_join(c, ", ") for c in ("graph_uris", "downloads")}).select(*_CAT_COLUMNS)


def _written_csv(spark: SparkSession, sf_dir: str) -> str:
    path = f"{new_folder(spark)}/catalogue.csv"
    _catalogue(spark, sf_dir).withColumnsRenamed({"name": "dataset_name", "endpoint": "endpoint_url"}).write.option("header", True).csv(path)
    return path


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read(spark, _written_csv(spark, sf_dir))


@query(_CATALOGUE + f"SELECT {', '.join(_CAT_COLUMNS)} FROM cat")
def catalogue_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_sources(spark, sf_dir))


@query(_CATALOGUE + f"SELECT {', '.join(_CAT_COLUMNS)} FROM cat")
def catalogue_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark)}/catalogue.yaml"
    value = lambda c: F.concat(F.lit(f"  {c}: "), F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null")))
    listed = F.concat(F.lit("  graph_uris:\n"), F.array_join(F.transform(F.split("graph_uris", "[|]"), lambda x: F.concat(F.lit("  - "), x)), "\n"))
    entry = F.concat_ws("\n", F.concat(F.lit("- name: "), "name"), *(value(c) for c in ("endpoint", "download_nt", "download_owl", "counts", "chunk_size")), listed)
    _catalogue(spark, sf_dir).select(entry.alias("value")).coalesce(1).write.text(path)
    return _shown(sources.read(spark, path))


@query(_CATALOGUE + "SELECT name, endpoint, counts, chunk_size FROM cat")
def catalogue_jsonld_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark)}/catalogue.jsonld"
    _rows(spark, [(sources.to_jsonld(_sources(spark, sf_dir)),)], "value string").coalesce(1).write.text(path)
    return sources.read(spark, path).select("name", "endpoint", "counts", "chunk_size")


@query(_CATALOGUE + "SELECT name, CASE WHEN endpoint IS NULL THEN 'no endpoint' WHEN down THEN 'endpoint down' END AS reason FROM cat")
def catalogue_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = sources.usable(_sources(spark, sf_dir))
    return good.select("name", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("name", "reason"))


@query(_CATALOGUE + "SELECT name, CASE WHEN endpoint IS NOT NULL AND NOT down AND k % 2 = 0 THEN 'both' WHEN endpoint IS NOT NULL AND NOT down THEN 'remote' WHEN k % 2 = 0 THEN 'local' ELSE 'unknown' END AS mode, CASE WHEN k % 2 = 0 THEN 'nt' END AS format FROM cat")
def catalogue_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.modes(_sources(spark, sf_dir))


@query(_CATALOGUE + "SELECT name FROM cat WHERE downloads <> '' ORDER BY contains(downloads, ','), name LIMIT 3")
def catalogue_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.smallest(_sources(spark, sf_dir), 3).select("name")


@query(_CATALOGUE + "SELECT name FROM cat WHERE regexp_matches(name, '(?i)^UNITED') UNION ALL SELECT domain || '/' || name FROM cat WHERE domain = 'd2'")
def catalogue_named_and_in_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sources(spark, sf_dir)
    return sources.named(found, "^UNITED").select("name").unionByName(sources.in_domain(found, "d2").select(F.concat("domain", F.lit("/"), "name").alias("name")))


@query(_CATALOGUE + "SELECT name, 'http://localhost:' || (7000 + k) AS endpoint FROM cat WHERE k < 5")
def catalogue_on_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 5").collect()
    return sources.on_ports(_sources(spark, sf_dir), {r.n_name.lower().replace(" ", "_"): 7000 + r.n_nationkey for r in rows}).select("name", "endpoint")


@query(_CATALOGUE + "SELECT name, CASE WHEN k % 2 = 0 THEN name ELSE NULL END AS prefix FROM cat")
def catalogue_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 2 = 0").select(F.lower(F.regexp_replace("n_name", " ", "_")).alias("prefix"), F.lit(None).cast("string").alias("provider"))
    return sources.resolve(_sources(spark, sf_dir), registry)


_SSSOM = f"SELECT '{_B}supplier/' || s_suppkey AS source_class, '{_B}customer/' || c_custkey AS target_class, '{terms.SKOS}' || CASE WHEN s_suppkey % 2 = 0 THEN 'exactMatch' ELSE 'closeMatch' END AS predicate, 'supp' AS source_dataset, 'cust' AS target_dataset, (s_suppkey % 4) / 4.0::DOUBLE AS confidence FROM supplier JOIN customer ON s_suppkey = c_custkey"


def _crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    met = read("supplier").join(read("customer"), F.col("s_suppkey") == F.col("c_custkey"))
    return met.select(F.concat(F.lit("supp:"), "s_suppkey").alias("subject_id"), F.when(F.col("s_suppkey") % 2 == 0, "skos:exactMatch").otherwise("skos:closeMatch").alias("predicate_id"), F.concat(F.lit("cust:"), "c_custkey").alias("object_id"), ((F.col("s_suppkey") % 4) / 4).alias("confidence"))


_CLASS_COLUMNS = ["source_class", "target_class", "predicate", "source_dataset", "target_dataset", "confidence"]


@query(_SSSOM)
def sssom_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping edges of SSSOM files whose head declares the prefixes."""
    path = new_folder(spark)
    head = f"#mapping_set_id: urn:trade\n#curie_map:\n#  supp: {_B}supplier/\n#  cust: {_B}customer/"
    rows = _crossed(spark, sf_dir).select(F.concat_ws("\t", *("subject_id predicate_id object_id confidence".split())).alias("value"))
    names = _rows(spark, [("subject_id\tpredicate_id\tobject_id\tconfidence",)], "value string")
    one = _rows(spark, [(0, head)], "k int, value string").unionByName(names.withColumn("k", F.lit(1))).unionByName(rows.withColumn("k", F.lit(2)))
    one.coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return sources.read_sssom(spark, path, dataset.prefixes(spark), "trade").select(*_CLASS_COLUMNS)


@query(_SSSOM.replace("'supp' AS source_dataset, 'cust' AS", "'supplier' AS source_dataset, 'customer' AS"))
def semra_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping edges of a SeMRA dump: references as CURIEs or as prefix and identifier, confidence from the evidence."""
    path, rows = new_folder(spark), _crossed(spark, sf_dir)
    ref = lambda c, prefix: F.struct(F.lit(prefix).alias("prefix"), F.substring_index(c, ":", -1).alias("identifier"))
    evidence = F.array(F.struct(F.lit(0.0).alias("confidence")), F.struct(F.col("confidence")))
    rows.select(ref("subject_id", "supplier").alias("subject"), F.col("predicate_id").alias("predicate"), F.regexp_replace("object_id", "^cust:", "customer:").alias("object"), evidence.alias("evidence")).write.json(path)
    return sources.read_semra(spark, path, dataset.prefixes(spark), keep=["Supplier"]).select(*_CLASS_COLUMNS)


_PLACES = f"SELECT s, p, o, o_kind, dt FROM quads WHERE g = '{dataset.GRAPH}places'"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.facts(spark, sf_dir, graph=dataset.GRAPH + "places").distinct()


@query(sql(_PLACES))
def turtle_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Turtle file with prefixes, ``a``, lists of objects and comments, read as quads."""
    path, q = f"{new_folder(spark)}/places.ttl", _places(spark, sf_dir)
    short = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, f"^{_V}(\\w+)$", "v:$1"), f"^{terms.RDFS}(\\w+)$", "rdfs:$1"), f"^{terms.TYPE}$", "a")
    term = lambda c: F.when(short(c) == F.col(c), F.concat(F.lit("<"), c, F.lit(">"))).otherwise(short(c))
    value = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), "o", F.lit('"'))).otherwise(term("o"))
    per = q.select("s", term("p").alias("p"), value.alias("o")).groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_list("o")), " , ").alias("os"))
    one = per.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list(F.concat("p", F.lit(" "), "os"))), " ;\n  ").alias("said"))
    head = f"@prefix v: <{_V}> .\n@prefix rdfs: <{terms.RDFS}> . # names\n"
    text = one.agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<"), "s", F.lit("> "), "said", F.lit(" .")))), "\n")).alias("value"))
    text.coalesce(1).write.text(path)
    return documents.read(spark, path).select("s", "p", "o", "o_kind", "dt")


@query(sql(_PLACES))
def rdfxml_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An RDF/XML file of descriptions, read as quads."""
    path, q = f"{new_folder(spark)}/places.rdf", _places(spark, sf_dir)
    ns, local = terms.namespace(F.col("p")), F.regexp_extract("p", "([^/#]+)$", 1)
    inner = F.when(F.col("o_kind") == "literal", F.concat(F.lit("<n:"), local, F.lit(' xmlns:n="'), ns, F.lit('">'), "o", F.lit("</n:"), local, F.lit(">"))).otherwise(F.concat(F.lit("<n:"), local, F.lit(' xmlns:n="'), ns, F.lit('" rdf:resource="'), "o", F.lit('"/>')))
    one = q.groupBy("s").agg(F.concat(F.lit('<rdf:Description rdf:about="'), F.col("s"), F.lit('">'), F.array_join(F.sort_array(F.collect_list(inner)), ""), F.lit("</rdf:Description>")).alias("x"))
    text = one.agg(F.concat(F.lit(f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{terms.RDF}">'), F.array_join(F.sort_array(F.collect_list("x")), "\n"), F.lit("</rdf:RDF>")).alias("value"))
    text.coalesce(1).write.text(path)
    return documents.read(spark, path).select("s", "p", "o", "o_kind", "dt")


@query(sql(f"SELECT s, p, o, o_kind, dt, 'en' AS lang FROM quads WHERE g = '{dataset.GRAPH}places' AND o_kind = 'literal'".replace("dt,", f"'{terms.RDF}langString' AS dt,")))
def language_tags_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals with a language tag as N-Triples, read again; tags are in lower case."""
    path = f"{new_folder(spark)}/tagged.nt"
    tagged = _places(spark, sf_dir).where("o_kind = 'literal'").drop("g").withColumn("lang", F.lit("EN")).withColumn("dt", F.lit(terms.RDF + "langString"))
    rdf.write(tagged, path)
    return rdf.read(spark, path).select("s", "p", "o", "o_kind", "dt", "lang")


@query(sql("SELECT o_orderkey AS k, 'order ' || o_orderkey || ' is no statement' AS value FROM orders"))
def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a file that are neither statements, comments nor empty."""
    path = f"{new_folder(spark)}/mixed.nt"
    bad = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("order "), "o_orderkey", F.lit(" is no statement")).alias("value"))
    good = rdf.to_lines(_places(spark, sf_dir).drop("g"))
    bad.unionByName(good).unionByName(_rows(spark, [("# a comment",), ("",)], "value string")).write.text(path)
    return rdf.rejected(spark, path).select(F.regexp_extract("value", "([0-9]+)", 1).cast("bigint").alias("k"), "value")


@query(sql("SELECT subject_class, property_uri, object_class, datatype, \"count\" FROM patterns WHERE NOT contains(subject_class, '_:') AND regexp_matches(subject_class, '^https?://') AND NOT starts_with(object_class, '_:')", PATTERNS))
def mined_file_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An N-Quads file mined and exported in one call; the patterns of its schema document."""
    folder = new_folder(spark)
    rdf.write(dataset.quads(spark, sf_dir), f"{folder}/all.nq", compressed=True)
    _, out = runs.mine_file(spark, f"{folder}/all.nq", dataset.prefixes(spark), folder, "trade", formats=("jsonld",))
    return jsonld.read_schema(jsonld.documents(spark, out["jsonld"])).select("subject_class", "property_uri", "object_class", "datatype", "count")


@query(sql("SELECT * FROM patterns", PATTERNS))
def schema_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of patterns as CSV, read again."""
    found = mined(spark, sf_dir)
    return spark.read.schema(found.schema).option("header", True).option("escape", '"').csv(runs.export_schema(found, new_folder(spark)))


@query(sql("SELECT * FROM patterns", PATTERNS))
def schema_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mined(spark, sf_dir)
    return spark.read.schema(found.schema).json(runs.export_schema(found, new_folder(spark), "json"))


_TYPED = "object_class NOT IN ('Literal', 'Resource')"


@query(sql(f"SELECT id, coalesce(nullif(regexp_extract(id, '([^/#]+)$', 1), ''), id) AS label, (SELECT count(*) FROM patterns WHERE subject_class = id AND {_TYPED}) AS out_edges FROM (SELECT subject_class AS id FROM patterns WHERE {_TYPED} UNION SELECT object_class FROM patterns WHERE {_TYPED})", PATTERNS))
def schema_multigraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, edges = graphs.multigraph(mined(spark, sf_dir))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_edges"))
    return vertices.join(out, "id", "left").na.fill(0, ["out_edges"])


@query(sql("SELECT src, dst, predicate, count(*) AS n FROM (SELECT source_class AS src, target_class AS dst, predicate FROM mapping) GROUP BY ALL", *_ALL))
def mapping_multigraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, edges = graphs.mapping_graph(_edges(spark, sf_dir))
    known = vertices.select("id")
    met = edges.join(known.withColumnRenamed("id", "src"), "src").join(known.withColumnRenamed("id", "dst"), "dst")
    return met.groupBy("src", "dst", "predicate").agg(F.count("*").alias("n"))


@query(sql("SELECT predicate, count(*) AS n FROM (SELECT DISTINCT source, predicate, target FROM edges) GROUP BY predicate", dataset.EDGES_SQL))
def merged_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of edges that overlap, merged: each edge once."""
    edges = derive.mapping_edges(dataset.instance_edges(spark, sf_dir)).select(F.col("source").alias("source_class"), F.col("target").alias("target_class"), "predicate", F.lit("a").alias("source_dataset"), F.lit("b").alias("target_dataset"), F.lit(0.5).alias("confidence"), F.lit("sssom_import").alias("strategy"))
    part = lambda where: mappings.of_strategies(edges.where(where), ["sssom_import"])
    key = F.pmod(F.xxhash64("source_class"), F.lit(3))
    return mappings.predicate_counts(mappings.merge(part(key < 2), part(key > 0)))


@query("SELECT lower(prefix) AS prefix, ns FROM (SELECT p_brand AS prefix, 'http://ns.example.org/' || p_brand || '/' AS ns, 0 AS rank FROM part UNION ALL SELECT p_type, 'http://ns.example.org/' || p_brand || '/', 1 FROM part) QUALIFY row_number() OVER (PARTITION BY lower(prefix) ORDER BY rank, ns) = 1")
def prefix_map_with_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of brands with their containers as synonyms."""
    registry = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.collect_set("p_type").alias("synonyms"))
    return lookup.prefix_map(registry.select(F.col("p_brand").alias("prefix"), F.concat(F.lit("http://ns.example.org/"), "p_brand", F.lit("/")).alias("ns"), "synonyms", F.lit(1).alias("priority")))
