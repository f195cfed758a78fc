"""Graphs of datasets and of nations that trade: layers, weights, components, metrics, domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs, mining
from . import dataset
from .mapping_queries import _ALL, _edges
from .mining_queries import BY_DATASET, by_dataset
from .registry import query, sql

_B = dataset.BASE


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_dataset(spark, sf_dir)


def _schema_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.once(spark, sf_dir, "schema edges", lambda: graphs.weights(graphs.schema_links(_patterns(spark, sf_dir))))


_WHERE = "cds AS (SELECT DISTINCT subject_class AS class_, dataset FROM dpatterns)"
_LINKS = "links AS (SELECT least(p.dataset, c.dataset) AS a, greatest(p.dataset, c.dataset) AS b, property_uri AS predicate FROM dpatterns p JOIN cds c ON p.object_class = c.class_ WHERE p.dataset <> c.dataset AND p.object_class NOT IN ('Literal', 'Resource'))"
_SCHEMA = (BY_DATASET, _WHERE, _LINKS)


@query(sql("SELECT a, b, count(*) AS weight FROM links GROUP BY a, b", *_SCHEMA))
def schema_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.weights(graphs.schema_links(_patterns(spark, sf_dir)))


@query(sql('SELECT a, b, predicate, count(*) AS "count" FROM links GROUP BY a, b, predicate', *_SCHEMA))
def schema_edge_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.predicate_weights(graphs.schema_links(_patterns(spark, sf_dir)))


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    patterns = _patterns(spark, sf_dir)
    where, edges = graphs.class_datasets(patterns), _edges(spark, sf_dir)
    of = lambda strategy: graphs.weights(graphs.mapping_links(edges.where(F.col("strategy") == strategy), where))
    return _schema_edges(spark, sf_dir), of("instance_matcher"), of("class_derived")


_MAPPED = "mlinks AS (SELECT strategy, least(s.dataset, t.dataset) AS a, greatest(s.dataset, t.dataset) AS b FROM mapping JOIN cds s ON s.class_ = source_class JOIN cds t ON t.class_ = target_class WHERE s.dataset <> t.dataset)"
_LAYERS = (*_ALL, *_SCHEMA, _MAPPED)
_SUMMED = lambda name, rest: f"SELECT '{name}' AS layer, a, b, count(*) AS weight FROM (SELECT a, b FROM links{rest}) GROUP BY a, b"
_RAW, _INFERRED = " UNION ALL SELECT a, b FROM mlinks WHERE strategy = 'instance_matcher'", " UNION ALL SELECT a, b FROM mlinks"


@query(sql(_SUMMED("schema", "") + " UNION ALL " + _SUMMED("raw", _RAW) + " UNION ALL " + _SUMMED("inferred", _INFERRED), *_LAYERS))
def graph_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.layered(*_layers(spark, sf_dir))


@query(sql("SELECT a, b, count(*) AS weight FROM mlinks WHERE (a, b) NOT IN (SELECT (a, b) FROM links) GROUP BY a, b", *_LAYERS))
def new_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, raw, inferred = _layers(spark, sf_dir)
    return graphs.new_pairs(graphs.added(raw, inferred), schema)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.graphs(spark, sf_dir).withColumnRenamed("g", "node")


@query(sql("SELECT DISTINCT g AS node FROM quads WHERE g NOT IN (SELECT a FROM links UNION SELECT b FROM links)", *_SCHEMA))
def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.isolated(_nodes(spark, sf_dir), _schema_edges(spark, sf_dir))


@query(sql('SELECT class_ AS "class", count(*) AS n_datasets FROM cds GROUP BY class_ HAVING count(*) > 1', *_SCHEMA))
def hub_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.hub_classes(_patterns(spark, sf_dir))


@query(sql("SELECT dataset, count(*) AS n_patterns, count(DISTINCT subject_class) AS n_classes, count(*) FILTER (object_class NOT IN ('Literal', 'Resource')) AS n_typed FROM dpatterns GROUP BY dataset", BY_DATASET))
def dataset_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.inventory(_patterns(spark, sf_dir))


_REACH = "ends AS (SELECT DISTINCT a AS u, b AS v FROM links UNION SELECT b, a FROM links), reach AS (SELECT g AS u, g AS v, 0 AS d FROM (SELECT DISTINCT g FROM quads) UNION SELECT r.u, e.v, r.d + 1 FROM reach r JOIN ends e ON r.v = e.u WHERE r.d < 5), near AS (SELECT u, v, min(d) AS d FROM reach GROUP BY u, v), rooted AS (SELECT u AS node, min(v) AS root FROM near GROUP BY u), sized AS (SELECT root, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS component FROM rooted GROUP BY root)"


@query(sql("SELECT node, component::INTEGER AS component, size FROM rooted JOIN sized USING (root)", *_SCHEMA, _REACH, recursive=True))
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.ranked_components(_nodes(spark, sf_dir), _schema_edges(spark, sf_dir))


_METRICS = """SELECT n_nodes, n_edges, n_components, largest_component, diameter, round(2 * n_edges / (n_nodes * (n_nodes - 1)), 4) AS density FROM
  (SELECT count(*) AS n_nodes FROM rooted), (SELECT count(*) AS n_edges FROM (SELECT DISTINCT a, b FROM links)), (SELECT count(*) AS n_components, max(size) AS largest_component FROM sized),
  (SELECT max(d)::BIGINT AS diameter FROM near JOIN rooted ON node = u JOIN sized USING (root) WHERE component = 0)"""


@query(sql(_METRICS, *_SCHEMA, _REACH, recursive=True))
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.metrics(_nodes(spark, sf_dir), _schema_edges(spark, sf_dir))


@query(sql(f"SELECT s AS node, o AS root FROM quads WHERE p = '{dataset.VOC}byCustomer' UNION SELECT o, o FROM quads WHERE p = '{dataset.VOC}byCustomer'"))
def entity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their customers: as many components as there are customers with orders."""
    links = dataset.quads(spark, sf_dir).where(F.col("p") == dataset.VOC + "byCustomer").select(F.col("s").alias("a"), F.col("o").alias("b"))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return graphs.components(nodes, links)


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.once(spark, sf_dir, "trade", lambda: _traded(spark, sf_dir))


def _traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, weight): the lines sold between suppliers of one nation and customers of another."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    bought = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("cn"))
    sold = read("lineitem").select("l_orderkey", "l_suppkey").join(read("supplier").select("s_suppkey", F.col("s_nationkey").alias("sn")), F.col("l_suppkey") == F.col("s_suppkey"))
    met = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).where("cn <> sn").groupBy(F.least("cn", "sn").alias("low"), F.greatest("cn", "sn").alias("high")).agg(F.count("*").alias("weight"))
    name = lambda c: F.concat(F.lit(_B + "nation/"), F.col(c).cast("string"))
    return met.select(F.least(name("low"), name("high")).alias("a"), F.greatest(name("low"), name("high")).alias("b"), "weight")


_TRADE = f"trade AS (SELECT least('{_B}nation/' || c_nationkey, '{_B}nation/' || s_nationkey) AS a, greatest('{_B}nation/' || c_nationkey, '{_B}nation/' || s_nationkey) AS b, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"
_TENDS = "tends AS (SELECT a AS node, b AS other, weight FROM trade UNION ALL SELECT b, a, weight FROM trade)"


@query(f"WITH {_TRADE}, {_TENDS} SELECT node, count(*) AS degree, sum(weight)::BIGINT AS weighted_degree FROM tends GROUP BY node")
def weighted_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.degrees(_trade(spark, sf_dir))


#: Every path without a node twice, from which the lightest of each pair are counted.
_WALKS = """wedges AS (SELECT a, b, count(*) AS w FROM links GROUP BY a, b), both_ends AS (SELECT a AS u, b AS v, w FROM wedges UNION ALL SELECT b, a, w FROM wedges),
walks AS (SELECT u AS src, v AS dst, w AS cost, [u, v] AS path FROM both_ends UNION ALL SELECT p.src, e.v, p.cost + e.w, list_append(p.path, e.v) FROM walks p JOIN both_ends e ON p.dst = e.u WHERE NOT list_contains(p.path, e.v)),
lightest AS (SELECT w.* FROM walks w JOIN (SELECT src, dst, min(cost) AS cost FROM walks GROUP BY ALL) USING (src, dst, cost)),
through AS (SELECT x AS node, sum(n / total) AS owed FROM (SELECT src, dst, x, count(*) AS n FROM lightest, unnest(path) AS t(x) WHERE x <> src AND x <> dst GROUP BY ALL) JOIN (SELECT src, dst, count(*) AS total FROM lightest GROUP BY ALL) USING (src, dst) GROUP BY x)"""


@query(sql("""SELECT src AS node, max(hops)::BIGINT AS eccentricity, round(coalesce(any_value(owed), 0) / greatest(1, (SELECT (count(DISTINCT src) - 1) * (count(DISTINCT src) - 2) FROM walks)), 6) AS betweenness
  FROM (SELECT src, dst, min(len(path)) - 1 AS hops FROM walks GROUP BY ALL) LEFT JOIN through ON node = src GROUP BY src""", *_SCHEMA, _WALKS, recursive=True))
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eccentricity in hops and betweenness by weight in the graph of schema links."""
    return graphs.central(_schema_edges(spark, sf_dir), weighted=True).withColumn("betweenness", F.round("betweenness", 6))


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit(_B + "nation/"), F.col("n_nationkey").cast("string")).alias("dataset"), F.col("r_name").alias("domain"))


_DOMAINS = f"domains AS (SELECT '{_B}nation/' || n_nationkey AS dataset, r_name AS domain FROM nation JOIN region ON n_regionkey = r_regionkey)"
_BETWEEN = "between_ AS (SELECT least(x.domain, y.domain) AS low, greatest(x.domain, y.domain) AS high, sum(weight)::BIGINT AS weight FROM trade JOIN domains x ON a = x.dataset JOIN domains y ON b = y.dataset GROUP BY 1, 2)"
_BOTH = "both_ AS (SELECT low AS domain, high AS other, weight FROM between_ UNION ALL SELECT high, low, weight FROM between_ WHERE low <> high)"


@query(f"WITH {_TRADE}, {_DOMAINS}, {_BETWEEN} SELECT low, high, weight, round(weight / (SELECT sum(weight) FROM between_), 4) AS share, low = high AS within FROM between_")
def domain_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.domain_weights(_trade(spark, sf_dir), _domains(spark, sf_dir))


@query(f"WITH {_TRADE}, {_DOMAINS}, {_BETWEEN}, {_BOTH} SELECT domain, " + ", ".join(f"round(ln(1 + coalesce(sum(weight) FILTER (other = '{r}'), 0)), 6) AS \"{r}\"" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM both_ GROUP BY domain")
def domain_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.domain_matrix(_trade(spark, sf_dir), _domains(spark, sf_dir))


_TOP = "top_ AS (SELECT node FROM tends GROUP BY node ORDER BY sum(weight) DESC, node LIMIT 5)"


@query(f"WITH {_TRADE}, {_TENDS}, {_TOP} SELECT node, other, weight FROM tends WHERE node IN (SELECT node FROM top_) AND other IN (SELECT node FROM top_)")
def adjacency_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of the five nations that trade most, as rows without zeros."""
    matrix = graphs.adjacency(_trade(spark, sf_dir), 5)
    others = [c for c in matrix.columns if c != "node"]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("other"), F.col(f"`{c}`").alias("weight")) for c in others)))
    return matrix.select("node", cells.alias("x")).select("node", "x.other", "x.weight").where("weight > 0")


_CANDIDATES = "SELECT o_orderpriority AS dataset, CAST(o_orderkey AS VARCHAR) AS schema_id, CASE o_orderkey % 5 WHEN 0 THEN 'qlever_paged' WHEN 1 THEN 'two_phase' WHEN 2 THEN 'single' ELSE 'qlever_oneshot' END AS strategy, o_custkey % 50 AS pattern_count FROM orders"


@query(f"SELECT *, CASE WHEN strategy = 'qlever_oneshot' THEN 1 WHEN starts_with(strategy, 'qlever') THEN 2 WHEN pattern_count > 0 THEN 3 ELSE 4 END AS tier FROM ({_CANDIDATES}) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY tier, pattern_count DESC, schema_id) = 1")
def best_schema_per_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 5
    strategy = F.when(key == 0, "qlever_paged").when(key == 1, "two_phase").when(key == 2, "single").otherwise("qlever_oneshot")
    candidates = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").cast("string").alias("schema_id"), strategy.alias("strategy"), (F.col("o_custkey") % 50).alias("pattern_count"))
    return graphs.best_schemas(candidates)


_KNOWN = {"widget": "Hardware", "bolt": "Hardware", "cold": "Climate"}


@query(f"""WITH k AS (SELECT p_brand || '/' || p_size AS dataset, p_partkey * 10 + i - 1 AS position, string_split(p_name, ' ')[i] AS keyword FROM part, range(1, 6) t(i) WHERE i <= len(string_split(p_name, ' '))),
  f AS (SELECT keyword, count(*) AS freq FROM k GROUP BY keyword), r AS (SELECT k.*, freq, d.domain FROM k JOIN f USING (keyword) LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _KNOWN.items())}) d(keyword, domain) USING (keyword))
  SELECT dataset, coalesce(arg_min(domain, (freq, position)) FILTER (domain IS NOT NULL), arg_min(upper(keyword[1]) || substr(keyword, 2), (freq, position)), 'Unknown') AS domain FROM r GROUP BY dataset""")
def primary_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws("/", "p_brand", "p_size").alias("dataset"), "p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "keyword"))
    known = spark.createDataFrame(list(_KNOWN.items()), "keyword string, domain string")
    return graphs.primary_domains(words.select("dataset", (F.col("p_partkey") * 10 + F.col("i")).alias("position"), "keyword"), known)
