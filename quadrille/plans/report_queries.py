"""Run analytics and streams.  The tables stand in for run reports: an order is a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from ..storage import new_folder
from ..streaming import incremental
from . import dataset
from .registry import query, sql


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


@query("SELECT o_orderpriority AS dataset, o_orderstatus AS variant, CAST(o_orderkey AS VARCHAR) AS config, o_totalprice AS wall_s FROM orders QUALIFY row_number() OVER (PARTITION BY dataset, variant ORDER BY o_totalprice, config) = 1")
def best_config_per_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _orders(spark, sf_dir).select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("variant"), F.col("o_orderkey").cast("string").alias("config"), F.col("o_totalprice").alias("wall_s"))
    return reports.best_runs(runs)


@query("""SELECT 'c' || o_custkey AS run, coalesce(sum(round(o_totalprice)) FILTER (o_orderstatus = 'F'), 0) AS patterns_s, coalesce(sum(round(o_totalprice)) FILTER (o_orderstatus = 'O'), 0) AS counts_s FROM orders GROUP BY 1""")
def phase_time_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    purpose = F.concat(F.when(F.col("o_orderstatus") == "F", "patterns/").when(F.col("o_orderstatus") == "O", "counts/").otherwise("other/"), F.col("o_orderkey").cast("string"))
    stats = F.map_from_entries(F.collect_list(F.struct(purpose, F.struct(F.lit(1).alias("sent"), F.lit(0).alias("failed"), F.round("o_totalprice").alias("total_time_s")))))
    runs = _orders(spark, sf_dir).groupBy(F.concat(F.lit("c"), "o_custkey").alias("run")).agg(stats.alias("query_stats"))
    return reports.phase_time(runs, {"patterns_s": "patterns/", "counts_s": "counts/"}).drop("query_stats")


@query("SELECT event_type AS type, " + ", ".join(f"coalesce(avg(CAST(regexp_extract(props, '([0-9-]+)', 1) AS BIGINT)) FILTER (user_id % 4 = {i}), 0) AS d{i}" for i in range(4)) + " FROM events GROUP BY event_type")
def warning_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("d"), F.col("user_id") % 4).alias("dataset"), F.col("event_type").alias("type"), F.regexp_extract("props", "([0-9-]+)", 1).cast("bigint").alias("n"))
    return reports.warning_pivot(rows)


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i:]))
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.correlations(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _NUMBERS)


@query("SELECT CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 21 ELSE CAST(floor(20 * o_totalprice / 500000) AS BIGINT) + 1 END AS bin, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1")
def pattern_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(_orders(spark, sf_dir), "o_totalprice", 20, 0, 500000)


#: Sums of squares and products of standardised columns solve the regression; three features, so a 3 x 3 system in closed form.
_MOMENTS = "c AS (SELECT corr(l_quantity, l_discount) AS r12, corr(l_quantity, l_tax) AS r13, corr(l_discount, l_tax) AS r23, corr(l_quantity, l_extendedprice) AS y1, corr(l_discount, l_extendedprice) AS y2, corr(l_tax, l_extendedprice) AS y3 FROM lineitem)"
_DET = "(1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23)"
_BETAS = {
    "l_quantity": f"((1 - r23 * r23) * y1 + (r13 * r23 - r12) * y2 + (r12 * r23 - r13) * y3) / {_DET}",
    "l_discount": f"((r13 * r23 - r12) * y1 + (1 - r13 * r13) * y2 + (r12 * r13 - r23) * y3) / {_DET}",
    "l_tax": f"((r12 * r23 - r13) * y1 + (r12 * r13 - r23) * y2 + (1 - r12 * r12) * y3) / {_DET}",
}


@query(f"WITH {_MOMENTS} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round({b}, 6) + 0.0 AS beta FROM c" for f, b in _BETAS.items()))
def standardised_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of the price on quantity, discount and tax, all standardised."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    found = reports.standardised_regression(table, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")[0]
    return found.select("feature", (F.round("beta", 6) + 0.0).alias("beta"))


@query(f"WITH {_MOMENTS} SELECT round({_BETAS['l_quantity']} * (SELECT stddev_samp(l_extendedprice) / stddev_samp(l_quantity) FROM lineitem), 4) AS slope, (SELECT count(*) FROM lineitem) AS n FROM c")
def added_variable_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope of what discount and tax leave of the price on what they leave of the quantity: the coefficient of the whole regression."""
    found = reports.added_variable(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_quantity", ["l_discount", "l_tax"], "l_extendedprice")
    return found.select(F.round("slope", 4).alias("slope"), "n")


@query()
def feature_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.importances(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@query(sql('SELECT o AS "class", count(*) AS instances FROM quads WHERE p = \'http://www.w3.org/1999/02/22-rdf-syntax-ns#type\' GROUP BY o'))
def stream_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of each class, counted by a stream over the stored quads; the last state of the sink."""
    stored, out = dataset.quads(spark, sf_dir), new_folder(spark)
    folder = stored.inputFiles()[0].rsplit("/", 1)[0]
    incremental.keep_class_counts(spark.readStream.schema(stored.schema).parquet(folder), f"{out}/seen", f"{out}/counts", f"{out}/checkpoint").awaitTermination()
    return incremental.latest(spark, f"{out}/counts")
