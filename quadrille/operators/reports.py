"""Run analytics over mining reports and schemas."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms


def best_runs(runs: DataFrame) -> DataFrame:
    """The fastest of (dataset, variant, config, wall_s) for each dataset and variant, ties by config; null times don't count."""
    order = Window.partitionBy("dataset", "variant").orderBy("wall_s", "config")
    return runs.where("wall_s is not null").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def phase_time(reports: DataFrame, prefixes: dict[str, str], column: str = "query_stats") -> DataFrame:
    """reports with one column for each prefix: the seconds of the queries whose purpose starts with it."""
    starting = lambda prefix: lambda k, _: k.startswith(prefix)
    for name, prefix in prefixes.items():
        mine = F.map_values(F.map_filter(column, starting(prefix)))
        reports = reports.withColumn(name, F.aggregate(F.transform(mine, lambda q: q["total_time_s"]), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))
    return reports


def with_config(reports: DataFrame, column: str = "label") -> DataFrame:
    return reports.withColumns(terms.config_label(F.col(column)))


def warning_pivot(warnings: DataFrame) -> DataFrame:
    """(type) by dataset from (dataset, type, n): the mean where several rows meet, 0 where none does."""
    names = sorted(r.dataset for r in warnings.select("dataset").distinct().collect())
    return warnings.groupBy("type").pivot("dataset", names).agg(F.avg("n")).na.fill(0.0)


def explode_warnings(documents: DataFrame) -> DataFrame:
    """(dataset, type, n) from (dataset, warnings map<string,bigint>); a dataset without any has one row ``(none)``."""
    return documents.select("dataset", F.explode_outer("warnings").alias("type", "n")).select("dataset", F.coalesce("type", F.lit("(none)")).alias("type"), F.coalesce("n", F.lit(0)).alias("n"))


def correlations(table: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r): Pearson's correlation of each pair of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = table.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs))))
    return one.select(rows.alias("c")).select("c.x", "c.y", F.round("c.r", 6).alias("r"))


def standardised_regression(table: DataFrame, features: list[str], target: str):
    """Ordinary least squares on standardised columns: a DataFrame (feature, beta, std_error, p_value) and R squared."""
    rows = table.select(*(F.col(c).cast("double").alias(c) for c in (*features, target))).na.drop()
    moments = rows.agg(*(f(c).alias(f"{n}_{c}") for c in (*features, target) for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    scaled = rows.select(*(((F.col(c) - moments[f"m_{c}"]) / (moments[f"s_{c}"] or 1.0)).alias(c) for c in (*features, target)))
    model = LinearRegression(featuresCol="v", labelCol=target, solver="normal", fitIntercept=True).fit(VectorAssembler(inputCols=features, outputCol="v").transform(scaled))
    s = model.summary
    found = [(f, float(b), float(e), float(p)) for f, b, e, p in zip(features, model.coefficients, s.coefficientStandardErrors, s.pValues)]
    return table.sparkSession.createDataFrame(found, "feature string, beta double, std_error double, p_value double"), float(s.r2)


def added_variable(table: DataFrame, feature: str, others: list[str], target: str) -> DataFrame:
    """(slope, n): the regression of what ``others`` leave of the target on what they leave of the feature."""
    rows = table.select(*(F.col(c).cast("double").alias(c) for c in (feature, *others, target))).na.drop()
    rows = VectorAssembler(inputCols=others, outputCol="v").transform(rows)
    for column in (feature, target):
        model = LinearRegression(featuresCol="v", labelCol=column, predictionCol=f"fit_{column}", solver="normal").fit(rows)
        rows = model.transform(rows).withColumn(f"rest_{column}", F.col(column) - F.col(f"fit_{column}"))
    return rows.agg(F.regr_slope(f"rest_{target}", f"rest_{feature}").alias("slope"), F.count("*").alias("n"))


def importances(table: DataFrame, features: list[str], target: str, seed: int = 1):
    """(feature, importance) of gradient-boosted trees."""
    rows = VectorAssembler(inputCols=features, outputCol="raw").transform(table.select(*(F.col(c).cast("double").alias(c) for c in (*features, target))).na.drop())
    rows = StandardScaler(inputCol="raw", outputCol="v").fit(rows).transform(rows)
    model = GBTRegressor(featuresCol="v", labelCol=target, maxIter=20, maxDepth=3, seed=seed).fit(rows)
    return table.sparkSession.createDataFrame([(f, float(i)) for f, i in zip(features, model.featureImportances.toArray())], "feature string, importance double")


def histogram(table: DataFrame, column: str, bins: int, low: float, high: float, logarithmic: bool = False) -> DataFrame:
    """(bin, n) of width buckets, 0 below and bins + 1 from ``high``; logarithmic ones clip at 1 first."""
    value = F.log10(F.greatest(F.col(column).cast("double"), F.lit(1.0))) if logarithmic else F.col(column).cast("double")
    return table.where(F.col(column).isNotNull()).groupBy(F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("bigint").alias("bin")).agg(F.count("*").alias("n")).orderBy("bin")


def numbers(table: DataFrame, columns: list[str], fill: float | None = 0.0) -> DataFrame:
    """table with the columns as numbers: what isn't one becomes ``fill``, or null and its row goes if fill is None."""
    out = table.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})
    return out.na.drop(subset=columns) if fill is None else out.na.fill(fill, subset=columns)


def dummy(table: DataFrame, column: str, value: str, name: str) -> DataFrame:
    """table with 1.0 where the column has the value, else 0.0."""
    return table.withColumn(name, F.coalesce((F.col(column) == value).cast("double"), F.lit(0.0)))


def with_triples(reports: DataFrame, counts: DataFrame) -> DataFrame:
    """reports with the number of triples of their dataset, null where it isn't known."""
    return reports.join(counts, "dataset", "left")


def described(table: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, std, min, max) in one aggregation."""
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = table.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in parts.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{n}_{c}").alias(n) for n in parts)) for c in columns))).alias("r")).select("r.*")


def compression(table: DataFrame, before: str, after: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n, share): how many rows reach each ratio of before to after, and their share in percent."""
    ratio = F.when(F.col(after) > 0, F.col(before) / F.col(after))
    one = table.agg(F.count("*").alias("all"), *(F.count_if(ratio >= t).alias(f"n{i}") for i, t in enumerate(thresholds)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n")) for i, t in enumerate(thresholds))))
    return one.select("all", rows.alias("r")).select("r.threshold", "r.n", F.round(100 * F.col("r.n") / F.col("all"), 2).alias("share"))


def flattened(sessions: DataFrame, *structs: str) -> DataFrame:
    """sessions with the fields of the structs as columns of their own, named struct_field."""
    plain = [F.col(c) for c in sessions.columns if c not in structs]
    return sessions.select(*plain, *(F.col(f"{s}.{f.name}").alias(f"{s}_{f.name}") for s in structs for f in sessions.schema[s].dataType.fields))


def richness(patterns: DataFrame) -> DataFrame:
    """One row: classes, properties, typed links, literals, and patterns with a label."""
    return patterns.agg(F.countDistinct("subject_class").alias("n_classes"), F.countDistinct("property_uri").alias("n_properties"), F.count_if(~F.col("object_class").isin(*terms.SENTINELS)).alias("n_links"), F.count_if(F.col("object_class") == "Literal").alias("n_literals"))


def compare(a: DataFrame, b: DataFrame, column: str = "subject_class") -> DataFrame:
    """One row: names in both, only in a, only in b, with up to three examples of each difference."""
    x, y = a.select(F.col(column).alias("n")).distinct().withColumn("x", F.lit(1)), b.select(F.col(column).alias("n")).distinct().withColumn("y", F.lit(1))
    both = x.join(y, "n", "full")
    sample = lambda where: F.slice(F.sort_array(F.collect_set(F.when(where, F.col("n")))), 1, 3)
    only_a, only_b = F.col("y").isNull(), F.col("x").isNull()
    return both.agg(F.count_if(~only_a & ~only_b).alias("common"), F.count_if(only_a).alias("only_first"), F.count_if(only_b).alias("only_second"), sample(only_a).alias("first_examples"), sample(only_b).alias("second_examples"))
