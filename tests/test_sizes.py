"""What a plan sends to the driver or between tasks when tables are large."""

import re

from pyspark.sql import functions as F
from quadrille.functions import terms
from quadrille.operators import lookup, mining, void
from quadrille.plans import dataset
from quadrille.sources import rdf
from quadrille.streaming import incremental


def broadcasts(df):
    """The operators of the plan that broadcast a side."""
    return [x.strip(" :+-") for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "BroadcastHashJoin" in x]


def test_only_the_registry_is_broadcast(spark, tmp_path):
    """Compressed files look small to the optimiser; the entities and the types in them aren't sent to the driver for it."""
    ids = spark.range(20_000)
    ids.select(F.concat(F.lit("http://alt.example.net/c/"), "id").alias("entity")).write.parquet(f"{tmp_path}/entities")
    said = ids.select(F.lit("g").alias("g"), F.concat(F.lit(dataset.BASE + "customer/"), "id").alias("s"), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type").alias("p"), F.lit("urn:c").alias("o"))
    said.write.parquet(f"{tmp_path}/quads")
    entities, quads = spark.read.parquet(f"{tmp_path}/entities"), spark.read.parquet(f"{tmp_path}/quads")
    index = lookup.class_index(quads, entities, dataset.prefixes(spark))
    found = broadcasts(index)
    assert len(found) == 2 and all("BuildRight" in x for x in found)
    assert index.count() == 20_000
    index.write.parquet(f"{tmp_path}/index")
    totals, missing = lookup.enrich_stats(entities, spark.read.parquet(f"{tmp_path}/index"), dataset.prefixes(spark))
    assert broadcasts(totals) == [] and totals.first().n_found == 20_000
    assert all("BuildRight" in x for x in broadcasts(missing)) and missing.count() == 0


def test_stored_quads_are_mined_without_a_shuffle_by_subject(spark):
    """They lie in buckets by subject; only counts of (class, property, object) move."""
    quads = dataset.quads(spark, "/root/testdata/sf0.001")
    for found in (mining.mine(quads), mining.mine(quads, scope=[dataset.GRAPH + "sales"]), mining.mine_datasets(quads), void.coverage(quads)):
        moved = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", found._jdf.queryExecution().executedPlan().toString())
        assert moved and not [x for x in moved if re.match(r"_?s#\d+(,|$)", x) and "oc#" not in x]


def test_coverage_of_few_and_many_objects(spark):
    """Subjects with one object, with the same few and with more than void.SAME, against counts by hand."""
    types = {f"urn:s{i}": ["urn:A"] + ["urn:B"] * (i % 2) for i in range(8)} | {f"urn:o{i}": ["urn:X"] + ["urn:Y"] * (i % 3 == 0) for i in range(30)}
    said = [(s, terms.TYPE, c, "iri") for s, cs in types.items() for c in cs]
    said += [(f"urn:s{i}", "urn:p", f"urn:o{j}", "iri") for i in range(8) for j in range((1, 3, 3, 30, 17, 16, 1, 0)[i])]
    said += [("urn:s1", "urn:p", "urn:untyped", "iri"), ("urn:s1", "urn:p", "_:b", "bnode"), ("urn:s2", "urn:name", "n", "literal"), ("urn:s2", "urn:name", "m", "literal")]
    want = {}
    for s, p, o, kind in said:
        for c in types.get(s, []):
            for oc in ["Literal"] if kind == "literal" else types.get(o, ["Resource"] if kind == "iri" else []):
                want.setdefault((c, p, oc), []).append(s)
    quads = spark.createDataFrame([("urn:g", s, "iri", p, o, kind, None, None) for s, p, o, kind in said], incremental.QUAD)
    got = {(r.subject_class, r.property_uri, r.object_class): (r.participating_entities, r.occurrence_count) for r in void.coverage(quads).collect()}
    assert got == {k: (len(set(v)), len(v)) for k, v in want.items()}


def test_a_source_is_mined_with_types_from_elsewhere(spark):
    quads = dataset.quads(spark, "/root/testdata/sf0.001")
    own = mining.mine(quads.where(F.col("g") == dataset.GRAPH + "web"), of=mining.types(quads))
    want = mining.mine_datasets(quads).where(F.col("dataset") == dataset.GRAPH + "web").drop("dataset")
    assert "Exchange hashpartitioning(s#" not in own._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, own.collect()), key=repr) == sorted(map(tuple, want.select(own.columns).collect()), key=repr)


def test_compressed_lines_are_read_again_in_files_of_bounded_length(spark, tmp_path):
    rows = spark.range(250).select(F.concat(F.lit("urn:s"), "id").alias("s"), F.lit("urn:p").alias("p"), F.lit("x").alias("o"), F.lit("literal").alias("o_kind"), F.lit(terms.XSD + "string").alias("dt"))
    rdf.write(rows.coalesce(1), f"{tmp_path}/all.nq", compressed=True, most=100)
    assert len(list(tmp_path.glob("all.nq/*.gz"))) == 3
    assert rdf.read(spark, f"{tmp_path}/all.nq").select("s").distinct().count() == 250


def test_class_counts_and_patterns_over_several_batches(spark, tmp_path):
    """An instance that returns counts once; a type that comes late moves its links."""
    row = lambda s, p, o, kind="iri": ("urn:g", s, "iri", p, o, kind, None, None)
    batches = [[row("urn:a", terms.TYPE, "urn:A"), row("urn:a", "urn:p", "urn:b")], [row("urn:a", terms.TYPE, "urn:A"), row("urn:b", terms.TYPE, "urn:B"), row("urn:c", terms.TYPE, "urn:A")], [row("urn:c", "urn:p", "urn:b")]]
    for i, said in enumerate(batches):
        spark.createDataFrame(said, incremental.QUAD).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = lambda: spark.readStream.schema(incremental.QUAD).parquet(f"{tmp_path}/in")
        incremental.keep_class_counts(stream(), f"{tmp_path}/seen", f"{tmp_path}/counts", f"{tmp_path}/c1").awaitTermination()
        incremental.maintain(stream(), f"{tmp_path}/quads", f"{tmp_path}/patterns", f"{tmp_path}/c2").awaitTermination()
        got = {tuple(r) for r in incremental.latest(spark, f"{tmp_path}/counts").collect()}
        assert got == [{("urn:A", 1)}, {("urn:A", 2), ("urn:B", 1)}, {("urn:A", 2), ("urn:B", 1)}][i]
    want = mining.mine(spark.read.parquet(f"{tmp_path}/in")).collect()
    assert sorted(map(tuple, incremental.latest(spark, f"{tmp_path}/patterns").collect()), key=repr) == sorted(map(tuple, want), key=repr)
    assert list(tmp_path.glob("quads/batch=0/*.zstd.parquet"))
