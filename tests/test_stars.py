"""Tables mined row by row against the same tables as quads."""

import pytest
from pyspark.sql import functions as F
from quadrille.operators import lookup, mining, stars
from quadrille.plans import dataset, graph_queries, mapping_queries, mining_queries, run_queries

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The tables with repeated rows, subjects with several rows, without a key and with null values, and pages about subjects of the tables."""
    folder = tmp_path_factory.mktemp("odd")
    for table in TABLES:
        df = spark.read.parquet(f"{DATA}/{table}.parquet")
        few = df.limit(7)
        more = {
            "lineitem": lambda: [few, few.withColumn("l_quantity", F.lit(-1.0)), few.withColumn("l_orderkey", F.lit(None).cast("bigint"))],
            "customer": lambda: [few.withColumn("c_mktsegment", F.lit("OTHER")), few.withColumn("c_custkey", F.col("c_custkey") + 10**6).withColumn("c_name", F.lit(None).cast("string"))],
            "orders": lambda: [few.withColumn("o_custkey", F.lit(None).cast("bigint")).withColumn("o_orderkey", F.col("o_orderkey") + 10**6)],
            "region": lambda: [few],
            "pages": lambda: [few.withColumn("url", F.concat(F.lit(dataset.BASE + k), F.col("page_id"))) for k in ("customer/", "part/")],
        }.get(table, list)()
        for x in more:
            df = df.unionByName(x)
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


@pytest.mark.parametrize("where", ["plain", "odd"])
def test_patterns_are_those_of_quads(spark, odd, where):
    folder = {"plain": "/root/testdata/sf0.01", "odd": odd}[where]
    quads, (tables, rest) = dataset.quads(spark, folder), dataset.stars(spark, folder)
    assert (rest is None) == (where == "plain")
    assert rows(stars.mine(tables, rest)) == rows(mining.mine(quads))
    assert rows(stars.mine(tables, rest, by_graph=True)) == rows(mining.mine_datasets(quads))
    for g in ("sales", "supply", "web", "kinds"):
        assert rows(stars.mine_graph(tables, rest, dataset.GRAPH + g)) == rows(mining.mine(quads, scope=[dataset.GRAPH + g]))


def test_equal_facts_of_a_row_count_once(spark):
    made = spark.createDataFrame([(1, "urn:A", "urn:A", "x"), (2, "urn:A", "urn:B", "x"), (3, None, "urn:B", None)], "k int, a string, b string, v string")
    said = [("g", "type", "iri", None, "a"), ("g", "type", "iri", None, "b"), ("g", "urn:p", "literal", "d", "v"), ("h", "urn:p", "literal", "d", "concat(v, '')"), ("g", "urn:to", "iri", None, "concat('urn:s/', k - 1)"), ("h", "urn:to", "iri", None, "concat('urn:s/', '1')"), ("g", "urn:b", "bnode", None, "'_:x'")]
    star = stars.Stars(made, "concat('urn:s/', k)", [(g, stars.terms.TYPE if p == "type" else p, *x) for g, p, *x in said])
    each = F.inline(F.array(*(F.struct(F.lit(g).alias("g"), F.lit(p).alias("p"), F.expr(o).alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("dt")) for g, p, kind, dt, o in star.facts)))
    quads = made.select(F.expr(star.subject).alias("s"), each).withColumn("lang", F.lit(None).cast("string"))
    assert rows(stars.mine([star])) == rows(mining.mine(quads))
    assert rows(stars.mine([star], by_graph=True)) == rows(mining.mine_datasets(quads))


def test_numbered_iris_meet_as_their_texts_do(spark):
    """A head and a whole number is a number; texts that say the same meet it, others don't, nor do heads that begin with another."""
    things = spark.createDataFrame([(1, "A", 12), (12, "B", -(2**63)), (-(2**63), "A", None), (2**63 - 1, "C", 7)], "k bigint, c string, to bigint")
    texts = spark.createDataFrame([(1, "urn:s/1"), (2, "urn:s/012"), (3, "urn:s/-9223372036854775808"), (4, "urn:s/9223372036854775807"), (5, "urn:s/ 1"), (6, None), (7, "urn:s/1"), (8, "urn:q/12")], "n int, v string")
    tens = spark.createDataFrame([(2, 1), (3, 2)], "m int, w int")
    said = lambda *rows: [("urn:g", stars.terms.TYPE if p == "type" else p, "iri", None, o) for p, o in rows]
    tables = [
        stars.Stars(things, "concat('urn:s/', k)", said(("type", "concat('urn:', c)"), ("type", "'urn:A'"), ("urn:to", "concat('urn:s/', to)"), ("urn:to", "'urn:s/12'"))),
        stars.Stars(texts, "concat('urn:t/', n)", said(("type", "'urn:T'"), ("urn:said", "v"), ("urn:ten", "concat('urn:q/', n)"))),
        stars.Stars(tens, "concat('urn:q/1', m)", said(("type", "'urn:Q'"), ("urn:ten", "concat('urn:q/1', w)"), ("urn:t", "concat('urn:t/', m)"))),
    ]
    quads = None
    for x in tables:
        each = F.inline(F.array(*(F.struct(F.lit(g).alias("g"), F.lit(p).alias("p"), F.expr(o).alias("o"), F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("dt")) for g, p, kind, _, o in x.facts)))
        part = x.rows.select(F.expr(x.subject).alias("s"), each).withColumn("lang", F.lit(None).cast("string"))
        quads = part if quads is None else quads.unionByName(part)
    assert rows(stars.mine(tables)) == rows(mining.mine(quads))
    own = tables[0].rows.where("k = 1")
    others = quads.where("s <> 'urn:s/1' and s not like 'urn:t/%' and s not like 'urn:q/%'")
    assert rows(stars.mine([stars.Stars(own, tables[0].subject, tables[0].facts), *tables[1:]], others)) == rows(mining.mine(quads))


@pytest.mark.parametrize("by_graph", [False, True])
def test_patterns_of_plain_tables_need_no_text_of_numbered_iris(spark, by_graph):
    """What is grouped, moved and joined for each row is a number."""
    tables, rest = dataset.stars(spark, "/root/testdata/sf0.01")
    plan = stars.mine(tables, rest, by_graph)._jdf.queryExecution().executedPlan().toString()
    assert rest is None and "l_orderkey" in plan and f"concat({dataset.BASE}" not in plan


def test_rows_alike_are_found_by_hash_and_told_apart_by_key(spark, odd):
    """Of subjects of several numbers only hashes are counted, and no row of another subject is taken for a copy."""
    found = {r.s for r in dataset._repeated(spark, odd, [x for x in dataset.stars(spark, odd)[0] if "line/" in x.subject]).collect()}
    lines = [r.s for r in spark.read.parquet(f"{odd}/lineitem.parquet").select(F.expr(dataset._fill(dataset._LINE)).alias("s")).where("s is not null").collect()]
    assert {s for s in found if "/line/" in s} == {s for s in lines if lines.count(s) > 1} != set()
    assert any(k[1] == odd and k[2].startswith("hashes of") for k in dataset._kept)


@pytest.mark.parametrize("where", ["plain", "odd"])
def test_what_is_looked_up_in_facts_is_in_quads(spark, odd, where):
    folder = {"plain": DATA, "odd": odd}[where]
    quads, names = dataset.quads(spark, folder), dataset.prefixes(spark)
    assert rows(mapping_queries.class_index(spark, folder)) == rows(lookup.class_index(quads, mapping_queries._entities(spark, folder), names))
    assert rows(dataset.graphs(spark, folder)) == rows(quads.select("g").distinct())
    graph = dataset.GRAPH + "places"
    assert rows(dataset.facts(spark, folder, graph=graph).distinct()) == rows(quads.where(F.col("g") == graph))
    found = [(r.uri_format, r.matched_class) for r in mapping_queries.probe_hits(spark, folder).collect()]
    assert set(found) == {(f, c) for f in {x for x, _ in found} for (c,) in quads.where((F.col("p") == stars.terms.TYPE) & F.col("s").startswith(f)).select("o").distinct().collect()}


@pytest.mark.parametrize("name", ["schema_properties", "schema_edges", "graph_metrics", "graph_layers", "class_index_nested", "class_index_saved", "classes_of_entity", "concatenated_runs", "derive_filtered_top20"])
def test_no_quads_are_stored_for_it(spark, name, tmp_path):
    """Making and storing all quads costs more than the query."""
    folder = f"{tmp_path}/tables"
    (tmp_path / "tables").symlink_to(DATA)
    query = next(getattr(m, name) for m in (mining_queries, graph_queries, mapping_queries, run_queries) if hasattr(m, name))
    assert query(spark, folder).count() > 0
    assert not [k for k in dataset._kept if k[1] == folder and k[2] == "quads"]
