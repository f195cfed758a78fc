"""Readers and writers: round trips, and fixtures written here in the layouts that exist in the wild."""

import json

import pytest
from quadrille.functions import terms
from quadrille.operators import convert, mappings
from quadrille.sources import catalogue, jsonld, rdf
from test_mining import QUAD

V = "http://v.org/"


def test_ntriples_lines(spark):
    lines = [
        '<http://a/1> <http://p/x> "say \\"hi\\"\\n\\u00e9 \\\\u0041" .',
        '<http://a/1> <http://p/x> "hallo"@de-AT <http://g/1> .',
        '_:b1 <http://p/x> "5"^^<http://www.w3.org/2001/XMLSchema#integer> . # note',
        "<http://a/1> <http://p/y> _:b1 <http://g/2> .",
        "# a comment", "", "broken line",
    ]
    got = {tuple(r) for r in rdf.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "http://g/0").collect()}
    assert got == {
        ("http://g/0", "http://a/1", "iri", "http://p/x", 'say "hi"\né \\u0041', "literal", terms.XSD + "string", None),
        ("http://g/1", "http://a/1", "iri", "http://p/x", "hallo", "literal", terms.RDF + "langString", "de-at"),
        ("http://g/0", "_:b1", "bnode", "http://p/x", "5", "literal", terms.XSD + "integer", None),
        ("http://g/2", "http://a/1", "iri", "http://p/y", "_:b1", "bnode", None, None),
    }


def test_ntriples_files(spark, tmp_path):
    rows = [("g:1", "http://a/1", "iri", "http://p/x", 'tab\tquote"\\ back\nnew', "literal", terms.XSD + "string", None), ("g:1", "_:z", "bnode", "http://p/x", "x", "literal", terms.RDF + "langString", "en"), (None, "http://a/1", "iri", "http://p/y", "_:z", "bnode", None, None)]
    quads = spark.createDataFrame(rows, QUAD)
    rdf.write(quads, str(tmp_path / "q"))
    assert {tuple(r) for r in rdf.read(spark, str(tmp_path / "q")).collect()} == set(rows)
    (tmp_path / "bad.nt").write_text("# fine\n\nnot a line\n")
    assert [r.value for r in rdf.rejected(spark, str(tmp_path / "bad.nt")).collect()] == ["not a line"]


PATTERNS = [
    (V + "A", V + "knows", V + "B", None, 3), (V + "A", V + "knows", V + "C", None, 2), (V + "A", V + "knows", "Resource", None, 7),
    (V + "A", V + "name", "Literal", terms.XSD + "string", 5), (V + "A", V + "name", "Literal", terms.XSD + "date", 1), (V + "B", V + "A", V + "A", None, None),
]
KEYS = "subject_class string, property_uri string, object_class string, datatype string, count bigint"


@pytest.fixture(scope="module")
def patterns(spark):
    return spark.createDataFrame(PATTERNS, KEYS)


@pytest.fixture(scope="module")
def prefixes(spark):
    return spark.createDataFrame([("v", V, "v"), ("xsd", terms.XSD, "xsd")], "prefix string, ns string, resource string")


def test_schema_round_trip_keeps_every_count(spark, patterns, prefixes):
    text = jsonld.write_schema(patterns, prefixes, {"dataset_name": "d"})
    document = json.loads(text)
    assert document["@about"]["pattern_count"] == 6 and document["@context"]["v"] == V
    back = jsonld.read_schema(spark.createDataFrame([("x", text)], "path string, doc string"))
    assert {tuple(r) for r in back.select("subject_class", "property_uri", "object_class", "datatype", "count").collect()} == set(PATTERNS)


def test_schema_written_elsewhere(spark):
    doc = {
        "@context": {"v": V, "xsd": terms.XSD},
        "@graph": [{"@id": "v:A", "v:z": [{"@id": "v:B"}, {"@type": "xsd:string"}], "v:a": {"@id": "Resource"}, "_counts": {"v:z": {"v:B": 4, "xsd:string": 2}, "v:a": {"rdfs:Resource": 9}}, "void:inDataset": {"@id": "v:d"}}],
        "_labels": {"v:A": "An A"},
    }
    got = jsonld.read_schema(spark.createDataFrame([("x", json.dumps(doc))], "path string, doc string")).orderBy("key_pos", "object_class").collect()
    assert [(r.property_uri, r.object_class, r.datatype, r["count"], r.subject_label) for r in got] == [
        (V + "z", "Literal", terms.XSD + "string", 2, "An A"), (V + "z", V + "B", None, 4, "An A"), (V + "a", "Resource", None, 9, "An A"),
    ]


def test_mapping_documents(spark, prefixes):
    rows = [("s", V + "A", V + "B", terms.SKOS + "exactMatch", "d1", "d2", 0.5), ("s", V + "A", V + "C", terms.SKOS + "exactMatch", "d1", "d1", None), ("s", V + "B", "no iri", terms.SKOS + "exactMatch", "d1", "d2", None), ("s", V + "B", V + "C", terms.SKOS + "exactMatch", "d1", "d2", 1.5)]
    edges = spark.createDataFrame(rows, "strategy string, source_class string, target_class string, predicate string, source_dataset string, target_dataset string, confidence double")
    good = mappings.valid(edges)
    assert good.count() == 2
    text = jsonld.write_mapping(good, prefixes, {"strategy": "s"})
    back = jsonld.read_mappings(spark.createDataFrame([("x", text)], "path string, doc string"))
    assert {tuple(r) for r in back.select(*edges.columns).collect()} == {tuple(r) for r in rows[:2]}
    merged = mappings.merge(good, good)
    assert {tuple(r) for r in merged.select(*edges.columns).collect()} == {tuple(r) for r in rows[:2]}
    assert mappings.merge_context({"a": "1"}, {"a": "2", "b": "3"}) == {"a": "1", "b": "3"} and mappings.ordered_union(["x", "y"], ["y", "z"]) == ["x", "y", "z"]


def test_linkml_shacl_and_rdfconfig(patterns, prefixes):
    yaml = pytest.importorskip("yaml")
    model = yaml.safe_load(convert.to_linkml(patterns, prefixes, "demo"))
    assert set(model["classes"]) == {"v_A", "v_B", "v_C", "rdfs_Resource"}
    assert model["classes"]["v_A"]["slots"] == ["v_knows", "v_name"] and model["classes"]["v_B"]["slots"] == ["has_v_A"]
    assert model["slots"]["v_name"]["range"] == "string" and model["slots"]["has_v_A"]["range"] == "v_A"
    shapes = convert.to_shacl(patterns, prefixes, suffix="Shape")
    assert shapes.count("sh:NodeShape") == 2 and f"sh:path <{V}name> ; sh:datatype xsd:string" in shapes
    files = convert.to_rdfconfig(patterns, prefixes, "http://e/sparql")
    assert yaml.safe_load(files["model"])[0] == {"A v:A": [{"v:knows": [{"a_knows": "Resource"}]}, {"v:name": [{"a_name": "a_name_value"}]}]} or "A v:A" in files["model"]
    assert "v: <http://v.org/>" in files["prefix"] and "http://e/sparql" in files["endpoint"]


def test_export_writes_every_format(spark, patterns, prefixes, tmp_path):
    out = convert.export(patterns, prefixes, str(tmp_path), "demo")
    assert {"jsonld", "void", "linkml", "shacl", "rdfconfig_model"} <= set(out)
    assert rdf.read(spark, out["void"]).count() > 10
    with pytest.raises(ValueError):
        convert.export(patterns, prefixes, str(tmp_path), "demo", ("pdf",))


def test_catalogue_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("- name: one\n  endpoint: http://e/1\n  graph_uris: http://g\n  download_ttl: http://f/x.ttl.gz\n  counts: 'no'\n- name: two\n  endpoint: http://e/2\n  endpoint_down: true\n- name: three\n")
    rows = catalogue.read(spark, str(tmp_path / "s.yaml"))
    one = rows.where("name = 'one'").first()
    assert one.graph_uris == ["http://g"] and one.counts is False and one.two_phase is True
    good, skipped = catalogue.usable(rows)
    assert [r.name for r in good.collect()] == ["one"] and {(r.name, r.reason) for r in skipped.collect()} == {("two", "endpoint down"), ("three", "no endpoint")}
    assert {(r.name, r.mode, r.format) for r in catalogue.modes(rows).collect()} == {("one", "both", "ttl"), ("two", "unknown", None), ("three", "unknown", None)}
    assert [r.endpoint for r in catalogue.on_ports(rows, {"one": 7001}).collect()] == ["http://localhost:7001"]
    assert [r.name for r in catalogue.named(rows, "^T").orderBy("name").collect()] == ["three", "two"]
    (tmp_path / "s.csv").write_text("dataset_name,endpoint_url,keywords\none,http://e/1,a|b\n")
    assert catalogue.read(spark, str(tmp_path / "s.csv")).first().keywords == ["a", "b"]
    (tmp_path / "s.jsonld").write_text(catalogue.to_jsonld(rows))
    assert {r.name for r in catalogue.read(spark, str(tmp_path / "s.jsonld")).collect()} == {"one", "two", "three"}
    with pytest.raises(ValueError):
        catalogue.read(spark, "s.docx")


def test_sssom(spark, prefixes, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m.sssom.tsv").write_text("#curie_map:\n#  x: http://x.org/\nsubject_id\tpredicate_id\tobject_id\tconfidence\nx:1\tskos:exactMatch\tv:2\t0.9\nbad\tskos:exactMatch\tv:2\t\n")
    got = catalogue.read_sssom(spark, str(tmp_path / "m.sssom.tsv"), prefixes, "d").collect()
    assert [(r.source_class, r.predicate, r.target_class, r.source_dataset, r.target_dataset, r.confidence) for r in got] == [("http://x.org/1", terms.SKOS + "exactMatch", V + "2", "x", "v", 0.9)]


def test_reports_and_schema_files(spark, tmp_path):
    run = tmp_path / "chunk100_batch15_cc5"
    run.mkdir()
    (run / "d_report.json").write_text(json.dumps({"dataset_name": "d", "total_duration_s": 2.5, "query_stats": {"patterns/x": {"sent": 1, "failed": 0, "total_time_s": 1.5}}}))
    (run / "d_schema.jsonld").write_text("{}")
    (run / "d.meta-data.json").write_text(json.dumps({"num-triples": {"normal": 12}}))
    from quadrille.operators import reports

    row = reports.with_config(reports.phase_time(catalogue.read_reports(spark, str(tmp_path)), {"p": "patterns/"})).first()
    assert (row.dataset_name, row.p, row.chunk_size, row.class_batch, row.class_chunk, row.is_one_shot) == ("d", 1.5, 100, 15, 5, False)
    assert [tuple(r) for r in catalogue.read_triple_counts(spark, str(tmp_path)).collect()] == [("d", 12)]
    assert catalogue.schema_files(spark, str(tmp_path), ["chunk*"]).count() == 1 and catalogue.schema_files(spark, str(tmp_path), ["other*"]).count() == 0
