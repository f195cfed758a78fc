"""Mining on a hand-made set of quads with what the tables don't have."""

import pytest
from quadrille.functions import terms
from quadrille.operators import mining, void

V, D = "http://v.org/", "http://d.org/"
QUAD = "g string, s string, s_kind string, p string, o string, o_kind string, dt string, lang string"


def iri(g, s, p, o, kind="iri"):
    return (g, s, "bnode" if s.startswith("_:") else "iri", p, o, kind, None, None)


def text(g, s, p, o, dt=terms.XSD + "string", lang=None):
    return (g, s, "iri", p, o, "literal", dt, lang)


ROWS = [
    iri("g1", D + "a", terms.TYPE, V + "A"),
    iri("g1", D + "a", terms.TYPE, V + "A2"),
    iri("g1", D + "a", terms.TYPE, V + "A3"),
    iri("g1", D + "b", terms.TYPE, V + "B"),
    iri("g1", D + "a", V + "knows", D + "b"),
    iri("g2", D + "a", V + "knows", D + "b"),  # the same triple in a second graph, where neither end has a type
    iri("g2", D + "c", terms.TYPE, V + "B"),
    iri("g2", D + "c", V + "knows", D + "b"),
    iri("g1", D + "a", V + "sees", "_:x", "bnode"),  # typed
    iri("g1", "_:x", terms.TYPE, V + "X"),
    iri("g1", D + "a", V + "hides", "_:y", "bnode"),  # untyped: no pattern
    iri("g1", D + "b", V + "page", "http://elsewhere.org/1"),
    text("g1", D + "b", V + "name", "bee"),
    text("g1", D + "b", V + "name", "Biene", terms.RDF + "langString", "de"),
    text("g1", D + "b", V + "name", "Biene", terms.RDF + "langString", "nl"),
    text("g1", D + "b", V + "size", "?", None),
    iri("g1", D + "e", terms.TYPE, "not an iri"),
    text("g1", V + "A", terms.RDFS + "label", "Class A"),
    text("g1", V + "A", terms.SKOS + "prefLabel", "A better one?"),
    text("g2", V + "knows", terms.SKOS + "altLabel", "zz"),
    text("g2", V + "knows", terms.SKOS + "altLabel", "is friends with"),
]


@pytest.fixture(scope="module")
def quads(spark):
    return spark.createDataFrame(ROWS + ROWS[:3], QUAD)  # with repeated rows


def brute(rows, scope=None):
    rows = set(rows)
    if scope is not None:
        rows = {r for r in rows if r[0] in scope}
    else:
        rows = {(None, *r[1:]) for r in rows}
    types = {}
    for g, s, _, p, o, *_ in rows:
        if p == terms.TYPE:
            types.setdefault((g, s), set()).add(o)
    count = {}
    for g, s, _, p, o, kind, dt, _ in rows:
        for c in types.get((g, s), ()):
            ends = ["Literal"] if kind == "literal" else sorted(types.get((g, o), ())) or (["Resource"] if kind == "iri" else [])
            for end in ends:
                key = (c, p, end, dt if kind == "literal" else None)
                count[key] = count.get(key, 0) + 1
    return count


def found(df):
    return {(r.subject_class, r.property_uri, r.object_class, r.datatype): r["count"] for r in df.collect()}


@pytest.mark.parametrize("scope", [None, ["g1"], ["g1", "g2"], ["nowhere"]])
def test_patterns_in_scope(quads, scope):
    assert found(mining.mine(quads, scope)) == brute(ROWS, scope)
    split = {}
    for part in (mining.typed_object_patterns, mining.literal_patterns, mining.untyped_uri_patterns):
        split |= found(part(quads, scope))
    assert split == brute(ROWS, scope)


def test_type_sets_give_the_same(quads):
    assert found(mining.mine_by_typesets(quads)) == brute(ROWS)


def test_only_some_classes(spark, quads):
    only = spark.createDataFrame([(V + "B",)], "class string")
    assert found(mining.mine(quads, only=only)) == {k: n for k, n in brute(ROWS).items() if k[0] == V + "B"}


def test_fallback(spark, quads):
    extra = spark.createDataFrame([iri("g3", D + "z", terms.TYPE, "_:q", "bnode")], QUAD)
    both = quads.unionByName(extra)
    got, fell = mining.mine_with_fallback(both, ["g3"])
    assert fell and found(got) == brute(ROWS)
    got, fell = mining.mine_with_fallback(both, ["g1"])
    assert not fell and found(got) == brute(ROWS, ["g1"])


def test_validity_services_and_labels(quads):
    mined = mining.mine(quads)
    good, bad = mining.split_valid(mined)
    assert {r.subject_class for r in bad.collect()} == {"not an iri"}
    assert all(not r.property_uri.startswith(terms.RDF) for r in mining.without_services(good).collect())
    assert found(mining.without_services(good, [V]).drop()) == {}
    labels = {r.uri: r.label for r in mining.labels(quads).collect()}
    assert labels == {V + "A": "Class A", V + "knows": "is friends with"}
    named = {(r.subject_class, r.property_uri): (r.subject_label, r.property_label) for r in mining.with_labels(mined, mining.labels(quads)).collect()}
    assert named[V + "A", V + "knows"] == ("Class A", "is friends with") and named[V + "B", V + "name"] == ("B", "name")


def test_void_round_trip_and_shared_nodes(quads):
    mined = mining.split_valid(mining.mine(quads))[0]
    assert found(void.from_triples(void.to_triples(mined))) == found(mined)
    names = lambda df: df.where("property_uri = 'http://v.org/name'").count()
    shared = void.to_triples(mined.where("property_uri = 'http://v.org/name'"), by_datatype=False)
    assert shared.select("s").distinct().count() == 1 and names(mined) == 2


def test_partitions_as_stores_publish_them(spark):
    v, x = terms.VOID, terms.VOID_EXT
    rows = [iri("g", *t) for t in [
        ("d", v + "classPartition", "cp"), ("cp", v + "class", V + "A"), ("cp", v + "propertyPartition", "pp"), ("pp", v + "property", V + "knows"),
        ("pp", v + "classPartition", "op"), ("op", v + "class", V + "B"), ("cp", v + "propertyPartition", "pl"), ("pl", v + "property", V + "name"),
        ("pl", x + "datatypePartition", "dp"), ("dp", x + "datatype", terms.XSD + "string"), ("pp", v + "triples", "5"),
        ("ls", v + "linkPredicate", V + "link"), ("ls", v + "subjectsTarget", "st"), ("ls", v + "objectsTarget", "ot"), ("st", v + "class", V + "A"), ("ot", v + "class", V + "C"),
    ]]
    got = {tuple(r) for r in void.partitions(spark.createDataFrame(rows, QUAD), ["g"]).collect()}
    assert got == {(V + "A", V + "knows", V + "B", None, 5), (V + "A", V + "name", None, terms.XSD + "string", None), (V + "A", V + "link", V + "C", None, None)}


def test_no_quads(spark):
    none = spark.createDataFrame([], QUAD)
    assert found(mining.mine(none)) == {} and void.coverage(none).count() == 0 and mining.classes(none).count() == 0
