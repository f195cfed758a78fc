import random

from hypothesis import given, settings
from hypothesis import strategies as st
from quadrille.llm import decontam as dc


def semi_global(item, text):
    """Smallest edit distance between item and any substring of text, by the plain dynamic programme."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120))
def test_myers_equals_the_dynamic_programme(item, text):
    assert dc.myers(dc.peq(item), len(item), text)[0] == semi_global(item, text)


@settings(max_examples=100, deadline=None)
@given(st.text(min_size=1, max_size=80), st.integers(0, 8))
def test_pieces_make_up_the_item(item, edits):
    cut = dc.pieces(item, edits)
    assert len(cut) == edits + 1 and "".join(p for _, p in cut) == item


def edited(r, text, n):
    for _ in range(n):
        i = r.randrange(len(text))
        text = text[:i] + r.choice(["", "x", text[i] + "y"]) + text[i + 1 :]
    return text


def test_same_leaks_as_brute_force(make):
    r = random.Random(11)
    words = ["ala", "bere", "cido", "dunu", "efe", "gol", "himi", "jak"]
    say = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, say(r.randint(8, 40))) for i in range(12)]
    docs = []
    for i in range(80):
        k = r.randrange(12)
        docs.append((i, say(30) + " " + edited(r, items[k][1], r.choice([0, 1, 2, 4, 9, 20])).replace(" ", "  \n").upper() + " " + say(30)))
    want = set()
    for d, text in docs:
        for k, item in items:
            item, e = dc.normal(item), dc.budget(len(dc.normal(item)))
            distance = semi_global(item, dc.normal(text))
            if distance <= e:
                want.add((d, k, distance))
    frame, bench = make(docs), make(items, "item_id bigint, text string")
    for chunk in (dc.CHUNK_CHARS, 100):
        got = {(x.doc_id, x.item_id, x.distance) for x in dc.leaks(frame, bench, chunk_chars=chunk).collect()}
        assert got == want and len(want) > 30
        left = {x.doc_id for x in dc.drop_contaminated(frame, bench, chunk_chars=chunk).collect()}
        assert left == {d for d, _ in docs} - {d for d, _, _ in want}


def test_defined_cases(make):
    item = "which of these seven rivers reaches the northern sea"
    bench = make([(1, item), (2, item), (3, None), (4, "short"), (5, ""), (None, item)], "item_id bigint, text string")
    rows = [(1, None, "a"), (2, "", "a"), (3, item, "a"), (3, item, "a"), (None, item, "a"), (4, "short", "a"), (5, "w " * 200_000 + item, "a")]
    docs = make(rows, "doc_id bigint, text string, item_id string")
    got = sorted(((x.doc_id or 0), (x.item_id or 0), x.distance) for x in dc.leaks(docs, bench).collect())
    assert got == sorted([(d, i, 0) for d in (0, 3, 3, 5) for i in (0, 1, 2)] + [(4, 4, 0)])
    left = dc.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(x.doc_id for x in left.collect()) == [1, 2]
    assert dc.leaks(docs.limit(0), bench).collect() == [] == dc.leaks(docs, bench.limit(0)).collect()
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_both_sides_are_folded_alike(make):
    items = [(1, "ΠΟΙΟΣ ΕΙΝΑΙ Ο ΠΑΛΑΙΟΤΕΡΟΣ ΦΑΡΟΣ ΤΗΣ ΒΟΡΕΙΑΣ ΑΚΤΗΣ"), (2, "İstanbul'un en eski İSKELESİ hangi kıyıdadır"), (3, "WELCHE STRASSE führt zum alten Straßenfest")]
    docs = [(i, f"vor {t} nach") for i, t in items] + [(i + 10, t.lower()) for i, t in items] + [(i + 20, "ΣΙΓΜΑ " + t.swapcase() + "ΣΙΓΜΑ") for i, t in items]
    got = {(r.doc_id, r.item_id): r.distance for r in dc.leaks(make(docs), make(items, "item_id bigint, text string")).collect()}
    want = {(d, i): semi_global(dc.normal(t), dc.normal(text)) for d, text in docs for i, t in items}
    assert got == {k: v for k, v in want.items() if v <= dc.budget(len(dc.normal(items[k[1] - 1][1])))} and len(got) == 9
    assert all(got[i, i] == got[10 + i, i] == 0 for i in (1, 3))


def test_short_items_are_whole_lines(make):
    docs = make([(1, "first line\n  What is  PI? \nend"), (2, "so what is pi? nobody knows"), (3, "what is pi?"), (4, "what is pie?")])
    got = [(r.doc_id, r.distance, r.edits_allowed, r.end_char) for r in dc.leaks(docs, make([(7, "What is pi?")], "item_id bigint, text string")).collect()]
    assert sorted(got) == [(1, 0, 0, 22), (3, 0, 0, 11)] and dc.normal("first line\n  What is  PI? \nend")[11:22] == "what is pi?"
