from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from quadrille.llm import urlfilter as u
from quadrille.llm.common import Scratch

URLS = ["https://a.example.org/x/", "http://A.Example.org:80/x#top", "https://b.example.org/", "https://u:p@b.example.org?q=1", "ftp://deep.bad.net/y", "https://notbad.net", None, "", "   ", "bad.net", "https://a.example.org/x/y"]
LIST = ["a.example.org/x", "bad.net", "bad.net", "b.example.org?q=1", None, ""]


def parts(form):
    """The canonical form, the host with its port, the host and its parent domains."""
    place = form.split("/", 1)[0].split("?", 1)[0]
    labels = place.split(":")[0].split(".")
    return [form, place, *(".".join(labels[i:]) for i in range(max(1, len(labels) - 1)))]


def brute(form, listed):
    return next((c for c in sorted(parts(form), key=len, reverse=True) if c in listed), None) if form else None


def key(text):
    """Spark's xxhash64, with its seed."""
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64))


def forms(pages):
    return {r.url: r.f for r in pages.select("url", u.canonical(F.col("url")).alias("f")).collect()}


def test_the_keys_are_64_bit_xxhash(make):
    texts = ["", "a", "é/ü?x=1", "x" * 300]
    assert [r.k for r in make(list(enumerate(texts))).coalesce(1).select(F.xxhash64("text").alias("k")).collect()] == [key(t) for t in texts]


def test_same_matches_as_brute_force(make):
    pages = make(list(enumerate(URLS, 1)) + [(1, URLS[0])], "page_id bigint, url string").withColumn("matched_entry", F.lit(1)).withColumn("candidates", F.lit(2))
    entries = make([(t,) for t in LIST], "entry string").repartition(3)
    got = u.blocked(pages, entries)
    assert got.columns == ["page_id", "url", "matched_entry", "candidates", "matched_entry_"]
    form = forms(pages)
    assert form["http://A.Example.org:80/x#top"] == "a.example.org/x" and form["https://u:p@b.example.org?q=1"] == "b.example.org?q=1"
    rows = got.collect()
    assert len(rows) == 12 and all(r.matched_entry_ == brute(form[r.url], set(LIST) - {None, ""}) for r in rows)
    assert sum(r.matched_entry_ is not None for r in rows) == 6
    none = make([], "entry string")
    assert all(r.matched_entry_ is None for r in u.blocked(pages, none).collect()) and u.blocked(pages.limit(0), entries).collect() == []


def test_ports_and_entries_in_any_form(make):
    long = "https://long.example/" + "p/" * 20_000 + "end"
    pages = make(list(enumerate(["http://evil.com:8080/x", "http://www.evil.com:8080", "http://port.org:81/", "http://port.org:82/", "http://star.net/a", "http://deep.star.net/", "http://fine.org/", long])), "page_id bigint, url string")
    entries = make([(t,) for t in ("http://Evil.com/", "EVIL.com", "port.org:81", "*.star.net", long.upper().replace("HTTPS://LONG.EXAMPLE", "LONG.example").replace("P/", "p/").replace("END", "end"))], "entry string")
    got = {r.page_id: r.matched_entry for r in u.blocked(pages, entries).collect()}
    assert got == {0: "evil.com", 1: "evil.com", 2: "port.org:81", 3: None, 4: "star.net", 5: "star.net", 6: None, 7: long[8:]}


def test_the_registered_list_has_urls_hosts_and_domains(make):
    urls = ["http://m.one.org/a", "http://m.one.org/b", "https://m.one.org/c", "http://x.two.org/", "http://y.two.org/", "https://z.two.org/q", "https://three.org/", "https://three.org/a", "http://three.org/b"]
    pages = make(list(enumerate(urls)), "page_id bigint, url string")
    count = defaultdict(list)
    for url in urls:
        for c in parts(url.split("://")[1].rstrip("/").split("/")[0])[2:]:
            count[c].append(url.startswith("http:"))
    want = {c for c, v in count.items() if 2 * sum(v) > len(v)} | {x.split("://")[1].rstrip("/") for x in urls if x.startswith("http:")}
    assert {r.entry for r in u.downgraded(pages).collect()} == want and {"m.one.org", "one.org", "two.org", "three.org/b"} <= want and "three.org" not in want


def test_a_collision_needs_the_stored_string(tmp_path):
    path = f"file://{tmp_path}/0-0"
    keys = np.array([-5, 7, 7, 9])
    u.write_array(keys, [b"low", b"first", b"second", b"third"], path)
    reader = u.DigestArray(((path, -5),)).open()
    asked = [(-9, "low"), (-5, "low"), (7, "second"), (7, "other"), (9, "third"), (10, "third")]
    assert list(reader.listed(np.array([k for k, _ in asked]), pa.array([t for _, t in asked]))) == [False, True, True, False, True, False]


@pytest.mark.parametrize("partitions", [1, 5])
def test_many_entries_over_several_files(spark, make, partitions):
    entries = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("entry"))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    array = u.build(entries, "entry", Scratch(spark))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    reader = array.open()
    texts = [f"h{i}.org" for i in range(0, 6000, 7)]
    assert list(reader.listed(np.array([key(t) for t in texts]), pa.array(texts))) == [i < 3000 for i in range(0, 6000, 7)]
