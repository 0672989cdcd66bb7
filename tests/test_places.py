"""Names in texts against a look for every name."""

import random

import pytest
from pyspark.sql import functions as F

from quaystone import adapters as a
from quaystone.operators import places, windows
from quaystone.registry import ports


def brute(rows, names):
    known = {n.lower() for n in names if n}
    return sorted((k, n) for k, t in rows if t is not None for n in known if n in t.lower())


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_mentions(spark, monkeypatch, limit):
    rng = random.Random(1)
    names = ["Oak", "oakland", "land", "Fog", "", None, "Zürich", "ÜR", "a b", "OAK"] + [f"place {i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(["Oakland", "FOG", "zürich", "a  b", "a b", "place 7", "place 49.", "x"]) for _ in range(rng.randrange(5)))) for i in range(200)] + [(900, None), (901, "")]
    monkeypatch.setattr(places, "NAMES_BYTES", limit)
    got = places.mentions(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", "text", spark.createDataFrame([(n,) for n in names], "n string"))
    assert sorted(map(tuple, got.collect())) == brute(rows, names)
    assert places.mentions(spark.createDataFrame(rows, "id long, text string"), "id", "text", spark.createDataFrame([], "n string")).count() == 0


def test_fifty_thousand_names(spark):
    rng = random.Random(2)
    names = [f"{''.join(rng.choices('abcdefghij', k=6))} {i}" for i in range(50_000)]
    rows = [(i, f"near {rng.choice(names).upper()}; or {rng.choice(names)}9 too") for i in range(2000)]
    registry = spark.createDataFrame([(f"p{i}", i, "ABC"[i % 3], n) for i, n in enumerate(names)], "port_id string, ord long, state string, name string")
    texts = spark.createDataFrame([(i, "ABCD"[i % 4], t) for i, t in rows], "id long, state string, area string")
    got = {r.id: r.port_id for r in places.place_of_text(texts, "id", "area", registry).collect()}
    place = {n: i for i, n in enumerate(names)}
    assert set(got) == {i for i, _ in rows if i % 4 < 3}
    for i, t in rows:
        if i % 4 < 3:
            words = t.lower().replace(";", " ;").split()
            # Names that are in the text: a name is a word and a number, and its number may go on in the text.
            mine = [place[n] for j in range(len(words) - 1) for n in (f"{words[j]} {words[j + 1][:k]}" for k in range(1, 7)) if n in place]
            mine = [j for j in mine if j % 3 == i % 4]
            assert got[i] == f"p{min(mine) if mine else i % 4}"


def test_same_rows_as_the_join_by_state(spark):
    n = a.a_nws(spark, "/root/testdata/sf0.001").select(F.col("event_id").alias("id"), a.pick(["CA", "NJ", "GA", "WA", "TX"], F.col("event_id") % 5).alias("state"), a.pick(["Off Oakland", "Greater Los Angeles", "Savannah", "Puget Sound"], F.col("event_id") % 4).alias("area"))
    city = F.lower(F.trim(F.get(F.split("name", "/"), F.lit(0))))
    p = ports(spark).select("port_id", "ord", "state", city.alias("name"))
    want = windows.keep_first(n.join(p, "state"), ["id"], F.desc(F.lower("area").contains(F.col("name"))), F.col("ord")).select("id", "port_id")
    assert sorted(map(tuple, places.place_of_text(n, "id", "area", p).collect())) == sorted(map(tuple, want.collect()))
