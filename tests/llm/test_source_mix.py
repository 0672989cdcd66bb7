import random

import numpy as np
import pytest

from quaystone.llm import source_mix
from quaystone.llm.source_mix import each_phase, exact_units, mixed, multiples, placed, scheduled, stretch_rows, stretch_table, walk, whole_units
from tests.llm.plain_mix import block_table, one_round, phases


def edf(blocks, units):
    """Slot by slot: among released blocks the earliest deadline; phases begin anew when a source runs out."""
    left, order = dict(blocks), []
    while any(left.values()):
        live = {s: u for s, u in units.items() if left[s]}
        total, done, t = sum(live.values()), dict.fromkeys(live, 0), 0
        while all(left[s] for s in live):
            ready = [s for s in live if done[s] * total // live[s] <= t]
            s = min(ready, key=lambda s: (-(-(done[s] + 1) * total // live[s]), done[s] * total // live[s], str(s)))
            order.append(s)
            done[s] += 1
            left[s] -= 1
            t += 1
            for x, u in live.items():
                assert abs(done[x] - t * u / total) < 1  # less than a block from the weight, at every slot
    return order


def test_rounds_and_phases_against_simulation():
    rng = random.Random(9)
    for _ in range(40):
        names = [f"s{i}" for i in range(rng.randint(1, 7))]
        units = whole_units({s: rng.random() + 0.01 for s in names}, rng.randint(5, 60))
        blocks = {s: rng.randint(1, 80) for s in names}
        slots = {}
        plan = phases(blocks, units)
        for i, p in enumerate(plan):
            for s, slot_list in p["rounds"].items():
                last = plan[i + 1]["first"].get(s, blocks[s]) if i + 1 < len(plan) else blocks[s]
                for k in range(p["first"][s], last):
                    j = k - p["first"][s]
                    slots[p["slot"] + j // len(slot_list) * p["size"] + slot_list[j % len(slot_list)]] = s
        assert [slots[t] for t in range(sum(blocks.values()))] == edf(blocks, units)


def test_slots_follow_the_callers_weights(spark):
    rng = random.Random(4)
    many = {f"s{i:03}": 400 if i else 60_000 for i in range(120)}
    cases = [(many, {s: n**0.5 for s, n in many.items()}), ({"a": 30_000, "b": 5}, {"a": 1e6, "b": 1.0}), ({f"t{i}": 900 for i in range(7)}, {f"t{i}": rng.random() ** 4 for i in range(7)})]
    for blocks, weights in cases:
        units = exact_units(weights)
        plan = phases(blocks, units)
        rows = block_table(plan, blocks, units).to_pylist()
        assert sorted(r["mix_slot"] for r in rows) == list(range(sum(blocks.values())))
        assert {(r["mix_source"], r["mix_block"]) for r in rows} == {(s, k) for s, n in blocks.items() for k in range(n)}
        assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in rows)
        order = [r["mix_source"] for r in sorted(rows, key=lambda r: r["mix_slot"])]
        for i, p in enumerate(plan[:3]):
            scale, end = sum(weights[s] for s in p["first"]), plan[i + 1]["slot"] if i + 1 < len(plan) else len(order)
            placed = dict.fromkeys(p["first"], 0)
            for t in range(p["slot"], end):
                placed[order[t]] += 1
                if t % 7 == 0 or t == end - 1:
                    assert all(abs(n - (t - p["slot"] + 1) * weights[s] / scale) < 1 + 1e-6 for s, n in placed.items())


def test_small_weights_are_not_rounded_up(spark):
    rows = [(i, "a" if i < 4000 else "b", "") for i in range(4050)]
    got = run(spark, rows, weights={"a": 1e6, "b": 1.0}, block_docs=1)
    assert sum(r.source == "b" for r in got if r.mix_slot < 3900) <= 1
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)


def test_more_sources_than_a_few_hundred(spark):
    rows = [(i, f"site{min(i % 700, i % 811)}", "") for i in range(6000)]
    got = run(spark, rows, block_docs=2)
    assert sorted(r.doc_id for r in got) == list(range(6000)) and len({(r.mix_slot, r.mix_place) for r in got}) == 6000
    assert len({r.source for r in got}) > 600


def test_round_is_full():
    slots = one_round({"a": 3, "b": 1, "c": 5})
    assert sorted(t for v in slots.values() for t in v) == list(range(9)) and len(slots["c"]) == 5


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    return mixed(df, **kw).collect()


def test_order_follows_weights(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), "x") for i in range(1500)]
    got = sorted(run(spark, rows, weights={"a": 1, "b": 2, None: 1}, block_docs=4, units=40), key=lambda r: (r.mix_slot, r.mix_place))
    assert sorted(r.doc_id for r in got) == list(range(1500))
    counts = {s: sum(r[1] == s for r in rows) for s in ("a", "b", None)}
    blocks = {("" if s is None else f"={s}"): -(-n // 4) for s, n in counts.items()}
    want = edf(blocks, whole_units({"=a": 1, "=b": 2, "": 1}, 40))
    seen = {}
    for r in got:
        seen.setdefault(r.mix_slot, "" if r.source is None else f"={r.source}")
    assert [seen[t] for t in range(len(want))] == want
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    early = [r for r in got if r.mix_slot < 100]
    assert abs(sum(r.source == "b" for r in early) - 200) < 8


def test_sources_without_weight_come_last_and_edge_cases(spark):
    rows = [(i, "a" if i % 2 else "z", "") for i in range(100)] + [(None, None, ""), (None, "a", ""), (7, "a", ""), (7, "a", "")]
    got = run(spark, rows, weights={"a": 1.0}, block_docs=3)
    assert len(got) == 104 and len({(r.mix_slot, r.mix_place) for r in got}) == 104
    assert max(r.mix_slot for r in got if r.source == "a") < min(r.mix_slot for r in got if r.source != "a")
    assert run(spark, []) == []


def test_many_sources_and_whole_rows(spark):
    """More than 500 sources, one of them hot; every row stays with all its columns, in blocks of its source."""
    rows = [(i, f"s{i % 700}" if i % 3 else "hot", f"text {i}", i % 5) for i in range(6000)] + [(None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot long")
    got = mixed(df).collect()
    assert sorted((r.doc_id or -1, r.source or "", r.text or "") for r in got) == sorted((d or -1, s or "", t or "") for d, s, t, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.mix_slot, []).append(r)
    assert sorted(slots) == list(range(len(slots))) and all(len({x.source for x in v}) == 1 and sorted(x.mix_place for x in v) == list(range(len(v))) for v in slots.values())


def planned(blocks, units):
    """All stretches one after another, as tasks work them out."""
    names = sorted(blocks)
    args = names, [blocks[s] for s in names], [units[s] for s in names]
    return [r for row in stretch_rows(*args[1:]) for batch in stretch_table(row, *args) for r in batch.to_pylist()]


@pytest.mark.parametrize("stretch", [3, 17, 1 << 16])
def test_stretches_against_the_plain_planner(stretch, monkeypatch):
    """Tasks that know no slot before their stretch give the schedule of a walk over all slots."""
    monkeypatch.setattr(source_mix, "STRETCH", stretch)
    monkeypatch.setattr(source_mix, "WALK", stretch)
    monkeypatch.setattr(source_mix, "LOOK", stretch)
    rng = random.Random(stretch)
    by_slot = lambda rows: sorted(rows, key=lambda r: r["mix_slot"])
    for trial in range(60):
        names = [f"s{i}" for i in range(rng.randint(1, 9))]
        weights = {s: rng.choice([1, 2, 3, rng.random() + 1e-3, rng.random() ** 6 + 1e-4]) for s in names}
        units = exact_units(weights) if trial % 2 else whole_units(weights, rng.randint(5, 60))
        blocks = {s: rng.randint(1, 150) for s in names}
        assert by_slot(planned(blocks, units)) == by_slot(block_table(phases(blocks, units), blocks, units).to_pylist())


def test_state_before_any_slot_is_that_of_a_walk():
    rng = random.Random(2)
    for _ in range(40):
        units = list(exact_units({i: rng.random() ** rng.choice([1, 4]) + 1e-4 for i in range(rng.randint(1, 30))}).values())
        order = walk(units, [0] * len(units), 0, 400)
        for t in range(0, 400, 7):
            assert placed(t, units) == np.bincount(order[:t], minlength=len(units)).tolist()


def test_multiples_are_exact():
    rng = random.Random(3)
    for bits in (3, 30, 60, 110):
        for _ in range(30):
            size, k = rng.getrandbits(bits) + 2, np.sort(np.array([rng.randrange(10 ** rng.randint(1, 9)) for _ in range(50)], np.int64))
            for unit in (1, 3, size, size - 1, rng.randrange(1, size), size // 2):
                for less in (0, 1):
                    assert multiples(k, size, unit, less).tolist() == [min(source_mix.FAR, (int(i) * size - less) // unit) for i in k]


def test_ten_million_blocks(spark):
    """The driver sees a row a source and a few stretches; at every slot tried each source is within one block of its weight."""
    weights = {f"s{i:02}": (i + 1) ** 0.5 for i in range(20)}
    units = exact_units(weights)
    total = sum(weights.values())
    blocks = {s: int(10_000_000 * w / total) + 5 for s, w in weights.items()}
    assert len(list(stretch_rows(list(blocks.values()), list(units.values())))) < 250
    slots = scheduled(spark, [(blocks, units)]).cache()
    n, ends, least, most, late = slots.selectExpr("count(*)", "count(DISTINCT mix_slot)", "min(mix_slot)", "max(mix_slot)", "count_if(mix_slot < mix_release OR mix_slot >= mix_deadline)").first()
    assert (n, ends, least, most, late) == (sum(blocks.values()), n, 0, n - 1, 0)
    for t in (65_535, 65_536, 1_234_567, 9_999_000):
        got = {r[0]: r[1] for r in slots.filter(f"mix_slot < {t}").groupBy("mix_source").count().collect()}
        assert all(abs(got[s] - t * w / total) < 1 for s, w in weights.items())
    slots.unpersist()


def test_the_least_weight_makes_stretches_longer_not_wrong(monkeypatch):
    monkeypatch.setattr(source_mix, "STRETCH", 50)
    units = exact_units({"a": 1.0, "b": 0.7, "c": 1e-3})
    blocks = {"a": 3000, "b": 2000, "c": 3}
    by_slot = lambda rows: sorted(rows, key=lambda r: r["mix_slot"])
    assert by_slot(planned(blocks, units)) == by_slot(block_table(phases(blocks, units), blocks, units).to_pylist())
