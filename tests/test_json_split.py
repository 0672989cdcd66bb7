"""JSON documents cut at any place against json.loads of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quaystone.sources.json_split import _change, read_records

SCHEMA = "id string, note string, more struct<x:array<int>>"


def make(rng, i):
    note = rng.choice(["plain", 'quote " and } brace', "back\\slash", "{[", '"records": [', "é 中  ", "\\\" }", "", "x" * rng.randrange(40)])
    return {"id": str(i), "note": note, "more": {"x": [1, {"records": [1]}][: 1] if i % 3 else [i, 2]}}


def files(rng, folder):
    """Files of all shapes; returns the ids that count."""
    want, i = [], 0
    for n in range(24):
        rows = [make(rng, i + j) for j in range(rng.choice([0, 1, 3, 40]))]
        i += len(rows)
        ids = [r["id"] for r in rows]
        dump = lambda x: json.dumps(x, indent=rng.choice([None, 1, 4]), ensure_ascii=rng.random() < 0.5)
        shape = n % 8
        if shape in (0, 1):
            text = dump({"written_at": "}", "meta": {"records": 1, "deep": [{}]}, "records": rows, "count": {"n": len(rows)}}) + rng.choice(["", "\n", "  \n"])
        elif shape == 2:
            text = dump(rows) + rng.choice(["", "\n"])
        elif shape == 3:
            text = "\n".join(dump(r) for r in rows)
        elif shape == 4:
            text = "\n".join(json.dumps({"records": [r]}) for r in rows) + "\n"
        elif shape == 5:
            text, ids = dump({"records": rows})[: -rng.randrange(1, 3)].rstrip("}] \n"), []
            text = text if text.count("\n") or not rows else "\n" + text
        elif shape == 6:
            text = "\n".join([*(json.dumps(r) for r in rows), '{"id": "cut'])  # JSON lines whose writer died
            ids = ids if rows else []
        else:
            text, ids = rng.choice(["", "not json", "]", '{"records": []}', "[]", "{}}", "[1, 2]"]), []
        (folder / f"{n:02d}.json").write_text(text, encoding="utf-8")
        want += ids
    return want


@pytest.mark.parametrize(("seed", "split", "chunk"), [(1, "128m", 1 << 20), (2, "300", 60), (3, "97", 1)])
def test_any_split_gives_the_records_of_whole_files(spark, tmp_path, seed, split, chunk):
    want = files(random.Random(seed), tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = read_records(spark, str(tmp_path), SCHEMA, chunk).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.id for r in got) == sorted(want) and len(want) > 100
    notes = {}
    for p in tmp_path.iterdir():
        for line in [p.read_text(encoding="utf-8")]:
            try:
                found = json.loads(line)
            except ValueError:
                continue
            for r in found.get("records", [found]) if isinstance(found, dict) else found:
                if isinstance(r, dict) and "id" in r:
                    notes[r["id"]] = r["note"]
    assert len(notes) > 40 and all(r.note == notes[r.id] for r in got if r.id in notes)


def test_state_changes():
    assert _change('{"a": [1, {"b": "}"', False) == (False, 0, "{[{") and _change('"}', False) == (True, 0, "")
    assert _change('x\\" } " , "records" : [ ', True) == (False, 0, "R") and _change("}]", False) == (False, 2, "")
    assert _change("no end", True) == (True, 0, "")


def test_a_large_document_is_read_by_many_tasks(spark, tmp_path):
    """One indented document of 60 MB: many partitions, chunks of bounded size, all rows."""
    row = json.dumps({"id": "0", "note": "y" * 300, "more": {"x": [1]}}, indent=2)
    with open(tmp_path / "big.json", "w", encoding="utf-8") as f:
        f.write('{\n "source": "nws",\n "records": [\n')
        for i in range(150_000):
            f.write(row.replace('"0"', f'"{i}"') + (",\n" if i < 149_999 else "\n"))
        f.write("]\n}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        df = read_records(spark, str(tmp_path), SCHEMA)
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() >= 12
        got = df.agg(F.count("*"), F.count_distinct("id"), F.max(F.length("note"))).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(got) == (150_000, 150_000, 300)
