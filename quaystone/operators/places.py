"""Many names in texts, found in one scan of each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # the slower way looks for every name
    ahocorasick = None

#: Bytes of all names up to which they are broadcast; more go in groups of that size, each a pass over the texts.
NAMES_BYTES = 16 << 20


class Names:
    """An automaton over lower-case names; a worker builds it once."""

    _built: dict[int, object] = {}

    def __init__(self, names: list[str]):
        self.names, self.key = names, hash(tuple(names))

    def automaton(self):
        if self.key not in Names._built:
            made = ahocorasick.Automaton()
            for i, name in enumerate(self.names):
                made.add_word(name, i)
            made.make_automaton()
            Names._built = {self.key: made}
        return Names._built[self.key]

    def found(self, text: str) -> list[int]:
        """Places of the names that the text holds."""
        if ahocorasick is None:
            return [i for i, name in enumerate(self.names) if name in text]
        made = self.automaton()
        return sorted({i for _, i in made.iter(text)}) if len(made) else []


def _groups(names: DataFrame) -> Iterator[list[str]]:
    group, size = [], 0
    for r in names.toLocalIterator():
        group.append(r[0])
        size += len(r[0].encode())
        if size >= NAMES_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """key and name (lower case) for every name that a row's text holds anywhere, whatever the case. names: one column; empty and
    null ones are never held, nor is anything by null texts. key names a row."""
    spark = texts.sparkSession
    known = names.select(F.lower(F.col(names.columns[0])).alias("name")).filter("name <> ''").distinct()
    kind, out = dict(texts.dtypes)[key], None
    for group in _groups(known):
        shared = spark.sparkContext.broadcast(Names(group))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [shared.value.found(t) for t in batch.column("text").to_pylist()]
                rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                held = pa.array([shared.value.names[j] for f in found for j in f], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("key").take(rows), held], ["key", "name"])

        wanted = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text"))
        some = wanted.mapInArrow(run, f"key {kind}, name string").withColumnRenamed("key", key)
        out = some if out is None else out.unionByName(some)
    return out if out is not None else spark.createDataFrame([], f"`{key}` {kind}, name string")


def place_of_text(rows: DataFrame, key: str, text: str, registry: DataFrame) -> DataFrame:
    """key and port_id of the place of each row (key, state, text): of the registry's places (port_id, ord, state, name) of its state the
    first whose name is in the text, else the first of the state. Rows of a state without places go."""
    held = mentions(rows, key, text, registry.select("name"))
    first = F.min(F.struct("ord", "port_id")).alias("place")
    named = registry.select("port_id", "ord", "state", F.lower("name").alias("name"))
    of_text = held.join(rows.select(key, "state"), key).join(named, ["state", "name"]).groupBy(key).agg(first).select(key, F.col("place").alias("said"))
    of_state = registry.groupBy("state").agg(first)
    return rows.select(key, "state").join(of_state, "state").join(of_text, key, "left").select(key, F.coalesce("said", "place")["port_id"].alias("port_id"))
