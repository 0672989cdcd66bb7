"""Near-duplicate line removal by a deletion-neighbourhood join, in DataFrame and SQL functions only.

Two lines of at least `MIN_CHARS` characters are linked if one edit (a character put in, taken out or replaced) makes them
equal; shorter lines only if they are equal. A line goes if an equal or linked line comes earlier in (doc_id, line number)
order, judged on the input.

Every line would emit as many variants as it has characters. An edit leaves all but one part of a line as it was, so lines
first meet on hashes of their halves, then of the line without one of four parts; what no other line shares can't be linked
and drops out, without loss. Of the rest, the variants with one character less inside the part in question are the join keys:
equal variants with the same gap differ by a replaced character, and a variant equal to a whole line by one put in. Each key
keeps its earliest line only, so groups of many lines give no pairs; candidates are verified by edit distance.

Cases: null text has no lines; blank lines stay; a null doc_id keeps all its lines; rows that repeat a doc_id have the same
line positions, so equal lines at the same position of them stay; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import shared_dir, stored

MIN_CHARS = 8


def _halves() -> Column:
    """Keys of the two halves, for a partner of the same length or longer (q = n) and for a shorter one (q = n - 1)."""
    key = "xxhash64({q}, 0, left(line, ({q}) div 2)), xxhash64({q}, 1, right(line, ({q}) - ({q}) div 2))"
    both = f"array({key.format(q='n')}, {key.format(q='n - 1')})"
    return F.expr(f"IF(n > {MIN_CHARS}, {both}, array({key.format(q='n')}))")


def _quarters() -> Column:
    """(key, q, part): the line without one of four parts, the places counted from the nearer end."""
    each = "named_struct('key', xxhash64({q}, {j}, concat(left(line, ({q}) * {j} div 4), '\\n', right(line, ({q}) - ({q}) * ({j} + 1) div 4))), 'q', {q}, 'part', {j})"
    same = ", ".join(each.format(q="n", j=j) for j in range(4))
    longer = ", ".join(each.format(q="n - 1", j=j) for j in range(4))
    return F.expr(f"IF(n > {MIN_CHARS}, array({same}, {longer}), array({same}))")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (key, h, ...) whose key another line has too."""
    alive = rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi").select("key")
    return rows.join(alive, "key")


def line_duplicates(docs: DataFrame) -> DataFrame:
    """Returns for each row of docs: doc_id, n_lines, n_removed and removed_lines (line numbers from 0, ascending)."""
    base = shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = known.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter("line <> ''")
    lines = lines.withColumns({"n": F.char_length("line"), "h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")})
    places = lines.select("doc_id", "line_no", "h", "g")
    texts = places.groupBy("h", "g").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    texts = stored(texts.select("h", "g", "first"), base, "texts")

    halves = lines.filter(F.col("n") >= MIN_CHARS).select("h", F.explode(_halves()).alias("key"))
    meeting = stored(_shared(halves).select("h").distinct().join(texts, "h"), base, "meeting")
    own_line = F.get(F.split("text", "\n"), F.col("first.line_no"))
    # A shuffle at every size: what meets grows with the lines.
    whole = known.hint("merge").join(meeting.withColumn("doc_id", F.col("first.doc_id")), "doc_id").select("h", "g", "first", own_line.alias("line"))
    whole = stored(whole.filter(F.xxhash64("line") == F.col("h")).dropDuplicates(["h", "g"]).withColumn("n", F.char_length("line")), base, "whole")

    parts = whole.select("h", "g", F.explode(_quarters()).alias("p")).select("h", "g", F.col("p.key").alias("key"), F.col("p.q").alias("q"), F.col("p.part").alias("part"))
    open_parts = stored(_shared(parts).select("h", "g", "q", "part").distinct().join(whole, ["h", "g"]), base, "parts")
    low, high = "q * part div 4 + 1", "q * (part + 1) div 4"
    gap = "concat(left(line, i - 1), substr(line, i + 1))"
    replaced = open_parts.filter(f"q = n AND {high} >= {low}").withColumn("i", F.explode(F.expr(f"sequence({low}, {high})"))).select(F.expr(f"xxhash64(n, i, {gap})").alias("key"), F.lit(0).alias("role"), "h", "g", "first")
    shorter = open_parts.filter("q = n - 1").withColumn("i", F.explode(F.expr(f"sequence({low}, {high} + 1)"))).select(F.expr(f"xxhash64(n - 1, 0, {gap})").alias("key"), F.lit(1).alias("role"), "h", "g", "first")
    full = open_parts.filter("q = n").select("h", "g", "first", "line", "n").distinct().select(F.expr("xxhash64(n, 0, line)").alias("key"), F.lit(2).alias("role"), "h", "g", "first")
    variants = replaced.unionByName(shorter).unionByName(full)
    earliest = variants.groupBy("key").agg(
        F.min(F.when(F.col("role") < 2, F.struct("first", "h", "g"))).alias("variant"), F.min(F.when(F.col("role") == 2, F.struct("first", "h", "g"))).alias("line"), F.count("*").alias("rows")
    )
    other = F.when(F.col("role") == 1, F.col("line")).otherwise(F.col("variant"))
    pairs = variants.join(earliest.filter("rows > 1"), "key").withColumn("other", other).filter("other.first < first")
    pairs = pairs.select("h", "g", F.col("other.h").alias("oh"), F.col("other.g").alias("og"), F.col("other.first").alias("earlier")).distinct()
    lines_of = whole.select("h", "g", "line")
    linked = (
        pairs.join(lines_of, ["h", "g"]).join(lines_of.toDF("oh", "og", "other_line"), ["oh", "og"])
        .filter(F.levenshtein("line", "other_line", 1) == 1).select("h", "g").distinct().withColumn("late", F.lit(True))
    )
    linked = stored(linked, base, "linked")

    removed = places.join(texts.join(linked, ["h", "g"], "left"), ["h", "g"]).filter(F.col("late") | (F.struct("doc_id", "line_no") != F.col("first")))
    removed = removed.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed_lines"))
    counts = docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    gone = F.coalesce("removed_lines", F.array().cast("array<int>"))
    # A row that repeats a doc_id with fewer lines has fewer to lose.
    return counts.join(removed, "doc_id", "left").select("doc_id", "n_lines", F.filter(gone, lambda x: x < F.col("n_lines")).alias("removed_lines")).select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs with the lines taken out that `line_duplicates` found; all columns stay. doc_id must be a key of both."""
    found = removed.select("doc_id", F.col("removed_lines").alias("__gone"))
    keep = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("__gone", F.array().cast("array<int>")), i))
    return docs.join(found, "doc_id", "left").withColumn("text", F.array_join(keep, "\n")).select(*docs.columns)
