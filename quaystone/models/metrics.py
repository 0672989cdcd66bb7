"""Ranking metrics as window queries; rows with equal scores count together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of scores whose sums are added up first; scores inside a range are ordered in a task of their own.
RANGES = 1000


def by_score(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Per key and distinct score, from the top down: true and false positives so far, and totals. Sums over ranges of scores
    come first, so no task orders all scores of a key."""
    steps = df.filter(F.col(y).isNotNull()).groupBy(*keys, p).agg(F.sum(y).cast("long").alias("pos"), F.count("*").alias("n"))
    # Scores are probabilities as a rule; those outside 0 to 1 are in the ranges at the ends. Null scores come last.
    steps = steps.withColumn("__range", F.coalesce(F.least(F.greatest(F.floor(F.col(p) * RANGES), F.lit(0)), F.lit(RANGES - 1)), F.lit(-1)))
    sums = steps.groupBy(*keys, "__range").agg(F.sum("pos").alias("__pos"), F.sum("n").alias("__n"))
    above, all_ = Window.partitionBy(*keys).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    sums = sums.select(
        *keys, "__range", F.coalesce(F.sum("__pos").over(above), F.lit(0)).alias("__tp"), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__seen"),
        F.sum("__pos").over(all_).alias("positives"), F.sum("__n").over(all_).alias("total"),
    )
    down = Window.partitionBy(*keys, "__range").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"__own": F.sum("pos").over(down), "__count": F.sum("n").over(down)})
    out = steps.join(sums, [*keys, "__range"])  # at most RANGES + 1 rows a key
    return out.select(*keys, p, "pos", "n", (F.col("__tp") + F.col("__own")).alias("tp"), (F.col("__seen") + F.col("__count")).alias("seen"), "positives", "total")


def pr_curve(df: DataFrame, keys: list[str]) -> DataFrame:
    """threshold, precision, recall for each distinct score."""
    s = by_score(df, keys)
    return s.select(*keys, F.col("p").alias("threshold"), (F.col("tp") / F.col("seen")).alias("precision"), (F.col("tp") / F.nullif("positives", F.lit(0))).alias("recall"))


def average_precision(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of precision times the rise of recall; 0 with a single class."""
    s = by_score(df, keys)
    gain = F.sum(F.col("tp") / F.col("seen") * F.col("pos")) / F.max("positives")
    mixed = (F.max("positives") > 0) & (F.max("positives") < F.max("total"))
    return s.groupBy(*keys).agg(F.when(mixed, gain).otherwise(0.0).alias("pr_auc"))


def roc_auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mann-Whitney statistic from mean ranks; 0.5 with a single class."""
    s = by_score(df, keys)
    below = F.col("total") - F.col("seen")
    mean_rank = below + (F.col("n") + 1) / 2
    pos, neg = F.max("positives"), F.max("total") - F.max("positives")
    auc = (F.sum(F.col("pos") * mean_rank) - pos * (pos + 1) / 2) / (pos * neg)
    return s.groupBy(*keys).agg(F.when((pos > 0) & (neg > 0), auc).otherwise(0.5).alias("roc_auc"))


def precision_at_k(df: DataFrame, keys: list[str], k: int = 10, tie: str = "doc_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p"), tie))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).groupBy(*keys).agg(F.avg("y").alias("precision_at_k"))


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score, share of positives and rows of each bin that has some; nothing with fewer rows than bins."""
    enough = df.agg((F.count("*") >= bins).alias("enough"))
    placed = df.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    out = placed.groupBy("bin").agg(F.avg("p").alias("mean_score"), F.avg("y").alias("positive_share"), F.count("*").alias("n"))
    return out.crossJoin(F.broadcast(enough)).filter("enough").drop("enough")  # one row


def drift(reference: DataFrame, current: DataFrame, columns: list[str], threshold: float = 2.0) -> DataFrame:
    """Shift of each column's mean in standard deviations of the reference, the largest first."""
    both = reference.select(*columns, F.lit(True).alias("__ref")).unionByName(current.select(*columns, F.lit(False).alias("__ref")))
    return drift_between(both, F.col("__ref"), ~F.col("__ref"), columns, threshold)


def drift_between(df: DataFrame, is_reference: Column, is_current: Column, columns: list[str], threshold: float = 2.0) -> DataFrame:
    """drift() of two parts of one table, in one pass. A column without values in either part is left out."""
    part = {"m": (F.avg, is_reference), "s": (F.stddev_samp, is_reference), "k": (F.avg, is_current), "d": (F.stddev_samp, is_current)}
    one = df.agg(*[f(F.when(where, F.col(c))).alias(f"{k}__{c}") for c in columns for k, (f, where) in part.items()])
    pairs = ", ".join(f"'{c}', " + ", ".join(f"`{k}__{c}`" for k in part) for c in columns)
    long = one.select(F.expr(f"stack({len(columns)}, {pairs}) AS (feature, m, s, k, d)")).filter("m IS NOT NULL AND k IS NOT NULL")
    z = F.abs(F.col("k") - F.col("m")) / F.greatest("s", F.lit(1e-6))
    out = long.select("feature", F.col("m").alias("reference_mean"), F.col("s").alias("reference_std"), F.col("k").alias("current_mean"), F.col("d").alias("current_std"), z.alias("z"))
    return out.withColumn("drifted", F.col("z") > threshold).orderBy(F.desc_nulls_last("z"), "feature")


def walk_forward(weeks: DataFrame, folds: int = 5, test_weeks: int = 4, min_train: int = 26) -> DataFrame:
    """weeks (week_ending, distinct) to (fold, week_ending, role): expanding training weeks, then the test weeks after them.

    Folds count from the oldest; a fold without enough history is left out. Weeks are few (one row each), so one window over
    all of them is small.
    """
    numbered = weeks.filter("week_ending IS NOT NULL").distinct().select("week_ending", F.row_number().over(Window.orderBy("week_ending")).alias("w"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("total"))
    each = numbered.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = F.col("total") - (folds - F.col("fold")) * test_weeks
    role = F.when(F.col("w") <= start, "train").when(F.col("w") <= start + test_weeks, "test")
    return each.filter(start >= min_train).withColumn("role", role).filter("role IS NOT NULL").select("fold", "week_ending", "role")


def champions(versions: DataFrame, promoted: str | None = None) -> DataFrame:
    """A version becomes champion if it is the first or strictly better than all before; the last to become one is champion,
    unless one is promoted by hand. The newest version comes first."""
    before = Window.orderBy("trained_at", "version").rowsBetween(Window.unboundedPreceding, -1)  # one row a version
    best = F.max("pr_auc").over(before)
    marked = versions.withColumn("became_champion", F.coalesce(F.col("pr_auc") > best, F.lit(True)))
    last = F.max(F.when(F.col("became_champion"), F.struct("trained_at", "version"))).over(Window.partitionBy(F.lit(1)))
    is_it = (F.col("version") == promoted) if promoted else (F.struct("trained_at", "version") == last)
    return marked.withColumn("is_champion", is_it).orderBy(F.desc("trained_at"), F.desc("version"))
