"""Verification of vectors: pairs, confusion, ROC, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions.exprs import cosine
from fieldtally.operators.windows import with_place


BUCKET_ROWS = 10_000


def verification_pairs(df: DataFrame, n_same: int, n_diff: int, seed: int = 42) -> DataFrame:
    """id1, id2, same (D38): pairs with equal and with different labels, a sample by a
    seeded order. Rows are dealt into buckets of about ``BUCKET_ROWS`` by a hash; in a
    bucket each row meets its successor in the seeded order, among the rows of its label
    and among all, so pairs grow with rows, not squared, and are the same on any cluster."""
    h = F.xxhash64(F.lit(seed), "id")
    bucket = F.pmod(h, F.lit(max(1, df.count() // BUCKET_ROWS)))
    in_label = Window.partitionBy("label", bucket).orderBy(h, "id")
    same = df.select("id", F.lead("id").over(in_label).alias("id2")).where("id2 IS NOT NULL").select(F.col("id").alias("id1"), "id2", F.lit(True).alias("same"))
    mixed = Window.partitionBy(bucket).orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id")
    other = df.select("id", "label", F.lead("id").over(mixed).alias("id2"), F.lead("label").over(mixed).alias("l2"))
    diff = other.where("id2 IS NOT NULL AND label <> l2").select(F.col("id").alias("id1"), "id2", F.lit(False).alias("same"))
    order = [F.xxhash64(F.lit(seed), "id1", "id2"), F.col("id1"), F.col("id2")]
    least = lambda pairs, n: with_place(pairs, order, "__n").where(F.col("__n") < n).drop("__n")
    return least(same, n_same).unionByName(least(diff, n_diff))


def pair_scores(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """Adds the cosine of each pair."""
    a, b = df.select(F.col("id").alias("id1"), F.col("vector").alias("v1")), df.select(F.col("id").alias("id2"), F.col("vector").alias("v2"))
    return pairs.join(a, "id1").join(b, "id2").select("id1", "id2", "same", cosine(F.col("v1"), F.col("v2")).alias("score"))


def confusion(df: DataFrame, threshold: float) -> DataFrame:
    """tp, fp, tn, fn, accuracy, false-accept and false-reject rate."""
    yes = F.col("score") >= threshold
    out = df.agg(F.count_if(yes & F.col("same")).alias("tp"), F.count_if(yes & ~F.col("same")).alias("fp"), F.count_if(~yes & ~F.col("same")).alias("tn"), F.count_if(~yes & F.col("same")).alias("fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(0.0))
    return out.withColumns({"accuracy": rate("tp + tn", "tp + fp + tn + fn"), "far": rate("fp", "fp + tn"), "frr": rate("fn", "fn + tp")})


def roc(df: DataFrame, decimals: int = 3) -> DataFrame:
    """threshold, tpr, fpr (E36) at scores rounded to ``decimals``: the counts per
    rounded score (2 * 10^decimals + 1 at most) are summed over one small window."""
    t = F.round("score", decimals).alias("threshold")
    steps = df.where("score IS NOT NULL").groupBy(t).agg(F.count_if("same").alias("p"), F.count_if(~F.col("same")).alias("n"))
    run = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy()
    return steps.select("threshold", F.try_divide(F.sum("p").over(run), F.sum("p").over(all_)).alias("tpr"), F.try_divide(F.sum("n").over(run), F.sum("n").over(all_)).alias("fpr"))


def auc(points: DataFrame) -> DataFrame:
    """Area under the curve by trapezoids (E36). Points meet the point before them by their
    numbers, so that curves of any number of points are no one task's work."""
    placed = with_place(points.select("fpr", "tpr"), [F.col("fpr"), F.col("tpr")])
    before = placed.select((F.col("place") + 1).alias("place"), F.col("fpr").alias("x"), F.col("tpr").alias("y"))
    j = placed.join(before, "place", "left")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    return j.select(((F.col("fpr") - x) * (F.col("tpr") + y) / 2).alias("a")).agg(F.sum("a").alias("auc"))


def best_threshold(points: DataFrame, max_far: float = 0.01) -> DataFrame:
    """By Youden's J, and the one with most true accepts at a bounded false-accept
    rate; ties go to the higher threshold (F11)."""
    return points.agg(
        F.max_by("threshold", F.struct(F.col("tpr") - F.col("fpr"), F.col("threshold"))).alias("youden"),
        F.max_by("threshold", F.struct(F.when(F.col("fpr") <= max_far, F.col("tpr")), F.col("threshold"))).alias("at_max_far"),
    )
