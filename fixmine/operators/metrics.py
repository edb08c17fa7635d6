"""Ranking and classification metrics. Groups are aggregated once, whatever the number of cut-offs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision_recall_f1(tp: Column, predicted: Column, expected: Column) -> list[Column]:
    return [ratio(tp, predicted).alias("precision"), ratio(tp, expected).alias("recall"), ratio(2 * tp, predicted + expected).alias("f1")]


def confusion(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    """Counts and the five measures of two 0/1 columns; precision and F1 are 0 without positives."""
    p, e = F.col(predicted) == 1, F.col(expected) == 1
    n = df.agg(*(F.count_if(x).alias(k) for k, x in (("tp", p & e), ("fp", p & ~e), ("fn", ~p & e), ("tn", ~p & ~e))))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.select("tp", "fp", "fn", "tn", *precision_recall_f1(tp, tp + fp, tp + fn), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(fp + fn, tp + fp + fn + tn).alias("error"))


def _by_k(ks: Sequence[int], rank: str, label: str, what) -> list[Column]:
    return [what(k, F.col(rank), F.col(label) == 1).alias(f"k{k}") for k in ks]


def topk_prf(df: DataFrame, group: Sequence[str], rank: str, label: str, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by, k, precision, recall, f1), macro means over groups. A group with fewer than k rows counts the missing ones as wrong."""
    hits = df.groupBy(*by, *group).agg(F.count_if(F.col(label) == 1).alias("p"), *_by_k(ks, rank, label, lambda k, r, y: F.count_if(y & (r <= k))))
    rows = hits.select(*by, "p", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"k{k}").alias("tp")) for k in ks))).alias("x")).select(*by, "p", "x.*")
    return rows.groupBy(*by, "k").agg(F.avg(ratio(F.col("tp"), F.col("k"))).alias("precision"), F.avg(ratio(F.col("tp"), F.col("p"))).alias("recall"), F.avg(ratio(2 * F.col("tp"), F.col("k") + F.col("p"))).alias("f1"))


def recall_effort_mrr(df: DataFrame, group: Sequence[str], rank: str, label: str, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by, k, recall, effort, mrr). effort: rank of the first positive before k, else k; 1 at k = 1. mrr: mean over all positives of a group."""
    y, r = F.col(label) == 1, F.col(rank)
    g = df.groupBy(*by, *group).agg(F.count_if(y).alias("p"), F.min(F.when(y, r)).alias("first"), F.coalesce(F.avg(F.when(y, 1.0 / r)), F.lit(0.0)).alias("mrr"), *_by_k(ks, rank, label, lambda k, r, y: F.count_if(y & (r <= k))))
    rows = g.select(*by, "p", "first", "mrr", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"k{k}").alias("tp")) for k in ks))).alias("x")).select(*by, "p", "first", "mrr", "x.*")
    effort = F.when(F.col("k") == 1, 1).when(F.col("first") < F.col("k"), F.col("first")).otherwise(F.col("k"))
    return rows.groupBy(*by, "k").agg(F.avg(ratio(F.col("tp"), F.col("p"))).alias("recall"), F.avg(effort.cast("double")).alias("effort"), F.avg("mrr").alias("mrr"))


def best_rank_at(df: DataFrame, group: Sequence[str], rank: str, label: str, n: int) -> DataFrame:
    """(mean_rank, hit_rate): each group's best positive rank capped at n, and the share within n."""
    best = df.groupBy(*group).agg(F.coalesce(F.min(F.when(F.col(label) == 1, F.col(rank))), F.lit(n + 1)).alias("best"))
    return best.agg(F.avg(F.least("best", F.lit(n)).cast("double")).alias("mean_rank"), F.avg((F.col("best") <= n).cast("double")).alias("hit_rate"))


def _thresholds_below(score: Column, steps: int) -> Column:
    """How many of 1/steps, 2/steps, ... are below the score, at most steps - 1; exact for doubles."""
    guess = F.ceil(score * steps) - 1
    exact = F.when(guess / F.lit(float(steps)) >= score, guess - 1).when((guess + 1) / F.lit(float(steps)) < score, guess + 1).otherwise(guess)
    return F.greatest(F.lit(0), F.least(F.lit(steps - 1), exact)).cast("long")


def threshold_curve(df: DataFrame, group: Sequence[str], score: str, label: str, steps: int = 1000) -> DataFrame:
    """(threshold, precision, recall, f1): macro means over groups for score > i / steps, i from 1 to steps - 1.

    A group's measures change only where one of its scores lies, so each group gives one row per distinct step of
    its scores, and sums over groups run over at most ``steps`` rows.
    """
    tiny = df.select(*group, _thresholds_below(F.col(score).cast("double"), steps).alias("b"), (F.col(label) == 1).alias("y"))
    cell = tiny.groupBy(*group, "b").agg(F.count("*").alias("n"), F.count_if("y").alias("tp"))
    w = Window.partitionBy(*group).orderBy(F.desc("b"))
    run = cell.select(*group, "b", F.sum("n").over(w).alias("n"), F.sum("tp").over(w).alias("tp"), F.sum("tp").over(Window.partitionBy(*group)).alias("p"), F.coalesce(F.lead("b").over(w), F.lit(0)).alias("next"))
    measures = run.select("b", "next", *precision_recall_f1(F.col("tp"), F.col("n"), F.col("p")))
    # these measures hold for thresholds next < i <= b
    step = measures.select(F.explode(F.array(F.struct(F.col("b").alias("i"), F.lit(1).alias("s")), F.struct(F.col("next").alias("i"), F.lit(-1).alias("s")))).alias("x"), "precision", "recall", "f1")
    names = ("precision", "recall", "f1")
    sums = step.groupBy(F.col("x.i").alias("i")).agg(*(F.sum(F.col("x.s") * F.col(c)).alias(c) for c in names))
    groups = df.select(*group).distinct().agg(F.count("*").alias("groups"))
    grid = df.sparkSession.range(1, steps).select(F.col("id").alias("i"))
    over = Window.orderBy(F.desc("i"))  # steps rows at most
    curve = grid.join(F.broadcast(sums), "i", "left").select("i", *(F.sum(F.coalesce(c, F.lit(0.0))).over(over).alias(c) for c in names))
    return curve.crossJoin(F.broadcast(groups)).select((F.col("i") / F.lit(float(steps))).alias("threshold"), *((F.col(c) / F.col("groups")).alias(c) for c in names))


def best_threshold(curve: DataFrame, digits: int = 9) -> DataFrame:
    """The row with the highest F1, the lowest threshold on ties; F1 is compared to ``digits`` decimals."""
    return curve.orderBy(F.desc(F.round("f1", digits)), "threshold").limit(1)


def set_scores(pred: DataFrame, truth: DataFrame, group: Sequence[str], item: str) -> DataFrame:
    """(group, tp, fp, fn, precision, recall, f1) per group of two tables of items; items are distinct within a group."""
    keys = [*group, item]
    both = pred.select(*keys).distinct().withColumn("_p", F.lit(1)).join(truth.select(*keys).distinct().withColumn("_t", F.lit(1)), keys, "full_outer")
    p, t = F.col("_p").isNotNull(), F.col("_t").isNotNull()
    n = both.groupBy(*group).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    tp = F.col("tp")
    return n.select("*", *precision_recall_f1(tp, tp + F.col("fp"), tp + F.col("fn")))


def summarise(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro means of group scores, means with groups not found at 0, and micro measures of pooled counts."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    found = F.col("tp") + F.col("fp") > 0
    return scores.groupBy(*by).agg(
        F.count("*").alias("groups"), F.count_if(found).alias("found"),
        *(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")),
        *(F.avg(F.when(found, F.col(c))).alias(f"found_{c}") for c in ("precision", "recall", "f1")),
        ratio(tp, tp + fp).alias("micro_precision"), ratio(tp, tp + fn).alias("micro_recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
    )


def capped_recall(hits: DataFrame, truth: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, recall): hits over truths, at most 1, so repeated hits cannot exceed it."""
    h, t = hits.groupBy(*group).agg(F.count("*").alias("h")), truth.groupBy(*group).agg(F.count("*").alias("t"))
    return t.join(h, list(group), "left").select(*group, F.least(F.lit(1.0), ratio(F.coalesce("h", F.lit(0)), F.col("t"))).alias("recall"))


def list_scores(pred: DataFrame, truth: DataFrame, group: Sequence[str], item: str) -> DataFrame:
    """``set_scores`` of lists: a prediction that is repeated counts each time, as a hit or as a miss."""
    keys = [*group, item]
    right = truth.select(*keys).distinct()
    hits = pred.select(*keys).join(right.withColumn("_t", F.lit(1)), keys, "left").groupBy(*group).agg(F.count_if(F.col("_t").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"))
    missed = right.join(pred.select(*keys).distinct(), keys, "left_anti").groupBy(*group).agg(F.count("*").alias("fn"))
    n = hits.join(missed, list(group), "full_outer").na.fill(0, ["tp", "fp", "fn"])
    tp = F.col("tp")
    return n.select("*", *precision_recall_f1(tp, tp + F.col("fp"), tp + F.col("fn")))


def ranks_from_losses(df: DataFrame, index: str, lost: str, size: int = 5000) -> DataFrame:
    """(block, rank): each block of ``size`` comparisons, in the order of an index from 0, is one item against others; its rank is its losses and one."""
    return df.groupBy(F.floor(F.col(index) / size).cast("long").alias("block")).agg((F.sum(F.col(lost).cast("long")) + 1).alias("rank"))


def label_accuracy(df: DataFrame, predicted: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, accuracy): the share of rows whose prediction is the label; a missing prediction is wrong."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(predicted) == F.col(label), F.lit(False)).cast("double")).alias("accuracy"))


def token_accuracy(predicted: Column, label: Column) -> Column:
    """Share of the places of ``label`` where both arrays agree; null for no places."""
    same = F.aggregate(F.zip_with(predicted, label, lambda p, t: F.coalesce(p == t, F.lit(False)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.try_divide(same.cast("double"), F.size(label).cast("double"))
