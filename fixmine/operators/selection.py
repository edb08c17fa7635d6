"""Parts of a skewed range of numbers, and exact quantiles, by refining counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixmine.store import checkpoints


def bisected(df: DataFrame, value: str, most: int, step: int = 6) -> DataFrame:
    """(low, high, n): ranges of a whole-number column, in halves of halves, none of more than ``most`` rows unless it is one value.

    The root is the least power of two of numbers from the smallest value on. A range that holds too many rows is halved; empty halves are
    left out. Counts go down the tree ``step`` levels at a time, over the rows of full ranges only: a level costs one aggregation of counts
    per value, and no range is looked at that its parent did not fill. Nulls are in no range.
    """
    checkpoints(df.sparkSession)
    values = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n")).checkpoint()
    low, high = values.agg(F.min("v"), F.max("v")).first()
    out = values.select(F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), "n").where("false")
    if low is None:
        return out
    bits = (high - low).bit_length()
    full = values.select(F.lit(0).cast("long").alias("node"), (F.col("v") - F.lit(low)).alias("at"), "n")
    while True:
        down = list(range(bits, max(bits - step, 0) - 1, -1))
        levels = F.array(*[F.struct(F.lit(b).alias("bits"), F.expr(f"shiftright(at, {b})").alias("node")) for b in down])
        counts = full.select("n", F.explode(levels).alias("x")).groupBy("x.bits", "x.node").agg(F.sum("n").alias("n"))
        above = counts.select((F.col("bits") - 1).alias("bits"), "node", F.col("n").alias("_n"))
        # a range is one of the result if its parent is too full and it is not, or is one value
        known = counts.withColumn("_up", F.expr("shiftright(node, 1)")).join(above.withColumnRenamed("node", "_up"), ["bits", "_up"], "left")
        top = F.col("bits") == down[0]
        cut = known.where((top | (F.col("_n") > most)) & ((F.col("n") <= most) | (F.col("bits") == 0)))
        # below the first level of a round the root itself is no part: it was too full in the round before
        if down[0] != (high - low).bit_length():
            cut = cut.where(~top)
        size = F.expr("shiftleft(1L, bits)")
        out = out.union(cut.select((F.col("node") * size + low).alias("low"), ((F.col("node") + 1) * size + (low - 1)).alias("high"), "n"))
        bits = down[-1]
        if bits == 0:
            return out
        over = counts.where((F.col("bits") == bits) & (F.col("n") > most)).select("node").checkpoint()
        if not over.head(1):
            return out
        full = full.withColumn("node", F.expr(f"shiftright(at, {bits})")).join(over, "node", "left_semi").checkpoint()


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, shares: Sequence[float], bins: int = 256, few: int = 1000) -> DataFrame:
    """(group, share, quantile): exact quantiles with linear interpolation between neighbours, as ``percentile`` gives them.

    Each wanted rank lies in one bin of a histogram of its group; the bin is refined until it holds ``few`` rows or one value, and what is left is
    sorted. A round aggregates counts, so no task holds a group, and one hot group spreads over all tasks. Nulls and NaN don't count; a group without
    values has no row.
    """
    checkpoints(df.sparkSession)
    keys = list(group)
    rows = df.select(*keys, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("v")).where("v IS NOT NULL")
    sized = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.col("share") * (F.col("n") - 1)
    wanted = sized.select("*", F.explode(F.array(*map(F.lit, map(float, shares)))).alias("share"))
    ranks = wanted.select(*keys, "share", "n", "low", "high", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank"))
    # a target: the bounds between which the value of a rank lies, and how many rows of the group are below
    todo = ranks.select(*keys, "rank", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")).distinct().checkpoint()
    same = lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in keys]
    found = todo.select(*keys, "rank", F.col("low").alias("v")).where("low = high").checkpoint()
    while True:
        many = todo.where((F.col("inside") > few) & (F.col("low") < F.col("high")))
        if not many.head(1):
            break
        spans = many.select(*keys, "low", "high", "below").distinct()
        on = [*same("r", "s"), F.col("r.v").between(F.col("s.low"), F.col("s.high"))]
        width = (F.col("high") / bins) - (F.col("low") / bins)
        bin_ = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") - F.col("low")) / width))).cast("int")
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        counts = rows.alias("r").join(spans.alias("s"), cond).select(*[F.col(f"s.{c}").alias(c) for c in keys], "low", "high", "below", "v", bin_.alias("bin"))
        hist = counts.groupBy(*keys, "low", "high", "below", "bin").agg(F.count("*").alias("m"), F.min("v").alias("from"), F.max("v").alias("to")).checkpoint()
        lists = hist.groupBy(*keys, "low", "high", "below").agg(F.array_sort(F.collect_list(F.struct("bin", "m", "from", "to"))).alias("hist"))
        t, h = many.alias("t"), lists.alias("h")
        cond = (F.col("t.low") == F.col("h.low")) & (F.col("t.high") == F.col("h.high")) & (F.col("t.below") == F.col("h.below"))
        for c in same("t", "h"):
            cond = cond & c
        step = "aggregate(hist, named_struct('c', below, 'b', cast(null as bigint), 'm', 0L, 'f', 0D, 't', 0D), (s, x) -> if(s.b is null and s.c + x.m > rank, named_struct('c', s.c, 'b', s.c, 'm', x.m, 'f', x.from, 't', x.to), if(s.b is null, named_struct('c', s.c + x.m, 'b', s.b, 'm', s.m, 'f', s.f, 't', s.t), s)))"
        narrowed = t.join(h, cond).select(*[F.col(f"t.{c}").alias(c) for c in keys], F.col("t.rank").alias("rank"), F.col("t.below").alias("below"), "hist").withColumn("s", F.expr(step))
        narrowed = narrowed.select(*keys, "rank", F.col("s.f").alias("low"), F.col("s.t").alias("high"), F.col("s.b").alias("below"), F.col("s.m").alias("inside"))
        rest = todo.where((F.col("inside") <= few) & (F.col("low") < F.col("high")))
        todo = rest.unionByName(narrowed).checkpoint()
        found = found.unionByName(todo.where("low = high").select(*keys, "rank", F.col("low").alias("v"))).checkpoint()
    left = todo.where("low < high")
    cond = F.col("r.v").between(F.col("s.low"), F.col("s.high"))
    for c in same("r", "s"):
        cond = cond & c
    # at most ``few`` rows of a target
    last = rows.alias("r").join(left.alias("s"), cond).groupBy(*[F.col(f"s.{c}").alias(c) for c in keys], F.col("s.rank").alias("rank"), F.col("s.below").alias("below")).agg(F.array_sort(F.collect_list("r.v")).alias("vs"))
    all_ = found.unionByName(last.select(*keys, "rank", F.element_at("vs", (F.col("rank") - F.col("below") + 1).cast("int")).alias("v"))).distinct()
    w, a = ranks.select(*keys, "share", "n", "rank").alias("w"), all_.alias("a")
    cond = F.col("w.rank") == F.col("a.rank")
    for c in same("w", "a"):
        cond = cond & c
    both = w.join(a, cond).select(*[F.col(f"w.{c}").alias(c) for c in keys], "share", "n", "w.rank", "v")
    part = place - F.floor(place)
    ends = both.groupBy(*keys, "share", "n").agg(F.min_by("v", "rank").alias("lo"), F.max_by("v", "rank").alias("hi"))
    return ends.select(*keys, "share", (F.col("lo") + (F.col("hi") - F.col("lo")) * part).alias("quantile"))
