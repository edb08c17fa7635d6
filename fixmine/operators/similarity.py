"""Exact similarity joins: strings within an edit distance by segments, and the best matches by cosine with bounds on scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixmine.operators.features import idf, sent, weights
from fixmine.store import dealt, kept


def _most(size: Column, least: tuple[int, int]) -> Column:
    """Edits that a longer string of this size may have: of its characters, those beyond the similarity ``least``, a fraction."""
    num, den = least
    return F.floor(size * (den - num) / F.lit(den) + F.lit(1e-9)).cast("int")


def segment_candidates(left: DataFrame, a: str, right: DataFrame, b: str, least: tuple[int, int]) -> DataFrame:
    """Distinct pairs (a, b) of strings that may have similarity ``least`` (numerator, denominator) or more: a superset.

    The longer string of a pair is cut into one segment more than it may have edits, evenly, so one segment is in the shorter string unchanged. As
    the edits left and right of it are few, it is looked for only in the places to which it can have moved. Both sides take the
    longer string's part once (of equal lengths only a does).
    """
    num, den = least
    if not 0 < num <= den:
        raise ValueError("the similarity is over 0 and at most 1")

    def cut(rows: DataFrame, name: str) -> DataFrame:
        sized = rows.select(name).where(F.col(name).isNotNull()).distinct().withColumn("size", F.length(name)).withColumn("most", _most(F.col("size"), least))
        each = sized.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("most"))))
        at = lambda i: F.expr(f"cast(({i} * size) div (most + 1) as int)")
        return each.select(name, "size", "i", F.substring(name, at("i") + 1, at("(i + 1)") - at("i")).alias("piece"))

    def probe(rows: DataFrame, name: str, equal: bool) -> DataFrame:
        own = rows.select(name).where(F.col(name).isNotNull()).distinct().withColumn("own", F.length(name))
        # sizes of longer strings that may match
        longest = F.expr(f"own * {den} div {num}").cast("int")
        first = F.col("own") if equal else F.col("own") + 1
        wide = own.where(first <= longest).withColumn("size", F.explode(F.sequence(first, longest))).withColumn("most", _most(F.col("size"), least))
        each = wide.where(F.col("size") - F.col("own") <= F.col("most")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("most"))))
        begin, end = (F.expr(f"cast(({i} * size) div (most + 1) as int)") for i in ("i", "(i + 1)"))
        # how far the segment has moved to the left: of size - own characters too many, and most edits in all
        low, high = F.ceil((F.col("size") - F.col("own") - F.col("most")) / 2).cast("int"), F.floor((F.col("size") - F.col("own") + F.col("most")) / 2).cast("int")
        moved = each.withColumn("begin", begin).withColumn("len", end - begin).withColumn("shift", F.explode(F.sequence(low, high)))
        inside = (F.col("begin") - F.col("shift") >= 0) & (F.col("begin") - F.col("shift") + F.col("len") <= F.col("own"))
        return moved.where(inside).select(name, "size", "i", F.substring(name, F.col("begin") - F.col("shift") + 1, F.col("len")).alias("piece")).distinct()

    shorter_a = probe(left, a, True).join(cut(right, b), ["size", "i", "piece"]).select(a, b)
    shorter_b = probe(right, b, False).join(cut(left, a), ["size", "i", "piece"]).select(a, b)
    return shorter_a.union(shorter_b).distinct()


def edit_join(left: DataFrame, a: str, right: DataFrame, b: str, least: tuple[int, int] = (2, 3)) -> DataFrame:
    """(a, b, distance) of all pairs of distinct strings whose edit distance leaves a similarity (1 - distance / longer length) of ``least`` or more.

    Exact: candidates share a segment where no edit is, and each is compared whole. Null strings match nothing, two empty ones are equal.
    """
    num, den = least
    pairs = segment_candidates(left, a, right, b, least)
    longer = F.greatest(F.length(a), F.length(b))
    d = F.when(longer == 0, F.lit(0)).otherwise(F.levenshtein(a, b))
    return pairs.withColumn("distance", d.cast("long")).where(F.col("distance") * den <= (den - num) * longer)


def _unit(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """(key, token, value): weights over the norm of their row; tokens without weight are left out."""
    return vectors.where("w <> 0 AND norm > 0").select(F.col(key), "token", (F.col("w") / F.col("norm")).alias(value))


def cosine_candidates(x: DataFrame, a: str, y: DataFrame, b: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(pairs to score, the least score of each b that is known to be reached by k rows of a).

    x: a, token, x; y: b, token, y, of unit length, with products that are not negative. A token can add at most y times the greatest x of
    any row. First the tokens of b with the shortest lists, of 8 k entries or so, open pairs; the k-th best of their partial scores is a bound. Tokens
    whose greatest contributions together stay below it cannot lift a pair over it, so they open none; a pair that the others
    open is dropped if its partial score and all that they could add stay below it.
    """
    lists = x.groupBy("token").agg(F.count("*").alias("df"), F.max(F.abs("x")).alias("top"))
    # bounds have a row for each row of y, so they go to the rows of x, which are summed up to pairs where they are
    bound = y.join(lists, "token").select(b, "token", "y", "df", (F.abs("y") * F.col("top")).alias("most")).checkpoint()
    short = Window.partitionBy(b).orderBy("df", F.desc("most"), "token")
    opening = bound.withColumn("_c", F.sum("df").over(short) - F.col("df")).where(F.col("_c") < 8 * k)
    partial = x.join(sent(opening), "token").groupBy(b, a).agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    kth = partial.withColumn("_n", F.row_number().over(Window.partitionBy(b).orderBy(F.desc("s")))).where(F.col("_n") == k).select(b, F.col("s").alias("least"))
    weak = Window.partitionBy(b).orderBy("most", F.desc("df"), "token")
    # a little slack, as sums in another order differ in the last digits
    rated = bound.join(kth, b, "left").withColumn("_c", F.sum("most").over(weak)).withColumn("weak", F.coalesce(F.col("_c") < F.col("least") * (1 - 1e-9), F.lit(False))).checkpoint()
    rest = rated.where("weak").groupBy(b).agg(F.sum("most").alias("rest"))
    met = x.join(sent(rated.where("NOT weak")), "token").groupBy(b, a).agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    hope = met.join(rest, b, "left").join(kth, b, "left")
    pairs = hope.where(F.col("least").isNull() | (F.col("s") + F.coalesce("rest", F.lit(0.0)) >= F.col("least") * (1 - 1e-9))).select(b, a)
    return pairs, kth


def top_cosine(left: DataFrame, a: str, right: DataFrame, b: str, k: int = 10) -> DataFrame:
    """(b, a, cosine, place): the k rows of a that are most like each b, ties by a; rows that share no token are never listed.

    left: a, token, w, norm; right: b, token, w, norm, as ``features.weights`` makes them with one table of idf for both. Equal to the ranking of all
    pairs, but only pairs that a bound on their score does not rule out are scored.
    """
    from fixmine.store import checkpoints

    checkpoints(left.sparkSession)
    x, y = _unit(left, a, "x").checkpoint(), _unit(right, b, "y").checkpoint()
    pairs = cosine_candidates(x, a, y, b, k)[0].checkpoint()
    whole = pairs.join(y, b).join(x, [a, "token"]).groupBy(b, a).agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))
    # equal scores differ in their last digits by the order of the sum
    ranked = whole.withColumn("place", F.row_number().over(Window.partitionBy(b).orderBy(F.desc(F.round("cosine", 12)), a)))
    return ranked.where(F.col("place") <= k).select(b, a, "cosine", F.col("place").cast("long").alias("place"))


#: Words whose idf goes to all tasks, besides those of the smaller side; texts of that side whose pairs are all scored.
COMMON, FEW = 100_000, 500


def top_cosine_texts(left: DataFrame, a: str, right: DataFrame, b: str, words: Column, k: int = 10) -> DataFrame:
    """``top_cosine`` of the texts themselves. words: an array of a text's words, repeats count, of columns of both sides.

    Texts are dealt out once. Where a text is, its words meet the commonest words of the left and those of the right, and are summed up to one row
    for each pair and one for the text's norm; only its other, rare words are looked up by a shuffle, so no table has the counts of all words.
    All pairs with a word in common are scored, so of more than ``FEW`` b those that ``cosine_candidates`` leaves are scored instead, by tables of all counts.
    """
    documents = left.count()
    # explode would ask for sizes above 0 below the words, and so make them twice
    each = lambda df, key, made: df.select(key, made.alias("_x")).select(key, F.explode_outer("_x").alias("token")).where("token IS NOT NULL")
    counted = lambda df, key, n: each(df, key, words).groupBy(key, "token").agg(F.count("*").alias(n))
    counts = counted(dealt(left, [a], 2048, left), a, "n")
    if right.select(b).distinct().limit(FEW + 1).count() > FEW:
        rarity = idf(counts, documents)
        return top_cosine(weights(counts, a, rarity), a, weights(counted(right, b, "n"), b, rarity), b, k)
    alone = left.groupBy(a).agg(F.count("*").alias("_c")).where("_c > 1").isEmpty()
    often = (each(left, a, F.array_distinct(words)) if alone else counts).groupBy("token").agg(F.count("*").alias("df"))
    idfs = kept(often.withColumn("idf", F.log(F.lit(float(documents)) / (F.col("df") + 1))), "idf")
    steps = [1 << i for i in range(48)]
    sizes = idfs.agg(*[F.count(F.when(F.col("df") >= x, 1)).alias(str(x)) for x in steps]).first()
    least = next((x for x in steps if sizes[str(x)] <= COMMON), steps[-1])
    own = counted(right, b, "m").join(idfs, "token").where("idf <> 0").withColumn("w", F.col("m") * F.col("idf"))
    own = own.withColumn("y", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(b))))
    lists = own.groupBy("token").agg(F.collect_list(F.struct(F.col(b).alias("b"), "y")).alias("_l"))
    known = sent(idfs.join(lists, "token", "left").where((F.col("df") >= least) | F.col("_l").isNotNull()).select("token", "idf", "_l"))
    x = F.col("n") * F.col("idf")
    row = lambda kind, b_, token, v: F.struct(F.lit(kind).alias("kind"), b_.alias("b"), token.alias("token"), v.alias("v"))
    no_b, no_token = F.lit(None).cast(right.schema[b].dataType), F.lit(None).cast("string")
    # the square of a word that is known and its share of each pair; a rare word itself
    norm, rare = F.array(row("norm", no_b, no_token, x * x)), F.array(row("rare", no_b, F.col("token"), F.col("n").cast("double")))
    shares = F.transform(F.coalesce("_l", F.array().cast(lists.schema["_l"].dataType)), lambda e: row("pair", e["b"], no_token, x * e["y"]))
    made = counts.join(known, "token", "left").select(a, F.explode(F.when(F.col("idf").isNull(), rare).otherwise(F.concat(norm, shares))).alias("e")).select(a, "e.*")
    made = kept(made.groupBy(a, "kind", "b", "token").agg(F.sum("v").alias("v")), "scores")
    squares = made.where("kind = 'norm'").select(a, "v").union(made.where("kind = 'rare'").join(idfs, "token").select(a, (F.col("v") * F.col("idf") * F.col("v") * F.col("idf")).alias("v")))
    norms = sent(squares.groupBy(F.col(a).alias("_a")).agg(F.sqrt(F.sum("v")).alias("norm")))
    pairs = made.where("kind = 'pair'").select(a, F.col("b").alias(b), "v")
    whole = pairs.join(norms, F.col(a).eqNullSafe(F.col("_a"))).select(b, a, (F.col("v") / F.col("norm")).alias("cosine"))
    ranked = whole.withColumn("place", F.row_number().over(Window.partitionBy(b).orderBy(F.desc(F.round("cosine", 12)), a)))
    return ranked.where(F.col("place") <= k).select(b, a, "cosine", F.col("place").cast("long").alias("place"))
