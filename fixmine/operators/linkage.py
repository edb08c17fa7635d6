"""Joins that link records: containment and prefix matches, intervals, ranges, blocked similarity, closures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixmine.functions.values import DAY, seconds, within_days
from fixmine.operators.features import sent
from fixmine.operators.ranking import numbered
from fixmine.store import kept


def contained(a: Column, b: Column) -> Column:
    """Whether b is in a; an empty or missing b is in nothing."""
    return F.coalesce((F.length(b) > 0) & F.contains(a, b), F.lit(False))


def commit_match(hash_p: Column, short_p: Column, subject_p: Column, hash_t: Column, title_t: Column) -> Column:
    """A predicted change is a true one if either hash contains the other, by long or short hash, or the titles are equal."""
    return contained(hash_p, hash_t) | contained(hash_t, hash_p) | contained(short_p, hash_t) | contained(hash_t, short_p) | F.coalesce((subject_p == title_t) & (F.length(title_t) > 0), F.lit(False))


def matched(pred: DataFrame, truth: DataFrame, key: str, match: Column, kind: str = "left_semi") -> DataFrame:
    """Predictions (or with ``inner`` pairs) of the same entity that match; the equality on the key keeps it a hash join."""
    p, t = pred.alias("p"), truth.alias("t")
    return p.join(t, (F.col(f"p.{key}") == F.col(f"t.{key}")) & match, kind)


def interval_pairs(df: DataFrame, key: str, time: str, ident: str, days: int, message: str | None = None, mention: str | None = None) -> DataFrame:
    """(key, a, b): rows of one key at most so many days apart, a before b by time and ident.

    message: pairs also need a valid message: that of either has the other's ``mention`` (an id), or each has two words
    or more and one contains the other.

    Times are cut into buckets of the interval's length; a row meets its own and the next bucket, so a busy key is split by
    time instead of being paired with itself whole.
    """
    width = (days + 1) * DAY
    text, names = (F.col(c) if c else F.lit(None).cast("string") for c in (message, mention))
    rows = df.select(key, F.col(ident).alias("_i"), F.col(time).alias("_t"), F.floor(seconds(F.col(time)) / width).alias("_b"), text.alias("_m"), names.alias("_v"))
    right = rows.select(key, F.explode(F.array("_b", F.col("_b") - 1)).alias("_b"), F.col("_i").alias("_j"), F.col("_t").alias("_u"), F.col("_m").alias("_n"), F.col("_v").alias("_w"))
    ahead = (F.col("_u") > F.col("_t")) | ((F.col("_u") == F.col("_t")) & (F.col("_j") > F.col("_i")))
    valid = valid_message(F.col("_n"), F.col("_m"), F.col("_v")) | contained(F.col("_m"), F.col("_w")) if message else F.lit(True)
    return rows.join(right, [key, "_b"]).where(within_days(F.col("_t"), F.col("_u"), days) & ahead & valid).select(key, F.col("_i").alias("a"), F.col("_j").alias("b"))


def in_ranges(points: DataFrame, value: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points joined to the ranges that hold them, ends included, over buckets of ``width``."""
    p = points.withColumn("_b", F.floor(F.col(value) / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "_b").where(F.col(value).between(F.col(low), F.col(high))).drop("_b")


def summed_ranges(points: DataFrame, value: str, ranges: DataFrame, low: str, high: str, key: str, width: float) -> DataFrame:
    """``points`` that a range holds, with ``count``, the number of ranges that do, and ``first``, the smallest key of those.

    Equal ranges and equal points meet once, so pairs follow the distinct values.
    """
    r = ranges.groupBy(low, high).agg(F.count("*").alias("_n"), F.min(key).alias("_k"))
    met = in_ranges(points.select(value).distinct(), value, r, low, high, width)
    return points.join(met.groupBy(value).agg(F.sum("_n").alias("count"), F.min("_k").alias("first")), value)


def grams(c: Column, n: int = 3) -> Column:
    """Distinct runs of n characters; none for shorter strings."""
    return F.when(F.length(c) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: c.substr(i, F.lit(n)))))


def gram_blocked(left: DataFrame, a: str, right: DataFrame, b: str, n: int = 3) -> DataFrame:
    """Distinct pairs (a, b) of strings that share a run of n characters: every pair with a common substring of n or more."""
    x = left.select(a).distinct().withColumn("_g", F.explode(grams(F.col(a), n)))
    y = right.select(b).distinct().withColumn("_g", F.explode(grams(F.col(b), n)))
    return x.join(y, "_g").select(a, b).distinct()


def names_or_similar(left: DataFrame, a: str, right: DataFrame, b: str, similarity: Column, least: float, most: int = 10) -> DataFrame:
    """(a, b, score, exact): of each name the equal ones of the other side and no others, else the ``most`` most similar with a score over ``least``.

    similarity: of the columns a and b; only pairs with three characters in a row in common are scored. Ties by the name.
    """
    x, y = left.select(a).distinct(), right.select(b).distinct()
    same = x.join(y, F.col(a) == F.col(b)).select(a, b, F.length(a).cast("double").alias("score"), F.lit(True).alias("exact"))
    other = x.join(y.select(F.col(b).alias(a)), a, "left_anti")
    scored = gram_blocked(other, a, y, b).withColumn("score", similarity.cast("double")).where(F.col("score") > least)
    place = F.row_number().over(Window.partitionBy(a).orderBy(F.desc("score"), b))
    return same.union(scored.withColumn("_p", place).where(F.col("_p") <= most).select(a, b, "score", F.lit(False).alias("exact")))


def alternate_pairs(df: DataFrame, group: str, label: str, item: str) -> DataFrame:
    """(group, left, right, flipped): each positive with each negative of its group, every second pair the other way round."""
    pos = df.where(F.col(label) == 1).select(group, F.col(item).alias("p"))
    neg = df.where(F.col(label) == 0).select(group, F.col(item).alias("n"))
    odd = (F.row_number().over(Window.partitionBy(group).orderBy("p", "n")) % 2) == 0
    return pos.join(neg, group).withColumn("flipped", odd).select(group, F.when(F.col("flipped"), F.col("n")).otherwise(F.col("p")).alias("left"), F.when(F.col("flipped"), F.col("p")).otherwise(F.col("n")).alias("right"), "flipped")


def factorise(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, code): codes from 0 by first appearance."""
    return numbered(df.groupBy(value).agg(F.min(order).alias("_f")), ["_f", value], "code").select(value, "code")


def aligned(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer join of two versions: (keys, before, after, status)."""
    a, b = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.col("before") == F.col("after"), "same").otherwise("modified")
    return a.join(b, list(keys), "full_outer").withColumn("status", status)


def valid_message(a: Column, b: Column, ident: Column) -> Column:
    """a has the id, or both messages have two words or more and one contains the other."""
    long = (F.size(F.split(F.trim(a), " +")) >= 2) & (F.size(F.split(F.trim(b), " +")) >= 2)
    return F.coalesce(contained(a, ident) | (long & (contained(a, b) | contained(b, a))), F.lit(False))


def equivalent_pairs(df: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, representative): rows with equal content and its smallest key; pairs are not expanded."""
    h = df.select(key, F.md5(content.cast("binary")).alias("_h"))
    groups = h.groupBy("_h").agg(F.min(key).alias("representative"), F.count("*").alias("copies")).where("copies > 1")
    return h.join(groups, "_h").select(key, "representative", "copies")


def left_features(pairs: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]], fill: dict[str, float] | None = None) -> DataFrame:
    """Pairs with the columns of each table joined on its keys; missing values are filled."""
    for other, keys in tables:
        pairs = pairs.join(other, list(keys), "left")
    return pairs.na.fill(fill or {})


def merged(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that both sides have."""
    return left.join(right, list(keys))


def name_matches(products: DataFrame, repos: DataFrame, key: str, product: str, repo: str, least: float = 2 / 3) -> DataFrame:
    """(key, product, repo, score): repositories of the same entity of whose words ``least`` are shared with a product's, over the longer name.

    Both sides meet on the words that they share, so names without a common word are never compared.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.col(c)), "[^a-z0-9]+"), lambda x: x != ""))
    p = products.select(key, product).distinct().withColumn("_p", words(product))
    r = repos.select(key, repo).distinct().withColumn("_r", words(repo))
    met = p.withColumn("_w", F.explode("_p")).join(r.withColumn("_w", F.explode("_r")), [key, "_w"]).groupBy(key, product, repo).agg(F.count("*").alias("_n"), F.first(F.greatest(F.size("_p"), F.size("_r"))).alias("_m"))
    return met.withColumn("score", F.col("_n") / F.col("_m")).where(F.col("score") >= least).select(key, product, repo, "score")


def commits_of_repos(commits: DataFrame, repos: DataFrame, repo: str) -> DataFrame:
    """Distinct changes of the chosen repositories."""
    return commits.join(repos.select(repo).distinct(), repo, "left_semi").distinct()


def aligned_with_lookup(before: DataFrame, after: DataFrame, whole_before: DataFrame, whole_after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``aligned`` of changed functions, where a side that is missing is looked up in the whole version of that side."""
    both = aligned(before, after, keys, value).drop("status")
    old, new = (w.groupBy(*keys).agg(F.min(value).alias(n)) for w, n in ((whole_before, "_old"), (whole_after, "_new")))
    found = both.join(old, list(keys), "left").join(new, list(keys), "left").withColumn("before", F.coalesce("before", "_old")).withColumn("after", F.coalesce("after", "_new")).drop("_old", "_new")
    return found.withColumn("status", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.col("before") == F.col("after"), "same").otherwise("modified"))


def compared_versions(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, ours, theirs, agree): the two answers for each key; a missing one does not agree."""
    a, b = ours.select(*keys, F.col(value).alias("ours")), theirs.select(*keys, F.col(value).alias("theirs"))
    return a.join(b, list(keys), "full_outer").withColumn("agree", F.coalesce(F.col("ours") == F.col("theirs"), F.lit(False)))


#: Rows of a side in a block of ``met``, and pairs of a task.
PORTION, PAIRS = 4096, 1 << 25


def met(left: DataFrame, a: str, right: DataFrame, b: str, links: DataFrame) -> DataFrame:
    """Each row of ``left`` (a and others) beside each row of ``right`` (b and others) where links (a, b; distinct) has the two, without a and b.

    For joins whose rows grow with the square of their groups: they read little, so Spark would give them few tasks, and one task all
    pairs of a group. Groups are cut into portions by a hash of their rows, two portions are a block of some ``PORTION`` rows each way at most, and
    blocks are dealt out to as many tasks as their pairs ask for. In a block the left is one array, which each row of the right unfolds. Rows
    that are equal are of one portion, so a side should have few of them.
    """

    def parts(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame, list[str]]:
        sizes, rest = sent(df.groupBy(key).agg(F.count("*").alias(name))), [c for c in df.columns if c != key]
        place = F.pmod(F.xxhash64(*rest), F.ceil(F.col(name) / PORTION))
        return sizes, df.join(sizes, key).withColumn(f"{name}_part", place).drop(name), rest

    (m, x, own), (n, y, other) = parts(left, a, "_m"), parts(right, b, "_n")
    linked = links.join(m, a).join(n, b).checkpoint()
    each = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(size) / PORTION) - 1))
    blocks = sent(linked.select(a, b, "_n", each("_m").alias("_m_part")).select(a, b, "_m_part", each("_n").alias("_n_part")).withColumn("_block", F.monotonically_increasing_id()))
    pairs = linked.agg(F.sum(F.col("_m") * F.col("_n") + F.col("_m") + F.col("_n"))).first()[0] or 0
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
    arrays = x.join(blocks, [a, "_m_part"]).select("_block", *own).repartition(tasks, "_block").groupBy("_block").agg(F.collect_list(F.struct(*own)).alias("_rows"))
    rows = y.join(blocks, [b, "_n_part"]).select("_block", *other).repartition(tasks, "_block")
    return arrays.hint("shuffle_hash").join(rows, "_block").select(F.explode("_rows").alias("_row"), *other).select("_row.*", *other)


def issue_search(issues: DataFrame, commits: DataFrame, similarity: Column, least: float = 2 / 3) -> DataFrame:
    """(entity, key, hash): changes whose message has an issue key of the entity, in repositories similar enough to its product.

    issues: entity, key, product; commits: repo, hash, message. Both sides meet on the keys that a message mentions, so
    no message is compared with keys that it does not have. similarity: of ``product`` and ``repo``; it is taken once for each two names. Issues
    with one key and the same products and changes with one key and the same repositories are groups, and groups are linked, so no row of the
    result is made twice and none has to be made distinct.
    """
    named = commits.select("repo", "hash", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("message"), F.lit("([A-Z][A-Z0-9]+-[0-9]+)")))).alias("_k"))
    asked = issues.select("entity", "key", "product", F.upper("key").alias("_k"))
    named = named.join(asked.select("_k").distinct(), "_k", "left_semi").distinct()
    # of each issue its products and of each change its repositories, so two of them meet once, whatever names they have in common
    left = kept(asked.groupBy("entity", "key", "_k").agg(F.array_sort(F.collect_set("product")).alias("_p")).select("entity", "key", F.struct("_k", "_p").alias("_a")), "issues")
    right = kept(named.groupBy("hash", "_k").agg(F.array_sort(F.collect_set("repo")).alias("_r")).select("hash", F.struct("_k", "_r").alias("_b")), "changes")
    sides = left.select("_a").distinct().select("_a", F.col("_a._k").alias("_k"), F.explode("_a._p").alias("product"))
    changes = right.select("_b").distinct().select("_b", F.col("_b._k").alias("_k"), F.explode("_b._r").alias("repo"))
    alike = sides.select("product").distinct().crossJoin(changes.select("repo").distinct()).where(similarity >= least)
    links = sides.join(alike, "product").join(changes, ["_k", "repo"]).select("_a", "_b").distinct()
    return met(left, "_a", right, "_b", links).select("entity", "key", "hash")


def merged_branches(truth: DataFrame) -> DataFrame:
    """(entity, branch, patch): rows without a branch get the first branch with an equivalent patch, one in which either contains the other.

    truth: entity, branch (null if unknown), patch. Patches are compared once for each entity, with the first branch that has one.
    """
    known, lost = truth.where("branch is not null"), truth.where("branch is null").select("entity", "patch").distinct()
    k = known.groupBy(F.col("entity").alias("_e"), F.col("patch").alias("_p")).agg(F.min("branch").alias("_b"))
    found = lost.join(k, (F.col("entity") == F.col("_e")) & (contained(F.col("patch"), F.col("_p")) | contained(F.col("_p"), F.col("patch"))), "left")
    return known.select("entity", "branch", "patch").union(found.groupBy("entity", "patch").agg(F.min("_b").alias("branch")).select("entity", "branch", "patch"))


def closest(df: DataFrame, keys: Sequence[str], wanted: str, tag: str, similarity: Column) -> DataFrame:
    """(keys, wanted, tag): an equal tag, else one that contains or is contained, else the most similar; the first by name on ties."""
    level = F.when(F.col(wanted) == F.col(tag), 3.0).when(contained(F.col(wanted), F.col(tag)) | contained(F.col(tag), F.col(wanted)), 2.0).otherwise(similarity)
    scored = df.withColumn("_s", level)
    best = scored.groupBy(*keys, wanted).agg(F.max("_s").alias("_s"))
    return scored.join(best, [*keys, wanted, "_s"]).groupBy(*keys, wanted).agg(F.min(tag).alias(tag))


def sharing_grams(left: DataFrame, a: str, right: DataFrame, b: str, text: str, n: int = 5) -> DataFrame:
    """Distinct pairs (a, b) of rows whose texts share a run of n words; grams that only one side has open nothing."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def each(rows: DataFrame, key: str) -> DataFrame:
        made = rows.select(key, words.alias("_w"))
        gram = F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))
        return made.where(F.size("_w") >= n).select(key, F.explode(F.array_distinct(gram)).alias("_g"))

    return each(left, a).join(each(right, b), "_g").select(a, b).distinct()
