"""Histories: ranges between two changes of a commit graph, classes of equal trees, and records as of a date."""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixmine.store import checkpoints, kept, scratch

#: Commits of a block, and ranges that one task walks through it.
BLOCK, RANGES = 1 << 16, 1024
_HEAD, _BASE = 1, 2


def _walk(key: tuple, marks: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """Go down through one block of a repository: (repo, range, pos, side), side 0 for a commit that is in the range, else a mark below the block.

    A commit comes after all that descend from it, so its mark is final when it is met. A range ends where no mark of its head alone is left.
    """
    parents = dict(zip(nodes["pos"].tolist(), nodes["parents"].tolist(), strict=True))
    out: list[tuple[int, int, int]] = []
    for name, own in marks.groupby("range"):
        side: dict[int, int] = {}
        for pos, mark in zip(own["pos"].tolist(), own["side"].tolist(), strict=True):
            side[pos] = side.get(pos, 0) | mark
        todo = [-p for p in side]
        heapify(todo)
        alone = sum(m == _HEAD for m in side.values())
        while todo and alone:
            pos = -heappop(todo)
            mark = side[pos]
            if pos not in parents:
                continue  # below the block
            del side[pos]
            if mark == _HEAD:
                alone -= 1
                out.append((name, pos, 0))
            for p in parents[pos]:
                before = side.get(p, 0)
                if not before:
                    heappush(todo, -p)
                side[p] = before | (mark & _BASE or mark)
                alone += (side[p] == _HEAD) - (before == _HEAD)
        if alone:
            out += [(name, pos, mark) for pos, mark in side.items()]
    rows = pd.DataFrame(out, columns=["range", "pos", "side"])
    rows.insert(0, "repo", key[0])
    return rows


def commit_ranges(commits: DataFrame, ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(range, repo, commit): the ancestors of ``head``, itself included, that are no ancestors of ``base`` (``base..head``).

    commits: repo, commit, order, parents (an array; parents that are not in the table end a line). order grows from parents to
    children, as generation numbers or places of a topologically sorted log do; a parent that does not come first is an error. ranges:
    range, repo, base (null: all ancestors of head), head.

    Commits are numbered within their repository and cut into blocks; marks of head and base go down block by block, in all
    repositories at once, so there are as many rounds as the longest history has blocks and no task holds more than one block. Ranges are
    dealt out in the order of their heads and wait until the walk is at their first mark, so a block goes only to the parts that are in it.
    """
    spark = commits.sparkSession
    checkpoints(spark)
    place = F.row_number().over(Window.partitionBy("repo").orderBy("order", "commit")).cast("long") - 1
    named = commits.select("repo", "commit", place.alias("pos"), "parents").checkpoint()
    old = named.select("repo", F.col("commit").alias("parent"), F.col("pos").alias("parent_pos"))
    edges = named.select("repo", "pos", F.explode_outer("parents").alias("parent")).join(old, ["repo", "parent"], "left")
    path = scratch(spark, "graph")
    kind, rkind = dict(commits.dtypes)["repo"], dict(ranges.dtypes)["range"]
    lists = edges.groupBy("repo", "pos").agg(F.collect_set("parent_pos").alias("parents"), F.max("parent_pos").alias("last"))
    lists.withColumn("block", F.expr(f"pos div {block}")).write.partitionBy("block").parquet(path)
    nodes = spark.read.schema(f"repo {kind}, pos long, parents array<long>, last long, block long").parquet(path)
    if nodes.where("last >= pos").head(1):
        raise ValueError("a parent does not come before its child in the order")
    # ranges of one repository are dealt to several tasks, each of which reads the block
    heads = ranges.join(named.select("repo", F.col("commit").alias("head"), F.col("pos").alias("at")), ["repo", "head"], "left")
    sized = heads.withColumn("part", F.expr(f"(row_number() OVER (PARTITION BY repo ORDER BY at, range) - 1) div {RANGES}")).select("repo", "range", "part", "base", "head").checkpoint()
    ends = sized.select("repo", "range", "part", F.explode(F.array(F.struct(F.col("head").alias("commit"), F.lit(_HEAD).alias("side")), F.struct(F.col("base").alias("commit"), F.lit(_BASE).alias("side")))).alias("e"))
    front = ends.select("repo", "range", "part", "e.*").join(named.select("repo", "commit", "pos"), ["repo", "commit"]).select("repo", "range", "part", "pos", "side")
    waiting = front.withColumn("first", F.expr(f"max(pos) OVER (PARTITION BY repo, range) div {block}")).checkpoint()
    parts = sized.select("repo", "range", "part")
    top = waiting.agg(F.max("pos")).first()[0]
    found = front.where("false").select("repo", "range", "pos")
    front = None
    for k in range(-1 if top is None else top // block, -1, -1):
        # with their marks further down, which tell whether a range has ended
        begun = waiting.where(F.col("first") == k).drop("first")
        front = begun if front is None else front.union(begun)
        own = nodes.where(F.col("block") == k).join(front.select("repo", F.col("part").alias("part")).distinct(), "repo").select("repo", "part", "pos", "parents")
        step = front.groupBy("repo", "part").cogroup(own.groupBy("repo", "part")).applyInPandas(_walk, f"repo {kind}, range {rkind}, pos long, side int").checkpoint()
        found = found.union(step.where("side = 0").select("repo", "range", "pos"))
        if k:
            below = step.where("side > 0").join(parts, ["repo", "range"]).select("repo", "range", "part", "pos", "side")
            front = below.checkpoint()
    return found.join(named, ["repo", "pos"]).select("range", "repo", "commit")


def _digest(path: Column, blob: Column) -> Column:
    """The digest of a file's path and content; null for no file."""
    return F.when(blob.isNotNull(), F.sha2(F.concat_ws("\0", path, blob).cast("binary"), 256))


def _print(digest: Column) -> list[Column]:
    """Four numbers of a digest, 0 for none."""
    number = lambda k: F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long")
    return [F.coalesce(number(k), F.lit(0).cast("long")) for k in range(4)]


def folder_deltas(changes: DataFrame, keys: Sequence[str], folder: str | None = None) -> DataFrame:
    """(keys, commit, folder, p0..p3): how a commit changes the print of each folder on the way to a changed file, or of ``folder`` alone; the root is ''.

    changes: keys, commit, path, old (the content's id before, null for a new file), new (null for a deleted one). A folder's print is the
    exclusive or of the digests of all files below it, so it follows from the changed files alone.
    """
    if folder:
        changes = changes.where(F.startswith("path", F.lit(folder + "/")))
    steps = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    delta = [a.bitwiseXOR(b).alias(f"p{k}") for k, (a, b) in enumerate(zip(_print(F.col("_old")), _print(F.col("_new")), strict=True))]
    # a digest is made once for its four numbers
    named = changes.select(*keys, "commit", "path", _digest(F.col("path"), F.col("old")).alias("_old"), _digest(F.col("path"), F.col("new")).alias("_new"))
    at = F.explode(folders) if folder is None else F.lit(folder)
    return named.select(*keys, "commit", at.alias("folder"), *delta).groupBy(*keys, "commit", "folder").agg(*[F.bit_xor(f"p{k}").alias(f"p{k}") for k in range(4)])


def tree_prints(commits: DataFrame, changes: DataFrame, keys: Sequence[str], folder: str = "") -> DataFrame:
    """(keys, commit, p0..p3): the print of a folder's tree at every commit, from the changed files of the commits.

    commits: keys, commit, parent (the first one; null at the beginning). changes: see ``folder_deltas``; they are those against the first parent.
    Prints are exclusive ors along the line of first parents; steps double, so there are as many rounds as the longest line's length has digits in base two.
    """
    prints = [f"p{k}" for k in range(4)]
    own = folder_deltas(changes, keys, folder).drop("folder")
    zero = {p: 0 for p in prints}
    now = kept(commits.select(*keys, "commit", F.col("parent").alias("on")).join(own, [*keys, "commit"], "left").na.fill(zero), "prints")
    # a line that has come to its beginning is written once and only looked up from then on
    done = now.where("on IS NULL")
    while now.where("on IS NOT NULL").head(1):
        left = now.where("on IS NOT NULL")
        far = done.unionByName(left).select(*keys, F.col("commit").alias("on"), F.col("on").alias("next"), *[F.col(p).alias(f"_{p}") for p in prints])
        step = left.join(far, [*keys, "on"], "left").na.fill({f"_{p}": 0 for p in prints})
        now = kept(step.select(*keys, "commit", F.col("next").alias("on"), *[F.col(p).bitwiseXOR(F.col(f"_{p}")).alias(p) for p in prints]), "prints")
        done = done.unionByName(now.where("on IS NULL"))
    return done.drop("on")


def tree_classes(commits: DataFrame, changes: DataFrame, keys: Sequence[str], folder: str = "") -> DataFrame:
    """(keys, commit, representative, copies): commits between which a diff is empty, named after the smallest; pairs are not expanded."""
    prints = [f"p{k}" for k in range(4)]
    at = tree_prints(commits, changes, keys, folder)
    groups = at.groupBy(*keys, *prints).agg(F.min("commit").alias("representative"), F.count("*").alias("copies"))
    return at.join(groups, [*keys, *prints]).select(*keys, "commit", "representative", "copies")


def changed_folders(commits: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, commit, folder): folders whose tree a commit leaves other than its first parent's."""
    return folder_deltas(changes, keys).where("p0 <> 0 OR p1 <> 0 OR p2 <> 0 OR p3 <> 0").select(*keys, "commit", "folder")


def intervals(history: DataFrame, key: str, date: str, changes: str) -> DataFrame:
    """(key, kind, value, since, until): when a record held each value; until is null for what it still holds.

    history: key, date, changes (array of action, type, old, new) as ``parsing.change_history`` reads them: Added puts ``new`` in, Removed takes ``old``
    out, Changed does both. Changes of one date count in the order of their list, removals of what is not there do nothing, and what is added again
    while it is there has begun before.
    """
    each = history.select(key, F.col(date).alias("date"), F.posexplode(changes).alias("n", "c")).select(key, "date", "n", F.col("c.type").alias("kind"), "c.old", "c.new", F.col("c.action").alias("action"))
    out = F.when(F.col("action").isin("Removed", "Changed"), F.struct(F.lit(0).alias("held"), F.col("old").alias("value")))
    put = F.when(F.col("action").isin("Added", "Changed"), F.struct(F.lit(1).alias("held"), F.col("new").alias("value")))
    events = each.select(key, "kind", "date", "n", F.posexplode(F.array_compact(F.array(out, put))).alias("m", "e")).select(key, "kind", "date", "n", "m", "e.*").where("value IS NOT NULL")
    w = Window.partitionBy(key, "kind", "value").orderBy("date", "n", "m")
    turns = events.withColumn("before", F.coalesce(F.lag("held").over(w), F.lit(0))).where("held <> before")
    ends = turns.withColumn("until", F.lead("date").over(w))
    return ends.where("held = 1").select(key, "kind", "value", F.col("date").alias("since"), "until").where("until IS NULL OR until > since")


def held_at(spans: DataFrame, points: DataFrame, key: str, date: str) -> DataFrame:
    """Rows of ``points`` (key, date and others) with each (kind, value) that the record held then; nulls where it held none.

    A change of that very date counts. The join is on the record, so its spans meet its own points only.
    """
    s = spans.select(F.col(key).alias("_k"), "kind", "value", "since", "until")
    on = (F.col(key) == F.col("_k")) & (F.col("since") <= F.col(date)) & (F.col("until").isNull() | (F.col(date) < F.col("until")))
    return points.join(s, on, "left").drop("_k", "since", "until")
