"""Link graphs as tables: bounded breadth-first search, path scores, edge rules and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixmine.operators.linkage import met
from fixmine.store import checkpoints, kept

EX = "EX"


def add_edges(edges: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``edges`` with the new ones whose parent is known and whose pair is not there in either direction."""
    nodes = edges.select(key, F.col("src").alias("_n")).union(edges.select(key, F.col("dst"))).distinct()
    pair = lambda df: df.select(key, F.least("src", "dst").alias("_x"), F.greatest("src", "dst").alias("_y"))
    known = new.join(nodes, (new[key] == nodes[key]) & (new["src"] == nodes["_n"]), "left_semi")
    one = known.withColumn("_x", F.least("src", "dst")).withColumn("_y", F.greatest("src", "dst")).dropDuplicates([key, "_x", "_y"])
    return edges.unionByName(one.join(pair(edges), [key, "_x", "_y"], "left_anti").drop("_x", "_y").select(*edges.columns))


def insert_outcomes(edges: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``new`` (key, src, dst, ``order`` and others) with ``added``: true where the child is a new node, null where an edge joins two nodes that are
    there (the child is not looked into again), false where the edge is refused: its parent is no node, or the pair has an edge in either direction.

    Edges are taken one after the other by ``order``, but a parent counts only if it was a node before the first of them.
    """
    nodes = edges.select(key, F.col("src").alias("_n")).union(edges.select(key, F.col("dst"))).distinct()
    pairs = edges.select(key, F.least("src", "dst").alias("_x"), F.greatest("src", "dst").alias("_y")).distinct().withColumn("_there", F.lit(True))
    flag = lambda column, name: nodes.select(key, F.col("_n").alias(column), F.lit(True).alias(name))
    rows = new.withColumn("_x", F.least("src", "dst")).withColumn("_y", F.greatest("src", "dst"))
    rows = rows.join(flag("src", "_parent"), [key, "src"], "left").join(flag("dst", "_child"), [key, "dst"], "left").join(pairs, [key, "_x", "_y"], "left")
    sound = F.col("_parent").isNotNull() & F.col("_there").isNull()
    first = lambda *by: F.row_number().over(Window.partitionBy(key, *by, sound).orderBy(order))
    ok = sound & (first("_x", "_y") == 1)
    fresh = F.col("_child").isNull() & (first("dst") == 1)
    return rows.withColumn("added", F.when(~ok, F.lit(False)).when(fresh, F.lit(True))).select(*new.columns, "added")


def bfs_levels(edges: DataFrame, roots: DataFrame, depth: int, expand: Column | None = None) -> DataFrame:
    """(root, node, level): nodes at most ``depth`` edges from each root at their least level.

    edges: src, dst; roots: root. expand: which edges may be followed beyond level 1. Each level is one join; what has been seen
    is removed by an anti-join, and lineage is cut after each level.
    """
    checkpoints(edges.sparkSession)
    edges = edges.checkpoint()
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("level"))
    frontier = seen
    for level in range(1, depth + 1):
        usable = edges if level == 1 or expand is None else edges.where(expand)
        step = frontier.join(usable, frontier["node"] == usable["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, ["root", "node"], "left_anti").withColumn("level", F.lit(level).cast("long")).checkpoint()
        seen = seen.union(frontier)
    return seen


SEARCHED = ("issue_url", "patch_url", "github_repo_url")


def deep_search(refs: DataFrame, links: DataFrame, types: DataFrame, rounds: int = 2, most: int = 5) -> DataFrame:
    """(root, src, dst, level): the reference graph of each root.

    refs: root, source, node; links: node, child, pos (the references on a node's page, in order); types: node, type. The root
    has its sources, a source its references. In the first round all references but changes and repositories are looked
    into, later the issues that were new in the round before, ``most`` of each page at most, first by place. A page
    adds issues, changes and repositories; a pair that is there in either direction is not added, and a node that is
    there already is linked but not looked into. Of pages that bring a new node in one round it is the first one's, by name.
    """
    checkpoints(refs.sparkSession)
    sources = refs.select("root", F.col("root").alias("src"), F.col("source").alias("dst"), F.lit(1).cast("long").alias("level")).distinct()
    tops = refs.select("root", F.col("source").alias("src"), F.col("node").alias("dst"), F.lit(2).cast("long").alias("level")).distinct()
    edges = sources.union(tops).checkpoint()
    typed = links.join(types.select(F.col("node").alias("child"), "type"), "child").where(F.col("type").isin(list(SEARCHED))).checkpoint()
    front = refs.select("root", "node").distinct().join(types, "node").where("type NOT IN ('patch_url', 'github_repo_url')").select("root", "node")
    for level in range(3, 3 + rounds):
        pair = lambda a, b: F.array_sort(F.array(a, b))
        step = front.join(typed, "node").where("node <> child").groupBy("root", "node", "child", "type").agg(F.min("pos").alias("pos")).withColumn("_p", pair("node", "child"))
        step = step.join(edges.select("root", pair("src", "dst").alias("_p")), ["root", "_p"], "left_anti")
        # of the two directions of a pair the first page's counts
        step = step.withColumn("_d", F.row_number().over(Window.partitionBy("root", "_p").orderBy("node"))).where("_d = 1").drop("_d", "_p").checkpoint()
        known = edges.select("root", F.col("src").alias("child")).union(edges.select("root", "dst")).distinct()
        fresh = step.join(known, ["root", "child"], "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy("root", "child").orderBy("node"))).where("_n = 1 AND type = 'issue_url'")
        front = fresh.withColumn("_k", F.row_number().over(Window.partitionBy("root", "node").orderBy("pos", "child"))).where(F.col("_k") <= most).select("root", F.col("child").alias("node")).checkpoint()
        edges = edges.union(step.select("root", F.col("node").alias("src"), F.col("child").alias("dst"), F.lit(level).cast("long").alias("level"))).checkpoint()
    return edges


def simple_paths(edges: DataFrame, roots: DataFrame, cutoff: int = 4, targets: DataFrame | None = None) -> DataFrame:
    """(root, node, path): all paths without a repeated node of 1 to ``cutoff`` edges.

    With targets (node), edges from which no target can be reached in the remaining steps are left out first. Lineage is
    cut after each step, as each step's result is used twice.
    """
    checkpoints(edges.sparkSession)
    edges = edges.select("src", "dst").distinct().checkpoint()
    out, paths = None, roots.select("root", F.col("root").alias("node"), F.array("root").alias("path"))
    near = []
    if targets is not None:
        back = targets.select(F.col("node").alias("n")).distinct()
        for _ in range(cutoff):
            near.append(back)
            back = back.union(edges.join(back, edges["dst"] == back["n"], "left_semi").select("src")).distinct().checkpoint()
        near.reverse()
    for k in range(cutoff):
        usable = edges if not near else edges.join(near[k], edges["dst"] == near[k]["n"], "left_semi")
        paths = paths.join(usable, paths["node"] == usable["src"]).where(~F.array_contains("path", F.col("dst"))).select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")).checkpoint()
        out = paths if out is None else out.union(paths)
    return out if targets is None else out.join(targets, "node", "left_semi").select("root", "node", "path")


def path_scores(paths: DataFrame, via: Column) -> DataFrame:
    """(root, node, score, paths, depth, steps): each path counts 2 ** -(nodes - 2), twice that if it goes via the trusted node.

    via: whether the path has that node. depth: the reciprocal of the shortest path, one edge less via that node.
    """
    n = F.size("path")
    weight = F.pow(F.lit(2.0), -(n - F.when(via, 3).otherwise(2)))
    length = n - 1 - F.when(via, 1).otherwise(0)
    return paths.groupBy("root", "node").agg(F.sum(weight).alias("score"), F.count("*").alias("paths"), (1 / F.min(F.greatest(length, F.lit(1)))).alias("depth"), F.min(n - 1).cast("long").alias("steps"))


def _leading(links: DataFrame, pairs: DataFrame, pair: list[str]) -> DataFrame:
    """(pair, _at, _to): for each (key, root, node) the edges on walks to node that do not come back to root, found from node up."""
    at = pairs.select(*pair, F.col("node").alias("_to"))
    seen, found = at, None
    while True:
        step = at.join(links, [pair[0], "_to"]).select(*pair, "_at", "_to").checkpoint()
        if step.isEmpty():
            return step if found is None else found.checkpoint()
        found = step if found is None else found.union(step)
        at = step.where("_at <> root").select(*pair, F.col("_at").alias("_to")).distinct().join(seen, [*pair, "_to"], "left_anti").checkpoint()
        seen = seen.union(at)


def local_connectivity(edges: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, root, node, connectivity): how many paths without a common inner node lead from root to node.

    Paths are taken shortest first (of equal lengths the least by its nodes) and their inner nodes taken out, which is the usual
    approximation from below. edges: key, src, dst; pairs: key, root, node. All pairs of all graphs are searched together: a step is a join of
    their fronts with the edges that lead to the pair's node, and what was seen or used is left out by anti-joins, so no task holds a graph
    and a front never spreads over all children of a node.
    """
    checkpoints(edges.sparkSession)
    pair = [key, "root", "node"]
    links = edges.select(key, F.col("src").alias("_at"), F.col("dst").alias("_to")).distinct().checkpoint()
    asked = pairs.select(*pair).distinct().checkpoint()
    active = asked.where("root <> node")
    ends = links.select(key, F.col("_at").alias("root"), F.col("_to").alias("node"))
    direct = active.join(ends, pair, "left_semi").withColumn("_direct", F.lit(True)).checkpoint()
    links = _leading(links, active, pair)
    counts = direct.select(*pair, F.lit(1).cast("long").alias("n"))
    active = active.join(direct, pair, "left").na.fill(False, ["_direct"]).checkpoint()
    used = active.where("false").select(*pair, F.col("root").alias("_to"))
    while active.head(1):
        front = active.select(*pair, "_direct", F.col("root").alias("_at"), F.array("root").alias("_path"))
        seen = front.select(*pair, F.col("_at").alias("_to"))
        found = None
        while front.head(1):
            step = front.join(links, [*pair, "_at"]).where(~(F.col("_direct") & (F.col("_at") == F.col("root")) & (F.col("_to") == F.col("node"))))
            new = step.join(used.union(seen), [*pair, "_to"], "left_anti").groupBy(*pair, "_direct", F.col("_to").alias("_at")).agg(F.min(F.concat("_path", F.array("_to"))).alias("_path")).checkpoint()
            hit = new.where("_at = node")
            found = hit if found is None else found.union(hit)
            ended = hit.select(*[F.col(c).alias(c) for c in pair])
            front = new.join(ended, pair, "left_anti").select(*new.columns)
            seen = seen.union(new.select(*pair, F.col("_at").alias("_to")))
        found = found.checkpoint()
        counts = counts.union(found.select(*pair, F.lit(1).cast("long").alias("n")))
        inner = found.select(*pair, F.explode(F.slice("_path", F.lit(2), F.size("_path") - 2)).alias("_to"))
        used = used.union(inner).checkpoint()
        active = found.select(*pair, "_direct").checkpoint()
    total = counts.groupBy(*pair).agg(F.sum("n").alias("connectivity"))
    return asked.join(total, pair, "left").na.fill(0, ["connectivity"])


def priorities(scores: DataFrame, degree: DataFrame, connectivity: DataFrame) -> DataFrame:
    """(root, node, CN, PC, DP, DG, C, DG_C, DG_DP): all priorities of a node.

    scores: as of ``path_scores``, with ``steps``, the edges of the shortest path; degree: node, in_degree, out_degree; connectivity: root, node,
    connectivity. In DG_DP two steps count as one.
    """
    dg = F.col("in_degree") + F.col("out_degree")
    all_ = scores.join(degree, "node", "left").join(connectivity.select("root", "node", "connectivity"), ["root", "node"], "left").na.fill(0, ["in_degree", "out_degree", "connectivity"])
    return all_.select("root", "node", F.col("score").alias("CN"), F.col("paths").alias("PC"), F.col("depth").alias("DP"), dg.alias("DG"), F.col("connectivity").alias("C"), (dg * F.col("connectivity")).alias("DG_C"), (dg / F.when(F.col("steps") > 2, F.col("steps")).otherwise(1)).alias("DG_DP"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def only_tagged(edges: DataFrame, tag: str = EX) -> DataFrame:
    """(node): nodes all of whose in-edges have the tag."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.bool_and(F.coalesce(F.col("tag") == tag, F.lit(False))).alias("_o")).where("_o").select("node")


def without_tag(edges: DataFrame, tag: str = EX) -> DataFrame:
    """Edges without the tag; nodes that only had such edges vanish with them."""
    return edges.where(F.coalesce(F.col("tag") != tag, F.lit(True)))


def without_node(edges: DataFrame, node) -> DataFrame:
    """Edges that do not touch a node; what was below it stays."""
    return edges.where((F.col("src") != node) & (F.col("dst") != node))


def sibling_counts(edges: DataFrame) -> DataFrame:
    """(node, siblings): for each node the number of other nodes that share a parent with it, without pairing them.

    Each node is counted by its parents' numbers of children, less itself for each parent.
    """
    children = edges.select("src", "dst").distinct()
    sizes = children.groupBy("src").agg(F.count("*").alias("k"))
    return children.join(sizes, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("k") - 1).alias("siblings"))


#: Parents of a node up to which they go with each of its edges.
PARENTS = 64


def siblings(edges: DataFrame, nodes: DataFrame, pool: DataFrame) -> DataFrame:
    """(node, sibling): for each of ``nodes`` (node) those of ``pool`` (node) that share a parent with it, itself among them.

    One row for each pair asked for; ``nodes`` is a selection, not the graph. Two nodes with several parents each are a row only below the first parent
    that they share, by its name, which the parents before it tell. Only pairs of which one has more than ``PARENTS`` parents are made distinct.
    """
    whole = Window.partitionBy("dst")
    named = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct().withColumn("_n", F.count("*").over(whole))
    named = named.withColumn("_all", F.collect_list(F.when(F.col("_n").between(2, PARENTS), F.col("src"))).over(whole))
    before = F.filter("_all", lambda p: p < F.col("src"))
    children = named.select("src", "dst", "_n", F.when(F.size(before) > 0, before).alias("_before"))
    of = lambda some, name, mark: children.join(some.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", F.col("dst").alias(name), F.col("_n").alias(f"_n{mark}"), F.col("_before").alias(f"_before{mark}"))
    asked, found = kept(of(nodes, "node", 1), "asked"), kept(of(pool, "sibling", 2), "found")
    parents = asked.select("src").distinct().join(found.select("src").distinct(), "src")
    once = (F.col("_n1") == 1) | (F.col("_n2") == 1) | (F.greatest("_n1", "_n2") <= PARENTS)
    first = F.col("_before1").isNull() | F.col("_before2").isNull() | ~F.arrays_overlap("_before1", "_before2")
    pairs = met(asked.withColumnRenamed("src", "_a"), "_a", found.withColumnRenamed("src", "_b"), "_b", parents.select(F.col("src").alias("_a"), F.col("src").alias("_b")))
    many = asked.where("_n1 > 1").join(found.where("_n2 > 1"), "src").where(~once)
    return pairs.where(once & first).select("node", "sibling").union(many.select("node", "sibling").distinct())


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other): ends of edges in both directions."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src")).where("node <> other").distinct()


def two_hops(edges: DataFrame) -> DataFrame:
    """(node, other): distinct nodes two edges away along the edges' direction, itself not."""
    a, b = edges.select(F.col("src").alias("node"), F.col("dst").alias("mid")).distinct(), edges.select(F.col("src").alias("mid"), F.col("dst").alias("other")).distinct()
    return a.join(b, "mid").where("node <> other").select("node", "other").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b, of any type with an order); component: its smallest reachable node.

    Every node takes the least label of itself and its neighbours, then the label of that label, until nothing changes: about
    log(length) rounds on chains.
    """
    checkpoints(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().checkpoint()
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_m"))
        least = labels.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("_m", "component")).alias("_l"))
        of = labels.select(F.col("node").alias("_l"), F.col("component").alias("_up"))
        now = least.join(of, "_l").select("node", F.least("_l", "_up").alias("component"), (F.least("_l", "_up") != F.col("component")).alias("_new")).checkpoint()
        labels = now.drop("_new")
        if now.where("_new").isEmpty():
            return labels


def patch_set_scores(pred: DataFrame, truth: DataFrame, equivalent: DataFrame) -> DataFrame:
    """(entity, tp, fp, fn, precision, recall) of predicted keys, with hits passed on among equivalent truths.

    pred, truth: entity, key; equivalent: entity, a, b. A hit truth makes its equivalents (from a to b) hits; one with
    equivalents that are all hit becomes one. Truths that are equivalent both ways are one set from the start; rounds go on until no
    truth becomes a hit.
    """
    checkpoints(pred.sparkSession)
    p = pred.select("entity", "key")
    tp = p.join(truth.select("entity", "key").distinct(), ["entity", "key"], "left_semi")
    known = truth.select("entity", "key").distinct()
    name = lambda c: F.struct("entity", F.col(c).alias("key"))
    ends = known.select(F.struct("entity", "key").alias("_k"))
    near = equivalent.select(name("a").alias("a"), name("b").alias("b")).distinct()
    near = near.join(ends, near["a"] == ends["_k"], "left_semi").join(ends, near["b"] == ends["_k"], "left_semi").checkpoint()
    mutual = near.intersect(near.select("b", "a"))
    label = connected(mutual)
    sets = ends.join(label, ends["_k"] == label["node"], "left").select("_k", F.coalesce("component", "_k").alias("set")).checkpoint()
    hit = sets.join(tp.select(F.struct("entity", "key").alias("_k")), "_k", "left_semi").select("set").distinct().checkpoint()
    of = lambda c: sets.select(F.col("_k").alias(c), F.col("set").alias(f"set_{c}"))
    links = near.join(of("a"), "a").join(of("b"), "b").checkpoint()
    while True:
        forward = links.join(hit, links["set_a"] == hit["set"], "left_semi").select(F.col("set_b").alias("set"))
        marked = links.join(hit.select(F.col("set").alias("set_b"), F.lit(1).alias("_h")), "set_b", "left")
        backward = marked.groupBy("a", "set_a").agg(F.bool_and(F.col("_h").isNotNull()).alias("_all")).where("_all").select(F.col("set_a").alias("set"))
        new = forward.union(backward).distinct().join(hit, "set", "left_anti").checkpoint()
        if new.isEmpty():
            break
        hit = hit.union(new).checkpoint()
    missed = sets.join(hit, "set", "left_anti").groupBy(F.col("_k.entity").alias("entity")).agg(F.count("*").alias("fn"))
    n = p.groupBy("entity").agg(F.count("*").alias("all")).join(tp.groupBy("entity").agg(F.count("*").alias("tp")), "entity", "left")
    every = known.select("entity").union(p.select("entity")).distinct().join(n, "entity", "left").join(missed, "entity", "left").na.fill(0, ["all", "tp", "fn"])
    good = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return every.select("entity", "tp", (F.col("all") - F.col("tp")).alias("fp"), "fn", good(F.col("tp"), F.col("all")).alias("precision"), good(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def extend(selected: DataFrame, edges: DataFrame, valid: Column, pool: DataFrame) -> DataFrame:
    """``selected`` (node) and the tagged neighbours in either direction that ``valid`` admits and ``pool`` (node) has.

    edges: src, dst, tag and what ``valid`` refers to.
    """
    tagged = edges.where((F.col("tag") == EX) & valid)
    both = tagged.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(tagged.select("dst", "src"))
    more = both.join(selected, "node", "left_semi").select(F.col("other").alias("node")).join(pool, "node", "left_semi")
    return selected.select("node").union(more).distinct()


def deeper_than(nodes: DataFrame, score: str, baseline: DataFrame, strict: bool = False) -> DataFrame:
    """Nodes whose score is at least (or over) the baseline's highest; all of them for an empty baseline."""
    top = baseline.agg(F.max(score).alias("_m"))
    ok = F.col(score) > F.col("_m") if strict else F.col(score) >= F.col("_m")
    return nodes.crossJoin(F.broadcast(top)).where(F.coalesce(ok, F.lit(True))).drop("_m")  # the baseline is one row


def from_search(edges: DataFrame, by_id: DataFrame, by_key: DataFrame, key: str) -> DataFrame:
    """``edges`` and search results: changes found by id below the root, those found by an issue key below the node with that key.

    by_id: key, root, node; by_key: key, holder, node.
    """
    new = by_id.select(key, F.col("root").alias("src"), F.col("node").alias("dst")).union(by_key.select(key, F.col("holder").alias("src"), F.col("node").alias("dst"))).withColumn("tag", F.lit("SG"))
    return add_edges(edges, new, key)


def from_sources(refs: DataFrame, key: str) -> DataFrame:
    """(key, src, dst, tag): the root to its sources and each source to its references.

    refs: key, source, url; an entity without references of a source has no edge for it.
    """
    top = refs.select(key, F.col(key).alias("src"), F.col("source").alias("dst")).distinct()
    return top.union(refs.select(key, F.col("source").alias("src"), F.col("url").alias("dst")).distinct()).withColumn("tag", F.lit(None).cast("string"))


def direct_or_found(edges: DataFrame, roots: DataFrame, source: Column) -> DataFrame:
    """(root, node): nodes directly below a trusted source of the root, and those that a search hung below the root itself.

    source: whether ``mid``, a child of the root, is the trusted source. edges: src, dst, tag.
    """
    top = roots.join(edges, roots["root"] == edges["src"]).select("root", F.col("dst").alias("mid"), "tag")
    below = top.where(source & F.col("tag").isNull()).select("root", "mid").join(edges.where("tag IS NULL").select(F.col("src").alias("mid"), F.col("dst").alias("node")), "mid")
    return below.select("root", "node").union(top.where("tag = 'SG'").select("root", F.col("mid").alias("node"))).distinct()


def subgraph_by_rules(nodes: DataFrame, edges: DataFrame, selected: DataFrame, on_paths: DataFrame, quiet: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) left by the rules of a cleaned graph. nodes: node, type; edges: src, dst, tag; selected, on_paths: node.

    Changes that are not selected go; with ``quiet`` so do issues on no path to a selected change. Edges with the tag attach go, and EX
    edges of which only one end is selected; then edges with an end that is gone, and nodes without an edge.
    """
    chosen = selected.select("node").distinct().withColumn("_s", F.lit(True))
    stay = nodes.join(chosen, "node", "left").where((F.col("type") != "patch_url") | F.col("_s").isNotNull()).drop("_s")
    if quiet:
        stay = stay.join(on_paths.select("node").distinct().withColumn("_p", F.lit(True)), "node", "left").where((F.col("type") != "issue_url") | F.col("_p").isNotNull()).drop("_p")
    end = lambda c: chosen.select(F.col("node").alias(c), F.col("_s").alias(f"_{c}"))
    marked = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    half = (F.col("tag") == EX) & (F.col("_src").isNull() != F.col("_dst").isNull())
    kept = marked.where(F.coalesce(~((F.col("tag") == "attach") | half), F.lit(True))).select(*edges.columns)
    for c in ("src", "dst"):
        kept = kept.join(stay.select(F.col("node").alias(c)), c, "left_semi").select(*edges.columns)
    ends = kept.select(F.col("src").alias("node")).union(kept.select("dst")).distinct()
    return stay.join(ends, "node", "left_semi"), kept


def node_info(nodes: DataFrame, url: str) -> DataFrame:
    """``nodes`` with ``issue_keys`` (without CVE ids) and ``github_repo`` (owner/repo) of their URLs; null where there is none."""
    keys = F.array_distinct(F.filter(F.regexp_extract_all(F.col(url), F.lit("([A-Z][A-Z0-9]+-[0-9]+)")), lambda x: ~x.startswith("CVE-")))
    repo = F.regexp_extract(F.col(url), "github[.]com/([^/]+/[^/]+)", 1)
    return nodes.withColumn("issue_keys", F.when(F.size(keys) > 0, keys)).withColumn("github_repo", F.nullif(repo, F.lit("")))


def confirmed(nodes: DataFrame, kind: str = "kind") -> DataFrame:
    """All changes of a kind that can be one, without a priority, those below ``/files/`` not."""
    return nodes.where(F.col(kind).isin("git_commit", "svn") & ~F.contains(F.col("node"), F.lit("/files/")))
