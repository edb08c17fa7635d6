"""The three workflows as compositions of operators: filter and vote, graph localisation, feature ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fixmine.operators import filters, graph, linkage, metrics, models, ranking, votes
from fixmine.store import dealt


def filter_and_vote(candidates: DataFrame, answers: DataFrame, entity: str = "cve", file: str = "file", keys: tuple[str, str, str] = ("hash", "short", "subject")) -> DataFrame:
    """(entity, number, hash, frequency): the candidates of each entity that most answers name.

    candidates are screened by how many files they are in, then numbered by hash; answers: entity, vote (a number).
    """
    kept = votes.cross_branch_frequency(candidates, [entity], file, keys)
    numbered = ranking.rank_within(kept, [entity], [*keys, file], "number")
    won = votes.modes(answers, entity, "vote").select(entity, F.explode("modes").alias("number"), "frequency")
    return won.join(numbered, [entity, "number"], "left").select(entity, "number", keys[0], "frequency")


def vote_scores(won: DataFrame, truth: DataFrame, entity: str = "cve") -> DataFrame:
    """Macro and micro scores of won candidates against true hashes of the same length."""
    named = won.where("hash is not null")
    return metrics.summarise(metrics.set_scores(named.select(entity, "hash"), truth.select(entity, "hash"), [entity], "hash"))


def localise(edges: DataFrame, roots: DataFrame, patches: DataFrame, trusted: Column, rules: dict[str, Column], source: Column | None = None, valid: Column | None = None, most: int | None = None, ablate: Sequence[str] = (), cutoff: int = 4) -> DataFrame:
    """(root, node): selected changes of each root.

    Sources in ``ablate`` go with their edges. Of the changes (``patches``: node and what ``rules`` refer to) that pass all rules and have an
    edge without the tag EX, those with the highest path score over such edges are taken (``trusted``: whether a ``path`` goes via the
    trusted node), and with ``source`` (see ``direct_or_found``) those directly below a trusted source or found by a search. With ``valid``, which
    says of an edge (src, dst, tag and others) whether it may extend, changes that pass the rules and are EX neighbours of one taken
    follow. most: a root with more results has none.
    """
    for node in ablate:
        edges = graph.without_node(edges, node)
    usable = graph.without_tag(edges)
    passed = filters.screen(patches, **rules).where("selected").select("node").distinct()
    ok = passed.join(graph.only_tagged(edges), "node", "left_anti")
    scores = graph.path_scores(graph.simple_paths(usable, roots, cutoff, ok), trusted)
    taken = ranking.best_within(scores, ["root"], "score").select("root", "node")
    if source is not None:
        taken = taken.union(graph.direct_or_found(usable, roots, source).join(ok, "node", "left_semi").select("root", "node")).distinct()
    if valid is not None:
        extends = edges.where((F.col("tag") == graph.EX) & valid)
        near = extends.select(F.col("src").alias("node"), F.col("dst").alias("_o")).union(extends.select("dst", "src")).distinct()
        taken = taken.union(taken.join(near, "node").select("root", F.col("_o").alias("node")).join(passed, "node", "left_semi").select("root", "node")).distinct()
    return taken if most is None else filters.no_more_than(taken, "root", most)


def rank_features(rows: DataFrame, entity: str, ident: str, features: Sequence[str], label: str, ks: Sequence[int] = (1, 2, 3, 5, 10)) -> tuple[DataFrame, DataFrame]:
    """(ranked rows, scores by k): fold-wise logistic and linear models, fused by the sum of their ranks."""
    scored = models.cross_scored(rows, entity, features, label, {"logistic": "logistic", "_linear": "linear"}).where(F.col(ident).isNotNull())
    # rows of one id meet all its linear scores, as in a join, but stay where their entity is
    linear = F.collect_list("_linear").over(Window.partitionBy(entity, ident))
    both = dealt(scored, [entity], 1 << 17, rows).withColumn("_linear", linear).withColumn("linear", F.explode("_linear")).drop("_linear")
    for s in ("logistic", "linear"):
        both = ranking.rank_within(both, [entity], [F.desc(s), ident], f"rank_{s}")
    ranked = ranking.rank_within(ranking.fuse_scores(both, ["rank_logistic", "rank_linear"], "borda"), [entity], ["fused", ident])
    return ranked, metrics.topk_prf(ranked, [entity], "rank", label, ks)


def match_precision(pred: DataFrame, truth: DataFrame, entity: str, match: Column) -> DataFrame:
    """(entity, precision) of predictions against all true changes of the entity."""
    hit = linkage.matched(pred, truth, entity, match).groupBy(entity).agg(F.count("*").alias("hits"))
    n = pred.groupBy(entity).agg(F.count("*").alias("n"))
    return n.join(truth.select(entity).distinct(), entity, "left_semi").join(hit, entity, "left").select(entity, metrics.ratio(F.coalesce("hits", F.lit(0)), F.col("n")).alias("precision"))


def evaluate_outputs(spark: SparkSession, folder: str, out: str, ks: Sequence[int], id_: str = "id", score: str = "score", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Scores of every ``*_output.csv`` in a folder (id, score, label), written as two CSV tables, precision by k and recall by k.

    All files are one table with the file's name, ranked and aggregated together; equal scores keep the order of their labels, worst first.
    """
    path = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = spark.read.option("header", True).option("inferSchema", True).option("pathGlobFilter", "*_output.csv").option("recursiveFileLookup", "true").csv(folder).withColumn("system", F.regexp_replace(path, "_output[.]csv$", ""))
    ranked = ranking.rank_within(rows, ["system", id_], [F.desc(score), label], "rank")
    made = []
    for name, measure in (("precision", metrics.topk_prf), ("recall", metrics.recall_effort_mrr)):
        parts = measure(ranked, [id_], "rank", label, ks, by=["system"])
        parts.write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
        made.append(spark.read.schema(parts.schema).option("header", True).csv(f"{out}/{name}"))
    return made[0], made[1]
