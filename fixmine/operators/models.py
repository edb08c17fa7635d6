"""Linear, logistic and boosted scorers over feature tables, and splits for their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixmine.store import scratch


def fold(ident: Column, folds: int) -> Column:
    """The fold of an id, from its digest: the same on every engine, and whole ids stay together."""
    return (F.conv(F.substring(F.md5(ident.cast("string")), 1, 6), 16, 10).cast("long") % folds).alias("fold")


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept) of the least-squares line, in one pass of sums."""
    n, a, b = F.count("*"), F.col(x).cast("double"), F.col(y).cast("double")
    s = df.agg(n.alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))
    slope = F.expr("(n * sxy - sx * sy) / (n * sxx - sx * sx)")
    return s.select(slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("intercept"))


def assembled(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """A vector of the features, and a weight that balances the classes."""
    from pyspark.ml.feature import VectorAssembler

    share = df.agg(F.avg(F.col(label).cast("double")).alias("_s"))
    weighted = df.crossJoin(F.broadcast(share)).withColumn("weight", F.when(F.col(label) == 1, 0.5 / F.col("_s")).otherwise(0.5 / (1 - F.col("_s")))).drop("_s")
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(weighted)


def filled(train: DataFrame, test: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with doubles for features; a missing one (null or NaN) is the mean of the training rows that have it, or 0 if none has."""
    value = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
    means = train.agg(*[F.avg(value(f)).alias(f) for f in features]).first().asDict()
    full = {f: F.coalesce(value(f), F.lit(means[f]), F.lit(0.0)) for f in features}
    return train.withColumns(full), test.withColumns(full)


def fit_predict(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, kind: str = "logistic", rounds: int = 500) -> DataFrame:
    """``test`` with ``score``: the probability of the positive class, or the value of a linear model.

    kind: linear, logistic (balanced) or boosted (``rounds`` trees of depth 5). Every row of ``test`` is scored, for missing features
    see ``filled``; rows of ``train`` without a label are left out.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    train, test = filled(train.where(F.col(label).isNotNull()), test, features)
    data = assembled(train, features, label).withColumn("_label", F.col(label).cast("double"))
    model = estimator(kind, rounds).fit(data)
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(test)
    out = model.transform(vectors)
    score = F.col("prediction") if kind == "linear" else vector_to_array("probability")[1]
    return out.withColumn("score", score).drop("features", "rawPrediction", "probability", "prediction")


def estimator(kind: str, rounds: int = 500):
    """The estimator of a kind, for a column ``features``, labels in ``_label`` and, but for linear, weights in ``weight``."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.regression import LinearRegression

    return {
        "linear": lambda: LinearRegression(labelCol="_label", solver="normal"),
        "logistic": lambda: LogisticRegression(labelCol="_label", weightCol="weight", maxIter=200),
        "boosted": lambda: GBTClassifier(labelCol="_label", weightCol="weight", maxDepth=5, maxIter=rounds, stepSize=0.05, seed=0),
    }[kind]()


def cross_validated(df: DataFrame, ident: str, features: Sequence[str], label: str, folds: int = 5, kind: str = "logistic", rounds: int = 500) -> DataFrame:
    """Every row scored by a model of the other folds; rows of one id are in one fold."""
    if kind != "boosted":
        return cross_scored(df, ident, features, label, {"score": kind}, folds)
    rows = df.withColumn("fold", fold(F.col(ident), folds))
    parts = [fit_predict(rows.where(F.col("fold") != k), rows.where(F.col("fold") == k), features, label, kind, rounds) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_scored(df: DataFrame, ident: str, features: Sequence[str], label: str, kinds: dict[str, str], folds: int = 5) -> DataFrame:
    """``cross_validated`` by several linear or logistic models at once: a score for each name in ``kinds``.

    Folds, features and labels are written once and all models are fitted on that table; means and shares of all folds come from one
    aggregation. A score is then an expression of the features and of its fold's coefficients, so ``df`` is read once more and not once a fold.
    """
    from pyspark.ml.feature import VectorAssembler

    spark = df.sparkSession
    rows = df.withColumn("fold", fold(F.col(ident), folds)).where("fold IS NOT NULL")
    own = [f"_x{i}" for i in range(len(features))]
    value = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features]
    path = scratch(spark, "folds")
    rows.where(F.col(label).isNotNull()).select("fold", F.col(label).cast("double").alias("_label"), *[v.alias(x) for v, x in zip(value, own, strict=True)]).write.parquet(path)
    kept = spark.read.schema(", ".join(["fold long", *(f"{x} double" for x in ("_label", *own))])).parquet(path)
    sums = kept.groupBy("fold").agg(*[f(x).alias(f"{n}{x}") for x in ("_label", *own) for n, f in (("n", F.count), ("s", F.sum))]).collect()
    means, weights = [], {name: [] for name in kinds}
    for k in range(folds):
        others = [s for s in sums if s["fold"] != k]
        mean = {x: sum(s[f"s{x}"] or 0.0 for s in others) / n if (n := sum(s[f"n{x}"] for s in others)) else None for x in ("_label", *own)}
        share = mean.pop("_label")
        means.append([0.0 if m is None else m for m in mean.values()])
        train = kept.where(F.col("fold") != k).fillna(dict(zip(own, means[-1], strict=True)))
        balance = F.when(F.col("_label") == 1, F.lit(0.5 / share if share else None)).otherwise(F.lit(0.5 / (1 - share) if share is not None and share != 1 else None))
        data = VectorAssembler(inputCols=own, outputCol="features").transform(train.withColumn("weight", balance.cast("double"))).select("features", "weight", "_label")
        for name, kind in kinds.items():
            model = estimator(kind).fit(data)
            weights[name].append([float(c) for c in (*model.coefficients, model.intercept)])
    of_fold = lambda table, i: F.element_at(F.lit([float(t[i]) for t in table]), (F.col("fold") + 1).cast("int"))
    out = rows.withColumns({f: F.coalesce(v, of_fold(means, i)) for i, (f, v) in enumerate(zip(features, value, strict=True))})
    for name, kind in kinds.items():
        line = F.lit(0.0)
        for i, f in enumerate(features):
            line = line + F.col(f) * of_fold(weights[name], i)
        line = line + of_fold(weights[name], len(features))
        out = out.withColumn(name, line if kind == "linear" else 1 - 1 / (1 + F.exp(line)))
    return out


def examples(df: DataFrame, first: str, second: str, label: str, ident: str, most: int = 128) -> DataFrame:
    """(id, text_a, text_b, label): lower-cased texts cut to so many tokens for an external pair model."""
    cut = lambda c: F.array_join(F.slice(F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda x: x != ""), 1, most), " ")
    return df.select(F.col(ident).alias("id"), cut(first).alias("text_a"), cut(second).alias("text_b"), F.col(label).cast("int").alias("label"))


def without_group(features: Sequence[str], groups: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """The features that are left when one group is taken out, for each group: what a leave-group-out run fits."""
    return {name: [f for f in features if f not in set(own)] for name, own in groups.items()}


def leave_group_out(train: DataFrame, test: DataFrame, features: Sequence[str], groups: dict[str, Sequence[str]], label: str, kind: str = "logistic", rounds: int = 500) -> DataFrame:
    """``test`` once for each group of features, scored by a model that has all others, with the group's name in ``left_out``."""
    out = None
    for name, left in without_group(features, groups).items():
        part = fit_predict(train, test, left, label, kind, rounds).withColumn("left_out", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def cross_group(df: DataFrame, group: str, train: Sequence, features: Sequence[str], label: str, kind: str = "logistic", rounds: int = 500) -> DataFrame:
    """Rows of all other groups scored by a model of the groups ``train``, as of one repository on the rest."""
    inside = F.coalesce(F.col(group).isin(list(train)), F.lit(False))
    return fit_predict(df.where(inside), df.where(~inside), features, label, kind, rounds)
