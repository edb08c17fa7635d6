"""Commit ranges, trees, functions, similarity joins and selections against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fixmine.operators import code, features, history, models, selection, similarity
from fixmine.sources import files


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


def ancestors(graph, at):
    todo, seen = [at], set()
    while todo:
        c = todo.pop()
        if c in graph and c not in seen:
            seen.add(c)
            todo += graph[c]
    return seen


def check_ranges(spark, repos, ranges, block):
    """repos: repo -> {commit: parents} in topological order."""
    commits = spark.createDataFrame([(r, c, n, p) for r, g in repos.items() for n, (c, p) in enumerate(g.items())], "repo string, commit string, order long, parents array<string>")
    asked = spark.createDataFrame(ranges, "range string, repo string, base string, head string")
    want = sorted((n, r, c) for n, r, base, head in ranges for c in ancestors(repos[r], head) - (ancestors(repos[r], base) if base else set()))
    assert rows(history.commit_ranges(commits, asked, block), "range", "repo", "commit") == want
    return want


def test_ranges_over_a_long_chain_and_a_diamond(spark):
    chain = {f"c{k}": [f"c{k - 1}"] if k else [] for k in range(1000)}
    diamond = {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"], "e": ["d"], "x": ["b", "gone"]}
    ranges = [("1", "chain", "c10", "c990"), ("2", "chain", None, "c5"), ("3", "chain", "c700", "c5"), ("4", "d", "b", "e"), ("5", "d", "c", "d"), ("6", "d", "e", "x"), ("7", "d", "x", "e"), ("8", "d", "a", "a"), ("9", "d", "nowhere", "b")]
    check_ranges(spark, {"chain": chain, "d": diamond}, ranges, 200)


@pytest.mark.parametrize("block", [7, 1000])
def test_ranges_over_random_graphs(spark, block):
    r = random.Random(block)
    repos = {}
    for k in range(3):
        g = {}
        for n in range(40):
            g[f"{k}-{n}"] = r.sample(list(g)[-6:], min(len(g), r.choice([1, 1, 1, 2, 3]))) if n and r.random() < 0.95 else []
        repos[f"r{k}"] = g
    ranges = [(f"{k}", repo, r.choice([None, *repos[repo]]), r.choice(list(repos[repo]))) for k, repo in enumerate(r.choices(list(repos), k=60))]
    assert len(check_ranges(spark, repos, ranges, block)) > 200


def test_ranges_need_an_order(spark):
    commits = spark.createDataFrame([("r", "a", 2, []), ("r", "b", 1, ["a"])], "repo string, commit string, order long, parents array<string>")
    with pytest.raises(ValueError, match="parent"):
        history.commit_ranges(commits, spark.createDataFrame([("1", "r", None, "b")], "range string, repo string, base string, head string"))
    assert history.commit_ranges(commits.limit(0), spark.createDataFrame([], "range string, repo string, base string, head string")).count() == 0


def test_trees_of_a_branching_history(spark):
    r = random.Random(5)
    paths = ["a.c", "src/a.c", "src/b.c", "src/lib/x.c"]
    trees, commits, changes = {}, [], []
    for n in range(120):
        parent = r.choice([*range(max(0, n - 5), n)]) if n else None
        tree = dict(trees.get(parent, {}))
        for p in r.sample(paths, r.randrange(3)):
            old, new = tree.get(p), r.choice(["1", "2", None])
            if old != new:
                changes.append(("r", n, p, old, new))
                tree.pop(p) if new is None else tree.__setitem__(p, new)
        trees[n] = tree
        commits.append(("r", n, parent))
    c = spark.createDataFrame(commits, "repo string, commit long, parent long")
    ch = spark.createDataFrame(changes, "repo string, commit long, path string, old string, new string")
    for folder in ("", "src", "src/lib"):
        key = {n: tuple(sorted((p, b) for p, b in t.items() if not folder or p.startswith(folder + "/"))) for n, t in trees.items()}
        want = sorted((("r", n, min(m for m in key if key[m] == key[n]), sum(key[m] == key[n] for m in key)) for n in key), key=str)
        assert rows(history.tree_classes(c, ch, ["repo"], folder)) == want
    deep = rows(history.changed_folders(c, ch, ["repo"]), "commit", "folder")
    assert {f for _, f in deep} == {"", "src", "src/lib"}
    assert {n for n, f in deep if f == "src/lib"} == {x[1] for x in changes if x[2] == "src/lib/x.c"}
    assert history.tree_classes(c.limit(0), ch.limit(0), ["repo"]).count() == 0


SOURCE = '''// void no() {
#include <x>
static int outer(int a,
                 char b)
{
    if (a) { return '}'; }
    const char *s = "{ \\" {";  /* } */
    return a;
}

struct point { int x; int y; };
class Box : public Base {
  public:
    Box(int w) : w_(w) { fill(w); }
    int size() const { return w_; }
    int declared(int);
};
int open(int a) {
  while (a) {
'''


def test_functions_with_braces(spark):
    df = spark.createDataFrame([("f", SOURCE), ("g", ""), ("h", None), ("i", "}} int f() { } {")], "file string, code string")
    found = code.functions(df, ["file"], "code")
    assert rows(found, "file", "function", "start", "end") == [("f", "Box", 14, 14), ("f", "outer", 3, 9), ("f", "size", 15, 15), ("i", "f", 1, 1)]
    points = spark.createDataFrame([("f", n) for n in (1, 3, 8, 9, 10, 14, 19)] + [("z", 1)], "file string, line long")
    assert rows(code.functions_at(points, found, ["file"], "line", 4), "file", "line", "function") == sorted([("f", 1, None), ("f", 3, "outer"), ("f", 8, "outer"), ("f", 9, "outer"), ("f", 10, None), ("f", 14, "Box"), ("f", 19, None), ("z", 1, None)], key=str)


def test_functions_by_indentation(spark):
    text = "import x\n\ndef a(b):\n    if b:\n        return 1\n\n    # note\n    def inner():\n        pass\n    return 2\n\nclass C:\n    async def m(self):\n        x = 1\n\n    y = 2\ndef last(): pass"
    df = spark.createDataFrame([("f", text)], "file string, code string")
    found = code.indented_functions(df, ["file"], "code")
    assert rows(found, "function", "start", "end") == [("a", 3, 10), ("inner", 8, 9), ("last", 17, 17), ("m", 13, 14)]
    points = spark.createDataFrame([("f", 9), ("f", 10), ("f", 16)], "file string, line long")
    assert rows(code.functions_at(points, found, ["file"], "line"), "line", "function") == [(10, "a"), (16, None), (9, "inner")]


def test_records_as_of_a_date(spark):
    entry = "array<struct<action:string,type:string,old:string,new:string>>"
    h = spark.createDataFrame(
        [("r", 1, [("Added", "CWE", None, "79"), ("Added", "URL", None, "u")]), ("r", 3, [("Changed", "CWE", "79", "89")]), ("r", 5, [("Removed", "URL", "u", None), ("Removed", "URL", "v", None), ("Added", "URL", None, "u")]), ("r", 7, [("Added", "CWE", None, "89"), ("Removed", "URL", "u", None)])],
        f"k string, d int, c {entry}",
    )
    spans = history.intervals(h, "k", "d", "c")
    assert rows(spans) == sorted([("r", "CWE", "79", 1, 3), ("r", "CWE", "89", 3, None), ("r", "URL", "u", 1, 5), ("r", "URL", "u", 5, 7)], key=str)
    points = spark.createDataFrame([("r", 0), ("r", 3), ("r", 9), ("s", 9)], "k string, at int")
    assert rows(history.held_at(spans, points, "k", "at"), "k", "at", "kind", "value") == sorted([("r", 0, None, None), ("r", 3, "CWE", "89"), ("r", 3, "URL", "u"), ("r", 9, "CWE", "89"), ("s", 9, None, None)], key=str)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("least", [(2, 3), (4, 5), (1, 2), (1, 1), (9, 10)])
def test_edit_join_finds_all_pairs(spark, least):
    r = random.Random(least[0])
    words = {"".join(r.choice("abé") for _ in range(r.randrange(0, 14))) for _ in range(110)} | {""}
    words |= {w[:k] + "x" + w[k + 1 :] for w in list(words)[:30] for k in [r.randrange(len(w) + 1)]}
    left, right = sorted(words)[::2], sorted(words)[1::2] + ["", "abab"]
    df = lambda ws, n: spark.createDataFrame([(w,) for w in [*ws, ws[0], None]], f"{n} string")
    num, den = least
    want = sorted((a, b, d) for a, b in itertools.product(set(left), set(right)) for d in [distance(a, b)] if d * den <= (den - num) * max(len(a), len(b)))
    assert rows(similarity.edit_join(df(left, "a"), "a", df(right, "b"), "b", least)) == sorted(want, key=str)


def test_edit_join_looks_at_few_pairs_and_refuses_nonsense(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(w,) for w in words], "a string")
    assert similarity.segment_candidates(df, "a", df.toDF("b"), "b", (4, 5)).count() < 400 * 400 // 50
    with pytest.raises(ValueError, match="similarity"):
        similarity.edit_join(df, "a", df.toDF("b"), "b", (0, 1))


def test_top_cosine_equals_the_full_ranking_and_scores_few(spark):
    r = random.Random(3)
    common = [f"w{k}" for k in range(12)]
    docs = [(k, [r.choice(common) for _ in range(40)] + [f"t{(k * 7 + j) % 90}" for j in range(8)]) for k in range(400)]
    items = [(1000 + k, [r.choice(common) for _ in range(30)] + [f"t{(k * 11 + j) % 90}" for j in range(8)]) for k in range(12)] + [(2000, ["nowhere"]), (2001, ["w1", "w2"])]
    made = {}
    for name, data in (("a", docs), ("b", items)):
        made[name] = features.term_counts(spark.createDataFrame(data, f"{name} long, tokens array<string>"), name, "tokens")
    idfs = features.idf(made["a"], len(docs))
    x, y = features.weights(made["a"], "a", idfs), features.weights(made["b"], "b", idfs)
    whole = features.tfidf_cosine(x, "a", y, "b").where("cosine <> 0")
    best = {}
    for b, a, c in sorted(((q["b"], q["a"], q["cosine"]) for q in whole.collect()), key=lambda t: (t[0], -round(t[2], 12), t[1])):
        if len(best.setdefault(b, [])) < 10:
            best[b].append((a, round(c, 9)))
    got = {}
    for q in similarity.top_cosine(x, "a", y, "b", 10).orderBy("b", "place").collect():
        got.setdefault(q["b"], []).append((q["a"], round(q["cosine"], 9)))
    assert got == best and 2000 not in got
    units = similarity._unit(x, "a", "x"), similarity._unit(y.where("b < 2000"), "b", "y")
    assert similarity.cosine_candidates(units[0], "a", units[1], "b", 10)[0].count() * 4 < whole.where("b < 2000").count()


def test_bisected_ranges_are_small_or_one_value(spark):
    r = random.Random(4)
    values = [int(r.paretovariate(0.6)) for _ in range(3000)] + [-50] * 700 + [10**12, 7] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "v long")
    out = selection.bisected(df, "v", 200, step=3).collect()
    for q in out:
        inside = sum(v is not None and q["low"] <= v <= q["high"] for v in values)
        assert q["n"] == inside and (inside <= 200 or q["low"] == q["high"])
    assert sum(q["n"] for q in out) == len(values) - 5
    assert rows(selection.bisected(df.where("v = -50"), "v", 10)) == [(-50, -50, 700)]
    assert selection.bisected(df.where("v is null"), "v", 10).count() == 0


def test_quantiles_by_refinement(spark):
    import numpy as np

    r = random.Random(9)
    data = {"skew": [r.paretovariate(0.3) for _ in range(4000)], "hot": [1.0] * 3000 + [2.0, -1e300, 1e300], "one": [5.5], "two": [1.0, 2.0], None: [float(k) for k in range(50)]}
    rows_ = [(g, v) for g, vs in data.items() for v in vs] + [("skew", None), ("none", None), ("two", float("nan"))]
    df = spark.createDataFrame(rows_, "g string, v double").repartition(6)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(q["g"], q["share"]): q["quantile"] for q in selection.exact_quantiles(df, ["g"], "v", shares, bins=16, few=20).collect()}
    assert got.keys() == {(g, s) for g in data for s in shares}
    for (g, s), v in got.items():
        assert v == pytest.approx(np.quantile(data[g], s), rel=1e-12)


def test_append_keeps_all_rows_of_a_new_key(spark, tmp_path):
    path, schema = str(tmp_path / "sink"), "k long, v string"
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (None, "n")], schema)
    files.append(first, path, "k")
    second = spark.createDataFrame([(1, "z"), (3, "d"), (3, "e")], schema)
    files.append(second, path, "k")
    assert rows(files.append(second, path, "k")) == sorted([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (None, "n"), (3, "d"), (3, "e")], key=str)


def test_of_several_rows_of_a_key_the_largest_stays(spark):
    t = spark.createDataFrame([("u", "a", 1), ("u", "b", 0), ("v", None, 3)], "k string, x string, y int")
    assert rows(files.one_row(t, "k")) == [("u", "b", 0), ("v", None, 3)]
    new = spark.createDataFrame([("u", "c", 5), ("u", "c", 4)], "k string, x string, y int")
    assert rows(files.upserted(t, new, "k")) == [("u", "c", 5), ("v", None, 3)]


def test_models_score_rows_with_missing_features(spark):
    r = random.Random(2)
    data = [(k, None if k % 4 == 0 else float(x), float("nan") if k % 9 == 0 else float(r.random()), int(x > 0.5)) for k in range(200) for x in [r.random()]]
    df = spark.createDataFrame(data, "id long, a double, b double, y int")
    out = models.cross_validated(df, "id", ["a", "b"], "y", folds=2)
    assert out.count() == 200 and out.where("score is null").count() == 0
    assert out.where("(score > 0.5) = (y = 1) AND a IS NOT NULL").count() > 140


def test_logistic_coefficients_equal_a_plain_fit(spark):
    """Newton steps on the balanced log-likelihood, as the scorer without regularisation should find."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.5, -1.0] + rng.logistic(size=300) > 0.8).astype(int)
    df = spark.createDataFrame([(int(k), float(a), float(b), int(t)) for k, ((a, b), t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y int")
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    design, w = np.column_stack([x, np.ones(300)]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w += np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design, design.T @ (weight * (y - p)))
    want = 1 / (1 + np.exp(-design @ w))
    got = {r["id"]: r["score"] for r in models.fit_predict(df, df, ["a", "b"], "y").collect()}
    assert max(abs(got[k] - want[k]) for k in range(300)) < 1e-3


def test_candidates_of_the_registered_ranking_are_few(spark):
    """Pairs scored for the ten best documents of each benchmark item, against all pairs that share a token."""
    from fixmine.queries.linking import _counts

    d = "/root/testdata/sf0.001"
    counts = _counts(spark, d, "documents", "doc_id")
    idfs = features.idf(counts, counts.select("doc_id").distinct().count())
    x = similarity._unit(features.weights(counts, "doc_id", idfs), "doc_id", "x").cache()
    y = similarity._unit(features.weights(_counts(spark, d, "benchmark", "item_id"), "item_id", idfs), "item_id", "y").cache()
    scored = similarity.cosine_candidates(x, "doc_id", y, "item_id", 10)[0].count()
    every = x.join(y, "token").select("doc_id", "item_id").distinct().count()
    print("scored", scored, "of", every)
    assert scored < every
    assert F is not None


def test_changed_functions_follow_headers_and_headings(spark):
    from fixmine.operators import diffs

    c = "--- a/x.c\n+++ b/x.c\n@@ -1,3 +1,5 @@\n int keep(int a) {\n+  a++;\n }\n+int fresh(int b) {\n+  return b; }\n@@ -20,4 +22,4 @@ static int far(int c)\n-  c--;\n+  c++;\n-int gone(void) {\n+int gone(int z) {\n   if (c) {\n@@ -60,1 +62,2 @@ nothing here\n x\n+y"
    py = "--- a/y.py\n+++ b/y.py\n@@ -1,2 +1,3 @@\n+x = 1\n def f(a):\n-    pass\n+    return\n@@ -9,1 +10,1 @@ def g(b):\n-old\n+new"
    lines = diffs.diff_lines(spark.createDataFrame([(1, c), (2, py), (3, None)], "k long, d string"), "k", "d")
    assert rows(diffs.changed_functions(lines, "k"), "k", "function", "change") == [(1, "fresh", "added"), (1, "gone", "modified"), (1, "keep", "modified"), (2, "f", "modified")]
