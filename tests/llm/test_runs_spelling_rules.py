"""Periodic runs, spelling variants and quality rules against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from fixmine.llm import periodic, quality_rules, spelling
from tests.llm.test_operators import SPACE, corpus, frame, got, low


def plain_runs(words):
    """Every run by trying all periods at all places."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted((i, length, q) for (i, length), q in best.items())


def plain_collapse(words, runs):
    gone = {k for i, length, q in runs for k in range(i + q, i + length)}
    return [w for k, w in enumerate(words) if k not in gone]


def repetitive(r):
    words = []
    while len(words) < r.randrange(150):
        unit = [r.choice("abcAB") for _ in range(r.randrange(1, 9))]
        words += (unit * r.randrange(1, 9))[: r.randrange(1, 60)] + ([f"x{r.randrange(99)}"] if r.random() < 0.3 else [])
    return words


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_runs_equal_those_of_all_periods():
    r = random.Random(11)
    texts = [repetitive(r) for _ in range(400)] + [fibonacci(233), ["a"] * 300, list("ab") * 100 + list("aab") * 50, [], ["a"] * 11, ["a"] * 12, list("abcdef") * 2, list("abcdef") * 2 + ["a", "z"]]
    known = {}
    ours = periodic.runs_of([[known.setdefault(w, len(known)) for w in t] for t in texts])
    assert ours == [plain_runs(t) for t in texts]
    assert any(len(x) > 3 for x in ours)


def test_z_function():
    r = random.Random(2)
    for _ in range(200):
        s = [r.randrange(2) for _ in range(r.randrange(1, 40))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periodic.z_function(s)[1:] == want[1:]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not words:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def run_row(doc_id, text):
    words = planted(doc_id, SPACE.findall(text or ""))
    runs = plain_runs(words) if len(words) < 3000 else None
    if runs is None:  # texts of one word, or without a repeat
        runs = [(0, len(words), 1)] if len(set(words)) == 1 else []
    top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{i},{n},{q}\n" for i, n, q in runs)), sha(" ".join(plain_collapse(words, runs))))


def test_run_report(spark):
    r = random.Random(4)
    rows = [(i, t) for i, t in corpus() if len(t or "") < 100_000 or len(set(t.split())) == 1]
    rows += [(1000 + k, " ".join(repetitive(r))) for k in range(60)] + [(None, "a b " * 20), (1000, "\x85no break " * 13), (2000, "one " * 40 + "\n\x0btwo"), (2000, "one " * 40 + "\n\x0btwo")]
    rows += [(3000 + k, " ".join(f"w{r.randrange(50)}" for _ in range(200))) for k in range(30)]
    ours = periodic.run_report(periodic.with_planted_runs(frame(spark, rows)))
    assert ours.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got(ours, *ours.columns) == sorted((run_row(*x) for x in rows), key=str)
    assert periodic.run_report(periodic.with_planted_runs(frame(spark, []))).count() == 0


def test_a_very_long_text_takes_linear_time(spark):
    words = [f"w{k % 7}" for k in range(200_000)] + [f"v{k}" for k in range(100_000)] + ["z"] * 100_000
    row = periodic.periodic_runs(frame(spark, [(1, " ".join(words))])).first()
    assert [tuple(x) for x in row["runs"]] == [(0, 200_000, 7), (300_000, 100_000, 1)]
    assert row["n_words"] == 400_000 and row["collapsed"].count(" ") == 7 + 100_000


def test_collapse_keeps_other_columns_and_texts(spark):
    rows = [(1, "keep  my\twhite space"), (2, "again and " * 9 + "end"), (3, None), (4, "")]
    df = frame(spark, rows)
    out = periodic.collapse_runs(df)
    assert out.schema == df.schema
    assert got(out, "doc_id", "text", "bitmap", "fresh") == [(1, rows[0][1], "b", 1), (2, "again and end", "b", 1), (3, None, "b", 1), (4, "", "b", 1)]


def edit_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(n):
    near = {w: [v for v in n if edit_one(w, v)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=str)


VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_of_words_that_are_many_edits_apart_and_near(spark):
    r = random.Random(8)
    n = {}
    for _ in range(60):
        word = "".join(r.choice("abcdeéÿ×") for _ in range(r.randrange(6, 12)))
        n[word] = r.randrange(5, 4000)
        for _ in range(12):  # chains of edits, with less weight each
            k = r.randrange(len(word))
            word = r.choice([word[:k] + word[k + 1 :], word[:k] + r.choice("abcdeéÿ×") + word[k:], word[:k] + r.choice("abcdeéÿ×") + word[k + 1 :], word])
            if len(word) >= 6:
                n.setdefault(word, r.choice([5, 5, 25, 125, 625, 3125]))
    ours = spelling.group_variants(spark.createDataFrame([*n.items(), (None, 7)], "word string, n long").repartition(5))
    assert got(ours, *VARIANT) == plain_variants(n)
    assert sum(x[1] is not None and x[1] != x[2] for x in plain_variants(n)) > 3
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_one_edit_leaves_a_pair_of_bands_alone():
    pairs = spelling.band_pairs()
    assert len(pairs) == 9 and all(a & b == 0 for a, b in pairs)
    for i in range(spelling.BITS):
        for j in range(i + 1):
            assert any(((1 << i) ^ (1 << j) if i != j else 1 << i) & (a | b) == 0 for a, b in pairs)


def test_planted_errors_and_counts(spark):
    rows = corpus() + [(k, "Überraschung strasse Straße strase strassen STRASSE naïveté " * 9) for k in range(200, 260)] + [(None, "strasse strasse"), (200, "strasse")]
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = low(w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    want = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    counts = spelling.word_counts(spelling.with_planted_errors(spelling.letter_runs(frame(spark, rows))))
    assert dict(map(tuple, counts.collect())) == want
    assert got(spelling.group_variants(counts), *VARIANT) == plain_variants(want)
    assert spelling.spelling_groups(frame(spark, [])).count() == 0


def rule_row(doc_id, text):
    text = text or ""
    words, seen, dups = SPACE.findall(text), set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dups += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(again), len(words) < 50 or 100 * len(again) > 50 * len(words)


RULE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rule_numbers(spark):
    r = random.Random(6)
    rows = [*corpus(), (None, "a b"), (None, None), (5, "#x *y $ % & | < > 𝒜𝒷 é\n\n\n \t\n#x *y\n#x *y"), (6, "to be or not to be or not"), (7, "a a a a"), (7, "a a a a")]
    rows += [(300 + k, "".join(r.choice("aab  \n.") for _ in range(r.randrange(400)))) for k in range(40)]
    ours = quality_rules.rule_report(frame(spark, rows))
    assert got(ours, *RULE) == sorted((rule_row(*x) for x in rows), key=str)
    assert all(not (x["kept"] and x["base_failed"]) and x["kept"] == (x["failed_rules"] == "") for x in ours.collect())
    assert quality_rules.rule_report(frame(spark, [])).count() == 0


def test_hash_collisions_do_not_count(spark):
    """With all windows alike in hash, the words decide."""
    docs = frame(spark, [(1, "a b c d a b c e")])
    real = quality_rules.F.expr
    try:
        quality_rules.F.expr = lambda s: real(s.replace("xxhash64(w, get(_words, i + 1), get(_words, i + 2))", "0L"))
        assert quality_rules.measures(docs).first()["n_repeat_words"] == 6
    finally:
        quality_rules.F.expr = real


PROSE = "The sailors of the harbour mended their nets and waited for a wind that would carry them to the northern banks. "


@pytest.mark.parametrize(
    "text, rules",
    [
        (" ".join(f"{PROSE}{k}" for k in range(5)), "repeats"),
        (" ".join(f"word{k} item{k}{k % 2 * '!'} of the" for k in range(40)), ""),
        (" ".join(f"word{k}!! of to the{k}!!" for k in range(40)), "marks"),
        (" ".join(f"word{k}### of the x{k}" for k in range(40)), "symbols"),
        (" ".join(f"zug{k} prt{k}" for k in range(40)), "stop_words"),
        ("\n".join(f"- the item{k} of word{k} in" for k in range(40)), "bullet_lines"),
        ("\n".join(f"the item{k} of word{k}..." for k in range(40)), "ellipsis_lines"),
        (" ".join(f"the averyveryverylongwordindeedandmore{k} of averyveryverylongerwordindeed{k}" for k in range(40)), "word_length"),
    ],
)
def test_each_rule(spark, text, rules):
    docs = frame(spark, [(1, text)])
    assert quality_rules.judged(docs).first()["failed_rules"] == rules
    out = quality_rules.accepted(docs)
    assert out.schema == docs.schema and out.count() == (rules == "")


def test_table_of_thresholds_can_be_replaced(spark):
    docs = frame(spark, [(1, "one two"), (2, "one"), (3, None)])
    rule = quality_rules.Rule("two", "n_words", "one", 1, least=2)
    assert got(quality_rules.judged(docs, (rule,), ()), "doc_id", "kept", "failed_rules") == [(1, True, ""), (2, False, "two"), (3, False, "two")]


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_quality_rules"])
def test_queries_against_sql(spark, name):
    from fixmine.llm.registry import ORACLES, QUERIES
    from tests.compare import connect, plain

    folder = "/root/testdata/sf0.001"
    ours, theirs = plain(QUERIES[name](spark, folder).toPandas()), plain(connect(folder).execute(ORACLES[name]).df())
    assert ours.equals(theirs)


def test_labelled_documents_are_judged_rightly(spark):
    folder = "/root/testdata/sf0.01"
    judged = quality_rules.rule_report(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("n_words >= 50")
    share = {r["quality"]: r["kept"] / r["n"] for r in judged.groupBy("quality").agg({"*": "count", "kept": "max"}).select("quality").join(judged.groupBy("quality").agg(quality_rules.F.count("*").alias("n"), quality_rules.F.sum(quality_rules.F.col("kept").cast("int")).alias("kept")), "quality").collect()}
    assert share[1] > 0.98 and share[0] < 0.1
