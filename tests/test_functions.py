"""Column functions on known pairs and edge cases."""

import pytest
from pyspark.sql import functions as F

from fixmine.functions import strings, urls, values
from fixmine.operators import filters, parsing


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


ID = "5f0c2b7d9e1a4638c0de77b1f2a9d4e6835b1c0f"


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://code.mountain.example/changeset/40417", "http://code.mountain.example/changeset/40417"),
        (f"https://git.harbour.example/browse/libquay/commit/?id={ID}", "git_5f0c2b"),
        (f"https://gitlab.harbour.example/quay/libquay/commit/{ID}", "git_5f0c2b"),
        (f"https://anon.harbour.example/git/ferry/winch.git/commit?id={ID}", "git_5f0c2b"),
        (f"https://github.com/lantern/wick/commit/{ID}", "git_5f0c2b"),
        ("https://git-two.harbour.example/repos/x?p=keel.git;h=5f0c2b", "git_5f0c2b"),
        ("https://svn.harbour.example/viewvc?view=revision&revision=r204417", "svn_204417"),
        ("http://svn.harbour.example/viewvc?view=revision&revision=998877", "svn_998877"),
    ],
)
def test_patch_keys(spark, url, key):
    assert one(spark, url, urls.patch_key) == key


@pytest.mark.parametrize(
    ("url", "kind"),
    [
        ("https://github.com/lantern/wick/pull/12/commits", None),
        (f"https://gist.github.com/someone/{ID[:32]}", None),
        ("https://github.com/lantern/wick/issues/5f0c2b7d", None),
        ("https://pagure.io/keel-base/c/5f0c2b7d9", "git_commit"),
        ("https://svn.harbour.example/viewvc?view=rev&rev=204418", "svn"),
        ("https://bugzilla.harbour.example/attachment.cgi?id=3141&action=diff", "diff_file"),
        (f"https://github.com/lantern/wick/pull/77/commits/{ID}", "git_commit"),
        (f"https://bitbucket.org/ferry/winch/commits/{ID}", "git_commit"),
        ("https://example.org/files/release.tar.gz", None),
        (None, None),
    ],
)
def test_patch_kinds(spark, url, kind):
    assert one(spark, url, urls.patch_kind) == kind


@pytest.mark.parametrize(
    ("url", "issue"),
    [
        # hosts that are refused, which are fixed values
        ("https://bugs.debian.org/cgi-bin/bugreport.cgi?bug=40417", None),
        ("https://bugzilla.mozilla.org/show_bug.cgi?id=40417", None),
        ("https://bugzilla.redhat.com/show_bug.cgi?id=40417", None),
        ("https://bugzilla.suse.com/show_bug.cgi?id=40417", None),
        ("https://bugzilla.gnome.org/show_bug.cgi?id=40417", None),
        ("https://bugs.gentoo.org/40417", None),
        ("https://bugzilla.harbour.example/show_bug.cgi?id=40417", "bugzilla.harbour.example/40417"),
        ("https://issues.harbour.example/jira/browse/KEEL-1409", "issues.harbour.example/KEEL-1409"),
        ("https://projects.harbour.example/issues/13511", "projects.harbour.example/13511"),
        ("https://bugs.harbour.example/bugs/show_bug.cgi?id=535670&login=1", "bugs.harbour.example/535670"),
    ],
)
def test_issue_ids(spark, url, issue):
    assert one(spark, url, urls.issue_id) == issue


def test_noise_words_and_letters_of_any_script(spark):
    letters = lambda x: one(spark, x, strings.letters_only)
    assert letters("JavaScript-Plugin Größe 42 漢") == "größe漢"
    assert letters("pythonic rubygem") == "icgem"
    pair = spark.createDataFrame([("Été plugin", "été-2"), ("linux kernel", "kernel"), ("php lib", "php")], "a string, b string")
    assert [r["y"] for r in pair.select(strings.word_overlap(F.col("a"), F.col("b")).alias("y")).collect()] == [1, 1, 1]
    assert one(spark, "C:/x.mjs", lambda c: filters.changes_code(F.array(c))) is True
    assert one(spark, "main.rs", lambda c: filters.changes_code(F.array(c))) is False


def test_links_with_any_quotes(spark):
    page = """<a href="/a?x&amp;y">One <i>and</i>\n two</a><A HREF='/b'>b</A><link href=/c.css><a class="href=no" href=/d>d</a> data-href=x <a hrefs="n">no</a>"""
    assert one(spark, page, urls.hrefs) == ["/a?x&y", "/b", "/c.css", "/d"]
    assert [tuple(x) for x in one(spark, page, urls.anchors)] == [("/a?x&y", "One and two"), ("/b", "b"), ("/d", "d")]


def test_strict_commit_id_shifts_and_the_default_does_not(spark):
    url = "https://github.com/lantern/wick/commit/581244cab7d9e1a4638c0de77b1f2a9d4e6835b1"
    assert one(spark, url, lambda c: urls.commit_id(c, strict=True)).startswith("81244c")
    assert one(spark, url, urls.commit_id).startswith("581244")


def test_similarities(spark):
    rows = [("elastic/kibana", "elastic:kibana"), ("chaitin/xray", "elastic:kibana"), ("", ""), ("jacksondatabind", "databindcore"), (None, "x"), ("MARTHA", "MARHTA")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    out = df.select(strings.word_overlap(a, b).alias("w"), strings.longest_common_substring(a, b).alias("l"), strings.edit_similarity(a, b).alias("e"), strings.jaro("a", "b").alias("j"), strings.jaro_winkler("a", "b").alias("k"), strings.indel_ratio("a", "b").alias("i")).collect()
    assert [r["w"] for r in out[:3]] == [1, 0, 1]
    assert out[3]["l"] == 8
    assert out[2]["e"] == 1.0
    assert out[4]["j"] is None
    assert out[5]["j"] == pytest.approx(0.944444, abs=1e-5)
    assert out[5]["k"] == pytest.approx(0.961111, abs=1e-5)


def test_identifiers(spark):
    assert one(spark, "parseXMLDocument2go_VSShape", strings.camel_tokens) == ["parse", "xml", "document", "2", "go", "vs", "shape"]
    assert one(spark, "", strings.camel_tokens) == []


def test_day_spans(spark):
    df = spark.sql("SELECT timestamp'2020-01-02 01:00:00' a, timestamp'2020-01-01 23:00:00' b, CAST(NULL AS timestamp) n")
    r = df.select(values.day_span(F.col("a"), F.col("b")).alias("x"), values.day_span(F.col("b"), F.col("a")).alias("y"), values.day_span(F.col("a"), F.col("n")).alias("z")).first()
    assert (r["x"], r["y"], r["z"]) == (0, -1, 0)
    for text in ("2020-05-06", "2020 05 06", "2020-05-06T00:00Z", "2020-05-06T00:00:00"):
        assert str(one(spark, text, values.parse_date)) == "2020-05-06 00:00:00"
    assert one(spark, "no date", values.parse_date) is None
    assert one(spark, "1:02:03", values.duration_seconds) == 3723


def test_vectors(spark):
    df = spark.sql("SELECT array(1.0D, 0.0D) a, array(0.0D, 0.0D) z, array(1.0D, 1.0D) b")
    r = df.select(values.cosine(F.col("a"), F.col("b")).alias("x"), values.cosine(F.col("a"), F.col("z")).alias("y"), values.cosine(F.col("z"), F.col("z")).alias("w"), F.size(values.pad(F.col("a"), 4, 0.0)).alias("n")).first()
    assert r["x"] == pytest.approx(0.70710678)
    assert (r["y"], r["w"], r["n"]) == (0.0, 1.0, 4)


def test_relation(spark):
    df = spark.sql("SELECT array('a', 'b') t, array('a') u, array('x') i, array('y') j, map('a', array('y'), 'b', array('z')) m")
    r = df.select(*(c.alias(n) for n, c in zip("pqr", values.relation(F.col("t"), F.col("u"), F.col("i"), F.col("j"), F.col("m")), strict=True))).first()
    # one equal pair, one related pair, three others
    assert (r["p"], r["q"], r["r"]) == (pytest.approx(1 / 6), pytest.approx(1 / 6), pytest.approx(4 / 6))


def test_pages_and_urls(spark):
    page = "<table><tr><th>Repo</th><th>n</th></tr><tr><td><b>a/b</b></td><td>1,234</td></tr></table>"
    assert one(spark, page, parsing.table_cells) == [["Repo", "n"], ["a/b", "1234"]]
    assert one(spark, "a%252Fb+c&amp;d", urls.unquote_twice) == "a/b+c&d"
    assert one(spark, "https://api.github.com/repos/a/b/commits/1", urls.api_to_page) == "https://github.com/a/b/commit/1"
    assert one(spark, "fixes #12, see # and x#7y", parsing.issue_numbers) == ["12", "7"]
