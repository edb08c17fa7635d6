"""Predicates that screen candidates, and set operations on id lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Suffixes of source code.
CODE = (
    "java", "py", "c", "cc", "cpp", "cxx", "c++", "js", "go", "rb", "cs", "as", "php", "pl", "coffee", "h", "m", "ts", "kt", "mjs", "twig", "htaccess", "tpl", "pt", "scala", "s", "erb",
    "swf", "asm", "groovy", "jsp", "sh", "hpp", "phps", "script", "wscript", "ldif", "Tokens", "nsi", "tcl", "idl", "pyx", "ps1", "toml", "inl", "x", "S", "hbs",
)


def suffix(path: Column) -> Column:
    return F.element_at(F.split(path, "[.]"), -1)


def changes_code(files: Column, code: Sequence[str] = CODE) -> Column:
    """Any file has a suffix of source code."""
    return F.exists(files, lambda f: suffix(f).isin(list(code)))


def changes_beyond_tests(files: Column) -> Column:
    """Any file is not a test's."""
    return F.exists(files, lambda f: ~F.contains(F.lower(f), F.lit("test")))


def changes_code_beyond_tests(files: Column, code: Sequence[str] = CODE) -> Column:
    """One and the same file is source code and not a test's."""
    return F.exists(files, lambda f: suffix(f).isin(list(code)) & ~F.contains(F.lower(f), F.lit("test")))


def confirmed_code_change(kind: Column, hosted: Column, files: Column, code: Sequence[str] = CODE) -> Column:
    """Whether a change passes: one that is no git change does; without files, one of the hub (``hosted``) does not and others do."""
    return F.when(kind != "git_commit", F.lit(True)).when(F.coalesce(F.size(files), F.lit(0)) <= 0, ~hosted).otherwise(changes_code_beyond_tests(files, code))


def is_diff(c: Column) -> Column:
    return F.contains(c, F.lit("---")) & F.contains(c, F.lit("+++")) & F.contains(c, F.lit("@@"))


def row_guard(cols: Column, at_least: int, most: Column | None = None, length: int = 1000) -> Column:
    """A record with enough columns and not too long a text."""
    ok = F.size(cols) >= at_least
    return ok if most is None else ok & (F.length(most) < length)


def no_more_than(df: DataFrame, group: str, n: int) -> DataFrame:
    """All rows of groups with at most n rows, none of the others."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(group))).where(F.col("_n") <= n).drop("_n")


def without_prefix(items: Column, prefix: str = "CVE-") -> Column:
    return F.filter(items, lambda x: ~x.startswith(prefix))


def screen(df: DataFrame, **rules: Column) -> DataFrame:
    """Add each rule as a boolean column and ``selected``, which needs them all; a missing value fails a rule."""
    out = df
    for name, rule in rules.items():
        out = out.withColumn(name, F.coalesce(rule, F.lit(False)))
    selected = F.lit(True)
    for name in rules:
        selected = selected & F.col(name)
    return out.withColumn("selected", selected)


def train_test(df: DataFrame, members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is among the members, the others); a missing key is in the second."""
    one = members.select(key).distinct()
    return df.join(one, key, "left_semi"), df.join(one, key, "left_anti")


def patch_rules(kind: Column, url: Column, reachable: Column, valid: Column, published: Column, changed: Column, similar: Column, code: Column, kinds: Sequence[str] = ("git_commit", "svn"), days: int = 730, least: float = 0.5) -> dict[str, Column]:
    """The rules that select changes, for ``screen``: each admits what it says nothing about.

    reachable: a path of the cut-off's length leads to it; valid: its page can be had; published, changed: times of the report and the
    change, either may be missing; similar: the highest similarity of its repository to a product; code: it changes code
    (which is asked of git changes only).
    """
    span = F.abs(F.floor((F.unix_timestamp(published) - F.unix_timestamp(changed)) / 86400))
    return {
        "of_kind": kind.isin(list(kinds)), "not_in_files": ~F.contains(url, F.lit("/files/")), "reachable": F.coalesce(reachable, F.lit(False)), "valid": F.coalesce(valid, F.lit(False)),
        "in_time": F.coalesce(span <= days, F.lit(True)) | (kind != "git_commit"), "of_product": F.coalesce(similar >= least, ~F.contains(url, F.lit("github."))) & ~F.contains(url, F.lit("gist")), "code": (kind != "git_commit") | F.coalesce(code, F.lit(False)),
    }


def todo(all_: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the done."""
    return all_.join(done.select(key).distinct(), key, "left_anti")


def pruned_children(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children (parent, id, owner, repo, number) of an issue kept in its own repository, or under a renamed owner with the same number.

    parents: id, owner, repo, number.
    """
    p = parents.select(F.col("id").alias("parent"), F.col("owner").alias("_o"), F.col("repo").alias("_r"), F.col("number").alias("_n"))
    same = (F.col("repo") == F.col("_r")) & ((F.col("owner") == F.col("_o")) | (F.col("number") == F.col("_n")))
    return children.join(p, "parent").where(same).drop("_o", "_r", "_n").dropDuplicates(["parent", "id"])


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): both, only_a or only_b."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both")
    return x.join(y, key, "full_outer").select(key, side.alias("side"))


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, missing): what one of two tables has and the other lacks, each once; missing: ``a`` or ``b``."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, list(keys), "left_anti").withColumn("missing", F.lit("b")).union(y.join(x, list(keys), "left_anti").withColumn("missing", F.lit("a")))


def kept_references(tags: Column) -> Column:
    """References that count: attachments, and those from a page's own content."""
    return F.exists(tags, lambda t: F.contains(t, F.lit("attachment")) | F.contains(t, F.lit("from html content")))
