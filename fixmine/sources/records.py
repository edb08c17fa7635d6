"""Shaping of fetched records: vendor components, truth tables, nested lists, crawl verdicts, vulnerability records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a truth table by position.
TRUTH = ("n", "entity", "svn", "other_git", "github", "equivalent", "branch", "external_repo", "pull", "pull_status", "note", "kind", "extra")
#: Hosts that never hold changes.
BLACKLIST = ("rhn.redhat.com/errata", "redhat.com/support", "securityfocus.com/bid", "osvdb.org/", "exchange.xforce.ibmcloud.com", "bugzilla.novell.com/", "linkedin.com/", "fb.com/")


def nested_lists(df: DataFrame, lists: str) -> DataFrame:
    """(language, owner, repo, entity) of nested lists of language, ``owner##repo`` names and ids."""
    inner = df.select(F.explode(lists).alias("l")).select("l.language", F.explode("l.repos").alias("r"))
    name = F.split("r.name", "##")
    return inner.select("language", name[0].alias("owner"), name[1].alias("repo"), F.explode("r.ids").alias("entity"))


def vendor_versions(df: DataFrame, components: str) -> DataFrame:
    """(component, range, fix_version, fix_date, patch, instance) of vendor components; missing lists give one row."""
    v = df.select(F.explode(components).alias("c")).select(F.col("c.component_name").alias("component"), F.explode_outer("c.versions").alias("v"))
    return v.select("component", F.col("v.version_range").alias("range"), "v.fix_version", "v.fix_date", "v.patch", F.explode_outer("v.instances").alias("instance"))


def with_detail(df: DataFrame, key: str, components: str, detail: DataFrame) -> DataFrame:
    """``vendor_versions`` with the key; a record without components takes those of its detail page (key, components)."""
    d = detail.select(key, F.col(components).alias("_d"))
    chosen = df.join(d, key, "left").select(key, F.coalesce(F.when(F.size(components) > 0, F.col(components)), "_d").alias(components))
    v = chosen.select(key, F.explode(components).alias("c")).select(key, F.col("c.component_name").alias("component"), F.explode_outer("c.versions").alias("v"))
    return v.select(key, "component", F.col("v.version_range").alias("range"), "v.patch")


#: Where vendors keep the fields of a component, a range of versions and an instance; the first that is there counts.
COMPONENT_PATHS = {
    "components": ("$.artifactComponents", "$.components", "$.data.components"),
    "kind": ("$.componentCoordinateType", "$.type"),
    "one": ("$.coordOne", "$.group", "$.name"),
    "two": ("$.coordTwo", "$.artifact"),
    "versions": ("$.versionRanges", "$.versions"),
    "range": ("$.versionRange", "$.version_range", "$.affected"),
    "fix_version": ("$.updateToVersion", "$.fix_version"),
    "fix_date": ("$.fixDate", "$.fix_date"),
    "patch": ("$.patch", "$.patch.url", "$.fix.commit"),
    "instances": ("$.componentInstances", "$.instances"),
    "instance": ("$.componentInstanceHash", "$.hash", "$"),
}


def field(record: Column, paths: Sequence[str], kind: str = "string") -> Column:
    """The first of the paths at which a variant has a value of that kind; null if none has. Records of any shape are in one column."""
    found = [F.try_variant_get(record, p, kind) for p in paths]
    # a text is no object or list that is written out
    return F.coalesce(*(F.when(~F.startswith(f, F.lit("{")) & ~F.startswith(f, F.lit("[")), f) for f in found)) if kind == "string" else F.coalesce(*found)


def variant_versions(df: DataFrame, key: str, json: str, detail: DataFrame | None = None, paths: dict[str, Sequence[str]] = COMPONENT_PATHS) -> DataFrame:
    """(key, component, range, fix_version, fix_date, patch, instances) of vendor records given as JSON text of differing shapes.

    component: kind and names that are not blank, lower-cased, joined by colons. A record without components takes those of its detail
    page (key, json). A component without versions has a row of nulls; text that is no JSON and records without components have no row.
    """
    at = lambda v, name, kind="string": field(F.col(v), paths[name], kind)
    rows = df.select(key, at_record(F.col(json), paths["components"]).alias("_c"))
    if detail is not None:
        more = detail.select(key, at_record(F.col(json), paths["components"]).alias("_d"))
        rows = rows.join(more, key, "left").select(key, F.coalesce(F.when(F.size("_c") > 0, F.col("_c")), "_d").alias("_c"))
    each = rows.select(key, F.explode("_c").alias("_c"))
    names = F.filter(F.array(at("_c", "kind"), at("_c", "one"), at("_c", "two")), lambda n: F.trim(n) != "")
    named = each.select(key, F.lower(F.array_join(names, ":")).alias("component"), F.explode_outer(at("_c", "versions", "array<variant>")).alias("_v"))
    hashes = F.transform(at("_v", "instances", "array<variant>"), lambda i: field(i, paths["instance"]))
    return named.select(key, "component", at("_v", "range").alias("range"), at("_v", "fix_version").alias("fix_version"), at("_v", "fix_date").alias("fix_date"), at("_v", "patch").alias("patch"), hashes.alias("instances"))


def at_record(json: Column, paths: Sequence[str]) -> Column:
    """The list of variants at the first of the paths of a JSON text that has one; null for other text."""
    return field(F.try_parse_json(json), paths, "array<variant>")


def last_written(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """The values of each key that were written last."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v")).select(*keys, "v.*")


def verdict(status: Column, remaining: Column) -> Column:
    """What a crawler does after an answer (status below 400) or a refusal; a null status is a timeout.

    done: the answer is there. wait: so it is, or it was refused, and no requests remain until the limit is reset. pass: there
    is nothing to be had. stop: the credentials have expired. all wait: everyone pauses. retry: ask again.
    """
    spent = F.coalesce(remaining, F.lit(0)) <= 0
    refused = F.when(status.isin(400, 404, 410, 422), "pass").when((status == 403) & spent, "wait").when(status == 401, "stop").otherwise("all wait")
    return F.when(status.isNull(), "retry").when(status < 400, F.when(spent, "wait").otherwise("done")).otherwise(refused)


def fetchable(url: Column, size: Column, most: int = 1 << 20) -> Column:
    """Not on a blacklisted host and not too large; an unknown size is allowed."""
    bad = F.lit(False)
    for host in BLACKLIST:
        bad = bad | F.contains(F.lower(url), F.lit(host))
    return ~bad & (F.coalesce(size, F.lit(0)) <= most)


def commits_of(pulls: DataFrame, key: str, commits: str) -> DataFrame:
    """(key, fields of a change) of the changes of pull requests or issues; one without has a row of nulls."""
    return pulls.select(key, F.explode_outer(commits).alias("_c")).select(key, "_c.*")


def looked_up(wanted: DataFrame, commits: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """``wanted`` with values of the change that has the key (the least of several), null where there is none, and ``valid``."""
    one = commits.groupBy(key).agg(F.min(F.struct(*values)).alias("_v")).select(key, "_v.*", F.lit(True).alias("valid"))
    return wanted.join(one, key, "left").na.fill(False, ["valid"])


def between_tags(log: DataFrame, group: Sequence[str], order: Sequence[Column | str], before: Column, last: Column) -> DataFrame:
    """Rows of each log after the last that is tagged ``before`` (or from the start) up to the last that is tagged ``last``; none without that."""
    nth = log.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).withColumn("_b", before).withColumn("_l", last)
    ends = nth.groupBy(*group).agg(F.max(F.when(F.col("_b"), F.col("_n"))).alias("_low"), F.max(F.when(F.col("_l"), F.col("_n"))).alias("_high"))
    return nth.join(ends, list(group)).where((F.col("_n") > F.coalesce("_low", F.lit(0))) & (F.col("_n") <= F.col("_high"))).select(*log.columns)


def truth_links(df: DataFrame, uncertain: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(entity, branch, url) of a positional truth table, without uncertain entities; the branch ends before a bracket or blank."""
    named = df.toDF(*TRUTH[: len(df.columns)])
    sure = named.join(uncertain.select("entity"), "entity", "left_anti")
    links = F.filter(F.flatten(F.transform(F.array("svn", "other_git", "github"), lambda c: F.split(F.coalesce(c, F.lit("")), r"[\s,;]+"))), lambda u: u != "")
    return sure.select(*keep, "entity", F.regexp_extract(F.coalesce("branch", F.lit("")), "^([^( ]*)", 1).alias("branch"), F.explode(links).alias("url"))


def page_title(page: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(page, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def vulnerability_record(json: Column) -> Column:
    """A flat record of a vulnerability's JSON text: weakness names, product names and the scores of both versions, or null."""
    pick = lambda p: F.get_json_object(json, p)
    kinds = F.from_json(pick("$.cve.problemtype.problemtype_data"), "array<struct<description:array<struct<value:string>>>>")
    weaknesses = F.coalesce(F.flatten(F.transform(kinds, lambda k: F.transform(k["description"], lambda d: F.coalesce(d["value"], F.lit(""))))), F.array().cast("array<string>"))
    return F.struct(
        pick("$.cve.CVE_data_meta.ID").alias("id"),
        F.array_distinct(F.filter(weaknesses, lambda x: x != "")).alias("cwes"),
        F.array_distinct(F.regexp_extract_all(json, F.lit('"cpe23Uri" ?: ?"([^"]+)"'))).alias("cpes"),
        pick("$.impact.baseMetricV2.cvssV2.baseScore").cast("double").alias("score2"),
        pick("$.impact.baseMetricV2.cvssV2.vectorString").alias("vector2"),
        pick("$.impact.baseMetricV3.cvssV3.baseScore").cast("double").alias("score3"),
        pick("$.impact.baseMetricV3.cvssV3.vectorString").alias("vector3"),
    )


def commit_files(json: Column) -> Column:
    """Files of a change as an interface gives them: path, status, additions, deletions, patch."""
    return F.from_json(F.get_json_object(json, "$.files"), "array<struct<filename:string,status:string,additions:long,deletions:long,patch:string>>")
