"""Column functions on URLs: recognisers, canonical keys, parts. A ladder of rules is one CASE, the last rule that may overwrite first."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What the recognisers reject or look for.
ARCHIVES = (".zip", ".gz", ".tgz", ".google.", ".msi", ".exe", ".tar", ".iso", ".sha256", ".asc", ".xz", ".atom", ".pdf")
COMMIT_HOSTS = ("gitlab.", "bitbucket.org", "pagure.io", "salsa.debian.org")
REJECTED_TRACKERS = ("bugzilla.mozilla.org/show_bug.cgi", "bugzilla.redhat.com/", "bugs.debian.org/", "bugzilla.suse.com/", "bugzilla.gnome.org/", "bugs.gentoo.org/")
ID = "[0-9a-f]{6,40}"
STRICT_ID = "(?![0-9]{6,40})(?![a-f]{6,40})[0-9a-f]{6,40}"


def _any(c: Column, parts) -> Column:
    return reduce(lambda x, y: x | y, (F.contains(c, F.lit(p)) for p in parts))


def commit_id(c: Column, strict: bool = False) -> Column:
    """First run of 6 to 40 hex digits that is not part of a longer word; strict: with the look-ahead rule, which may begin later."""
    if strict:
        return F.nullif(F.regexp_extract(c, STRICT_ID, 0), F.lit(""))
    return F.nullif(F.regexp_extract(c, "(?:^|[^0-9A-Za-z])([0-9a-f]{6,40})(?:[^0-9A-Za-z]|$)", 1), F.lit(""))


def svn_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "(?:rev=r?|revision=r?|/r)([0-9]+)", 1), F.lit(""))


def parts(c: Column) -> dict[str, Column]:
    """scheme, host, path and query of a URL; empty where missing."""
    return {
        "scheme": F.regexp_extract(c, "^([a-zA-Z]+)://", 1),
        "host": F.lower(F.regexp_extract(c, "^[a-zA-Z]+://([^/?#]+)", 1)),
        "path": F.regexp_extract(c, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1),
        "query": F.regexp_extract(c, "^[^?#]*[?]([^#]*)", 1),
    }


def canonical(c: Column) -> Column:
    """Without tag, fragment and closing markup."""
    return F.substring_index(F.substring_index(F.substring_index(c, "__fdse__", 1), "#", 1), "</", 1)


def owner_repo(c: Column) -> tuple[Column, Column, Column]:
    """(owner, repo, id) of a hosted repository's URL; empty where missing."""
    rule = "github[.]com/([^/?#]+)/([^/?#]+)(?:/(?:commit|pull|issues)/([^/?#]+))?"
    return F.regexp_extract(c, rule, 1), F.regexp_replace(F.regexp_extract(c, rule, 2), "[.]git$", ""), F.regexp_extract(c, rule, 3)


def patch_kind(c: Column) -> Column:
    """git_commit, svn or diff_file for the URL of a change, else null."""
    u = canonical(c)
    refused = ~u.rlike("^https?://") | _any(u, ARCHIVES) | F.contains(u, F.lit("bugs.debian.org")) | F.contains(u, F.lit("/blob/")) | F.contains(u, F.lit("://gist.")) | (F.contains(u, F.lit("github")) & ~F.contains(u, F.lit("commit")))
    has_id = u.rlike(ID)
    return F.when(refused, F.lit(None)).when(F.contains(u, F.lit("attachment")) & F.contains(u, F.lit("action=")), F.lit("diff_file")).when(u.rlike("[.](?:patch|diff)$"), F.lit("diff_file")).when(F.contains(u, F.lit("svn")) & u.rlike("rev=r?[0-9]|/r[0-9]|revision=r?[0-9]"), F.lit("svn")).when(has_id & u.rlike("/commits?/|[;?&]a=commit|/c/|h=[0-9a-f]{6}|changeset|/commit"), F.lit("git_commit"))


def issue_kind(c: Column) -> Column:
    """git_issue, git_pull_request, bugzilla, jira or other_issue_tracker, else null."""
    u = canonical(c)
    return F.when(~u.rlike("^https?://") | _any(u, REJECTED_TRACKERS), F.lit(None)).when(u.rlike("://(?:issues|bugs|tickets|tracker)[.][^/]+/.*[0-9]{2,}") & ~u.rlike("bugzilla|/browse/[A-Z]"), F.lit("other_issue_tracker")).when(u.rlike("/browse/[A-Z][A-Z0-9]+-[0-9]+"), F.lit("jira")).when(u.rlike("show_bug[.]cgi[?].*id=[0-9]{2,}|bugzilla[^/]*/[0-9]{2,}"), F.lit("bugzilla")).when(u.rlike("/pull/[0-9]+(?:/|$)"), F.lit("git_pull_request")).when(u.rlike("/issues/[0-9]+(?:/|$)"), F.lit("git_issue"))


def url_type(c: Column) -> Column:
    """patch_url, issue_url, common_github_url or common_url."""
    u = canonical(c)
    return F.when(patch_kind(c).isNotNull(), F.lit("patch_url")).when(issue_kind(c).isNotNull(), F.lit("issue_url")).when(u.rlike("://github[.]com/[^/]+/[^/]+"), F.lit("common_github_url")).otherwise(F.lit("common_url"))


def issue_id(c: Column) -> Column:
    """Host and key of an issue, null for other URLs."""
    u = canonical(c)
    key = F.regexp_extract(u, "([A-Z][A-Z0-9]+-[0-9]+)", 1)
    number = F.regexp_extract(u, "(?:id=|/issues/|/pull/|/|=)([0-9]+)(?:[^0-9].*)?$", 1)
    return F.when(issue_kind(c).isNotNull(), F.concat(parts(u)["host"], F.lit("/"), F.when(key != "", key).otherwise(number)))


def patch_key(c: Column) -> Column:
    """git_<6 hex digits>, svn_<number>, or the URL as it is; the number of an issue is no commit."""
    u = canonical(c)
    issue = patch_kind(c).isNull() & issue_kind(c).isNotNull()
    key = F.regexp_extract(u, "(?:/commits?/|[;?&]id=|[;?&]h=|/c/|commit/[?]id=)([0-9a-f]{6})[0-9a-f]*", 1)
    revision = svn_id(u)
    return F.when(F.contains(u, F.lit("svn")) & revision.isNotNull(), F.concat(F.lit("svn_"), revision)).when((key != "") & ~issue, F.concat(F.lit("git_"), key)).otherwise(u)


def api_to_page(c: Column) -> Column:
    """Address of a page from its API's."""
    return F.replace(F.replace(F.replace(c, F.lit("api.github.com/repos"), F.lit("github.com")), F.lit("/commits/"), F.lit("/commit/")), F.lit("/pulls/"), F.lit("/pull/"))


#: The value of an attribute href in double, single or no quotes, in any case.
HREF = """(?i)[ \t\r\n]href[ \t\r\n]*=[ \t\r\n]*("[^"]*"|'[^']*'|[^ \t\r\n"'<>]+)"""
#: The same for a link, and what stands in it.
ANCHOR = """(?is)<a[ \t\r\n](?:[^<>]*[ \t\r\n])?href[ \t\r\n]*=[ \t\r\n]*("[^"]*"|'[^']*'|[^ \t\r\n"'<>]+)[^<>]*>(.*?)</a>"""


def _unquoted(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, """^["']|["']$""", ""), F.lit("&amp;"), F.lit("&"))


def hrefs(page: Column) -> Column:
    """Targets of links, in order, with ampersands decoded."""
    return F.transform(F.regexp_extract_all(page, F.lit(HREF)), _unquoted)


def anchors(page: Column) -> Column:
    """(href, text) of links, in order; tags inside a link are left out of its text and white space is one blank."""
    targets, texts = F.regexp_extract_all(page, F.lit(ANCHOR), F.lit(1)), F.regexp_extract_all(page, F.lit(ANCHOR), F.lit(2))
    bare = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), r"[ \t\r\n]+", " "))
    return F.zip_with(targets, texts, lambda h, t: F.struct(_unquoted(h).alias("href"), bare(t).alias("text")))


def _untagged(c: Column) -> Column:
    return F.element_at(F.split(c, "__fdse__"), 1)


def split_references(refs: Column, tags: Sequence[str] = ()) -> tuple[Column, Column]:
    """(URLs with one of the tags, the others) of references written as ``url__fdse__tag``, without their tags."""
    tagged = lambda x: F.exists(F.split(x, "__fdse__"), lambda t: t.isin(list(tags)))
    return F.transform(F.filter(refs, tagged), _untagged), F.transform(F.filter(refs, lambda x: ~tagged(x)), _untagged)


def unquote_twice(c: Column) -> Column:
    """Percent escapes decoded twice, then ampersands; a plus stays a plus, and what cannot be decoded stays."""
    for _ in range(2):
        c = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


@F.pandas_udf(StringType())
def resolve(base: pd.Series, target: pd.Series) -> pd.Series:
    """Absolute address of a link on a page."""
    from urllib.parse import urljoin

    return base.combine(target, lambda b, t: None if b is None or t is None else urljoin(b, t))
