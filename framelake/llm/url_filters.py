"""URL filters: host and path rules, and verdicts that reach every alias of a page.

Two URLs are aliases when a redirect or a canonical link joins them. The redirects that sites do as a
matter of course (to another scheme, without ``www.`` or ``m.``, without a tracking query, a fragment
or the last slash) are edges as well, from each URL to its bare address. Aliases form connected
components, found by distributed rounds; a block decision on any member holds for the whole component
unless a member is explicitly allowed. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.components import connected_components
from framelake.runtime import Scratch, join_lookup, staged

#: Rules of the registered query: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _behind_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.coalesce(_behind_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    rest = F.coalesce(_behind_scheme(url), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one; ``rules`` is a short list.

    A rule fits its host and every subdomain of it where the path starts with the rule's. Of rules
    of equal length an allowing one wins. The rule is shown as host and path together.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: F.coalesce(*[F.when(c, F.lit(v)) for c, v in zip(fits, values, strict=True)], F.lit(None).cast("string"))
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def match_rules(df: DataFrame, rules: DataFrame, key: str, host: str = "host", path: str = "path") -> DataFrame:
    """``(key, rule, verdict)`` for rows that a rule of a large rule table fits.

    ``rules`` has verdict, rule_host and rule_path. Every row looks up the suffixes of its host by
    an equal join and keeps the longest fitting path, so the list may be of any size; the host of a
    third of all rows spreads, as the key joins its suffixes.
    """
    labels = F.split(F.col(host), r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    seen = df.select(key, F.col(path).alias("_path"), F.explode(suffix).alias("rule_host"))
    fits = seen.join(rules, "rule_host").where(F.col("_path").startswith(F.col("rule_path")))
    best = F.struct(F.length(F.concat("rule_host", "rule_path")), F.col("verdict") == "allow", F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    return fits.groupBy(key).agg(F.max(best).alias("b")).select(key, "b.rule", "b.verdict")


def address(url: Column) -> Column:
    """The form of a URL under which trivial redirects meet: no scheme, www, fragment, tracking query, trailing slash."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")
    bare = F.regexp_replace(bare, r"([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[?&]+$", ""), r"([?&])&+", "$1")
    rest = _behind_scheme(bare)
    host = F.regexp_replace(host_of(bare), r"^(?:www|m)\.", "")
    return F.regexp_replace(F.concat(host, F.regexp_extract(rest, r"^[^/?#]*(.*)$", 1)), r"/+$", "")


def html_targets(url: Column, html: Column) -> Column:
    """Where a page says that it lives: its canonical link and its refresh address, made absolute."""
    attribute = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']?([^"'\s>]+)""", 1)
    link = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    meta = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    refresh = F.regexp_extract(meta, r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)""", 1)
    scheme = F.regexp_extract(url, r"^([^:/?#]*):", 1)

    def absolute(to: Column) -> Column:
        return (
            F.when(to.contains("://"), to)
            .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
            .when(to.startswith("/"), F.concat(scheme, F.lit("://"), host_of(url), to))
            .when(to != "", F.concat(scheme, F.lit("://"), host_of(url), F.regexp_replace(path_of(url), r"[^/]*$", ""), to))
        )

    return F.filter(F.array(absolute(attribute(link, "href")), absolute(refresh)), lambda x: x.isNotNull())


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """``(key, url, host, path, rule, verdict, by_alias)``, one row per page.

    A page's own rule decides it. Without one, it is blocked if an alias of it is blocked by a rule
    and no alias is explicitly allowed; else allowed. ``redirects`` (src, dst) adds known redirects
    to the canonical links and refreshes found in ``html``.

    A null url or one without ``://`` has an empty host and path, fits no rule and has no alias.
    Repeated addresses are one node however many pages have them; links to pages outside the table
    count, as their address may fit a rule. No pages: no rows. Other columns are not read.
    """
    u = F.col(url)
    judged = pages.select(F.col(key), u.alias("url"), host_of(u).alias("host"), path_of(u).alias("path"), *([html_targets(u, F.col(html)).alias("to")] if html else []))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = staged(judged.withColumns({"rule": rule, "ruled": verdict}))
    named = judged.where("host <> ''")
    with Scratch(pages.sparkSession) as scratch:
        links = pages.sparkSession.createDataFrame([], "src string, dst string")
        if html:
            links = links.union(named.where("size(to) > 0").select("url", F.explode("to")))
        if redirects is not None:
            links = links.union(redirects.select("src", "dst"))
        links = scratch.staged(links.where((host_of(F.col("src")) != "") & (host_of(F.col("dst")) != "")))
        ends = links.select(F.explode(F.array("src", "dst")).alias("url"))
        ends = ends.select("url", rule_columns(host_of(F.col("url")), path_of(F.col("url")), rules)[1].alias("ruled"))
        seen = named.select("url", "ruled").union(ends)
        nodes = scratch.staged(seen.groupBy("url").agg(F.max(F.col("ruled") == "allow").alias("allowed"), F.max(F.col("ruled") == "block").alias("blocked")))
        bare = nodes.select(F.col("url").alias("src"), F.concat(F.lit("address "), address(F.col("url"))).alias("dst"))
        parts = scratch.staged(connected_components(links.union(bare)))
        whole = nodes.join(parts.withColumnRenamed("node", "url"), "url")
        blocked = whole.groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked")).where("blocked and not coalesce(allowed, false)")
        # only URLs without a rule ask their aliases
        decided = whole.where("allowed is null and blocked is null").join(blocked.select("component"), "component", "left_semi")
        decided = staged(decided.select("url", F.lit(True).alias("by_alias")))
    out = join_lookup(judged, decided, ["url"]).withColumn("by_alias", F.coalesce("by_alias", F.lit(False)))
    return out.select(key, "url", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("by_alias"), "block").otherwise("allow")).alias("verdict"), "by_alias")
