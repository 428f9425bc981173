"""URL filters by redirect equivalence.

Pages that redirect to one another or name one another as canonical are one page
under several addresses.  Addresses are first put in a normal form (a function, so it
needs no join): lower-case scheme and host, https, no default port, no leading www. or
m., no fragment, no trailing slash, query parameters sorted and without those that only
track.  Declared canonical links, meta refreshes and a table of redirects are edges
between normal forms; connected components over them are the equivalence classes.

A block rule that matches any address of a class blocks all its aliases.  An allow rule
takes precedence, but speaks only for the addresses that it matches: such an address
is allowed whatever blocks it or its aliases, and passes no block on.  Rules are rows
(kind, value): host matches a host and its subdomains, prefix an address that starts
with it up to a path boundary, url one address.  All are joined by equality, after
listing an address's host suffixes and path prefixes.

Defined cases.  A null or blank address belongs to no class and is kept; one that isn't
http(s) is its own normal form, trimmed.  Null html declares nothing.  Null or blank
rules and edge ends are dropped, repeated ones count once.  Several rows with one address
get the same decision.  Columns of the input called form, class, decision or reason are replaced.  With no edges every normal form is its own class.  Empty tables are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm._components import components
from quarrystone.llm._text import named

TRACKING = "^(utm_[^=]*|ref|ref_src|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid)(=|$)"
_PARTS = r"^[Hh][Tt][Tt][Pp][Ss]?://([^/?#]*)([^?#]*)([?][^#]*)?"
_CANONICAL = r"(<[Ll][Ii][Nn][Kk]\s[^>]*[Rr][Ee][Ll]\s*=\s*[\"']?[Cc][Aa][Nn][Oo][Nn][Ii][Cc][Aa][Ll][\"'\s/>][^>]*>?)"
_HREF = r"[Hh][Rr][Ee][Ff]\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"<[Mm][Ee][Tt][Aa]\s[^>]*[Hh][Tt][Tt][Pp]-[Ee][Qq][Uu][Ii][Vv]\s*=\s*[\"']?[Rr][Ee][Ff][Rr][Ee][Ss][Hh][\"']?[^>]*[Uu][Rr][Ll]\s*=\s*[\"']?([^\"'>\s]+)"
BLOCKED = (("host", "spam-farm.example.org"), ("host", "cheap-pills.example.com"), ("host", "adult-x.example.com"))
ALLOWED = (("prefix", "https://cheap-pills.example.com/de"),)


def normal_form(url: Column) -> Column:
    """The normal form of an address; null if it is null or blank."""
    u = F.trim(url)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, _PARTS, 1)), ":(80|443)?$", ""), "^(www|m)[.]", "")
    path = F.regexp_replace(F.regexp_extract(u, _PARTS, 2), "/+$", "")
    query = F.split(F.substring(F.regexp_extract(u, _PARTS, 3), 2, 1 << 30), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    full = F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(u == "", None).when(u.rlike(_PARTS), full).otherwise(u)


def resolve(base: Column, link: Column) -> Column:
    """The absolute address of a link found on page ``base``; null for an empty one."""
    site = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z]+://[^?#]*/)[^/?#]*", 1)
    folder = F.when(F.length(folder) > F.length(site), folder).otherwise(F.concat(site, F.lit("/")))
    return (
        F.when((link == "") | link.isNull(), None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(folder, link))
    )


def declared_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): normal forms joined by a page's canonical link or meta refresh."""
    url, html = F.col(url_col), F.col(html_col)
    canonical = F.regexp_extract(F.regexp_extract(html, _CANONICAL, 1), _HREF, 1)
    links = F.array(canonical, F.regexp_extract(html, _REFRESH, 1))
    rows = pages.where(html.rlike("[Cc][Aa][Nn][Oo][Nn][Ii][Cc][Aa][Ll]|[Rr][Ee][Ff][Rr][Ee][Ss][Hh]")).select(url.alias("u"), F.explode(links).alias("l"))
    return rows.select(normal_form(F.col("u")).alias("a"), normal_form(resolve(F.trim("u"), F.col("l"))).alias("b")).where("a is not null and b is not null and a <> b")


def _host_keys(form: Column) -> Column:
    host = F.split(F.regexp_extract(form, _PARTS, 1), "[.]")
    n = F.size(host)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host "), F.array_join(F.slice(host, i, n), ".")))


def _prefix_keys(form: Column) -> Column:
    """The address without its query, and every shorter one down to the bare host."""
    steps = F.split(F.regexp_replace(form, "[?].*$", ""), "/")
    n = F.size(steps)
    return F.transform(F.sequence(F.lit(3), F.greatest(n, F.lit(3))), lambda i: F.concat(F.lit("prefix "), F.array_join(F.slice(steps, 1, i), "/")))


def matches(forms: DataFrame, rules: DataFrame) -> DataFrame:
    """The normal forms (column form, distinct) that a rule (kind, value) matches."""
    value = F.trim("value")
    by_host = F.regexp_replace(F.lower(value), "^(www|m)[.]", "")
    keys = rules.where((value != "") & F.col("kind").isin("host", "prefix", "url")).select(F.concat_ws(" ", "kind", F.when(F.col("kind") == "host", by_host).otherwise(normal_form(value))).alias("key")).distinct()
    listed = forms.select("form", F.explode(F.concat(_host_keys(F.col("form")), _prefix_keys(F.col("form")), F.array(F.concat(F.lit("url "), F.col("form"))))).alias("key"))
    return listed.join(keys, "key", "left_semi").select("form").distinct()


def filter_urls(pages: DataFrame, blocked: DataFrame, allowed: DataFrame, redirects: DataFrame | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its html, plus form, class, decision (allow, block, keep) and reason."""
    edges = declared_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(normal_form(F.col("source")).alias("a"), normal_form(F.col("target")).alias("b")))
    groups = components(edges)
    added = {html_col.lower(), "form", "class", "decision", "reason"}
    rest = [named(c) for c in pages.columns if c.lower() not in added]
    rows = pages.select(*rest, normal_form(F.col(url_col)).alias("form"))
    ends = groups.select(F.col("node").alias("form"))
    forms = rows.select("form").where("form is not null").unionByName(ends).distinct()
    marked = (
        forms.join(groups.withColumnRenamed("node", "form"), "form", "left")
        .join(matches(forms, allowed).withColumn("is_allowed", F.lit(True)), "form", "left")
        .join(matches(forms, blocked).withColumn("is_blocked", F.lit(True)), "form", "left")
        .select("form", F.coalesce("component", "form").alias("class"), F.col("is_allowed").isNotNull().alias("is_allowed"), F.col("is_blocked").isNotNull().alias("is_blocked"))
    )
    bad = marked.where("is_blocked and not is_allowed").select("class").distinct().withColumn("class_blocked", F.lit(True))
    reason = F.when(F.col("is_allowed"), "allow rule").when(F.col("is_blocked"), "block rule").when(F.col("class_blocked"), "alias of blocked").otherwise("none")
    known = marked.join(bad, "class", "left").select("form", "class", reason.alias("reason"))
    found = rows.join(known, "form", "left").withColumn("reason", F.coalesce("reason", F.lit("none")))
    decision = F.when(F.col("reason") == "allow rule", "allow").when(F.col("reason") == "none", "keep").otherwise("block")
    return found.select(*rest, "form", "class", decision.alias("decision"), "reason")


def rule_table(spark, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    return spark.createDataFrame(list(rules), "kind string, value string")
