"""URL filter with redirect equivalence.

A rule (action, host, path) fits its host and all subdomains of it where the url's path starts with the rule's
path; the longest rule (host and path together) wins, of equally long ones ``allow``. Few rules become one
expression; a table of rules of any size is met by equi-joins over the parent domains of a host and the
lengths of path that the rules of a domain have.

A url that no rule fits gets its verdict from its aliases: addresses tied to it by redirects, directly or by steps.
Links come from the pages (``<link rel="canonical">`` and ``<meta http-equiv="refresh">``) and from a table
of redirects, if given. Connected components over these links carry the rules' decisions: an alias that a rule
explicitly allows goes before any that a rule blocks; without either the url is allowed. Only urls that take
part in a link enter the components, as 256-bit digests, never pages.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the
end; no ``://``: both empty. An address, the unit of links, is host, path and query: scheme and fragment don't
count, dot segments are resolved, an empty path is ``/``. Links inside comments and scripts don't count;
relative ones are resolved against the page's url; targets of other schemes (``mailto:``) are no links.

Defined cases: a null or odd url has an empty host and path and no links; a null, empty or very long page is read
whole; repeated rows each have their result; a null id is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import staged
from ..session import settle
from .common import components

#: Rules up to this number are an expression, more are joined.
INLINE = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*(\?[^#]*)"
#: What is no part of the page's own links.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
TAG = r"(?is)<(?:link|meta)\s[^>]*>"
IS_CANONICAL = r"""(?is)^<link\s(?:.*[\s"'])?rel\s*=\s*(?:canonical[\s/>]|"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?')"""
IS_REFRESH = r"""(?is)^<meta\s(?:.*[\s"'])?http-equiv\s*=\s*["']?\s*refresh[\s"'/>]"""
HREF = r"""(?is)[\s"']href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
CONTENT = r"""(?is)[\s"']content\s*=\s*(?:"([^"]*)"|'([^']*)')"""
REFRESH_TO = r"""(?is)^[^a-z]*url\s*=\s*['"]?([^'"]*)"""

Rules = Sequence[tuple[str, str, str]]


def rule(text: str, action: str) -> tuple[str, str, str]:
    """A rule from its text: ``example.com/en/`` is host ``example.com``, path ``/en/``."""
    host, slash, path = text.partition("/")
    return action, host, slash + path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path without dot segments, and query of a url."""
    path = path_of(url)
    # each step ends where the segment before it ended
    step = lambda so_far, x: (F.when(x == "..", F.regexp_replace(so_far, r"/[^/]*$", "")).when(x == ".", so_far)
                              .otherwise(F.concat(so_far, F.lit("/"), x)))
    ended = F.concat(path, F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))
    parts = F.split(ended, "/")
    plain = F.when(path.contains("/."), F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), step)
                   ).otherwise(path)
    return F.concat(host_of(url), F.when(plain == "", F.lit("/")).otherwise(plain),
                    F.coalesce(F.regexp_extract(url, QUERY, 1), F.lit("")))


def resolved(target: Column, url: Column) -> Column:
    """The url that a page's link means, null where it is no link."""
    base = F.concat(F.lit("x://"), host_of(url))
    folder = F.regexp_replace(F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), "[^/]*$", "")
    return (F.when((target == "") | target.startswith("#") | (host_of(url) == "") & ~target.contains("://"), None)
            .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(target.startswith("//"), F.concat(F.lit("x:"), target))
            .when(target.startswith("/"), F.concat(base, target))
            .when(target.startswith("?"), F.concat(base, path_of(url), target))
            .otherwise(F.concat(base, folder, target)))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``url`` and ``target`` of the canonical links and refreshes of pages."""
    has = F.lower(F.col(html))
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(
        F.col("url").isNotNull() & (has.contains("canonical") | has.contains("refresh")))
    tags = rows.select("url", F.explode(F.regexp_extract_all(F.regexp_replace("html", HIDDEN, ""), F.lit(TAG), 0)).alias("tag"))
    tags = staged(tags.where(F.col("tag").rlike(IS_CANONICAL) | F.col("tag").rlike(IS_REFRESH)), {"tag": "tag"})
    tag = F.col("tag")
    href = F.concat(*[F.regexp_extract(tag, HREF, i) for i in (1, 2, 3)])
    content = F.concat(*[F.regexp_extract(tag, CONTENT, i) for i in (1, 2)])
    target = F.when(tag.rlike(IS_CANONICAL), href).otherwise(F.regexp_extract(content, REFRESH_TO, 1))
    target = F.trim(F.regexp_replace(F.regexp_replace(target, "&amp;", "&"), r"[\t\n\r]", ""))
    return rows.sparkSession.createDataFrame([], "url string, target string").union(
        tags.select("url", resolved(target, F.col("url")).alias("target")).where("target IS NOT NULL"))


def rule_of(host: Column, path: Column, rules: Rules) -> Column:
    """The winning rule (``action``, ``rule``) of a host and path as one expression, null if none fits."""
    found = F.lit(None)
    for action, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(own + start).alias("rule"))).otherwise(found)
    return found.cast("struct<action:string,rule:string>")


def rules_joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, ``path`` and the winning ``found`` (``action``, ``rule``) of urls, for a table of rules of any size.

    A host meets its parent domains, a path its beginnings of the lengths that a domain's rules have; the rules
    themselves are unique in the last join, so a domain with very many urls or rules multiplies no rows.
    """
    urls = urls.select("host", "path").distinct()
    rules = rules.select("action", F.col("host").alias("own"), F.col("path").alias("start")).distinct()
    lengths = rules.groupBy("own").agg(F.collect_set(F.length("start")).alias("lengths"))
    labels = F.split("host", r"\.")
    parents = urls.select("host").distinct().select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("own"))
    probes = parents.join(lengths, "own").select("host", "own", F.explode("lengths").alias("n"))
    fits = (urls.join(probes, "host").where(F.col("n") <= F.length("path"))
            .withColumn("start", F.expr("substring(path, 1, n)")).join(rules, ["own", "start"]))
    text = F.concat("own", "start")
    best = F.max(F.struct(F.length(text).alias("n"), (F.col("action") == "allow").alias("allow"), text.alias("rule"), "action"))
    return fits.groupBy("host", "path").agg(best.alias("best")).select(
        "host", "path", F.struct("best.action", "best.rule").alias("found"))


def with_rule(rows: DataFrame, rules: Rules | DataFrame) -> DataFrame:
    """``rows`` with ``found``, the winning rule of their ``host`` and ``path``."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= INLINE:
            return rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
        rules = rows.sparkSession.createDataFrame(list(rules), "action string, host string, path string")
    return rows.join(rules_joined(rows, rules), ["host", "path"], "left")


def _digest(address: Column) -> Column:
    return F.unhex(F.sha2(address, 256))


def alias_verdicts(links: DataFrame, rules: Rules | DataFrame) -> DataFrame:
    """``node`` (digest of an address) of every address tied to others by ``links`` (``url``, ``target``) and its ``verdict``."""
    ends = links.select(*[F.struct(host_of(F.col(c)).alias("host"), path_of(F.col(c)).alias("path"),
                                   _digest(address_of(F.col(c))).alias("node")).alias(c) for c in ("url", "target")])
    ends = settle(ends.distinct(), "links")
    # an address may be written in several ways, each with its own rule
    said = with_rule(ends.select("url.*").union(ends.select("target.*")).distinct(), rules).where("found IS NOT NULL")
    said = said.select("node", "found.action").distinct()
    rooted = settle(components(ends.select(F.col("url.node").alias("a"), F.col("target.node").alias("b"))), "aliases")
    # 'allow' comes before 'block'
    decided = rooted.join(said, "node").groupBy("root").agg(F.min("action").alias("verdict"))
    return rooted.join(decided, "root").select("node", "verdict")


def url_filter(pages: DataFrame, rules: Rules | DataFrame, redirects: DataFrame | None = None, id_column: str = "page_id",
               url: str = "url", html: str | None = "html") -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule`` that fits (or null) and ``verdict``.

    ``redirects``: further links, as ``url`` and ``target``. ``html``: None if pages have no text.
    """
    links = pages.sparkSession.createDataFrame([], "url string, target string") if html is None else page_links(pages, url, html)
    if redirects is not None:
        links = links.union(redirects.select("url", resolved(F.col("target"), F.col("url")).alias("target")).dropna())
    aliases = settle(alias_verdicts(links, rules).where("verdict = 'block'").select(F.col("node").alias("blocked")), "blocked")
    u = F.col(url)
    rows = pages.select(F.col(id_column).alias("_id"), host_of(u).alias("host"), path_of(u).alias("path"), u.alias("_url"))
    rows = with_rule(rows, rules).withColumn("_node", F.when(F.col("found").isNull() & (F.col("host") != ""),
                                                             _digest(address_of(F.col("_url")))))
    return rows.join(aliases, F.col("_node") == F.col("blocked"), "left").select(
        F.col("_id").alias(id_column), "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.action", F.when(F.col("blocked").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"))


def oracle(rules: Rules) -> str:
    """The filter of ``pages`` in DuckDB's SQL."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def part(x: str, pattern: str) -> str:
        return f"coalesce(regexp_extract({x}, {quoted(pattern)}, 1), '')"

    host = lambda x: f"translate({part(x, HOST)}, '{UPPER}', '{LOWER}')"
    known = ", ".join(f"({quoted(a)}, {quoted(h)}, {quoted(p)})" for a, h, p in rules)
    fits = "(u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)"
    ended = "path || CASE WHEN regexp_matches(path, '/\\.\\.?$') THEN '/' ELSE '' END"
    folded = (f"list_reduce(list_concat([''], string_split({ended}, '/')[2:]), lambda f, x: CASE x WHEN '..' THEN "
              "regexp_replace(f, '/[^/]*$', '') WHEN '.' THEN f ELSE f || '/' || x END)")
    base, path = f"'x://' || {host('url')}", part("url", PATH)
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:"
    either = lambda x, pattern, n: " || ".join(f"coalesce(regexp_extract({x}, {quoted(pattern)}, {i}), '')" for i in range(1, n + 1))
    return f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {known}) AS r(action, host, path)),
tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, {quoted(HIDDEN)}, '', 'g'), {quoted(TAG)})) AS tag FROM pages WHERE url IS NOT NULL),
targets AS (
  SELECT url, trim(regexp_replace(replace(CASE WHEN regexp_matches(tag, {quoted(IS_CANONICAL)}) THEN {either('tag', HREF, 3)}
      ELSE regexp_extract({either('tag', CONTENT, 2)}, {quoted(REFRESH_TO)}, 1) END, '&amp;', '&'), '[\\t\\n\\r]', '', 'g')) AS t
  FROM tags WHERE regexp_matches(tag, {quoted(IS_CANONICAL)}) OR regexp_matches(tag, {quoted(IS_REFRESH)})),
links AS (
  SELECT url, CASE WHEN t = '' OR starts_with(t, '#') OR ({host('url')} = '' AND NOT contains(t, '://')) THEN NULL
      WHEN regexp_matches(t, '{scheme}//') THEN t WHEN regexp_matches(t, '{scheme}') THEN NULL
      WHEN starts_with(t, '//') THEN 'x:' || t WHEN starts_with(t, '/') THEN {base} || t WHEN starts_with(t, '?') THEN {base} || {path} || t
      ELSE {base} || regexp_replace(CASE {path} WHEN '' THEN '/' ELSE {path} END, '[^/]*$', '') || t END AS target FROM targets),
urls AS (SELECT url, {host('url')} AS host, {path} AS path, {part('url', QUERY)} AS query FROM (
  SELECT url FROM pages UNION SELECT target FROM links) AS x),
ruled AS (
  SELECT u.url, arg_max(r, (length(r.host || r.path), r.action = 'allow', r.host || r.path)) AS r FROM urls u JOIN rules r ON {fits} GROUP BY u.url),
nodes AS (
  SELECT u.url, host, path, r.action, r.host || r.path AS rule,
    host || CASE f WHEN '' THEN '/' ELSE f END || query AS node
  FROM (SELECT *, CASE WHEN contains(path, '/.') THEN {folded} ELSE path END AS f FROM urls) u LEFT JOIN ruled USING (url)),
edges AS (
  SELECT a.node AS a, b.node AS b FROM links l JOIN nodes a ON a.url = l.url JOIN nodes b ON b.url = l.target),
reach AS (
  SELECT node, node AS other FROM (SELECT a AS node FROM edges UNION SELECT b FROM edges)
  UNION SELECT r.node, e.b FROM reach r JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) e ON e.a = r.other),
verdicts AS (SELECT r.node, min(n.action) AS verdict FROM reach r JOIN nodes n ON n.node = r.other
  WHERE n.url IN (SELECT url FROM links WHERE target IS NOT NULL UNION SELECT target FROM links) GROUP BY r.node)
SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, n.rule,
  coalesce(n.action, v.verdict, 'allow') AS verdict
FROM pages p LEFT JOIN nodes n ON n.url = p.url LEFT JOIN verdicts v ON v.node = n.node AND n.host <> ''"""
