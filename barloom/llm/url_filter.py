"""URL filters: hashed host-suffix / path-prefix lookup of block and allow rules.

Every URL is expanded into expressions (host suffix + path prefix). The
expressions meet the rules in an equi-join on the first bytes of their
SHA-256, after which the whole digests are compared and the longest fitting
rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import lower_ascii

#: The production rules: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
PREFIX_HEX = 8  # 32 bits of the digest


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; '' without one."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and all its parent domains (``a.b.c``: ``a.b.c``, ``b.c``, ``c``)."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """Prefixes of ``path`` of the lengths that rules have."""
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.transform(fits, lambda n: F.substring(path, F.lit(1), n))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row of ``pages``.

    Params: ``rules (host, path, verdict)``; ``default`` is the verdict of a
    URL that no rule fits. A rule fits its host and every subdomain of it when
    the URL's path starts with the rule's path. The longest host wins, then
    the longest path; if two rules are the same, the one that blocks.

    The work is keyed by distinct URL (pre-aggregated before the shuffle), so
    repeated rows cost nothing and every row keeps its own columns. Columns
    of ``pages`` that are named like an output column are replaced. Null URLs
    and URLs without ``://`` have an empty host and path and no rule; an empty
    table gives an empty result. Rules with a null host or path fit nothing.
    """
    whole = F.concat(F.col("rule_host"), F.col("rule_path"))
    known = (
        rules.where("host is not null and path is not null")
        .select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .withColumn("rule_digest", F.sha2(whole, 256))
        .withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))
    )
    # one row for each length of a path in the rules: bounded by the longest path
    lengths = sorted(r[0] for r in known.select(F.length("rule_path")).distinct().collect()) or [0]
    urls = pages.select(F.col(url_col).alias("u")).where("u is not null").distinct()
    parts = urls.withColumn("h", host_of(F.col("u"))).withColumn("p", path_of(F.col("u"))).where("h <> ''")
    expressions = (
        parts.select("u", "p", F.explode(host_suffixes(F.col("h"))).alias("hs"))
        .select("u", "hs", F.explode(path_prefixes(F.col("p"), lengths)).alias("pp"))
        .withColumn("digest", F.sha2(F.concat("hs", "pp"), 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    best = (
        expressions.join(known, "short")
        .where("digest = rule_digest and hs = rule_host and pp = rule_path")
        .groupBy("u")
        .agg(F.max(F.struct(F.length("hs").alias("a"), F.length("pp").alias("b"), (F.col("rule_verdict") == "block").alias("c"), whole.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
        .select("u", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    left = pages.drop("host", "path", "rule", "verdict")
    return left.join(best, left[url_col] == best["u"], "left").select(
        *[left[c] for c in left.columns],
        host_of(left[url_col]).alias("host"),
        path_of(left[url_col]).alias("path"),
        best["rule"].alias("rule"),
        F.coalesce(best["verdict"], F.lit(default)).alias("verdict"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (
  SELECT row_number() OVER () AS k, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
m AS (
  SELECT k, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY k ORDER BY length(rhost) DESC, length(rpath) DESC) AS rn
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.rverdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.k = m.k AND m.rn = 1
"""
