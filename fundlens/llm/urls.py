"""URL filters (DataFrame functions only).

Every distinct URL is expanded into host-suffix and path-prefix expressions,
at the label counts and path lengths that occur among the rules. The
expressions are equi-joined with the rules on the first four bytes of their
SHA-256, the full digest confirms a hit, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.llm.common import c

#: ``(host, path, verdict)``: fixed values of the registered query.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Rules up to this number are broadcast; a longer list is joined by shuffle.
BROADCAST_RULES = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: after the first ``://`` up to ``/``,
    ``?``, ``#`` or the end; then up to ``?``, ``#`` or the end. Null or no
    ``://``: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    # the zero byte keeps ("a", "b/") and ("ab", "/") apart
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def judge_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict)``, one row per input row.

    A rule fits its host and all subdomains, if the path starts with the
    rule's. The rule with the most characters (host and path) wins; between
    equal lengths the smaller rule text, then ``block``. Without a fitting
    rule, ``rule`` is null and ``verdict`` is ``default``.

    * null or unparsable URL: host and path empty, no rule fits;
    * repeated rows and ids each keep their row; equal URLs are judged once;
    * other columns (whatever their names) are ignored; empty tables give
      empty results, an empty rule list gives ``default`` throughout.
    """
    rules = rules.select(F.lower("rule_host").alias("rule_host"), "rule_path", "verdict").dropna().distinct()
    # shapes of the rules: as many as there are different label counts and path lengths in the rule list
    shapes = rules.agg(F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"),
                       F.collect_set(F.length("rule_path")).alias("lengths"),
                       F.count(F.lit(1)).alias("n")).first()
    pages = df.select(c(id_col).alias("_id"), c(url_col).cast("string").alias("_url"))
    host, path = url_parts(F.col("_url"))
    urls = pages.select("_url").distinct().select("_url", host.alias("host"), path.alias("path"))
    labels = F.array(*[F.lit(int(x)) for x in sorted(shapes["labels"])]).cast("array<int>")
    lengths = F.array(*[F.lit(int(x)) for x in sorted(shapes["lengths"])]).cast("array<int>")
    dots = F.size(F.split("host", r"\."))
    suffixes = F.transform(F.filter(labels, lambda k: k <= dots),
                           lambda k: F.array_join(F.slice(F.split("host", r"\."), dots - k + 1, k), "."))
    prefixes = F.transform(F.filter(lengths, lambda k: k <= F.length("path")),
                           lambda k: F.substring(F.col("path"), F.lit(1), k))
    exprs = (urls.select("_url", F.explode(suffixes).alias("_suffix"), prefixes.alias("_prefixes"))
             .select("_url", "_suffix", F.explode("_prefixes").alias("_prefix"))
             .select("_url", _digest(F.col("_suffix"), F.col("_prefix")).alias("_digest")))
    keyed = rules.select(F.concat("rule_host", "rule_path").alias("rule"), "verdict",
                         _digest(F.col("rule_host"), F.col("rule_path")).alias("_rule_digest"))
    keyed = keyed.withColumn("_short", F.substring("_rule_digest", 1, 8))
    if shapes["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    hits = (exprs.withColumn("_short", F.substring("_digest", 1, 8)).join(keyed, "_short")
            .where(F.col("_digest") == F.col("_rule_digest"))
            .groupBy("_url").agg(F.min(F.struct((-F.length("rule")).alias("n"), F.col("rule"),
                                (F.col("verdict") != "block").alias("b"), F.col("verdict"))).alias("_hit")))
    # the second key makes both sides exchanges of the join, so that a frequent URL's pages can be split
    again = F.xxhash64("_url")
    out = pages.withColumn("_h", again).join(hits.withColumn("_h", again), ["_url", "_h"], "left")
    host, path = url_parts(F.col("_url"))
    return out.select(F.col("_id").alias(id_col), host.alias("host"), path.alias("path"),
                      F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rule_host, rule_path, verdict) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT hp.*, (SELECT max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path, verdict := verdict))
                FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS hit
  FROM hp)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM fit
"""
