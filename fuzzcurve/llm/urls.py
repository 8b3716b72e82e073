"""Operator 3: URL filters whose rules are indexed by their rarest literal token.

Rules are of two kinds. A host rule (``example.org/es/``) fits its host and
all subdomains if the path starts with the rule's; the longest that fits
decides. A pattern rule is text in which ``^`` stands for a separator (no
letter or digit; also either end) and ``*`` for anything; where no host rule
fits, a URL is blocked if a blocking pattern occurs in it and no allowing one
does. All are regular expressions in the end.

A rule's literal tokens are those that every URL it fits must have as a
whole; where a pattern breaks off inside a token (``^porn``), every URL must
have a token that begins so. The rule is filed under the one that is rarest
among the URLs at hand; a URL's tokens, and their beginnings of the lengths
that such rules have, fetch the rules filed under them, and only those run
their expression. Only a rule without any of these (``*``) is fetched by
every URL. Verdicts are for distinct URLs; the index joins by token, and
Spark broadcasts it only if the written table is below its own threshold.
Rules are a table (rule, kind, verdict), from anywhere.

A null URL has an empty host and path and is allowed; one without ``://`` has
an empty host and path, and its verdict is allow unless a pattern blocks it. Repeated
rows are judged once and come back as often as they stand there; of several
fitting host rules of one length the last in order is named. Long URLs are
whole. An empty table gives an empty result; without rules all is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read, write_table

#: The host rules (rule, verdict).
HOST_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: The pattern rules (rule, verdict).
PATTERN_RULES = [
    ("^adult-x^", "block"), ("^adult^content^", "block"), ("^casino^", "block"), ("^cheap-pills^", "block"), ("^spam-farm^", "block"), ("^free-money^", "block"), ("^xxx^", "block"),
    ("^porn", "block"), ("^click-here^buy-now^", "block"), ("^signup^referral=", "block"), ("^phishing*^login^", "block"), ("^adult-x*^health^", "allow"),
]
_TOKEN = "[a-z0-9]+"


def rule_table(spark: SparkSession, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """(rule, kind, verdict) of both kinds."""
    return spark.createDataFrame([(r, "host", v) for r, v in host_rules] + [(r, "pattern", v) for r, v in pattern_rules], "rule string, kind string, verdict string")


def _expression(rule: Column, kind: Column) -> Column:
    """The rule as a regular expression: on host and path, or on the whole lower-cased URL."""
    plain = F.regexp_replace(rule, r"([.+?|(){}\[\]$\\])", r"\\$1")
    host = F.concat(F.lit(r"^([^/]*\.)?"), F.regexp_replace(plain, r"([*^])", r"\\$1"))
    text = F.regexp_replace(F.regexp_replace(plain, r"\*", ".*"), r"^\^", "(^|[^a-z0-9])")
    return F.when(kind == "host", host).otherwise(F.regexp_replace(text, r"(?<!\(|\[)\^(?!\|)", "([^a-z0-9]|\\$)"))


def _literals(rule: Column, kind: Column) -> Column:
    """Tokens between separators on both sides, and ``token*`` for what follows one and breaks off; a host rule's last label is whole, since what follows it is a slash."""
    whole = F.lower(F.when(kind == "host", F.concat(F.lit("^"), rule)).otherwise(rule))
    begun = F.transform(F.regexp_extract_all(whole, F.lit(f"(?<=[^a-z0-9*])({_TOKEN})(?=$|[*])"), F.lit(1)), lambda t: F.concat(t, F.lit("*")))
    return F.array_distinct(F.concat(F.regexp_extract_all(whole, F.lit(f"(?<=[^a-z0-9*])({_TOKEN})(?=[^a-z0-9*])"), F.lit(1)), begun))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(ascii_lower, F.lit("")), F.coalesce(path, F.lit(""))


def url_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_rules_run) for every row of ``pages`` (page_id, url)."""
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    null = own.where("url is null").select("page_id", F.lit("").alias("host"), F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(0).cast("long").alias("n_rules_run"))
    own = own.where("url is not null")  # null urls would all meet in one task of the join
    urls = own.select("url").distinct()
    host, path = split_url(F.col("url"))
    low = F.translate("url", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    filed = rules.select("rule", "kind", "verdict", _expression(F.col("rule"), F.col("kind")).alias("pattern"), _literals(F.col("rule"), F.col("kind")).alias("literals"))
    choice = filed.select("rule", "kind", F.explode("literals").alias("token"))
    begun = choice.where(F.col("token").endswith("*")).select((F.length("token") - 1).alias("n")).distinct()
    lengths = F.array(*[F.lit(r["n"]) for r in begun.collect()]).cast("array<int>")  # as many as a token has letters
    whole = F.array_distinct(F.regexp_extract_all(low, F.lit(_TOKEN), F.lit(0)))
    starts = F.flatten(F.transform(lengths, lambda n: F.transform(F.filter(whole, lambda t: F.length(t) >= n), lambda t: F.concat(F.substring(t, F.lit(1), n), F.lit("*")))))
    tokens = urls.select("url", F.explode(F.array_distinct(F.concat(whole, starts, F.array(F.lit(""))))).alias("token"))
    count = tokens.join(choice.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("c"))
    rarest = choice.join(count, "token", "left").groupBy("rule", "kind").agg(F.min_by("token", F.struct(F.coalesce("c", F.lit(0)), "token")).alias("token"))
    index = filed.join(rarest, ["rule", "kind"], "left").select("rule", "kind", "verdict", "pattern", F.coalesce("token", F.lit("")).alias("token"))
    index = write_table(index, "rules")
    fetched = tokens.join(index, "token").select("url", "rule", "kind", "verdict", "pattern")
    run = fetched.withColumns({"host": host, "path": path}).withColumn("on", F.when(F.col("kind") == "host", F.concat("host", "path")).otherwise(low)).withColumn("fits", F.expr("`on` rlike pattern"))
    is_host, is_block = F.col("fits") & (F.col("kind") == "host"), F.col("verdict") == "block"
    found = run.groupBy("url").agg(
        F.max_by("rule", F.when(is_host, F.struct(F.length("rule"), "rule"))).alias("rule"),
        F.max_by("verdict", F.when(is_host, F.struct(F.length("rule"), "rule"))).alias("by_host"),
        F.coalesce(F.max(F.when(F.col("fits") & (F.col("kind") == "pattern"), is_block)), F.lit(False)).alias("blocked"),
        F.coalesce(F.max(F.when(F.col("fits") & (F.col("kind") == "pattern"), ~is_block)), F.lit(False)).alias("excepted"),
        F.count("*").alias("n_rules_run"),
    )
    by_pattern = F.when(F.col("blocked") & ~F.col("excepted"), "block").otherwise("allow")
    out = own.join(found, "url", "left")
    out = out.select("page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("by_host", by_pattern).alias("verdict"), F.coalesce("n_rules_run", F.lit(0)).cast("long").alias("n_rules_run"))
    return out.unionByName(null)


def op3_urls(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(read(spark, sf_dir, "pages"), rule_table(spark)).drop("n_rules_run")


ORACLE = r"""
WITH p AS (
  SELECT page_id, lower(coalesce(url, '')) AS low, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, low, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p
), r(host_, path_, rule, v) AS (
  VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'), ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')
), b AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
  FROM q JOIN r ON (host = host_ OR ends_with(host, '.' || host_)) AND starts_with(path, path_) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(low, '(^|[^a-z0-9])(adult-x([^a-z0-9]|$)|adult[^a-z0-9]content([^a-z0-9]|$)|casino([^a-z0-9]|$)|cheap-pills([^a-z0-9]|$)|spam-farm([^a-z0-9]|$)|free-money([^a-z0-9]|$)|xxx([^a-z0-9]|$)|porn|click-here[^a-z0-9]buy-now([^a-z0-9]|$)|signup[^a-z0-9]referral=|phishing.*[^a-z0-9]login([^a-z0-9]|$))')
  AND NOT regexp_matches(low, '(^|[^a-z0-9])adult-x.*[^a-z0-9]health([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN b USING (page_id)
"""
