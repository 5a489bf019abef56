"""URL filters (operator 1), native.

Each URL becomes the expressions it may be listed under: host suffixes crossed with path prefixes, cut at the label
counts and path lengths that occur among the rules, so nothing that could fit is left out and a very long URL costs no
more than a short one. Expressions meet rules in an equi-join on a short hash prefix; the full digest then confirms, and
the highest score wins. Rules are grouped by their prefix, so the join is on the prefix alone and brings the digests that
are to be compared. A score packs what precedence needs (length of the rule, of its host, block before allow) into one
number, so the best rule of a URL is a plain max and the rule's text is cut out of the URL again.

Precedence: longest rule (host and path together), then longer host, then block. Defined cases: null or a URL without
`://` has an empty host and path and no rule; repeated rows give repeated results; a null page_id stays; rules with a
null part are ignored; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Above so many rules they are no longer broadcast but dealt out, with URLs salted.
MOST_BROADCAST = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int = 16) -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict. rules: (verdict, host, path); hosts in lower case."""
    rules = rules.where("verdict is not null and host is not null and path is not null and host <> ''").select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), (F.col("verdict") == "block").cast("long").alias("r_block")
    )
    # how many labels and path characters rules have: a few distinct numbers, whatever the number of rules
    shape = rules.agg(
        F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths"), F.count("*").alias("n")
    ).first()
    labels, lengths, n_rules = sorted(shape["labels"]), sorted(shape["lengths"]), shape["n"]
    rules = rules.select(
        (F.length("r_host") + F.length("r_path")).cast("long").alias("total"),
        F.length("r_host").cast("long").alias("host_len"),
        "r_block",
        F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256).alias("r_digest"),
    )
    score = F.shiftleft(F.col("total"), 32) + F.shiftleft(F.col("host_len"), 1) + F.col("r_block")
    rules = rules.groupBy("r_digest").agg(F.max(score).alias("score")).withColumn("prefix", F.substring("r_digest", 1, 8))
    # 4 bytes of a digest: two rules in a billion pairs share them, so these lists stay short
    rules = rules.groupBy("prefix").agg(F.collect_list(F.struct("r_digest", "score")).alias("listed"))

    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    if not labels:
        return urls.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    count = F.size(F.split("host", r"\."))
    hosts = F.array(*[F.when(count >= k, F.substring_index("host", ".", -k)) for k in labels])
    paths = F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths])
    # one row stays for a URL without expressions; the row number keeps repeated rows apart
    each = urls.withColumn("h", F.explode_outer(F.filter(hosts, lambda x: x.isNotNull() & (x != ""))))
    each = each.withColumn("p", F.explode_outer(F.filter(paths, lambda x: x.isNotNull())))
    each = each.withColumn("digest", F.sha2(F.concat("h", F.lit("\n"), "p"), 256)).drop("h", "p")
    each = each.withColumn("prefix", F.substring("digest", 1, 8))
    if n_rules <= MOST_BROADCAST:
        keys = each["prefix"] == rules["prefix"]
        rules = F.broadcast(rules)
    else:
        each = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
        rules = rules.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys = (each["prefix"] == rules["prefix"]) & (each["salt"] == rules["r_salt"])
    hits = each.join(rules, keys, "left")
    confirmed = F.array_max(F.transform(F.filter("listed", lambda x: x["r_digest"] == F.col("digest")), lambda x: x["score"]))
    best = hits.groupBy("row", "id", "host", "path").agg(F.max(confirmed).alias("score"))
    total, host_len = F.shiftright("score", 32), F.shiftright(F.col("score").bitwiseAND(0xFFFFFFFF), 1)
    block = F.col("score").bitwiseAND(1) == 1
    rule = F.concat(F.expr("right(host, cast(host_len as int))"), F.expr("left(path, cast(total - host_len as int))"))
    return best.withColumns({"total": total, "host_len": host_len}).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.when(F.col("score").isNotNull(), rule).alias("rule"),
        F.when(F.col("score").isNull(), F.lit(default)).when(block, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


ORACLE = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
m AS (
  SELECT u.*, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.n ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC, r.verdict DESC) AS k
  FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
