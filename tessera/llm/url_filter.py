"""URL allow and block lists.

Every URL is expanded into host-suffix and path-prefix expressions of the shapes that
occur in the rules (number of labels, length of path), the expressions are joined with
the rules on a short hash prefix, the full digest confirms a hit and the longest rule
wins. DataFrame functions only.

Edge cases: a null URL, or one without "://", has an empty host and path and gets the
default verdict; repeated rows each keep their row; ids may be null; an empty table
gives an empty result; other columns are not read. Rules that repeat count once; of
two rules with the same host and path, allow wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are broadcast; beyond it both sides are shuffled on the hash prefix.
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def short(full: Column) -> Column:
    return F.conv(F.substring(full, 1, 8), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains
    where the path starts with the rule's; the longest rule (host plus path) wins.
    """
    rules = (
        rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .where("r_host is not null and r_path is not null")
        .groupBy("r_host", "r_path")
        .agg(F.min("r_verdict").alias("r_verdict"))
        .withColumn("r_digest", digest(F.col("r_host"), F.col("r_path")))
        .withColumn("r_short", short(F.col("r_digest")))
    )
    # Shapes are pairs of small integers: their number is bounded by the longest rule, not by the number of rules.
    shapes = rules.select(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("chars")).distinct().collect()
    urls = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    expressions = [
        F.when(
            (F.size(F.split("host", r"\.")) >= x["labels"]) & (F.length("path") >= x["chars"]),
            F.struct(F.substring_index("host", ".", -x["labels"]).alias("h"), F.substring("path", 1, x["chars"]).alias("p")),
        )
        for x in shapes
    ]
    probes = (
        urls.distinct()
        .withColumn("e", F.explode(F.filter(F.array(*expressions), lambda e: e.isNotNull())))
        .withColumn("digest", digest(F.col("e.h"), F.col("e.p")))
        .withColumn("short", short(F.col("digest")))
        if shapes
        else None
    )
    judged = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if probes is None:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    hits = (
        probes.join(F.broadcast(rules) if small else rules, F.col("short") == F.col("r_short"))
        .where((F.col("digest") == F.col("r_digest")) & (F.col("e.h") == F.col("r_host")) & (F.col("e.p") == F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("m"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    return judged.join(hits, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
