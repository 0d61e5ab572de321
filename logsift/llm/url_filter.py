"""URL filter by rules and by a tree of path templates, in DataFrame operations only.

Per host, paths become lists of segments whose digits and long hexadecimal ids are wildcards.
The tree is then walked level by level: segments of a node with very many rare children become
a wildcard, and children whose labels don't differ significantly from those of their
labelled siblings are merged into one; from the DEPTH-th on segments are taken as one. Labels are the verdicts of rules; a template is rejected when its
smoothed share of blocked labels reaches REJECT. A url without a rule takes the verdict of
its template, and one whose template has no labels is allowed.

All work on the tree is on distinct (host, template) counts; pages meet it again in one join,
which Spark splits where one host holds much of the table. Nulls: a null url or one without
`://` has empty host and path; a null page_id is kept. Repeated rows are judged each, ties of rules go to the later
by host and path. Very long urls are judged whole. Only page_id and url are read, so other columns can't clash.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.session import shared_dir

# (verdict, host, path): fixed values of the contract.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
MANY, RARE, Z, PRIOR, WEIGHT, REJECT, LEAST = 50, 3.0, 2.0, 0.25, 4.0, 0.5, 5
DEPTH = 64  # segments of a path; what follows counts as part of the last
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _generalised(segment: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(segment, r"^[0-9a-fA-F-]{16,}$", "*"), r"[0-9]+", "*")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _templates(seen: DataFrame) -> DataFrame:
    """seen(host, template, n, blocked, allowed) with `final`, the template after merging. Each level is written, so
    plans don't grow; a template that is alone below its node keeps its rest, so levels end where no two share a node."""
    tree, done = seen.withColumns({"segments": F.split("template", "/", DEPTH), "final": F.lit("")}), None
    for k in range(DEPTH):
        at = tree.withColumn("segment", F.get("segments", F.lit(k)))
        kids = _kept(at.groupBy("host", "final", "segment").agg(F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.sum("allowed").alias("a"), F.count("*").alias("left")), "url-kids")
        labelled = F.when(F.col("b") + F.col("a") >= LEAST, 1).otherwise(0)
        parents = kids.where("segment is not null").groupBy("host", "final").agg(
            F.count("*").alias("kids"), F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.sum("a").alias("all_a"), F.sum(labelled).alias("known"), F.sum("left").alias("below")
        )
        j = kids.join(parents, ["host", "final"])
        own, rest = F.col("b") + F.col("a"), F.col("all_b") + F.col("all_a") - F.col("b") - F.col("a")
        p, q = (F.col("b") + 1) / (own + 2), (F.col("all_b") - F.col("b") + 1) / (rest + 2)
        both = (F.col("all_b") + 2) / (own + rest + 4)
        alike = F.abs(p - q) <= Z * F.sqrt(both * (1 - both) * (1 / (own + 2) + 1 / (rest + 2)))
        variable = (F.col("kids") > MANY) & (F.col("n") <= RARE * F.col("all_n") / F.col("kids"))
        merged = (F.col("known") > 1) & (own >= LEAST) & (rest >= LEAST) & alike
        to = j.select("host", "final", "segment", F.when(variable | merged, "*").otherwise(F.col("segment")).alias("to"), (F.col("below") == 1).alias("alone"))
        slash = F.lit("/" if k else "")
        tail = F.array_join(F.slice("segments", k + 1, DEPTH), "/")
        final = F.when(F.col("segment").isNull(), F.col("final")).when(F.col("alone"), F.concat("final", slash, tail)).otherwise(F.concat("final", slash, "to"))
        after = at.join(to, ["host", "final", "segment"], "left").select(*seen.columns, "segments", final.alias("final"), (F.col("segment").isNull() | F.col("alone")).alias("ended"))
        after = _kept(after, "url-tree")
        done = after if done is None else done.where("ended").unionByName(after)
        tree = after.where("not ended").drop("ended")
        if not tree.limit(1).count():
            break
    return done.drop("segments", "ended")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of pages(page_id, url)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "by_rule": verdict, "template": F.array_join(F.transform(F.split("path", "/"), _generalised), "/")})
    seen = parsed.groupBy("host", "template").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "block").alias("blocked"), F.count_if(F.col("by_rule") == "allow").alias("allowed"))
    at = shared_dir(spark, "url-templates")
    seen.write.parquet(at)
    tree = _templates(spark.read.parquet(at))
    purity = (F.sum("blocked") + PRIOR * WEIGHT) / (F.sum("blocked") + F.sum("allowed") + WEIGHT)
    leaves = tree.groupBy("host", "final").agg(purity.alias("purity"))
    verdicts = tree.join(leaves, ["host", "final"]).select("host", "template", "final", "purity")
    out = parsed.join(verdicts, ["host", "template"])
    by_template = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_template).alias("verdict"), F.col("final").alias("template"), "purity")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
