"""URL filters: rules by host and path, and for other urls a tree of path templates for each host.

The tree is grown level by level over (host, path) groups, until no branch is left. Segments are counted as they are, with
digits or without; one that is rare under its parent is variable and becomes a wildcard. Frequent branches are binned by their
share of bad labels, and those that a two-proportion test doesn't tell apart from the cluster before them merge into one
numbered wildcard. Below a branch of fewer than ``min_support`` urls every segment is rare, so it is grown no further. A template
is rejected if its share of bad labels, smoothed towards the host's, which is smoothed towards the share of all, reaches
``reject``.

All of it is DataFrame functions; every step aggregates partially before it shuffles, and joins by host are plain joins
that adaptive execution can split when a host is hot.

Defined results: a null url, or one without ``://``, has an empty host and path and belongs to the template of the empty
host; without any label nothing is rejected; equal rows get equal verdicts; an empty table gives an empty result; columns
of the input named like results, and ``url_shape``, are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.runtime import materialise

#: Levels that are grown before the first look whether a branch is left.
DEPTH = 5
#: Bins of shares of bad labels: branches whose shares differ by less than a thousandth are alike.
BINS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("host", "path", "rule", "template", "purity", "verdict")


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. rules: (verdict, host/path)."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        at, slash, tail = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def clusters(frequent: DataFrame, z: float) -> DataFrame:
    """(host, template, bin, cluster, alone) for branches of a parent, binned by their share of bad labels. Bins are taken in order; each
    joins the cluster before it unless a two-proportion test tells it apart from all of that cluster's labels together, so that a
    cluster can't creep from clean branches to bad ones. alone: whether the cluster is one branch. A parent has BINS + 1 bins at most."""
    bins = frequent.groupBy("host", "template", "bin").agg(F.sum("m").alias("m"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("k"))
    listed = bins.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("bin", "m", "b", "k"))).alias("bins"))

    def step(so_far: Column, x: Column) -> Column:
        m, b = so_far["m"] + x["m"], so_far["b"] + x["b"]
        pooled = b / m
        error = F.sqrt(pooled * (1 - pooled) * (1 / x["m"] + F.try_divide(F.lit(1), so_far["m"])))
        apart = F.coalesce(F.abs(x["b"] / x["m"] - F.try_divide(so_far["b"], so_far["m"])) > z * error, F.lit(False))
        cluster = so_far["cluster"] + apart.cast("int")
        placed = F.concat(so_far["placed"], F.array(F.struct(x["bin"].alias("bin"), cluster.alias("cluster"), x["k"].alias("k"))))
        return F.struct(F.when(apart, x["m"]).otherwise(m).alias("m"), F.when(apart, x["b"]).otherwise(b).alias("b"), cluster.alias("cluster"), placed.alias("placed"))

    nothing = F.struct(F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("cluster"), F.array().cast("array<struct<bin: int, cluster: int, k: bigint>>").alias("placed"))
    placed = listed.select("host", "template", F.explode(F.aggregate("bins", nothing, step, lambda x: x["placed"])).alias("p")).select("host", "template", "p.*")
    own = Window.partitionBy("host", "template", "cluster")  # over a parent's bins
    return placed.select("host", "template", "bin", "cluster", (F.sum("k").over(own) == 1).alias("alone"))


def template_tree(urls: DataFrame, min_support: int = 20, z: float = 1.96, smoothing: float = 20.0) -> DataFrame:
    """(host, shape, template, purity) for each group of urls. urls: host, shape (path by segments()), bad (1, 0 or null)."""
    n, m, b = F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("b").alias("b")
    groups = urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("m"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    live, ended, level = groups.withColumn("template", F.lit("")), [], 0
    while True:
        live = materialise(live, "url-groups")  # else each level would run all levels above it three times
        deeper = F.size("shape") > level
        if level >= DEPTH:
            open_ones = live.where(deeper).groupBy("host", "template").agg(n).where(F.col("n") >= min_support)
            live = materialise(live.join(open_ones.select("host", "template", F.lit(True).alias("open")), ["host", "template"], "left"), "url-groups")
            deeper = F.col("open").isNotNull() & deeper
        rest = F.repeat(F.lit("/*"), F.greatest(F.size("shape") - level, F.lit(0)))
        ended.append(live.where(~deeper).select("host", "shape", "n", "m", "b", F.concat("template", rest).alias("template")))
        live = live.where(deeper)
        if live.isEmpty():
            break
        level += 1
        branch = live.withColumn("segment", F.try_element_at("shape", F.lit(level)))
        branches = branch.groupBy("host", "template", "segment").agg(n, m, b)
        frequent = branches.where((F.col("n") >= min_support) & (F.col("m") > 0)).withColumn("bin", F.round(BINS * F.col("b") / F.col("m")).cast("int"))
        literal = frequent.join(clusters(frequent, z), ["host", "template", "bin"])
        literal = literal.select("host", "template", "segment", F.when(F.col("alone"), F.col("segment")).otherwise(F.concat(F.lit("*"), F.col("cluster").cast("string"))).alias("stays"))
        branch = branch.join(literal, ["host", "template", "segment"], "left")
        live = branch.select("host", "shape", "n", "m", "b", F.concat("template", F.lit("/"), F.coalesce("stays", F.lit("*"))).alias("template"))
    groups = materialise(reduce(DataFrame.union, ended), "url-groups")
    total = groups.agg(m, b).first()
    overall = (total["b"] or 0) / max(total["m"] or 0, 1)
    hosts = groups.groupBy("host").agg(((F.sum("b") + smoothing * overall) / (F.sum("m") + smoothing)).alias("host_share"))
    shares = groups.groupBy("host", "template").agg(m, b).join(hosts, "host")
    shares = shares.select("host", "template", ((F.col("b") + smoothing * F.col("host_share")) / (F.col("m") + smoothing)).alias("purity"))
    return groups.select("host", "shape", "template").join(shares, ["host", "template"])


def filter_urls(urls: DataFrame, rules: list[tuple[str, str]], url: str = "url", bad: str = "bad", reject: float = 0.5, min_support: int = 20) -> DataFrame:
    """urls with host, path, rule, template, purity (smoothed share of bad labels) and verdict. bad: 1, 0 or null (no label)."""
    rows = urls.drop(*[c for c in RESULTS if c not in (url, bad)])
    rows = rows.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rows = rows.withColumn("url_shape", segments(F.col("path")))
    tree = template_tree(rows.select("host", F.col("url_shape").alias("shape"), F.col(bad).cast("long").alias("bad")), min_support)
    rows = rows.join(tree.withColumnRenamed("shape", "url_shape"), ["host", "url_shape"], "left").drop("url_shape")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(said, own)})
