"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is budget x weight / rows. Each document inverts the Poisson distribution function of its
source's rate at a uniform number that a seeded hash of its id gives, is exploded by the count that comes out, and all
copies are dealt out anew by a hash, so that their order is random over the whole result.

All of it is DataFrame functions; one shuffle moves the texts. Rates are one row per source: they are broadcast only if
counted to be at most ``BROADCAST_ROWS``; beyond that the join is dealt by source and salt, so a hot source is split.

Defined results: a null source is a source of its own; a null doc_id takes its number from the text instead; rows with
equal ids get equal counts; null and empty texts are mixed like any others; an empty table gives an empty result; columns
of the input named ``copy``, or with names that begin with ``mix_``, are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A rate's row is about 1 KB.
BROADCAST_ROWS = 20_000
SALTS = 32


def hashed_uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from md5, the same in any engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float | None = None, source: str = "source") -> DataFrame:
    """(source, rows, mix_rate). Weights: as given (others have none: rate 0), else rows to the power ``temperature``. budget: the expected
    rows of the mix, by default as many as go in."""
    sizes = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(temperature))
    elif not weights:
        raise ValueError("weights is empty")
    elif min(weights.values()) < 0:
        raise ValueError("a weight is negative")
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        weight = F.coalesce(F.try_element_at(given, F.col("mix_source")), F.lit(0.0))
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("weight").alias("w"), F.sum("rows").alias("n")).first()
    whole, rows = total["w"] or 1.0, float(total["n"] or 0) if budget is None else float(budget)
    return sizes.select("mix_source", "rows", (F.lit(rows) * F.col("weight") / F.lit(whole) / F.col("rows")).alias("mix_rate"))


def poisson_table(rates: DataFrame) -> DataFrame:
    """Adds ``cdf``: P(count <= k) for k from 0 to far in the tail. Worked out in logs, so large rates don't underflow."""
    last = F.ceil(F.col("mix_rate") + 12 * F.sqrt("mix_rate") + 30).cast("int")
    steps = rates.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    upto = Window.partitionBy("mix_source").orderBy("k")
    log_factorial = F.sum(F.log(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(upto)
    p = F.when(F.col("mix_rate") > 0, F.exp(F.col("k") * F.log("mix_rate") - F.col("mix_rate") - log_factorial)).otherwise((F.col("k") == 0).cast("double"))
    steps = steps.withColumn("p", p).withColumn("below", F.sum("p").over(upto))
    table = F.transform(F.array_sort(F.collect_list(F.struct("k", "below"))), lambda x: x["below"])
    return steps.groupBy("mix_source", "mix_rate").agg(table.alias("cdf"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float | None = None, seed: int = 17, id_column: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Each document as often as its Poisson count says, with ``copy`` (from 0), ``mix_rate`` and ``mix_key``, in random order:
    partitions by a hash of mix_key, rows by mix_key in each."""
    docs = docs.drop("copy", *[c for c in docs.columns if c.lower().startswith("mix_")])
    tables = poisson_table(source_rates(docs, weights, temperature, budget, source))
    # A null source joins as the empty string, others behind a mark.
    tables = tables.select(F.coalesce(F.concat(F.lit("="), "mix_source"), F.lit("")).alias("mix_join"), "mix_rate", "cdf")
    own = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.withColumn("mix_join", F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))).withColumn("mix_u", hashed_uniform(seed, own))
    if tables.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(tables), "mix_join")
    else:
        tables = tables.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("mix_salt", F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int")).join(tables, ["mix_join", "mix_salt"]).drop("mix_salt")
    count = F.size(F.filter("cdf", lambda c: c < F.col("mix_u")))
    rows = rows.withColumn("mix_n", count).where("mix_n > 0").drop("cdf", "mix_u", "mix_join")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1))).drop("mix_n")
    copies = copies.withColumn("mix_key", F.xxhash64(F.lit(seed), own, F.col("copy")))
    return copies.repartition("mix_key").sortWithinPartitions("mix_key")
