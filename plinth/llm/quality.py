"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A document's evidence is a log-odds ratio, free of the labels' base rate, from a logistic regression on its whole text: shares
of capitals, signs, digits, repeated words and lines, and what its words say by learned log-odds of hashed words. Those are
counted in two folds of ids, and a document is read with the table of the other fold, so that none meets its own label there.
Hosts and paths below them have posteriors from grouped sums over all documents (a label where there is one, else the
classifier's probability): a path is shrunk towards its host, a host towards the whole, with strengths that the spread of the
groups' rates gives (method of moments). A document is left out of its own path's and host's sums. Its score is that posterior
updated by its own evidence.

Words and regression are fitted on a bounded sample: at most ``fit_rows`` labelled ids of each class, those with the smallest
hash, and at most as many rows. Features have a fixed length; texts never leave the executors, nor move between them.

Defined results: a null text is the empty one; a null host or path is a group of its own; rows without an id are scored
like others; repeated rows count as often as they occur, and each of them is left out of its own sums alone; of several labels
of an id the smallest holds; without labels of both classes the evidence is 0; an empty table gives an empty result. Extra
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.words import WordHashes
from plinth.runtime import bound_batches, materialise

FIT_ROWS = 20_000
#: Buckets of hashed words: a table has two folds of them.
BUCKETS = 1 << 14
#: Groups (hosts' paths) that are broadcast at most. Beyond it those with more than this share of the rows still are.
BROADCAST_GROUPS = 200_000
HOT_SHARE = 1e-4
#: Character classes counted in a text.
CLASSES = {"capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "shouts": b"!?", "bars": b"|", "odd signs": b"#$%&*+=@\\^_~<>{}[]", "stops": b".,;:", "lines": b"\n", "beyond ASCII": bytes(range(128, 256))}
FEATURES = len(CLASSES) + 9


def buckets(hashes: WordHashes, words: list[bytes]) -> np.ndarray:
    return (hashes.of(words) % np.uint64(BUCKETS)).astype(np.int64)


def shape(text: bytes, words: list[bytes], said: np.ndarray) -> list[float]:
    """said: the learned log-odds of each word."""
    n, size = len(words), max(len(text), 1)
    lines = [x for x in text.split(b"\n") if x]
    counts = [size - len(text.translate(None, c)) if text else 0 for c in CLASSES.values()]
    learned = [said.mean(), said.std(), (said < -1).mean(), (said > 1).mean()] if n else [0.0] * 4
    return [c / size for c in counts] + [np.log1p(n), size / max(n, 1), len(set(words)) / max(n, 1), len(set(lines)) / max(len(lines), 1), np.log1p(size / max(len(lines), 1)), *learned]


def shape_of(tables: np.ndarray) -> Callable[[Column, Column], Column]:
    """(text, fold) -> features, with the words' log-odds of the other fold."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def shapes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for texts, folds in batches:
            rows = np.zeros((len(texts), FEATURES), np.float32)
            for i, (t, fold) in enumerate(zip(texts.cast(pa.binary()), folds.to_pylist(), strict=True)):
                text = t.as_py() or b""
                words = text.split()
                rows[i] = shape(text, words, tables[1 - fold][buckets(hashes, words)])
            yield pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * FEATURES, rows.ravel())

    return shapes


def word_odds(rows: DataFrame) -> np.ndarray:
    """rows: text, y, fold. For each fold and bucket the log-odds that documents of class 1 have a word of it: smoothed counts of
    documents, summed by task and then by cell. The bucket of number BUCKETS counts the documents."""
    cells = BUCKETS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(4 * cells, np.int64)
        for batch in batches:
            for t, y, fold in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = np.unique(buckets(hashes, (t.as_py() or b"").split()))
                at = (2 * fold + y) * cells
                total[at + found] += 1
                total[at + BUCKETS] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    sums = rows.select("text", "y", "fold").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(4 * cells)
    n[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    n = n.reshape(2, 2, cells)
    share = (n[:, :, :BUCKETS] + 0.5) / (n[:, :, BUCKETS:] + 1)
    return np.log(share[:, 1] / (1 - share[:, 1])) - np.log(share[:, 0] / (1 - share[:, 0]))


def expand(x: np.ndarray) -> np.ndarray:
    """Shares are read on a root scale too, where small ones differ more."""
    return np.concatenate([x, np.sqrt(np.abs(x)), np.minimum(np.abs(x), 0.05) * 20], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Newton's method, classes weighed alike. (means, scales, weights, offset): log-odds ratios without the base rate."""
    means, scales = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.concatenate([(x - means) / scales, np.ones((len(x), 1))], axis=1)
    sizes = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w, hold = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    hold[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (sizes * (p - y)) + hold * w
        curve = (z * (sizes * p * (1 - p))[:, None]).T @ z + np.diag(hold)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return means, scales, w[:-1], float(w[-1])


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def posterior(good: Column, n: Column, prior: Column, strength: float) -> Column:
    return (good + F.lit(strength) * prior) / (n + F.lit(strength))


def strength_of(groups: DataFrame, overall: float) -> float:
    """Beta strength by moments: rates that spread more than chance alone would are trusted more."""
    m = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - overall, 2)).alias("s"), F.count(F.lit(1)).alias("k")).first()
    if not m["n"] or m["k"] < 2:
        return 10.0
    chance = overall * (1 - overall)
    between = max(m["s"] / m["n"] - chance * m["k"] / m["n"], 1e-6)
    return float(np.clip(chance / between - 1, 1.0, 10_000.0))


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined to their groups, which have a count n. A group with many rows never meets in one task: it is broadcast."""
    size = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).first()
    if size["groups"] <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), keys)
    hot = F.broadcast(groups.where(F.col("n") > HOT_SHARE * size["rows"]))
    cool = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups, keys)
    return rows.join(hot, keys).unionByName(cool)


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text", id_column: str = "doc_id", keep: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, evidence, prior, score, kept) for each row of docs. labels: (id, quality 0/1), the ones to learn from."""
    bound_batches(docs.sparkSession)
    known = labels.where("quality in (0, 1) and id is not null").select(F.col("id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("y")).groupBy("label_id").agg(F.min("y").alias("y"))
    order = [F.xxhash64("label_id", F.lit("fit")), F.col("label_id")]
    sample = materialise(known.where("y = 0").orderBy(*order).limit(fit_rows).union(known.where("y = 1").orderBy(*order).limit(fit_rows)), "sample")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.concat(F.lit("="), F.col(host).cast("string")).alias("host"), F.concat(F.lit("="), F.col(path).cast("string")).alias("path"), F.col(text).cast("string").alias("text"))
    rows = rows.fillna("", ["host", "path"]).withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(2)).cast("int"))
    odds = word_odds(rows.join(F.broadcast(sample), F.col("id") == F.col("label_id")))
    rows = materialise(rows.withColumn("shape", shape_of(odds)("text", "fold")).drop("text", "fold"), "shapes")
    fit = rows.join(F.broadcast(sample), F.col("id") == F.col("label_id")).withColumn("h", F.xxhash64("id", F.lit("fit")))
    one = [fit.where(F.col("y") == k).orderBy("h", "id").limit(fit_rows).select("shape", "y") for k in (0, 1)]
    fitted = one[0].union(one[1]).toArrow()
    y = fitted["y"].to_numpy()
    evidence = F.lit(0.0)
    if len(y) and y.min() != y.max():
        model = fit_logistic(expand(fitted["shape"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, FEATURES)), y)

        @F.arrow_udf("double")
        def ratio(shapes: pa.Array) -> pa.Array:
            means, scales, w, offset = model
            x = expand(shapes.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, FEATURES))
            return pa.array(np.clip((x - means) / scales @ w + offset, -12, 12))

        evidence = ratio("shape")
    rows = rows.join(known, F.col("id") == F.col("label_id"), "left")
    rows = materialise(rows.select("id", "host", "path", "y", evidence.alias("evidence")), "evidence")
    base = rows.agg(F.avg("y").alias("y")).first()["y"]
    base = min(max(0.5 if base is None else base, 0.01), 0.99)
    p = F.lit(1.0) / (1 + F.exp(-F.col("evidence") - float(np.log(base / (1 - base)))))
    own = F.coalesce(F.col("y").cast("double"), p)
    paths = materialise(rows.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(own).alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    overall = min(max((whole["good"] or 0.0) / (whole["n"] or 1.0), 0.001), 0.999)
    at_path, at_host = strength_of(paths, overall), strength_of(hosts, overall)
    groups = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good")), "host")
    scored = with_group(rows.withColumn("own", own), groups, ["host", "path"])
    others = posterior(F.col("host_good") - F.col("own"), F.col("host_n") - 1, F.lit(overall), at_host)
    scored = scored.withColumn("prior", posterior(F.col("good") - F.col("own"), F.col("n") - 1, others, at_path))
    score = F.lit(1.0) / (1 + F.exp(-F.col("evidence") - logit(F.col("prior"))))
    return scored.select("id", "evidence", "prior", score.alias("score")).withColumn("kept", F.col("score") >= keep)
