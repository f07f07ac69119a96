"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of the embeddings of its hash and of the hashes of its first letters, so that inflected words
that training never saw are near those that it saw. Filters of several widths slide over the whole text; each filter's
largest response is kept (max pooling), and a logistic unit weighs them. Training follows the gradients through the places
that won the pooling. Scores see nothing but the text. Thresholds for decisions are calibrated by language on all
labelled rows that the weights were not fitted on, from histograms of their scores; a language with few labels
takes the threshold of all.

The fit uses a bounded sample: at most ``FIT_ROWS`` toxic and twice as many other labelled rows, those with the smallest hash
of their id, so it is the same in every run, and of these the first ones that make up ``fit_bytes``; each is read whole. Where
a class is cut, the offset moves by the log-odds of the two classes' sampling rates, counted over all training labels, so that scores hold at the
labels' own base rate, not at the sample's. Scoring reads whole texts. The broadcast model has a fixed size (4 MB). For each distinct word a worker keeps what all filters make of it, so a text costs a few gathers a word.

Defined results: a null text is the empty one, whose score is the model's for no words; rows are scored one by one, so
repeated rows get equal scores; without labelled rows of both classes every score is the share of toxic labels (0 if none);
an empty table gives an empty result; columns named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm.sift import maybe_among
from plinth.runtime import bound_batches, discard, materialise, release, worker_cache

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
STEMS = (4, 5, 6)
PIECES = 1 + len(STEMS)
FIT_ROWS, FIT_BYTES, EPOCHS, BATCH = 2500, 32 << 20, 6, 32
#: Every CALIBRATE-th row of the sample sets thresholds with the rows outside of it instead of the weights.
CALIBRATE, LEAST_LABELS, SHRINK = 5, 40, 20
#: How fine the histograms of scores are.
BINS_A_LOGIT = 32
#: Words whose responses a worker keeps; beyond it the table starts anew. It only bounds memory.
KEPT_WORDS = 100_000
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "¡¿«»…“”„’‘–—"


def pieces(word: bytes) -> list[int]:
    """Buckets of a raw word: itself without the signs at its ends and in lower case, and its first letters."""
    text = word.decode("utf-8", "replace").lower().strip(EDGES)
    return [xxhash.xxh3_64_intdigest(p.encode()) % BUCKETS for p in (text, *(f"{n}^{text[:n]}" for n in STEMS))]


@dataclass
class Model:
    embeddings: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # by width: width x DIM x FILTERS
    bias: np.ndarray  # widths * FILTERS
    weights: np.ndarray
    offset: float

    def responses(self, buckets: np.ndarray) -> np.ndarray:
        """n x PIECES buckets -> what each place of each filter adds for that word."""
        e = self.embeddings[buckets].sum(axis=1)
        return np.concatenate([e @ w[j] for w in self.filters for j in range(len(w))], axis=1)

    def pooled(self, made: np.ndarray) -> np.ndarray:
        """Rows of responses(), word by word -> the largest of each filter, 0 at least."""
        out, at = [], 0
        for width in WIDTHS:
            if len(made) >= width:
                n = len(made) - width + 1
                total = made[:n, at : at + FILTERS].copy()
                for j in range(1, width):
                    total += made[j : n + j, at + j * FILTERS : at + (j + 1) * FILTERS]
                out.append(total.max(axis=0))
            else:
                out.append(np.full(FILTERS, -np.inf, np.float32))
            at += width * FILTERS
        return np.maximum(np.concatenate(out) + self.bias, 0)

    def score(self, made: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.pooled(made) @ self.weights + self.offset, -30, 30))))


def fresh(rng: np.random.Generator) -> Model:
    filters = [(rng.normal(size=(w, DIM, FILTERS)) / np.sqrt(DIM * w)).astype(np.float32) for w in WIDTHS]
    k = len(WIDTHS) * FILTERS
    return Model((rng.normal(size=(BUCKETS, DIM)) * 0.1).astype(np.float32), filters, np.zeros(k, np.float32), (rng.normal(size=k) * 0.3).astype(np.float32), 0.0)


def warm_start(model: Model, texts: list[np.ndarray], words: np.ndarray, toxic: np.ndarray) -> None:
    """Max pooling over hundreds of words learns nothing from random weights. So one dimension of the embeddings starts as the
    log-odds of a bucket's occurrence in toxic and other texts, shrunk where it is rare, and one filter of each width as its reader."""
    seen = np.zeros((2, BUCKETS))
    for own, y in zip(texts, toxic, strict=True):
        seen[int(y), np.unique(words[own])] += 1
    sizes = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    odds = np.log((seen[1] + 0.5) / (sizes[1] + 1)) - np.log((seen[0] + 0.5) / (sizes[0] + 1))
    all_seen = seen.sum(axis=0)
    model.embeddings[:, 0] = np.clip(odds * all_seen / (all_seen + 5), -3, 3) / PIECES
    for k, f in enumerate(model.filters):
        f[:, :, 0] = 0
        f[:, 0, 0] = 1 / len(f)
        model.bias[k * FILTERS] = -0.5
        model.weights[k * FILTERS] = 2
    model.offset = -2.0


def fit(texts: list[np.ndarray], words: np.ndarray, toxic: np.ndarray, seed: int = 5) -> Model:
    """texts: places in words (n x PIECES buckets). Adagrad on the logistic loss, a little decay."""
    rng = np.random.default_rng(seed)
    model = fresh(rng)
    warm_start(model, texts, words, toxic)
    square = {"e": np.full(BUCKETS, 1e-6, np.float32), "f": [np.full_like(f, 1e-6) for f in model.filters], "b": np.full_like(model.bias, 1e-6), "w": np.full_like(model.weights, 1e-6), "o": 1e-6}
    rate = 0.02
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            # What each filter's places make of the batch's distinct words, then of its texts.
            ends = np.cumsum([len(texts[i]) for i in batch])
            own, at = np.unique(np.concatenate([texts[i] for i in batch]), return_inverse=True)
            e = model.embeddings[words[own]].sum(axis=1)
            made = model.responses(words[own]) if len(own) else np.empty((0, sum(WIDTHS) * FILTERS), np.float32)
            best = np.full((len(batch), len(model.bias)), -np.inf, np.float32)
            place = np.zeros((len(batch), len(model.bias)), np.int64)
            for row, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                rest = made[at[start:end]]
                column = 0
                for k, width in enumerate(WIDTHS):
                    n = end - start - width + 1
                    if n > 0:
                        total = rest[:n, column : column + FILTERS]
                        for j in range(1, width):
                            total = total + rest[j : n + j, column + j * FILTERS : column + (j + 1) * FILTERS]
                        top = total.argmax(axis=0)
                        span = slice(k * FILTERS, (k + 1) * FILTERS)
                        place[row, span], best[row, span] = start + top, total[top, np.arange(FILTERS)]
                    column += width * FILTERS
            raw = best + model.bias
            hidden = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.weights + model.offset, -30, 30)))
            g = ((p - toxic[batch]) / len(batch)).astype(np.float32)
            back = g[:, None] * model.weights * (raw > 0)
            grad_w, grad_o, grad_b = g @ hidden, g.sum(), back.sum(axis=0)
            grad_f, rows, slopes = [np.zeros_like(f) for f in model.filters], [], []
            for k, width in enumerate(WIDTHS):
                span = slice(k * FILTERS, (k + 1) * FILTERS)
                i, c = np.nonzero(back[:, span])
                slope, won = back[:, span][i, c], place[:, span][i, c]
                for j in range(width):
                    word = at[won + j]
                    np.add.at(grad_f[k][j].T, c, slope[:, None] * e[word])
                    rows.append(words[own[word]].ravel())
                    slopes.append(slope[:, None] * model.filters[k][j].T[c])
            rows = rows if sum(map(len, rows)) else []
            if rows:
                touched, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(touched), DIM), np.float32)
                np.add.at(total, inverse, np.repeat(np.concatenate(slopes), PIECES, axis=0))
                square["e"][touched] += (total**2).mean(axis=1)
                model.embeddings[touched] -= rate * total / np.sqrt(square["e"][touched])[:, None] + 1e-4 * model.embeddings[touched]
            for f, g, s in zip(model.filters, grad_f, square["f"], strict=True):
                s += g**2
                f -= rate * g / np.sqrt(s)
            square["b"] += grad_b**2
            model.bias -= rate * grad_b / np.sqrt(square["b"])
            square["w"] += grad_w**2
            model.weights -= rate * grad_w / np.sqrt(square["w"])
            square["o"] += grad_o**2
            model.offset -= rate * grad_o / np.sqrt(square["o"])
    return model


class _Responses(dict):
    """Places of words in a growing table of responses."""

    def __init__(self, model: Model) -> None:
        self.model, self.table, self.new = model, np.empty((0, sum(WIDTHS) * FILTERS), np.float32), []

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.table) + len(self.new)
        self.new.append(pieces(word))
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) + len(words) > KEPT_WORDS and len(self):
            self.clear()
            self.table = self.table[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.table = _append(self.table, self.model.responses(np.array(self.new)).astype(np.float32))
            self.new = []
        return self.table[at]


def _append(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Grows into spare room, so that appending costs its own rows."""
    room = table.base if table.base is not None and len(table.base) - len(table) >= len(rows) else None
    if room is None:
        room = np.empty((2 * (len(table) + len(rows)) + 1024, rows.shape[1]), np.float32)
        room[: len(table)] = table
    room[len(table) : len(table) + len(rows)] = rows
    return room[: len(table) + len(rows)]


class ToxicityClassifier:
    """score(text) as a column, thresholds by language, and decisions."""

    def __init__(self, spark: SparkSession, model: Model | None, share: float, thresholds: dict[str, float], overall: float) -> None:
        bound_batches(spark)
        self.thresholds, self.overall = thresholds, overall
        # Arrays only: a broadcast isn't pickled by value, and workers may not have this package.
        shared = spark.sparkContext.broadcast((model.embeddings, model.filters, model.bias, model.weights, model.offset) if model else None)
        name = sha256(model.embeddings.tobytes() + model.weights.tobytes() + np.float64(model.offset).tobytes()).hexdigest() if model else f"share-{share}"
        fitted = model is not None

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = worker_cache(("toxicity", name), lambda: _Responses(Model(*shared.value))) if fitted else None
            for texts in batches:
                rows = (t.as_py() or b"" for t in texts.cast(pa.binary()))
                yield pa.array((known.model.score(known.of(t.split())) if known is not None else share for t in rows), pa.float64(), size=len(texts))

        self._score = score

    def score(self, text: Column) -> Column:
        return self._score(text.cast("string"))

    def threshold(self, lang: Column) -> Column:
        out = F.lit(self.overall)
        for name, at in sorted(self.thresholds.items()):
            out = F.when(lang == name, at).otherwise(out)
        return out


def best_threshold(bins: np.ndarray, weigh: np.ndarray) -> float:
    """The middle of the widest gap among thresholds of the best F1. bins: a histogram of BINS; weigh: what each of its rows counts."""
    _, place = np.unique(-bins["bin"], return_inverse=True)
    k = place.max() + 1
    s, top, n, hits = np.ones(k), np.zeros(k), np.zeros(k), np.zeros(k)
    np.minimum.at(s, place, bins["low"])
    np.maximum.at(top, place, bins["high"])
    np.add.at(n, place, weigh * bins["n"])
    np.add.at(hits, place, weigh * bins["n"] * bins["y"])
    f1 = 2 * np.cumsum(hits) / (np.cumsum(n) + hits.sum())
    below = np.append(top[1:], 0.0)
    i = np.flatnonzero(f1 >= f1.max() - 1e-12)
    i = i[np.argmax(s[i] - below[i])]
    middle = (s[i] + below[i]) / 2
    # Few toxic rows say little: the threshold is shrunk towards a half.
    toxic = (bins["n"] * bins["y"]).sum()
    odds = np.log(max(middle, 1e-6) / max(1 - middle, 1e-6)) * toxic / (toxic + SHRINK)
    return float(1 / (1 + np.exp(-odds)))


#: One row of a histogram of scores. A bin is a span of log-odds; thresholds lie between bins.
BINS = np.dtype([("y", "i8"), ("fitted", "?"), ("bin", "i8"), ("n", "i8"), ("low", "f8"), ("high", "f8")])


def calibrate(scored: DataFrame, known: DataFrame, fitted: DataFrame) -> tuple[dict[str, float], float]:
    """(thresholds by language, threshold of all) over all labelled rows (fit_id, lang, score) but those in fitted. The fit takes its
    rows by class: what it left over is weighed so that each class counts as in all rows."""
    scored = scored.where("fit_id is not null").select("fit_id", "lang", "score").join(known.select("fit_id", F.col("y").cast("long").alias("y")), "fit_id")
    scored = scored.join(F.broadcast(fitted.withColumn("fitted", F.lit(True))), "fit_id", "left").withColumn("fitted", F.coalesce("fitted", F.lit(False)))
    least = F.lit(1e-12)  # scores can be 0 or 1
    bin_of = F.floor(BINS_A_LOGIT * F.ln(F.greatest(F.col("score"), least) / F.greatest(1 - F.col("score"), least)))
    held = scored.groupBy("lang", "y", "fitted", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    held = materialise(held, "scores")

    def table(found: list) -> np.ndarray:
        return np.array([tuple(r[c] for c in BINS.names) for r in found], BINS)

    bins = table(held.groupBy("y", "fitted", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect())
    by = np.ones(2)
    for y in (0, 1):
        own = bins["y"] == y
        by[y] = bins["n"][own].sum() / max(bins["n"][own & ~bins["fitted"]].sum(), 1)
    bins = bins[~bins["fitted"]]
    overall = best_threshold(bins, by[bins["y"]]) if len(set(bins["y"].tolist())) == 2 else 0.5
    left = held.where("not fitted and lang <> ''")
    enough = left.groupBy("lang").agg(F.sum("n").alias("all"), F.min("y").alias("least"), F.max("y").alias("most")).where(f"all >= {LEAST_LABELS} and least < most")
    of: dict[str, list] = {}
    for r in left.join(enough.select("lang"), "lang").collect():
        of.setdefault(r["lang"], []).append(r)
    discard(held)
    return {lang: best_threshold(own, by[own["y"]]) for lang, own in ((k, table(v)) for k, v in sorted(of.items()))}, overall


def level(model: Model, texts: list[np.ndarray], words: np.ndarray, toxic: np.ndarray, labels: dict[int, int]) -> np.float64:
    """The offset with which the sample's scores, each row standing for as many labels of its class as it was taken from, add up to the
    toxic ones. labels: how many there are of each class."""
    pooled = np.array([model.pooled(model.responses(words[own])) @ model.weights for own in texts], np.float64)
    stands = np.array([labels[y] / max((toxic == y).sum(), 1) for y in (0, 1)])[toxic.astype(int)]
    low, high = -40.0, 40.0
    for _ in range(60):
        middle = (low + high) / 2
        over = (stands / (1 + np.exp(-np.clip(pooled + middle, -30, 30)))).sum() > (stands * toxic).sum()
        low, high = (low, middle) if over else (middle, high)
    return np.float64(round((low + high) / 2, 4))  # sums of 32-bit numbers needn't come out alike to the last bit


def fitted_on(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_bytes: int, text: str, id_column: str) -> tuple[ToxicityClassifier, DataFrame, DataFrame | None]:
    """(the classifier without thresholds, the labels by id, the ids that its weights were fitted on: None if there is nothing to learn). The
    sample is chosen among the labels, so that no other text is shuffled: its 3 * fit_rows ids at most are broadcast. Of several
    texts of an id that with the smallest hash is fitted. Which texts fit into fit_bytes is told by their lengths, a third of the
    bytes for toxic ones and the rest for others; only those that do are fetched. The offset is set by level(), so scores hold
    at the labels' own base rate whichever bound it was that cut the sample."""
    spark = docs.sparkSession
    known = labels.where("y in (0, 1) and id is not null").groupBy(F.col("id").cast("long").alias("fit_id")).agg(F.max("y").cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("fit_id", F.lit("fit")))
    rows = docs.select(F.col(id_column).cast("long").alias("fit_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = materialise(known.join(rows.select("fit_id"), "fit_id", "left_semi"), "labels")  # those without a document say nothing
    chosen = [known.where(F.col("y") == y).orderBy("h", "fit_id").limit(most) for y, most in ((1, fit_rows), (0, 2 * fit_rows))]
    told = rows.join(F.broadcast(chosen[0].union(chosen[1])), "fit_id").select("fit_id", "y", "h", F.struct(F.xxhash64("text").alias("which"), F.octet_length("text").alias("bytes")).alias("own"))
    sizes = told.groupBy("fit_id", "y", "h").agg(F.min("own").alias("own"))
    upto = Window.partitionBy("y").orderBy("h", "fit_id")  # over 2 * fit_rows rows at most, without their texts
    fits = F.sum("own.bytes").over(upto) <= F.when(F.col("y") == 1, fit_bytes // 3).otherwise(fit_bytes - fit_bytes // 3)
    picked = materialise(sizes.withColumn("fits", fits).where("fits").select("fit_id", "y", "h", F.col("own.which").alias("which")), "picked")
    fetched = rows.withColumn("which", F.xxhash64("text")).join(F.broadcast(picked), ["fit_id", "which"])
    sample = fetched.groupBy("fit_id", "y", "h").agg(F.first("text").alias("text")).toArrow().sort_by("h")
    discard(picked)
    y = sample["y"].to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        return ToxicityClassifier(spark, None, float(y.mean()) if len(y) else 0.0, {}, 0.5), known, None
    ids, hashes = sample["fit_id"].to_pylist(), sample["h"].to_numpy()
    places: dict[bytes, int] = {}
    texts = [np.array([places.setdefault(w, len(places)) for w in t.as_py().encode().split()], np.int32) for t in sample["text"]]
    words = np.array([pieces(w) for w in places] or np.empty((0, PIECES)), np.int32).reshape(-1, PIECES)
    del sample, places
    release()
    aside = np.argsort(np.argsort(hashes)) % CALIBRATE == 0
    aside &= len(set(y[~aside].tolist())) == 2  # of very few labels all are fitted
    model = fit([texts[i] for i in np.flatnonzero(~aside)], words, y[~aside])
    model.offset = level(model, texts, words, y, {r["y"]: r["count"] for r in known.groupBy("y").count().collect()})
    out = ToxicityClassifier(spark, model, float(y.mean()), {}, 0.5)
    fitted = spark.createDataFrame([(i,) for i, other in zip(ids, aside.tolist(), strict=True) if not other], "fit_id long")
    del texts, words
    release()
    return out, known, fitted


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> ToxicityClassifier:
    """labels: (id, y), y 0 or 1; of several for an id the largest holds. lang only chooses which rows set which threshold."""
    model, known, fitted = fitted_on(docs, labels, fit_rows, fit_bytes, text, id_column)
    if fitted:
        rows = docs.select(F.col(id_column).cast("long").alias("fit_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
        rows = maybe_among(rows, known, "fit_id").select("fit_id", "lang", model.score(F.col("text")).alias("score"))
        model.thresholds, model.overall = calibrate(rows, known, fitted)
    return model


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """The columns ``keep`` of docs with ``toxicity``, a struct of score, threshold (the row's language's) and toxic. Trained as by
    train(), but each text is scored only once: thresholds come from the labelled ones among the scores."""
    model, known, fitted = fitted_on(docs, labels, fit_rows, fit_bytes, text, id_column)
    own = {"fit_id": F.col(id_column).cast("long"), "fit_lang": F.col(lang).cast("string"), "fit_score": model.score(F.col(text))}
    scored = materialise(docs.select(F.struct(*keep).alias("row"), *[c.alias(k) for k, c in own.items()]), "toxicity")
    if fitted:
        model.thresholds, model.overall = calibrate(scored.select("fit_id", F.col("fit_lang").alias("lang"), F.col("fit_score").alias("score")), known, fitted)
    at = model.threshold(F.col("fit_lang"))
    said = F.struct(F.col("fit_score").alias("score"), at.alias("threshold"), (F.col("fit_score") >= at).alias("toxic"))
    return scored.select("row.*", said.alias("toxicity"))
