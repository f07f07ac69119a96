"""Kept words against brute force over all windows."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import substrings
from plinth.llm.words import WordHashes, fingerprint


def brute(docs, window=13):
    first = {}
    for i, text in docs:
        words = (text or "").encode().split()
        for j in range(len(words) - window + 1):
            key = tuple(words[j : j + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in docs:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            if first[tuple(words[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out)


def found(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df).collect())


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_random_passages(spark, seed):
    rng = random.Random(seed)
    docs = {}
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        if docs and rng.random() < 0.6:
            other = rng.choice(list(docs.values())).split()
            at = rng.randint(0, len(other))
            words[20:20] = other[at : at + rng.randint(0, 40)]
        docs[rng.randint(0, 900)] = " ".join(words)
    rows = [*docs.items(), *list(docs.items())[:4]]
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(15_000))
    docs = [(1, None), (2, ""), (3, "a b"), (4, long), (5, long), (6, "head " + long), (7, "x\ty " + " ".join("abcdefghijklm")), (8, "É " + " ".join("abcdefghijklm") + "  z"), (4, " ".join("abcdefghijklm"))]
    assert found(spark, docs) == brute(docs)


def test_rows_without_id_clashing_names_and_empty_table(spark):
    text = " ".join("abcdefghijklmnop")
    df = spark.createDataFrame([(None, text, "k"), (1, text, "l"), (2, text, "m")], "doc_id long, text string, kept string").withColumn("repeats_note", F.lit(1))
    out = {(r.doc_id, r.n_removed, r.kept, r.repeats_note) for r in substrings.remove_repeats(df).collect()}
    assert out == {(None, 0, text, 1), (1, 0, text, 1), (2, 16, "", 1)}
    assert substrings.remove_repeats(df.limit(0)).collect() == []


def test_levels_double_until_nothing_survives(spark):
    words = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(words)), (2, "x " + " ".join(words[:30]) + " y"), (3, " ".join(f"v{i}" for i in range(40)))]
    out = substrings.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("n", F.octet_length("found") / 4)
    assert {(r.id, r.length, int(r.n)) for r in out.collect()} == {(1, 13, 18), (2, 13, 18), (1, 26, 5), (2, 26, 5)}


def by_level(docs, window):
    """(text's print, level) -> hashes of its chosen runs that another text chooses too, level by level in plain Python."""
    lengths, texts = substrings.levels(window), {}
    for _, text in docs:
        h = WordHashes().of(text.encode().split())
        values, chains = dict(zip(lengths, substrings.ladder(h, lengths), strict=True)), set()
        for at in range(len(h) - window + 1):
            chain, longer = [], window
            for length in lengths[-2::-1]:
                at = min(range(at, at + longer - length + 1), key=lambda i: (int(values[length][i]), i))
                chain.append(int(values[length][at]))
                longer = length
            chains.add(tuple(reversed(chain)))
        texts[fingerprint(h)[1]] = chains
    out, alive = {}, texts
    for i, length in enumerate(lengths[:-1]):
        having = defaultdict(set)
        for record, chains in alive.items():
            for chain in chains:
                having[chain[i]].add(record)
        alive = {r: {c for c in chains if len(having[c[i]]) > 1} for r, chains in alive.items()}
        out |= {(r, length): sorted({c[i] & 0xFFFFFFFF for c in chains}) for r, chains in alive.items() if chains}
    return out


def test_candidates_by_level(spark):
    """Texts that share 5 words survive the first level alone, those that share 9 the second one too, and only long passages the last."""
    assert substrings.levels(13) == [4, 7, 13] and substrings.levels(26) == [4, 7, 13, 26] and substrings.levels(2) == [1, 2]
    rng, docs = random.Random(7), []
    for size, copies in ((5, 40), (9, 40), (20, 4)):
        shared = [f"s{size}_{i}" for i in range(size)]
        for i in range(copies):
            words = [f"u{rng.random()}" for _ in range(40)]
            words[15:15] = shared
            docs.append((len(docs), " ".join(words)))
    rows = substrings.texts_of(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), "doc_id", "text")
    n, expected = 3, by_level(docs, 13)

    def as_lists(found, length):
        return {(r["print"], length): np.frombuffer(r.found, np.uint32).tolist() for r in found.collect()}

    seen = substrings.scan(rows, n, 13)
    first = substrings.shared_anchors(seen.where("bucket is not null").select("bucket", "c0", "c1", "c2"), n)
    level = seen.where("bucket is null").select("id", "key", "print").join(first, "print")
    second = substrings.shared_anchors(substrings.extended(substrings.candidates(rows, level), n, 13, 7), n)
    assert as_lists(first, 4) | as_lists(second, 7) == expected
    texts = {length: sum(at == length for _, at in expected) for length in (4, 7)}
    assert texts[4] > texts[7] > 4
    third, _ = substrings.lower_levels(rows, n, 13)
    last = substrings.repeated(substrings.windows(substrings.candidates(rows, third), n, 13, first=True, smaller=False), n, smaller=False)
    assert {len(np.frombuffer(r.found, np.uint32)) for r in last.collect()} == {8} and last.count() == 4


@pytest.mark.parametrize("window", [2, 3, 5, 9, 26])
def test_other_windows(spark, window):
    rng = random.Random(window)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 70)))) for i in range(30)]
    docs += [(40 + i, docs[i][1] + " z " + docs[i + 1][1]) for i in range(5)]
    out = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window=window)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()) == brute(docs, window)
