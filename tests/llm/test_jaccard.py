"""Components against brute force over all pairs."""

import random

import numpy as np
import pytest

from plinth.llm import components, jaccard
from plinth.llm.components import connected_components


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[j : j + 5]) for j in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(docs):
    sets = {i: sets_of(t) for i, t in docs}
    home = {i: i for i in sets}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                home[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets.items()}


def found(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {tuple(r) for r in jaccard.jaccard_components(df).collect()}


@pytest.mark.parametrize("seed, few, passes", [(0, 50, (4, 32, None)), (1, 1, (1, None)), (2, 0, (1, 2, None)), (3, 0, (None,))])
def test_random_near_copies(spark, monkeypatch, seed, few, passes):
    monkeypatch.setattr(jaccard, "FEW", few)  # 0: one round, and all the rest over whole sets
    monkeypatch.setattr(jaccard, "PASSES", passes)
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(1, 60))] for _ in range(4)]
    docs = []
    for i in range(100):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        docs.append((3 * i + 1, " ".join(words[rng.randint(0, 3) if rng.random() < 0.3 else 0 :])))
    assert found(spark, docs) == brute(docs)


@pytest.mark.parametrize("cost", [0.0, 0.0085, 0.5, 1e9])  # from probing all that may be skipped to merging all
def test_search_in_inverted_lists(monkeypatch, cost):
    monkeypatch.setattr(jaccard, "MERGE_COST", cost)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 40), replace=False), rng.integers(0, 1 << 63, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(150)]
    homes = rng.integers(0, 100, 150).tolist()
    lists = jaccard.Lists(homes, sets)
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    links = 0
    for home, own in zip(homes, sets, strict=True):
        want = [i for i in range(150) if homes[i] != home and near(own, sets[i])]
        assert lists.search(home, own) == want
        links += len(want)
    assert links > 50 and jaccard.Lists([], []).search(1, base) == []


def test_all_links_come_from_the_search(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    docs = [(i, text + f" tail{i}") for i in range(5)]
    assert {home for _, _, home in found(spark, docs)} == {0}
    monkeypatch.setattr(jaccard.Lists, "search", lambda self, home, own: [])
    assert {home for _, _, home in found(spark, docs)} == {0, 1, 2, 3, 4}


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    docs = [(5, "One two"), (3, "ONE\ttwo\x0b"), (9, None), (8, ""), (7, " \n"), (4, "one  two three four five"), (2, long), (1, long + " tail"), (6, "ÉCLAIR a b c d e"), (11, "éclair a b c d e")]
    assert found(spark, docs) == brute(docs)
    assert found(spark, [*docs, *docs]) == brute(docs)


@pytest.mark.parametrize("swap", [False, True])
def test_different_texts_of_one_id(spark, swap):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    docs = [(2, a), (2, b), (2, b.upper()), (5, a + " tail"), (7, b + " tail"), (8, b), (8, "alone"), (9, "alone")]
    got = found(spark, docs[::-1] if swap else docs)
    assert {(i, home) for i, _, home in got} == {(i, 2) for i in (2, 5, 7, 8, 9)}


def test_rows_without_id_and_empty_table(spark):
    docs = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    assert found(spark, docs) == {(None, 2, None), (1, 2, 1), (2, 2, 1)}
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string, id long, n long")).collect() == []


@pytest.mark.parametrize("few", [0, 100])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    links = [(5, 4), (4, 3), (3, 3), (9, 8), (8, 9), (3, 1), (20, 19), (19, 18), (18, 17), (17, 20)]
    out = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {tuple(r) for r in out} == {(1, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8), (17, 17), (18, 17), (19, 17), (20, 17)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
