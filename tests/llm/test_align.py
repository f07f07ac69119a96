"""Cross-tokenizer alignment against a brute-force version by the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plinth.llm import align
from plinth.llm import queries as q
from plinth.llm.bpe import byte_chars

SF = "/root/testdata/sf0.001"
FILES = [open(public_tokenizers.path(name), "rb").read() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(rows, libraries):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), sorted."""
    a, b = libraries
    back = {c: x for x, c in byte_chars().items()}
    linked, count, texts = [], Counter(), []
    for i, text in rows:
        own, groups = [], []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            as_bytes = [bytes(back[c] for c in a.id_to_token(t)) for t in x]
            bs_bytes = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in y]
            if b"".join(as_bytes) == b"".join(bs_bytes) == (" " + text).encode():
                at = [0, 0]
                place = [0, 0]
                group = [[], []]
                while place[0] < len(x) or place[1] < len(y):
                    side = 0 if at[0] <= at[1] else 1
                    ids, sizes = ((x, as_bytes), (y, bs_bytes))[side]
                    group[side].append(ids[place[side]])
                    at[side] += len(sizes[place[side]])
                    place[side] += 1
                    if at[0] == at[1]:
                        groups.append(group)
                        own += [(s, t) for s in group[0] for t in group[1]]
                        group = [[], []]
        texts.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(own), hashlib.sha256(";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups).encode()).hexdigest() if groups else ""))
        linked.append(own)
        count.update(set(own))
    most = defaultdict(int)
    for (s, _), n in count.items():
        most[s] = max(most[s], n)
    out = [(*base[:5], sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), base[5]) for base, own in zip(texts, linked, strict=True)]
    return sorted(out, key=repr)


def test_query_over_the_smallest_table(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, q.op12_token_alignment(spark, SF).collect()), key=repr) == brute(rows, libraries)


CASES = [
    "", None, "a", " ", "  ", "hello world", "</s><s> <|endoftext|> <unk>", "<0x41> ▁ x", "a▁b", "naïve café — 東京タワー 🎉👩‍👩‍👧 x", "\t\n\r\n  tabs\n\n\nlines   ", "１２３ x²", "é" * 50, "\x00\x01 b", "ſt ﬁ", "的" * 300, "x" * 999, " " * 777 + "a",
]


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "tokenization", "Über", "東京", "🎉", "12", "...", "\n", "  ", "naïve", "a", "b"]
    return [rng.choice(CASES) if rng.random() < 0.2 else " ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("block, docs, group", [(10**6, 20_000, 10**6), (60, 7, 25), (1, 1, 3)])
def test_blocks_and_groups(spark, libraries, monkeypatch, block, docs, group):
    """Small bounds split hot ids over groups, and documents over blocks."""
    for name, value in (("BLOCK_POSTINGS", block), ("BLOCK_DOCS", docs), ("GROUP_POSTINGS", group), ("LISTED_PAIRS", 6 if group == 3 else 1 << 16), ("ENCODED_CHARS", 50)):
        monkeypatch.setattr(align, name, value)
    rows = [(i, t) for i, t in enumerate(CASES)] + [(i // 2 if i % 5 else None, t) for i, t in enumerate(texts(block, 120))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id int, text string, block int, n_a string").repartition(3)
    got = align.align_tokenizers(df, *FILES).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, libraries)


def test_hot_ids_are_split_evenly():
    import numpy as np

    sizes = np.array([0, 5, 1000, 3, 3, 3, 300, 0, 99])
    plan = align.Plan.of(sizes, 100)
    load = Counter()
    for a, n in enumerate(sizes):
        for k in range(plan.parts[a]):
            load[plan.first[a] + k] += n / plan.parts[a]
    assert max(load.values()) <= 200 and plan.parts.tolist() == [1, 1, 10, 1, 1, 1, 3, 1, 1] and max(load) < plan.n


def test_long_texts_and_an_empty_table(spark, libraries):
    rows = [(1, "word and 東京 " * 20_000), (2, "z" * 100_000), (3, "word")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, align.align_tokenizers(df, *FILES).collect()), key=repr) == brute(rows, libraries)
    assert align.align_tokenizers(df.limit(0), *FILES).collect() == []
    nothing = spark.createDataFrame([(None, None)] * 3, "doc_id string, text string")
    assert [tuple(r) for r in align.align_tokenizers(nothing, *FILES).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")] * 3
