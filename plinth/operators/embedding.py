"""Hashed bag-of-words embeddings of unit length: packed (id, buckets, weights), or a row for each bucket (id, bucket, weight).

Two profiles, ``blake2b`` and ``md5``, give different vectors, so they are different models. A text's sums are made in an Arrow
function where the text is: only vectors leave it, and nothing is shuffled.
"""

from __future__ import annotations

from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.operators.lexical import repeated_ids, where_id
from plinth.runtime import bound_batches

PROFILES = ("blake2b", "md5")
#: Texts whose sums are held at once, 8 bytes a dimension.
TILE_ROWS = 1024
SUMS = pa.struct([("buckets", pa.list_(pa.int32())), ("sums", pa.list_(pa.float64()))])


def model_name(profile: str, dimensions: int) -> str:
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {', '.join(PROFILES)}")
    return f"hashing-bow-{dimensions}" + ("" if profile == "blake2b" else f"-{profile}")


def hashed(terms: pa.Array, profile: str, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, signs): the first four bytes of a term's digest, and whether the fifth is even."""
    each = terms.cast(pa.binary()).to_pylist()
    digests = [blake2b(t, digest_size=8).digest() for t in each] if profile == "blake2b" else [md5(t).digest() for t in each]
    data = np.frombuffer(b"".join(digests), np.uint8).reshape(len(each), -1)
    return np.ascontiguousarray(data[:, :4]).view(">u4")[:, 0].astype(np.int64) % dimensions, np.where(data[:, 4] % 2 == 0, 1.0, -1.0)


def term_sums(tokens: pa.Array, profile: str, dimensions: int) -> pa.Array:
    """Of each list of tokens the buckets and sums of its tokens and pairs of neighbours. Each distinct term of a batch is hashed once."""
    n = tokens.value_lengths().to_numpy(zero_copy_only=False)
    coded = tokens.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    own = np.repeat(np.arange(len(tokens)), n)
    inside = np.nonzero(own[1:] == own[:-1])[0]
    pairs, place = np.unique(code[inside] * len(words) + code[inside + 1], return_inverse=True)
    if not len(code):
        return pa.array([{"buckets": [], "sums": []}] * len(tokens), SUMS)
    joined = pc.binary_join_element_wise(words.take(pa.array(pairs // len(words))), words.take(pa.array(pairs % len(words))), "_")
    bucket, sign = hashed(pa.concat_arrays([words, joined]), profile, dimensions)
    which, own = np.concatenate([code, len(words) + place]), np.concatenate([own, own[inside]])
    order = np.argsort(own, kind="stable")
    which, own = which[order], own[order]
    sizes, buckets, sums = [], [], []
    for at in range(0, len(tokens), TILE_ROWS):
        rows = min(TILE_ROWS, len(tokens) - at)
        a, b = np.searchsorted(own, [at, at + rows])
        tile = np.bincount((own[a:b] - at) * dimensions + bucket[which[a:b]], weights=sign[which[a:b]], minlength=rows * dimensions).reshape(rows, dimensions)
        r, c = np.nonzero(tile)
        sizes.append(np.bincount(r, minlength=rows))
        buckets.append(c)
        sums.append(tile[r, c])
    ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
    flat = (pa.array(np.concatenate(buckets).astype(np.int32)), pa.array(np.concatenate(sums)))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, x) for x in flat], ["buckets", "sums"])


def sums_of(text: Column, profile: str, dimensions: int) -> Column:
    @F.arrow_udf("struct<buckets:array<int>,sums:array<double>>")
    def sums(tokens: pa.Array) -> pa.Array:
        return term_sums(tokens, profile, dimensions)

    return sums(T.tokens(F.coalesce(text, F.lit(""))))


def hash_vectors(rows: DataFrame, id_column: str = "chunk_id", text: str = "text", profile: str = "blake2b", dimensions: int = 768, unique: bool = False) -> DataFrame:
    """(id, buckets, weights); buckets of weight 0 and texts without terms have no entry. Texts of one id are summed, which only their
    rows are shuffled for; unique: ids are known not to repeat, and aren't counted."""
    model_name(profile, dimensions)
    bound_batches(rows.sparkSession)
    rows = rows.select(F.col(id_column), F.col(text).alias("text"))
    made = lambda part: part.select(id_column, sums_of(F.col("text"), profile, dimensions).alias("x")).select(id_column, "x.buckets", "x.sums")
    again = None if unique else repeated_ids(rows, id_column)
    if again is None:
        out = made(rows)
    else:
        each = made(where_id(rows, id_column, again, "left_semi")).select(id_column, F.explode(F.arrays_zip("buckets", "sums")).alias("x"))
        each = each.groupBy(id_column, F.col("x.buckets").alias("bucket")).agg(F.sum("x.sums").alias("w")).where("w <> 0")
        # One list, so that buckets and sums stay aligned.
        both = each.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("bucket", "w"))).alias("x"))
        out = made(where_id(rows, id_column, again, "left_anti")).unionByName(both.select(id_column, F.col("x.bucket").alias("buckets"), F.col("x.w").alias("sums")))
    norm = F.sqrt(F.aggregate("sums", F.lit(0.0), lambda s, w: s + w * w))
    weights = T.let(norm, lambda n: F.transform("sums", lambda w: w / n))
    return out.where(F.size("buckets") > 0).select(id_column, "buckets", weights.alias("weights"))


def hash_embed(rows: DataFrame, id_column: str = "chunk_id", text: str = "text", profile: str = "blake2b", dimensions: int = 768) -> DataFrame:
    """hash_vectors(), a row for each bucket: (id, bucket, weight)."""
    found = hash_vectors(rows, id_column, text, profile, dimensions)
    each = found.select(id_column, F.explode_outer(F.arrays_zip("buckets", "weights")).alias("x"))
    return each.select(id_column, F.col("x.buckets").alias("bucket"), F.col("x.weights").alias("weight"))
