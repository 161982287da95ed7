"""Byte-level BPE encoding and decoding as a monoid tree reduction (operator 8).

A text is cut into halves until the pieces are short (``LEAF_CHARS``).  A piece is encoded on
its own; two neighbours are joined by encoding anew a window around the cut.
The window grows until both of its ends lie at a *stable* place: a space
between two letters.  The pre-token pattern can't match across such a place,
and a match depends on the text from its own start only, so the tokens
outside of the window are those of the whole text.  Where there is no such
place the window grows to the whole of both sides, which is always right.
Decoding concatenates the bytes of the pieces up the same tree.

Null text counts as empty: no tokens.  Extra columns pass through; columns
that clash with the added ones (``ids_le``, ``n_tokens``, ``decoded``) are
replaced.  Repeated rows are kept, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, give_back

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS = 512
LEAF_IDS = 128
FIRST_WINDOW = 16
_STABLE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _codec(path: str):
    """One encoder per Python worker and vocabulary, with the byte length of each id."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    codec = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = [0] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return codec, sizes


def _byte_len(text: str) -> int:
    return len(text.encode("utf-8"))


def _split_ids(ids: list[int], n_bytes: int, sizes: list[int], from_end: bool) -> int:
    """How many tokens make up the first (or last) ``n_bytes``."""
    taken = count = 0
    for i in reversed(ids) if from_end else ids:
        if taken >= n_bytes:
            break
        taken += sizes[i]
        count += 1
    return count


def _join(left: str, left_ids: list[int], right: str, right_ids: list[int], codec, sizes) -> list[int]:
    width = FIRST_WINDOW
    while True:  # the left end of the window
        at = max(0, len(left) - width)
        found = _STABLE.search(left, max(0, at - 1))
        if found or not at:
            start = found.start() if found else 0
            break
        width *= 2
    width = FIRST_WINDOW
    while True:  # its right end
        found = _STABLE.search(right, 1, width)
        if found or width >= len(right):
            stop = found.start() if found else len(right)
            break
        width *= 2
    head = len(left_ids) - _split_ids(left_ids, _byte_len(left[start:]), sizes, True)
    tail = _split_ids(right_ids, _byte_len(right[:stop]), sizes, False)
    return left_ids[:head] + codec.encode_ordinary(left[start:] + right[:stop]) + right_ids[tail:]


def tree_encode(text: str, codec, sizes, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Ids of ``text``, by halves."""
    if len(text) <= leaf_chars:
        return codec.encode_ordinary(text)
    cut = len(text) // 2
    left, right = text[:cut], text[cut:]
    return _join(left, tree_encode(left, codec, sizes, leaf_chars), right, tree_encode(right, codec, sizes, leaf_chars), codec, sizes)


def tree_decode(ids: list[int], codec, leaf_ids: int = LEAF_IDS) -> bytes:
    if len(ids) <= leaf_ids:
        return codec.decode_bytes(ids)
    cut = len(ids) // 2
    return tree_decode(ids[:cut], codec, leaf_ids) + tree_decode(ids[cut:], codec, leaf_ids)


def encode(docs: DataFrame, path: str, text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Add ``ids_le`` (the ids as little-endian unsigned 32-bit integers) and ``n_tokens``."""

    bound_batches(docs.sparkSession)

    def ids_of(texts: pa.Array) -> pa.Array:
        codec, sizes = _codec(path)
        out = pa.array((np.array(tree_encode(t.as_py() or "", codec, sizes, leaf_chars), dtype="<u4").tobytes() for t in texts), pa.binary())
        give_back()
        return out

    return docs.withColumn("ids_le", F.arrow_udf(ids_of, "binary")(F.col(text_col).cast("string"))).withColumn("n_tokens", (F.octet_length("ids_le") / 4).cast("long"))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the bytes that the ids of ``ids_le`` stand for."""

    def bytes_of(packed: pa.Array) -> pa.Array:
        codec, _ = _codec(path)
        return pa.array((tree_decode(np.frombuffer(x.as_py(), dtype="<u4").tolist(), codec) for x in packed), pa.binary())

    return tokens.withColumn("decoded", F.arrow_udf(bytes_of, "binary")("ids_le"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    coded = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    return coded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_tokens",
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), vocabulary_path())
