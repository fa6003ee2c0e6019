"""Packing by power-of-two decomposition.

A document of n token ids is cut into as many pieces of the maximal length as fit and then into one piece for
each bit of the rest, longest first. Every piece has a power of two as its length and is a sequence of its own, so
no sequence crosses documents and none needs padding. Pieces of one length form a bucket; batches are drawn from
one bucket at a time.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import CACHES, documents, let_go, map_batches

#: Ids of this many words are kept in each Python worker; then the store starts anew.
CACHED_WORDS = 250_000
#: A space beside other white space: there the tokenizer's split depends on both, so such texts are encoded whole.
_UNEVEN = re.compile(r" [^\S\x1c-\x1f]|[^\S\x1c-\x1f] |^ | $")


class _Words(dict):
    """Little-endian ids of a space-separated word, by word; computed when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[word] = np.array(self.encode(word), "<u4").tobytes()
        return ids


class ByteBpe:
    """Ids of whole texts as bytes.

    ``tokenizer`` is a file of the tokenizers library. ``ranks`` may name the same vocabulary as tiktoken ranks:
    texts are then split at single spaces (where the tokenizer splits too), and each word is encoded once.
    """

    def __init__(self, tokenizer: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.first = self.rest = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                by_rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=by_rank, special_tokens={})
            self.plain = own.encode_ordinary
            self.rest = _Words(lambda word: own.encode_ordinary(" " + word))

    def __call__(self, text: str) -> bytes:
        if self.rest is None or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _UNEVEN.search(text):
            return np.array(self.plain(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.plain(first), "<u4").tobytes() + b"".join(map(self.rest.__getitem__, rest))


@lru_cache(1)
def _tokenizer(tokenizer: str, ranks: str | None, pattern: str | None) -> ByteBpe:
    found = ByteBpe(tokenizer, ranks, pattern)
    let_go(keep=True)  # reading the files takes twice what stays
    return found


CACHES.append(lambda: _tokenizer.cache_clear())

def pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: powers of two, at most ``most``, which is one itself."""
    found, start = [], 0
    while n - start:
        length = min(most, 1 << (n - start).bit_length() - 1)
        found.append((start, length))
        start += length
    return found


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 1024,
    end_id: int = 0,
) -> DataFrame:
    """Sequences of the documents: doc_id, start, length, ids (little-endian unsigned 32-bit, binary), doc_tokens,
    bucket (log2 of length), sequence_id, offset (0: a sequence is one piece).

    Null and empty texts are the end id alone. A null doc_id stays null. Repeated rows are packed each. Whole texts
    are encoded; other columns are ignored. An empty table gives no rows. One pass, no shuffle.
    """
    if max_tokens & max_tokens - 1 or max_tokens < 1:
        raise ValueError("max_tokens must be a power of two")

    def run(batch: pa.RecordBatch):
        encode, end = _tokenizer(tokenizer, ranks, pattern), np.array([end_id], "<u4").tobytes()
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens")}
        held = 0
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            ids = encode(text.as_py() or "") + end
            for start, length in pieces(len(ids) // 4, max_tokens):
                for k, v in zip(out, (doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4), strict=True):
                    out[k].append(v)
            held += len(ids)
            if held > 8_000_000:
                yield out
                out, held = {k: [] for k in out}, 0
        yield out

    found = map_batches(documents(docs, id_col, text_col), run, "doc_id long, start long, length long, ids binary, doc_tokens long", keep=True)
    return found.select(
        "*",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length, so that a reader can form batches of equal sequences without padding."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)
