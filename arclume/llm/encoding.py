"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Texts up to ``split_chars`` are encoded where they lie. Longer ones are halved
again and again into parts of that length, wherever the cut falls; the parts are
encoded in parallel and their ids joined pairwise up the tree. At a join the ids
of both sides are wrong only near the cut, so a window around it is encoded anew
and grows until its ends agree with the ids beyond it:

* A window that ends where the splitting pattern must end a match (a plain letter
  or digit before a blank or ASCII punctuation) is encoded as in the whole text,
  because no match crosses such a place and none looks back over it.
* In a run without such a place the window is one piece of bytes. A token sequence
  is the encoding of a piece exactly if each adjacent pair of tokens is the
  encoding of its own bytes; so once the first and last token of the new window
  equal those of the old sides, every adjacent pair of the joined sequence occurs
  in some encoding, and the join is exact.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT_CHARS = 8192


def default_vocabulary() -> str:
    """The installed rank file of byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(vocabulary: str):  # noqa: ANN201
    """The encoder of a rank file, once per process."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_AFTER = frozenset(" \n\t.,;:!?\"'()[]{}<>/\\|#*+-=_&%$@^~`")


def _plain(c: str) -> bool:
    """A letter or digit of a long-settled Unicode block."""
    return c.isascii() and c.isalnum() or "一" <= c <= "龥" or ("À" <= c <= "ɏ" or "Ѐ" <= c <= "я") and c.isalpha()


def _boundary(text: str, i: int) -> bool:
    return text[i] in _AFTER and _plain(text[i - 1])


class Part:
    """A stretch of text with its ids; ``ends`` are the byte offsets after each id."""

    def __init__(self, enc, text: str, ids: list[int] | None = None) -> None:  # noqa: ANN001
        self.enc, self.text = enc, text
        self.ids = enc.encode_ordinary(text) if ids is None else ids

    def sizes(self, ids: list[int]) -> list[int]:
        return [len(b) for b in self.enc.decode_tokens_bytes(ids)]


def _take_bytes(part: Part, n: int, from_end: bool) -> tuple[list[int], list[int]]:
    """The ids of ``part`` parted where ``n`` bytes from one end lie; that place is a token's edge."""
    ids = part.ids
    got = k = 0
    step = 64
    while got < n and k < len(ids):
        chunk = ids[len(ids) - k - step : len(ids) - k] if from_end and k + step <= len(ids) else ids[: len(ids) - k] if from_end else ids[k : k + step]
        sizes = part.sizes(chunk)
        for s in reversed(sizes) if from_end else sizes:
            if got >= n:
                break
            got += s
            k += 1
    assert got == n, "no token edge at a boundary of the pattern"
    return (ids[: len(ids) - k], ids[len(ids) - k :]) if from_end else (ids[:k], ids[k:])


def join(left: Part, right: Part, window: int = 64) -> Part:
    """The part of both texts together, as if encoded at once."""
    enc, a, b = left.enc, left.text, right.text
    if not a or not b:
        return left if not b else right
    text = a + b
    cut, size = len(a), len(text)
    # the nearest places on both sides that surely end a match
    lo, reach = None, window
    while lo is None:
        low = max(0, cut - reach)
        lo = next((i for i in range(cut - 1, max(low, 1) - 1, -1) if _boundary(text, i)), 0 if low == 0 else None)
        reach *= 4
        if reach > 64 * window and lo is None:
            break
    hi, reach = None, window
    while hi is None:
        high = min(size, cut + reach)
        # a boundary right at the cut is a join that needs no repair
        hi = next((i for i in range(max(cut, 1), high) if _boundary(text, i)), size if high == size else None)
        reach *= 4
        if reach > 64 * window and hi is None:
            break
    if hi == cut:
        return Part(enc, text, left.ids + right.ids)
    if lo is not None and hi is not None:
        head, _ = _take_bytes(left, len(a[lo:].encode()), True)
        _, tail = _take_bytes(right, len(b[: hi - cut].encode()), False)
        return Part(enc, text, head + enc.encode_ordinary(text[lo:hi]) + tail)
    # the library's own merging of one piece; without it a run is encoded whole
    if hasattr(getattr(left.enc, "_core_bpe", None), "encode_single_piece") and (run := _run(text, cut)) is not None:
        return Part(enc, text, _join_run(left, right, *run))
    # long stretches of mixed characters without a sure boundary are encoded whole
    return Part(enc, text)


def _kind(c: str) -> str:
    return "L" if c.isalpha() and _plain(c) else "N" if c.isascii() and c.isdigit() else "P" if c in _AFTER and not c.isspace() and c != "'" else "?"


def _run(text: str, cut: int) -> tuple[int, int] | None:
    """The run of one plain kind of characters around the cut, if it is a match of the pattern by itself."""
    kind = _kind(text[cut])
    if kind == "?" or _kind(text[cut - 1]) != kind:
        return None
    lo = cut
    while lo > 0 and _kind(text[lo - 1]) == kind:
        lo -= 1
    hi = cut
    while hi < len(text) and _kind(text[hi]) == kind:
        hi += 1
    # an edge next to a character of unsure kind may lie inside a match
    if lo > 0 and not (text[lo - 1] in "\n\t" or (_kind(text[lo - 1]) not in ("?", kind))):
        return None
    if hi < len(text) and not (text[hi] in " \n\t" or _kind(text[hi]) not in ("?", kind)):
        return None
    return lo, hi


def _join_run(left: Part, right: Part, lo: int, hi: int) -> list[int]:
    enc, cut = left.enc, len(left.text)
    head, x = _take_bytes(left, len(left.text[lo:].encode()), True)
    y, tail = _take_bytes(right, len(right.text[: hi - cut].encode()), False)
    w = 8
    while True:
        p, q = x[-w:], y[:w]
        new = enc._core_bpe.encode_single_piece(b"".join(enc.decode_tokens_bytes(p + q)))
        whole_left, whole_right = w >= len(x), w >= len(y)
        if (whole_left or new[0] == p[0]) and (whole_right or new[-1] == q[-1]) and (len(new) > 1 or whole_left or whole_right):
            return head + ([] if whole_left else x[:-w]) + new + ([] if whole_right else y[w:]) + tail
        w *= 2


def tree_concat(parts: list[Part]) -> Part:
    """All parts as one, joined pairwise level by level."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def halves(text: str, limit: int) -> list[str]:
    """``text`` halved until no part is longer than ``limit`` characters."""
    if len(text) <= limit:
        return [text]
    m = len(text) // 2
    return halves(text[:m], limit) + halves(text[m:], limit)


def _lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
    flat = np.fromiter((t for x in ids for t in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str | None = None, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """``key``, ``ids``: the ids of each text, without special tokens; strings of special tokens are ordinary text.

    Null and empty texts give the empty list. Every input row gives one output
    row, repeated texts and texts of any length alike; two rows with one key are
    refused only if both are longer than ``split_chars``, where the key gathers the
    parts: those rows must have distinct keys that are not null.
    """
    path = vocabulary or default_vocabulary()
    key_type = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    long = F.length("t") > split_chars

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([c.column(0), _lists([enc.encode_ordinary(t) for t in c.column(1).to_pylist()])], names=["k", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                parts = halves(t, split_chars)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(parts), b.schema.field(0).type), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["k", "part", "t"])

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _lists([enc.encode_ordinary(t) for t in b.column(2).to_pylist()])], names=["k", "part", "t", "ids"])

    def gather(own: pa.Table) -> pa.Table:
        enc = encoder(path)
        own = own.sort_by("part")
        whole = tree_concat([Part(enc, t, ids) for t, ids in zip(own["t"].to_pylist(), own["ids"].to_pylist(), strict=True)])
        return pa.table({"k": own["k"].slice(0, 1), "ids": _lists([whole.ids])})

    short = slim.where(~long).mapInArrow(encode, f"k {key_type}, ids array<int>")
    parts = slim.where(long).mapInArrow(split, f"k {key_type}, part int, t string").repartition("k", "part")
    joined = parts.mapInArrow(encode_parts, f"k {key_type}, part int, t string, ids array<int>").groupBy("k").applyInArrow(gather, f"k {key_type}, ids array<int>")
    return short.unionByName(joined).toDF(key, "ids")
