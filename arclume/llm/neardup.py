"""Records that share most of their words, by odd sketches.

Word sets are min-hashed. Bands of min-hashes propose pairs; each band row carries
an odd sketch, the parity bitmap into which the min-hash samples are folded. The
population count of the XOR of two sketches estimates how many samples differ, most
precisely where few do, so the join itself drops pairs that cannot be similar
enough. What remains is compared word by word, by 64-bit hashes of the words. Equal
word sets form one class beforehand; ``similar_classes`` returns classes and their
members, ``similar_pairs`` expands them to pairs of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclume.session import cut

BANDS, ROWS = 30, 6
SAMPLES, BITS = BANDS * ROWS, 384
SEED = 20250101


def word_set(text: Column) -> Column:
    """The 64-bit hashes of the distinct runs of a-z and 0-9 of the lower-cased text, sorted; null for null."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def minhash(values: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """(sets, k) min-hashes of the 64-bit ``values``; set ``i`` is ``values[offsets[i]:offsets[i+1]]`` and not empty."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, k, np.uint64)
    out = np.empty((len(offsets) - 1, k), np.uint32)
    step = 64
    for i in range(0, len(offsets) - 1, step):
        own = offsets[i : i + step + 1]
        x = values[own[0] : own[-1]].view(np.uint64)
        h = ((x[:, None] * a + b) >> np.uint64(32)).astype(np.uint32)
        out[i : i + step] = np.minimum.reduceat(h, own[:-1] - own[0], axis=0)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def odd_sketch(signature: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(sets, bits / 64) parity bitmaps: each (sample, value) toggles one bit."""
    n, k = signature.shape
    bit = (mix(signature.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount((np.arange(n)[:, None] * bits + bit).ravel(), minlength=n * bits).reshape(n, bits // 64, 64) & 1
    return (flips.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64)


def xor_limit(threshold: float, samples: int = SAMPLES, bits: int = BITS, sigmas: float = 4.0) -> int:
    """The XOR population count that a pair at ``threshold`` stays below, ``sigmas`` deviations out.

    The count varies with the number of samples that differ and with the bits they fall on.
    """
    differ = samples * (1 - threshold)
    mean = bits / 2 * (1 - math.exp(-4 * differ / bits))
    slope = 2 * math.exp(-4 * differ / bits)
    return math.ceil(mean + sigmas * math.sqrt(slope**2 * differ * threshold + bits / 16))


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per set and band: the band's hash, the class, its size, its sketch."""
    words = BITS // 64
    for b in batches:
        lists = b.column(1)
        if not b.num_rows:
            continue
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        sig = minhash(values, offsets, BANDS * ROWS)
        sketch = odd_sketch(sig[:, :SAMPLES])
        h = np.zeros((b.num_rows, BANDS), np.uint64)
        for r in range(ROWS):
            h = mix(h * np.uint64(31) + sig[:, r::ROWS])
        h = mix(h + np.arange(BANDS, dtype=np.uint64))
        rep = lambda x: np.repeat(x, BANDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.ravel().view(np.int64)), pa.array(rep(b.column(0).to_numpy())), pa.array(rep(np.diff(offsets)).astype(np.int32)), *(pa.array(rep(sketch[:, i].view(np.int64))) for i in range(words))],
            names=["band", "cls", "size", *(f"s{i}" for i in range(words))],
        )


def similar_classes(df: DataFrame, key: str, text: str, threshold: float = 0.8, least: int = 40) -> tuple[DataFrame, DataFrame]:
    """(``cls, id`` of every row that takes part; ``cls_a, cls_b, similarity`` of the classes that are similar enough).

    A class holds the rows of one word set and is named by its smallest key.
    Similarity is |A and B| / |A or B|, exact. Null texts and texts with fewer than
    ``least`` (at least 1) distinct words take no part, nor do rows with a null key.
    A candidate is missed with a chance of 2e-4 at the threshold and less above it;
    no false pair is returned.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), word_set(F.col(f"`{text}`")).alias("h")).where((F.size("h") >= max(1, least)) & F.col("id").isNotNull())
    # sets are equal if two hashes of them are
    rows = rows.select("id", "h", F.xxhash64(F.lit(1), "h").alias("d1"), F.xxhash64(F.lit(2), "h").alias("d2"))
    # one class per word set; its smallest id names it
    classes = cut(rows.groupBy("d1", "d2").agg(F.min("id").alias("cls"), F.first("h").alias("h")))
    hashes = classes.select("cls", "h")
    words = BITS // 64
    bands = hashes.mapInArrow(_band_rows, "band long, cls long, size int, " + ", ".join(f"s{i} long" for i in range(words)))
    a, b = bands.alias("a"), bands.alias("b")
    smaller, larger = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(words)))
    close = (F.col("a.cls") < F.col("b.cls")) & (smaller >= larger * threshold) & (apart <= xor_limit(threshold))
    proposed = a.join(b, (F.col("a.band") == F.col("b.band")) & close).select(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b")).distinct()

    sets = classes.select("cls", "h")
    both = proposed.join(sets.toDF("cls_a", "h_a"), "cls_a").join(sets.toDF("cls_b", "h_b"), "cls_b")
    common = F.size(F.array_intersect("h_a", "h_b"))
    # in whole numbers where they decide: |A and B| against the union
    sized = both.select("cls_a", "cls_b", common.alias("i"), (F.size("h_a") + F.size("h_b") - common).alias("u"))
    linked = sized.where(F.col("i") / F.col("u") >= threshold).select("cls_a", "cls_b", (F.col("i") / F.col("u")).alias("similarity"))

    members = rows.select("id", "d1", "d2").join(classes.select("d1", "d2", "cls"), ["d1", "d2"]).select("cls", "id")
    return members, linked


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8, least: int = 40) -> DataFrame:
    """``key_a, key_b, similarity``: all pairs of rows whose word sets are similar enough, smaller key first.

    See ``similar_classes``; rows of one class are pairs as well, so what is returned
    grows by the square of the copies, as its definition demands.
    """
    members, linked = similar_classes(df, key, text, threshold, least)
    across = linked.join(members.toDF("cls_a", "x"), "cls_a").join(members.toDF("cls_b", "y"), "cls_b").select("x", "y", "similarity")
    within = members.alias("m").join(members.alias("n"), (F.col("m.cls") == F.col("n.cls")) & (F.col("m.id") < F.col("n.id"))).select(F.col("m.id").alias("x"), F.col("n.id").alias("y"), F.lit(1.0).alias("similarity"))
    return across.unionByName(within).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"), "similarity")
