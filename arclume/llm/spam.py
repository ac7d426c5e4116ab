"""Keyword-stuffed pages, link lists and tag lists.

A text is read in units, its sentences and lines. Counts over all distinct texts say
how words go together: the mean pointwise mutual information of a unit's neighbours,
normalised and without what the text itself adds to the counts, is low where words
are strung together without order. How low is told by the corpus itself, from the
distribution of all its units of that length. Sentences made only to repeat a search
phrase read well, but repeat a collocation within themselves, which ordinary
sentences do not. Words that most of their texts have in such units make up a
lexicon, by which shorter units without a repetition are known. Lists of links,
trails, tags and products show by their form. A page is spam if more than half of
its characters are in such units.

No count is cut off and none is sent to every task: texts are parted by their hash,
each part's words and neighbours get their counts by one window over all parts, and
come back to the part's texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arclume.llm.tokens import WORD, Tokens, lex, mix
from arclume.session import cut

DIGIT = re.compile(r"\d")
TOKEN = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+(?:['’-][^\W\d_一-鿿]+)*|\d+")
LINK = re.compile(r"(?:https?://|www\.)\S+|<a\s[^<>]*>|</a>|\]\([^()\s]*\)", re.I)
PATH = re.compile(r"\b[A-Za-z]:\\\S+")
UNIT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？；])|;\s+|\n+")
MARKS = re.compile(r"\s[>»›→/|]\s")
MARK = re.compile(r"[>»›→/|]")
HASH = re.compile(r"(?<!\S)#[^\W_][\w-]*")
COUNTED = re.compile(r"[\w-]+ ?\(\d+\)")
SKU = re.compile(r"\b(?:sku|art\.?|ean) ?\d+", re.I)

#: How often a collocation in one unit is excessive without any word of the lexicon.
OFTEN = 4
#: Share of all words from which a word is too common to be a search phrase.
COMMON = 3e-3
REPEATED, LEXICAL, DENSE, AGAIN = 0.3, 0.6, 0.4, 0.25
#: Words of a unit whose information is judged, other texts a word needs to be known, and the share of a unit's neighbours that must be.
LEAST, KNOWN, MOST_KNOWN = 12, 4, 0.8
#: A unit is incoherent below 0 and so many deviations below the median of its length, of which there must be enough units.
DEVIATIONS, ENOUGH = 4.0, 200
HALF = 0.5
#: Entries that a task counts before it passes them on.
HELD = 500_000


def units(text: str) -> list[str]:
    """The sentences and lines of a text that are not blank."""
    return [u for u in (x.strip() for x in UNIT.split(text)) if u]


def linked(unit: str) -> bool:
    """Whether a unit may hold a link; most do not, and need no closer look."""
    return "://" in unit or "](" in unit or "<" in unit or "www." in unit.lower()


def solid(text: str) -> int:
    """Characters without blanks."""
    return sum(map(len, text.split()))


def words(unit: str) -> list[str]:
    """Lower-cased words without links; numbers are all one word, ideographs one each."""
    if "\\" in unit:
        unit = PATH.sub(" ", unit)
    ws = TOKEN.findall((LINK.sub(" ", unit) if linked(unit) else unit).lower())
    return ["0" if w[0].isdigit() else w for w in ws] if DIGIT.search(unit) else ws


def form(unit: str, ws: list[str]) -> bool:
    """Whether the unit is a list of links, a trail, tags, tag counts or a product tag by its form."""
    if linked(unit) and (links := LINK.findall(unit)):
        rest = LINK.sub(" ", unit).strip()
        if len(ws) <= 6 * len(links) and rest[-1:] not in (".", "!", "?", ")"):
            return True
    marks = len(MARKS.findall(unit)) if MARK.search(unit) else 0
    if marks >= 2 and len(ws) <= 8 * marks or "0" in ws and SKU.search(unit):
        return True
    if "#" in unit and sum(map(len, HASH.findall(unit))) >= 0.6 * solid(unit):
        return True
    counted = COUNTED.findall(unit) if "(" in unit else []
    return len(counted) >= 2 and sum(map(len, counted)) >= 0.6 * solid(unit)


def repeated(ws: list[str], common: frozenset[str]) -> tuple[float, int]:
    """Share of a unit's words that lie in collocations repeated within it, and how often the most frequent one occurs."""
    n = len(ws)
    if n < 4 or len(set(ws)) == n:
        return 0.0, 0
    count = Counter(ws)
    # only words that occur again can be part of what occurs again
    again = [count[w] > 1 and w != "0" for w in ws]
    covered, most = bytearray(n), 0
    for size in (2, 3):
        at: dict[tuple, list[int]] = {}
        for i in range(n - size + 1):
            if again[i] and again[i + 1] and (size == 2 or again[i + 2]):
                g = tuple(ws[i : i + size])
                cjk = sum("一" <= w <= "鿿" for w in g)
                if cjk == (0 if size == 2 else 3):
                    at.setdefault(g, []).append(i)
        for where in at.values():
            if len(where) > 1:
                most = max(most, len(where))
                for i in where:
                    covered[i : i + size] = b"\1" * size
    for w, c in count.items():
        if c >= 3 and len(w) >= 5 and w not in common:
            for i, x in enumerate(ws):
                if x == w:
                    covered[i] = 1
    return sum(covered) / n, most


def bucket(n: int) -> int:
    """The class of lengths that a unit of ``n`` words is of, by doublings."""
    return n.bit_length()


def neighbours(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in the column, hash of both, of the first, of the second) of every two words in a row; numbers are no words."""
    at = np.flatnonzero((t.row[1:] == t.row[:-1]) & (t.kind[1:] == WORD) & (t.kind[:-1] == WORD))
    a, b = t.hash[at], t.hash[at + 1]
    return t.row[at], mix(a * np.uint64(3) + mix(b + np.uint64(5))), mix(a + np.uint64(1)), mix(b + np.uint64(1))


class Part:
    """What the counts of all texts say about the words of some of them."""

    def __init__(self, words_: dict[str, tuple[int, int, int]], hashes: np.ndarray, texts_with: np.ndarray) -> None:
        """``words_``: occurrences, texts, and texts with a suspect unit; "" holds all words and texts. ``hashes``: of words and neighbours, and how many texts have each."""
        total, self.texts, _ = words_.get("", (0, 0, 0))
        order = np.argsort(hashes)
        self.hashes, self.texts_with = hashes[order], texts_with[order]
        single = [(k, c) for k, c in words_.items() if k]
        self.common = frozenset(k for k, (n, _, _) in single if n >= total * COMMON)
        # by texts, so that no one page decides
        self.lexicon = frozenset(k for k, (_, d, s) in single if k != "0" and s >= max(3, 0.6 * d))

    def others(self, h: np.ndarray) -> np.ndarray:
        """How many texts but the one that is judged have what is hashed to ``h``."""
        if not len(self.hashes):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.texts_with[at] - 1.0, 0.0)

    def information(self, units_: list[str]) -> np.ndarray:
        """Mean normalised pointwise mutual information of each unit's neighbours, -1 to 1; a unit is its words with blanks between.

        The text that is judged is left out of the counts, so neighbours that no
        other text has score -1. NaN where too few neighbours are words that other
        texts have, as in names, codes or a language hardly met.
        """
        total, n, sums = max(self.texts, 2), np.zeros(len(units_)), np.zeros(len(units_))
        for t in lex(pa.array(units_, pa.string())):
            row, both, one, two = neighbours(t)
            na, nb = self.others(one), self.others(two)
            known = (na >= KNOWN) & (nb >= KNOWN)
            row, na, nb, nab = row[known], na[known], nb[known], self.others(both[known])
            seen = nab > 0
            score = np.full(len(row), -1.0)
            score[seen] = np.clip(np.log(nab[seen] * total / (na[seen] * nb[seen])) / np.maximum(-np.log(nab[seen] / total), 1e-9), -1, 1)
            n += np.bincount(row, minlength=len(units_))
            sums += np.bincount(row, weights=score, minlength=len(units_))
        enough = n >= np.maximum(1, MOST_KNOWN * np.array([u.count(" ") for u in units_]))
        return np.where(enough, sums / np.maximum(n, 1), np.nan)

    def spam(self, ws: list[str], again: bool) -> bool:
        """Whether a unit that is no list is made for search engines, by its words or its repetitions; without ``again`` it repeats too little whatever is common."""
        known = [w for w in ws if w in self.lexicon]
        if known:
            share = len(known) / len(ws)
            if share >= LEXICAL or share >= DENSE and len(ws) >= 4:
                return True
            if share >= AGAIN and len(set(known)) < len(known):
                return True
        if not again:
            return False
        # a collocation said twice may be an accident of the story; with a word of the lexicon, or said often, it is not
        share, most = repeated(ws, self.common)
        return share >= REPEATED and (bool(known) or most >= OFTEN)

    def judge(self, texts: Iterable[list[tuple[str, int, bool, bool]]]) -> tuple[list[list], Counter]:
        """([characters, those in spam units, (class, information, characters) of other units that may be incoherent] of each text, units by class and hundredth of information).

        A text is its units: words, characters, whether it is a list by its form, and whether it repeats itself.
        """
        rows, open_, of = [], [], []
        for i, text in enumerate(texts):
            whole = bad = 0
            for w, n, listed, again in text:
                ws = w.split(" ") if w else []
                whole += n
                if listed or ws and self.spam(ws, again):
                    bad += n
                elif len(ws) >= LEAST:
                    open_.append(w)
                    of.append((i, bucket(len(ws)), n))
            rows.append([whole, bad, []])
        spread: Counter = Counter()
        for (i, c, n), score in zip(of, self.information(open_).tolist()):
            if score == score:
                spread[c, int((score + 1) * 50)] += 1
                if score < 0:
                    rows[i][2].append((c, score, n))
        return rows, spread


_UNIT = pa.struct([("w", pa.string()), ("n", pa.int32()), ("f", pa.bool_()), ("a", pa.bool_())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``h, part, units``: the texts as units, each with its words (``w``), its characters, whether it is a list by its form and whether it repeats itself."""
    nothing = frozenset()
    for b in batches:
        cols: tuple[list, ...] = ([], [], [], [])
        ends = [0]
        for t in b.column(2).to_pylist():
            for u in units(t):
                ws = words(u)
                for c, v in zip(cols, (" ".join(ws), solid(u), form(u, ws), repeated(ws, nothing)[0] >= REPEATED), strict=True):
                    c.append(v)
            ends.append(len(cols[0]))
        flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _UNIT)], names=[f.name for f in _UNIT])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["h", "part", "units"])


def _of_texts(column: pa.Array) -> list[list[tuple[str, int, bool, bool]]]:
    """The units of each text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_pylist()
    flat = column.values
    all_ = list(zip(*(flat.field(i).to_pylist() for i in range(4))))
    return [all_[i:j] for i, j in zip(ends, ends[1:])]


def _dedupe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task without further copies of a text, known by the hash in the first column."""
    seen: set[int] = set()
    for b in batches:
        at = []
        for i, h in enumerate(b.column(0).to_pylist()):
            if h not in seen:
                seen.add(h)
                at.append(i)
        yield b.take(pa.array(at, pa.int64()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part, k, g, n, d, s`` of the words (``k``) and of hashed words and neighbours (``g``) of a task's texts, a text of several copies once."""
    held: dict[int, tuple[Counter, Counter, Counter]] = {}

    def given() -> pa.RecordBatch:
        rows = [(p, k, 0, c, d[k], s[k]) for p, (n, d, s) in held.items() for k, c in n.items()]
        held.clear()
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _COUNTED, strict=True)], names=["part", "k", "g", "n", "d", "s"])

    for b in _dedupe(batches):
        parts, plain = b.column(1).to_numpy(), []
        for part, text in zip(parts.tolist(), _of_texts(b.column(2))):
            n, d, s = held.setdefault(part, (Counter(), Counter(), Counter()))
            all_ = " ".join([w for w, _, _, _ in text if w]).split()
            n.update(all_)
            n[""] += len(all_)
            d.update({"", *all_})
            s.update({x for w, _, listed, again in text if listed or again for x in w.split()})
            # marks keep the neighbours of two units apart
            plain.append(" . ".join([w for w, _, _, _ in text]))
        for t in lex(pa.array(plain, pa.string())):
            row, both, _, _ = neighbours(t)
            at = np.flatnonzero(t.kind == WORD)
            row, h = np.concatenate([row, t.row[at]]), np.concatenate([both, mix(t.hash[at] + np.uint64(1))])
            order = np.lexsort((row, h))
            row, h = row[order], h[order]
            once = np.ones(len(row), bool)
            once[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            part, h = parts[row[once]], h[once]
            order = np.lexsort((h, part))
            part, h = part[order], h[order]
            begin = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
            d, zero = np.diff(np.append(begin, len(h))), pa.array(np.zeros(len(begin), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(part[begin], pa.int32()), pa.nulls(len(begin), pa.string()), pa.array(h[begin].view(np.int64)), zero, pa.array(d), zero], names=["part", "k", "g", "n", "d", "s"])
        if sum(len(n) for n, _, _ in held.values()) > HELD:
            yield given()
    yield given()


_COUNTED = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def _judge(texts: pa.Table, counts: pa.Table) -> pa.Table:
    """Each text of a part judged by the counts of the part's words; the last row has the part's units by class and information."""
    hashed = np.asarray(counts["k"].is_null())
    spelt = counts.filter(pa.array(~hashed))
    words_ = dict(zip(spelt["k"].to_pylist(), zip(*(spelt[c].to_pylist() for c in ("n", "d", "s")))))
    part = Part(words_, counts["g"].to_numpy()[hashed].view(np.uint64), counts["d"].to_numpy()[hashed])
    h, first = np.unique(texts["h"].to_numpy(), return_index=True)
    rows, spread = part.judge(_of_texts(texts["units"].take(pa.array(first))))
    item = pa.struct([("c", pa.int32()), ("w", pa.float64()), ("n", pa.int64())])
    low = [[{"c": c, "w": w, "n": n} for c, w, n in r[2]] for r in rows]
    seen = [{"c": c, "w": float(at), "n": n} for (c, at), n in spread.items()]
    return pa.table(
        {
            "h": pa.array([*h.tolist(), None], pa.int64()),
            "whole": pa.array([*(r[0] for r in rows), None], pa.int64()),
            "bad": pa.array([*(r[1] for r in rows), None], pa.int64()),
            "units": pa.array([*low, seen], pa.list_(item)),
        }
    )


def limits(spread: dict[tuple[int, int], int]) -> dict[int, float]:
    """For each class of lengths the information below which a unit is incoherent, from the units by class and hundredth.

    A class of few units takes the limit of the next shorter one.
    """
    out: dict[int, float] = {}

    def median(values: list[tuple[float, int]]) -> float:
        half, run = sum(n for _, n in values) / 2, 0
        for v, n in sorted(values):
            run += n
            if run >= half:
                return v
        return 0.0

    for c in sorted({c for c, _ in spread}):
        at = [(i / 50 - 1 + 0.01, n) for (k, i), n in spread.items() if k == c]
        if sum(n for _, n in at) < ENOUGH and out:
            out[c] = out[max(out)]
            continue
        middle = median(at)
        deviation = 1.4826 * median([(abs(v - middle), n) for v, n in at])
        out[c] = min(0.0, middle - DEVIATIONS * max(deviation, 0.02))
    return out


def labels(spark: SparkSession, parts: int) -> list[int]:
    """A number for each part that hashes to a partition of its own, so that no task gets two parts and another none."""
    hashed = spark.range(0, 24 * parts).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"))
    got = sorted((r.p, r.i) for r in hashed.groupBy("p").agg(F.min("i").alias("i")).collect())
    taken = {i for _, i in got}
    return ([i for _, i in got] + [i for i in range(-parts, 0) if i not in taken])[:parts]


def judge_texts(df: DataFrame, text: str) -> tuple[DataFrame, dict[int, float]]:
    """(``h, whole, bad, units`` of every distinct text, the limits of information); ``h`` is the text's hash."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    t = F.col(f"`{text}`").cast("string")
    part = F.element_at(F.lit(labels(spark, parts)), F.pmod(F.xxhash64(t, F.lit(1)), F.lit(parts)).cast("int") + 1)
    # copies are dropped before anything is moved, so that no text fills a part
    slim = df.select(F.xxhash64(t).alias("h"), part.cast("int").alias("part"), t.alias("t")).where("t is not null").mapInArrow(_dedupe, "h long, part int, t string")
    placed = slim.mapInArrow(_cut, "h long, part int, units array<struct<w: string, n: int, f: boolean, a: boolean>>").repartition(parts, "part")
    every = Window.partitionBy("k", "g")
    counts = placed.mapInArrow(_count, "part int, k string, g long, n long, d long, s long").select("part", "k", "g", *[F.sum(c).over(every).alias(c) for c in "nds"])
    judged = cut(placed.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(_judge, "h long, whole long, bad long, units array<struct<c: int, w: double, n: long>>"))
    # a hundred entries for each doubling of length
    seen = judged.where("h is null").select(F.explode("units").alias("u")).groupBy("u.c", "u.w").agg(F.sum("u.n").alias("n")).collect()
    return judged.where("h is not null"), limits({(r.c, int(r.w)): r.n for r in seen})


def find_spam(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``share`` of the texts more than half of which is made for search engines.

    Null, empty and blank texts are none. Each text is judged whole, by itself and
    the counts of the corpus, in which copies count once; repeated rows are judged
    alike. An empty table gives no rows.
    """
    judged, limit = judge_texts(df, text)
    salad = F.aggregate("units", F.lit(0).cast("long"), lambda s, u: s + F.when(reduce(lambda x, y: x | y, [(u["c"] == c) & (u["w"] < at) for c, at in limit.items()], F.lit(False)), u["n"]).otherwise(0))
    found = judged.where("whole > 0").select("h", ((F.col("bad") + salad) / F.col("whole")).alias("share")).where(F.col("share") > HALF)
    rows = df.select(F.col(f"`{key}`").alias("k"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("h"), F.col(f"`{text}`").isNotNull().alias("there")).where("there")
    return rows.join(found, "h").select(F.col("k").alias(key), "share")
