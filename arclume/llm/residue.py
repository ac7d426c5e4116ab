"""Template residue and error-page text instead of content.

Records of one source follow a template: runs of words that a fair share of them
agree in, with slots between. Every three tokens in a row are an anchor of this
alignment: those common in a source are its template's, all others are what its
slots hold. What slots should hold differs from source to source. A run that stands
in the slots of several sources' templates is content of neither: the default of a
slot, filler, a page or a notice, repeated wherever something failed. Such runs are
induced from counts over all texts and found again wherever they stand, so no
wording of them is known beforehand.

Beside runs, slots retain the names of their variables: an identifier between marks.
Its notation is surely one where the marks are several or the identifier is written
as one; a name that records hold in a sure notation, or in several, is a variable's
in any other notation as well. Filler also shows by its form: a word said three times
in a row, words of one letter, and a few dummy words. What stands in quotation marks
is depicted and left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclume.llm.tokens import END, MARK, NUMBER, START, WORD, Tokens, lex, mix
from arclume.session import cut

# Dummy words.
FILLER = ["lorem", "ipsum", "dolor", "amet", "consectetur", "foo", "bar", "baz", "qux", "asdf", "qwerty", "hjkl", "tbd", "fixme", "todo", "xxx", "blah", "dummy"]

#: Share of a source's texts from which a run is its template's, if they are distinct enough.
COMMON, DISTINCT = 0.05, 90
#: Bits of the filter for induced runs, an entry, and at most; what passes it is looked up in the table of runs.
PER_RUN, MOST_BITS = 16, 1 << 27

QUOTED = r'"[^"\n]{0,200}"|“[^“”\n]{0,200}”|„[^„“”\n]{0,200}[“”]'
QUOTED_ONCE = r"(^|[\s(,.;:])'[^'\n]{3,200}'"
_OPEN, _CLOSE = r"[\[{<%$#@~|«^]", r"[\]}>%$#@~|»=^)]"
HELD = re.compile(rf"(?<!\w)(?P<o>{_OPEN}(?:[\[{{<%$#@~|«^=(]){{0,2}}|__)\s*(?P<n>(?:[A-Za-z]+ ){{0,2}}?[A-Za-z][A-Za-z0-9_]{{0,59}}?(?: [A-Za-z]+)?)\s*(?P<c>{_CLOSE}{{1,3}}(?:s(?![A-Za-z0-9]))?|__(?![a-z0-9]))")
_MIRROR = {"{": "}", "[": "]", "<": ">", "(": ")", "«": "»"}


def closes(opening: str, closing: str) -> bool:
    """Whether the marks after a name answer those before it."""
    mirrored = "".join(_MIRROR.get(c, c) for c in reversed(opening.rstrip("=")))
    plain = closing.removesuffix("s") if opening.endswith("(") else closing
    # "${x}" ends by its last mark alone, and so does "%(x)s"
    return plain == mirrored or (len(opening) > 1 and opening[-1] in _MIRROR and plain == _MIRROR[opening[-1]])


def base(name: str) -> str:
    """A name without case and the number at its end."""
    return re.sub(r"_?\d+$", "", name.lower())


def names(text: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(name, notation, surely a variable's, alone between the marks) of what stands between marks."""
    for m in HELD.finditer(text):
        if closes(m["o"], m["c"]):
            words = m["n"].split()
            alone = len(words) == 1
            if not alone and m.start("n") > m.end("o"):
                continue  # several words stand close to the marks, or they are only compared or counted
            shaped = any("_" in w for w in words)
            for w in words:
                yield base(w), m["o"] + " " + m["c"], shaped or (alone and len(m["o"]) > 1), alone


def depicted(texts: pa.Array) -> pa.Array:
    """Texts without what stands in quotation marks."""
    return pc.replace_substring_regex(pc.replace_substring_regex(texts, QUOTED, ' " '), QUOTED_ONCE, '\\1 " ')


def runs(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash, whether it counts alone) of every three tokens that hold two words, and of every sentence without blanks.

    Marks and ends are all alike, so a slot's whole filling is found between others.
    """
    loose = (t.kind == MARK) | (t.kind == START) | (t.kind == END)
    h = np.where(loose, np.uint64(MARK), t.hash)
    word = (t.kind == WORD).astype(np.int8)
    wide = np.flatnonzero(t.wide)
    n = max(0, len(t.row) - 2)
    at = np.flatnonzero((t.row[:n] == t.row[2:]) & (word[:n] + word[1 : n + 1] + word[2:] >= 2)) if n else np.zeros(0, np.int64)
    three = mix(h[at] * np.uint64(3) + mix(h[at + 1] * np.uint64(5) + mix(h[at + 2] + np.uint64(7))))
    alone = np.concatenate([loose[at] | loose[at + 1] | loose[at + 2], np.ones(len(wide), bool)])
    return np.concatenate([t.row[at], t.row[wide]]), np.concatenate([at, wide]), np.concatenate([three, mix(h[wide] + np.uint64(11))]), alone


def _dummies() -> np.ndarray:
    return np.concatenate([t.hash[t.kind == WORD] for t in lex(pa.array(FILLER or [""]))])


def filled(t: Tokens, dummies: np.ndarray) -> np.ndarray:
    """Texts that hold filler by its form."""
    at = np.flatnonzero(t.kind != MARK)
    row, h, word = t.row[at], t.hash[at], t.kind[at] == WORD
    long, same = word & (t.length[at] > 1), t.same[at]
    dummy = word & np.isin(h, dummies)
    twice = (row[1:] == row[:-1]) & ((same[1:] & same[:-1]) | (dummy[1:] & dummy[:-1]))
    thrice = (row[2:] == row[:-2]) & long[2:] & (h[2:] == h[1:-1]) & (h[1:-1] == h[:-2])
    return np.unique(np.concatenate([row[1:][twice], row[2:][thrice]]))


def _texts(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(source, hash, text) of the distinct texts of a batch, depictions left out."""
    th, first = np.unique(b.column(1).to_numpy(), return_index=True)
    return b.column(0).take(pa.array(first)), th, depicted(b.column(2).take(pa.array(first)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a source hold each run, and a bitmap of which; run 0 stands for any text."""
    for b in batches:
        if not b.num_rows:
            continue
        src, th, texts = _texts(b)
        code = src.dictionary_encode()
        source, bit = code.indices.to_numpy(), np.uint64(1) << (mix(th.view(np.uint64)) % np.uint64(64))
        keys = [(source.astype(np.int64), np.zeros(len(th), np.uint64), bit)]
        for t in lex(texts):
            row, _, h, _ = runs(t)
            order = np.lexsort((row, h))
            row, h = row[order], h[order]
            once = np.ones(len(row), bool)
            once[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            row, h = row[once], h[once]
            keys.append((source[row].astype(np.int64), h, bit[row]))
        s, h, bit = (np.concatenate(c) for c in zip(*keys, strict=True))
        order = np.lexsort((h, s))
        s, h, bit = s[order], h[order], bit[order]
        begin = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (h[1:] != h[:-1])]))
        n = np.diff(np.append(begin, len(s)))
        yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(s[begin])), pa.array(h[begin].view(np.int64)), pa.array(n), pa.array(np.bitwise_or.reduceat(bit, begin).view(np.int64))], names=["src", "g", "n", "bits"])


def induced_runs(texts: DataFrame) -> DataFrame:
    """``g``: the runs that the slots of several sources hold; ``texts`` are ``src, th, t``."""
    each = texts.mapInArrow(_count, "src string, g long, n long, bits long").groupBy("src", "g").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"))
    # an entry per source in each list
    across = cut(each.groupBy("g").agg(F.collect_list(F.struct("src", "n", "bits")).alias("of")).where((F.size("of") > 1) | (F.col("g") == 0)))
    total = {s["src"]: s["n"] for r in across.where("g = 0").collect() for s in r.of}
    if len(total) < 2:
        return across.where("false").select("g")
    whole = F.create_map(*[F.lit(x) for kv in total.items() for x in kv])
    # linear counting; a full bitmap is of some 270 texts or more
    texts_with = lambda x: F.when(F.bit_count(x["bits"]) > 63, 270.0).otherwise(-64 * F.log1p(-F.bit_count(x["bits"]) / 64))
    fixed = lambda x: (x["n"] >= COMMON * whole[x["src"]]) & (texts_with(x) >= F.least(F.lit(float(DISTINCT)), COMMON * whole[x["src"]]))
    return across.where((F.col("g") != 0) & ~F.exists("of", fixed)).select("g")


def _bits(g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = g.view(np.uint64)
    return (h % np.uint64(size)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


def _filter(runs_: DataFrame) -> np.ndarray:
    """Bits of which two are set for every run; at most ``MOST_BITS``, however many runs there are."""
    size = int(min(MOST_BITS, max(1 << 16, 1 << (PER_RUN * max(1, runs_.count()) - 1).bit_length())))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = np.concatenate(_bits(b.column(0).to_numpy(), size))
            yield pa.RecordBatch.from_arrays([pa.array(bit // 32), pa.array(np.int64(1) << (bit % 32))], names=["word", "bits"])

    got = runs_.mapInArrow(set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 32, np.uint32)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return out


def find_residue(df: DataFrame, keys: list[str], text: str, source: str | None = None) -> DataFrame:
    """``keys`` of the rows whose text is or contains template residue, filler, an error page or a script notice.

    ``source`` says which rows follow one template (few values); without it, or with
    one value, no runs are induced and names and filler remain. All of each text is
    read and counted. Null, empty and blank texts are no residue, nor is a slot left
    blank, nor what stands in quotation marks. Copies of a text count once where
    they are met together, and are all returned; ``keys`` are returned once. An empty
    table gives no rows.
    """
    spark = df.sparkSession
    k = [f"k{i}" for i in range(len(keys))]
    t = F.col("t")
    src = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")) if source else F.lit("")
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k, strict=True)], src.alias("src"), F.col(f"`{text}`").cast("string").alias("t")).where(t.isNotNull() & t.rlike(r"\S"))
    rows = rows.withColumn("th", F.xxhash64("src", "t"))
    texts = rows.select("src", "th", "t")

    induced = cut(induced_runs(texts))
    shared = spark.sparkContext.broadcast((_filter(induced), _dummies()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, dummies = shared.value
        size = len(bits) * 32
        for b in batches:
            if not b.num_rows:
                continue
            _, th, own = _texts(b)
            for s in lex(own):
                row, at, h, loose = runs(s)
                met = np.ones(len(h), bool)
                for bit in _bits(h, size):
                    met &= (bits[bit // 32] >> (bit % 32).astype(np.uint32) & 1).astype(bool)
                sure = filled(s, dummies)
                n = len(sure)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([th[row[met]], th[sure]])), pa.array(np.concatenate([at[met], np.zeros(n, np.int64)])), pa.array(np.concatenate([h[met].view(np.int64), np.zeros(n, np.int64)])), pa.array(np.concatenate([loose[met], np.ones(n, bool)])), pa.array(np.arange(len(row[met]) + n) >= len(row[met]))],
                    names=["th", "at", "g", "loose", "sure"],
                )

    met = cut(texts.mapInArrow(look, "th long, at long, g long, loose boolean, sure boolean"))
    runs_met = met.where("not sure").join(induced, "g", "left_semi").select("th", "at", "loose")
    # a run counts if it goes on for four tokens or is bounded by a mark
    further = runs_met.select("th", "at").unionByName(runs_met.select("th", (F.col("at") + 1).alias("at"))).groupBy("th", "at").agg(F.count("*").alias("n")).where("n > 1").select("th")
    found = met.where("sure").select("th").unionByName(runs_met.where("loose").select("th")).unionByName(further)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, th, own = _texts(b)
            got = [(int(h), *x) for h, one in zip(th, own.to_pylist(), strict=True) for x in names(one)]
            cols = list(zip(*got, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=["th", "name", "notation", "sure", "alone"])

    # few texts hold marks that could open a name
    marked = texts.where(t.rlike(r"[\[{<%$#@~|«^_]"))
    held = cut(marked.mapInArrow(hold, "th long, name string, notation string, sure boolean, alone boolean"))
    known = held.where("alone").groupBy("name").agg(F.count_distinct("notation").alias("n"), F.max("sure").alias("sure")).where("sure or n > 1").select("name")
    found = found.unionByName(held.where("sure").select("th")).unionByName(held.join(known, "name", "left_semi").select("th")).distinct()
    return rows.select(*k, "th").join(found, "th", "left_semi").select(*k).distinct().toDF(*keys)
