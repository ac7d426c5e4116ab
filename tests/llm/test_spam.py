import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from arclume.llm import spam as S
from arclume.llm.spam import Part, find_spam, form, judge_texts, limits, repeated, units, words

NOTES = [
    "The camera stays beside the door for 30 frames. Nobody touches the shelf until the plumber moves it near the ramp, then leaves.",
    "Camera 1 is clear. Camera 2 is clear again. Camera 3 is clear and the light is on. Camera 4 is clear. Camera 5 is clear.",
    "We suggest adding a pair with steady rain because the set has too few of them.\n\nReferences\nhttps://a.example/x\nhttps://b.example/y",
    "harbour: a word we use when the farmer runs.\nplaza: marked only if the tourist waits near the pool.\nramp: this means that the cart rolls.",
    "The barber smashes awkwardly, then the barber smashes a steep signpost.",
    "Then a barber waits near the pool. The vendor sees that one barber smashes a box. Awkwardly a barber smashes a cup by a steep signpost.",
    "An C:\\clips\\a.mp4 alarm was raised, C:\\clips\\a.mp4 and C:\\clips\\a.mp4 closed.",
    "第427帧到第2559帧之间没有发现异常。因为下雨，地上的背包几乎看不清楚。",
]
SPAM = [
    "buy dash cam cheap dash cam dash cam price dash cam online best dash cam dash cam review",
    "If you want a dash cam, then this sale dash cam page about dash cam is for you and your dash cam.\nOur dash cam is the free dash cam for every dash cam need.",
    "https://a.example/x\nhttps://b.example/y\n<a href=\"https://c.example\">dash cam</a>",
    "Home > dash cam > price > chain\nShop > dash cam > best > rope",
    "#dashcam #cheap #rope #best #4k",
    "ladder (53), dash cam (4), parcel (49), barrel (114)",
    "SKU 11525 | dash cam 8MP | new | 205.14 GBP\nSKU 57960 | ip camera | sale | 5 EUR",
    "想买录像机就来录像机专卖，价格录像机，厂家录像机。",
    "cheap best\ndash cam price",
    "Kamera Set Belcor, Kamera Set Ashlop, Kamera Set Rinnor, Kamera Set Melrin",
]


def test_cases(spark):
    rows = [(None, False), ("", False), (" \n ", False)]
    rows += [(t, False) for t in NOTES] * 12 + [(t, True) for t in SPAM] * 12
    rows += [(NOTES[0] * 3 + "\n" + SPAM[4], False), (SPAM[1] * 4000, True), (NOTES[0] * 4000, False)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, (t, _) in enumerate(rows)], "doc_id long, text string, share int, k string")
    got = {r.doc_id for r in find_spam(df, "doc_id", "text").collect()}
    assert [t[:80] for i, (t, want) in enumerate(rows) if (i in got) != want and t is not None] == []
    assert find_spam(df.limit(0), "doc_id", "text").collect() == []


def documents(sf="0.01"):
    return [t for t in pq.read_table(f"/root/testdata/sf{sf}/documents.parquet")["text"].to_pylist() if t and t.strip()]


def test_counts_of_the_corpus(spark, monkeypatch):
    """Each part gets the counts of all distinct texts, however they are spread."""
    texts = documents("0.001")[:60] * 2
    monkeypatch.setattr(S, "HELD", 50)
    want_words, want_pairs = Counter(), Counter()
    for t in set(texts):
        each = [words(u) for u in units(t)]
        want_words.update({w for ws in each for w in ws})
        want_pairs.update({p for ws in each for p in zip(ws, ws[1:]) if "0" not in p})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    batches = df.selectExpr("xxhash64(text) h", "cast(pmod(xxhash64(text), 3) as int) part", "text t").toArrow().to_batches()
    rows = list(S._count(S._cut(iter(batches))))
    spelt, hashed = Counter(), Counter()
    for b in rows:
        for k, g, d in zip(*(b[c].to_pylist() for c in ("k", "g", "d"))):
            (hashed if k is None else spelt)[g if k is None else k] += d
    assert spelt.pop("") == len(set(texts)) and spelt == want_words
    plain = {p for p in want_pairs if all(w.isascii() and w.isalpha() for w in p)}
    for pair in list(plain)[:200]:
        for t in S.lex(S.pa.array([" ".join(pair)])):
            _, both, _, _ = S.neighbours(t)
            assert hashed[int(both.view(np.int64)[0])] == want_pairs[pair]


def salad(rng, texts, n, length):
    pool = [w for t in texts for u in units(t) for w in words(u) if w.isascii() and w != "0"]
    return [" ".join(rng.choice(pool) for _ in range(length)) + "." for _ in range(n)]


def test_word_salad(spark):
    """Mutual information alone finds planted word salad at natural word frequencies, and no note."""
    texts, rng = documents(), random.Random(2)
    planted = salad(rng, texts, 30, 20) + salad(rng, texts, 10, 60)
    copies = [planted[0]] * 300  # copies of a page do not make its neighbours common
    df = spark.createDataFrame(list(enumerate(texts + planted + copies)), "doc_id long, text string")
    before = {r.doc_id for r in find_spam(df.where(f"doc_id < {len(texts)}"), "doc_id", "text").collect()}
    got = {r.doc_id for r in find_spam(df, "doc_id", "text").collect()}
    assert {i for i in got if i < len(texts)} == before
    assert len({i for i in got if len(texts) <= i < len(texts) + 40}) >= 38
    assert len([i for i in got if i >= len(texts) + 40]) in (0, 300) and (len(texts) in got) == (len(texts) + 40 in got)
    judged, limit = judge_texts(df, "text")
    by_rules = {r.h for r in judged.where("bad * 2 > whole").select("h").collect()}
    hashes = {r.h for r in df.where(f"doc_id >= {len(texts)}").selectExpr("xxhash64(text) h").collect()}
    assert not hashes & by_rules and all(-1.5 < x <= 0 for x in limit.values())


def test_information():
    """Known neighbours score high, unseen ones -1, and units of unknown words are not judged."""
    ordered = "the old man walks to the small harbour with his green boat today".split()
    shuffled = "boat the harbour walks today old with small his the to green man".split()
    h, d = [], []
    for t in S.lex(S.pa.array([" ".join(ordered)])):
        _, both, one, two = S.neighbours(t)
        h = np.concatenate([both, one, two])
        d = np.concatenate([np.full(len(both), 40), np.full(len(one) * 2, 80)])
    at = np.unique(h, return_index=True)[1]
    part = Part({"": (10**5, 10**4, 0)}, h[at], d[at])
    a, b, c = part.information([" ".join(x) for x in (ordered, shuffled, [f"w{i}" for i in "abcdefghijkl"])])
    assert a > 0.5 and b < -0.8 and c != c
    assert part.information([]).tolist() == []
    assert limits({(5, 70): 300, (5, 75): 300, (6, 1): 3}) == {5: limits({(5, 70): 300, (5, 75): 300})[5], 6: limits({(5, 70): 300, (5, 75): 300})[5]}


def test_forms():
    assert form("see https://a.example/x", words("see https://a.example/x"))
    assert not form("The note of https://a.example/x says that nothing was found here.", words("The note of says that nothing was found here"))
    assert repeated(words("Clip 30 and clip 449 overlap by 33 frames"), frozenset()) == (0, 0)
    assert repeated([], frozenset()) == (0, 0)


def test_phrase_that_is_rare_in_a_large_corpus(spark):
    filler = [NOTES[0] * 400 + f" {i}" for i in range(300)]
    rows = filler + [f"{w} zorvex lamp, zorvex lamp shop" for w in ("buy", "get", "find")]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in find_spam(df, "doc_id", "text").collect()} == {300, 301, 302}


def test_labels_part_evenly(spark):
    from pyspark.sql import functions as F

    for n in (1, 7, 32):
        at = spark.createDataFrame([(i,) for i in S.labels(spark, n)], "i int").select(F.pmod(F.hash("i"), F.lit(n)).alias("p"))
        assert at.distinct().count() == n
