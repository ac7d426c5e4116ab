import random
import re

import numpy as np
import pyarrow.parquet as pq

from arclume.llm.neardup import SAMPLES, minhash, odd_sketch, similar_classes, similar_pairs, xor_limit


def brute(rows, threshold, least):
    sets = [(i, s) for i, t in rows if t is not None and i is not None and len(s := set(re.findall("[a-z0-9]+", t.lower()))) >= least]
    out = []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if len(a & b) >= threshold * len(a | b):
                out.append((min(i, j), max(i, j)))
    return sorted(out)


def test_small_fixture(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "Ünï " * 50)]
    for f in range(25):
        words = rng.sample(vocabulary, 60)
        for _ in range(8):
            w = words[:]
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(60)] = rng.choice(vocabulary)
            rng.shuffle(w)
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.3 else ", ".join(w)))
    rows += [(len(rows) + k, rows[10][1]) for k in range(60)]
    rows.append((9999, "long " * 100000 + rows[20][1]))
    rows.append((None, rows[10][1]))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "log_id long, full_prompt string, cls int, words string")
    got = sorted((r[0], r[1]) for r in similar_pairs(df, "log_id", "full_prompt", 0.8, 40).collect())
    assert got == brute(rows, 0.8, 40)
    members, links = similar_classes(df, "log_id", "full_prompt", 0.8, 40)
    of = {r.id: r.cls for r in members.collect()}
    assert len(of) == sum(i is not None and t is not None and len(set(re.findall("[a-z0-9]+", t.lower()))) >= 40 for i, t in rows)
    linked = {(r.cls_a, r.cls_b) for r in links.collect()}
    assert linked == {(min(of[a], of[b]), max(of[a], of[b])) for a, b in got if of[a] != of[b]}
    assert similar_pairs(df.limit(0), "log_id", "full_prompt").collect() == []


def test_whole_small_table(spark):
    t = pq.read_table("/root/testdata/sf0.01/success_log.parquet")
    rows = list(zip(t["log_id"].to_pylist(), t["full_prompt"].to_pylist()))
    df = spark.read.parquet("/root/testdata/sf0.01/success_log.parquet")
    assert sorted((r[0], r[1]) for r in similar_pairs(df, "log_id", "full_prompt").collect()) == brute(rows, 0.8, 40)


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(300):
        base = rng.integers(0, 2**62, 90)
        a, b = base[:85], np.concatenate([base[:75], base[85:]])  # 75 of 90 + 5: about 0.79
        sig = minhash(np.concatenate([a, b[:80]]), np.array([0, 85, 165]), SAMPLES)
        s = odd_sketch(sig)
        lost += sum(int(x).bit_count() for x in s[0] ^ s[1]) > xor_limit(0.8)
    assert lost == 0
