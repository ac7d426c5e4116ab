import re

import pyarrow.parquet as pq
import pytest

from arclume.operators.packed import unpack_ranges

CASES = [
    (None, []),
    ("", []),
    ("  \t\n", []),
    ("0", []),
    (' "0" ', []),
    ("none", []),
    ('""', []),
    ("1-5; 7-9", [(1, 1, 5), (2, 7, 9)]),
    ("10-5", [(1, 10, 5)]),
    ("7", [(1, 7, 7)]),
    ("0; 3", [(1, 0, 0), (2, 3, 3)]),
    ("0-0", [(1, 0, 0)]),
    ("1-2-3;7-8", [(2, 7, 8)]),
    ("12.5-20, 4", [(2, 4, 4)]),
    ("77-; 3-4", [(2, 3, 4)]),
    ("?;- ;x-40;na 5~6", [(5, 5, 6)]),
    (";; 1->2 ;;3..4", [(1, 1, 2), (2, 3, 4)]),
    ('"1,101~1,114" | 5 - 6', [(1, 1101, 1114), (2, 5, 6)]),
    ("1,101", [(1, 1, 1), (2, 101, 101)]),
    ('"1,1012"', [(1, 1, 1), (2, 1012, 1012)]),
    ('"12,34"', [(1, 12, 12), (2, 34, 34)]),
    ("frame 26 - 59\tf30-31 frames 7", [(1, 26, 59), (2, 30, 31), (3, 7, 7)]),
    ("[1 to 2] and (3 — 4) & '5–6'", [(1, 1, 2), (2, 3, 4), (3, 5, 6)]),
    ('"3994 to 4076; 12468 to 24023;"', [(1, 3994, 4076), (2, 12468, 24023)]),
    ("99999999999; 2147483647; 00012", [(2, 2147483647, 2147483647), (3, 12, 12)]),
    ("１-２;5", [(2, 5, 5)]),
    ("1-2;1-2", [(1, 1, 2), (2, 1, 2)]),
    ("; ".join(f"{i}-{i + 1}" for i in range(30000)), [(i + 1, i, i + 1) for i in range(30000)]),
]


@pytest.mark.parametrize("split", [1, 3])
def test_cases(spark, split):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id long, text string").repartition(split)
    got = {}
    for r in unpack_ranges(df, "text", ["id"]).collect():
        got.setdefault(r.id, []).append((r.pos, r.start_frame, r.end_frame))
    for i, (text, want) in enumerate(CASES):
        assert sorted(got.get(i, [])) == want, text


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "pos long, text string")
    assert unpack_ranges(df, "text", ["pos"]).collect() == []
    df = spark.createDataFrame([(4, "text", "1-2")], "pos long, k0 string, text string")
    r = unpack_ranges(df, "text", ["k0", "pos"]).collect()
    assert [tuple(x) for x in r] == [("text", 4, 1, 1, 2)]


def brute(s):
    """A plain reading of the notation, one text at a time."""
    if s is None:
        return []
    s = re.sub(r"->|\.\.|[–—~]", "-", s)
    s = re.sub(r"\b(?:frames?|f) *(?=\d)", "", s)
    s = re.sub(r"(?<=\d)([\])'\"]*) *\bto\b *", r"\1-", s)
    s = re.sub(r"(?<=\d)([\])'\"]*) *- *", r"\1-", s)
    s = "".join(re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", x) if i % 2 else x for i, x in enumerate(s.split('"')))
    s = re.sub(r"['()\[\]]", "", s)
    pieces = [p for p in re.split(r"[;,|/&\s]+|\band\b", s) if p]
    if pieces == ["0"]:
        return []
    out = []
    for i, p in enumerate(pieces, 1):
        if m := re.fullmatch(r"(\d+)(?:-(\d+))?", p):
            out.append((i, int(m[1]), int(m[2] or m[1])))
    return out


@pytest.mark.parametrize("name,column", [("test_annotations", "anomaly_frames"), ("test_gt", "anomaly_ranges")])
def test_brute_force(spark, name, column):
    path = f"/root/testdata/sf0.1/{name}.parquet"
    t = pq.read_table(path)
    want = sorted((i, *v) for i, s in zip(t["gt_id"].to_pylist(), t[column].to_pylist()) for v in brute(s))
    got = sorted(tuple(r) for r in unpack_ranges(spark.read.parquet(path), column, ["gt_id"]).collect())
    assert got == want and len(got) > 1000
