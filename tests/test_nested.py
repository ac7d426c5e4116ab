import json

import pyarrow.parquet as pq

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arclume.operators.nested import dump_deep, label_nodes, link_nodes, node_table, parse_deep, unreadable
from arclume.plans.problems import p1_found


def blank(v):
    return v is None or (isinstance(v, str) and not v.strip())


def brute(body):
    """The rows of one body, built top down without any node numbers."""
    try:
        v = json.loads(body)
    except (TypeError, ValueError):
        return set()
    if isinstance(v, dict):
        v = v.get("pairs", [v])
    out = set()
    for n, p in enumerate(v or [], 1):
        if not isinstance(p, dict):
            continue
        out.add((n, "pair", "", ""))
        ctx = p.get("shared_context") or {}
        pc, chars = ctx.get("Pc"), ctx.get("Pchar")
        if isinstance(pc, str) and not blank(pc):
            out.add((n, "context", "", "text"))
        for k, x in (pc.items() if isinstance(pc, dict) else ()):
            if isinstance(x, list):
                out |= {(n, "context", "", f"{k}/{i}") for i, y in enumerate(x, 1) if not blank(y.get("text"))}
            elif not blank(x):
                out.add((n, "context", "", k))
        for i, c in enumerate(chars if isinstance(chars, list) else [chars], 1):
            if not blank(c):
                out.add((n, "character", "", str(i)))
                if isinstance(c, dict):
                    out |= {(n, "carried", "", f"{i}/{j}") for j, _ in enumerate(c.get("carried") or [], 1)}
        sides = [(s, p[f"{s}_branch"]) for s in ("abnormal", "normal") if p.get(f"{s}_branch")] + [(b["branch"], b) for b in p.get("branches") or []]
        for side, b in sides:
            out.add((n, "branch", side, ""))
            fr = b.get("frames") or {}
            for name, f in fr.items() if isinstance(fr, dict) else [(f["name"], f) for f in fr]:
                text, cues = (f.get("text"), f.get("cues")) if isinstance(f, dict) else (f, [])
                if not blank(text):
                    out.add((n, "frame", side, name))
                    out |= {(n, "cue", side, f"{name}/{i}") for i, _ in enumerate(cues or [], 1)}
    return out


def test_whole_table(spark):
    t = pq.read_table("/root/testdata/sf0.1/prompt_raw.parquet")
    want = {(i, *r) for i, b in zip(t["raw_id"].to_pylist(), t["body"].to_pylist()) for r in brute(b)}
    rows = [tuple(r) for r in p1_found(spark, "/root/testdata/sf0.1").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


BODIES = {
    1: None,
    2: "",
    3: "[1, 2",
    4: "[NaN]",
    5: "[" * 200000,
    6: '[null, 7, "x", [], {}]',
    7: '{"pairs": null}',
    8: '{"pairs": {"pair_id": "p"}}',
    9: '{"pair_id": "p", "shared_context": null, "normal_branch": {"frames": [null, {"text": "t", "cues": [null, "c"]}, {"name": "F", "text": " "}]}, "branches": [null, {"branch": "normal", "frames": {"F": {"text": "x"}}}]}',
    11: '{"pair_id": "deep", "x": ' + "[" * 100000 + "]" * 100000 + ', "shared_context": {"Pchar": ' + '{"a":' * 50000 + "1" + "}" * 50000 + "}}",
    10: json.dumps([{"shared_context": {"Pchar": [None, {"role": None, "carried": [{"thing": "x"}] * 5000}]}}]),
}


def test_cases(spark):
    df = spark.createDataFrame([(*x, "extra") for x in BODIES.items()], "raw_id long, body string, kind string")
    linked = link_nodes(label_nodes(df, "raw_id", "body")).cache()
    rows = {}
    for r in linked.collect():
        rows.setdefault(r.rec, []).append(r)
    assert set(rows) == {6, 8, 9, 10, 11}
    assert sorted((r.kind, r.name) for r in rows[11]) == [("character", "1"), ("pair", "")]
    # every node counts: the pair closes after all nodes in it, 100,000 arrays among them
    assert max(r.post for r in rows[11]) > 150000
    dead = {r.raw_id: r.reason for r in unreadable(df, "raw_id", "body").collect()}
    assert dead == {1: "null", 2: "invalid", 3: "invalid", 4: "invalid", 5: "invalid"}
    assert [(r.kind, r.pair_no) for r in rows[6]] == [("pair", 5)]
    assert sorted((r.kind, r.branch, r.name) for r in rows[9]) == [("branch", "normal", "normal"), ("branch", "normal", "normal"), ("cue", "normal", "/2"), ("frame", "normal", ""), ("frame", "normal", "F"), ("pair", "", "")]
    assert sum(r.kind == "carried" and r.name.startswith("2/") for r in rows[10]) == 5000
    # the parent of every row is in its parent table, and contains it
    at = {(r.rec, r.pre): r for rs in rows.values() for r in rs}
    for r in at.values():
        if r.kind != "pair":
            p = at[r.rec, r.parent_pre]
            assert p.pre < r.pre and p.post > r.post
    assert node_table(linked, "cue").count() == 1


def test_empty(spark):
    df = spark.createDataFrame([], "raw_id long, body string")
    assert link_nodes(label_nodes(df, "raw_id", "body")).collect() == []


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.integers(0, 3))
def test_deep_parser(value, indent):
    text = json.dumps(value, ensure_ascii=False, indent=indent or None)
    assert parse_deep(text) == value == json.loads(dump_deep(value)) and dump_deep(value) == json.dumps(value, ensure_ascii=False)
    for cut in (text[:-1], text + "]", text + " 1"):
        try:
            want = json.loads(cut)
        except ValueError:
            with pytest.raises(ValueError):
                parse_deep(cut)
        else:
            assert parse_deep(cut) == want
