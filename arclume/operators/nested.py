"""Deeply nested records as related flat tables.

Every record is walked once, depth first, and every node of it, whatever it is, gets
a pre-order and a post-order number; ``a`` is an ancestor of ``b`` in a record
exactly if ``a.pre < b.pre`` and ``a.post > b.post``. What a node is follows from what
its parent is and where it stands in it; nodes of a type go to the table of their
type, and tables are linked by that containment alone: in pre-order the nearest node
of the parent's type that contains a node is the last one opened before it, so one
sort per record links all of them without a self join.

The walk and, where a record is too deep for the library's parser, the parser keep
their own stack, so depth is bounded by memory alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from json.decoder import scanstring
from json.scanner import NUMBER_RE

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The parent type of each table.
PARENTS = {"pair": None, "branch": "pair", "context": "pair", "character": "pair", "carried": "character", "frame": "branch", "cue": "frame"}
NODE_SCHEMA = "rec long, kind string, pre int, post int, ord int, name string, value string"


def _blank(v: object) -> bool:
    return v is None or (isinstance(v, str) and not v.strip())


def _reject(token: str) -> None:
    raise ValueError(token)


_SPACE = re.compile(r"[ \t\n\r]*")
_LITERALS = {"true": True, "false": False, "null": None}
_LITERAL = re.compile("true|false|null")


def parse_deep(text: str) -> object:
    """The value of a JSON text of any depth; ValueError if it is not one."""
    space = lambda at: _SPACE.match(text, at).end()

    def named(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(at)
        name, at = scanstring(text, at + 1, True)
        at = space(at)
        if text[at : at + 1] != ":":
            raise ValueError(at)
        return name, space(at + 1)

    open_: list[list] = []  # containers that are not closed, each with the name its next value gets
    at = space(0)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            inner = space(at + 1)
            if text[inner : inner + 1] != {"{": "}", "[": "]"}[c]:
                if c == "{":
                    name, at = named(inner)
                    open_.append([{}, name])
                else:
                    open_.append([[], None])
                    at = inner
                continue
            value, at = ({} if c == "{" else []), inner + 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _LITERAL.match(text, at):
            value, at = _LITERALS[m.group()], m.end()
        elif m := NUMBER_RE.match(text, at):
            value, at = float(m.group()) if m.group(2) or m.group(3) else int(m.group()), m.end()
        else:
            raise ValueError(at)
        while True:  # the value goes to its container, which it may close
            at = space(at)
            if not open_:
                if at != len(text):
                    raise ValueError(at)
                return value
            box, name = open_[-1]
            if name is None:
                box.append(value)
            else:
                box[name] = value
            c, at = text[at : at + 1], at + 1
            if c == ",":
                at = space(at)
                if name is not None:
                    open_[-1][1], at = named(at)
                break
            if c != ("]" if name is None else "}"):
                raise ValueError(at)
            value = open_.pop()[0]


def dump_deep(value: object) -> str:
    """The JSON text of a value of any depth."""
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(True, value)]
    while todo:
        whole, v = todo.pop()
        if not whole:
            out.append(v)
        elif isinstance(v, dict) or isinstance(v, list):
            ends = "{}" if isinstance(v, dict) else "[]"
            out.append(ends[0])
            rest: list[tuple[bool, object]] = []
            for i, x in enumerate(v.items() if isinstance(v, dict) else v):
                rest += [(False, ", ")] * (i > 0) + ([(False, json.dumps(x[0], ensure_ascii=False) + ": "), (True, x[1])] if isinstance(v, dict) else [(True, x)])
            todo += [(False, ends[1]), *reversed(rest)]
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def _text(v: object) -> str:
    if isinstance(v, str):
        return v
    try:
        return json.dumps(v, ensure_ascii=False)
    except RecursionError:
        return dump_deep(v)


def _listed(v: object) -> list:
    return v if isinstance(v, list) else []


#: What a child of a node is: (child, type or None, place, name, value of its row).
Child = tuple[object, "str | None", int, str, object]


def _of_pairs(items: list, _: str) -> Iterator[Child]:
    for n, p in enumerate(items, 1):
        own = isinstance(p, dict)
        yield p, "pair" if own else None, n, "", p.get("pair_id") if own else None


def _of_pair(p: dict, _: str) -> Iterator[Child]:
    for key, v in p.items():
        if key == "shared_context" and isinstance(v, dict):
            yield v, "shared", 1, "", None
        elif key in ("abnormal_branch", "normal_branch") and isinstance(v, dict):
            yield v, "branch", 1, key.removesuffix("_branch"), v.get("label")
        elif key == "branches" and isinstance(v, list):
            yield v, "branches", 1, "", None
        else:
            yield v, None, 1, "", None


def _of_shared(shared: dict, _: str) -> Iterator[Child]:
    for key, v in shared.items():
        if key == "Pc" and isinstance(v, dict):
            yield v, "parts", 1, "", None
        elif key == "Pc" and isinstance(v, str) and not _blank(v):
            yield v, "context", 1, "text", v
        elif key == "Pchar" and isinstance(v, list):
            yield v, "characters", 1, "", None
        elif key == "Pchar" and not _blank(v):
            yield v, "character", 1, "1", v.get("role", v) if isinstance(v, dict) else v
        else:
            yield v, None, 1, "", None


def _of_parts(parts: dict, _: str) -> Iterator[Child]:
    for n, (key, v) in enumerate(parts.items(), 1):
        if isinstance(v, list):
            yield v, "part", n, key, None
        else:
            yield v, None if _blank(v) else "context", n, key, v


def _of_part(items: list, key: str) -> Iterator[Child]:
    for i, x in enumerate(items, 1):
        t = x.get("text") if isinstance(x, dict) else x
        yield x, None if _blank(t) else "context", i, f"{key}/{i}", t


def _of_characters(items: list, _: str) -> Iterator[Child]:
    for n, c in enumerate(items, 1):
        yield c, None if _blank(c) else "character", n, str(n), c.get("role", c) if isinstance(c, dict) else c


def _of_character(c: object, n: str) -> Iterator[Child]:
    if isinstance(c, dict):
        for key, v in c.items():
            yield v, "things" if key == "carried" and isinstance(v, list) else None, 1, n, None
    else:
        yield from _of_any(c, "")


def _of_named(kind: str) -> Callable:
    """Entries of a list that are rows of ``kind``, named after what holds the list."""

    def children(items: list, name: str) -> Iterator[Child]:
        for i, x in enumerate(items, 1):
            yield x, None if _blank(x) else kind, i, f"{name}/{i}", x

    return children


def _of_branches(items: list, _: str) -> Iterator[Child]:
    for n, b in enumerate(items, 1):
        own = isinstance(b, dict) and not _blank(b.get("branch"))
        yield b, "branch" if own else None, n, str(b["branch"]).strip() if own else "", b.get("label") if own else None


def _of_branch(b: dict, _: str) -> Iterator[Child]:
    for key, v in b.items():
        yield v, "frames" if key == "frames" and isinstance(v, dict | list) else None, 1, "", None


def _of_frames(frames: dict | list, _: str) -> Iterator[Child]:
    named = list(frames.items()) if isinstance(frames, dict) else [(f.get("name") if isinstance(f, dict) else None, f) for f in frames]
    for n, (name, f) in enumerate(named, 1):
        text = f.get("text") if isinstance(f, dict) else f if isinstance(frames, dict) else None
        yield f, None if _blank(text) else "frame", n, "" if name is None else str(name), text


def _of_frame(f: object, name: str) -> Iterator[Child]:
    if isinstance(f, dict):
        for key, v in f.items():
            yield v, "cues" if key == "cues" and isinstance(v, list) else None, 1, name, None
    else:
        yield from _of_any(f, "")


def _of_any(v: object, _: str) -> Iterator[Child]:
    for x in v.values() if isinstance(v, dict) else _listed(v):
        yield x, None, 1, "", None


CHILDREN = {
    "pairs": _of_pairs,
    "pair": _of_pair,
    "shared": _of_shared,
    "parts": _of_parts,
    "part": _of_part,
    "characters": _of_characters,
    "character": _of_character,
    "things": _of_named("carried"),
    "branches": _of_branches,
    "branch": _of_branch,
    "frames": _of_frames,
    "frame": _of_frame,
    "cues": _of_named("cue"),
}


def _number(rec: int, root: object, kind: str | None, out: list[tuple]) -> None:
    """Numbers all nodes below and with ``root``; rows of typed ones go to ``out``."""
    pre = post = 0
    waiting: Iterator[Child] = iter([(root, kind, 1, "", None)])
    open_: list[tuple] = []  # (row's place or -1, the row so far, the siblings that follow)
    while True:
        child = next(waiting, None)
        if child is None:
            if not open_:
                return
            at, row, waiting = open_.pop()
            post += 1
            if at >= 0:
                out[at] = (rec, row[0], row[1], post, *row[2:])
            continue
        value, kind, order, name, shown = child
        pre += 1
        at = -1
        if kind in PARENTS:
            at = len(out)
            out.append(())
        if value.__class__ in (dict, list) and value:
            open_.append((at, (kind, pre, order, name, None if shown is None else _text(shown)), waiting))
            waiting = CHILDREN.get(kind, _of_any)(value, name)
        else:
            post += 1
            if at >= 0:
                out[at] = (rec, kind, pre, post, order, name, None if shown is None else _text(shown))


def read_record(body: str) -> object:
    """The value of a record; ValueError if it cannot be read whole."""
    try:
        return json.loads(body, parse_constant=_reject)
    except RecursionError:
        return parse_deep(body)


def _record(rec: int, body: str, out: list[tuple]) -> None:
    """The nodes of one record; none if it cannot be read whole."""
    try:
        v = read_record(body)
    except ValueError:
        return
    if isinstance(v, dict):
        v = v["pairs"] if "pairs" in v else [v]
        v = [v] if isinstance(v, dict) else v
    if isinstance(v, list):
        _number(rec, v, "pairs", out)


def label_nodes(df: DataFrame, key: str, body: str) -> DataFrame:
    """``rec, kind, pre, post, ord, name, value``: the numbered nodes of all records.

    Null, cut-off and otherwise invalid bodies (bare NaN or Infinity included) give no
    node, never half of a record; ``unreadable`` lists them. A key repeated in an
    object counts as its last value. ``ord`` counts from 1 among siblings, null and
    blank ones included.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple] = []
            for rec, text in zip(f["rec"], f["body"], strict=True):
                if text is not None and rec is not None:
                    _record(rec, text, out)
            yield pd.DataFrame(out, columns=["rec", "kind", "pre", "post", "ord", "name", "value"])

    slim = df.select(F.col(f"`{key}`").cast("long").alias("rec"), F.col(f"`{body}`").cast("string").alias("body")).where("rec is not null and body is not null")
    return slim.mapInPandas(run, NODE_SCHEMA)


def unreadable(df: DataFrame, key: str, body: str) -> DataFrame:
    """``key, reason``: the dead letters of ``label_nodes``, whose bodies are null or no valid JSON."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for rec, text in zip(f["rec"], f["body"], strict=True):
                try:
                    if text is None:
                        out.append((rec, "null"))
                    else:
                        read_record(text)
                except ValueError:
                    out.append((rec, "invalid"))
            yield pd.DataFrame(out, columns=["rec", "reason"])

    slim = df.select(F.col(f"`{key}`").cast("long").alias("rec"), F.col(f"`{body}`").cast("string").alias("body")).where("rec is not null")
    return slim.mapInPandas(run, "rec long, reason string").toDF(key, "reason")


def link_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent_pre``, and the ``pair_no`` and ``branch`` that contain each node.

    Containment of intervals decides: the candidate is the last node of the
    parent's type opened before a node, and it is the parent only if it closes
    after the node does. Records are independent, so the sort stays within one.
    """
    opened = Window.partitionBy("rec").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    linked = nodes
    for kind in ("pair", "branch", "character", "frame"):
        own = F.when(F.col("kind") == kind, F.struct("pre", "post", "ord", "name"))
        last = F.last(own, ignorenulls=True).over(opened)
        linked = linked.withColumn(f"in_{kind}", F.when(last["post"] > F.col("post"), last))
    parent = F.coalesce(*[F.when(F.col("kind") == k, F.col(f"in_{p}.pre")) for k, p in PARENTS.items() if p])
    linked = linked.withColumn("parent_pre", parent)
    pair_no = F.when(F.col("kind") == "pair", F.col("ord")).otherwise(F.col("in_pair.ord"))
    branch = F.when(F.col("kind") == "branch", F.col("name")).otherwise(F.coalesce(F.col("in_branch.name"), F.lit("")))
    return linked.select("rec", "kind", "pre", "post", "parent_pre", pair_no.alias("pair_no"), branch.alias("branch"), "ord", "name", "value")


def node_table(linked: DataFrame, kind: str) -> DataFrame:
    """The flat table of one type; ``parent_pre`` is the parent's ``pre`` in the same record."""
    return linked.where(F.col("kind") == kind)
