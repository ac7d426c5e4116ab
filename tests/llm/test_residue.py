"""Template residue: wordings that no list holds, depictions, names, filler and edge cases."""

import random

import pyarrow as pa
import pytest

from arclume.llm import residue as R
from arclume.llm.tokens import NUMBER, WORD, lex

WHO, DO, HOW = ["cyclist", "nurse", "porter", "welder", "usher"], ["waits", "sits", "leans", "runs", "waves"], ["slowly", "calmly", "idly", "firmly"]
WHERE, THING = ["quay", "garden", "lobby", "market", "tunnel"], ["bench", "kettle", "trolley", "lamp", "crate", "poster"]

#: Wordings of pages, notices and defaults; the operator knows none of them.
HELD_OUT = [
    "Something went wrong on our end.",
    "The connection has timed out. Try the address again in a moment.",
    "Scripting turned off; switch it on to see the gallery.",
    "Placeholder text, replace before release",
    "Please sign in to your account to go on viewing.",
    "Beklager, vi fant ikke siden du lette etter.",
    "お探しのページは見つかりませんでした。",
]
NAMES = ["{weather_state}", "[SCENE_DESCRIPTION_HERE]", "%%ACTOR%%", "~~place~~", "${po}", "{{ Frame_3 }}", "%(time)s", "<%= role %>", "__DETAIL__", "@@camera@@"]


def prompts(rng, n):
    def frame(i):
        return f"Frame {i}: the {rng.choice(WHO)} {rng.choice(HOW)} {rng.choice(DO)} near the {rng.choice(THING)}"

    return [f"muted recorder footage, four moments on a sheet. a {rng.choice(WHERE)} by the {rng.choice(THING)} " + "; ".join(frame(i) for i in range(1, 5)) + ". The same coat in every panel." for _ in range(n)]


def messages(rng, n):
    kinds = ["TIMEOUT: read timed out after {0} s", "HTTP 4{0}: quota used up", "javascript worker of the renderer ran out of memory ({0} MB)", "template check passed, placeholder count {0}, image missing", "unbalanced brace '{{' at offset {0} of the model answer", "client gave up: gateway answered {0} twice"]
    return [rng.choice(kinds).format(rng.randrange(10, 99)) for _ in range(n)]


def inside(rng, prompt, text):
    words = prompt.split(" ")
    at = rng.randrange(8, len(words) - 4)
    return " ".join(words[:at] + [text] + words[at:])


def table(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, "x") for i, (s, t, _) in enumerate(rows)], "id long, src string, text string, th int, k0 string").repartition(3)


def wrong(spark, rows, keys=("src", "id")):
    got = {r.id for r in R.find_residue(table(spark, rows), list(keys), "text", "src").collect()}
    return [(s, (t or "")[-150:]) for i, (s, t, want) in enumerate(rows) if (i in got) != want]


@pytest.fixture
def corpus():
    rng = random.Random(5)
    return rng, [("prompts", t, False) for t in prompts(rng, 240)] + [("messages", t, False) for t in messages(rng, 150)]


def test_wordings_that_no_list_holds(spark, corpus, monkeypatch):
    monkeypatch.setattr(R, "FILLER", [])
    rng, rows = corpus
    for text in HELD_OUT:
        rows += [("prompts", inside(rng, p, text), True) for p in prompts(rng, 2)] + [("messages", text, True), ("messages", "got " + text, True)]
    for name in NAMES:
        rows += [("prompts", inside(rng, prompts(rng, 1)[0], name), True), ("messages", f"generation failed: {name}", True)]
    rows += [("prompts", inside(rng, prompts(rng, 1)[0], "<place>"), True), ("messages", "error=$Po$", True)]  # names that others hold in sure notations
    rows += [("prompts", inside(rng, prompts(rng, 1)[0], "zzz zzzz hhh"), True), ("messages", "reason: test test test", True)]
    found = [w for w in wrong(spark, rows)]
    assert len(found) <= 0.1 * sum(want for *_, want in rows)
    assert all(want for s, t, want in rows for f in found if f == (s, t[-150:]))  # nothing wrong is returned
    # without the phrase in another source it is content of its template
    alone = [("prompts", t, False) for t in prompts(rng, 100)] + [("prompts", inside(rng, p, HELD_OUT[0]), False) for p in prompts(rng, 4)]
    assert wrong(spark, alone) == []


def test_depictions(spark, corpus):
    rng, rows = corpus
    page = "<html><head><title>404 Not Found</title></head><body><h1>Not Found</h1><p>{}</p></body></html>"
    said = ["The page is having a short break.", "Reload the page or come back later.", "We cannot show this address."]
    rows += [("messages", page.format(s), True) for s in said] + [("prompts", page.format(s), True) for s in said]
    depicted = ['a wall tag spelled "{Osswick}"', 'a receipt printed with "$Kepmar" and "<Estruddra>"', 'a kiosk frozen on "Unknown Error, please try again later"', "a billboard reading 404 Not Found hangs above a shop", "a laptop with a JavaScript course open", "a sign saying 'We cannot show this address.' by the door"]
    rows += [("prompts", inside(rng, p, d), False) for d in depicted for p in prompts(rng, 2)]
    rows += [("messages", "reviewer rejected image: a 'page not found' sign fills panel 2", False), ("prompts", prompts(rng, 1)[0].replace("Frame 3: the", "Frame 3: ;"), False)]
    assert wrong(spark, rows) == []


def test_edges(spark, corpus):
    rng, rows = corpus
    text = HELD_OUT[0]
    rows += [("prompts", None, False), ("messages", "", False), (None, " \n\t", False), (None, None, False)]
    rows += [("prompts", prompts(rng, 1)[0] * 3000 + " ${po}", True), ("prompts", "lorem ipsum", True), (None, "{{name}}", True)]
    # copies of one text are a third of all rows; they do not make it a template's
    rows += [("prompts", text, True)] * 200 + [("messages", text, True)]
    assert wrong(spark, rows) == []
    df = table(spark, rows)
    assert R.find_residue(df.limit(0), ["src", "id"], "text", "src").collect() == []
    one = R.find_residue(df, ["k0"], "text").collect()  # no source; keys that repeat come once
    assert [tuple(r) for r in one] == [("x",)]


def test_tokens():
    texts = ["", "Frame_1: The cat, 4k x12!", "naïve «Élan» 此页面需要脚本支持。 zzz", "a" * 5000 + " b", "the cat"]
    got = {}
    for t in lex(pa.array(texts)):
        for i in range(len(texts)):
            mine = (t.row == i) & ((t.kind == WORD) | (t.kind == NUMBER))
            got[i] = list(zip(t.kind[mine].tolist(), t.hash[mine].tolist()))
            if i == 2:
                assert t.wide[mine].tolist() == [False, False, True, False] and t.same[mine].tolist() == [False, False, False, True]
    assert got[0] == [] and len(got[1]) == 6 and [k for k, _ in got[1]] == [WORD, NUMBER, WORD, WORD, NUMBER, NUMBER]
    assert got[1][2:4] == got[4] and len(got[2]) == 4 and len(got[3]) == 2


def test_slices(monkeypatch):
    from arclume.llm import tokens

    texts = pa.array([f"text {'w' * i} number {i}" for i in range(50)])
    whole = list(tokens.lex(texts))
    monkeypatch.setattr(tokens, "SLICE", 60)
    parts = list(tokens.lex(texts))
    assert len(whole) == 1 and len(parts) > 20
    for c in ("row", "kind", "hash", "length"):
        assert [x for p in parts for x in getattr(p, c).tolist()] == getattr(whole[0], c).tolist()


def test_names():
    def held(text):
        return [(n, sure) for n, _, sure, _ in R.names(text)]

    assert held("a {{Pchar}} b") == [("pchar", True)] and held("%(PO)s,") == [("po", True)]
    assert held("<Frame_2>") == [("frame", True)] and held("{camera}") == [("camera", False)]
    assert held("[your ROLE here]") == [("your", False), ("role", False), ("here", False)]
    assert held("a < b and c > d") == [] and held("{x]") == [] and held("5 % of 10 %") == []
