import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arclume.llm.encoding import Part, default_vocabulary, encode_corpus, encoder, halves, tree_concat


@pytest.fixture(scope="module")
def enc():
    return encoder(default_vocabulary())


def tree(enc, text, limit):
    return tree_concat([Part(enc, t) for t in halves(text, limit)]).ids


ALPHABETS = ["ab", "aaab", "a", "the and of in ", "abc'st re", " \n\t", "12", "1a", "!?.", "é à ü ß", "你好，世界。", "a你b1 '", "👍🏽é́", "=-", "AaBb. ", "​　x"]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from(ALPHABETS), st.integers(1, 700), st.integers(1, 40))
def test_join_is_exact(seed, alphabet, n, limit):
    enc = encoder(default_vocabulary())
    rng = random.Random(seed)
    text = "".join(rng.choice(alphabet) for _ in range(n))
    assert tree(enc, text, limit) == enc.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200), st.integers(1, 20))
def test_any_text(text, limit):
    enc = encoder(default_vocabulary())
    text = text.encode("utf-8", "ignore").decode()
    assert tree(enc, text, limit) == enc.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["a", "ab", "thequickbrownfox", "你好", "-", "7", "x '"])
def test_long_unsplit_runs(enc, unit):
    text = "start " + unit * 20000 + " end"
    assert tree(enc, text, 1000) == tree(enc, text, 7001)
    whole = tree(enc, text, 1000)
    assert enc.decode(whole) == text
    if unit in ("thequickbrownfox", "x '"):
        assert whole == enc.encode_ordinary(text)


def test_operator(spark, enc):
    rng = random.Random(5)
    texts = [None, "", " ", "a", "<|endoftext|> x", "same", "same", "".join(rng.choice("abc d.,'你1") for _ in range(5000)), "z" * 3000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "ids long, text string, k int")
    got = {r[0]: r[1] for r in encode_corpus(df, "ids", "text", split_chars=300).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert encode_corpus(df.limit(0), "ids", "text").collect() == []
