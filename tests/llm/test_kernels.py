import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import boilerplate, language, leaks, repeats, residue, tokens


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.Vocabulary.load()


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="ab \n'st019é日", max_size=60), max_size=6))
def test_encoding_is_the_tokenizers(vocabulary, plain, texts):
    assert tokens.Encoder(vocabulary)(texts).to_pylist() == plain(texts)


def test_encoding_of_extremes(vocabulary, plain):
    texts = ["a" * 30_000, " " * 5_000, "<|endoftext|>", "=-" * 2_000, "x", ""]
    assert tokens.Encoder(vocabulary)([*texts, None]).to_pylist() == [*plain(texts), []]


def test_leaks_against_brute_force():
    rng = random.Random(4)
    for _ in range(120):
        k = rng.choice([1, 2, 3, 4])
        items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))) for i in range(6)]
        a = leaks.Automaton(items, k)
        text = " ".join(rng.choice("abcd") for _ in range(20))
        w = text.split()
        want = {i for i, y in items for j in range(len(w) - k + 1) if f" {' '.join(w[j : j + k])} " in f" {y} "}
        assert a.items_in(text) == want and {s[0] for s in a.spans(text)} == want
        for item, first, n, start, end in a.spans(text):
            assert f" {' '.join(w[first : first + n])} " in f" {dict(items)[item]} " and text[start:end] == " ".join(w[first : first + n])
    assert leaks.Automaton([]).items_in("a b") == set() and leaks.Automaton([(1, None)]).items_in(None) == set()
    assert leaks.Automaton([(1, "A, b-C d!")], 4).items_in("x a B c; D") == {1}


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 123, 5_000, np.uint8)

    def hashes(parts):
        data = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        entry, h = repeats.chunks(data, ends - [len(p) for p in parts], ends)
        return [h[entry == i].tolist() for i in range(len(parts))]

    alone = hashes([body])[0]
    assert hashes([body[:7], body, body[9:10], body])[1] == alone and hashes([body[:7], body])[1] == alone
    shifted = hashes([np.concatenate([body[:3], body])])[0]
    assert len(set(alone) & set(shifted)) > 0.9 * len(alone) > 20


def flags(lines, kinds=None, title="Title", known=True, **shares):
    p = boilerplate.Shares(**shares)
    size = np.array([len(x) for x in lines])
    crumbs = np.array(["›" in x for x in lines])
    got = boilerplate.template_flags(size, np.array(kinds or [0] * len(lines)), np.array([x == title for x in lines]), crumbs, p, known)
    return np.flatnonzero(~got).tolist()


def test_line_blocks():
    assert boilerplate.body_range(np.array([0, 0, 5, 0, 7, 0, 0, 0]), 3) == (2, 5) and boilerplate.body_range(np.zeros(4), 3) == (0, 0) and boilerplate.body_range(np.zeros(0), 3) == (0, 0)
    lines = ["menu", "menu › Title", "Title", "text", "By me", "more text", "Read also", "Teaser", "Imprint"]
    assert flags(lines, [1, 0, 0, 0, 1, 0, 2, 0, 1]) == [2, 3, 5]


def test_line_blocks_by_length():
    lines = ["Home", "Docs", "Title", "By me", "A body line. " * 13, "short", "Last words. " * 9, "Teaser", "Privacy", "Terms"]
    # nothing is shared here, so lengths decide: from the title to the last block
    assert flags(lines, window=1) == [2, 3, 4, 5, 6] and flags(lines) == [2, 3, 4, 5, 6, 7, 8]
    assert flags(lines, window=1, surge=150) == [2, 3, 4] and flags(lines, long_line=1_000) == list(range(10))
    # shared lines weigh nothing: with the last block shared, the dive comes earlier
    assert flags(lines, [0] * 6 + [1] + [0] * 3) == [2, 3, 4, 5]


def test_line_blocks_of_a_lone_page():
    # a site of one page shares nothing; its menu and footer go by their length alone
    lines = ["Home", "Products", "Contact", "What is said here is long enough. " * 20, "Imprint", "Terms of use"]
    assert flags(lines, known=False) == [3]
    assert flags(["Home", "Title", "Says little.", "Terms"], known=False) == [1, 2, 3] or flags(["Home", "Title", "Says little.", "Terms"], known=False) == [0, 1, 2, 3]


def test_network_gradients():
    n = language.Network(language.Training(hidden=5, embedding=3, seed=1))
    x, mask = language._padded([b"hello world this", b"abc", b"the quick brown fox"])
    y = np.array([0, 3, 5])
    _, g = n.gradients(x, mask, y)
    rng = np.random.default_rng(0)
    for k, v in n.p.items():
        for _ in range(4):
            i = (ord("e"), int(rng.integers(3))) if k == "E" else tuple(int(rng.integers(s)) for s in v.shape)
            old, e = v[i], 2e-2
            v[i] = old + e
            up, _ = n.gradients(x, mask, y)
            v[i] = old - e
            down, _ = n.gradients(x, mask, y)
            v[i] = old
            assert (up - down) / (2 * e) == pytest.approx(float(g[k][i]), abs=2e-3, rel=0.05)


def test_network_learns_and_pools():
    rng = random.Random(1)
    words = {0: "the and of with this that", 1: "der die und nicht mit ein"}
    texts = [" ".join(rng.choices(words[i % 2].split(), k=9)) for i in range(400)]
    labels = np.array([i % 2 for i in range(400)])
    net = language.train(texts, labels, language.Training(rounds=(60, 20), hidden=8))
    p = language.pooled(net, ["the and with that this of the", "der und die mit nicht ein und", "x" * 5_000, ""])
    assert p.shape == (4, 7) and p[:2].argmax(1).tolist() == [0, 1] and np.isfinite(p).all()


def test_linear_classifier():
    lines = [f"page not found number {i}" for i in range(60)] + [f"a good day for walking {i}" for i in range(60)]
    f = residue.Features(14)
    r, c = f(lines, [True] * 120, [False] * 120)
    y = np.array([1.0] * 60 + [0.0] * 60)
    m = residue.Classifier(14).fit(r, c, y, residue.Training(bits=14))
    r, c = f(["page not found today", "walking on a good day", ""], [True] * 3, [False] * 3)
    s = m.scores(r, c, 3)
    assert s[0] > 0 > s[1] and np.isfinite(s).all()
