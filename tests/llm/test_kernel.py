"""The text kernel, the token encoder and the codec against plain Python."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granary.llm import decontaminate, packing, simple8b
from granary.llm import kernel as K
from granary.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from(list("aBé 1.\n\t'日\x0b")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 60))
def test_words_and_lines(texts, limit):
    at = 0
    for c in K.chunks(pa.array(texts, pa.string()), limit):
        start, end, bounds = c.words()
        h = c.hashes(start, end)
        ls, le, lb = c.lines()
        raw = c.data.tobytes()
        for i in range(len(bounds) - 1):
            text = texts[at] or ""
            words = [raw[a:b].decode() for a, b in zip(start[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]])]
            assert words == WORD.findall(text)
            assert [raw[a:b].decode() for a, b in zip(ls[lb[i] : lb[i + 1]], le[lb[i] : lb[i + 1]])] == text.split("\n")
            same = {}
            for w, x in zip(words, h[bounds[i] : bounds[i + 1]]):
                assert same.setdefault(w, x) == x
            assert len(set(same.values())) == len(same)
            at += 1
    assert at == len(texts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    rnd = random.Random(7)
    parts = ["a", "B", "é", "É", "'", "s", "re", "LL", " ", "  ", "\n", "\t", ".", ",", "23", "'s", "'ll", "ñ", "ß", "×", "I'Ve", "_", "—", "日本", " '", " ", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "\x00", "word", "İ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(3000)] + [None, "", " ", "\n\n", "x" * 5000]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    e = Encoder(public_tokenizers.path(name))
    for c in K.chunks(pa.array(texts)):
        ids, bounds = e.encode(c)
        for i in range(len(bounds) - 1):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == t.encode(texts[c.rows.start + i] or "", add_special_tokens=False).ids


def alike(n):
    """Two words of n letters whose difference a sum over powers of one base modulo 2**64 does not see."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_patterned_words_have_hashes_and_ids_of_their_own(n):
    from granary.llm import quality_rules

    a, b = alike(n)
    (c,) = K.chunks(pa.array([f"{a} {b}", f"x {b} {a}", f"{a}\n{b}", " ".join(a), " ".join(b)]), 1 << 20)
    start, end, bounds = c.words()
    h = c.hashes(start, end)
    assert h[0] != h[1] and h[0] == h[4]
    m = quality_rules.measures(c)
    assert m["n_dup_lines"].tolist() == [0] * 5 and len(set(m["line"][-2:].tolist())) == 2
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        ids, at = Encoder(public_tokenizers.path(name)).encode(c)
        t = Tokenizer.from_file(public_tokenizers.path(name))
        raw = c.data.tobytes().decode()
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [t.encode(raw[i:j], add_special_tokens=False).ids for i, j in zip(c.offsets, c.offsets[1:])]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=90), max_size=12))
def test_spans_are_equal_where_their_bytes_are(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
    start = end - np.array([len(p) for p in parts], np.int64)
    h = K.hashed(data, start, end)
    for i, p in enumerate(parts):
        for j, q in enumerate(parts):
            assert (h[i] == h[j]) == (p == q)
            if len(p) == len(q):
                assert K.equal_spans(data, start[[i]], data, start[[j]], end[[i]] - start[[i]]).all() == (p == q)


def test_a_hash_that_two_words_share_is_no_mistake(monkeypatch):
    monkeypatch.setattr(K, "hashed", lambda data, start, end: (end - start).astype(np.uint64))
    e = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    e.table.clear()
    texts = ["one two six", "six one", "ten", "eleven twelve", "three"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for c in K.chunks(pa.array(texts)):
        ids, at = e.encode(c)
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    e.table.clear()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, sizes, escapes = simple8b.encode(v)
    assert sizes.sum() == len(words)
    assert (simple8b.decode(words, sizes, escapes, len(v)) == v).all()


def test_shard_round_trip_and_cut_off_file():
    import io

    rng, out = np.random.default_rng(3), io.BytesIO()
    docs = [rng.integers(0, 50000, n).astype(np.uint32) for n in (0, 1, 127, 128, 129, 4000, 0, 5)]
    w = simple8b.Writer(out, hold=256)
    for k, d in enumerate(docs):
        w.add([k], d, np.array([len(d)]))
    assert w.close() == sum(map(len, docs))
    r = simple8b.Reader(io.BytesIO(out.getvalue()))
    got = [(i, np.concatenate([np.zeros(0, np.uint64), *p])) for i, _, p in r.documents(step=1)]
    assert [i for i, _ in got] == list(range(8)) and all((a == b).all() for (_, a), b in zip(got, docs))
    assert (r.tokens(100, 300) == np.concatenate(docs)[100:300]).all()
    with pytest.raises(ValueError):
        simple8b.Reader(io.BytesIO(out.getvalue()[:-3]))


@pytest.mark.parametrize("window, misses", [(13, 2), (12, 2), (10, 2), (9, 1), (5, 1)])
def test_masks_miss_no_substitution(window, misses):
    import itertools

    for bad in itertools.combinations(range(window), misses):
        assert any(all(p + o not in bad for o in m) for m in decontaminate.masks(window, misses) for p in range(window - m[-1]))


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 400), max_size=12))
def test_layout_places_every_piece_once(histogram):
    size, h = 32, np.zeros(33, np.int64)
    for k, n in histogram.items():
        h[k] = n
    plan = packing.layout(h, size, tolerance=1)
    length = np.repeat(np.arange(33), h)
    rank = np.concatenate([np.arange(n) for n in h]) if h.sum() else np.zeros(0, np.int64)
    row, cut, part, sequence, offset = plan.assign(length, rank)
    assert part.sum() == length.sum() and (np.bincount(row, part, minlength=len(length)) == length).all()
    order = np.lexsort((offset, sequence))
    s, o, p = sequence[order], offset[order], part[order]
    first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    assert (o[first] == 0).all() and (o[1:][~first[1:]] == (o + p)[:-1][~first[1:]]).all() and (o + p <= size).all()
    # of whole sequences no more than a token each is wasted, and the rest is one run
    assert sequence.max(initial=-1) + 1 <= -(-length.sum() // (size - 1)) + 1


def test_patterns_near_the_optimum():
    h = np.zeros(1025, np.int64)
    h[[300, 724, 512, 100]] = [1000, 1000, 500, 0]
    total = sum(x for _, x in packing.patterns(h))
    assert abs(total - (h @ np.arange(1025)) / 1024) < 2
