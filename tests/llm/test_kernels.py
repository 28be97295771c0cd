"""The numpy kernels against plain versions."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelake.llm._bwt import prefixes_of, suffix_array
from sievelake.llm._text import Words, flat
from sievelake.llm.line_crf import Crf, describe
from sievelake.llm.packing import pack
from sievelake.llm.simhash import _blocks, _merge, trie_pairs, word_shingle_hashes
from sievelake.llm.substring import repeated_windows, runs

TEXTS = st.lists(st.text(alphabet="ab \n\té", max_size=40), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_split(texts):
    words = Words(*flat(pa.array(texts)))
    assert [bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends, strict=True)] == [w for t in texts for w in t.encode().lower().split()]
    hashes, first = words.shingles(2)
    plain = [[tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))] if (w := t.encode().lower().split()) else [] for t in texts]
    assert np.diff(first).tolist() == [len(x) for x in plain]
    named = {}
    for h, s in zip(hashes.tolist(), itertools.chain(*plain), strict=True):
        assert named.setdefault(s, h) == h
    assert len(set(named.values())) == len(named)


def test_flat_reads_slices_and_nulls():
    data, offsets = flat(pa.array(["xx", None, "é", ""]).slice(1))
    assert bytes(data) == "é".encode() and offsets.tolist() == [0, 0, 2, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(1, 9))
def test_interval_expansion_gives_common_prefixes(symbols, least):
    s = np.array([*symbols, 0])
    order = suffix_array(s, least + 1)
    got = prefixes_of(s, order, least)
    for row in range(1, len(order)):
        a, b = s[order[row - 1] :].tolist(), s[order[row] :].tolist()
        common = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert got[row] == min(common, least)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=40, max_size=70).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=5), st.randoms())
def test_repeated_windows_of_runs(texts, rng):
    length = 32
    texts = [t + texts[0][: rng.randrange(40)] for t in texts]
    windows = np.array([len(t) - length + 1 for t in texts])
    # windows are only compared at equal distances from the anchors
    anchors = np.array([8 * rng.randrange(4) for _ in texts])
    flags = repeated_windows(texts, windows, anchors, length)
    seen = {}
    for r, t in enumerate(texts):
        for k in range(windows[r]):
            seen.setdefault(((k - int(anchors[r])) % 8, t[k : k + length]), []).append((r, k))
    for (_, _), places in seen.items():
        for r, k in places:
            assert flags[r][k] == (len(places) > 1)


@pytest.mark.parametrize("length", [32, 64, 400])
def test_runs_cover_every_window_once_by_content(length):
    rng = random.Random(3)
    base = bytes(rng.choices(b"abcd", k=2000))
    data = np.frombuffer(base + base[500:1500] + b"z" * 900, dtype=np.uint8)
    offsets = np.array([0, 2000, 3000, 3900])
    anchor_of = {}
    for start, size, anchor, name in runs(data, offsets, length):
        for s, m, p, h in zip(start, size, anchor, name, strict=True):
            for k in range(s, s + m):
                assert k not in anchor_of
                anchor_of[k] = (p - k, h)
    assert len(anchor_of) == sum(n - length + 1 for n in (2000, 1000, 900))
    by_content = {}
    for k, v in anchor_of.items():
        assert by_content.setdefault(bytes(data[k : k + length]), v) == v


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=30, unique=True), st.integers(0, 6), st.randoms())
def test_trie_pairs_are_all_near_pairs(values, budget, rng):
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values]
    v = np.unique(np.array(values, dtype=np.uint64))
    got = set()
    for i, j in trie_pairs(v, np.array([0]), np.array([len(v)]), np.array([0]), np.array([len(v)]), 0, budget):
        got |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= budget}


def test_blocks_cover_all_bits():
    for budget in range(8):
        assert [b for s, w in _blocks(budget) for b in range(s, s + w)] == list(range(64))


def test_merge_points_at_the_least():
    parent = np.arange(6)
    _merge(parent, np.array([5, 3, 1]), np.array([3, 1, 0]))
    assert parent.tolist() == [0, 0, 2, 0, 4, 0]


def test_shingles_of_short_and_empty_texts():
    assert word_shingle_hashes(None, 3) == word_shingle_hashes(" \n", 3) == []
    assert len(word_shingle_hashes("one two", 3)) == 1 and len(word_shingle_hashes("a b c d", 3)) == 2
    assert word_shingle_hashes("A  B\tC", 3) == word_shingle_hashes("a b c", 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 11), min_size=1, max_size=7), st.floats(-1, 1))
def test_viterbi_is_the_best_labelling(kinds, stay):
    crf = Crf(np.linspace(-2, 2, 12), stay)
    lines = np.zeros((len(kinds) + 1, 12))
    lines[np.arange(len(kinds)), kinds] = 1
    got = crf.viterbi(lines, np.array([0, len(kinds), len(kinds) + 1]))
    gain = lines @ crf.weights
    worth = lambda y: sum(g for g, v in zip(gain, y, strict=False) if v) + stay * sum(a == b for a, b in zip(y, y[1:], strict=False))
    best = max(worth(y) for y in itertools.product((0, 1), repeat=len(kinds)))
    assert abs(worth(got[: len(kinds)].tolist()) - best) < 1e-9


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#é", max_size=60), min_size=1, max_size=4))
def test_base_counts(texts):
    page = describe(*flat(pa.array(texts)))
    for k, t in enumerate(texts):
        words = [w.decode() for w in t.encode().split()]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        cover = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
        lines = t.split("\n")
        dup = sum(1 for i, line in enumerate(lines) if line.encode().split() and line in lines[:i])
        expected = (len(words), sum(map(len, words)), t.count("#"), dup, len(cover))
        assert tuple(int(v[k]) for v in page.base.values()) == expected
        assert page.first_line[k + 1] - page.first_line[k] == len(lines)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_packing_holds_each_piece_once_in_the_least_size(lengths):
    n = np.array(lengths, dtype=np.int64)
    at, bins = pack(n, (16, 32, 64))
    used = np.bincount(at, n, len(bins)) if len(n) else np.zeros(0)
    assert len(at) == len(n) and (used <= bins).all()
    assert all(c == min(x for x in (16, 32, 64) if x >= u) for c, u in zip(bins, used, strict=True))
    if len(n):
        assert len(bins) <= 2 * np.ceil(n.sum() / 64) + 1
