"""Vectorised words, hashes and repeats next to plain Python."""

import random

import numpy as np
import pyarrow as pa

from regionloom.llm import repeats
from regionloom.llm.textkit import ByteHash, run_hashes, slices, text_buffer, word_hashes, word_spans

TEXTS = ["a b", None, "", "  x  y\x0bz ", "héé wé", "x", "x", "\t", "end"]


def test_words_are_the_same_as_split():
    data, offsets = text_buffer(pa.array(TEXTS))
    starts, ends, first = word_spans(data, offsets)
    words = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    assert [words[first[i]:first[i + 1]] for i in range(len(TEXTS))] == [(t or "").encode().split() for t in TEXTS]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    data, offsets = text_buffer(pa.array(TEXTS + ["X x"]))
    hashes, _ = word_hashes(data, offsets, lower=True)
    words = [w.lower() for t in TEXTS + ["X x"] for w in (t or "").split()]
    for i, a in enumerate(words):
        assert [a == b for b in words] == (hashes[i] == hashes).tolist()


def test_runs_of_words():
    data, offsets = text_buffer(pa.array(["a b c d", "b c d", "a", "", "a b", "b a"]))
    runs, first = run_hashes(*word_hashes(data, offsets), 3)
    assert np.diff(first).tolist() == [2, 1, 1, 0, 1, 1]
    assert runs[1] == runs[2] and len(set(runs.tolist())) == 5


def test_slices_cover_all_rows_once():
    offsets = np.array([0, 5, 5, 900, 905, 910])
    parts = list(slices(offsets, 10))
    assert [r for a, b in parts for r in range(a, b)] == list(range(5))


def test_anchors_of_equal_windows_are_at_the_same_place():
    rng = random.Random(1)
    data = np.array([rng.randrange(3) for _ in range(400)] * 2, np.uint8)
    places = np.arange(len(data) - 3)
    at, low, high = repeats.anchors(ByteHash(data).of(places, places + 4), np.array([0, 300, len(data)]), 20, 4)
    place = {s: p - s for p, a, b in zip(at, low, high) for s in range(a, b + 1)}
    assert sorted(place) == [s for s in range(len(data) - 19) if s + 20 <= 300 or s >= 300]
    by_text = {}
    for s, offset in place.items():
        assert by_text.setdefault(data[s:s + 20].tobytes(), offset) == offset


def test_anchors_of_texts_longer_than_a_key_can_place(monkeypatch):
    rng = random.Random(6)
    data = np.array([rng.randrange(4) for _ in range(500)], np.uint8)
    data[400:460] = data[10:70]
    places = np.arange(len(data) - 3)
    grams, rows = ByteHash(data).of(places, places + 4), np.array([0, len(data)])
    want = [a.tolist() for a in repeats.anchors(grams, rows, 20, 4)]
    monkeypatch.setattr(repeats, "_PLACE_BITS", 6)
    assert [a.tolist() for a in repeats.anchors(grams, rows, 20, 4)] == want


def test_deep_shallow_order_and_common_prefixes():
    rng = random.Random(2)
    rows = [bytes(rng.choice(b"ab") for _ in range(24)) for _ in range(200)] + [b"a" * 24] * 5 + [b"a" * 23 + b"b"]
    words = np.frombuffer(b"".join(rows), ">u8").astype(np.uint64).reshape(len(rows), 3)
    group = np.array([rng.randrange(3) for _ in rows])
    order = repeats.deep_shallow_order(words, group)
    assert [(group[i], rows[i]) for i in order] == sorted((g, r) for g, r in zip(group, rows))
    lcp = repeats.common_prefix(words, order, group, np.full(len(rows), 24), 8)
    for n, (a, b) in enumerate(zip(order[:-1], order[1:]), 1):
        want = next((k for k in range(24) if rows[a][k] != rows[b][k]), 24) if group[a] == group[b] else -1
        assert lcp[n] == want
