"""Near and exact duplicates next to brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from regionloom.llm import components, minhash, phrase_dedup, simhash, suffix_dedup
from tests.llm.conftest import frame


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    label = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    while True:
        new = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_position_sets_meet_in_every_five():
    sets = simhash.position_sets()
    assert len(set(sets)) == 14
    assert all(any(set(s) <= set(five) for s in sets) for five in itertools.combinations(range(8), 5))


def test_simhash_equals_brute_force(spark, documents, sf):
    got = simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).toPandas().sort_values("doc_id").reset_index(drop=True)
    prints = np.array([int(x, 16) for x in got["fingerprint"]], np.uint64)
    assert [fingerprint(t) for t in documents["text"][:60]] == prints[:60].tolist()
    assert documents["doc_id"].to_numpy()[components_of(prints)].tolist() == got["component_id"].tolist()


@pytest.mark.parametrize("cell", [512, 7])
def test_dense_fingerprints_keep_their_components(spark, monkeypatch, cell):
    """A cloud of fingerprints around one, in lists that are cut into blocks."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(3)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for c in centre for _ in range(60)}
    signed = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in signed.view(np.int64)], "fp long")
    roots = {r["fp"]: r["root"] for r in simhash.fingerprint_components(df).collect()}
    got = [roots.get(int(x), int(x)) for x in signed.view(np.int64)]
    want = components_of(signed)
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(got)) for j in range(i))


def test_simhash_odd_rows(spark, odd_rows, empty):
    docs = frame(spark, odd_rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(odd_rows)
    blank = [r for r in got if r["fingerprint"] == "0" * 16]
    assert len(blank) == 4 and {r["component_id"] for r in blank} == {2}
    kept = simhash.one_per_group(docs.withColumnRenamed("lang", "fp")).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 1, 2, 5, 7]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_per_group(empty).count() == 0


def test_star_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (7, 7), (None, 3), (200, 100)]
    got = {r["node"]: r["root"] for r in components.star_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 100}


def repeated_bytes(texts, window):
    texts = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                gone[i:i + window] = True
        edge = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        yield len(t), int(gone.sum()), edge, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


def mixed_texts(rng, join, alphabet):
    def some(n):
        return join.join(rng.choice(alphabet) for _ in range(n))

    base = [rng.choice(alphabet) for _ in range(50)]
    texts = [some(rng.randint(0, 70)) for _ in range(40)] + [join.join(alphabet[:2] * 25), join.join([alphabet[0]] * 40), None, ""]
    texts += [join.join(base)] * 2 + [some(8) + join + join.join(base[5:42]) + join + some(8) for _ in range(20)]
    return texts + [join.join([*base[:25], rng.choice(alphabet), *base[26:]]) for _ in range(10)]


@pytest.mark.parametrize("shard", [1000, 6])
def test_suffix_dedup_equals_brute_force(spark, shard):
    texts = mixed_texts(random.Random(4), "", ["a", "b", "é"])
    got = suffix_dedup.deduplicate(frame(spark, list(enumerate(texts))), 12, 4, shard).toPandas().sort_values("doc_id")
    assert list(zip(got["n_bytes"], got["n_removed"], got["n_spans"], got["kept_sha256"])) == list(repeated_bytes(texts, 12))


def test_suffix_dedup_on_the_table(spark, documents, sf):
    got = suffix_dedup.deduplicate(spark.read.parquet(f"{sf}/documents.parquet")).toPandas().sort_values("doc_id")
    assert list(zip(got["n_bytes"], got["n_removed"], got["n_spans"], got["kept_sha256"])) == list(repeated_bytes(documents["text"], 200))


def test_suffix_dedup_odd_rows(spark, odd_rows, empty):
    rows = odd_rows + [(8, "x" * 300), (9, "y" * 250), (None, "y" * 250)]
    got = suffix_dedup.deduplicate(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r["n_removed"] for r in got if r["doc_id"] in (8, 9)) == [250, 300]
    assert suffix_dedup.deduplicate(empty).count() == 0


def late_words(ids, texts, window):
    texts = [(t or "").encode().split() for t in texts]
    first = {}
    for d, t in zip(ids, texts):
        for i in range(len(t) - window + 1):
            key = tuple(t[i:i + window])
            first[key] = min(d, first.get(key, d))
    for d, t in zip(ids, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if first[tuple(t[i:i + window])] < d:
                gone[i:i + window] = True
        yield d, (len(t), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(t, gone) if not g)).hexdigest())


@pytest.mark.parametrize("shard", [1000, 6])
def test_phrase_dedup_equals_brute_force(spark, shard):
    rng = random.Random(4)
    texts = mixed_texts(rng, " ", ["a", "b", "cé"])
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = phrase_dedup.deduplicate(frame(spark, list(zip(ids, texts))), 10, 4, shard).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == dict(late_words(ids, texts, 10))


def test_phrase_dedup_odd_rows(spark, odd_rows, empty):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = odd_rows + [(20, passage), (20, passage), (21, "x\n" + passage.replace(" ", "  ")), (None, passage)]
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in phrase_dedup.deduplicate(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    assert sorted(g for g in got if g[0] in (20, 21)) == [(20, 60, 0), (20, 60, 0), (21, 61, 60)]
    assert (None, 60, 0) in got
    assert phrase_dedup.deduplicate(empty).count() == 0


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_minhash_of_texts_and_their_edits(spark, documents, monkeypatch, sf):
    monkeypatch.setattr(minhash, "RANGE_BYTES", 200_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = minhash.fingerprints(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = list(documents["text"])
    after = texts[1:] + texts[:1]
    edited = [t[:len(t) - len(t) // 2] + f[:len(t) // 2] for t, f in zip(texts, after)]
    assert got["n_chars"].tolist() == [len(t) for t in texts]
    assert got["edited_sha256"].tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    assert max(abs(g - jaccard(a, b)) for g, a, b in zip(got["near_edited"], texts, edited)) < 0.2
    assert np.mean([abs(g - jaccard(a, b)) for g, a, b in zip(got["near_next"], texts, after)]) < 0.02
    same = got.groupby(documents["text"])["fingerprint"].nunique()
    assert (same == 1).all()
    named = minhash.fingerprints(docs, minhash.near_duplicate_classes(docs)).toPandas().set_index("doc_id")
    classes = named["class_id"]
    root = list(range(len(texts)))
    holders = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for s in shingles(t):
            holders[s].append(i)
    pairs = {(h[0], i) for h in holders.values() for i in h[1:]} | {p for h in holders.values() if len(h) < 9 for p in itertools.combinations(h, 2)}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if jaccard(texts[a], texts[b]) >= 0.8:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    ids = documents["doc_id"]
    assert [classes[d] for d in ids] == [ids[top(i)] for i in range(len(ids))]


def test_minhash_classes_of_cells_with_several_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 8)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(70):  # a large group around one text, and texts that drift away from it
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 7), replace=False):
            words[at] = f"x{rng.integers(1000)}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(frame(spark, list(enumerate(texts)))).collect()}
    root = list(range(len(texts)))
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.8]
    for _ in texts:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert 1 < len(set(root)) < 60
    assert [got.get(i, i) for i in range(len(texts))] == root


def test_a_check_moves_a_text_once_to_each_shard(spark, monkeypatch):
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(30):
        words = [f"w{i}" for i in range(90)]
        for at in rng.choice(90, rng.integers(0, 5), replace=False):
            words[at] = f"x{rng.integers(1000)}"
        texts.append(" ".join(words))
    pairs = list(itertools.combinations(range(30), 2))
    links = spark.createDataFrame(pairs, "u long, v long")
    for blocks, most in ((1, 30), (2, 90)):
        dealt = minhash._dealt_links(links, blocks, 40)
        assert dealt.select("u", "shard").union(dealt.select("v", "shard")).distinct().count() <= most < len(pairs)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "LINKS", 50)
    got = {(r["u"], r["v"]): r["good"] for r in minhash._checked(frame(spark, list(enumerate(texts))), links).collect()}
    assert got == {(a, b): jaccard(texts[a], texts[b]) >= 0.8 for a, b in pairs} and len(set(got.values())) == 2


def test_minhash_odd_rows(spark, odd_rows, empty):
    docs = frame(spark, odd_rows)
    got = minhash.fingerprints(docs).collect()
    assert len(got) == len(odd_rows)
    blank = [r for r in got if r["doc_id"] in (2, 3, 4)]
    assert {r["fingerprint"] for r in blank} == {"ff" * minhash.PERMS} and blank[0]["near_next"] == 1.0
    single = minhash.fingerprints(frame(spark, [(5, "one two three four five six")])).collect()
    assert single[0]["near_next"] == 1.0
    assert minhash.fingerprints(empty).count() == 0
    assert minhash.near_duplicate_classes(empty).count() == 0


def test_the_forest_of_a_cell_prefers_the_likeliest_links():
    """a-b and b-c are alike enough, a-c nearly: whatever the order, b holds both."""
    a = np.zeros(minhash.PERMS, np.uint8)
    b, c = a.copy(), a.copy()
    b[:18], c[:32] = 1, 1
    for order in itertools.permutations([(1, a), (2, b), (3, c)]):
        rows = pd.DataFrame({"key": 0, "x": 0, "y": 0, "block": 0, "node": [n for n, _ in order], "root": [n for n, _ in order],
                             "failed": None, "sig": [s.tobytes() for _, s in order]})
        got = minhash._cell_links(minhash._forest)(rows)
        assert list(zip(got["u"], got["v"])) == [(1, 2), (2, 3)]


@pytest.mark.parametrize("rounds", [3, 1])
def test_links_hidden_by_a_failed_one_are_checked(spark, monkeypatch, rounds):
    """Forests in the order of the ids take the link 1-3, which fails, and leave out 2-3."""
    words = [f"w{i}" for i in range(204)]
    texts = {1: words, 2: words[:-1 * 22] + ["x", *"abcdefghi"], 3: words[16:-22] + ["x", *"abcdefghi"]}
    texts = {d: " ".join(w) for d, w in texts.items()}
    assert jaccard(texts[1], texts[2]) >= 0.8 <= jaccard(texts[2], texts[3]) and jaccard(texts[1], texts[3]) < 0.8

    def by_id(sig, left, right, root, bad):
        tree, out = {i: i for i in range(len(sig))}, []
        for i, j in itertools.combinations(np.lexsort((root,)).tolist(), 2):
            if tree[i] != tree[j] and root[i] != root[j] and j not in bad[i]:
                out.append((i, j))
                tree = {k: tree[i] if t == tree[j] else t for k, t in tree.items()}
        return out

    monkeypatch.setattr(minhash, "FORESTS", rounds)
    monkeypatch.setattr(minhash, "_forest", by_id)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(frame(spark, list(texts.items()))).collect()}
    assert got == {2: 1, 3: 1}


def test_the_query_names_the_classes(spark):
    from regionloom.llm.queries import op4

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in op4(spark, "/root/testdata/sf0.01").collect() if r["class_id"] != r["doc_id"]}
    assert got and got == {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs).collect()}
