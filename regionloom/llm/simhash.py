"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most three
bits share at least five of them (``GUARANTEED``). A posting list per single byte would hold a
256th of all documents, so the lists are keyed by four bytes at a time: of the 14 sets of four
positions used here (the blocks of a Steiner system), every five positions contain at least one,
so every such pair meets in a list. Within a list the shared positional bytes of each pair are
tallied, pairs below the guaranteed number are dropped, the others are verified bit by bit.

Equal fingerprints are one entry, however many documents have them. A list of more than ``CELL``
entries is cut into blocks, and each pair of blocks is worked on by itself, so no list has to fit
one task. A cell emits the links of a spanning forest of its verified pairs, not all pairs;
components stay the same.

Defined cases: null and empty texts have fingerprint zero and are linked like any other. Rows
with a null doc_id get a component like all others; component_id is the smallest doc_id in it that
is not null, or null. Repeated rows are separate rows with the same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from regionloom.llm.components import star_components
from regionloom.llm.textkit import with_columns
from regionloom.session import checkpointed

GUARANTEED = 5
MAX_BITS = 3
CELL = 512
#: Index rows that one task works on at a time.
BUCKET_ROWS = 40_000


def position_sets() -> list[tuple[int, ...]]:
    """14 sets of 4 of the 8 byte positions; every 5 positions contain one of them.

    The two halves, and for each way to split a half into two pairs, every pair of the one half
    with every pair of the other that comes from the same way.
    """
    ways = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    sets = [(0, 1, 2, 3), (4, 5, 6, 7)]
    return sets + [a + tuple(p + 4 for p in b) for way in ways for a in way for b in way]


def _shingle_hashes(text: str | None, k: int) -> list[int]:
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(b" ".join(words), 42)] if words else []
    return [digest(b" ".join(w), 42) for w in zip(*(words[i:] for i in range(k)))]


def fingerprint_array(texts: list[str | None], k: int = 3) -> np.ndarray:
    """Fingerprints of whole texts as unsigned 64-bit numbers; zero where there are no words."""
    out = np.zeros(len(texts), np.uint64)
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size < 1 << 20):  # texts of about a megabyte at a time
            size += len(texts[b] or "")
            b += 1
        hashes = [_shingle_hashes(t, k) for t in texts[a:b]]
        full = np.flatnonzero([len(h) for h in hashes])
        if len(full):
            flat = np.concatenate([np.array(hashes[i], np.uint64) for i in full])
            n = np.array([len(hashes[i]) for i in full])
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            bits = np.unpackbits(flat.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            out[a + full] = np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel()
        a = b
    return out


def _fingerprint_batches(k: int, keep: bool):
    def run(batches):
        for batch in batches:
            fp = pa.array(fingerprint_array(batch["text"].to_pylist(), k).view(np.int64))
            yield with_columns(batch if keep else batch.select(["doc_id"]), ["fp_"], [fp])
    return run


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint's bits as a signed number."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp_", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches(k, False), schema).withColumnRenamed("fp_", "fp")


def _cell_links(fps: np.ndarray, left: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the verified pairs of one cell: left entries with right ones, or all with all."""
    i_all, j_all = [], []
    at = np.arange(len(fps))
    a, b = (at[left], at[~left]) if (~left).any() else (at, at)
    for s in range(0, len(a), 256):
        diff = fps[a[s:s + 256], None] ^ fps[None, b]
        shared = sum(((diff >> np.uint64(8 * p)) & np.uint64(255)) == 0 for p in range(8))
        i, j = np.nonzero(shared >= GUARANTEED)
        ok = np.bitwise_count(diff[i, j]) <= max_bits
        i, j = a[s:s + 256][i[ok]], b[j[ok]]
        i_all.append(i[i != j])
        j_all.append(j[i != j])
    i, j = np.concatenate(i_all), np.concatenate(j_all)
    root = at.copy()
    while len(i):  # smallest label over links, until nothing changes
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != at)
    return moved, root[moved]


def _bucket_links(max_bits: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "x", "y"], kind="stable")
        fps = rows["fp"].to_numpy().view(np.uint64)
        left = (rows["block"] == rows["x"]).to_numpy()
        same = (rows[["key", "x", "y"]].diff().fillna(1) == 0).all(axis=1).to_numpy()
        cuts = np.append(np.flatnonzero(~same), len(rows))
        us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                u, v = _cell_links(fps[a:b], left[a:b], max_bits)
                us.append(fps[a:b][u])
                vs.append(fps[a:b][v])
        return pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)}).drop_duplicates()
    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` whose components are those of all close pairs."""
    keys = []
    for t, places in enumerate(position_sets()):
        value = F.lit(t).cast("long")
        for p in places:
            value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255)))
        keys.append(value)
    index = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    index = checkpointed(index.join(sizes, "key"))
    blocks = F.ceil(F.col("n") / F.lit(CELL)).cast("int")
    cells = (
        index.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "fp", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    )
    buckets = max(1, -(-cells.count() // BUCKET_ROWS))
    return (
        cells.withColumn("bucket", F.pmod(F.xxhash64("key", "x", "y"), F.lit(buckets)))
        .groupBy("bucket").applyInPandas(_bucket_links(max_bits), "u long, v long").distinct()
    )


def fingerprint_components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) for the distinct fingerprints that have a close one."""
    return star_components(links(fps.select("fp").distinct(), max_bits), "u", "v").withColumnRenamed("node", "fp")


def _marked(docs: DataFrame, k: int, max_bits: int) -> DataFrame:
    """(doc_id, fp, root, component_id) per row; root is the component's smallest fingerprint."""
    prints = checkpointed(fingerprints(docs, k))
    roots = fingerprint_components(prints, max_bits)
    per_fp = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = per_fp.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(per_fp.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, k: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``."""
    return _marked(docs, k, max_bits).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, k: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with one document per component: that of the smallest doc_id.

    Of several rows with that doc_id one stays. A component in which no row has a doc_id keeps
    one of its rows.
    """
    groups = checkpointed(_marked(docs, k, max_bits).groupBy("root").agg(F.min("component_id").alias("doc_id"), F.min("fp").alias("fp")))
    known, lost = groups.filter("doc_id is not null").select("doc_id"), groups.filter("doc_id is null").select("fp")
    order = F.xxhash64(*docs.columns)
    kept = docs.join(known, "doc_id", "left_semi")
    kept = kept.withColumn("n_", F.row_number().over(W.partitionBy("doc_id").orderBy(order))).filter("n_ = 1").drop("n_")
    unnamed = docs.filter("doc_id is null")
    unnamed = unnamed.mapInArrow(_fingerprint_batches(k, True), T.StructType([*docs.schema, T.StructField("fp_", T.LongType())]))
    unnamed = unnamed.join(lost.withColumnRenamed("fp", "fp_"), "fp_", "left_semi")
    unnamed = unnamed.withColumn("n_", F.row_number().over(W.partitionBy("fp_").orderBy(order))).filter("n_ = 1")
    return kept.select(*docs.columns).union(unnamed.select(*docs.columns))
