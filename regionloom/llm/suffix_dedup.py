"""Exact removal of repeated 200-byte strings with a sparse suffix array, sorted deep-shallow.

The suffixes that are sorted are those that begin at anchors (see ``repeats``): every 200-byte
string has one, and equal strings have the same one. Per shard of anchors the suffixes are ordered
by multikey quicksort to a shallow depth and by blind tries beyond it; so are the reversed texts to
the left of the anchors. The common prefixes of both orders say which strings occur twice.

1. Every document gives its anchors: hash of the 32 bytes, hash of the whole span, place.
2. Anchors whose hash occurs once are dropped. Spans that occur twice as a whole are covered.
3. Of the other spans with a common anchor, one of each content goes, with its bytes, to the shard of
   its anchor, where the suffixes are sorted. A shard holds at most about ``SHARD_SPANS`` spans.
   An anchor with more spans is dealt over several shards; each sends one row per distinct
   string on to a count over all of them, so nothing is missed and no shard grows with an anchor.
4. The covered ranges are joined with the documents and cut out.

Spans are compared by their bytes; anchors and whole spans by 64-bit hashes (two of them for spans).

Defined cases: a null text is empty; documents under 200 bytes lose nothing; repeated rows have
their own row each and count as other places; rows are told apart by doc_id and, if it repeats or
is null, by the row's content and number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from regionloom.llm import repeats
from regionloom.llm.textkit import ByteHash, slices, text_buffer
from regionloom.session import checkpointed

WINDOW = 200
GRAM = 32
SHARD_SPANS = 16_000
_RIGHT = WINDOW
_LEFT = WINDOW - GRAM

def _anchor_batches(window: int, k: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch["text"])
            for a, b in slices(offsets):
                base = offsets[a]
                part, first = data[base:offsets[b]], offsets[a:b + 1] - base
                hashed = ByteHash(part)
                places = np.arange(max(0, len(part) - k + 1))
                grams = hashed.of(places, places + k)
                at, lo, hi = repeats.anchors(grams, first, window, k)
                row = np.searchsorted(first, at, "right") - 1
                cut = at - lo, at - hi
                yield pa.RecordBatch.from_pydict({
                    "id": batch["id"].take(pa.array(row + a)), "gram": pa.array(grams[at].view(np.int64)),
                    "span": pa.array((hashed.of(lo, hi + window) ^ cut[0].astype(np.uint64)).view(np.int64)),
                    "at": pa.array((at - first[row]).astype(np.int32)),
                    "low": pa.array(cut[1].astype(np.int32)), "high": pa.array(cut[0].astype(np.int32))})
    return run


_WANT = {"shard": pa.int64(), "gram": pa.int64(), "at": pa.int32(), "low": pa.int32(), "high": pa.int32(), "many": pa.bool_(), "split": pa.bool_()}


def _span_batches(window: int):
    """The bytes of the wanted spans of each document, some megabytes at a time."""
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch["text"])
            wants, flat = batch["want"], batch["want"].flatten()
            n = np.diff(wants.offsets.to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(len(wants)), n)
            at, low, high = (flat.field(c).to_numpy().astype(np.int64) for c in ("at", "low", "high"))
            start = offsets[row] + at - high
            size = high - low + window
            for a, b in slices(np.concatenate([[0], np.cumsum(size)]), 4 << 20):
                seg = [data[s:s + z].tobytes() for s, z in zip(start[a:b].tolist(), size[a:b].tolist())]
                yield pa.RecordBatch.from_pydict({"id": batch["id"].take(pa.array(row[a:b])),
                                                  **{c: flat.field(c).slice(a, b - a).cast(t) for c, t in _WANT.items()}, "bytes": pa.array(seg, pa.binary())})
    return run


def _words(rows: list[bytes], width: int) -> np.ndarray:
    """Zero-padded big-endian words of byte strings."""
    size = -(-width // 8) * 8
    flat = np.frombuffer(b"".join(r[:size].ljust(size, b"\0") for r in rows), ">u8")
    return flat.astype(np.uint64).reshape(len(rows), -1)


def _shard_ranges(window: int):
    """Of the spans of one shard, the windows that occur twice there, and what other shards must know."""
    def run(spans: pd.DataFrame) -> pd.DataFrame:
        spans = spans.reset_index(drop=True)
        low, high = spans["low"].to_numpy(np.int64), spans["high"].to_numpy(np.int64)
        text = spans["bytes"].tolist()
        right = [t[h:] for t, h in zip(text, high)]
        left = [t[:h][::-1] for t, h in zip(text, high)]
        group = np.unique(spans["gram"].to_numpy(), return_inverse=True)[1]
        many, split = spans["many"].to_numpy(bool), spans["split"].to_numpy(bool)
        width = int(high.max() - low.min()) + window
        found = np.zeros((len(spans), int(high.max()) + 1), bool)
        sent = []
        size = lambda x: np.array([len(t) for t in x], np.int64)
        for o, members, classes in repeats.window_classes(group, _words(right, min(width, window)), size(right), _words(left, max(8, int(high.max()))),
                                                          size(left), low, high, window, 8):
            _, inverse, count = np.unique(classes, return_inverse=True, return_counts=True)
            twice = count[inverse] > 1
            found[members[twice], o] = True
            for i in np.flatnonzero(split[members]):  # rare: an anchor that is dealt over shards
                m = members[i]
                digest = xxhash.xxh3_128_digest(text[m][high[m] - o:high[m] - o + window])
                sent.append((m, o, digest, bool(twice[i] or many[m])))
        out = []
        ids, at = spans["id"].to_numpy(), spans["at"].to_numpy(np.int64)
        for i in np.flatnonzero(found.any(axis=1) & ~many):
            for a, b in repeats.runs(found[i]):
                out.append((ids[i], at[i] - (b - 1), at[i] - a + window, None, None))
        once = {}
        for m, o, digest, twice in sent:  # one row per distinct string of this shard
            once[digest] = (ids[m], at[m] - o, at[m] - o + window, digest, twice)
        out += once.values()
        return pd.DataFrame(out, columns=["id", "start", "stop", "digest", "twice"])
    return run


def _cut_batches(batches):
    for batch in batches:
        data, offsets = text_buffer(batch["text"])
        removed, spans, kept = [], [], []
        for i, ranges in enumerate(batch["ranges"].to_pylist()):
            text = data[offsets[i]:offsets[i + 1]]
            n, merged = 0, []
            for r in sorted((r["start"], r["stop"]) for r in ranges or []):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            digest, at = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(text[at:a].tobytes())
                n, at = n + b - a, b
            digest.update(text[at:].tobytes())
            removed.append(n)
            spans.append(len(merged))
            kept.append(digest.hexdigest())
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"], "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})


def numbered(docs: DataFrame) -> DataFrame:
    """(id, doc_id, text): ``id`` is the doc_id where that names one row, else a number derived from the row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if counts.limit(1).count() == 0:
        return rows.withColumn("id", F.col("doc_id"))
    # ids repeat: rows are numbered within (doc_id, text), which takes a shuffle of the texts
    twin = W.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    return rows.withColumn("n_", F.row_number().over(twin)).withColumn("id", F.xxhash64("doc_id", F.xxhash64("text"), "n_")).drop("n_")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, k: int = GRAM, shard_spans: int = SHARD_SPANS) -> DataFrame:
    """(id, start, stop): byte ranges of documents (id, text) that are covered by repeated strings."""
    schema = "id long, gram long, span long, at int, low int, high int"
    found = docs.select("id", "text").mapInArrow(_anchor_batches(window, k), schema)
    # written first, so that the join below has plain shuffles on both sides and a hot anchor can be split
    again = checkpointed(found.groupBy("gram").agg(F.count("*").alias("n_")).filter("n_ > 1").drop("n_"))
    found = checkpointed(found.join(again.hint("merge"), "gram"))
    # spans by content: how often, and one place
    spans = found.groupBy("gram", "span").agg(F.count("*").alias("copies"), F.min(F.struct("id", "at", "low", "high")).alias("r"))
    spans = checkpointed(spans)
    whole = spans.filter("copies > 1").select("gram", "span")
    covered = found.join(whole.hint("merge"), ["gram", "span"]).select("id", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + window).alias("stop"))
    groups = checkpointed(spans.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    chosen = spans.join(groups.hint("merge"), "gram")
    shards = max(1, -(-chosen.count() // (shard_spans // 2)))
    # a small part of the shard numbers would do for most anchors; one with many spans gets several
    parts = F.ceil(F.col("kinds") / F.lit(shard_spans))
    deal = F.pmod(F.xxhash64("span"), parts)
    shard = F.pmod(F.xxhash64("gram", F.when(parts > 1, deal).otherwise(F.lit(0))), F.lit(shards))
    shard = F.when(parts > 1, -1 - F.pmod(F.xxhash64("gram", deal), F.lit(1 << 40))).otherwise(shard)
    want = chosen.select(F.col("r.id").alias("id"), F.struct(
        shard.cast("long").alias("shard"), "gram", F.col("r.at").alias("at"), F.col("r.low").alias("low"), F.col("r.high").alias("high"),
        (F.col("copies") > 1).alias("many"), (parts > 1).alias("split")).alias("w"))
    want = want.groupBy("id").agg(F.collect_list("w").alias("want"))  # as many as the document's own anchors
    seg_schema = "id long, shard long, gram long, at int, low int, high int, many boolean, split boolean, bytes binary"
    segments = docs.select("id", "text").join(want.hint("merge"), "id").mapInArrow(_span_batches(window), seg_schema)
    compared = checkpointed(segments.groupBy("shard").applyInPandas(_shard_ranges(window), "id long, start long, stop long, digest binary, twice boolean"))
    inside = compared.filter("digest is null").select("id", "start", "stop")
    across = compared.filter("digest is not null")
    known = across.groupBy("digest").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n_")).filter("n_ > 1").select("digest")
    far = across.filter("not twice").join(known, "digest").select("id", "start", "stop")
    return covered.union(inside).union(far)


def deduplicate(docs: DataFrame, window: int = WINDOW, k: int = GRAM, shard_spans: int = SHARD_SPANS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs``."""
    rows = numbered(docs)
    ranges = repeated_ranges(rows, window, k, shard_spans).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    joined = rows.join(ranges.hint("merge"), "id", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cut_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
