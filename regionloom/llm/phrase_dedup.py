"""Removal of repeated 50-word passages with Aho-Corasick automata of recurring phrases.

1. Every document gives its anchors (see ``repeats``): phrases of ``PHRASE`` words, such that each
   50-word window has one and equal windows have the same one. A phrase that is an anchor of
   documents with different doc_ids is confirmed; all others are dropped.
2. The stretch of words around a confirmed phrase goes to the shard that owns the phrase. The shard
   compiles its phrases into one automaton and streams its stretches through it, so every occurrence
   is located by its text. Streaming whole documents through every shard would cost the product of
   both; a stretch meets one automaton only.
3. Around the occurrences of one phrase the windows are compared word by word, to the left and to
   the right; a window is removed if an equal one starts in a document with a smaller doc_id.
4. The removed ranges are joined with the documents and cut out.

A shard holds about ``SHARD_SPANS`` stretches of different content. A phrase with more is dealt over
several shards; each sends one row per distinct window on, and the smallest doc_id over all
shards decides.

Words are compared by 64-bit hashes, phrases by their text.

Defined cases: a null text has no words; documents under 50 words lose nothing; rows of one doc_id
do not remove each other's words; rows with a null doc_id neither lose words nor take any.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from regionloom.llm import repeats
from regionloom.llm.suffix_dedup import numbered
from regionloom.llm.textkit import ByteHash, slices, text_buffer, word_spans
from regionloom.session import checkpointed

WINDOW = 50
PHRASE = 8
SHARD_SPANS = 16_000


def _anchor_batches(window: int, k: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch["text"])
            for a, b in slices(offsets):
                base = offsets[a]
                part = data[base:offsets[b]]
                starts, ends, first = word_spans(part, offsets[a:b + 1] - base)
                hashed = ByteHash(ByteHash(part).of(starts, ends))
                places = np.arange(max(0, len(starts) - k + 1))
                grams = hashed.of(places, places + k)
                at, lo, hi = repeats.anchors(grams, first, window, k)
                row = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_pydict({
                    "id": batch["id"].take(pa.array(row + a)), "doc_id": batch["doc_id"].take(pa.array(row + a)),
                    "gram": pa.array(grams[at].view(np.int64)),
                    "span": pa.array((hashed.of(lo, hi + window) ^ (at - lo).astype(np.uint64)).view(np.int64)),
                    "at": pa.array((at - first[row]).astype(np.int32)),
                    "low": pa.array((at - hi).astype(np.int32)), "high": pa.array((at - lo).astype(np.int32))})
    return run


_WANT = {"shard": pa.int64(), "gram": pa.int64(), "span": pa.int64(), "owner": pa.int64(), "at": pa.int32(), "low": pa.int32(),
         "high": pa.int32(), "split": pa.bool_()}


def _stretch_batches(window: int):
    """The text of the wanted stretches of words of each document, some megabytes at a time."""
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch["text"])
            wants, flat = batch["want"], batch["want"].flatten()
            edges = wants.offsets.to_numpy().astype(np.int64)
            edges = edges - edges[0]
            for a, b in slices(offsets):
                base, w0, w1 = offsets[a], edges[a], edges[b]
                starts, ends, first = word_spans(data[base:offsets[b]], offsets[a:b + 1] - base)
                mine = flat.slice(w0, w1 - w0)
                row = np.repeat(np.arange(b - a), np.diff(edges[a:b + 1]))
                at, low, high = (mine.field(c).to_numpy().astype(np.int64) for c in ("at", "low", "high"))
                lo = base + starts[first[row] + at - high]
                hi = base + ends[first[row] + at - low + window - 1]
                for c, d in slices(np.concatenate([[0], np.cumsum(hi - lo)]), 4 << 20):
                    seg = [data[x:y].tobytes() for x, y in zip(lo[c:d].tolist(), hi[c:d].tolist())]
                    yield pa.RecordBatch.from_pydict({**{n: mine.field(n).slice(c, d - c).cast(t) for n, t in _WANT.items()}, "bytes": pa.array(seg, pa.binary())})
    return run


def _located(words: list[list[bytes]], high: np.ndarray, k: int) -> np.ndarray:
    """Number of the phrase that an automaton of all phrases finds at each stretch's anchor (-1: none)."""
    machine = ahocorasick.Automaton()
    phrases: dict[str, int] = {}
    for w, h in zip(words, high):
        text = (b" " + b" ".join(w[h:h + k]) + b" ").decode()
        machine.add_word(text, phrases.setdefault(text, len(phrases)))
    machine.make_automaton()
    out = np.full(len(words), -1, np.int64)
    for i, (w, h) in enumerate(zip(words, high)):
        stop = len((b" " + b" ".join(w[:h + k])).decode())
        for end, number in machine.iter((b" " + b" ".join(w) + b" ").decode()):
            if end == stop:
                out[i] = number
                break
    return out


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), max(1, width)), np.uint64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r[:width]
    return out


def _shard_ranges(window: int, k: int):
    """Of the stretches of one shard, the windows that an earlier document has, as ranges of offsets."""
    def run(spans: pd.DataFrame) -> pd.DataFrame:
        spans = spans.reset_index(drop=True)
        low, high = spans["low"].to_numpy(np.int64), spans["high"].to_numpy(np.int64)
        words = [b.split() for b in spans["bytes"]]
        phrase = _located(words, high, k)
        flat = pa.array([b" ".join(w).decode() for w in words])
        data, offsets = text_buffer(flat)
        starts, ends, first = word_spans(data, offsets)
        hashes = ByteHash(data).of(starts, ends)
        rows = [hashes[first[i]:first[i + 1]] for i in range(len(words))]
        right = [r[h:] for r, h in zip(rows, high)]
        left = [r[:h][::-1] for r, h in zip(rows, high)]
        size = lambda x: np.array([len(t) for t in x], np.int64)
        owner, split = spans["owner"].to_numpy(np.int64), spans["split"].to_numpy(bool)
        found = np.zeros((len(spans), int(high.max()) + 1), bool)
        sent = []
        for o, members, classes in repeats.window_classes(phrase, _padded(right, window), size(right), _padded(left, int(high.max())), size(left), low, high, window, 1):
            ok = phrase[members] >= 0
            members, classes = members[ok], classes[ok]
            _, inverse = np.unique(classes, return_inverse=True)
            first_owner = np.full(len(members), np.iinfo(np.int64).max)
            np.minimum.at(first_owner, inverse, owner[members])
            late = owner[members] > first_owner[inverse]
            found[members[late], o] = True
            for m in members[split[members] & ~late]:
                sent.append((m, o, xxhash.xxh3_128_digest(rows[m][high[m] - o:high[m] - o + window].tobytes())))
        gram, span = spans["gram"].to_numpy(), spans["span"].to_numpy()
        out = []
        for i in np.flatnonzero(found.any(axis=1)):
            out += [(gram[i], span[i], owner[i], a, b, None) for a, b in repeats.runs(found[i])]
        out += [(gram[m], span[m], owner[m], o, o + 1, digest) for m, o, digest in sent]
        return pd.DataFrame(out, columns=["gram", "span", "owner", "first", "last", "digest"])
    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW, k: int = PHRASE, shard_spans: int = SHARD_SPANS) -> DataFrame:
    """(id, start, stop): ranges of words of documents (id, doc_id, text) that an earlier document has."""
    known = docs.filter("doc_id is not null").select("id", "doc_id", "text")
    found = known.mapInArrow(_anchor_batches(window, k), "id long, doc_id long, gram long, span long, at int, low int, high int")
    # written first, so that the join below has plain shuffles on both sides and a hot phrase can be split
    again = checkpointed(found.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("gram"))
    found = checkpointed(found.join(again.hint("merge"), "gram"))
    spans = checkpointed(found.groupBy("gram", "span").agg(F.min(F.struct("doc_id", "id", "at", "low", "high")).alias("r"), F.max("doc_id").alias("last")))
    owners = spans.select("gram", "span", F.col("r.doc_id").alias("owner"))
    late = spans.filter(F.col("last") > F.col("r.doc_id")).select("gram", "span", F.col("r.doc_id").alias("owner"))
    reach = ((F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + window).alias("stop"))
    covered = found.join(late.hint("merge"), ["gram", "span"]).filter("doc_id > owner").select("id", *reach)
    groups = owners.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("owner").alias("a"), F.max("owner").alias("b"))
    groups = checkpointed(groups.filter("kinds > 1 and a < b").select("gram", "kinds"))
    chosen = spans.join(groups.hint("merge"), "gram")
    shards = max(1, -(-chosen.count() // (shard_spans // 2)))
    parts = F.ceil(F.col("kinds") / F.lit(shard_spans))
    deal = F.pmod(F.xxhash64("span"), parts)
    shard = F.when(parts > 1, -1 - F.pmod(F.xxhash64("gram", deal), F.lit(1 << 40))).otherwise(F.pmod(F.xxhash64("gram"), F.lit(shards)))
    want = chosen.select(F.col("r.id").alias("id"), F.struct(
        shard.cast("long").alias("shard"), "gram", "span", F.col("r.doc_id").alias("owner"), F.col("r.at").alias("at"), F.col("r.low").alias("low"),
        F.col("r.high").alias("high"), (parts > 1).alias("split")).alias("w"))
    want = want.groupBy("id").agg(F.collect_list("w").alias("want"))  # as many as the document's own anchors
    schema = "shard long, gram long, span long, owner long, at int, low int, high int, split boolean, bytes binary"
    stretches = known.select("id", "text").join(want.hint("merge"), "id").mapInArrow(_stretch_batches(window), schema)
    compared = checkpointed(stretches.groupBy("shard").applyInPandas(_shard_ranges(window, k), "gram long, span long, owner long, first int, last int, digest binary"))
    across = compared.filter("digest is not null")
    earliest = across.groupBy("digest").agg(F.min("owner").alias("e_"), F.max("owner").alias("l_")).filter("e_ < l_").select("digest", "e_")
    far = across.join(earliest.hint("merge"), "digest").filter("owner > e_").select(*(c for c in compared.columns if c != "digest"))
    hits = compared.filter("digest is null").drop("digest").union(far)
    inside = found.join(hits.hint("merge"), ["gram", "span"]).filter("doc_id = owner").select(
        "id", (F.col("at") - F.col("last") + 1).alias("start"), (F.col("at") - F.col("first") + window).alias("stop"))
    return covered.union(inside)


def _cut_batches(batches):
    for batch in batches:
        removed, total, kept = [], [], []
        for text, ranges in zip(batch["text"].to_pylist(), batch["ranges"].to_pylist()):
            words = (text or "").encode().split()
            keep, at = [], 0
            for a, b in sorted((r["start"], r["stop"]) for r in ranges or []):
                keep += words[at:max(at, a)]
                at = max(at, b)
            keep += words[at:]
            total.append(len(words))
            removed.append(len(words) - len(keep))
            kept.append(hashlib.sha256(b" ".join(keep)).hexdigest())
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_words": pa.array(total, pa.int64()),
                                          "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})


def deduplicate(docs: DataFrame, window: int = WINDOW, k: int = PHRASE, shard_spans: int = SHARD_SPANS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of ``docs``."""
    rows = numbered(docs)
    ranges = repeated_ranges(rows, window, k, shard_spans).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    joined = rows.join(ranges.hint("merge"), "id", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cut_batches, "doc_id long, n_words long, n_removed long, kept_sha256 string")
