"""Mix sources to target weights by drawing fixed-length token blocks.

The words of a source form one stream: its documents in the order of a hash of the doc_id. The
stream is packed into blocks of ``BLOCK`` words (the last one may be shorter). A source's target
buys so many whole passes over its blocks and a part of one more pass. The blocks of a pass are
visited in a pseudorandom order, a keyed permutation of the block numbers (a Feistel network with
cycle walking); slot j of a pass holds the block that the permutation puts there. The slots of a
source are dealt to the output shards by a multinomial draw. Slots and blocks are joined by
(source, block), so whatever a document's words are taken for follows from that join. The last slot
of a source is cut where its target is reached, so a source gets its target to the word.

Nothing is gathered per source: word offsets are sums inside small buckets of documents, carried
over one row per bucket. Draws are functions of the seed, source and number, so reruns and
recomputed tasks agree.

Defined cases: a null text has no words; documents without words are returned with nothing taken.
A null source is a source of its own, ordered last. Repeated rows are documents of their own
(each is a row of the result). Sources without words have target 0. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regionloom.session import checkpointed

BLOCK = 128
WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3.0
OUTPUT_SHARDS = 16
SEED = 17
#: Documents per bucket, the unit within which word offsets are summed.
BUCKET_DOCS = 1024
#: Most partitions of drawn slots.
MOST_RUNS = 1 << 15
WORD = r"[^\x20\x09-\x0D]+"
_GAPS = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _feistel(x: np.ndarray, half: int, keys: np.ndarray, back: bool = False) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys[::-1] if back else keys:
        inner = left if back else right
        f = (inner + k) * np.uint64(0x9E3779B97F4A7C15)
        f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        f = (f >> np.uint64(32)) & mask
        left, right = (right ^ f, left) if back else (right, left ^ f)
    return (left << np.uint64(half)) | right


def permute(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 evaluated at ``index``, or its inverse (cycle walking)."""
    half = max(1, (max(1, int(n) - 1).bit_length() + 1) // 2)
    keys = np.random.default_rng([SEED, key]).integers(0, 1 << 63, 4, dtype=np.uint64)
    out = _feistel(index.astype(np.uint64), half, keys, back)
    while (far := out >= np.uint64(n)).any():
        out[far] = _feistel(out[far], half, keys, back)
    return out.astype(np.int64)


def source_table(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """source, source_no (code point order, null last), source_size, target: one row per source.

    Sources are few against documents; their shares are solved by rounds over this table, each of
    which caps the sources that are above and shares the rest anew.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a small table: one row per source
    order = W.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))
    numbered = per.withColumn("source_no", F.row_number().over(order) - 1)
    numbered = checkpointed(numbered.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))))
    total = float(numbered.agg(F.sum("source_size")).first()[0] or 0)
    # a source is capped if weight * level > cap * size; the level rises as others are capped
    level, capped = None, -1
    while total > 0:
        over = (F.col("weight") * F.lit(level) > F.lit(cap) * F.col("source_size")) if level is not None else F.lit(False)
        row = numbered.filter("source_size > 0").agg(
            F.sum(F.when(over, F.lit(cap) * F.col("source_size")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("mass"), F.sum(over.cast("int")).alias("n")).first()
        if row["n"] == capped or not row["mass"]:
            break
        capped, level = row["n"], (total - row["fixed"]) / row["mass"]
    share = F.least(F.col("weight") * F.lit(level or 0.0), F.lit(cap) * F.col("source_size"))
    return numbered.withColumn("target", F.when(F.col("source_size") > 0, share).otherwise(0.0)).drop("weight")


def _slots(block: int, shards: int):
    """Slots of runs of passes: block, words taken from its start, output shard."""
    def run(batches):
        for rows in batches:
            for r in rows.itertuples():
                n, last = int(r.blocks), int(r.source_size - (r.blocks - 1) * block)
                key = int(r.source_no) * 64 + int(r.pass_)
                slot = np.arange(r.first, r.last)
                drawn = permute(slot, n, key)
                short = permute(np.array([n - 1]), n, key, back=True)[0]
                before = slot * block - (block - last) * (slot > short)
                size = np.where(drawn == n - 1, last, block)
                take = np.clip(r.words - before, 0, size)
                # how many of the source's slots each output shard draws, then the slots in order
                counts = np.random.default_rng([SEED, int(r.source_no)]).multinomial(int(r.n_slots), np.full(shards, 1 / shards))
                shard = np.searchsorted(np.cumsum(counts), int(r.pass_) * n + slot, "right")
                out = pd.DataFrame({"source_no": np.int64(r.source_no), "block": drawn, "pass_": np.int32(r.pass_), "slot": slot,
                                    "shard": np.minimum(shard, shards - 1).astype(np.int32), "take": take})
                yield out[out["take"] > 0]
    return run


def slots(sources: DataFrame, block: int = BLOCK, shards: int = OUTPUT_SHARDS) -> DataFrame:
    """One row per drawn block: source_no, block, pass_, slot, shard, take (words from its start)."""
    step = 65536
    want = F.round("target").cast("long")
    passes = F.floor((want + F.col("source_size") - 1) / F.col("source_size")).cast("int")
    rows = (
        sources.filter("source_size > 0 and target >= 0.5")
        .withColumn("blocks", F.floor((F.col("source_size") + block - 1) / F.lit(block)))
        .withColumn("n_slots", F.ceil(want / F.lit(block)) + passes)
        .withColumn("pass_", F.explode(F.sequence(F.lit(0), passes - 1)))
        .withColumn("words", F.least(F.col("source_size"), want - F.col("pass_") * F.col("source_size")))
        .withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(step).cast("long"))))
        .withColumn("last", F.least(F.col("first") + step, F.col("blocks")))
        .select("source_no", "source_size", "blocks", "n_slots", "pass_", "words", "first", "last")
    )
    # a row makes up to ``step`` slots; with a stated number of partitions the planner doesn't merge them by their size
    words = sources.agg(F.sum(F.greatest("source_size", "target"))).first()[0] or 0
    rows = rows.repartition(max(1, min(MOST_RUNS, int(words / (block * step)) + sources.count())), "source_no", "pass_", "first")
    return rows.mapInPandas(_slots(block, shards), "source_no long, block long, pass_ int, slot long, shard int, take long")


def placed_documents(sized: DataFrame) -> DataFrame:
    """``sized`` (with source, size, key) and its words' places begin and stop in its source's stream.

    Sums run inside buckets of about ``BUCKET_DOCS`` documents; one row per source and bucket
    carries them on, so a source of a third of all rows is spread like any other.
    """
    sized = sized.withColumn("h_", F.xxhash64("key", F.lit(SEED)))
    buckets = max(1, -(-sized.count() // BUCKET_DOCS))
    sized = sized.withColumn("bucket", F.pmod("h_", F.lit(buckets)))
    inside = W.partitionBy("source", "bucket").orderBy("h_", "key").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("begin", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = (sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0)))
             .select(F.col("source").alias("s_"), F.col("bucket").alias("b_"), "base"))
    placed = placed.join(carry, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("b_")))
    placed = placed.withColumn("begin", F.col("begin") + F.col("base"))
    return placed.withColumn("stop", F.col("begin") + F.col("size")).drop("s_", "b_", "base", "bucket", "h_")


def drawn_pieces(placed: DataFrame, drawn: DataFrame, block: int = BLOCK) -> DataFrame:
    """Join of blocks by index: source_no, begin (names a document), pass_, shard, lo, hi (its words taken)."""
    first, last = F.floor(F.col("begin") / F.lit(block)), F.floor((F.col("stop") - 1) / F.lit(block))
    pieces = placed.filter("size > 0").select("source_no", "begin", "stop", F.explode(F.sequence(first, last)).alias("block"))
    # the planner takes the drawn slots for as few as the sources they come from; both sides grow with the corpus
    got = pieces.join(drawn.hint("merge"), ["source_no", "block"])
    at = F.col("block") * block
    lo, hi = F.greatest(at, F.col("begin")), F.least(at + F.col("take"), F.col("stop"))
    return got.filter(hi > lo).select("source_no", "begin", "pass_", "shard", (lo - F.col("begin")).alias("lo"), (hi - F.col("begin")).alias("hi"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shards: int = OUTPUT_SHARDS,
         cap: float = MAX_PASSES) -> tuple[DataFrame, DataFrame]:
    """(documents with key, doc_id, size, source_no, source_size, target, begin, stop; drawn pieces)."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(*docs.columns).alias("h_row"))
    numbered = sized.withColumn("n_row", F.row_number().over(W.partitionBy("h_row").orderBy("doc_id")))
    sized = checkpointed(numbered.withColumn("key", F.struct("h_row", "n_row")).drop("h_row", "n_row"))
    sources = checkpointed(source_table(sized, weights, cap))
    by_source = sources.select(F.col("source").alias("s_"), "source_no", "source_size", "target")
    placed = placed_documents(sized).join(by_source, F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    placed = checkpointed(placed)
    return placed, drawn_pieces(placed, slots(sources, block, shards), block)


def taken_words(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken per row of ``docs``."""
    placed, pieces = plan(docs, weights, block)
    taken = pieces.groupBy("source_no", "begin").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    # an empty document shares its begin with the next one
    full, empty = placed.filter("size > 0"), placed.filter("size = 0")
    out = full.join(taken.hint("merge"), ["source_no", "begin"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    return out.select(*cols).union(empty.withColumn("taken", F.lit(0).cast("long")).select(*cols))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """The mix as documents: one row per document and pass, with the columns of ``docs``.

    A pass that takes all of a document's words keeps its text as it is; otherwise the text is the
    taken words, joined by one space. A document of which nothing is taken has no row.
    """
    placed, pieces = plan(docs, weights, block)
    parts = pieces.groupBy("source_no", "begin", "pass_").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("parts_"), F.sum(F.col("hi") - F.col("lo")).alias("got_"))
    chosen = placed.filter("size > 0").join(parts.hint("merge"), ["source_no", "begin"])
    chosen = chosen.select(F.col("key.h_row").alias("h_"), F.col("key.n_row").alias("n_"), F.col("size").alias("size_"), "parts_", "got_")
    keyed = docs.withColumn("h_", F.xxhash64(*docs.columns))
    keyed = keyed.withColumn("n_", F.row_number().over(W.partitionBy("h_").orderBy("doc_id")))
    words = F.filter(F.split("text", _GAPS), lambda w: w != "")
    cut = F.array_join(F.flatten(F.transform("parts_", lambda p: F.slice(F.col("words_"), p["lo"].cast("int") + 1, (p["hi"] - p["lo"]).cast("int")))), " ")
    rows = keyed.join(chosen.hint("merge"), ["h_", "n_"]).withColumn("words_", F.when(F.col("got_") < F.col("size_"), words))
    rows = rows.withColumn("text", F.when(F.col("got_") < F.col("size_"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns and dict(docs.dtypes)["n_chars"] in ("int", "bigint"):
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
