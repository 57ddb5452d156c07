"""MinHash fingerprints of documents, their likeness, and near-duplicate classes from signature bands.

A document's set is its shingles of five words (fewer words: the whole sequence). ``PERMS``
functions of a universal family (multiply-shift) take the place of random permutations; the
signature is the lowest byte of the smallest value of each (b-bit MinHash), the fingerprint its
hexadecimal text. The likeness of two is the share of equal bytes, corrected for chance agreement.

*Edited texts.* A document's second half gives way to the beginning of the next document by
doc_id. Documents are dealt to ranges of doc_id of about ``RANGE_BYTES`` of text; the first document
of a range also goes to the range before it, the very first to the last. So the texts move once.

*Classes.* Signatures are cut into ``BANDS`` bands of ``ROWS`` bytes; documents that agree in a band meet
in a cell. First each document is linked with one likely document that comes first in one of its cells, so
large groups are joined at one row a document. In the cells that still hold several components the whole
signatures are compared, and the links of a maximum spanning forest are chosen. All links are verified by the
exact Jaccard index of the shingles and joined to components. A link that fails may have hidden others: its cells choose anew among the pairs that are neither joined nor checked, and after
``FORESTS`` rounds all that are left are checked. Equal signatures are one entry.

Defined cases: a null text is empty; texts without words have the same fingerprint, ff in all
bytes, which is alike to itself (1.0). Repeated doc_ids are ordered by their text; a null doc_id
comes last. A single document is its own next document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from regionloom.llm.components import star_components
from regionloom.llm.textkit import run_hashes, slices, text_buffer, with_columns, word_hashes
from regionloom.session import checkpointed

PERMS = 128
SHINGLE = 5
BANDS, ROWS = 20, 6
THRESHOLD = 0.8
RANGE_BYTES = 4 << 20
CELL = 512
#: A margin of three standard errors of the estimate: the exact index decides.
LIKELY = THRESHOLD - 0.11
#: Rounds that check one forest per cell; after them all pairs left are checked.
FORESTS = 3
MARKS = 1 << 26
ZIP_LEVEL = 6
#: Documents per block and links per shard of a check, and documents whose shingles are held at a time.
BLOCK, LINKS, HELD = 2000, 1000, 250
_RNG = np.random.default_rng(4)
_MUL = _RNG.integers(1, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_EMPTY = 255
_LAST = (1 << 63) - 1


def _shingles(texts: pa.Array):
    """Slices of rows with their shingle hashes and the first shingle of each row."""
    data, offsets = text_buffer(texts)
    for a, b in slices(offsets, 1 << 20):
        words, first = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        yield a, b, *run_hashes(words, first, SHINGLE)


def signatures(texts: pa.Array) -> np.ndarray:
    """One row of PERMS bytes per text: the lowest byte of each function's minimum."""
    out = np.full((len(texts), PERMS), _EMPTY, np.uint8)
    for a, b, hashes, first in _shingles(texts):
        full = np.flatnonzero(np.diff(first))
        if not len(full):
            continue
        starts = first[:-1][full]
        for p in range(PERMS):
            value = ((hashes * _MUL[p] + _ADD[p]) >> np.uint64(32)).astype(np.uint32)
            out[a + full, p] = (np.minimum.reduceat(value, starts) & np.uint32(255)).astype(np.uint8)
    return out


def fingerprint_strings(sig: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in sig]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard index of two arrays of signatures (the last axis holds the bytes)."""
    same = (a == b).mean(axis=-1)
    return np.clip((same - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def _ranges(docs: DataFrame) -> list[int]:
    """Doc_ids that begin the ranges; as many as the text needs, like the bounds of a range partitioning."""
    stats = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("low")).first()
    parts = max(1, -(-int(stats["bytes"] or 0) // RANGE_BYTES))
    if stats["low"] is None:
        return [_LAST]
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(parts)], 100 * parts).alias("c")).first()["c"]
    return sorted({int(stats["low"]), *map(int, cuts)})


def _packed(rows: pa.Table) -> bytes:
    """Rows as one compressed Arrow stream: the texts are most of what this operator moves."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZIP_LEVEL))) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _deal(bounds: list[int]):
    """Each document to its range; the first of a range also to the range before, as the next document there.

    Documents of one batch and range travel as one packed row.
    """
    edges = np.array(bounds, np.int64)

    def run(batches):
        for batch in batches:
            ids = batch["doc_id"].cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)
            part = np.maximum(np.searchsorted(edges, ids, "right") - 1, 0)
            opens = np.flatnonzero(ids == edges[part])
            parts = np.concatenate([part, (part[opens] - 1) % len(edges)])
            order = np.argsort(parts, kind="stable")
            rows = np.concatenate([np.arange(len(ids)), opens])[order]
            follows = (np.arange(len(parts)) >= len(ids))[order]
            parts = parts[order]
            cuts = np.flatnonzero(np.diff(parts)) + 1
            for at in np.split(np.arange(len(parts)), cuts) if len(parts) else []:
                take = pa.array(rows[at])
                table = pa.table({"doc_id": batch["doc_id"].cast(pa.int64()).take(take), "text": batch["text"].cast(pa.large_string()).take(take),
                                  "follows": pa.array(follows[at])})
                yield pa.RecordBatch.from_pydict({"part": pa.array(parts[at[:1]]), "rows": pa.array([_packed(table)], pa.binary())})
    return run


_COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
            "class_id long")


def _compare(rows: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
    """Fingerprints of a range's documents, their edited texts and their next documents."""
    if not len(rows):
        return pd.DataFrame(columns=[c.split()[0] for c in _COLUMNS.split(", ")])
    rows = pa.concat_tables([pa.ipc.open_stream(r).read_all() for r in rows["rows"]]).to_pandas()
    rows = rows.assign(key=rows["doc_id"].fillna(_LAST).astype("int64"), text=rows["text"].fillna(""))
    own = rows[~rows["follows"].astype(bool)].sort_values(["key", "text"], kind="stable")
    after = rows[rows["follows"].astype(bool)].sort_values(["key", "text"], kind="stable")
    if not len(own):
        return pd.DataFrame(columns=[c.split()[0] for c in _COLUMNS.split(", ")])
    texts = own["text"].tolist() + after["text"].tolist()[:1]
    n = len(own)
    following = [i + 1 if i + 1 < len(texts) else 0 for i in range(n)]
    edited = [texts[i][:len(texts[i]) - len(texts[i]) // 2] + texts[j][:len(texts[i]) // 2] for i, j in enumerate(following)]
    sig = signatures(pa.array(texts, pa.large_string()))
    new = signatures(pa.array(edited, pa.large_string()))
    named = dict(zip(classes["doc_id"], classes["class_id"]))
    ids = [None if pd.isna(d) else int(d) for d in own["doc_id"]]
    return pd.DataFrame({
        "doc_id": pd.array(ids, "Int64"), "n_chars": [len(t) for t in texts[:n]],
        "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
        "fingerprint": fingerprint_strings(sig[:n]), "edited_fingerprint": fingerprint_strings(new),
        "near_edited": likeness(sig[:n], new), "near_next": likeness(sig[:n], sig[following]),
        "class_id": pd.array([None if d is None else int(named.get(d, d)) for d in ids], "Int64")})


def _placed(bounds: list[int]):
    edges = np.array(bounds, np.int64)

    def run(batches):
        for batch in batches:
            part = np.maximum(np.searchsorted(edges, batch["doc_id"].to_numpy(), "right") - 1, 0)
            yield with_columns(batch, ["part"], [pa.array(part)])
    return run


def fingerprints(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id per row.

    ``classes`` (doc_id, class_id) names the classes; a document that it lacks is a class of its own.
    """
    docs = docs.select("doc_id", "text")
    if classes is None:
        classes = docs.sparkSession.createDataFrame([], "doc_id long, class_id long")
    bounds = _ranges(docs)
    dealt = docs.mapInArrow(_deal(bounds), "part long, rows binary")
    named = classes.mapInArrow(_placed(bounds), "doc_id long, class_id long, part long")
    return dealt.groupBy("part").cogroup(named.groupBy("part")).applyInPandas(_compare, _COLUMNS)


def _print_batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.int64()), "sig": pa.array([r.tobytes() for r in signatures(batch["text"])], pa.binary())})


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, sig) per row, without moving a text."""
    return docs.select("doc_id", "text").mapInArrow(_print_batches, "doc_id long, sig binary")


def _band_batches(batches):
    """The bands of each signature: number of the band and its bytes in one key."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint8).reshape(-1, PERMS)
        keys = np.zeros((len(sig), BANDS), np.int64)
        for b in range(BANDS):
            keys[:, b] = b
            for c in range(ROWS):
                keys[:, b] = keys[:, b] << 8 | sig[:, b * ROWS + c]
        yield pa.RecordBatch.from_pydict({"node": pa.array(np.repeat(batch["node"].to_numpy(), BANDS)), "key": pa.array(keys.ravel())})


def _forest(sig: np.ndarray, left: np.ndarray, right: np.ndarray, root: np.ndarray, bad: list) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over likely pairs, by Prim's algorithm; equal roots are joined at no cost."""
    n = len(sig)
    best, via, open_ = np.full(n, -1.0), np.full(n, -1), np.ones(n, bool)
    out = []
    for _ in range(n):
        at = int(np.where(open_, best, -2.0).argmax())
        if best[at] >= LIKELY and root[at] != root[via[at]]:
            out.append((int(via[at]), at))
        open_[at] = False
        near = np.where((left[at] & right) | (right[at] & left), likeness(sig, sig[at]), -1.0)
        near[bad[at]] = -1.0
        near[root == root[at]] = 2.0
        better = open_ & (near > best)
        best[better], via[better] = near[better], at
    return out


def _rest(sig: np.ndarray, left: np.ndarray, right: np.ndarray, root: np.ndarray, bad: list) -> list[tuple[int, int]]:
    """All likely pairs of different roots."""
    out = []
    for at in np.flatnonzero(left):
        likely = right & (likeness(sig, sig[at]) >= LIKELY) & (root != root[at])
        likely[bad[at]] = False
        out += [(int(at), int(j)) for j in np.flatnonzero(likely)]
    return out


def _cell_links(choose):
    """Pairs of a shard's cells that ``choose`` sends to the check."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: set[tuple[int, int]] = set()
        for (_, x, _), cell in rows.groupby(["key", "x", "y"], sort=False):
            node, block = cell["node"].to_numpy(), cell["block"].to_numpy()
            sig = np.frombuffer(b"".join(cell["sig"]), np.uint8).reshape(-1, PERMS)
            left, right = block == x, block != x
            right = right if right.any() else left
            bad = _failed_places(node, cell["failed"])
            for i, j in choose(sig, left, right, cell["root"].to_numpy(), bad):
                out.add((int(min(node[i], node[j])), int(max(node[i], node[j]))))
        return pd.DataFrame(sorted(out), columns=["u", "v"], dtype="int64")
    return run


def _failed_places(node: np.ndarray, failed) -> list[np.ndarray]:
    """For each row of a cell the rows that it failed with; one end of a failed pair names the other."""
    out: list[list[int]] = [[] for _ in node]
    for i, names in enumerate(failed):
        if names is not None and len(names):
            for j in np.flatnonzero(np.isin(node, names)).tolist():
                out[i].append(j)
                out[j].append(i)
    return [np.array(x, np.int64) for x in out]


def _marked(ids: DataFrame) -> np.ndarray:
    """A table of ``MARKS`` bits, set at the hashes of the ids: what a text must pass before it is moved."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    width = 4096
    table = np.zeros(MARKS // 8, np.uint8)
    for r in rows:
        table[(r["b"] - 1) * width:r["b"] * width] = np.frombuffer(r["bits"], np.uint8)
    return table


def _keep_marked(table: np.ndarray, zip_texts: bool = False):
    """The rows whose hash ``at`` is set in the table; with ``zip_texts`` doc_id and the compressed text of them."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=ZIP_LEVEL)
        for batch in batches:
            at = batch["at"].to_numpy()
            kept = batch.filter(pa.array((table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            if not zip_texts:
                yield kept.drop_columns(["at"])
                continue
            zipped = [pack.compress((t or "").encode()) for t in kept["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": kept["doc_id"], "zipped": pa.array(zipped, pa.binary())})
    return run


def _jaccard_shard(links: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    """Links of a shard with the result of their check, for a few documents' shingles at a time."""
    unpack = zstandard.ZstdDecompressor()
    zipped = dict(zip(texts["doc_id"], texts["zipped"]))
    held = [np.unique(links[c], return_inverse=True)[1] // HELD for c in ("u", "v")]
    out = [pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "good": pd.Series(dtype=bool)})]
    for _, some in links.groupby(held, sort=False):
        ids = np.union1d(some["u"], some["v"])
        sets: list[np.ndarray] = []
        for i, j, hashes, first in _shingles(pa.array([unpack.decompress(zipped[d]).decode() for d in ids], pa.large_string())):
            sets += [np.unique(hashes[first[r]:first[r + 1]]) for r in range(j - i)]
        good = []
        for i, j in zip(np.searchsorted(ids, some["u"]), np.searchsorted(ids, some["v"])):
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            good.append(common >= THRESHOLD * (len(sets[i]) + len(sets[j]) - common))
        out.append(pd.DataFrame({"u": some["u"].to_numpy(), "v": some["v"].to_numpy(), "good": np.array(good, bool)}))
    return pd.concat(out[1:] or out)


def _dealt_links(links: DataFrame, blocks: int, shards: int) -> DataFrame:
    """(u, v, shard): documents are dealt to blocks, links to cells of two blocks, cells to shards."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    return links.select("u", "v", F.pmod(F.xxhash64(block("u"), block("v")), F.lit(shards)).alias("shard"))


def _checked(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(u, v, good): whether the exact Jaccard index of the linked documents' shingles is high enough.

    Only texts of linked documents are moved (and the few whose mark another id has set): once to their
    shards' list, and once to each shard that has links of theirs, however many these are.
    """
    ends = lambda df, *more: df.select(F.col("u").alias("doc_id"), *more).union(df.select("v", *more))
    marks = _marked(ends(links))
    dealt = _dealt_links(links, -(-int(np.bitwise_count(marks).sum()) // BLOCK) or 1, -(-links.count() // LINKS) or 1)
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)))
    texts = rows.mapInArrow(_keep_marked(marks, zip_texts=True), "doc_id long, zipped binary").dropDuplicates(["doc_id"])
    wanted = ends(dealt, "shard").groupBy("doc_id").agg(F.collect_set("shard").alias("shards"))
    moved = texts.join(wanted.hint("merge"), "doc_id").select(F.explode("shards").alias("shard"), "doc_id", "zipped")
    return checkpointed(dealt.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(_jaccard_shard, "u long, v long, good boolean"))


def _likely_batches(batches):
    """Of pairs with both signatures those that are likely near duplicates."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, PERMS) for c in ("a", "b"))
        yield batch.filter(pa.array(likeness(one, two) >= LIKELY)).select(["u", "v"])


def _pivot_links(shared: DataFrame, per_sig: DataFrame) -> DataFrame:
    """(u, v): each node v with the smallest likely one among the first nodes of its cells."""
    pairs = shared.filter("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    full = pairs.join(per_sig.select(F.col("node").alias("v"), F.col("sig").alias("b")).hint("merge"), "v").join(
        per_sig.select(F.col("node").alias("u"), F.col("sig").alias("a")).hint("merge"), "u")
    return full.mapInArrow(_likely_batches, "u long, v long").groupBy("v").agg(F.min("u").alias("u")).select("u", "v")


def _mixed_cells(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, block, x, y): the rows of cells that hold several roots, once for each pair of blocks they are compared in.

    In a cell of more than ``CELL`` rows those of the most frequent root have blocks of their own; as they are
    joined already, these blocks meet the other rows' blocks only.
    """
    members = shared.select("key", "node").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("kinds")).filter("kinds > 1")
    wide = F.col("n") > CELL
    blocks_of = lambda n: F.ceil(n / F.lit(CELL)).cast("int")
    cells = (members.join(mixed.hint("merge"), "key").withColumn("top_", wide & (F.col("root") == F.col("top.root")))
             .withColumn("few", F.when(wide, blocks_of(F.col("n") - F.col("top.n"))).otherwise(1))
             .withColumn("many", F.when(wide, blocks_of(F.col("top.n"))).otherwise(0)))
    block = F.when(F.col("top_"), F.col("few") + F.pmod(F.xxhash64("node"), F.greatest("many", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("few")))
    meets = F.when(F.col("top_"), F.col("few")).otherwise(F.col("few") + F.col("many"))
    return cells.withColumn("block", block.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1))).select(
        "key", "node", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of the documents that have an equal or near duplicate with a smaller doc_id."""
    named = checkpointed(prints(docs).filter("doc_id is not null"))
    per_sig = checkpointed(named.groupBy("sig").agg(F.min("doc_id").alias("node")))
    bands = per_sig.select("node", "sig").mapInArrow(_band_batches, "node long, key long")
    firsts = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).filter("n > 1").select("key", "pivot")
    shared = checkpointed(bands.join(firsts.hint("merge"), "key"))
    # only signatures that meet another in a cell are compared
    marked = per_sig.select("node", "sig", F.pmod(F.xxhash64("node"), F.lit(MARKS)).alias("at"))
    meeting = checkpointed(marked.mapInArrow(_keep_marked(_marked(shared.select(F.col("node").alias("doc_id")))), "node long, sig binary"))
    # copies of one text meet in nearly all their cells: one link each joins most of them, at one row a document
    checked = _checked(docs, checkpointed(_pivot_links(shared, meeting)))
    good, failed = checked.filter("good").select("u", "v"), checked.filter("not good").select("u", "v")
    roots = star_components(good, "u", "v")
    cells = active = checkpointed(_mixed_cells(shared, roots))
    for turn in range(FORESTS + 1):
        over = failed.groupBy(F.col("v").alias("node")).agg(F.collect_list("u").alias("failed"))
        nodes = active.groupBy("node").agg(F.collect_list(F.struct("key", "block", "x", "y")).alias("cells"))
        full = nodes.join(meeting.hint("merge"), "node").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        full = full.join(over.hint("merge"), "node", "left").withColumn("cell", F.explode("cells")).select("node", "sig", "root", "failed", "cell.*")
        shards = max(1, -(-active.count() // 4000))
        full = full.withColumn("shard", F.pmod(F.xxhash64("key", "x", "y"), F.lit(shards)))
        choose = _forest if turn < FORESTS else _rest
        links = checkpointed(full.groupBy("shard").applyInPandas(_cell_links(choose), "u long, v long").distinct())
        if not links.limit(1).count():
            break
        checked = _checked(docs, links)
        bad = checked.filter("not good").select("u", "v")
        good, failed = good.union(checked.filter("good").select("u", "v")), failed.union(bad)
        roots = star_components(good, "u", "v")
        if turn == FORESTS or not bad.limit(1).count():
            break
        # a failed link may have hidden others, in the cells that hold both its ends
        ends = bad.select(F.col("u").alias("node"), F.struct("u", "v").alias("pair")).union(bad.select("v", F.struct("u", "v")))
        torn = cells.join(ends, "node").groupBy("key", "x", "y", "pair").agg(F.count("*").alias("n")).filter("n > 1")
        active = checkpointed(cells.join(torn.select("key", "x", "y").distinct(), ["key", "x", "y"], "left_semi"))
    key = [F.xxhash64("sig").alias("s1"), F.hash("sig").alias("s2")]
    names = per_sig.select("node", *key).join(roots, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("class_id"))
    return (named.select("doc_id", *key).join(names.hint("merge"), ["s1", "s2"])
            .filter("class_id <> doc_id").select("doc_id", "class_id"))
