"""Conversation repair by lightest derivations (Knuth's generalisation of Dijkstra's search).

The rows of a conversation, in the order of their turns, are to become ``(s?(ua)+)?`` by role
initials at the lowest cost. An item (rows used, state) says: the last rows, from this state on, can be
completed. Its weight is (cost, audit), the audit being the edits' initials. Every edit is a deduction
that puts its letter before the audit of an item already derived. An agenda pops the lightest item
first; its key is (cost, rows used, audit). All deductions are superior and monotone in that key: an
edit costs something or uses up a row, and a letter put before two audits keeps their order. (The
order of audits alone would not do, since ``K`` before an audit costs nothing and can come lower.) So
the first derivation that is popped is final, and the search ends with the goal item.

Conversations of any length: rows are range-partitioned by conversation and turn and stream through
the tasks in that order. A conversation that lies within a partition and has at most ``CHUNK`` rows
is done there. Others leave chunks of at most ``CHUNK`` rows, whose weights from each state to each
state are derived the same way; a deduction over chunks takes a chunk's weight for a letter. They are
combined ``FAN`` at a time, level by level. Only the digest of a repaired text reads one
conversation in one task, as a stream, since SHA-256 has to.

Defined cases: a null role or text is one space, and so is a null conv_id or turn in the hashed key;
null turns come first and do not count for gaps. Rows of one turn are ordered by role and text. Null
conv_ids are one conversation. Repeated rows are duplicates. A conversation without rows after damage has
zeros, an empty audit and the empty text's digest. Columns beyond conv_id, turn, role and text are left out.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from regionloom.session import shared_path

CHUNK = 256
FAN = 64
SPACE = r"\x20\x09-\x0D"

#: What may follow: after nothing, a system row, a user row, an assistant row.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
ACCEPTED = (0, 3)
RIGHT_PAIRS = {"su", "ua", "au"}

# ---------------------------------------------------------------- derivations

#: (from state, to state, cost, letter)
INSERTS = [(s, NEXT[s, WANTED[s]], 3, "I") for s in range(4)]


@lru_cache(maxsize=64)
def row_edits(role: str, fault: str) -> tuple[tuple[int, int, int, str], ...]:
    """The edits of one row: role initial (x: another), fault (b blank, d duplicate, t truncated, - none)."""
    out = []
    for s in range(4):
        out.append((s, s, 4, "D"))
        if fault not in "bd":
            left = 3 if fault == "t" else 0
            if (s, role) in NEXT:
                out.append((s, NEXT[s, role], left, "K"))
            out.append((s, NEXT[s, WANTED[s]], 3 + left, "R"))
    return tuple(out)


def lightest(steps: list, ends: tuple[int, ...], goals: tuple[int, ...], inserts: list = INSERTS) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the lightest derivation over all steps from each goal state to one of ``ends``."""
    agenda = [(0, 0, "", s) for s in ends]
    final: dict[tuple[int, int], tuple[int, str]] = {}
    open_goals = {(len(steps), s) for s in goals}
    while agenda and open_goals:
        cost, used, audit, state = heapq.heappop(agenda)
        if (used, state) in final:
            continue
        final[used, state] = (cost, audit)
        open_goals.discard((used, state))
        for s, to, weight, letter in inserts:
            if to == state and (used, s) not in final:
                heapq.heappush(agenda, (cost + weight, used, letter + audit, s))
        if used < len(steps):
            for s, to, weight, letters in steps[len(steps) - 1 - used]:
                if to == state and (used + 1, s) not in final:
                    heapq.heappush(agenda, (cost + weight, used + 1, letters + audit, s))
    return {s: final[len(steps), s] for s in goals if (len(steps), s) in final}


def _steps(code: str) -> list:
    return [row_edits(code[i], code[i + 1]) for i in range(0, len(code), 2)]


@lru_cache(maxsize=1 << 14)
def best_audit(code: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation; ``code`` has two letters a row (role, fault)."""
    return lightest(_steps(code), ACCEPTED, (0,))[0]


@lru_cache(maxsize=1 << 10)
def chunk_weights(code: str) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, audit) of a stretch of rows for every pair of states that it can connect."""
    steps = _steps(code)
    return tuple((s, t, *w) for t in range(4) for s, w in lightest(steps, (t,), (0, 1, 2, 3)).items())


def joined_weights(parts: list) -> list:
    """The weights of consecutive stretches, each given as by ``chunk_weights``; inserts are in them already."""
    return [(s, t, *w) for t in range(4) for s, w in lightest(parts, (t,), (0, 1, 2, 3), []).items()]


def repaired_lines(audit: str, roles: list[str], texts: list[str], state: int) -> tuple[list[str], int]:
    """The ``role:text`` lines of a stretch, and the state behind it."""
    lines, at = [], 0
    for letter in audit:
        if letter == "K":
            lines.append(f"{roles[at]}:{texts[at]}")
            state = NEXT[state, roles[at][0]]
        elif letter != "D":
            lines.append(f"{ROLES[WANTED[state]]}:{texts[at] if letter == 'R' else ''}")
            state = NEXT[state, WANTED[state]]
        at += letter != "I"
    return lines, state


def faults(code: str) -> list[int]:
    """Numbers of blank, duplicate, truncated rows and of adjacent roles that may not follow each other."""
    roles = code[::2]
    return [*(code[1::2].count(f) for f in "bdt"), sum(roles[i:i + 2] not in RIGHT_PAIRS for i in range(len(roles) - 1))]


def digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def gap_count(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


# ---------------------------------------------------------------- rows

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, r): the rows after damage by the hash of ``conv_id:turn``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text_of("role").alias("role"), text_of("text").alias("text"), F.monotonically_increasing_id().alias("r"),
        (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20).alias("fate"))
    rows = rows.filter("fate <> 0").withColumns({
        "role": F.when(F.col("fate") == 4, "user").otherwise(F.col("role")),
        "text": F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate", "copy")


def row_code() -> Column:
    """Two letters a row: the role's initial (x: neither s, u nor a) and its fault without regard to other rows."""
    initial = F.substring("role", 1, 1)
    blank, ended = ~F.col("text").rlike(f"[^{SPACE}]"), F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    return F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), F.when(blank, "b").when(~ended, "t").otherwise("-"))


_RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
           ("audit", pa.string()), ("repaired_sha256", pa.string())]
_PIECE = pa.schema([("conv", pa.string()), ("conv_id", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), *_RESULT,
                    ("turns", pa.list_(pa.int64())), ("codes", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_PIECE_DDL = ("conv string, conv_id long, part long, chunk long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string, turns array<long>, codes array<string>, roles array<string>, texts array<string>")


def _with_duplicates(codes: list[str], roles: list[str], texts: list[str]) -> str:
    seen, out = set(), []
    for code, pair in zip(codes, zip(roles, texts)):
        out.append(code[0] + "d" if pair in seen and code[1] != "b" else code)
        seen.add(pair)
    return "".join(out)


def _finished(turns: list, codes: list[str], roles: list[str], texts: list[str]) -> tuple:
    code = _with_duplicates(codes, roles, texts)
    cost, audit = best_audit(code)
    return (gap_count(turns), *faults(code), cost, audit, digest(repaired_lines(audit, roles, texts, 0)[0]))


def _pieces(size: int):
    """Sorted rows to finished conversations and, where one may go on in another partition, chunks of ``size`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        conv, rows, chunk, edge = None, [], 0, True  # edge: the partition's first conversation may have begun before

        def flush(ended: bool) -> None:
            turns, codes, roles, texts = (list(c) for c in zip(*(r[2:] for r in rows)))
            if ended and not edge and not chunk:
                out.append((*rows[0][:2], part, 0, *_finished(turns, codes, roles, texts), None, None, None, None))
            else:
                out.append((*rows[0][:2], part, chunk, *[None] * len(_RESULT), turns, codes, roles, texts))

        def emitted() -> pa.RecordBatch:
            columns = zip(*out) if out else [[] for _ in _PIECE]
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "conv_id", "turn", "code", "role", "text"))):
                if rows and row[0] != conv:
                    flush(True)
                    rows, chunk, edge = [], 0, False
                elif len(rows) == size:
                    flush(False)
                    rows, chunk = [], chunk + 1
                conv = row[0]
                rows.append(row)
            yield emitted()
        if rows:
            flush(False)
            yield emitted()
    return run


# ---------------------------------------------------------------- conversations over several chunks

PLACE = ["conv", "part", "chunk"]


def _duplicate_places(chunks: DataFrame) -> DataFrame:
    """(conv, part, chunk, again): the rows of a chunk whose role and text an earlier row of the conversation has."""
    rows = chunks.select(*PLACE, F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "z"))
    rows = rows.select("conv", F.struct("part", "chunk", "i").alias("place"), F.col("z.roles").alias("role"), F.md5("z.texts").alias("text_"))
    key = ["conv", "role", "text_"]
    first = rows.groupBy(*key).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = rows.join(first, key).filter("place > first")
    return again.groupBy("conv", F.col("place.part").alias("part"), F.col("place.chunk").alias("chunk")).agg(F.collect_list("place.i").alias("again"))


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        out = []
        for codes, again in zip(df["codes"], df["again"]):
            late = set() if again is None else set(again)
            code = "".join(c[0] + "d" if i in late and c[1] != "b" else c for i, c in enumerate(codes))
            out.append(json.dumps({"n": len(codes), "faults": faults(code), "ends": code[0] + code[-2], "weights": chunk_weights(code)}))
        yield df[[*PLACE]].assign(summary=out)


def _combine(parts: list[dict]) -> dict:
    total = [sum(x) for x in zip(*(p["faults"] for p in parts))]
    total[3] += sum(a["ends"][1] + b["ends"][0] not in RIGHT_PAIRS for a, b in zip(parts, parts[1:]))
    return {"n": sum(p["n"] for p in parts), "faults": total, "ends": parts[0]["ends"][0] + parts[-1]["ends"][1],
            "weights": joined_weights([p["weights"] for p in parts]) if len(parts) > 1 else parts[0]["weights"]}


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield df[[*PLACE]].assign(summary=[json.dumps(_combine([json.loads(x["summary"]) for x in xs])) for xs in df["xs"]])


def _rounds(top: int) -> int:
    n = 0
    while top > 0:
        n, top = n + 1, top // FAN
    return n


def _audits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lightest audit of each conversation, and which of it belongs to which chunk."""
    for df in batches:
        for conv, xs, summary in zip(df["conv"], df["sizes"], df["summary"]):
            s = json.loads(summary)
            cost, audit = min((c, a) for f, t, c, a in s["weights"] if f == 0 and t in ACCEPTED)
            sizes, at, rows = list(xs), 0, []
            for x in sizes:
                start, used = at, 0
                while used < x["n"] or (x is sizes[-1] and at < len(audit)):
                    used += audit[at] != "I"
                    at += 1
                rows.append((conv, x["part"], x["chunk"], audit[start:at]))
            out = pd.DataFrame(rows, columns=[*PLACE, "piece"])
            out["state"] = _states(out["piece"], s["ends"][0], xs)
            head = dict(zip(("blank", "duplicate", "truncated", "illegal"), s["faults"])) | {"cost": cost, "audit": audit}
            for name, value in head.items():
                out[name] = [value, *[None] * (len(out) - 1)]  # once per conversation
            yield out.astype({c: "Int64" for c in ("blank", "duplicate", "truncated", "illegal", "cost")})


def _states(pieces: pd.Series, first: str, xs) -> list[int]:
    """The state before each piece; after the first line that is written, roles alternate."""
    states, state = [], 0
    for piece, x in zip(pieces, xs):
        states.append(state)
        at = 0
        for letter in piece:
            if letter == "K":
                state = NEXT[state, x["initials"][at]]
            elif letter != "D":
                state = NEXT[state, WANTED[state]]
            at += letter != "I"
    return states


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        lines = [repaired_lines(p, list(r), list(t), s)[0] for p, r, t, s in zip(df["piece"], df["roles"], df["texts"], df["state"])]
        yield df[[*PLACE]].assign(body=["\n".join(x) for x in lines], some=[bool(x) for x in lines])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per conversation from its chunks in order; a chunk at a time is in memory."""
    conv, running, begun = None, None, False
    done: list[tuple[str, str]] = []

    def emitted() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["conv", "repaired_sha256"])
        done.clear()
        return batch

    for batch in batches:
        for c, body, some in zip(*(batch.column(n).to_pylist() for n in ("conv", "body", "some"))):
            if c != conv or running is None:
                if running is not None:
                    done.append((conv, running.hexdigest()))
                conv, running, begun = c, hashlib.sha256(), False
            if some:
                running.update((b"\n" if begun else b"") + body.encode())
                begun = True
        yield emitted()
    if running is not None:
        done.append((conv, running.hexdigest()))
        yield emitted()


def long_conversations(chunks: DataFrame) -> DataFrame:
    """Results of conversations given as chunks (conv, conv_id, part, chunk, turns, codes, roles, texts)."""
    again = chunks.join(_duplicate_places(chunks), PLACE, "left").select(*PLACE, "codes", "again")
    summary = again.mapInPandas(_summaries, "conv string, part long, chunk long, summary string")
    top = chunks.agg(F.max("chunk"), F.max("part")).first()
    for name, rounds in (("chunk", _rounds(top[0] or 0)), ("part", _rounds(top[1] or 0))):
        for _ in range(rounds):
            up = [F.floor(F.col(c) / FAN).cast("long").alias(c) if c == name else F.col(c) for c in PLACE]
            xs = F.sort_array(F.collect_list(F.struct("part", "chunk", "summary"))).alias("xs")  # at most FAN
            summary = summary.groupBy(*up).agg(xs).mapInPandas(_combined, "conv string, part long, chunk long, summary string")
    initials = F.concat_ws("", F.transform("codes", lambda c: F.substring(c, 1, 1)))
    sizes = chunks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "chunk", F.size("codes").alias("n"), initials.alias("initials")))).alias("sizes"))
    spec = "conv string, part long, chunk long, piece string, state int, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    path = shared_path(chunks.sparkSession, "dialogue-audits")
    summary.select("conv", "summary").join(sizes, "conv").mapInPandas(_audits, spec).write.parquet(path)
    pieces = chunks.sparkSession.read.parquet(path)
    texts = chunks.select(*PLACE, "roles", "texts").join(pieces.select(*PLACE, "piece", "state"), PLACE)
    texts = texts.mapInPandas(_texts, "conv string, part long, chunk long, body string, some boolean")
    hashes = texts.repartition("conv").sortWithinPartitions(*PLACE).mapInArrow(_digests, "conv string, repaired_sha256 string")
    turns = chunks.select("conv", "conv_id", F.explode("turns").alias("turn")).groupBy("conv", "conv_id", "turn").count()
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    gaps = turns.groupBy("conv", "conv_id").agg(F.coalesce(span, F.lit(0).cast("long")).alias("gaps"))
    return pieces.filter("audit is not null").drop("part", "chunk", "piece", "state").join(gaps, "conv").join(hashes, "conv")


def repair(conversations: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = conversations.sparkSession
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("r").asc()]
    rows = damaged(conversations).withColumn("code", row_code())
    pieces = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("r").mapInArrow(_pieces(chunk_rows), _PIECE_DDL)
    path = shared_path(spark, "dialogue-pieces")
    pieces.write.parquet(path)
    stored = spark.read.parquet(path)
    names = [n for n, _ in _RESULT]
    done = stored.filter("audit is not null").select("conv_id", *names)
    chunks = stored.filter("audit is null").select(*PLACE, "conv_id", "turns", "codes", "roles", "texts")
    done = done.unionByName(long_conversations(chunks).select("conv_id", *names))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), *[F.lit(None).cast("long" if t == pa.int64() else "string").alias(n) for n, t in _RESULT])
    fill = {n: F.lit(0).cast("long") if t == pa.int64() else F.lit(digest([]) if n == "repaired_sha256" else "") for n, t in _RESULT}
    return done.unionByName(every).groupBy("conv_id").agg(*[F.coalesce(F.max(n), fill[n]).alias(n) for n in names])
