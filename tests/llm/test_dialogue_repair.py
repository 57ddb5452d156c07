"""Conversation repair against an exhaustive search that knows neither agenda nor chunks."""

import hashlib
import random
import re
import zlib

from regionloom.llm import dialogue_repair as dr

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        sp = lambda x: " " if x is None else x
        fate = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def fault_list(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        f = "b" if not re.search(r"[^\x20\x09-\x0D]", text) else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
        seen.add((role, text))
        out.append(f)
    return out


def search(rows, fault):
    """(cost, audit, lines) of the cheapest edit list, ties by the audit: all edits tried at every row, from the last row on.

    Up to three inserts stand before a row; more never pay off, since two of them leave the role as it was.
    """
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    after: dict = {}
    for i in range(len(rows), -1, -1):
        here: dict = {}
        for ins in (3, 2, 1, 0):
            for last in follow:
                options = []
                if i == len(rows) and last in ("", "a"):
                    options.append((0, "", ()))
                for r in "ua":
                    if ins < 3 and r in follow[last] and here.get((r, ins + 1)):
                        c = here[r, ins + 1]
                        options.append((c[0] + 3, "I" + c[1], (names[r] + ":", c[2])))
                if i < len(rows):
                    _, role, text = rows[i]
                    if after.get((last, 0)):
                        c = after[last, 0]
                        options.append((c[0] + 4, "D" + c[1], c[2]))
                    late = 3 if fault[i] == "t" else 0
                    for letter, name, cost in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)] if fault[i] not in "bd" else []:
                        if name and name[0] in follow[last] and after.get((name[0], 0)):
                            c = after[name[0], 0]
                            options.append((c[0] + cost + late, letter + c[1], (f"{name}:{text}", c[2])))
                if options:
                    here[last, ins] = min(options, key=lambda o: o[:2])
        after = here
    cost, audit, linked = after["", 0]
    lines = []
    while linked:
        line, linked = linked
        lines.append(line)
    return cost, audit, lines


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = damage([r for r in rows if r[0] == conv])
        fault = fault_list(mine)
        turns = {t for t, _, _ in mine if t is not None}
        cost, audit, lines = search(mine, fault)
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(fault.count(f) for f in "bdt"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def results(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def talk(r, conv, n):
    text = lambda: r.choice(["a.", "b!", "c", "Is it?  ", " \t", "", "d. e", "x y.", f"{r.random()}."])
    return [(conv, r.choice([None, *range(2 * n)]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), text()) for _ in range(n)]


def test_agenda_equals_trying_all_edits(spark):
    r = random.Random(11)
    rows = [x for conv in range(150) for x in talk(r, conv, r.choice([1, 2, 3, 5, 8, 13]))]
    assert results(dr.repair(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_chunks_equal_whole_conversations(spark):
    r = random.Random(12)
    rows = talk(r, 1, 700) + talk(r, 2, 40) + talk(r, 3, 9) + talk(r, None, 60)
    for size in (1, 7, 256):
        fan, dr.FAN = dr.FAN, 4
        try:
            assert results(dr.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), size)) == brute(rows), size
        finally:
            dr.FAN = fan


def test_defined_cases(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hello."), (1, None, "user", None), (2, 0, "", ""), (3, 0, "user", "A."), (3, 0, "user", "A."),
            (3, 1, "assistant", "B."), (4, 5, "system", "word " * 50_000 + "."), (4, 6, "user", "Üß 漢字!"), (4, 9, "assistant", "ok.\n")]
    rows += [(100 + i, 0, "user", "only row.") for i in range(30)]  # some of these lose it
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert any(v[5:7] == (0, "") for v in want.values())
    assert results(dr.repair(df)) == want
    clash = df.selectExpr("*", "1 AS conv", "2 AS part", "3 AS chunk", "4 AS code", "5 AS r", "6 AS fate", "7 AS copy")
    assert results(dr.repair(clash)) == want
    assert dr.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_registered_query(spark, sf):
    import pandas as pd

    rows = [tuple(x) for x in pd.read_parquet(f"{sf}/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    from regionloom.llm.queries import QUERIES

    assert results(QUERIES["op12_dialogue_repair"](spark, sf)) == brute(rows)
