"""Decontamination, surrogates, mixing, sharding and the pipeline."""

import collections
import os
import re
import sys
import zlib

import numpy as np
import pandas as pd
import pytest

from regionloom.llm import decontamination, mixing, pii, sharding
from tests.llm.conftest import SCHEMA, frame

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

ITEM = "John has 5 apples and gives 3 apples to Mary who had 12 km to walk"
BENCH = "item_id long, text string"


def test_leaks_equal_brute_force(spark, documents, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {r["doc_id"] for r in decontamination.contamination(docs, bench).filter("contaminated").collect()}

    def windows(text):
        w = re.findall(r"\w+", text.lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    items = [windows(t) for t in pd.read_parquet(f"{sf}/benchmark.parquet")["text"]]
    want = {d for d, t in zip(documents["doc_id"], documents["text"]) if any(i and len(i & windows(t)) >= 0.8 * len(i) for i in items)}
    assert got == want and got
    clean = decontamination.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(documents) - len(want)


def test_templates_and_slots(spark, odd_rows, empty):
    bench = spark.createDataFrame([(0, ITEM), (1, None), (2, ""), (3, "one two three")], BENCH)
    rows = [(11, "so Peter has 7 apples and gives 4 apples to Anna who had 31 km to walk today"),
            (12, "so Peter has 7 apples and gives 7 apples to Anna who had 31 km"),  # 5 and 3 both become 7
            (13, "John has five apples"), (14, "zero one two three four"), (15, "one two three")]
    docs = frame(spark, odd_rows + rows)
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, bench).collect()}
    assert got[11]["item_id"] == 0 and got[11]["share"] == 1.0 and got[15]["item_id"] == 3
    assert not any(got[d]["contaminated"] for d in (1, 2, 3, 4, 5, 6, 7, 12, 13, 14, None))
    assert decontamination.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.clean_documents(docs.withColumnRenamed("lang", "hash"), bench).count() == len(odd_rows) + 3


def test_names_that_begin_sentences(spark):
    item = "Anna has 12 apples. Anna gives 5 apples to Ben. How many apples does Anna have left?"
    other = "Carl has 9 apples. Carl gives 4 apples to Dan. How many apples does Carl have left?"
    docs = frame(spark, [(1, f"Read this first. {other} Good luck."), (2, other.replace("Carl gives 4", "Eve gives 9")),
                         (3, f"so we say that {item[0].lower() + item[1:]}"), (4, "Carl has 9 apples. Nobody asks. How many pears are left?")])
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, spark.createDataFrame([(0, item)], BENCH)).collect()}
    assert got[1]["share"] == 1.0 and got[1]["contaminated"]
    assert not got[2]["contaminated"] and not got[4]["contaminated"] and got[3]["contaminated"]


def test_windows_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 1)
    docs = frame(spark, [(1, f"well {ITEM} yes"), (2, "something else entirely and quite long too")])
    got = decontamination.contamination(docs, spark.createDataFrame([(0, ITEM)], BENCH)).collect()
    assert {r["doc_id"]: r["contaminated"] for r in got} == {1: True, 2: False}


def test_surrogates_are_consistent_and_of_the_same_form(spark, odd_rows, empty):
    text = ("Call John Smith at +1 (017) 555-7713 or 017-555-7713; Mr. Smith, mail a.b@Mail7.example.com. Card 4111 1111 1111 1111 "
            "or 4111111111111111, ip 10.0.0.1, Иван Петров, SSN 123-45-6789, key 04dbebab91ab85687d33eeaaf9ac699e1188f962")
    rows = odd_rows + [(30, text), (31, "Anna wrote to a.b@mail7.example.com from 10.0.0.1")]
    got = {r["doc_id"]: r for r in pii.pseudonymised(frame(spark, rows)).collect()}
    out = got[30]["text"]
    pattern = (r"Call (\w+) (\w+) at \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}); Mr\. (\w+), mail (\S+@\S+)\. Card (\d{4}) (\d{4}) (\d{4}) (\d{4}) "
               r"or (\d{16}), ip (\S+), ([А-Я][а-я]+) ([А-Я][а-я]+), SSN (\d{3}-\d\d-\d{4}), key ([0-9a-f]{40})")
    g = re.fullmatch(pattern, out).groups()
    assert g[1] == g[8] and g[2:5] == g[5:8] and "".join(g[10:14]) == g[14]
    assert g[0].endswith("n") and got[31]["text"].split()[0].endswith("a")
    digits = [int(c) for c in g[14]][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert g[9] in got[31]["text"] and g[15] in got[31]["text"]
    assert not any(p in out for p in ("Smith", "555-7713", "4111", "10.0.0.1", "Петров", "123-45", "04dbeb"))
    assert [got[d]["text"] for d in (1, 2, 3, 4)] == [dict(rows[:5])[d] for d in (1, 2, 3, 4)]
    assert pii.pseudonymised(empty).count() == 0 and len(pii.pseudonymised(frame(spark, rows)).collect()) == len(rows)


def test_colliding_surrogates_are_drawn_again(spark):
    """Sixteen given names of two syllables each collide often among thousands of values."""
    values = spark.range(3000).selectExpr("'surname_lat' AS kind", "concat('Name', id) AS canon")
    got = pii.surrogates(values).toPandas()
    assert len(got) == 3000 and got["new"].nunique() == 3000 and not set(got["new"]) & set(got["canon"])


def test_surrogates_on_the_table(spark, documents, sf):
    got = pii.pseudonymised(spark.read.parquet(f"{sf}/documents.parquet")).toPandas().set_index("doc_id")
    find = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+|\b\d{16}\b|\+1 \(\d+\) \d+-\d+|\b\d+\.\d+\.\d+\.\d+\b|\b[0-9a-f]{40}\b")
    for d, text in zip(documents["doc_id"], documents["text"]):
        new = got["text"][d]
        assert not any(m in new for m in find.findall(text))
        assert find.split(text) == find.split(new) or got["n_entities"][d] > len(find.findall(text))


def test_permutations():
    for n in (1, 2, 3, 7, 100, 4096, 4097):
        there = mixing.permute(np.arange(n), n, 5)
        assert sorted(there) == list(range(n))
        assert (mixing.permute(there, n, 5, back=True) == np.arange(n)).all()


def shares(sizes, weights, cap=3.0):
    out, free = {}, {s for s in sizes if sizes[s]}
    rest = float(sum(sizes.values()))
    while True:
        mass = sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / mass > cap * sizes[s]}
        if not over:
            return {**{s: 0.0 for s in sizes}, **out, **{s: rest * weights[s] / mass for s in free}}
        out |= {s: cap * sizes[s] for s in over}
        rest -= sum(cap * sizes[s] for s in over)
        free -= over


def test_mixing_reaches_its_targets(spark, documents, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.taken_words(docs).toPandas().set_index("doc_id")
    again = mixing.taken_words(docs.repartition(7)).toPandas().set_index("doc_id")
    assert got.sort_index().equals(again.sort_index())
    size = documents["text"].map(lambda t: len(t.encode().split()))
    assert (got["size"].reindex(documents["doc_id"]).to_numpy() == size.to_numpy()).all() and (got["taken"] <= 3 * got["size"]).all()
    per = size.groupby(documents["source"]).sum().to_dict()
    want = shares(per, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(per))})
    source = documents.set_index("doc_id")["source"]
    for s, words in got["taken"].groupby(source).sum().items():
        assert abs(words - want[s]) < 1
        assert got["target"][source == s].iloc[0] == pytest.approx(want[s])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.toPandas().assign(n=lambda m: m["text"].map(lambda t: len(t.encode().split()))).groupby("doc_id")["n"].sum()
    assert (words.reindex(got.index).fillna(0) == got["taken"]).all()


def test_mixing_odd_rows(spark, odd_rows, empty):
    rows = [(d, t, "en", s, 0) for (d, t), s in zip(odd_rows, ["b", None, "a", "a", "b", None, "c", "c", "c", "c", "a"])]
    got = mixing.taken_words(frame(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    assert got["target"][got["source_size"] == 0].eq(0).all()
    # a's texts are all empty; c and the null source are small, so they stop at three times their size
    by_size = got[got["size"] > 0].groupby("source_size")["target"].first()
    assert by_size[6] == 18 and by_size.iloc[-1] == pytest.approx(got["size"].sum() - by_size.iloc[:-1].sum())
    docs = frame(spark, rows).withColumnRenamed("lang", "key").withColumnRenamed("n_chars", "size")
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.taken_words(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_shards_are_even_and_keep_groups(spark, documents, sf):
    got = sharding.assign(spark.read.parquet(f"{sf}/documents.parquet")).toPandas().set_index("doc_id").reindex(documents["doc_id"])
    assert (got["text_crc32"].to_numpy() == documents["text"].map(lambda t: zlib.crc32(t.encode())).to_numpy()).all()
    assert (got["size"].to_numpy() == documents["text"].map(lambda t: len(t.encode()) + 8).to_numpy()).all()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 24 and load.max() < 1.03 * load.mean() and load.min() > 0.97 * load.mean()
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    groups = got.groupby(documents["text"].to_numpy())["shard"].agg(["size", "nunique"])
    groups = groups[groups["size"] > 1]
    assert (groups["nunique"] == 1).mean() > 0.9


def test_a_group_larger_than_shards_fills_them(spark):
    rows = [(i, "copy of one text") for i in range(1000)] + [(1000 + i, f"text {i} " + "x" * (i % 40)) for i in range(2000)]
    got = sharding.assign(frame(spark, rows)).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert load.max() < 1.05 * load.mean() and load.min() > 0.95 * load.mean()
    copies = got[got["doc_id"] < 1000]
    assert copies["shard"].nunique() <= 11  # nine hold them all, if full


def test_a_full_shard_cuts_at_most_one_small_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 64)
    rows = [(3 * g + i, f"text {g} " + "x" * (g % 40)) for g in range(3000) for i in range(3)]
    got = sharding.assign(frame(spark, rows), 2).toPandas()
    assert (got.groupby(got["doc_id"] // 3)["shard"].nunique() > 1).sum() <= 3


def test_every_group_votes(spark):
    # many small groups and one of a third of all rows, on the shards of all
    rows = [(20 * g + i, f"text {g} " + "x" * (g % 40)) for g in range(500) for i in range(20)]
    rows += [(20000 + i, "a hot text of many copies") for i in range(5000)]
    got = sharding.assign(frame(spark, rows)).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and load.max() - load.min() < 200
    small = got[got["doc_id"] < 20000]
    assert (small.groupby(small["doc_id"] // 20)["shard"].nunique() > 1).sum() <= 46  # an edge of a shard in each of two layouts
    assert got[got["doc_id"] >= 20000]["shard"].nunique() <= 16


def test_exchanges_and_room():
    # 0 and 1 exchange what both ask for; the rest of what 0 asks for fits into the room of 1
    assert sharding._flows({(0, 1): 100, (1, 0): 60}, [0.0, 20.0]) == [0.0, 80.0, 60.0, 0.0]
    assert sharding._flows({(0, 1): 100}, [5.0, -3.0]) == [0.0, 0.0, 0.0, 0.0]


def test_shards_of_odd_rows(spark, odd_rows, empty):
    docs = frame(spark, odd_rows).withColumnRenamed("lang", "shard").withColumnRenamed("source", "g1")
    got = sharding.shard_documents(docs).toPandas()
    assert len(got) == len(odd_rows) and set(got["size"]) >= {8}
    assert sorted(got.groupby("shard")["slot"].max() + 1) == sorted(got.groupby("shard").size())
    assert sharding.assign(empty).count() == 0 and sharding.shard_documents(empty).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
        if name != "sharding":
            assert docs.columns == columns
    assert kept[0] >= kept[1] >= kept[2] > 0 and kept[3] == kept[4]
    assert set(columns) <= set(docs.columns) and {"shard", "slot"} <= set(docs.columns)
    got = collections.Counter(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "shard", "text").collect()))
    assert got == collections.Counter(map(tuple, docs.select("doc_id", "shard", "text").collect()))


def test_pipeline_on_odd_rows(spark, odd_rows, tmp_path):
    import corpus_pipeline

    path = str(tmp_path)
    for rows in (odd_rows, []):
        docs = spark.createDataFrame([], SCHEMA) if not rows else frame(spark, rows)
        docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
        spark.createDataFrame([(0, ITEM)], BENCH).write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        assert bool(out) == bool(rows)


def test_copies_in_another_case_and_short_items(spark):
    long = "How many apples does Anna have left over?"
    bench = spark.createDataFrame([(0, ITEM), (1, long), (2, "What is 17 + 25?")], BENCH)
    rows = [(1, f"well, {ITEM.lower()} he said"), (2, f"NOTE {ITEM.upper()} END"), (3, long.lower()), (4, long.upper() + " Well."), (5, long.replace("Anna", "Bob")),
            (6, "First this. What is 17 + 25? Then that."), (7, "What is 17 + 26?"), (8, "Tell me what is 17 + 25 now"), (9, "a list\nwhat is 17+25\nof lines"),
            (None, f"hidden {ITEM}"), (None, "clean"), (10, "how few apples does it have left for us today")]
    got = decontamination.contamination(frame(spark, rows), bench).collect()
    assert sorted((r["doc_id"], r["contaminated"]) for r in got if r["doc_id"]) == [(i, i not in (8, 10)) for i in range(1, 11)]
    assert sorted(r["contaminated"] for r in got if r["doc_id"] is None) == [False, True]
    assert decontamination.clean_documents(frame(spark, rows), bench).count() == 3


def test_templates_equal_brute_force(spark):
    """Re-parameterised items inside other words, and the same with one slot used for two values."""
    import random

    r = random.Random(21)
    names, units = ["Anna", "Carl", "Priya", "Zoë", "Mei", "Omar"], ["km", "kg", "miles", "hours"]
    shapes = ["{0} drives {3} {5} to meet {1} and then walks {4} {5} back home with {2} before dinner is served",
              "Yesterday {0} bought {3} pens while {1} sold {4} pens, so how many pens did {0} need to give {2} today"]
    fill = lambda s, who, x, y, u: s.format(*who, x, y, u)
    items = [fill(s, r.sample(names, 3), 12, 345, "km") for s in shapes]
    rows, want = [], set()
    for i in range(120):
        s, who = r.choice(shapes), r.sample(names, 3)
        x, y = r.sample(range(1, 999), 2)
        text = fill(s, who, x, y, r.choice(units) if s is shapes[0] else "")
        if i % 3 == 1:
            text = r.choice([str.lower, str.upper])(text)
        if i % 3 == 2:  # every second word is another: no window is left
            text = " ".join(w if k % 2 else f"other{k}" for k, w in enumerate(text.split()))
        else:
            want.add(i)
        rows.append((i, " ".join(r.choices(["some", "plain", "words", "7", "home"], k=r.randrange(9))) + " " + text + " and so on"))
    bench = spark.createDataFrame(list(enumerate(items)), BENCH)
    got = {x["doc_id"] for x in decontamination.contamination(frame(spark, rows), bench).filter("contaminated").collect()}
    assert got == want
