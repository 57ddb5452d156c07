"""License scan: an exact set-similarity join of text blocks with license templates, in Spark functions only.

Words are ``[0-9a-z]`` and characters beyond ASCII, A-Z lower-cased. A text is covered by blocks of
2 x ``stride`` words that start every ``stride`` words, ``stride`` being the longest template's number
of words, so every stretch as long as a template lies whole in a block. A template is found in a
block that holds at least its ``threshold`` of the template's distinct words (containment).

1. One pass over the documents stores, per block, which template words stand where. The global
   frequency of each template word over all documents orders the words, rarest first.
2. A template of n words that needs o of them is indexed by its n - o + 1 rarest words (prefix). A
   block probes the index with its own rare words by a hash join; a pair goes on only if the block
   has o words (length filter) and if o more can still be shared behind the place of the common
   word in both orders (positional filter). A pair is made once, at its rarest common word.
3. What is left is counted exactly. A phrase (``exact``) needs all its words, and its words must
   stand consecutively; each place counts in the block where it starts.

Template words are a few hundred at most, whatever the corpus; only they are counted, ordered and
sent to the tasks. Nothing is gathered per document but the blocks of its own row.

Defined cases: a null or empty text has no words and no finds (score 0, null places, empty labels). A
null doc_id and repeated rows are rows like any other: one result each. Long texts are blocks like
any other. Ties of equal frequency go by the word. An empty table gives an empty result. Columns of
``docs`` other than doc_id and text are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from regionloom.session import shared_path

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    """A license text: its label, its words, the share of its distinct words that a block must hold.

    ``exact`` asks for the words one after the other, and counts the places.
    """

    label: str
    text: str
    threshold: float = THRESHOLD
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def needed(self) -> int:
        """The least number of distinct words to be shared."""
        n = len(set(self.words))
        return next(o for o in range(1, n + 1) if o / n >= self.threshold)


#: Phrases that name a license.
PHRASES = [
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
]

#: The operative sentences of common public licenses. Texts of one family differ in
#: single words, so those are asked for in full.
TEXTS = [
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", 1.0),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", 1.0),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]

TEMPLATES = [*PHRASES, *TEXTS]


def words_of(text: Column) -> Column:
    """The words of a text. The Kelvin sign is the one other character whose lower case is in a-z."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")))
    return F.array_remove(F.split(plain, SEPARATORS), "")


def block_hits(docs: DataFrame, vocabulary: list[str], stride: int) -> DataFrame:
    """(row, doc_id, n_words, blocks): the template words of every block as numbers place * V + word.

    Places count from the block's start. Written to the shared folder, which fixes ``row`` and
    lets the later steps read the documents no more.
    """
    spark, size = docs.sparkSession, len(vocabulary)
    known = F.array(*[F.lit(w) for w in vocabulary])

    def hits(k: Column) -> Column:
        block = F.slice("words", k * stride + 1, F.lit(2 * stride))
        number = lambda w, i: F.when(w.isin(vocabulary), (i * size + F.array_position(known, w) - 1).cast("int"))
        return F.array_compact(F.transform(block, number))

    numbers = F.when(F.col("n_words") > 0, F.sequence(F.lit(0), F.floor((F.col("n_words") - 1) / stride).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    blocks = F.filter(F.transform(numbers, lambda k: F.struct(k.alias("k"), hits(k).alias("hits"))), lambda b: F.size(b.hits) > 0)
    path = shared_path(spark, "license-blocks")
    rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", blocks.alias("blocks")).write.parquet(path)
    return spark.read.parquet(path)


def word_order(stored: DataFrame, vocabulary: list[str], stride: int) -> list[int]:
    """The rank of each template word by its number of places in all documents, rarest first."""
    size = len(vocabulary)
    hits = stored.select(F.explode("blocks").alias("b")).select(F.explode("b.hits").alias("h"))
    # a place is in two blocks; it counts in the one in whose first half it stands
    counts = hits.filter(F.col("h") < stride * size).groupBy((F.col("h") % size).alias("w")).agg(F.count("*").alias("n"))
    found = {r["w"]: r["n"] for r in counts.collect()}  # a row per template word
    rank = [0] * size
    for r, w in enumerate(sorted(range(size), key=lambda w: (found.get(w, 0), vocabulary[w]))):
        rank[w] = r
    return rank


def label_names(templates: list[Template]) -> list[str]:
    names = sorted({t.label for t in templates})
    if len(names) > 62:
        raise ValueError("at most 62 labels")
    return names


INDEX_SCHEMA = "token int, i int, template int, tokens array<int>, needed int, spots array<int>, label string, bit long"


def template_index(templates: list[Template], vocabulary: list[str], rank: list[int]) -> list[tuple]:
    """One entry per prefix word of a template: token, its place i in the template's order, and the template."""
    at, names = {w: i for i, w in enumerate(vocabulary)}, label_names(templates)
    rows = []
    for t, template in enumerate(templates):
        tokens = sorted({rank[at[w]] for w in template.words})
        spots = [at[w] for w in template.words] if template.exact else None
        rows += [(tokens[i], i, t, tokens, template.needed, spots, template.label, 1 << names.index(template.label)) for i in range(len(tokens) - template.needed + 1)]
    return rows


def find_blocks(stored: DataFrame, templates: list[Template], vocabulary: list[str], stride: int) -> DataFrame:
    """(row, k, template, label, bit, containment, places): every block that meets a template's threshold."""
    size, rank = len(vocabulary), word_order(stored, vocabulary, stride)
    ranks = F.array(*[F.lit(r) for r in rank])
    entries = template_index(templates, vocabulary, rank)
    prefix = sorted({e[0] for e in entries})
    index = stored.sparkSession.createDataFrame(entries, INDEX_SCHEMA)
    least = min(t.needed for t in templates)
    blocks = stored.select("row", F.explode("blocks").alias("b")).select("row", "b.k", "b.hits")
    mine = F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.get(ranks, h % size))))
    blocks = blocks.withColumn("mine", mine).filter(F.size("mine") >= least)
    probes = blocks.select("*", F.posexplode("mine").alias("j", "token")).filter(F.col("token").isin(prefix))
    pairs = probes.join(F.broadcast(index), "token")
    n_block, n_template = F.size("mine"), F.size("tokens")
    pairs = pairs.filter((n_block >= F.col("needed")) & (F.least(n_template - F.col("i"), n_block - F.col("j")) >= F.col("needed")))
    pairs = pairs.withColumn("both", F.array_intersect("mine", "tokens")).filter((F.get("both", F.lit(0)) == F.col("token")) & (F.size("both") >= F.col("needed")))

    def stands(h: Column) -> Column:
        rest = F.sequence(F.lit(1), F.size("spots") - 1)
        after = lambda o: F.array_contains("hits", h + o * size + F.get("spots", o) - F.get("spots", F.lit(0)))
        return (h % size == F.get("spots", F.lit(0))) & (h < stride * size) & F.forall(rest, after)

    places = F.when(F.col("spots").isNotNull(), F.transform(F.filter("hits", stands), lambda h: (F.floor(h / size) + F.col("k") * stride).cast("long")))
    found = pairs.select("row", "k", "template", "label", "bit", (F.size("both") / n_template).alias("containment"), places.alias("places"))
    return found.filter("places is null or size(places) > 0")


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base columns come from the ``exact`` templates: all places, the smallest and the largest start, their
    labels. ``labels`` adds those of the other templates; ``score`` is the highest containment
    among the blocks found, 0 without one.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for t in templates for w in t.words})
    stride = max(len(t.words) for t in templates)
    stored = block_hits(docs, vocabulary, stride)
    found = find_blocks(stored, templates, vocabulary, stride)
    base = F.col("places").isNotNull()
    none = F.lit(None).cast("long")
    finds = found.select(
        "row", none.alias("doc_id"), none.alias("n_words"), F.when(base, F.size("places")).otherwise(0).alias("n"), F.array_min("places").alias("lo"),
        F.array_max("places").alias("hi"), F.when(base, F.col("bit")).otherwise(0).alias("base"), F.col("bit").alias("all"), F.col("containment").alias("score"))
    zero = F.lit(0).cast("long")
    every = stored.select("row", "doc_id", "n_words", F.lit(0).alias("n"), none.alias("lo"), none.alias("hi"), zero.alias("base"), zero.alias("all"), F.lit(0.0).alias("score"))
    out = every.unionByName(finds).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("n").alias("n_base"), F.min("lo").alias("first_word"),
        F.max("hi").alias("last_word"), F.bit_or("base").alias("base"), F.bit_or("all").alias("all"), F.max("score").alias("score"))

    def listed(mask: str) -> Column:
        return F.concat_ws(",", *[F.when(F.col(mask).bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(label_names(templates))])

    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", listed("base").alias("base_labels"), listed("all").alias("labels"), "score")


def scan_sql(templates: list[Template] | None = None) -> str:
    """The same result as DuckDB SQL over ``documents``: every block counted against every template."""
    templates = TEMPLATES if templates is None else templates
    stride = max(len(t.words) for t in templates)
    tokens = ", ".join(f"({i}, '{w}', {len(set(t.words))}, {t.needed}, {t.exact}, '{t.label}')" for i, t in enumerate(templates) for w in sorted(set(t.words)))
    phrases = ", ".join(f"({t.words}, '{t.label}')" for t in templates if t.exact)
    return rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
tokens(t, w, n, needed, exact, label) AS (VALUES {tokens}),
places AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM docs),
known AS (SELECT * FROM places WHERE w IN (SELECT w FROM tokens)),
inside AS (SELECT doc_id, w, p // {stride} AS k FROM known UNION SELECT doc_id, w, p // {stride} - 1 FROM known WHERE p >= {stride}),
shared AS (SELECT doc_id, label, count(DISTINCT w) / any_value(n) AS c FROM inside JOIN tokens USING (w) WHERE NOT exact
           GROUP BY doc_id, k, t, label HAVING count(DISTINCT w) >= any_value(needed)),
phrases(ph, label) AS (VALUES {phrases}),
based AS (SELECT d.doc_id, p.label, k.p AS p FROM known k JOIN docs d USING (doc_id) JOIN phrases p ON k.w = p.ph[1] AND d.ws[k.p + 1:k.p + len(p.ph)] = p.ph),
b AS (SELECT doc_id, count(*) AS n, min(p) AS lo, max(p) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM based GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(c) AS c
      FROM (SELECT doc_id, label, c FROM shared UNION ALL SELECT doc_id, label, 1.0 FROM based) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(b.l, '') AS base_labels, coalesce(a.l, '') AS labels, CAST(coalesce(c, 0) AS DOUBLE) AS score
FROM docs d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id
"""
