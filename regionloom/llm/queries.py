"""One query per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from regionloom.llm import decontamination, dialogue_repair, hard_negatives, licenses, minhash, mixing, phrase_dedup, pii, quality, sharding, simhash, suffix_dedup, toxicity
from regionloom.session import checkpointed
from regionloom.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_segments", "segments")


@query("op2_simhash_near_duplicates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query("op7_label_propagation_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).drop("g1", "n_row")


@query("op1_template_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP3_SQL = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
places AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM docs WHERE len(x) >= 400),
windows AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS m FROM places),
twice AS (SELECT m FROM windows GROUP BY m HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM windows JOIN twice USING (m)),
steps AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hits),
isles AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM steps),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS t FROM isles GROUP BY doc_id, g),
edges AS (SELECT doc_id, coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM spans
          UNION ALL SELECT d.doc_id, coalesce(max(t), 0), len(any_value(x)) // 2 FROM docs d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM edges JOIN docs USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(t - s) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM docs d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""


@query("op3_suffix_array_dedup", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


_OP5_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM words WHERE len(ws) >= 50),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM places),
earliest AS (SELECT s, min(doc_id) AS lo FROM windows GROUP BY s),
late AS (SELECT doc_id, i FROM windows JOIN earliest USING (s) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 50)) AS j FROM late)),
single AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM words),
kept AS (SELECT s.doc_id, string_agg(s.w, ' ' ORDER BY s.p) AS t, count(*) AS n
         FROM single s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.p = s.p WHERE g.p IS NULL GROUP BY s.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""


@query("op5_phrase_automata", _OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.deduplicate(table(spark, sf_dir, "documents"))


@query("op4_minhash_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return minhash.fingerprints(docs, checkpointed(minhash.near_duplicate_classes(docs)))


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query("op6_pii_surrogates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"))


@query("op11_license_scan", licenses.scan_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op12_dialogue_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue_repair.repair(table(spark, sf_dir, "conversations"))


@query("op13_hard_negatives", hard_negatives.MINE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), labels=moved)
