"""The registered queries of the training-data operators, and the library without them."""

import os
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import bag  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_": {"doc_id", "fingerprint", "component_id"},
    "op3_": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op4_": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op5_": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op7_": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op8_": {"doc_id", "size", "source_size", "target", "taken"},
    "op9_": {"doc_id", "held_out", "score", "predicted"},
    "op10_": {"doc_id", "held_out", "score", "predicted"},
    "op11_": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
}


@pytest.mark.parametrize("prefix", sorted(COLUMNS))
def test_query_returns_one_row_per_document(spark, prefix):
    [name] = [k for k in entry.queries() if k.startswith(prefix)]
    out = entry.queries()[name](spark, SF)
    assert COLUMNS[prefix] <= set(out.columns)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


@pytest.mark.parametrize("prefix", ["op3_", "op5_", "op11_", "op13_"])
def test_query_equals_its_sql(spark, prefix):
    [name] = [k for k in entry.oracle_sql() if k.startswith(prefix)]
    con = duckdb.connect()
    for name_ in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{SF}/{name_}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    out = entry.queries()[name](spark, SF)
    assert sorted(names) == sorted(out.columns)
    assert bag([tuple(r) for r in out.collect()], out.columns) == bag(rel.fetchall(), names)


def test_every_number_is_registered_once():
    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 1 + len(names))) and len(names) >= 10 and "pipeline" in entry.queries()


def test_the_rest_imports_without_the_operators(tmp_path):
    """A copy of the library without this subpackage and the pipeline still registers its queries."""
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 250 and not any(k.startswith('op') for k in q); e.oracle_sql()"
    for name in ("regionloom", "__spark_entry__.py"):
        os.symlink(os.path.join(ROOT, name), tmp_path / name) if name.endswith(".py") else os.mkdir(tmp_path / name)
    for name in os.listdir(os.path.join(ROOT, "regionloom")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(ROOT, "regionloom", name), tmp_path / "regionloom" / name)
    # the entry file's own folder comes first on the path, so it is copied, not linked
    os.unlink(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(os.path.join(ROOT, "__spark_entry__.py")).read())
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-800:]
