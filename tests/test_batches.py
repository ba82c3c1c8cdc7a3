"""Long rows reach Python workers in small batches: a worker and the JVM hold a batch each, for every task of an executor."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from codeweft import session
from codeweft.operators import keyword, vector
from codeweft.plans import ingest

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _batches_asked(monkeypatch):
    """Bound in force at every ``cut`` whose plan goes through a Python worker."""
    asked = []

    def spy(df, batch_bytes=None):
        if any(step in df._jdf.queryExecution().optimizedPlan().toString() for step in ("InArrow", "EvalPython")):
            asked.append(batch_bytes)
        return session.cut(df, batch_bytes)

    for module in (ingest, keyword, vector):
        monkeypatch.setattr(module, "cut", spy)
    return asked


def test_cut_bounds_batches_and_leaves_the_setting(spark):
    def measured(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    rows = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))
    before = spark.conf.get(SETTING, None)
    sizes = [row.n for row in session.cut(rows.mapInArrow(measured, "n long"), session.LONG_ROWS_BYTES).collect()]
    assert sum(sizes) >= 24_000_000 and max(sizes) <= session.LONG_ROWS_BYTES + 1_100_000
    assert spark.conf.get(SETTING, None) == before


def test_setting_is_restored_after_a_failure(spark):
    spark.conf.set(SETTING, "32m")
    try:
        with session.batches_of(spark, 1 << 20):
            assert spark.conf.get(SETTING) == str(1 << 20)
            raise KeyError
    except KeyError:
        assert spark.conf.get(SETTING) == "32m"
    finally:
        spark.conf.unset(SETTING)


def test_index_and_search_use_small_batches(spark, monkeypatch):
    asked = _batches_asked(monkeypatch)
    docs = spark.createDataFrame([("r", i, f"word{i % 3} other") for i in range(9)], "repo_id string, id long, text string")
    queries = spark.createDataFrame([("r", 1, "word1")], "repo_id string, query_id long, query string")
    found = keyword.bm25_search(keyword.build_keyword_index(docs), queries, 2)
    assert [row.id for row in found.orderBy("rank").collect()] == [1, 4]
    # Words to numbers, numbers to lists, and the search of the lists.
    assert asked == [session.LONG_ROWS_BYTES] * 3


def test_vector_search_uses_small_batches(spark, monkeypatch):
    asked = _batches_asked(monkeypatch)
    vectors = spark.createDataFrame([("r", i, [float(i), 1.0]) for i in range(5)], "repo_id string, id long, embedding array<double>")
    queries = vectors.where("id = 3").select(F.col("id").alias("query_id"), "repo_id", "embedding")
    assert [row.id for row in vector.vector_search(vectors, queries, 1).collect()] == [3]
    assert asked == [session.LONG_ROWS_BYTES]


def test_ingest_lists_few_lines_at_once(spark, monkeypatch):
    asked = _batches_asked(monkeypatch)
    files = spark.createDataFrame(
        [("r", "a/one.py", "python", "def one():\n    return two()\n"), ("r", "a/two.ts", "typescript", "function two() {\n}\n")],
        "repo_id string, file_path string, language string, content string",
    )
    symbols, _ = ingest.parse(files)
    assert sorted(row.name for row in symbols.where("type = 'function'").collect()) == ["one", "two"]
    assert asked == [session.LISTED_BYTES]
