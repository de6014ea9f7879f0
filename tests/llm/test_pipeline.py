"""The pipeline stage by stage, and the queries of the operators over the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
import helpers  # noqa: E402

import corpus_pipeline  # noqa: E402
from tideframe.llm import queries  # noqa: E402
from tideframe.llm.common import written  # noqa: E402


def test_stages(spark, sf):
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "test")
        after[name] = docs
    one, two, three, four, five = after.values()
    for df in (one, two, three, four):
        assert df.columns == start.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in start.collect()}
    assert len(ids(start) - ids(one)) <= 0.02 * len(texts)
    groups = helpers.jaccard([(i, texts[i]) for i in ids(one)])
    assert ids(two) == {i for i, _, c in groups if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids(three) == {i for i in ids(two) if not helpers.contaminating(texts[i], items)}
    assert not any(t in texts[i] for _, t in items for i in ids(three))
    assert ids(four) <= ids(three) and four.count() >= len(ids(four))
    assert five.count() == four.count()
    assert corpus_pipeline.run(spark, sf).count() == five.count()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    rows = spark.read.parquet(f"{sf}/{'embeddings' if name.startswith('op9') else 'documents'}.parquet").count()
    assert df.count() == rows


def test_sharding_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(queries.oracle_sql()["op3_sharding"]).fetchall()
    got = queries.op3_sharding(spark, sf).select("doc_id", "slot", "shard").collect()
    assert sorted(map(tuple, got)) == sorted(want)
