"""The registered queries and the pipeline on the smallest tables."""
import pytest

import corpus_pipeline
from deltascope.llm import byte_cnn, common, minhash, packing, quality_rules, queries
from tests.llm.test_links import brute_classes

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, FOLDER, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "minhash_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.collect(), docs.columns
        docs = common.stored(stage(spark, docs, FOLDER), name)
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before}
        else:
            assert docs.columns == columns and set(docs.collect()) <= set(before)
        if name == "minhash_dedup":
            classes = brute_classes([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in docs.collect()} == set(classes.values())
    assert sorted(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32").collect()))
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, whole.groupBy("doc_id").sum("length").collect())) == sorted(map(tuple, docs.groupBy("doc_id").sum("length").collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "conversations"):
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, FOLDER)
    want = connection.sql(queries.ORACLES[name])
    order = sorted(frame.columns)
    assert order == sorted(want.columns)
    assert sorted(str(tuple(r[c] for c in order)) for r in frame.collect()) == sorted(str(r) for r in want.select(*order).fetchall())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES if n != "pipeline"} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in queries.QUERIES and set(queries.ORACLES) <= set(queries.QUERIES)
    assert (byte_cnn.THRESHOLD, minhash.SIMILARITY, minhash.SHINGLE, packing.WINDOW, quality_rules.LEAST_WORDS) == (0.3, 0.8, 5, 1024, 10)
