import importlib

import __spark_entry__ as entry


def test_stages_and_registration(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "personal_data", "mixing", "packing"]


def test_pipeline_runs_on_all_documents(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept and kept <= ids
    out = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == kept and max(r.offset + r.length for r in out) <= 2048


def test_stages_drop_what_other_stages_left_in_a_worker(spark):
    """pipeline: the tables of an encoder stay in a Python worker; the stages that follow in it free them."""
    import pyarrow as pa
    from packetspark.llm import common, quality
    from packetspark.llm.tokens import encoder, vocabulary

    def held(batches):
        code = encoder(vocabulary("byte_bpe_50k.json"), True)
        code.encode(pa.array(["some words"]))
        seen = []
        for batch in quality_task(iter([pa.RecordBatch.from_pydict({"text": ["a b"], "doc_id": [1]})])):
            seen.append(encoder.cache_info().currsize)
        yield from (pa.RecordBatch.from_pydict({"n": seen}) for _ in batches)
    quality_task = common.lean(quality._scores({}))
    assert [r.n for r in spark.range(1, numPartitions=1).mapInArrow(held, "n long").collect()] == [0]
    plan = quality.good_documents(spark.createDataFrame([(1, "a", "s", "en")], "doc_id long, text string, source string, lang string"),
                                  spark.createDataFrame([(1, 0, 0)], "doc_id long, quality long, toxic long"))._jdf.queryExecution().toString()
    assert "task(" in plan
