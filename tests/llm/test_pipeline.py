import corpus_pipeline as pipeline
from cuesheet.llm import line_dedup
from cuesheet.session import BATCH_BYTES, MOST_BATCH_BYTES


def test_stages_keep_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontaminate", "mix"]
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.stored(stage(spark, docs, folder))
        assert after.columns == list(pipeline.COLUMNS)
        assert before * 0.6 <= after.count() <= before
        docs, before = after, after.count()
    mixed = pipeline.mix(spark, docs, folder)
    assert mixed.count() == before
    whole = pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, mixed.collect()))


def test_empty_documents(spark, folder):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_batches_of_stages_are_bound_by_bytes(spark, folder):
    bound = spark.conf.get(BATCH_BYTES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    try:
        for _, stage in pipeline.STAGES[:-1]:
            spark.conf.unset(BATCH_BYTES)
            stage(spark, docs.limit(20), folder)
            assert int(spark.conf.get(BATCH_BYTES)) == MOST_BATCH_BYTES
            spark.conf.set(BATCH_BYTES, "1000000")
            stage(spark, docs.limit(20), folder)
            assert spark.conf.get(BATCH_BYTES) == "1000000"
    finally:
        spark.conf.set(BATCH_BYTES, bound)


def test_lines_are_aligned_once(spark):
    kinds = "i int, k int, chars int, before bigint, after bigint, partner bigint, j int, places array<int>, once boolean, holder_before bigint, holder_after bigint, df bigint"
    line = (0, 1, 80, None, None, 7, 3, None, True, None, None, 2)
    short = (0, 1, 8, None, None, 7, 3, None, True, None, None, 2)
    lists = spark.createDataFrame([(5, [line]), (6, [short])], f"row bigint, shared array<struct<{kinds.replace(' ', ':').replace(',:', ',')}>>")
    found = line_dedup.aligned(lists)
    plan = found.where("size(removed) > 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert [tuple(r) for r in found.collect()] == [(5, [0])]
