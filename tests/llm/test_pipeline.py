import brute
import corpus_pipeline
from conftest import frame, rows

from lectern.llm import quality
from lectern.session import kept


def test_stages_one_after_the_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, sf), name)
        steps.append(docs)
    assert all(s.columns == columns for s in steps[:-1])
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in steps[:-1]]
    source = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ratios = quality.fit(source, labels)
    rules = quality.calibrated(source, labels, ratios)
    assert set(texts[0]) == {r["doc_id"] for r in quality.judge(source, ratios, rules).where("kept").collect()}
    classes = brute.near_duplicates(list(texts[0].items()))
    assert set(texts[1]) == {r[1] for r in classes}
    cut = {r[0]: r for r in brute.repeated_bytes(list(texts[1].items()))}
    for d, text in texts[2].items():
        assert (text == texts[1][d]) == (cut[d][2] == 0 or len(text.encode()) == cut[d][1])
        assert cut[d][1] - cut[d][2] <= len(text.encode()) <= cut[d][1]
    assert all(not r[5] or r[0] not in texts[3] for r in brute.contamination(list(texts[2].items()), rows(spark.read.parquet(f"{sf}/benchmark.parquet"))))
    last = steps[-1].collect()
    assert {r["doc_id"] for r in last} == set(texts[3]) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last)
    assert set(texts[3]) <= set(given)


def test_run_with_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 5, None, None, None)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, odd, sf).collect()
        assert rows(stage(spark, odd.limit(0), sf)) == []
    assert len(rows(corpus_pipeline.STAGES[-1][1](spark, odd, sf))) == 3
    assert frame is not None
