"""The pipeline stage by stage, and on odd rows."""

import corpus_pipeline
from gapweave.llm import decontam, near, ngram_lm, quality


def test_stages(spark, odd, tmp_path):
    sf = "/root/testdata/sf0.01"
    raw = docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == raw.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = kept["quality_classifier"].join(labels, "doc_id")
    assert judged.where("quality = 0").count() <= 0.03 * labels.where("quality = 0").count()
    assert judged.where("quality = 1").count() >= 0.97 * labels.where("quality = 1").count()
    assert near.duplicates(kept["near_duplicates"]).count() == 0
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontam.find(kept["decontamination"], items).count() == 0
    assert kept["packing"].select("doc_id").distinct().count() == kept["decontamination"].count()


def test_classifier_keeps_and_rejects_documents_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = ngram_lm.held_out("doc_id", 4, 2)
    unseen = docs.join(labels.where(held).select("doc_id", "quality"), "doc_id")
    kept = quality.keep_good(unseen, quality.fit(docs, labels.select("doc_id", "quality"), ~held))
    counts = {q: (unseen.where(f"quality = {q}").count(), kept.where(f"quality = {q}").count()) for q in (0, 1)}
    assert counts[0][1] <= 0.05 * counts[0][0] and counts[1][1] >= 0.95 * counts[1][0] > 0


def test_run_is_its_stages_in_order(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    cols = ["doc_id", "start", "length", "ids"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select(*cols).collect())) == sorted(map(tuple, docs.select(*cols).collect()))


def test_stages_give_odd_rows_their_defined_results(spark, odd):
    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    near_ids = [r["doc_id"] for r in sorted(stages["near_duplicates"](spark, odd, sf).collect(), key=key)]
    # Texts without words are one class, as are copies; repeated rows of the first id and rows without an id stay.
    assert near_ids == [1, 2, 3, 6, 6, 8, 9, 10, None, None]
    texts = {}
    for r in stages["substring_dedup"](spark, odd, sf).collect():
        texts.setdefault(r["doc_id"], []).append((r["text"], r["n_chars"], r["_text"]))
    before = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert texts[2][0][0] == " ".join(before[2].split()[:10]) and texts[2][0][1] == len(texts[2][0][0]) and texts[7] == [("", 0, "x")]
    assert sorted(t or "" for t, *_ in texts[None]) == ["", ""] and [t for t, *_ in texts[6]] == [before[6]] * 2
    assert all(texts[k][0][0] == before[k] for k in (1, 3, 4, 5, 8, 9, 10, 11))
    assert stages["decontamination"](spark, odd, sf).count() == odd.count()
    pieces = stages["packing"](spark, odd, sf).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in pieces if r["doc_id"] in (3, 6, None)} == {3: 1, 6: 2, None: 2} and max(r["count"] for r in pieces) > 10


def test_stages_take_odd_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.001"
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).count()
