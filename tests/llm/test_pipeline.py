"""The pipeline's stages take effect, each on what the one before kept."""

import corpus_pipeline
from glimmer.llm import langid, packing, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "packing"]
    kept = docs
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns
        seen.append(kept.count())
    accepted = {r["doc_id"] for r in langid.predict(docs, langid.fit(langid.training_rows(docs))).where("accepted").collect()}
    judged = docs.where(docs.doc_id.isin(list(accepted)))
    good = {r["doc_id"] for r in quality.quality(judged).where("kept").collect()}
    groups = simhash.near_duplicates(docs.where(docs.doc_id.isin(list(good)))).collect()
    want = {r["component_id"] for r in groups}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert seen == [docs.count(), len(accepted), len(good), len(want)] and seen[0] > seen[2] > seen[3]
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.collect()} == want
    assert packed.count() == packing.pack(kept, packing.word_tokenizer()).count()


def test_odd_rows_go_through(spark, odd_docs, no_docs):
    for table in (odd_docs, no_docs):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            now.count()
            if name != "packing":
                assert now.columns == table.columns
