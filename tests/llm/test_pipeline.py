"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

from collections import defaultdict

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline
    from stockflow.llm import decontam, ngram_join, toxicity
    from stockflow.llm.frames import stored, table

    docs = table(spark, SF, "documents")
    columns = docs.columns
    labels, bench = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["toxicity"]
    assert ids(after) == {r.doc_id for r in toxicity.score_documents(before, labels).collect() if not r.predicted}
    before, after = seen["ngram_dedup"]
    groups = defaultdict(list)
    for r in ngram_join.ngram_components(before, 5, 80, 100).collect():
        groups[r.component_id].append(r.doc_id)
    assert ids(after) == {min(g) for g in groups.values()}
    before, after = seen["decontamination"]
    assert ids(after) == {r.doc_id for r in decontam.contamination(before, bench).collect() if not r.contaminated}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_dedup", "decontamination", "packing"]


def test_run(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    ends = defaultdict(int)
    for r in rows:
        ends[r.sequence_id] += r.length
    assert rows and all(n <= 2048 and n & (n - 1) == 0 for n in ends.values())
