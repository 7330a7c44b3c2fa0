"""Callers' columns named like the operators' own, through every stage of the pipeline."""

from __future__ import annotations

import pytest

NAMES = ["later", "_d", "_t", "_new", "_n_removed", "_key_d", "_key_t", "d", "T", "new", "n_removed", "key_d", "key_t", "tkey", "id", "size",
         "class", "prefix", "parts", "gram", "comp", "node", "root", "label", "c", "phrase", "hits", "words", "found", "s", "kind", "base", "pos"]


@pytest.fixture(scope="module")
def clashing(spark, edge_rows):
    line = " ".join(f"v{i}" for i in range(60)) + "."
    rows = [*edge_rows, (50, f"Own start.\n{line}"), (51, f"Other begin.\n{line}\nOther end."), (52, f"Other begin.\n{line}\nOther ends.")]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, *[f"{n} {k}" for n in NAMES]) for k, (i, t) in enumerate(rows)], schema)


def test_stages_hand_clashing_columns_through(spark, clashing, tiny_labels):
    from stockflow.llm import decontam, line_dedup, ngram_join, toxicity

    bench = spark.createDataFrame([(1, "three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    of = {r.later: r for r in clashing.collect()}
    for stage in (lambda d: toxicity.drop_toxic(d, tiny_labels), line_dedup.drop_repeated_lines, ngram_join.ngram_dedupe,
                  lambda d: decontam.drop_contaminated(d, bench)):
        out = stage(clashing)
        assert out.columns == clashing.columns
        rows = out.collect()
        assert 0 < len(rows) <= len(of)
        assert all(r[n] == of[r.later][n] for r in rows for n in ["doc_id", *NAMES])
    texts = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(clashing).collect()}
    assert texts[51] == "Other begin.\nOther end."
    assert "_n_removed" in line_dedup.dedupe_lines(clashing).columns


def test_queries_read_only_their_columns(spark, clashing):
    from stockflow.llm import phrases, pii

    assert pii.personal_data(clashing).count() == clashing.count()
    assert phrases.phrase_counts(clashing.selectExpr("*", "'en' as lang"), least=2).where("phrase = 'one two'").first().f == 5
