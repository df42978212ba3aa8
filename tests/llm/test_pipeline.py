import pytest

import corpus_pipeline
from sparkweft.llm import decontaminate, quality, queries, stages
from sparkweft.llm.common import table

from ..oracle import SF, same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline_keeps_what_each_stage_decides(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    judged = quality.judge(docs, quality.fit(docs, table(spark, SF, "labels")))
    left = {r["doc_id"] for r in judged.filter("kept").collect()}
    assert 0 < len(left) < len(texts)
    from .test_corpus import fingerprint, joined

    prints = {d: fingerprint(texts[d]) for d in left}
    of = joined(set(prints.values()))
    first = {}
    for d in sorted(left):
        first.setdefault(of[prints[d]], d)
    left = set(first.values())
    dirty = decontaminate.decontaminate(docs, table(spark, SF, "benchmark")).filter("contaminated")
    left -= {r["doc_id"] for r in dirty.collect()}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "size", "source_size", "target", "copies", "taken"]
    assert {r["doc_id"] for r in out.collect()} == left


def test_stages_keep_columns_and_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x", None, None, 1, "k"), (1, None, "en", "web", None, "k"), (1, None, "en", "web", None, "k")], "doc_id long, text string, lang string, source string, n_chars long, c0 string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert stages.secret_scan(spark, docs, SF).count() == 3
