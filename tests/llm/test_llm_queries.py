"""The registered corpus queries against SQL on the smallest tables, and the pipeline stage by stage."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest
from compare import same
from motifloom.llm import catalog, common, decontaminate, jaccard, langid, quality
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(catalog.queries()[name](spark, FOLDER), catalog.oracle_sql()[name], FOLDER)


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.queries()) == list(range(1, 11))


def test_stages_of_the_pipeline_take_effect(spark):
    docs = common.table(spark, FOLDER, "documents")
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(stage(spark, before, FOLDER), f"test-{name}")
        assert after.columns == docs.columns
        ids, source = {r["doc_id"] for r in after.collect()}, {r["doc_id"] for r in before.collect()}
        assert ids <= source
        kept[name] = (source, ids)
        before = after
    model = quality.train_quality(docs, common.table(spark, FOLDER, "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    source, ids = kept["quality"]
    assert ids == {d for d in source if model.score(model.pool(texts[d])[None])[0] >= quality.THRESHOLD}
    source, ids = kept["near_duplicates"]
    classes = {r["doc_id"]: r["class_id"] for r in jaccard.jaccard_join(docs.where(F.col("doc_id").isin(sorted(source)))).collect()}
    assert ids == set(classes.values())
    source, ids = kept["decontamination"]
    index = decontaminate.build_index([(r["item_id"], r["text"]) for r in common.table(spark, FOLDER, "benchmark").collect()])
    assert ids == {d for d in source if not index.search([texts[d]])[0]}
    source, ids = kept["language"]
    assert all(langid.WORD.search(texts[d]) for d in ids) and len(ids) > 0.95 * len(source)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in before.collect()}


def test_pipeline_of_nothing_and_of_nulls(spark):
    docs = common.table(spark, FOLDER, "documents")
    odd = docs.limit(3).union(docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]))
    nothing = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        nothing = common.written(stage(spark, nothing, FOLDER), f"test-{name}")
        assert nothing.count() == 0
    # the untrained stages keep rows of nulls as they are; packing gives such a row one piece, its end id
    odd = odd.withColumn("class_id", F.lit(1))
    good = corpus_pipeline.keep_good(spark, odd, FOLDER).collect()
    assert all(r in [x[:5] for x in odd.collect()] for r in (tuple(g) for g in good))
    assert corpus_pipeline.keep_known_language(spark, odd, FOLDER).where("text IS NULL").count() == 0
    for stage in (corpus_pipeline.keep_one_of_each, corpus_pipeline.drop_leaks):
        kept = stage(spark, odd, FOLDER)
        assert kept.columns == corpus_pipeline.COLUMNS and kept.where("doc_id IS NULL").count() == 1
    pieces = corpus_pipeline.pack(spark, odd, FOLDER).where("doc_id IS NULL").collect()
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in pieces] == [(0, 1, 1)]
