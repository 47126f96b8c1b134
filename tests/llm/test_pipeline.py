"""The pipeline: order, whole stages and their effects."""

import corpus_pipeline
import pytest
from fixtures import documents, texts

from evidlake.llm.common import keep

SF = "/root/testdata/sf0.001"


def test_stages_on_a_table_of_the_driver(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "personal_data", "source_mix", "packing"
    ]
    docs = corpus_pipeline.table(spark, SF, "documents")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert 0.8 * 200 < counts[0] <= 200 and counts[1] < counts[0] and counts[2] == counts[1] and counts[4] > 0


def test_near_duplicates_and_mix_keep_what_they_should(spark):
    values = texts()
    docs = documents(spark, values).select(*corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    from test_documents import brute_components

    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, stays in brute_components(values) if stays]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, stage):
    docs = documents(spark).select(*corpus_pipeline.COLUMNS).limit(0)
    assert stage(spark, docs, SF).count() == 0
