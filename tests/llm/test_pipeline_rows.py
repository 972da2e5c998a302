"""Stages that filter take rejected texts only, not all rows of their id."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.cases import documents, prose, sorted_rows
from tests.llm.test_pipeline import QUESTION, tables


def test_clean_texts_stay_beside_rejected_ones_of_their_id(spark, folder):
    clean = [(None, prose(2, 60)), (5, prose(2, 60)), (6, prose(3, 60))]
    short = [(None, None), (None, "too short"), (5, "too short")]
    leaked = [(None, f"{prose(4, 60)} {QUESTION}"), (6, f"{prose(5, 60)} {QUESTION}")]
    tables(spark, folder, clean)
    left = corpus_pipeline.quality_stage(spark, documents(spark, clean + short), folder)
    assert sorted_rows(left.select("doc_id", "text").collect()) == sorted_rows(clean)
    left = corpus_pipeline.decontamination_stage(spark, documents(spark, clean + leaked), folder)
    assert sorted_rows(left.select("doc_id", "text").collect()) == sorted_rows(clean)
