"""Registered query: language-model scores."""

from __future__ import annotations

from tracewell.llm.lm import score_texts
from tracewell.llm.registry import query, table


@query("op1_lm_score")
def op1_lm_score(spark, sf_dir):
    out = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumnRenamed("id", "doc_id").select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
