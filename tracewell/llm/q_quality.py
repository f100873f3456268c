"""Registered query: quality rules."""

from __future__ import annotations

from tracewell.llm.quality import judge
from tracewell.llm.registry import query, table


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")
