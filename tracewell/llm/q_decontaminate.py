"""Registered query: benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.llm.decontaminate import leaks
from tracewell.llm.registry import query, table


@query("op4_decontaminate")
def op4_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.inline(found))
