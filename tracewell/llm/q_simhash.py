"""Registered query: SimHash near-deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.llm.registry import query, table
from tracewell.llm.simhash import near_duplicates


@query("op3_simhash_dedup")
def op3_simhash_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")
