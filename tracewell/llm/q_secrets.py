"""Registered query: secret scans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.llm.registry import query, table
from tracewell.llm.secrets import BASE, secret_spans


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])),
                        ",")


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", secret_spans(F.col("text")).alias("all"))
    count = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("all", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"))
