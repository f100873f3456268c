"""Registered query: main text of web pages. It has no form in SQL; tests compare with known texts."""

from __future__ import annotations

from tracewell.llm.maintext import extract
from tracewell.llm.registry import query, table


@query("op13_main_text")
def op13_main_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
