from pyspark.sql import functions as F

from tracewell.llm.chat import CHATML, escape, format_conversations, loss_text, parse_formatted, unescape

SCHEMA = "conv_id bigint, turn bigint, role string, text string, turns string, segments string"


def _format(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = format_conversations(df).select(
        "*", parse_formatted(F.col("formatted")).alias("back"), loss_text(F.col("segments")).alias("loss"))
    return {r["conv_id"]: r for r in out.collect()}


def test_escape_is_reversible(spark):
    texts = ["<|im_end|>", "<\\|x", "<\\\\|", "<<|>|", "a\\<|\\", "", "<|<|", "\n<|im_start|>user\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"] and "<|" not in r["e"]


def test_turn_order_and_round_trip(spark):
    rows = [
        (1, 2, "assistant", "two"), (1, 1, "user", "one"),
        (2, 1, "assistant", "starts wrong"), (2, 2, "user", None),
        (3, 1, "system", "s"), (3, 2, "user", "u"), (3, 3, "assistant", "a"), (3, 4, "user", "open"),
        (4, 1, "us\ner%0A<|", "odd role"), (4, 2, None, "none"),
        (None, 1, "user", "q"), (None, 1, "assistant", "<|im_end|>"), (None, None, "user", "first"),
        (5, 1, "user", "same"), (5, 1, "user", "same"), (5, 2, "assistant", "x" * 300_000)]
    got = _format(spark, rows)
    assert (got[1]["valid"], got[1]["bad_turn"]) == (True, None)
    assert (got[2]["valid"], got[2]["bad_turn"]) == (False, 0)
    assert (got[3]["valid"], got[3]["bad_turn"]) == (False, None)
    assert (got[5]["valid"], got[5]["bad_turn"]) == (False, 1)
    for conv, r in got.items():
        want = sorted(((t is not None, t or 0, ro or "", x or "") for c, t, ro, x in rows if c == conv))
        assert [(b["role"], b["text"]) for b in r["back"]] == [w[2:] for w in want]
        assert r["loss"] == "".join(w[3] for w in want if w[2] == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["formatted"].count(CHATML.open) == len(want)


def test_no_rows(spark):
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
