import pytest

LONG = " ".join(f"word{i % 977}" for i in range(40_000))
PASSAGE = "\n".join(" ".join(f"{w}{i}" for w in "some line of a passage in two texts".split()) for i in range(8))
ROWS = [
    # doc_id, text, lang, source
    (1, "Alpha beta gamma\n" + PASSAGE + "\nend one", "en", "s1"),
    (2, "Other start here\n" + PASSAGE + "\nend two", "en", "s2"),
    (3, None, "en", "s1"),
    (4, "", None, None),
    (5, "   \n\t\n", "de", "s3"),
    (6, LONG, "en", "s1"),
    (7, "short", "", "s2"),
    (None, "a text without an id " * 9, "en", "s1"),
    (None, "a text without an id " * 9, "en", "s1"),
    (8, "repeated row " * 30, "fr", "s4"),
    (8, "repeated row " * 30, "fr", "s4"),
    (9, "ñandú über ﬁn 漢字 😀 " * 12, "es", "s2"),
]
# Names that the operators use inside, or that clash with results.
CLASH = ["id", "row", "key", "block", "size", "part", "text_hash", "_row", "_x", "copies", "stratum",
         "rule", "host", "fp", "root", "taken", "kept", "leaks", "lines_removed"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    extra = [f"x{i}" for i in range(len(CLASH))]
    rows = [(d, t, la, s, len(t or ""), *extra) for d, t, la, s in ROWS]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
        + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
