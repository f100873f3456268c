import random

from tracewell.llm.linededup import dedup_lines, drop_repeated_lines

BLANKS = " \t\n\x0b\x0c\r"


def _plain(docs, least):
    """Deletes every line inside a run of enough words that also stands earlier, all runs tried."""
    lines = []  # (doc, line number, trimmed line, words)
    for d, text in sorted(docs.items()):
        for n, x in enumerate((text or "").split("\n")):
            if x.strip(BLANKS):
                lines.append((d, n, x.strip(BLANKS), len(x.encode().split())))
    seqs = {d: [x for x in lines if x[0] == d] for d in docs}
    gone = set()
    order = sorted(docs)
    for d in order:
        s = seqs[d]
        for i in range(len(s)):
            for e in order[:order.index(d) + 1]:
                t = seqs[e]
                for j in range(len(t) if e != d else i):
                    k = 0
                    while i + k < len(s) and j + k < len(t) and s[i + k][2] == t[j + k][2]:
                        k += 1
                    if sum(x[3] for x in s[i:i + k]) >= least:
                        gone |= {(d, x[1]) for x in s[i:i + k]}
        for a, b in zip(s, s[1:]):  # blank lines between deleted lines
            if {(d, a[1]), (d, b[1])} <= gone:
                gone |= {(d, n) for n in range(a[1], b[1])}
    return {d: text if text is None else "\n".join(
        x for n, x in enumerate(text.split("\n")) if (d, n) not in gone) for d, text in docs.items()}


def test_against_all_pairs(spark):
    rng = random.Random(5)
    pool = [" ".join(f"{chr(97 + i)}{j}" for j in range(rng.randrange(1, 9))) for i in range(12)]
    docs = {}
    for d in range(40):
        body = [rng.choice(["", "  ", *pool]) for _ in range(rng.randrange(1, 14))]
        if d > 3 and rng.random() < .5:
            body += [f" {x}\t" for x in docs[rng.randrange(d)].split("\n")[1:7]]
        docs[d] = "\n".join(body)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    for least in (4, 10, 21):
        got = {r["row"]["doc_id"]: r["text"] for r in dedup_lines(df, min_words=least).collect()}
        assert got == _plain(docs, least)


def test_odd_rows(odd, nothing):
    out = drop_repeated_lines(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    text = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == 12  # nothing is only copies; rows that share an id count as one document
    assert text[1].count("\n") == 9 and text[2] == "Other start here\nend two"
    assert text[3] is None and text[4] == "" and text[5] == "   \n\t\n"
    assert drop_repeated_lines(nothing).count() == 0


def test_copies_that_hold_nothing_else_go(spark):
    body = "\n".join(f"line {i} " + "word " * 20 for i in range(5))
    df = spark.createDataFrame([(1, body), (2, body), (3, body + "\nown")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in drop_repeated_lines(df).collect()} == {1: body, 3: "own"}
