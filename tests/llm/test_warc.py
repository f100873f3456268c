import base64
import gzip
import hashlib
import random

from tracewell.llm import warc as W


def _index(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, block string, digest string")
    return W.archive_round_trip(df.repartition(3), **kw).collect()


def test_chunked_framing():
    for n in (0, 1, 8192, 8193, 50_000):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert W.unchunked(W.chunked(data)) == data
    for broken in (b"5\r\nab", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b""):
        try:
            W.unchunked(broken)
        except ValueError:
            continue
        raise AssertionError(broken)


def test_pages_come_back(spark):
    rng = random.Random(1)
    big = "".join(rng.choice("abc é漢😀\r\n") for _ in range(90_000)) + "\r\n\r\nWARC/1.1\r\n"
    same, small = "equal " * 400, "tiny"
    rows = [(1, "http://a/ü b\r\nX: y", big), (2, None, same), (3, "u", same), (None, "u", same), (4, "u", small),
            (5, "u", small), (6, "u", None), (7, "u", ""), (8, "u", big), (9, "u", "Z" * 40_000),
            (3, "u", same), (9, "u", "Z" * 40_000), (None, None, None)]
    got = _index(spark, [(*r, "x", "y") for r in rows], segment_bytes=5_000)
    assert len(got) == len(rows) and all(r["problem"] is None for r in got)
    seen = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in got)
    n = len(big.encode())
    assert seen == sorted([
        (1, n, "revisit", 8), (2, 2400, "revisit", 3), (3, 2400, "response", 0), (3, 2400, "response", 0),
        (0, 2400, "revisit", 3), (4, 4, "response", 0), (5, 4, "response", 0), (6, 0, "response", 0),
        (7, 0, "response", 0), (8, n, "response", 0), (9, 40_000, "response", 0), (9, 40_000, "response", 0),
        (0, 0, "response", 0)])
    assert {r["segments"] for r in got if r["page_id"] == 8} == {-(-(n + 250) // 5_000)}


def test_payloads_and_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://h/p?q#f", "text ü" * 3000)], "page_id bigint, url string, html string")
    W.write_archives(df, f"{tmp_path}/w", segment_bytes=1_000)
    row = W.reassemble(W.read_records(spark, f"{tmp_path}/w")).collect()
    assert len(row) == 1 and bytes(row[0]["payload"]).decode() == "text ü" * 3000
    assert row[0]["url"] == "http://h/p?q#f" and row[0]["segments"] > 15


def _records(spark, tmp_path, parts, name):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(p + b"\n") for p in parts))
    return W.reassemble(W.read_records(spark, str(folder))).collect()


def test_segments_out_of_order_missing_or_broken(spark, tmp_path):
    parts = list(W.page_records(1, "u", b"x" * 9_000, None, False, 2_000))
    shuffled = [parts[3], parts[0], parts[4], parts[2], parts[1]]
    ok = _records(spark, tmp_path, shuffled, "ok")
    assert [bytes(r["payload"]) for r in ok] == [b"x" * 9_000]
    for name, bad, why in (("gap", [parts[0], *parts[2:]], "segment missing"),
                           ("tail", parts[:4], "total length differs"),
                           ("head", parts[1:], "no first segment")):
        got = _records(spark, tmp_path, bad, name)
        assert [(r["payload"], r["problem"]) for r in got] == [(None, why)]
    cut = _records(spark, tmp_path, [parts[0][:300]], "cut")
    assert cut[-1]["problem"] in ("record cut short", "no record header")


def test_no_rows(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert W.archive_round_trip(df).count() == 0


def _foreign(fields, block=b"HTTP/1.1 200 OK\r\n\r\nhello"):
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": "response", **fields}.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r"


def test_foreign_headers(spark, tmp_path):
    sha = hashlib.sha1(b"hello")
    b32 = base64.b32encode(sha.digest()).decode()
    good = [{"WARC-Payload-Digest": f"sha1:{x}"} for x in (b32, b32.lower(), sha.hexdigest(), sha.hexdigest().upper())]
    good += [{"WARC-Payload-Digest": "sha256:zz"}, {"X-Page-Id": "-7"}, {}]
    bad = [{"WARC-Payload-Digest": "sha1:abc"}, {"WARC-Payload-Digest": "sha1:"}, {"X-Page-Id": "\u00b2"},
           {"X-Page-Id": "--1"}, {"WARC-Segment-Number": str(1 << 31)}, {"X-Page-Id": "9" * 30}]
    got = _records(spark, tmp_path, [_foreign({"WARC-Record-ID": str(i), **f}) for i, f in enumerate(good + bad)], "f")
    assert len(got) == len(good) + len(bad)
    for r in got:
        if int(r["record_id"]) < len(good):
            assert bytes(r["payload"]) == b"hello" and r["problem"] is None
        else:
            assert r["payload"] is None and r["problem"].startswith("bad ")
    wrong = _records(spark, tmp_path, [_foreign({"WARC-Payload-Digest": "sha1:" + "da39" * 10})], "w")
    assert [r["problem"] for r in wrong] == ["digest differs"]


def test_reading_goes_on_behind_a_broken_record(spark, tmp_path):
    whole = _foreign({"WARC-Record-ID": "a"})
    cut = whole.replace(b"Content-Length: 24", b"Content-Length: 99")
    odd = whole.replace(b"Content-Length: 24", "Content-Length: \u00b2".encode())
    assert cut != whole != odd
    got = _records(spark, tmp_path, [whole, cut, whole, odd, whole], "b")
    assert sum(r["problem"] is None for r in got) == 3 and sum(r["problem"] is not None for r in got) == 2
    member = gzip.compress(whole + b"\n")
    broken = member[:14] + b"\xff\xff\xff" + member[17:]
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "a.gz").write_bytes(member + broken + member)
    got = W.reassemble(W.read_records(spark, str(folder))).collect()
    assert sum(r["problem"] is None for r in got) == 2 and any(r["problem"] for r in got)
