import pytest

from pyspark.sql import functions as F
from tracewell import schemas
from tracewell.operators import flow as FL
from tracewell.operators import normalize as N
from tracewell.sources import readers as R


def _lines(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "pos int, value string")


def test_session_markers(spark):
    got = R.parse_sessions(_lines(spark, [
        "SESSION 1 END 2024-01-01T00:00:00Z",          # no start yet
        "SESSION 1 START 2024-01-01T00:01:00Z",
        "SESSION 1 START 2024-01-01T00:02:00Z",        # the latest start wins
        "SESSION 1 END 2024-01-01T00:03:00Z",
        "SESSION 1 END 2024-01-01T00:09:00Z",          # repeats the closed span
        "NOISE 3", "SESSION 2 START 2024-01-01T00:00:00Z",
        "SESSION 1 START 2024-01-01T01:00:00Z", "SESSION 1 END 2024-01-01T01:30:00.5Z"]))
    rows = [(r["session"], r["pos"], r["s"], r["e"]) for r in got.select(
        "session", "pos", F.date_format("start", "HH:mm").alias("s"),
        F.date_format("end", "HH:mm:ss.S").alias("e")).orderBy("pos").collect()]
    assert rows == [(1, 3, "00:02", "00:03:00.0"), (1, 4, "00:02", "00:03:00.0"),
                    (1, 8, "01:00", "01:30:00.5")]


def test_audit_lines_and_identities(spark, tmp_path):
    path = tmp_path / "audit.log"
    path.write_text("\n".join([
        '{"auditID":"1","user":{"username":"u"},"impersonatedUser":{"username":"v"},'
        '"annotations":{"authorization.k8s.io/decision":"forbid"},"responseStatus":{"code":403}}',
        "", "not json", '{"auditID":"2","impersonatedUser":{"username":"v"}}',
        '{"auditID":"3","user":{"username":"u"},"impersonatedUser":{"username":"u"}}',
        '{"auditID":"4","objectRef":{"resource":"pods"},"sourceIPs":["1.1.1.1","2.2.2.2"],'
        '"stageTimestamp":"2024-01-01T00:00:00Z","user":{"groups":["a","b"]}}']))
    df = R.read_audit_jsonl(spark, str(path))
    assert R.line_counts(df).first()[:] == (4, 1)
    good = df.where(~F.col("_bad"))
    got = {r["audit_key"]: (r["actor"], r["imp"], r["is_imp"], r["code"], r["decision"])
           for r in N.flatten_event(good).collect()}
    assert got == {"1": ("u", "v", 1, 403, "forbid"), "2": ("v", "v", 1, 0, ""),
                   "3": ("u", "", 0, 0, ""), "4": ("", "", 0, 0, "")}
    eff = {r["audit_key"]: r["actor"] for r in N.flatten_event(good, actor_mode="effective").collect()}
    assert eff == {"1": "v", "2": "v", "3": "u", "4": ""}
    wide = N.flatten_wide(good).where("event.auditID = '4'").first()
    assert (wide["timestamp"], wide["user_groups"], wide["source_ip"], wide["response_code"]) == (
        "2024-01-01T00:00:00Z", "a|b", "1.1.1.1", "")


def test_request_bodies(spark):
    rows = [('{"kind":"Pod","spec":{"hostPID":true,"volumes":[{"name":"a"},{"hostPath":{"path":"/"}}],'
             '"containers":[{"name":"c"},{"securityContext":{"privileged":true}}]}}',),
            ('{"kind":"Role","rules":[{"verbs":["get"]},{"resources":["*"]}]}',),
            ('{"kind":"Other","rules":[{"verbs":["*"]}]}',), (None,), ("7",)]
    df = spark.createDataFrame(rows, "request_object string")
    out = N.rbac_wildcard(N.pod_flags(df)).collect()
    assert tuple(out[0][1:]) == (1, 1, 1, 0, 0, 0)
    assert [r["rbac_wildcard"] for r in out] == [0, 1, 0, 0, 0]
    assert all(sum(r[1:6]) == 0 for r in out[1:])


def test_csv_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,label\n1,Benign \nx,label\n2,DDoS\n")
    (tmp_path / "b.csv").write_text("y,label\n3,0\n")
    assert R.read_csv_clean(spark, str(tmp_path / "a.csv")).count() == 2
    both = R.read_csv_union(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    got = {(r["x"], r["y"], r["source_file"]) for r in both.where("label <> 'label'").collect()}
    assert got == {("1", None, "a.csv"), ("2", None, "a.csv"), (None, "3", "b.csv")}


def test_label_columns():
    assert FL.detect_label_column(["a", "Class", "label"]) == "label"
    assert FL.detect_label_column(["a", "my_Attack_kind"]) == "my_Attack_kind"
    with pytest.raises(ValueError):
        FL.detect_label_column(["a"])


def test_load_and_align(spark):
    df = spark.createDataFrame(
        [("1.1.1.1", " TCP", "1.5", float("inf"), "Benign "), ("1.1.1.2", "gre", "abc", float("nan"), "x"),
         ("1.1.1.3", None, None, 2.0, None)], "src_ip string, protocol string, a string, b double, Label string")
    out, feats = FL.load_tabular(df)
    assert feats == ["protocol", "a", "b"]
    assert [tuple(r) for r in out.collect()] == [(6.0, 1.5, 0.0, 0), (0.0, 0.0, 0.0, 1), (0.0, 0.0, 2.0, 1)]
    al = FL.align_features(out, ["b", "zzz", "protocol"])
    assert al.columns == ["b", "zzz", "protocol"] and al.first()["zzz"] == 0.0


def test_derive_flow_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (2000.0, 10.0, 12.0)],
                               "duration double, packets_count double, fwd_packets_count double")
    a, b = FL.derive_flow(df).collect()
    assert (a["flow_pkts_per_s"], a["flow_iat_mean_s"], a["fwd_pkt_len_mean"]) == (0.0, 0.0, 0.0)
    assert (b["duration_s"], b["tot_bwd_pkts"], b["tot_bytes"]) == (0.002, 0.0, 15000.0)
    assert b["src_ip"] == "unknown" and b["protocol"] == 6


def test_directional_columns_are_summed(spark):
    df = spark.createDataFrame(
        [(2.0, 4, 6, 400, 600), (1.0, 0, 3, 0, 90)], "`Flow Duration` double, `Total Fwd Packets` int, "
        "`Total Backward Packets` int, `Total Length of Fwd Packets` int, `Total Length of Bwd Packets` int")
    a, b = FL.derive_flow(df).collect()
    assert (a["tot_fwd_pkts"], a["tot_bwd_pkts"], a["tot_bytes"], a["flow_pkts_per_s"]) == (4.0, 6.0, 1000.0, 5.0)
    assert (b["tot_fwd_pkts"], b["tot_bwd_pkts"], b["tot_bytes"]) == (0.0, 3.0, 90.0)


def test_line_order_follows_the_files(spark, tmp_path):
    # The closing line lies in the largest file, which Spark reads first.
    texts = ["SESSION 1 START 2024-01-01T00:00:00Z\n", "SESSION 1 START 2024-01-02T00:00:00Z\n",
             "x\n" * 5000 + "SESSION 1 END 2024-01-03T00:00:00Z\n", "SESSION 1 END 2024-01-04T00:00:00Z\n"]
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.txt").write_text(t)
    got = R.read_sessions(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["start"].day, r["end"].day) for r in got] == [(2, 3), (2, 3)]


def test_csv_folder_union(spark, tmp_path):
    for i in range(6):
        head = "a,b" if i % 2 else "b,c"
        (tmp_path / f"d{i}.csv").write_text(f"{head}\n{i},x\n{i},y\n")
    out = R.read_csv_union(spark, str(tmp_path))
    assert set(out.columns) == {"a", "b", "c", "source_file"}
    rows = {(r["source_file"], r["a"], r["b"], r["c"]) for r in out.collect()}
    assert ("d1.csv", "1", "x", None) in rows and ("d2.csv", None, "2", "y") in rows and len(rows) == 12


def test_packet_networks(spark):
    rows = [("10.244.9.1", "10.111.255.255", 6, 0x12), ("10.245.0.1", "10.112.0.0", 17, 0x12),
            ("bad", "10.96.0.0", 6, 0x01), ("300.1.1.1", "10.244.0.1", 1, 0)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, proto int, flags int")
    out = FL.packet_flags(df).collect()
    assert len(out) == 3  # neither TCP nor UDP is left out
    assert (out[0]["syn"], out[0]["ack"], out[0]["fin"], out[0]["src_is_pod"], out[0]["dst_is_service"]) == (
        1, 1, 0, 1, 1)
    assert (out[1]["syn"], out[1]["src_is_pod"], out[1]["dst_is_service"]) == (0, 0, 0)
    assert (out[2]["fin"], out[2]["src_is_pod"], out[2]["dst_is_service"]) == (1, 0, 1)


def test_label_text(spark):
    df = spark.createDataFrame([("DDoS_HTTP/Flood",), (" None ",), ("Port  Scan",)], "l string")
    out = df.withColumn("t", FL.label_normalize(F.col("l")))
    assert [r["t"] for r in out.collect()] == ["ddos http flood", "none", "port scan"]
    assert FL.keep_labels(out, "t", "ddos").count() == 2
    assert FL.keep_labels(out, "t", "attack").count() == 2


def test_syscall_filter(spark):
    df = R.parse_syscall_lines(_lines(spark, [
        "text", '{"rule":"r","output_fields":{"k8s.pod.name":"p"}}', '{"norule":1}', '{"broken']))
    assert [r["rule"] for r in df.collect()] == ["r"]
    assert schemas.SYSCALL_ALERT.fieldNames()[0] == "time"
