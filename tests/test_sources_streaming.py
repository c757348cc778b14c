import json
import re

import pytest
from pyspark.sql import functions as F

from redactra import cli
from redactra.operators import dataset, leakage
from redactra.sources import readers, writers
from redactra.streaming import stream


def test_rows_round_trip(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text(json.dumps({"id": "1", "text": "x 😀", "lang": "ko", "spans": [{"start": 0, "end": 1, "label": "CVC"}]}, ensure_ascii=False) + "\n\n", encoding="utf-8")
    df = readers.read_rows(spark, str(p))
    assert df.first()["valid"] is True and df.count() == 1
    s = writers.write_rows(df, str(tmp_path / "out")).first()
    assert (s["rows"], s["spans"], s["labels"]) == (1, 1, 1)
    assert readers.read_rows(spark, str(tmp_path / "out")).first()["text"] == "x 😀"


def test_sentences_templates_text(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"sentence": "가", "sent_idx": "a_1_0", "PII_set": []}, {"sentence": "나", "sent_idx": "a_1_1", "PII_set": []}]))
    rows = readers.read_sentences(spark, str(tmp_path / "s.json")).orderBy("ord").collect()
    assert [r["sentence"] for r in rows] == ["가", "나"]
    (tmp_path / "t.jsonl").write_text('{"genre": "g", "style": "s", "text": "{PERSON}"}\n')
    assert readers.read_templates(spark, str(tmp_path / "t.jsonl")).first()["genre"] == "g"
    (tmp_path / "x.txt").write_text("one\ntwo")
    assert readers.read_text(spark, str(tmp_path / "x.txt")).first()["text"] == "one\ntwo"


def test_results(spark, tmp_path):
    body = {"micro": {"p": 1, "r": 1, "f1": 1, "partial_f1": 1}, "per_entity": {"CVC": {"support": 2, "p": 1, "r": 1, "f1": 1, "partial_f1": 1}}, "n_rows": 1, "tag": "t"}
    for name in ("m1/eval_a.json", "m1/eval_a.pre_fix.json", "m2/other.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body))
    got = readers.read_results(spark, str(tmp_path)).collect()
    assert [(r["model"], r["per_entity"]["CVC"]["support"]) for r in got] == [("m1", 2)]
    assert readers.read_if_there(spark, str(tmp_path / "none.json")) is None
    assert readers.read_if_there(spark, str(tmp_path / "m1/eval_a.json")).count() == 1


def test_label_file(tmp_path):
    (tmp_path / "l.yaml").write_text("# c\nlabels:\n  PERSON:   {kind: context}\n  CVC: {kind: format}  # x\nmap:\n  a: b\n")
    assert readers.read_labels(str(tmp_path / "l.yaml")) == {"PERSON": "context", "CVC": "format"}


def test_http_detector(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["texts"]
            out = json.dumps({"spans": [[{"start": 0, "end": len(t), "label": "CVC", "score": 1.0}] if t else [] for t in texts]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([("ab",), ("",)], "text string")
    got = df.select(readers.HttpDetector(f"http://127.0.0.1:{server.server_port}").spans(F.col("text")).alias("s")).collect()
    server.shutdown()
    assert [len(r["s"]) for r in got] == [1, 0]


def test_long_texts_reach_the_service_whole():
    """Parts overlap; spans come back in the whole text's places, once."""
    d = readers.HttpDetector("http://none", longest=50, overlap=10)
    text = "".join(f"{i:04d} " for i in range(60))
    parts = d.parts(text)
    assert all(len(p) <= 50 for _, p in parts) and {i for at, p in parts for i in range(at, at + len(p))} == set(range(len(text)))
    spans = lambda p: [{"start": m.start(), "end": m.end(), "label": "CVC", "score": 1.0} for m in re.finditer(r"(?<!\d)\d{4}(?= )", p)]
    got = d.joined([(at, spans(p)) for at, p in parts])
    assert [text[s["start"] : s["end"]] for s in got] == [f"{i:04d}" for i in range(60)]
    assert d.parts("") == [(0, "")] and d.parts("x" * 50) == [(0, "x" * 50)]


def test_order_is_by_file_and_place(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text("".join(f'{{"text": "b{i}"}}\n' for i in range(2000)))
    (tmp_path / "a.jsonl").write_text("".join(f'{{"text": "a{i}"}}\n' for i in range(30)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.with_order(spark.read.schema("text string").json([str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")]))
        assert [r["text"] for r in df.orderBy("ord").collect()] == [f"a{i}" for i in range(30)] + [f"b{i}" for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_leak_splits_and_errors(spark, tmp_path):
    train = spark.createDataFrame([("a",)], "text string")
    test = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, text string")
    paths = writers.write_leak_splits(leakage.marked(train, test).persist(), str(tmp_path), "t")
    assert [spark.read.schema("id string").json(p).count() for p in paths] == [1, 1, 1, 1]
    rows = spark.createDataFrame([("1", "ab", [(0, 1, "CVC", 1.0)], [])], "id string, text string, gold array<struct<start:int,end:int,label:string,score:double>>, spans array<struct<start:int,end:int,label:string,score:double>>")
    writers.write_errors(rows, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).first()["fn"][0]["span"] == "a"


def test_stream_masks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": 1, "text": "mail a@b.org"}\n{"id": 2, "text": "none"}\n')
    s = stream.masked_stream(stream.read_stream(spark, str(tmp_path / "in"), "id int, text string"))
    stream.write_stream(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "mail [EMAIL]", 2: "none"}


def test_stream_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"ts": "2024-01-01T00:00:10Z", "text": "a@b.org c@d.org"}\n{"ts": "2024-01-01T01:00:00Z", "text": "1.2.3.4"}\n')
    (tmp_path / "in2").mkdir()
    counts = stream.label_counts(stream.read_stream(spark, str(tmp_path / "in"), "ts timestamp, text string"), "ts")
    q = counts.writeStream.format("memory").queryName("label_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["label"], r["n"]) for r in spark.table("label_counts").collect()} == {("EMAIL", 2), ("IPADDRESS", 1)}


def test_token_bucket(spark, tmp_path):
    ok, tokens, last = stream.admitted([0.0, 0.0, 0.0, 30.0, 30.0], 2.0, None, 2.0)
    assert ok == [True, True, False, True, False] and last == 30.0 and tokens == pytest.approx(0)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("".join(f'{{"who": "{w}", "ts": "2024-01-01T00:00:00Z"}}\n' for w in "aaab"))
    s = stream.rate_limited(stream.read_stream(spark, str(tmp_path / "in"), "who string, ts timestamp"), "who", "ts", 2.0)
    stream.write_stream(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("key").agg(F.count_if("allowed").alias("n")).collect()
    assert {r["key"]: r["n"] for r in got} == {"a": 2, "b": 1}


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "x.txt").write_text("mail a@b.org")
    assert cli.main(["detect", "--file", str(tmp_path / "x.txt")]) == 0
    assert capsys.readouterr().out.split() == ["5", "12", "EMAIL", "1.0", "a@b.org"]
    assert cli.main(["mask", "--file", str(tmp_path / "x.txt"), "--json"]) == 0
    assert json.loads(capsys.readouterr().out) == {"text": "mail [EMAIL]", "summary": {"total": 1, "by_label": {"EMAIL": 1}, "sensitive": 0}}
    assert cli.main(["info"]) == 0


def test_read_masked(spark, tmp_path):
    spark.createDataFrame([(1, "010-1234-5678", "ko", "d", "n", '[{"label":"PHONE","value":"","start":0,"end":13}]')], "uid int, source_text string, language string, source_dataset string, augmentation_type string, privacy_mask string").write.parquet(str(tmp_path / "m"))
    assert dataset.unify_masked(readers.read_masked(spark, str(tmp_path / "m")), "train").first()["valid"] is True


def test_dataset_by_name(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1", "text": "a", "lang": "ko", "spans": []}\n{"id": "2", "text": "b", "lang": "en", "spans": []}\n')
    assert readers.read_dataset(spark, str(tmp_path), "x").count() == 2
    assert readers.read_dataset(spark, str(tmp_path) + "/", "x", "en").first()["id"] == "2"
