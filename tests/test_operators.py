"""Operators against plain Python written for the tests alone."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactra.functions import labels as L
from redactra.functions import spans as S
from redactra.functions import validators as V
from redactra.operators import dataset, decode, leakage, reports, scoring, stress, synth
from redactra.operators import detect as D
from redactra.plans import queries

GOLD = dataset.GOLD


def tuples(spans):
    return [(s["start"], s["end"], s["label"]) for s in spans]


def pairs(n, seed=2):
    """Gold and found spans that touch, nest, repeat and swap labels."""
    r = random.Random(seed)

    def some():
        return [(a := r.randint(0, 12), a + r.randint(1, 5), r.choice(["PERSON", "PHONE", "CVC"]), 1.0) for _ in range(r.randint(0, 4))]

    return [(str(i), "x" * 20, g := some(), [*some(), *r.sample(g, r.randint(0, len(g)))]) for i in range(n)]


def test_scores(spark):
    rows = pairs(120)
    want = {k: dict.fromkeys(("tp", "fp", "fn", "ptp", "pfp", "pfn"), 0) for k in ("PERSON", "PHONE", "CVC")}
    for _, _, g, p in rows:
        a, b = {x[:3] for x in g}, {x[:3] for x in p}
        for name, some in (("tp", a & b), ("fp", b - a), ("fn", a - b)):
            for x in some:
                want[x[2]][name] += 1
        used = set()
        for x in g:
            hit = next((i for i, y in enumerate(p) if i not in used and y[2] == x[2] and y[0] < x[1] and y[1] > x[0]), None)
            want[x[2]]["pfn" if hit is None else "ptp"] += 1
            used |= {hit} - {None}
        for i, y in enumerate(p):
            if i not in used:
                want[y[2]]["pfp"] += 1
    df = spark.createDataFrame(rows, f"id string, text string, gold {S.SPANS}, spans {S.SPANS}")
    c = scoring.counts(df)
    assert {r["label"]: {k: r[k] for k in want["CVC"]} for r in c.collect()} == want
    total = {k: sum(v[k] for v in want.values()) for k in want["CVC"]}
    m = scoring.micro(c).first()
    assert m["p"] == total["tp"] / (total["tp"] + total["fp"]) and m["support"] == total["tp"] + total["fn"]
    per = scoring.per_label(c)
    assert scoring.restricted(per, ["PERSON", "PHONE", "CVC"]).first()["p"] == pytest.approx(m["p"])
    assert scoring.macro(per, 1).first()["labels"] == 3
    differ = sum({x[:3] for x in g} != {x[:3] for x in p} for _, _, g, p in rows)
    assert scoring.errors(df).count() == differ
    e = scoring.evaluate(df, "t", seconds=1.2).first()
    assert e["n_rows"] == 120 and e["ms_per_row"] == pytest.approx(10) and set(e["per_entity"]) == set(want)


def test_scores_of_nothing(spark):
    df = spark.createDataFrame([("1", "x", None, [])], f"id string, text string, gold {S.SPANS}, spans {S.SPANS}")
    assert scoring.micro(scoring.counts(df)).first().asDict() == {"p": 0.0, "r": 0.0, "f1": 0.0, "partial_f1": 0.0, "support": 0}


def test_tally(spark):
    df = spark.createDataFrame([([(0, 2, "CVC", 1.0), (5, 9, "CVC", 1.0), (11, 12, "PORT", 1.0)], [(0, 2, "CVC", 1.0), (6, 8, "CVC", 1.0), (14, 15, "PORT", 1.0)])], f"gold {S.SPANS}, spans {S.SPANS}")
    r = scoring.tally(df).first()
    assert (r["exact"], r["partial"], r["missed"], r["false_alarms"]) == (1, 1, 1, 1)


@pytest.mark.parametrize("n", [0, 1, 10, 509, 510, 511, 512, 513, 892, 893, 1200, 1617, 5000])
def test_windows_cover(spark, n):
    starts = decode.window_starts(n)
    body = [range(s, min(n, s + 510)) for s in starts]
    assert set().union(*body) == set(range(n)) if n else not body
    assert all(len(set(a) & set(b)) == 128 for a, b in zip(body, body[1:], strict=False))
    assert len(starts) == (1 + -(-max(0, n - 510) // 382) if n else 0)
    got = spark.range(1).select(decode.windows(F.slice(F.sequence(F.lit(0), F.lit(max(n, 1))), F.lit(1), F.lit(n))).alias("w")).first()["w"]
    assert [w["start"] for w in got] == starts and [len(w["tokens"]) for w in got] == [len(b) for b in body]


TAGS = L.tags(["PERSON", "PHONE"])


def brute_path(lp, move, first, last):
    import itertools

    best = max(itertools.product(range(lp.shape[1]), repeat=len(lp)), key=lambda p: first[p[0]] + lp[0, p[0]] + sum(move[a, b] + lp[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:], strict=False))) + last[p[-1]])
    return list(best)


def test_viterbi():
    r = np.random.default_rng(1)
    move, first, last = decode.transitions(TAGS)
    for n in (1, 2, 3, 4):
        for _ in range(5):
            lp = decode.log_softmax(r.normal(0, 2, (n, len(TAGS))).astype(np.float32))
            assert decode.viterbi(lp, move, first, last).tolist() == brute_path(lp, move, first, last)
    for n in (7, 512):
        path = [TAGS[i] for i in decode.viterbi(decode.log_softmax(r.normal(0, 3, (n, len(TAGS)))), move, first, last)]
        assert path[0][0] in "OBS" and path[-1][0] in "OES"
        for a, b in zip(path, path[1:], strict=False):
            assert (b[0] in "OBS") if a[0] in "OES" else (b[0] in "IE" and a[2:] == b[2:])
    assert decode.viterbi(np.zeros((5, len(TAGS))), move, first, last).tolist() == [0] * 5


def test_tag_spans():
    offsets = [(0, 0), (0, 2), (2, 4), (5, 6), (6, 8), (9, 9), (9, 12), (0, 0)]
    spans = lambda *t: [(s["start"], s["end"], s["label"], s["score"]) for s in decode.tag_spans(list(t), offsets, np.array([1, 0.5, 1, 1, 0.25, 1, 1, 1.0]), 0)]
    assert spans("O", "B-PERSON", "E-PERSON", "S-PHONE", "O", "O", "O", "O") == [(0, 4, "PERSON", 0.75), (5, 6, "PHONE", 1.0)]
    assert spans("O", "I-PERSON", "I-PHONE", "E-PHONE", "O", "O", "E-PERSON", "O") == [(0, 2, "PERSON", 0.5), (2, 6, "PHONE", 1.0), (9, 12, "PERSON", 1.0)]
    assert spans("O", "B-PERSON", "B-PERSON", "O", "I-PHONE", "O", "I-PHONE", "O") == [(0, 2, "PERSON", 0.5), (2, 4, "PERSON", 1.0), (6, 12, "PHONE", 0.625)]


def test_own_tags():
    tags = ["S-PHONE"] * 300
    kept = [sum(t != "O" for t in decode.own_tags(tags, w, 3)) for w in range(3)]
    assert kept == [300 - 64, 300 - 128, 300 - 64]
    assert decode.own_tags(["S-PHONE"], 0, 1) == ["S-PHONE"]


def test_finished(spark):
    text = "김철수는 서울 강남 010-1234-5678로 x"
    raw = [(0, 4, "PERSON", 0.9, 0), (5, 8, "ADDRESS", 0.8, 0), (8, 10, "ADDRESS", 0.6, 0), (11, 18, "PHONE", 0.5, 0), (15, 25, "PHONE", 0.7, 1), (20, 23, "CVC", 0.6, 1), (26, 27, "PORT", 0.11116, 1)]
    df = spark.createDataFrame([(text, raw)], f"text string, raw {decode.RAW}")
    got = df.select(decode.finished(F.col("text"), F.col("raw")).alias("s"), decode.finished(F.col("text"), F.col("raw"), ()).alias("t")).first()
    assert [(*tuples([s])[0], s["score"]) for s in got["s"]] == [(0, 3, "PERSON", 0.9), (5, 10, "ADDRESS", 0.6), (11, 24, "PHONE", 0.7), (26, 27, "PORT", 0.1112)]
    assert len(got["t"]) == 5


def test_model_detector(spark):
    def load():
        def tokenize(text):
            offsets, at = [], 0
            for w in text.split(" "):
                offsets.append((at, at + len(w)))
                at += len(w) + 1
            return [1 if text[s:e].isdigit() else 0 for s, e in offsets], offsets

        def score(some):
            out = [np.full((len(w), len(TAGS)), -5.0) for w in some]
            for m, w in zip(out, some, strict=True):
                m[:, 0] = 1
                for i, t in enumerate(w[1:-1], 1):
                    m[i, TAGS.index("S-PHONE")] = 9.0 if t == 1 else -5
            return out

        return tokenize, score, TAGS

    detector = decode.ModelDetector(load, max_length=12, stride=4)
    long = " ".join("12" if i % 3 == 0 else "ab" for i in range(60))
    df = spark.createDataFrame([("call 123 or 45 now",), ("",), (None,), (long,)], "text string")
    got = [r["spans"] for r in D.detect(df, detector).collect()]
    assert tuples(got[0]) == [(5, 8, "PHONE"), (12, 14, "PHONE")] and got[1] == [] and not got[2]
    assert tuples(got[3]) == [(i * 3, i * 3 + 2, "PHONE") for i in range(0, 60, 3)]
    both = D.UnionDetector(detector, D.RuleDetector())
    assert {s["label"] for s in D.detect(spark.createDataFrame([("12 a@b.org",)], "text string"), both).first()["spans"]} == {"PHONE", "EMAIL"}


def test_find_weights(tmp_path, monkeypatch):
    monkeypatch.delenv("REDACTRA_MODEL_DIR", raising=False)
    with pytest.raises(FileNotFoundError):
        decode.find_weights(str(tmp_path), places=())
    for f in ("model.int8.onnx", "tokenizer.json", "config.json"):
        (tmp_path / f).write_text("{}")
    monkeypatch.setenv("REDACTRA_MODEL_DIR", str(tmp_path))
    assert decode.find_weights(places=()) == str(tmp_path)


def test_service_spans(spark):
    df = spark.createDataFrame([("김철수는 a", [("Person", None, 0, 4, 0.8), ("Other", "Date", 5, 1, None), ("Zzz", "Zzz", 0, 1, 1.0)])], "text string, e array<struct<category:string,subcategory:string,offset:int,length:int,confidenceScore:double>>")
    got = df.select(decode.service_spans(F.col("e"), F.col("text")).alias("s")).first()["s"]
    assert [(*tuples([s])[0], s["score"]) for s in got] == [(0, 3, "PERSON", 0.8), (5, 6, "DATE", 1.0)]


def test_unify(spark):
    masks = json.dumps([{"label": "PHONE", "value": "010", "start": 3, "end": 6}, {"label": "EMAIL", "value": "a@b.org", "start": 7, "end": 14}])
    cols = "uid int, source_text string, language string, source_dataset string, augmentation_type string, privacy_mask string"
    df = spark.createDataFrame([(1, "tel010 a@b.org", "ko", "d", "none", masks)], cols)
    r = dataset.unify_masked(df, "train").first()
    assert (r["id"], r["source"], r["valid"], r["bad"]) == ("bc-train-1", "bccard/d", False, ["PHONE"]) and tuples(r["spans"]) == [(3, 6, "PHONE"), (7, 14, "EMAIL")]
    as_array = df.withColumn("privacy_mask", dataset.mask_array(df))
    assert dataset.unify_masked(as_array, "train").first() == r
    with pytest.raises(Exception, match="unknown label"):
        dataset.unify_masked(df.withColumn("privacy_mask", F.lit('[{"label":"NOPE","value":"","start":0,"end":1}]')), "train").collect()


def test_sentences_and_dialogues(spark):
    rows = [(0, "국민 110-22 3333입니다 김철수", "d_1_0", [("PS_NAME", "김철수", 18, 21), ("QT_ACCOUNT_NUMBER", "국민 110-22 3333", 0, 14), ("QT_AGE", "x", 0, 1)]), (1, "네", "e_1_0", []), (2, "김철수", "d_1_1", [("PS_NAME", "김철수", 0, 3)]), (3, "\n", "d_1_2", None)]
    df = spark.createDataFrame(rows, "ord int, sentence string, sent_idx string, PII_set array<struct<label:string,form:string,begin:int,end:int>>")
    s = dataset.unify_sentences(df, "test")
    by = {r["id"]: r for r in s.collect()}
    assert tuples(by["kd-test-d_1_0"]["spans"]) == [(3, 14, "ACCOUNT_NUMBER"), (18, 21, "PERSON")]
    ordered = s.join(df.select("ord", F.concat(F.lit("kd-test-"), "sent_idx").alias("id")), "id")
    d = {r["id"]: r for r in dataset.dialogues(ordered, "test", "ord").collect()}
    assert set(d) == {"kd-test-dlg-d", "kd-test-dlg-e"}
    whole = d["kd-test-dlg-d"]
    assert whole["text"] == rows[0][1] + "\n김철수" and [whole["text"][a:b] for a, b, _ in tuples(whole["spans"])] == ["110-22 3333", "김철수", "김철수"]
    assert dataset.integrity_violations(s).first()[0] == 0


def unified(spark, rows):
    return spark.createDataFrame([(i, t, "ko", src, "none", sp, v, []) for i, t, src, sp, v in rows], dataset.UNIFIED)


def test_assemble_and_reports(spark):
    r = random.Random(4)
    text = lambda: "".join(r.choices("가나다라마바사아", k=60))
    test = text()
    masked = unified(spark, [("m1", test, "bccard/a", [], True), ("m2", text(), "bccard/b", [(0, 2, "PERSON")], False)])
    sentences = unified(spark, [("s1", test[:40], "kdpii", [], True), ("s2", text(), "kdpii", [(0, 2, "PHONE")], True), ("s3", test[:14] + text(), "kdpii", [], True)])
    synthetic = unified(spark, [("y1", "short", "synth/x", [(0, 2, "PHONE")], None)])
    tests = unified(spark, [("t1", test, "kdpii", [], True)])
    ids = lambda clean: {x["id"] for x in dataset.assemble(masked, sentences, synthetic, tests, clean).collect()}
    assert ids(True) == {"m1", "s2", "s3", "y1"} and ids(False) == {"m1", "m2", "s2", "s3", "y1"}
    full = dataset.assemble(masked, sentences, synthetic, tests, False)
    assert {x["source"]: x["rows"] for x in dataset.by_source(full).collect()} == {"bccard": 2, "kdpii": 2, "synth": 1}
    assert dataset.rarest_label(full).first()["label"] == "PERSON"
    s = dataset.summary(full).first()
    assert (s["rows"], s["valid"], s["spans"], s["labels"]) == (5, 4, 3, 2)


def test_audit(spark):
    rows = unified(spark, [(str(i), "12 a@b.org" if i < 5 else "123 x", "s", [(0, 2 if i < 5 else 3, "CVC")], True) for i in range(6)])
    r = dataset.audit(rows).first()
    assert (r["total"], r["failed"], r["examples"]) == (6, 5, ["12", "12", "12"])
    assert dataset.audit_rows(rows).first()["bad_rows"] == 0


def test_first_wins_split_and_weights(spark):
    df = spark.createDataFrame([(3, "a  b"), (1, "a b "), (2, "c")], "ord int, text string")
    assert dataset.first_wins(df, "ord").columns == df.columns
    assert {r["ord"] for r in dataset.first_wins(df, "ord").collect()} == {1, 2}
    many = spark.range(300).select(F.concat(F.lit("template "), F.col("id").cast("string")).alias("text"))
    train, held = dataset.split_templates(many)
    assert train.count() + held.count() == 300 and 10 < held.count() < 60
    assert dataset.weighted(df, 3).count() == 9 and dataset.weighted(df, 0).count() == 0
    rows = df.withColumn("id", F.col("ord").cast("string"))
    assert dataset.shuffled(rows, 1).collect() == dataset.shuffled(rows.repartition(3), 1).collect()
    assert dataset.shuffled(rows, 1, 2).count() == 2


def test_bioes(spark):
    df = spark.createDataFrame([([(0, 0), (0, 2), (2, 4), (5, 6), (7, 9), (0, 0)], [(1, 6, "PERSON"), (7, 8, "CVC")])], f"o array<struct<start:int,end:int>>, s {GOLD}")
    assert df.select(dataset.bioes(F.col("o"), F.col("s"))).first()[0] == [None, "B-PERSON", "I-PERSON", "E-PERSON", "S-CVC", None]


def test_leakage(spark):
    train = spark.createDataFrame([("Ａ b 12",), ("x",), (None,)], "text string")
    test = spark.createDataFrame([(1, "Ａ b 12"), (2, "a B12"), (3, "ab 99"), (4, "other"), (5, None)], "id int, text string")
    rows = leakage.marked(train, test)
    got = {r["id"]: (r["leak_exact"], r["leak_norm"], r["leak_masked"]) for r in rows.collect()}
    assert got == {1: (True, True, True), 2: (False, True, True), 3: (False, False, True), 4: (False, False, False), 5: (False, False, False)}
    assert {r["level"]: (r["n"], r["percent"]) for r in leakage.counts(rows).collect()} == {"exact": (1, 20.0), "norm": (2, 40.0), "masked": (3, 60.0)}
    assert {k: v.count() for k, v in leakage.splits(rows).items()} == {"dedup": 4, "dupsonly": 1, "maskdedup": 2, "maskdupsonly": 3}


def test_leakage_stays_in_the_jvm(spark):
    """No batch of whole texts goes to Python, and only the keys asked for are computed."""
    df = spark.createDataFrame([("ﬁ ｂ",)], "text string")
    for levels in ("exact",), ("norm",), leakage.LEVELS:
        plan = leakage.marked(df, df, levels=levels)._jdf.queryExecution().optimizedPlan().toString()
        assert "nfkc(" not in plan and "Python" not in plan
        assert leakage.keyed(df, levels=levels).select("keys.*").columns == list(levels)


@pytest.mark.parametrize("variant", list(stress.VARIANTS))
def test_perturb(spark, variant):
    import re

    rules = {"sep_dot": lambda v: v.replace("-", "."), "sep_space": lambda v: v.replace("-", " "), "sep_none": lambda v: v.replace("-", ""), "fullwidth": lambda v: v.translate({48 + i: 0xFF10 + i for i in range(10)}), "spaced": " ".join, "nospace": lambda v: re.sub(r"\s+", "", v)}
    text = "이름 홍 길동, 010-1234-5678 그리고 😀-1"
    rows = unified(spark, [("a", text, "s", [(9, 22, "PHONE"), (3, 7, "PERSON")], True), ("b", "xy", "s", [(0, 1, "CVC")], True), ("c", "x-y z", "s", [(0, 3, "CVC"), (2, 5, "CVC")], True), ("d", "x", "s", [], True)])
    out = {r["id"]: r for r in stress.perturb(rows, variant).collect()}
    assert set(out) == {"a"}
    r = out["a"]
    assert [(r["text"][s:e], label) for s, e, label in tuples(r["spans"])] == [(rules[variant](text[3:7]), "PERSON"), (rules[variant](text[9:22]), "PHONE")]
    assert r["text"].endswith("그리고 😀-1") and r["aug"] == "stress"
    assert stress.base_of(rows, stress.perturb(rows, variant)).count() == 1


def test_long_documents(spark):
    r = random.Random(6)
    rows = [(i, "".join(r.choices("가 나.", k=r.randint(1, 30))), [(0, 1, "CVC")] if r.random() < 0.5 else []) for i in range(60)]
    docs, buf, spans, off = [], [], [], 0
    for _, t, sp in rows:
        spans += [(s + off, e + off, label) for s, e, label in sp]
        buf.append(t)
        off += len(t) + 1
        if off >= 100:
            docs.append(("\n".join(buf), spans))
            buf, spans, off = [], [], 0
    if spans:
        docs.append(("\n".join(buf), spans))
    df = spark.createDataFrame(rows, f"ord int, text string, spans {GOLD}").repartition(3)
    got = stress.long_documents(df, "ord", 100).collect()
    assert [(x["text"], tuples(x["spans"])) for x in sorted(got, key=lambda x: int(x["id"][5:]))] == docs


@pytest.mark.parametrize(("target", "longest"), [(100, 30), (7, 30), (100_000, 30), (40, 0)])
def test_long_documents_over_chunks(spark, target, longest):
    """One stream in many chunks is as one pass over all rows."""
    r = random.Random(target)
    rows = [(i, "".join(r.choices("ab 나", k=r.randint(0, longest))), [(0, 1, "CVC")] if r.random() < 0.3 else []) for i in range(500)]
    docs, buf, spans, off = [], [], [], 0
    for _, t, sp in rows:
        spans += [(s + off, e + off, label) for s, e, label in sp]
        buf.append(t)
        off += len(t) + 1
        if off >= target:
            docs.append(("\n".join(buf), spans))
            buf, spans, off = [], [], 0
    if spans:
        docs.append(("\n".join(buf), spans))
    df = spark.createDataFrame(rows, f"ord int, text string, spans {GOLD}").repartition(5)
    got = stress.long_documents(df, "ord", target).collect()
    assert [(x["text"], tuples(x["spans"])) for x in sorted(got, key=lambda x: int(x["id"][5:]))] == docs


def test_longdoc_query_packs_across_conversations(spark, sf_dir):
    from redactra.plans import queries as q

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).collect()
    want, n, k, spans = {}, 0, 0, 0
    for x in sorted(rows, key=lambda x: (x["conv_id"], x["turn"], x["text"])):
        spans += bool(x["text"])
        n += len(x["text"]) + 1
        if n >= 1800:
            want[f"long-{k}"], n, k, spans = (n - 1, spans), 0, k + 1, 0
    if spans:
        want[f"long-{k}"] = n - 1, spans
    assert {x["id"]: (x["n"], x["n_spans"]) for x in q.longdoc_pack(spark, sf_dir).collect()} == want


def test_occurrences(spark):
    df = spark.createDataFrame([("abababa",), ("",)], "text string")
    assert [tuples(x[0]) for x in df.select(stress.occurrences(F.col("text"), "aba", "CVC")).collect()] == [[(0, 3, "CVC"), (2, 5, "CVC"), (4, 7, "CVC")], []]


@pytest.mark.parametrize("label", L.LABELS)
def test_generated_values_are_valid(spark, label):
    bad = synth.generated(spark, label, 100).filter(~V.check(F.col("label"), F.col("value"), F.lit("ko")))
    assert bad.collect() == []


def test_fill(spark):
    t = spark.createDataFrame([("a", "g", "이름 {PERSON} 번호 {PHONE}. 다시 {PERSON}! 끝."), ("b", "g", "{NOPE} x")], "template_id string, genre string, text string")
    rows = synth.fill(t, 30, 1).orderBy("id").collect()
    assert len(rows) == 30 and rows == synth.fill(t.repartition(2), 30, 1).orderBy("id").collect()
    for r in rows:
        assert [s["label"] for s in r["spans"]] == ["PERSON", "PHONE", "PERSON"]
        assert all(r["text"][s["start"] : s["end"]].strip() for s in r["spans"])
        # What stands before a span is the template's, or what may stand around a value.
        assert "이름 " in r["text"][: r["spans"][0]["start"]]
    filled = synth.fill(t, 30, 1)
    long = synth.long_rows(filled, 5).collect()
    values = {r["text"][s["start"] : s["end"]] for r in rows for s in r["spans"]}
    assert len(long) == 5
    for r in long:
        assert len(r["spans"]) in (6, 9, 12) and all(r["text"][s["start"] : s["end"]] in values for s in r["spans"])
    assert synth.negative_rows(spark, 5).filter(F.size("spans") == 0).count() == 5


@pytest.mark.parametrize("label", list(D.RULES))
def test_one_hint_for_all_rules(label):
    """A text that a rule matches has the hint and the rule's gate."""
    import regex
    from hypothesis import given, settings
    from hypothesis import strategies as st

    hint, own, rule = (regex.compile(p) for p in (D.HINT, D.gate(label), D.RULES[label]))

    @given(st.from_regex(D.RULES[label].replace("(?<=:)", ":")))
    @settings(max_examples=200, deadline=None)
    def run(text):
        if rule.search(text):
            assert hint.search(text) and own.search(text)

    run()


def test_forms_are_many_and_as_written():
    for label, forms in synth.FORMS.items():
        seen = {synth.Values(synth.chance(label, k)).value(label) for k in range(60)}
        assert len(seen) > (9 if label != "CVC" else 5), label
        assert not any(c in v for v in seen for c in "#{}<>"), label
    v = synth.Values(synth.chance(0))
    assert set(v.form("{07-07} [b-b] #")) <= set("07 b123456789") and synth.luhn_digit("7992739871") == "3"


def test_templates(spark):
    df = spark.createDataFrame([("담당자: 이몽룡님 a@b.org 010-1234-5678 2024년 3월 5일 http://x.kr 1.2.3.4 홍길동",)], "text string")
    assert df.select(synth.auto_placeholder(F.col("text"))).first()[0] == "담당자: {PERSON} {EMAIL} {PHONE} {DATE} {URL} {IPADDRESS} {PERSON}"
    raw = spark.createDataFrame([('ok [{"text": " {PERSON} 님 "}, {"text": "none"}, {"text": "{NOPE}"}] end',), ("nothing",), ("[broken",)], "raw string")
    assert [r["text"] for r in synth.parsed_templates(raw).collect()] == ["{PERSON} 님"]


def test_both_spans_equal_each(spark):
    """A text with cards that pass and fail their checksum, and others that compete with them."""
    rows = [("card 4111 1111 1111 1111, 4111 1111 1111 1112; a@b.org 1.2.3.4",), ("010-1234-5678 1234 5678 1234 5678 900101-1234567",), ("none",), ("",), (None,)]
    df = spark.createDataFrame(rows, "text string")
    for rules in (None, ["EMAIL", "CARD_NUMBER"]):
        got = D.both_spans(df, "c", "u", rules).withColumns({"own_c": D.rule_spans(F.col("text"), True, rules), "own_u": D.rule_spans(F.col("text"), False, rules)}).collect()
        assert all(r["c"] == r["own_c"] and r["u"] == r["own_u"] for r in got) and any(r["c"] != r["u"] for r in got)


def test_evaluation_by_group(spark):
    rows = [(str(i % 2), *x) for i, x in enumerate(pairs(60))] + [("bare", "x", "x", None, [])]
    df = spark.createDataFrame(rows, f"model string, id string, text string, gold {S.SPANS}, spans {S.SPANS}")
    got = {r["model"]: r.asDict() for r in scoring.evaluate(df, "t", seconds=1.0, by=["model"]).collect()}
    assert set(got) == {"0", "1", "bare"} and got["bare"]["n_rows"] == 1 and got["bare"]["per_entity"] == {}
    for model, r in got.items():
        assert r == {"model": model, **scoring.evaluate(df.filter(F.col("model") == model), "t", seconds=1.0).first().asDict()}
    none = scoring.evaluate(df.limit(0), "t").first()
    assert (none["n_rows"], none["per_entity"], none["micro"]["support"]) == (0, {}, 0)


@pytest.mark.parametrize("name", ["pivot_report", "topk_drops", "score_evaluate"])
def test_reports_read_texts_once(spark, sf_dir, name):
    """One scan of the documents and one pass of each rule's pattern, for all models, figures and columns."""
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 1 and all(f"(?U){D.RULES[x]}, 0)" in plan for x in queries.LIVE)
    assert plan.count("regexp_extract_all(") == len(queries.LIVE)


def test_comparison_and_drops_run_nothing_and_keep_doubles(spark):
    """Labels beyond the schema count as a run; a label that two runs of a model have gives all their differences."""
    rows = [("a", "d", "PERSON", 5, 0.9), ("a", "d", "CVC", 0, None), ("b", "d", "OTHER", 1, 0.5), ("a", "e", "PORT", 1, 1.0), ("b", "d", "CVC", 4, 0.2), ("c", "d", "CVC", 4, 0.1), ("c", "d", "CVC", 4, 0.0), ("c", "d", "CVC", 4, None)]
    failing = F.raise_error(F.lit("run")).cast("string")
    labels = spark.createDataFrame(rows, "model string, dataset string, label string, support long, f1 double")
    assert reports.comparison(labels.withColumn("model", failing), "d", ["b", "a", "z"]).columns == ["label", "support", "b", "a", "z"]
    t = {r["label"]: tuple(r)[1:] for r in reports.comparison(labels, "d", ["b", "a", "z"]).collect()}
    assert t["PERSON"] == (5, 0.0, 0.9, None) and t["CVC"] == (4, 0.2, 0.0, None) and t["PORT"] == (0, None, None, None) and len(t) == 32
    assert sorted(round(r["delta"]) for r in reports.drops(labels, "d", "b", "c", "f1").collect()) == [-20, -10]


def result(spark, model, ds, tag, f1, per):
    row = ((f1, f1, f1, f1, None), {k: (n, v, v, v, v) for k, (n, v) in per.items()}, 10, 1.0, 100.0, tag, model, ds)
    return spark.createDataFrame([row], reports.RESULT)


def test_reports(spark):
    every = result(spark, "a", "d", "stress_x", 0.8, {"PERSON": (5, 0.9), "CVC": (2, 0.5)})
    for x in (("b", "d", "stress_x_base", 0.9, {"PERSON": (5, 0.8)}), ("c", "e", "longdoc_800", 0.7, {"PORT": (1, 1.0)}), ("c", "e", "longdoc_1200", 0.6, {}), ("c", "e", "longdoc_800_fixed", 0.6, {})):
        every = every.unionByName(result(spark, *x))
    labels = reports.by_label(reports.supported(every))
    t = {r["label"]: r for r in reports.comparison(labels, "d", ["a", "b", "z"]).collect()}
    assert len(t) == 32 and (t["PERSON"]["support"], t["PERSON"]["a"], t["PERSON"]["b"], t["PERSON"]["z"]) == (5, 0.9, 0.8, None)
    assert (t["CVC"]["a"], t["CVC"]["b"], t["PORT"]["a"]) == (0.5, 0.0, None)
    assert reports.without_support(reports.comparison(labels, "d", ["a", "b"])).count() == 30
    assert [(r["label"], round(r["delta"])) for r in reports.drops(labels, "d", "a", "b").collect()] == [("PERSON", -10)]
    v = reports.variant_deltas(reports.supported(every)).first()
    assert (v["variant"], round(v["delta"]), v["support"]) == ("x", -10, 7)
    assert [r["length"] for r in reports.by_length(every).collect()] == [800, 1200]
    assert reports.ranking(every).count() == 5
    assert reports.markdown(reports.by_length(every)).splitlines()[2] == "| 800 | 10 | 0.700 | 0.700 | 0.700 |"
    assert "<th>length</th>" in reports.html_table(reports.by_length(every), "t")
    sizes = spark.createDataFrame([("x", 0.9, 200.0), ("y", 0.8, 150.0), ("z", 0.8, 140.0)], "name string, f1 double, size_mb double")
    assert reports.best_variant(sizes).first()["name"] == "z"
    assert decode.best_bias(spark.createDataFrame([(0.5, 0.8), (0.0, 0.8)], "o_bias double, f1 double")).first()["o_bias"] == 0.0


def test_limits(spark):
    df = spark.createDataFrame([("b", "x" * 10), ("b", "y" * 10), ("c", None)], "batch string, text string")
    assert D.limits(df, longest=10, most=20, batch_col="batch").count() == 3
    with pytest.raises(Exception, match="too long"):
        D.limits(df, longest=9).collect()
    with pytest.raises(Exception, match="batch too long"):
        D.limits(df, most=15, batch_col="batch").collect()


SCENARIOS = [
    ("particles", "김민수님이 2024년 3월 15일에 010-9876-5432로 전화, hong.gd@example.com으로 답. 김민수", [("김민수", "PERSON"), ("2024년 3월 15일", "DATE"), ("010-9876-5432", "PHONE"), ("hong.gd@example.com", "EMAIL")], {"EMAIL"}),
    ("card", "카드 5432-1234-5678-9012 로 결제, 주민등록번호 900101-1234567 입니다", [("5432-1234-5678-9012", "CARD_NUMBER")], {"CARD_NUMBER"}),
    ("numbers only", "결제 금액 1,250,000원, 수량 3개, 펌웨어 v12.4.1, 온도 36.5도", [], set()),
    ("times", "오전 9시 회의, 처리 시간은 2시간 30분, 2024년형 신제품", [], set()),
]


def test_scenarios(spark):
    df = spark.createDataFrame([s[:3] for s in SCENARIOS], "id string, text string, needles array<struct<value:string,label:string>>")
    out = {r["id"]: r for r in D.detect(stress.scenarios(df)).collect()}
    for name, text, needles, labels in SCENARIOS:
        r = out[name]
        want = sorted((i, i + len(v), label) for v, label in needles for i in range(len(text)) if text.startswith(v, i))
        assert tuples(r["gold"]) == want
        assert {s["label"] for s in r["spans"]} == labels
    for bad, why in (([("없음", "CVC")], "no such text"), ([("abc", "CVC"), ("bc", "PORT")], "overlap")):
        one = spark.createDataFrame([("x", "abcd", bad)], df.schema)
        with pytest.raises(Exception, match=why):
            stress.scenarios(one).collect()


def test_report_page_and_manifest(spark):
    every = result(spark, "a", "d", "t", 0.8, {}).unionByName(result(spark, "b", "d", "t_dedup", 0.9, {})).unionByName(result(spark, "b", "e", "x", 0.5, {}))
    manifest = spark.createDataFrame([("dedup", "t_dedup", "t"), ("gone", "none", "t")], "name string, tag string, base_tag string")
    got = {r["name"]: r for r in reports.against(every, manifest).collect()}
    assert round(got["dedup"]["delta"]) == 10 and got["gone"]["f1"] is None and got["gone"]["base_f1"] == 0.8
    page = reports.html_report(every, spark.createDataFrame([("d", 2.5)], "dataset string, percent double"))
    assert page.index("d (2.50 % in training)") < page.index("<td>b</td>") < page.index("<td>a</td>") < page.index("<h2>e</h2>")
    assert "<td>a</td>" not in reports.html_report(every, final=["b"])
