"""Bounds of the driver and of time: training rows of repeated ids, redaction of very many spans."""

import random
import time

from fogline.llm import quality, secrets


def redacted(text, spans, mark):
    out, at = "", -1
    for s, _, e in spans:
        if s > at:
            out += text[max(at, 0) : s] + mark
        at = max(at, e)
    return out + text[max(at, 0) :]


def test_redaction_of_any_spans_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(80):
        text = "".join(rng.choice("abcé日 \n") for _ in range(rng.randrange(1, 120)))
        spans = sorted((s, rng.randrange(4), rng.randrange(s + 1, min(len(text), s + 12) + 1)) for s in (rng.randrange(len(text)) for _ in range(rng.randrange(0, 25))))
        rows.append((i, text, spans))
    rows.append((99, None, []))
    df = spark.createDataFrame(rows, "doc_id int, text string, all_spans array<struct<s:int,k:int,e:int>>")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(df, "[X]").collect()}
    assert got == {i: text if not spans else redacted(text, spans, "[X]") for i, text, spans in rows}


def test_redaction_takes_about_as_long_as_the_text(spark):
    def seconds(n):
        text = "password=hunter2 some words " * n
        spans = [(28 * i, 0, 28 * i + 16) for i in range(n)]
        df = spark.createDataFrame([(1, text, spans)], "doc_id int, text string, all_spans array<struct<s:int,k:int,e:int>>")
        began = time.time()
        assert secrets.redact(df).first()["text"] == "[SECRET] some words " * n
        return time.time() - began

    seconds(100)
    assert seconds(40_000) < 20


def test_training_rows_of_repeated_ids_stay_within_the_bound(spark, monkeypatch):
    seen = []
    plain = quality._matrix
    monkeypatch.setattr(quality, "_matrix", lambda rows: seen.append(rows.count()) or plain(rows))
    docs = spark.createDataFrame([(i % 2, ("good words of many kinds " if i % 2 else "zzz ### @@ ") * (i % 7 + 1)) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit_quality(docs, labels, train_rows=10) is not None
    assert seen == [20]


def test_training_rows_do_not_come_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("good words of many kinds " if i % 2 else "zzz ### @@ ") * (i % 7 + 1)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    came = []
    for name in ("collect", "toArrow", "toPandas"):
        plain = getattr(type(docs), name)
        monkeypatch.setattr(type(docs), name, lambda self, plain=plain: (came.append(plain(self)), came[-1])[1])
    model = quality.fit_quality(docs, labels, train_rows=100)
    # the numbers of labels by class, and the model
    assert sum(map(len, came)) == 3
    assert model.weights.shape == (2 * quality.BLOCK,) and model.weights.any()
