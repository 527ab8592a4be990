"""The field on real documents: secrets that no pattern finds, and clean documents that it leaves alone."""

import random

import pytest

from basaltql.llm import secret_scan

SF = "/root/testdata/sf0.01"
#: Contexts of which none stands among the planted phrases' keywords.
CONTEXTS = ("signing key {}", "AUTH_HEADER='{}'", "db_pass: \"{}\"", "conn {} ok", "otp seed = {}")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return secret_scan.fit(documents.where("doc_id % 4 <> 1"))


def test_hidden_secrets(spark, documents, model):
    rng, rows, places = random.Random(11), [], {}
    texts = [r.text for r in documents.where("doc_id % 4 = 1 and text <> ''").collect()]
    for i, text in enumerate(t for t in texts if not secret_scan.base_spans(t)):
        value = secret_scan.random_value(rng)
        value += "x9Q2" if len(value) < 12 else ""
        at = text.find(" ", len(text) // 2) + 1
        before, after = CONTEXTS[i % len(CONTEXTS)].split("{}")
        rows.append((i, text[:at] + before + value + after + " " + text[at:]))
        places[i] = (at + len(before), at + len(before) + len(value))
    held = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    found = sum(any(k == "crf" and a <= x and y - 1 <= b for k, a, b in held[i]) for i, (x, y) in places.items())
    wrong = sum(k == "crf" and (b <= places[i][0] or a >= places[i][1]) for i, spans in held.items() for k, a, b in spans)
    assert found >= 0.8 * len(rows) and wrong <= 0.01 * len(rows)


def test_clean_documents(documents, model):
    clean = {r.doc_id for r in documents.where("doc_id % 4 = 1").collect() if not secret_scan.base_spans(r.text or "")}
    hit = [r.doc_id for r in secret_scan.scan(documents, model).collect() if r.doc_id in clean and len(r.spans)]
    assert len(hit) <= 0.005 * len(clean)
