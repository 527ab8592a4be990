"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword. For each bit a logistic classifier over hashed byte 2- and 3-grams of the whole text is
trained on a bounded sample of labelled rows. Decoding weighs each bit's logistic loss by how well the bit's classifier
does on that language in training, and picks the codeword with the least loss; a close second makes a text ambiguous."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_tools import bounded_batches, keyed, read, slices
from .text_arrays import LOWER, raw

DIMENSIONS, LETTER = 4096, regex.compile(r"\p{L}")
#: Labelled rows to learn from: about SAMPLE_ROWS in all, at most SAMPLE_EACH of a language, chosen by a hash of the row.
SAMPLE_ROWS, SAMPLE_EACH, LEAST_EACH = 2000, 500, 4
#: Languages that the model is made for, as a parameter of fit.
MOST_LANGUAGES = 1000
STEPS, RATE, PENALTY = 200, 2.0, 1e-4
UNKNOWN, AMBIGUOUS_BELOW = "und", 0.5


def grams_of(texts: pa.Array) -> np.ndarray:
    """Shares of the hashed 2- and 3-grams of each text's bytes (A-Z as a-z): rows x DIMENSIONS."""
    data, offsets = raw(texts)
    data = LOWER[data].astype(np.uint32)
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    if len(data) < 3:
        two = three = np.zeros(0, np.int64)
    else:
        pair = data[:-1] << np.uint32(8) | data[1:]
        two = ((pair * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        triple = pair[:-1] << np.uint32(8) | data[2:]
        three = ((triple * np.uint32(2246822519) + np.uint32(374761393)) >> np.uint32(20)).astype(np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a >= 3:
            row = np.bincount(two[a : b - 1], minlength=DIMENSIONS) + np.bincount(three[a : b - 2], minlength=DIMENSIONS)
            out[i] = row / (2 * (b - a) - 3)
        elif b - a == 2 and len(data) >= 3:
            out[i, two[a]] = 1
    return out


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1. Up to five languages: every split of them; more: the most distant of many random codes."""
    if n <= 5:
        return np.array([[1 if (k >> i) & 1 else -1 for k in range(1, 1 << max(1, n - 1))] for i in range(n)], np.float32).reshape(n, -1)
    rng, bits = np.random.default_rng(7), max(15, int(10 * np.log2(n)))
    codes = [rng.choice(np.array([-1, 1], np.float32), (n, bits)) for _ in range(200)]
    return max(codes, key=lambda c: -(c @ c.T - 2 * bits * np.eye(n)).max())


def train(x: np.ndarray, labels: list[str]) -> dict:
    """The model: weights and offsets of the bits, languages, codewords, and each bit's weight for each language."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    code = codewords(len(languages))
    scale = 1 / np.sqrt(x.mean(0) + 1e-6)
    x = x * scale
    share = np.bincount(y, minlength=len(languages))
    each = (len(y) / (len(languages) * share))[y][:, None].astype(np.float32)
    target = code[y]
    w, b = np.zeros((DIMENSIONS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    last_w = w
    step = RATE / max(1e-6, float((x * x).sum(1).mean()))
    for k in range(STEPS):
        ahead = w + (w - last_w) * (k / (k + 3))
        miss = -target / (1 + np.exp(np.clip(target * (x @ ahead + b), -30, 30))) * each
        last_w, w = w, ahead - step * (x.T @ miss / len(y) + PENALTY * ahead)
        b = b - 0.1 * miss.mean(0)
    right = (np.sign(x @ w + b) == target).astype(np.float32)
    trust = np.stack([right[y == i].mean(0) for i in range(len(languages))]) + 1e-3
    return {"weights": w * scale[:, None], "offsets": b, "languages": languages, "code": code, "trust": trust / trust.sum(1, keepdims=True)}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best language's index, its score): a softmax of the loss-weighted distances to the codewords."""
    margin = x @ model["weights"] + model["offsets"]
    loss = np.log1p(np.exp(-np.clip(margin[:, None, :] * model["code"][None], -30, 30)))
    distance = (loss * model["trust"][None]).sum(2)
    close = np.exp(-4 * (distance - distance.min(1, keepdims=True)))
    best = distance.argmin(1)
    return best, close[np.arange(len(best)), best] / close.sum(1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 19):
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in grams_of(batch.column("text"))], pa.binary())], ["lang", "grams"])


def _predicted(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            texts = batch.column("text")
            known = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            if model is None or not batch.num_rows:
                pred, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                best, score = decode(model, grams_of(texts))
                pred = [model["languages"][i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, score, 0).astype(float)
            doubt = [k and bool(s < AMBIGUOUS_BELOW) for k, s in zip(known.tolist(), score.tolist(), strict=True)]
            keep = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(pred), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "ambiguous"])

    return run


def _accepted(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            texts = batch.column("text")
            known = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            score = decode(model, grams_of(texts))[1] if model else np.zeros(len(known))
            yield batch.filter(pa.array(known & (score >= AMBIGUOUS_BELOW)))

    return run


def accepted(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs without the rows that have no language or an ambiguous one; all columns stay. Without a model none has one."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_accepted(model), docs.schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def fit(labelled: DataFrame, most_languages: int = MOST_LANGUAGES) -> dict | None:
    """Learns from (doc_id, text, lang): about SAMPLE_ROWS rows, of each language a share fixed by its count in all rows, but
    LEAST_EACH rows of it (all, if fewer). More than most_languages languages are an error."""
    labelled = labelled.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(most_languages + 1).collect()}
    if not counts:
        return None
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages; raise most_languages to learn them all")
    each = max(LEAST_EACH, min(SAMPLE_EACH, SAMPLE_ROWS // len(counts)))
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, each / n)))
    sampled = labelled.withColumn("__at", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)).where(F.col("__at") < F.element_at(shares, F.col("lang")))
    #: Repeated rows share a hash, so the bound is kept by the order; sorted, the same table gives the same model.
    most = 2 * max(SAMPLE_ROWS, each * len(counts))
    rows = sorted(sampled.orderBy("__at", "lang").limit(most).select("lang", "text").mapInArrow(_features, "lang string, grams binary").collect())
    if not rows:
        return None
    return train(np.stack([np.frombuffer(r["grams"], np.float32) for r in rows]), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, text_hash, lang_pred, score, ambiguous), one row for each row of docs (doc_id, text and any others).

    A null text, or one without a letter, is `und` with score 0; so is every text without a model (no labels). Only the text
    counts. An empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(_predicted(model), "doc_id long, text_hash long, lang_pred string, score double, ambiguous boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    bounded_batches(spark)
    model = fit(docs.where(~fold(F.col("doc_id")).eqNullSafe(2)))
    out = identify(docs, model)
    return out.select("doc_id", fold(F.col("doc_id")).eqNullSafe(2).alias("held_out"), "lang_pred", "score", "ambiguous")
