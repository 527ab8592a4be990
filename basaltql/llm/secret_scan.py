"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are runs of `[A-Za-z0-9+/_=.-]`. Each is tagged O (outside), B (a secret begins) or I (it goes on) from its shape,
the words and marks around it and features of the file. Tokens of under LEAST characters that follow no assignment mark
can only be O: the chain falls apart at them. Viterbi runs on what lies between where a tag other than O is possible at all:
a token's shape, the best that its surroundings could add and the best transitions bound its gain, which is exact.
The field is trained on a bounded sample of texts. Labels are the fixed patterns' spans and, in each sampled text, phrases
planted at random: random values of many shapes behind keywords that the patterns lack or behind none, as secrets, and ordinary
values behind the same words and others, as clean text. A token that looks random though no pattern covers it may be a secret
that the patterns miss, so its chain teaches nothing. Keyword features are dropped at random, so that shape alone can carry a
decision where no keyword stands."""

from __future__ import annotations

import json
import math
import random
import re
import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_tools import bounded_batches, keyed, read, slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "api")
LEAST = 8
TOKEN = re.compile(rf"""(?<![A-Za-z0-9+/_=.-])([A-Za-z0-9+/_=.-]{{{LEAST},}})|(?:[:=]|(?<==))\x20*["']?([A-Za-z0-9+/_=.-]+)""")
#: What may stand between two tokens of a chain.
BETWEEN = " \"'=:,;+\\"
#: Holds wherever base_spans finds something, in Spark's regular expressions.
BASE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"""
#: Training: at most so many texts that a fixed pattern matches and as many others; of one text so many chains with a label and so many others.
SAMPLE_EACH, SAMPLE_CHAINS, OTHER_CHAINS, EPOCHS, RATE = 750, 20, 8, 8, 0.3
#: A chain's tag counts only if the field is this sure of it.
SURE = 0.9
TAGS = 3  # O, B, I


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that are long enough, by kind and start; code points, end exclusive."""
    low = text.lower()
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if any(k in low for k in KEYWORDS) else []
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def shape(token: str) -> list[str]:
    n = len(token)
    digits, upper, lower = (sum(map(f, token)) for f in (str.isdigit, str.isupper, str.islower))
    counts = defaultdict(int)
    for c in token:
        counts[c] += 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    classes = [("U" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "s") for c in token]
    #: Random texts change between classes often; names and words joined to one don't.
    turns = sum(x != y for x, y in zip(classes, classes[1:], strict=False))
    kinds = ("d" if digits else "") + ("U" if upper else "") + ("l" if lower else "") + ("s" if digits + upper + lower < n else "")
    return [f"len{min(n // 8, 8)}", f"dig{round(5 * digits / n)}", f"kinds:{kinds}", f"ent{int(2 * entropy)}", f"{kinds}:{int(entropy)}", f"hex{all(c in '0123456789abcdef' for c in token)}", f"dots{min(token.count('.'), 3)}", f"turns{int(8 * turns / n)}", f"{kinds}:turns{int(5 * turns / n)}", f"head:{token[:4] if token[:4].isalpha() else '-'}"]


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that can be part of a secret."""
    return [m.span(m.lastindex) for m in TOKEN.finditer(text)]


def file_features(text: str, spans: list[tuple[int, int]]) -> list[str]:
    long = sum(1 for a, b in spans if b - a >= 16 and any(map(str.isdigit, text[a:b])))
    return [f"file{min(long, 4)}", f"size{min(len(text).bit_length() // 4, 5)}"]


def token_features(text: str, a: int, b: int, file: list[str]) -> list[str]:
    before, after = text[max(0, a - 24) : a], text[b : b + 12]
    words = re.findall(r"\w+", before)
    return ["bias", *shape(text[a:b]), *file, f"prev:{words[-1].lower()[:12] if words else '-'}", f"mark:{before[-1:]}", f"next:{after[:1]}", f"set{'=' in before[-4:] or ':' in before[-4:]}"]


def linked(text: str, a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether two neighbouring tokens are in one chain."""
    return not text[a[1] : b[0]].strip(BETWEEN)


def chains(text: str) -> list[tuple[list[tuple[int, int]], list[list[str]]]]:
    """Maximal runs of tokens that can be part of a secret: their spans and features."""
    spans = tokens(text)
    file = file_features(text, spans)
    out: list[tuple[list[tuple[int, int]], list[list[str]]]] = []
    for i, span in enumerate(spans):
        if not i or not linked(text, spans[i - 1], span):
            out.append(([], []))
        out[-1][0].append(span)
        out[-1][1].append(token_features(text, *span, file))
    return out


def _forward(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    a = [e[0] + np.array([0.0, 0.0, -1e9])]  # no chain begins inside
    for row in e[1:]:
        m = a[-1][:, None] + t
        top = m.max(0)
        a.append(row + top + np.log(np.exp(m - top).sum(0)))
    return np.array(a)


def marginals(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tag chances, transition chances) of a chain with emissions e and transitions t."""
    a, b = _forward(e, t), [np.zeros(TAGS)]
    for row in e[:0:-1]:
        m = t + (row + b[-1])[None]
        top = m.max(1)
        b.append(top + np.log(np.exp(m - top[:, None]).sum(1)))
    b = np.array(b[::-1])
    top = a[-1].max()
    z = top + np.log(np.exp(a[-1] - top).sum())
    pair = np.exp(a[:-1, :, None] + t[None] + (e[1:] + b[1:])[:, None, :] - z) if len(e) > 1 else np.zeros((0, TAGS, TAGS))
    return np.exp(a + b - z), pair


def viterbi(e: np.ndarray, t: np.ndarray) -> list[int]:
    score, back = e[0] + np.array([0.0, 0.0, -1e9]), []
    for row in e[1:]:
        m = score[:, None] + t
        back.append(m.argmax(0))
        score = row + m.max(0)
    tags = [int(score.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def train(examples: list[tuple[list[list[str]], list[int]]]) -> dict:
    """Stochastic gradient of the log-likelihood, with averaged weights. Forbidden: O then I."""
    rng = np.random.default_rng(3)
    names = {f: i for i, f in enumerate(sorted({f for fs, _ in examples for x in fs for f in x}))}
    w, t = np.zeros((len(names), TAGS)), np.zeros((TAGS, TAGS))
    t[0, 2] = -1e9
    mean_w, mean_t, k = np.zeros_like(w), np.zeros_like(t), 0
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(examples)).tolist():
            fs, tags = examples[i]
            ids = [[names[f] for f in x if rng.random() > (0.5 if f[:4] in ("prev", "mark", "next", "setT", "setF", "head") else 0.1)] for x in fs]
            e = np.array([w[x].sum(0) for x in ids])
            one, two = marginals(e, t)
            rate = RATE / (1 + epoch)
            for x, p, tag in zip(ids, one, tags, strict=True):
                g = -p
                g[tag] += 1
                w[x] += rate * g
            for (a, b), p in zip(zip(tags, tags[1:], strict=False), two, strict=True):
                g = -p
                g[a, b] += 1
                t += rate * g
            w *= 1 - 1e-5
            t[0, 2] = -1e9
        if epoch >= EPOCHS // 2:  # the first ones are still far off
            mean_w, mean_t, k = mean_w + w, mean_t + t, k + 1
    return {"names": names, "weights": mean_w / k, "transitions": mean_t / k}


def secret_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans without the keyword and mark of an assignment."""
    return [(k, ASSIGN.match(text, a).start(2) if k == "assign" else a, b) for k, a, b in base]


def _labels(spans: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[int]:
    """B for the first token over a fixed pattern's secret, I for its others."""
    tags, last = [], None
    for a, b in spans:
        hit = next(((s, e) for _, s, e in base if s < b and a < e), None)
        tags.append(0 if hit is None else 2 if hit == last else 1)
        last = hit
    return tags


#: Words and marks of planted phrases. Secrets stand behind KEYS, ordinary values behind KEYS and PLAIN.
KEYS = "pwd pass passphrase credential credentials auth authorization bearer login pin cert cookie access_key private_key client_secret session_key password secret token key".split()
PLAIN = "version name title date id number size count file path page author status result value code line user host address".split()
MARKS = (" = ", "=", ": ", ":", " ", " is ", ' = "', ": '", "='")
ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters, string.ascii_letters + string.digits + "_-")
#: Characters of a planted value, of the text around it that counts, and planted phrases of each kind in a sampled text.
SECRET_SIZE, AROUND, PLANTED = (10, 44), 160, 2


def random_value(rng: random.Random) -> str:
    alphabet = rng.choice(ALPHABETS)
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(*SECRET_SIZE)))


def ordinary_value(rng: random.Random, words: list[str]) -> str:
    """What stands behind a mark in clean text: words, joined words, numbers, dates, versions, names of files and hosts."""
    word = lambda: rng.choice(words)
    number = lambda n: str(rng.randrange(10**n))
    return rng.choice((
        word, word, lambda: rng.choice("-_./").join(word() for _ in range(rng.randint(2, 4))), lambda: word() + number(rng.randint(1, 4)), lambda: number(rng.randint(3, 12)),
        lambda: f"{rng.randint(1950, 2050)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(0, 20)}.{rng.randint(0, 40)}.{rng.randint(0, 9)}", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: f"{word()}_{number(2)}.{word()[:3]}", lambda: f"{word()}{number(1)}.{word()}.com", lambda: f"/{word()}/{word()}/{word()}.{word()[:3]}", lambda: word().capitalize() + word().capitalize() + word().capitalize(),
    ))()


def gap(text: str, at: int, step: int) -> int:
    """The place of a space from here on, forwards or backwards; where there is none nearby, here."""
    end = text.find(" ", at, at + AROUND) if step > 0 else text.rfind(" ", max(0, at - AROUND), at)
    return at if end < 0 else end


def planted(text: str, base: list[tuple[str, int, int]], rng: random.Random) -> list[tuple[list[list[str]], list[int]]]:
    """Examples of phrases put into the text: a secret, and an ordinary value, each in its chain."""
    file, out = file_features(text, tokens(text)), []
    for secret in [True, False] * PLANTED:
        at = gap(text, rng.randrange(len(text) + 1), 1)
        at = max([at, *(b for _, a, b in base if a < at < b)])
        left, right = text[gap(text, max(0, at - AROUND), 1) : at], text[at : gap(text, min(len(text), at + AROUND), -1)]
        #: A word of mixed case may be a secret's.
        words = [w for w in re.findall(r"[^\W\d_]+", left + right) if w[1:] == w[1:].lower()] or ["text"]
        value = random_value(rng) if secret else ordinary_value(rng, words)
        key = rng.choice(KEYS) if rng.random() < (0.8 if secret else 0.4) else rng.choice([*PLAIN, rng.choice(words)])
        mark = rng.choice(MARKS)
        before = left + f" {key}{mark}"
        around = before + value + mark[-1:].strip(" =:") + " " + right
        start, end = len(before), len(before) + len(value)
        spans = tokens(around)
        hit = next((i for i, (a, b) in enumerate(spans) if a < end and start < b), None)
        if hit is not None:
            first, last = hit, hit + 1
            while first and linked(around, spans[first - 1], spans[first]):
                first -= 1
            while last < len(spans) and linked(around, spans[last - 1], spans[last]):
                last += 1
            chain = spans[first:last]
            labels = _labels(chain, secret_parts(around, base_spans(around)) + [("planted", start, end)] * secret)
            if taught(around, chain, labels) and (secret or not labels[hit - first]):
                out.append(([token_features(around, *x, file) for x in chain], labels))
    return out


def looks_random(token: str) -> bool:
    """Letters and digits in turns, as names and numbers don't have them."""
    turns = sum(x.isdigit() != y.isdigit() for x, y in zip(token, token[1:], strict=False))
    return len(token) >= 12 and turns >= 4 and "." not in token


def taught(text: str, spans: list[tuple[int, int]], labels: list[int]) -> bool:
    """Whether no token outside the labelled ones looks random."""
    return not any(not tag and looks_random(text[a:b]) for (a, b), tag in zip(spans, labels, strict=True))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The examples of each text. A text that only looks as if a fixed pattern matched it (BASE) is left out."""
    for batch in slices(batches, "text", 1 << 20):
        out = []
        for at, text, maybe in zip(*(batch.column(c).to_pylist() for c in ("at", "text", "maybe")), strict=True):
            base = base_spans(text)
            if base or not maybe:
                parts = secret_parts(text, base)
                held = [(fs, labels) for spans, fs in chains(text) if taught(text, spans, labels := _labels(spans, parts))]
                some, others = ([x for x in held if any(x[1]) == labelled] for labelled in (True, False))
                #: The others are spread over the text.
                found = some[:SAMPLE_CHAINS] + others[:: -(-len(others) // OTHER_CHAINS) or 1]
                out.append((at, maybe, json.dumps(found + planted(text, base, random.Random(at)))))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.float64(), pa.bool_(), pa.string()))], ["at", "maybe", "examples"])


def fit(docs: DataFrame) -> dict | None:
    """Trains on at most SAMPLE_EACH texts with a fixed pattern's span and as many others, chosen from all rows by a hash of
    the text, and on phrases planted in them. None only if there is no text."""
    bounded_batches(docs.sparkSession)
    texts = keyed(docs).where("text <> ''").withColumn("maybe", F.col("text").rlike(BASE)).withColumn("at", F.pmod(F.xxhash64("text_hash"), F.lit(1 << 40)) / float(1 << 40))
    n = {r["maybe"]: r["count"] for r in texts.groupBy("maybe").count().collect()}
    rows: list = []
    for maybe in (True, False):
        #: A share of the hashes that holds enough rows; if few of them have a span or many are equal, four times as many, up to all.
        share, found = 1.2 * SAMPLE_EACH / max(n.get(maybe, 0), 1), []
        while n.get(maybe):
            some = texts.where((F.col("maybe") == maybe) & (F.col("at") < share)).select("at", "text", "maybe")
            found = some.mapInArrow(_examples, "at double, maybe boolean, examples string").orderBy("at", "examples").limit(SAMPLE_EACH).collect()
            if len(found) == SAMPLE_EACH or share >= 1:
                break
            share *= 4
        rows += found
    examples = [(fs, tags) for r in sorted(r["examples"] for r in rows) for fs, tags in json.loads(r)]
    return train(examples) if any(any(tags) for _, tags in examples) else None


class Field:
    """A trained model, with bounds of what a token's surroundings and the transitions can add to its gain over O."""

    def __init__(self, model: dict):
        self.names, self.weights, self.transitions = model["names"], model["weights"], model["transitions"]
        gains = self.weights[:, 1:].max(1) - self.weights[:, 0]
        best: dict[str, float] = {}
        for name, i in self.names.items():
            group = next((g for g in ("prev:", "mark:", "next:", "setT", "setF", "file", "size") if name.startswith(g)), None)
            if group:
                best[group[:3]] = max(best.get(group[:3], 0.0), gains[i])
        steps = self.transitions - self.transitions[0, 0]
        steps[0, 0] = 0
        #: Each token with a tag takes part in two transitions at most.
        self.most = sum(best.values()) + 2 * max(0.0, steps.max())
        self.held: dict[str, bool] = {}

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        return np.array([self.weights[[self.names[f] for f in x if f in self.names]].sum(0) for x in features])

    def possible(self, token: str) -> bool:
        """Whether any surroundings could give the token a tag other than O."""
        out = self.held.get(token)
        if out is None:
            e = self.emissions([["bias", *shape(token)]])[0]
            out = bool(max(e[1], e[2]) - e[0] + self.most >= -1e-6)
            if len(token) <= 64:
                if len(self.held) >= 200_000:
                    self.held.clear()
                self.held[token] = out
        return out

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Secrets by the field that no fixed pattern covers."""
        spans, out, file, end = tokens(text), [], None, 0
        for i, (a, b) in enumerate(spans):
            if i < end or not self.possible(text[a:b]):
                continue
            start, end = i, i + 1
            while start and linked(text, spans[start - 1], spans[start]):
                start -= 1
            while end < len(spans) and linked(text, spans[end - 1], spans[end]):
                end += 1
            file = file or file_features(text, spans)
            out += self.tagged(spans[start:end], [token_features(text, *x, file) for x in spans[start:end]], base)
        return out

    def tagged(self, spans: list[tuple[int, int]], features: list[list[str]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        e, out = self.emissions(features), []
        tags = viterbi(e, self.transitions)
        if any(tags):
            sure = 1 - marginals(e, self.transitions)[0][:, 0]
            for i, (a, b) in enumerate(spans):
                if tags[i] and sure[i] >= SURE and not any(s < b and a < x for _, s, x in base):
                    if tags[i] == 2 and out and out[-1][2] == spans[i - 1][1]:
                        out[-1] = ("crf", out[-1][1], b)
                    else:
                        out.append(("crf", a, b))
        return out


def _scanned(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(model) if model else None
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, "text", 1 << 20):
            found = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = field.added(text, base) if field and text else []
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in [*base, *more]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, kind)], ["doc_id", "text_hash", "spans"])

    return run


SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def scan(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, text_hash, spans), one row for each row of docs (doc_id, text and any others). A null text has no spans."""
    bounded_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(_scanned(model), f"doc_id long, text_hash long, spans {SPANS}")


def _redacted(model: dict | None, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(model) if model else None
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for text in batch.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    spans = sorted((a, b) for _, a, b in [*base, *(field.added(text, base) if field else [])])
                    parts, at = [], 0
                    for a, b in spans:
                        if b > at:
                            parts += [text[at:a], mark] if a >= at else []
                            at = b
                    text = "".join([*parts, text[at:]])
                out.append(text)
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))

    return run


def redact(docs: DataFrame, model: dict | None, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by mark; overlapping spans become one mark. Other columns stay."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_redacted(model, mark), docs.schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda rows: f"array_join(transform({rows}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    ranked = "array_sort(transform(spans, s -> named_struct('start', s.start, 'place', coalesce(nullif(array_position(array('assign', 'access', 'hex'), s.kind), 0), 4), 'end', s.end, 'kind', s.kind)))"
    rows = found.withColumn("ranked", F.expr(ranked))
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.expr(listed("filter(ranked, s -> s.place < 4)")), 256).alias("base_sha256"), F.expr(listed("ranked")).alias("spans"))
