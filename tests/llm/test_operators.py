"""Each operator against brute force on small tables with nulls, empty and very long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basaltql.llm import bpe, language_id, line_dedup, near_dedup, packing, pii, quality_rules, secret_scan, substring_dedup, topk_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, node int, spans int, words string, `__lines` int"


def texts() -> dict:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abehinorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    out = {i: "\n".join(prose(rng.randint(1, 40)) for _ in range(rng.randint(1, 8))) for i in range(40)}
    base = prose(200)
    for i in range(40, 60):  # near copies
        words = base.split()
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out[i] = " ".join(words)
    out |= {60 + i: out[3] for i in range(5)}  # copies
    out |= {70: None, 71: "", 72: " \n\t ", 73: "one", 74: "One", 75: "9" * 5000, 76: "a" * 60000, 77: prose(6000), 78: out[5] + "\n" + out[6], 79: "é ß 漢字 😀\n" * 30}
    line = "this license line stands in many documents of the corpus for sure"
    for i in range(80, 90):
        out[i] = prose(30) + "\n" + (line if i % 2 else line.replace("many", "several")) + "\n" + prose(30)
    return out


@pytest.fixture(scope="module")
def held():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, held):
    rows = [(i, t, "en", "src", len(t or ""), "x", 1, 2, "y", 3) for i, t in held.items()]
    rows += [r for r in rows if r[0] in (3, 70)] + [(None, "a text without an id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert substring_dedup.substring_dedup(nothing).count() == 0
    assert line_dedup.line_dedup(nothing).count() == 0
    assert packing.pack_documents(nothing).count() == 0
    assert bpe.encode_and_decode(nothing).count() == 0
    assert pii.find_pii(nothing).count() == 0
    assert quality_rules.measure(nothing).count() == 0
    assert language_id.identify(nothing, language_id.fit(nothing)).count() == 0
    assert secret_scan.scan(nothing, secret_scan.fit(nothing)).count() == 0


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, held):
    sets = {i: shingles(t) for i, t in held.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(held) + 3
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id)


def test_sketches_merge(held):
    import pyarrow as pa

    values, bounds = near_dedup.shingle_sets(pa.array([held[40], held[1]]))
    a, b = near_dedup.set_sketch(values, bounds)
    union = np.unique(values)
    assert (near_dedup.merged(a, b) == near_dedup.set_sketch(union, np.array([0, len(union)]))[0]).all()


def test_substrings(docs, held):
    seen, expected = set(), {}
    for i in sorted(held):
        w = WORD.findall(held[i] or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        expected[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    for r in substring_dedup.substring_dedup(docs).collect():
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_text) == expected[r.doc_id]


def test_lines(docs, held):
    first, places = {}, []
    for i in sorted(held):
        for k, part in enumerate((held[i] or "").split("\n")):
            w = tuple(WORD.findall(part))
            if len(w) >= 3:
                first.setdefault(w, (i, k))
                places.append((i, k, w))
    near = {w for w in first if len(w) >= 8 and any(len(v) >= 8 and first[v] < first[w] and line_dedup.within_one_edit(list(v), list(w)) for v in first)}
    gone = defaultdict(set)
    for i, k, w in places:
        if first[w] != (i, k) or w in near:
            gone[i].add(k)
    assert near
    for r in line_dedup.line_dedup(docs).collect():
        if r.doc_id is not None:
            t = held[r.doc_id]
            kept = t if t is None or not gone[r.doc_id] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[r.doc_id])
            assert r.kept_text == kept and r.n_removed == len(gone[r.doc_id])


def test_packing(docs, held):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in held.items()}
    rows = [r for r in packing.pack_documents(docs).collect()]
    sequences = defaultdict(list)
    for r in rows:
        if r.doc_id is not None:
            assert bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(ids[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
    covered = Counter()
    for r in rows:
        covered[r.doc_id] += r.length
    assert all(covered[i] == len(x) * (2 if i in (3, 70) else 1) for i, x in ids.items())
    full = 0
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 2048
        full += sum(n for _, n in pieces) == 2048
    assert full >= len(sequences) - 3


def test_tournament_tree_is_first_fit():
    sizes = [random.Random(2).randint(1, 2047) for _ in range(300)]
    tree, bins = packing.TournamentTree(len(sizes), 2048), []
    for n in sorted(sizes, reverse=True):
        b = tree.first_with(n)
        tree.take(b, n)
        plain = next((k for k, r in enumerate(bins) if r >= n), len(bins))
        assert b == plain
        if plain == len(bins):
            bins.append(2048)
        bins[plain] -= n


def test_bpe_round_trip(docs, held):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in bpe.encode_and_decode(docs).collect():
        if r.doc_id is not None:
            e = tokenizer.encode(held[r.doc_id] or "", add_special_tokens=False).ids
            assert r.ids == e and r.decoded == tokenizer.decode(e, skip_special_tokens=False)


def test_bpe_streams_like_the_library(held):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.Transducer(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
    rng = random.Random(1)
    parts = ["a", "b", "'", "'s", "'re", "'v", "'ll", " ", "  ", "\n", "\t", "é", "漢", "😀", "1", "23", "<|endoftext|>", "<|", "!", "\u3000", "\u00a0", "there", " with"]
    for own.window in (1, 2, 3, 5, 8, 13, 100):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(60)]
        assert [x.tolist() for x in own.encode(texts)] == [ids(t) for t in texts]
    texts = ["".join(rng.choice("aabehinorst") for _ in range(5000)), "a" * 9000, "漢字" * 3000, " " * 5000 + "x", "9" * 5000, held[77]]
    for own.window in (700, 4096):
        assert [x.tolist() for x in own.encode(texts)] == [ids(t) for t in texts]


def test_bpe_state_is_bounded_and_needs_its_lookahead():
    import public_tokenizers

    own = bpe.Transducer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    text = "".join(rng.choice("aabehinorst") for _ in range(40000))
    whole = own.encode([text])[0].tolist()

    def stepped() -> list[int]:
        own.open_text()
        out = []
        for i in range(0, len(text), 100):
            out += own.step([text[i : i + 100]], i + 100 < len(text))[0].tolist()
            assert len(own.rest) <= own.lookahead + own.sizes.max() + 100 and len(own.tail) <= 2
        return out

    assert stepped() == whole
    own.lookahead = 0  # tokens that aren't stable yet go out
    assert stepped() != whole


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(200)] + [(300, None), (320, [1.0, None] * 4), (340, [float("nan")] * 8), (None, [0.0] * 8), (360, [0.5] * 8), (361, [0.5] * 8)]
    good = [(i, np.floor(np.array(v) * 64).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    got = defaultdict(list)
    for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for i, q in good:
        if i % 20 == 0:
            assert got.pop(i) == sorted(((j, int(q @ v)) for j, v in good if j != i), key=lambda x: (-x[1], x[0]))[:20]
    assert not got


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pii(spark):
    samples = ["1.2.3.4.5.6.7.8 300.1.2.3 4111 1111 1111 1111 x@y.z_q@r.st +49 (30) 123456-7", None, "", "9" * 5000, "😀 é@b.cd 4111111111111111", "a@b.c" * 3000, "x." * 30000 + "a@" + "b." * 30000 + "c", "1." * 30000, "account DE89 3704 0044 0532 0130 00 and DE89 3704 0044 0532 0130 01", "ssn 078-05-1120"]
    got = {r.doc_id: [tuple(s)[:3] for s in r.spans] for r in pii.find_pii(spark.createDataFrame(list(enumerate(samples)), "doc_id long, text string")).collect()}
    for i, t in enumerate(samples):
        t = t or ""
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if len(t) < 20000 else [s for s in got[i] if s[0] == "email"]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m[0].split("."))) <= 255]
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(re.sub(r"\D", "", m[0])) <= 19 and luhn(re.sub(r"\D", "", m[0]))]
        out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
        assert [s for s in got[i] if s[0] in pii.BASE_KINDS] == out
    assert [s[0] for s in got[8]] == ["iban"] and [s[0] for s in got[9]] == ["ssn"]


def test_quality(docs, held):
    for r in quality_rules.measure(docs).collect():
        if r.doc_id is None:
            continue
        t = held[r.doc_id] or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_languages_on_held_out_rows(spark):
    got = language_id.op7_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 12, 40):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n


def test_secrets(spark, docs):
    known = [(i, f"some words and password = \"{hashlib.sha256(str(i).encode()).hexdigest()[:20]}Xy\" and more words here 12 ok") for i in range(60)]
    rows = known + [(100, "AKIA" + "A1" * 10 + " token: short"), (101, None), (102, ""), (103, "api_key='" + "Qw7" * 8 + "'"), (104, "password " + "aB3dE5gH7jK9mN1pQ3sT")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = secret_scan.fit(table)
    assert model is not None
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.scan(table, model).collect()}
    assert all(got[i][0][0] == "assign" for i, _ in known)
    assert [s[0] for s in got[100]] == ["access"] and got[101] == got[102] == [] and got[103][0] == ("assign", 0, 33)
    clean = {r.doc_id: r.text for r in secret_scan.redact(table, model).collect()}
    assert clean[103] == "[SECRET]'" and clean[101] is None
    assert secret_scan.redact(docs, model).count() == docs.count()


def test_viterbi_is_exact():
    from itertools import product

    rng = np.random.default_rng(4)
    for _ in range(50):
        e, t = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
        t[0, 2] = -1e9
        value = lambda tags: sum(e[i, x] for i, x in enumerate(tags)) + sum(t[a, b] for a, b in zip(tags, tags[1:])) - 1e9 * (tags[0] == 2)
        assert tuple(secret_scan.viterbi(e, t)) == max(product(range(3), repeat=5), key=value)
        one, _ = secret_scan.marginals(e, t)
        assert np.allclose(one.sum(1), 1)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.drop("text_hash").write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, str(tmp_path))
        assert out.columns == held.columns
        held = corpus_pipeline.written(out, "test")
    kept = {r.doc_id for r in near_dedup.near_duplicates(held).collect() if not r.kept}
    assert not kept
    assert corpus_pipeline.run(spark, str(tmp_path)).where("length <= 0").count() == 0
    assert zlib.crc32(b"") == 0
