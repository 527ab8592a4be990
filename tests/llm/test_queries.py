"""Each query's own columns against brute force over a whole small table, with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from basaltql.llm import queries, topk_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def texts() -> list:
    rng = random.Random(8)
    words = ["".join(rng.choice("abdeghinorst") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = ["\n".join(prose(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))) for _ in range(30)]
    out += [out[2], out[2] + " more", out[3][:200], None, "", " \n\t ", "é漢字 😀 don't", out[4].upper(), prose(3000), "x" * 3000, "the same three " * 40]
    out += [f"{prose(5)} mail a.b+{i}@ex-ample.co.uk ip 10.0.0.{i}, 999.1.1.1 card 4111 1111 1111 1111 or 4111111111111112 tel +49 (30) 123456{i} {prose(5)}" for i in range(4)]
    out += [f"{prose(6)} token = \"{sha(str(i))[:30]}\" AKIA{sha(str(i)).upper()[:16]} password: short {prose(6)} API_KEY:Ab9{sha(str(i))[:14]}" for i in range(5)]
    passage = prose(60)
    return out + [f"{prose(25)} {passage} {prose(25)}" for _ in range(4)]


@pytest.fixture(scope="module")
def held():
    return texts()


@pytest.fixture(scope="module")
def folder(spark, held, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queries"))
    rows = [(i, t, "en", i, "k", [1]) for i, t in enumerate(held)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, start int, key string, spans array<int>").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def rows_of(spark, folder, name):
    out = {}
    for r in queries.QUERIES[name](spark, folder).collect():
        assert r.doc_id not in out
        out[r.doc_id] = r
    return out


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_op1(spark, folder, held):
    got = rows_of(spark, folder, "op1_pii")
    digits = lambda s: re.sub("[^0-9]", "", s)
    for i, t in enumerate(held):
        t = t or ""
        found = {
            "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
            "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m[0].split("."))) <= 255],
            "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
            "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15],
        }
        base = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (*map(len, found.values()), sha(base)) and (r.spans == base if base else r.spans == "")


def test_op3(spark, folder, held):
    got = rows_of(spark, folder, "op3_quality_rules")
    for i, t in enumerate(held):
        w = WORD.findall(t or "")
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)


def test_op4(spark, folder, held):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    covered, places = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op4_packing"](spark, folder).collect():
        ids = np.array(tokenizer.encode(held[r.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
        covered[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(covered) == set(range(len(held)))
    for pieces in [*covered.values(), *places.values()]:
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
    assert all(sum(n for _, n in p) <= 2048 for p in places.values())


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_op5(spark, folder, held):
    sets = [shingles(t) for t in held]
    label = list(range(len(held)))
    for _ in held:
        for i in range(len(held)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = rows_of(spark, folder, "op5_near_dedup")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), label[i], label[i] == i) for i, s in enumerate(sets)}


def test_op6(spark, folder, held):
    seen, expected = set(), {}
    for i, t in enumerate(held):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        expected[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in rows_of(spark, folder, "op6_substring_dedup").items()} == expected


def test_op7(spark, folder, held):
    got = rows_of(spark, folder, "op7_language_id")
    for i, t in enumerate(held):
        letters = any(x.isalpha() for x in t or "")
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].lang_pred == ("en" if letters else "und") and 0 <= got[i].score <= 1


def test_op8(spark, folder, held):
    got = rows_of(spark, folder, "op8_secret_scan")
    for i, t in enumerate(held):
        t = t or ""
        base = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.IGNORECASE | re.ASCII) if len(m[2]) >= 12]
        base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        n = Counter(b[3] for b in base)
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(base))
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (n["assign"], n["access"], n["hex"], sha(listed)) and set(listed.split(",")) - {""} <= set(r.spans.split(","))


def test_op9(spark, folder, held):
    got = rows_of(spark, folder, "op9_line_dedup")
    seen = set()
    for i, t in enumerate(held):  # exact copies; lines within one edit are held against brute force elsewhere
        lines = [tuple(WORD.findall(x)) for x in (t or "").split("\n")]
        exact = 0
        for line in lines:
            exact += bool(line) and line in seen
            seen.add(line)
        assert got[i].n_lines == sum(map(bool, lines)) and got[i].n_removed >= exact


def test_op10(spark, folder, held):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows_of(spark, folder, "op10_bpe")
    for i, t in enumerate(held):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_op2_with_many_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD", 64)
    monkeypatch.setattr(topk_search, "QUERIES", 8)
    monkeypatch.setattr(topk_search, "STEP", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(1).tolist(), 1, "x") for i in range(600)] + [(7, [9.0] * 6, 2, "y"), (40, [9.0] * 6, 2, "y"), (None, [1.0] * 6, 2, "z"), (900, [], 3, "e")]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank string").write.parquet(f"{tmp_path}/embeddings.parquet")
    good = [(i, np.floor(np.array(v) * 64).astype(int)) for i, v, *_ in rows if i is not None]
    first = {i: v for i, v in good if sum(j == i for j, _ in good) == 1}
    got = defaultdict(list)
    for r in topk_search.op2_topk_search(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id, r.rank))
    dot = lambda a, b: int(a[: len(b)] @ b[: len(a)])
    for i, q in first.items():
        if i % 20 == 0:
            best = sorted(((dot(q, v), j) for j, v in good if j != i), key=lambda x: (-x[0], x[1]))[:20]
            assert got.pop(i) == [(s, j, k + 1) for k, (s, j) in enumerate(best)]
    assert set(got) == {40}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert all(q(spark, str(tmp_path)).count() == 0 for q in queries.QUERIES.values())


def test_empty_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    expected = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(expected.columns)
    assert sorted(map(tuple, got.select(*expected.columns).collect())) == sorted(expected.fetchall())


def test_stages_on_odd_rows(spark):
    """Stages that keep documents' columns: nulls, empties, repeated rows and columns whose names the operators use inside."""
    from basaltql.llm import language_id, line_dedup, secret_scan

    secret = "password = " + sha("x")[:30]
    rows = [(1, "plain words of a text\n" + secret, "en", "h", 1, [1]), (2, None, "en", "h", 2, None), (3, "", None, "h", 3, []), (None, "no id here", "en", None, None, [2]), (1, "plain words of a text\n" + secret, "en", "h", 1, [1]), (4, "12 34", "en", "h", 4, []), (5, "plain words of a text", "en", "h", 5, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, text_hash string, at int, lines array<int>").repartition(2)
    kept = language_id.accepted(docs, language_id.fit(docs))
    assert kept.schema == docs.schema and sorted(r.text[:5] for r in kept.collect()) == ["no id", "plain", "plain", "plain"]
    clean = secret_scan.redact(docs, secret_scan.fit(docs))
    assert clean.schema == docs.schema and sorted(str(r.text) for r in clean.collect()) == sorted(str(t).replace(secret, "[SECRET]") for _, t, *_ in rows)
    lines = line_dedup.drop_repeated_lines(docs, line_dedup.EVERY_LINE)
    assert lines.schema == docs.schema
    assert sorted((r.at or 0, r.text) for r in lines.collect() if r.text is not None) == [(0, "no id here"), (1, rows[0][1]), (1, rows[0][1]), (3, ""), (4, "12 34"), (5, "")]
