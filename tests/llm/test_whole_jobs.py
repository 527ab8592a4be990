"""What the queries must not leave out: short lines, and other rows that a bound once kept from an operator."""

import hashlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from basaltql.llm import line_dedup, secret_scan, substring_dedup


def test_short_lines_go(spark, tmp_path):
    paragraph = "一段没有空格的中文文字" * 30
    texts = ["one\nan old line\nHome page\n" + paragraph, paragraph + "\nHome  page\n \none\nnew", None, "Home page"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {0: (0, sha(texts[0])), 1: (3, sha(" \nnew")), 2: (0, None), 3: (1, sha(""))}
    out = corpus_pipeline.line_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id: r.text for r in out.collect()} == {0: texts[0], 1: " \nnew", 2: None, 3: ""}


def test_one_secret_in_many_texts_trains(spark):
    value = hashlib.sha256(b"x").hexdigest()[:20]
    table = spark.range(20000).selectExpr("id doc_id", f"if(id = 4321, 'password = {value}Xy', concat('plain text ', id, ' and part number A1B2C3D4E5F6G7H8', id)) text")
    known = lambda model: "head:pass" in model["names"] or any(n.startswith("prev:password") for n in model["names"])
    assert known(secret_scan.fit(table)) and secret_scan.fit(table.where("doc_id < 0")) is None


def test_field_finds_secrets_without_a_pattern(spark):
    letters = lambda i, n: hashlib.sha256(str(i).encode()).hexdigest()[:n].translate(str.maketrans("0123456789abcdef", "QxZkWvJpGbTyMhRd"))
    prose = "the international committee considered several additional documents about transportation yesterday"
    known = [(i, f"{prose} password = {letters(i, 12 + i % 9)} afterwards everything continued") for i in range(300)]
    plain = [(1000 + i, f"{prose} number {i}: nothing particular happened, description = unchanged") for i in range(300)]
    hidden = [(2000 + i, f"{prose} pwd = {letters(-i - 1, 12 + i % 4)} afterwards everything continued") for i in range(40)]
    table = spark.createDataFrame(known + plain + hidden, "doc_id long, text string")
    model = secret_scan.fit(table.where("doc_id < 2000"))
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.scan(table, model).collect()}
    found = sum(("crf", t.index("pwd = ") + 6, t.index(" afterwards")) in got[i] for i, t in hidden)
    assert found >= 36
    assert sum(len(got[i]) for i, _ in plain) <= 3
    field = secret_scan.Field(model)
    for _, t in known + plain + hidden:  # what the bounds leave out changes nothing
        base = secret_scan.base_spans(t)
        assert field.added(t, base) == [s for spans, features in secret_scan.chains(t) for s in field.tagged(spans, features, base)]


def test_windows_that_share_half_a_hash(monkeypatch):
    """Texts a, b, b: a's only window has b's minimizer and the upper half of b's hash; b's copy must still find b."""
    hashes = {"a": 7 << 32 | 1, "b": 7 << 32 | 2}
    made = lambda t: (np.array([hashes[x] for x in t.to_pylist()], np.uint64), np.full(len(t), 5, np.uint64), np.arange(len(t)), np.zeros(len(t), np.int64))
    monkeypatch.setattr(substring_dedup, "windows", made)
    parts = [pa.RecordBatch.from_pydict({"doc_id": [i], "text_hash": [ord(t)], "text": [t]}) for i, t in enumerate("abb")]
    edges = [e for part in parts for e in substring_dedup._edges(1)([part])]
    pieces = [x for out in substring_dedup._repeats(edges) for x in out.to_pylist()]
    assert [(x["doc_id"], x["source"]) for x in pieces] == [(2, 1)]


def test_compaction_of_pieces(spark):
    """Pieces that follow each other become one path; a branch, another diagonal or a gap parts them; repeats change nothing."""
    rows = [(1, 7, 0, 10, 0, 5, 100), (1, 7, 10, 5, 0, 5, 110), (1, 7, 15, 3, 0, 5, 300), (1, 7, 30, 4, 0, 5, 130), (2, 7, 0, 6, 0, 5, 100)]
    rows += [rows[0], (3, 7, 0, 20, 1, 9, 0), (3, 7, 0, 8, 1, 9, 0), (3, 7, 8, 12, 1, 9, 8), (3, 7, 15, 10, 1, 9, 15)]
    got = sorted(tuple(r) for r in substring_dedup.compacted(spark.createDataFrame(rows, substring_dedup.PATHS).repartition(3)).collect())
    assert [r for r in got if r[0] == 1] == [(1, 7, 0, 10, 0, 5, 100), (1, 7, 0, 15, 0, 5, 100), (1, 7, 15, 3, 0, 5, 300), (1, 7, 30, 4, 0, 5, 130)]
    assert [r for r in got if r[0] == 2] == [(2, 7, 0, 6, 0, 5, 100)]
    covered = {x for r in got if r[0] == 3 for x in range(r[2], r[2] + r[3])}
    assert covered == set(range(25)) and all(r[2] == r[6] for r in got if r[0] == 3)


def test_one_path_for_a_passage(spark):
    words = [f"w{i}" for i in range(600)]
    texts = ["x " + " ".join(words[:400]) + " y", "other " + " ".join(words[50:350]) + " end", " ".join(words[200:600])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    paths = sorted(tuple(r)[:4] for r in substring_dedup.repeated_paths(substring_dedup.by_key(table)).drop("text_hash").collect())
    assert [p[:3] for p in paths] == [(1, 1, 281), (2, 0, 181)]


def test_lookups_of_hot_keys(spark, monkeypatch):
    from basaltql.llm import spark_tools

    monkeypatch.setattr(spark_tools, "HOT_ROWS", 20)
    left = spark.range(1000).selectExpr("if(id % 3 = 0, 7, id) k", "id")
    right = spark.range(500).selectExpr("id k", "id * 2 v")
    rows = lambda df: sorted(tuple(-1 if x is None else x for x in r) for r in df.select("k", "id", "v").collect())
    hot = spark_tools.hot_keys(left, ["k"])
    assert len(hot) == 1
    for how in ("inner", "left"):
        assert rows(spark_tools.looked_up(left, right, ["k"], hot, how)) == rows(left.join(right, "k", how))


def test_components_of_a_large_star(spark, monkeypatch):
    from basaltql.llm import spark_tools
    from basaltql.llm.components import components

    monkeypatch.setattr(spark_tools, "HOT_ROWS", 10)
    star = spark.range(1, 200).selectExpr("0 a", "id b")
    chain = spark.range(1000, 1050).selectExpr("id a", "id + 1 b")
    got = {r.node: r.label for r in components(star.union(chain)).collect()}
    assert got == {**{i: 0 for i in range(200)}, **{i: 1000 for i in range(1000, 1051)}}


def test_links_between_components_are_a_forest(spark, monkeypatch):
    """Near copies behind hubs they are not linked with: links found later join components, and don't grow with all pairs."""
    from basaltql.llm import near_dedup

    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    edited = lambda i, edits: " ".join(f"x{i}y{k}" if k in edits else w for k, w in enumerate(base))
    texts = [edited(i, set(rng.choice(300, 12 if i < 60 else 3, replace=False).tolist())) for i in range(140)]
    rows = {}

    def written(df, name, f=near_dedup.written):
        out = f(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "written", written)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(296)} for t in texts]
    pairs = [(j, i) for i in range(140) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    label = list(range(140))
    for _ in range(140):
        for j, i in pairs:
            label[i] = label[j] = min(label[i], label[j])
    assert got == dict(enumerate(label)) and len(set(label)) > 20
    assert rows["rest-links"] < 140 < len(pairs)


def test_forest_of_links():
    from basaltql.llm import near_dedup

    sets = [np.arange(i, i + 100, dtype=np.uint64) for i in (0, 5, 10, 50, 55, 400, 1)]
    node, label = np.arange(7), np.array([0, 1, 2, 3, 4, 5, 0])
    links = near_dedup.forest(node, label, np.full(7, 2), sets)
    assert len(links) == 3 and all(a < b and len(np.intersect1d(sets[a], sets[b])) * 100 >= 75 * len(np.union1d(sets[a], sets[b])) for a, b in links)
    assert near_dedup.forest(node, label, np.array([0, 0, 0, 1, 1, 1, 0]), sets) == []
    assert near_dedup.forest(node, label, np.array([0, 0, 0, 0, 1, 1, 0]), sets) == [(3, 4)]
