"""Conversations, embeddings, the pipeline, and queries against SQL."""

import hashlib
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from cadenza.llm import chat_format, embedding_dedup, minmax_dedup, queries, substring_dedup


def test_chats(spark):
    rows = [
        (1, 0, "system", "be <nice>"), (1, 1, "user", "a [INST] b\\"), (1, 2, "assistant", "</s>\\<"), (2, 0, "assistant", "first"), (2, 1, "user", None),
        (3, None, None, None), (4, 0, "to>ol", "x<y"), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (None, 0, "user", "hi"), (None, 1, "assistant", "日本 [/INST]"), (5, 0, "user", " "), (5, 1, "assistant", ""),
    ]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, turns string")
    got = {r.conv_id: r for r in chat_format.summary(chat_format.format_chats(turns)).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, found in by.items():
        found.sort()
        said = "".join(t for _, r, t in found if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(found), digest("".join(f"{a}\n{b}\n" for _, a, b in found))), conv
        assert (r.loss_chars, r.loss_sha256) == (len(said), digest(said)), conv
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True, 5: True}
    full = {r.conv_id: r for r in chat_format.format_chats(turns).collect()}
    assert full[1].formatted == "<s><sys>be <\\nice></sys>[INST] a [\\INST] b\\\\ [/INST]<reply><\\/s>\\\\<\\</s>" and "".join(s.text for s in full[1].segments) == full[1].formatted
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_a_table_with_the_added_conversation(spark):
    """Turns of a conversation -7 that is there already are turns beside the added ones."""
    turns = spark.createDataFrame([(-7, 2, "user", "more"), (1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat_format.summary(chat_format.format_chats(chat_format.with_control_strings(spark, turns))).collect()}
    assert got[-7].n_turns == 3 and not got[-7].valid and got[1].n_turns == 1


def brute(vectors, cosine=0.95):
    ok = {i for i, v in enumerate(vectors) if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    link = {(a, b) for a in ok for b in ok if a < b and len(vectors[a]) == len(vectors[b]) and np.dot(vectors[a], vectors[b]) / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b]) >= cosine}
    n, up = Counter(x for p in link for x in p), list(range(len(vectors)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in link:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {i: (n[i], top(i)) for i in range(len(vectors))}


@pytest.mark.parametrize("block", [1024, 16])
def test_embeddings(spark, block):
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(40):
        v = rng.normal(size=32)
        vectors += [(v + rng.normal(size=32) * s).tolist() for s in rng.choice([0.02, 0.1, 0.3], 4)]
    vectors += [vectors[0]] * 30 + [(np.array(vectors[0]) * 7).tolist(), None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [1.0, 2.0], [2.0, 4.0]]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, key string, sig int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table, block=block).collect()}
    want = brute(vectors)
    links, found = sum(n for n, _ in want.values()), sum(n for n, _ in got.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.97 * links
    assert all(got[i] == want[i] for i in range(160, len(vectors)))
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_recall_at_the_bound(spark, hashes):
    """Pairs with a cosine of just 0.95, the hardest to find."""
    rng = np.random.default_rng(hashes)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(600, 64)))
    b = rng.normal(size=(600, 64))
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * b
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(table, hashes=hashes).collect()}
    assert np.mean([got[i + 600] == i for i in range(600)]) >= 0.99


def test_vectors_with_null_and_repeated_ids(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    table = spark.createDataFrame([(5, v), (5, v), (None, v), (7, [1.0, 2.0, 3.001]), (8, w), (8, v), (None, None)], "vec_id bigint, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table).collect()), key=str)
    assert got == sorted([(5, 4, 5, True), (5, 4, 5, True), (None, 4, 5, False), (7, 4, 5, False), (8, 0, 8, True), (8, 4, 5, False), (None, 0, None, True)], key=str)


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 16))
    h = np.array([[1]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(embedding_dedup.hadamard(x), x @ h.T)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    place = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in place) for r in want.fetchall())


def test_pipeline(spark, sf_dir):
    """Each stage against a plain version on what it gets."""
    import corpus_pipeline as P
    from cadenza.llm.common import Workspace

    work = Workspace(spark)
    docs = work.keep(spark.read.parquet(f"{sf_dir}/documents.parquet"), "docs")
    tables = [docs]
    for name, stage in P.STAGES:
        tables.append(work.keep(stage(spark, tables[-1], sf_dir), name))
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    assert all(t.columns == list(P.KINDS) for t in tables[1:-1])
    pairs = [[(i, r.text) for i, r in found.items()] for found in rows[:-1]]
    assert set(rows[1]) <= set(rows[0]) and all(rows[1][i].text == rows[0][i].text for i in rows[1])
    assert set(rows[2]) == {i for i, (_, c) in H.near_duplicates(pairs[1], 80).items() if i == c}
    assert {i: r.text for i, r in rows[3].items()} == {i: kept for i, (_, _, kept) in H.without_repeats(pairs[2]).items()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(rows[4]) == set(rows[3]) - {d for d, *_ in H.containment(pairs[3], items)}
    assert set(rows[5]) == set(rows[4]) and all(rows[5][i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in pairs[4])
    assert {r.doc_id: r.ids_sha256 for r in P.run(spark, sf_dir).collect()} == {i: r.ids_sha256 for i, r in rows[5].items()}


def test_edges_of_the_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    H.frame(spark, H.EDGES + [(None, "no id"), (1, H.BASE)]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, H.FAR)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in P.run(spark, str(tmp_path)).collect()}
    assert {1, 6, 7, 8, 9, 12, 14, None} <= got and 2 not in got and 5 not in got
    assert minmax_dedup and substring_dedup


def test_pipeline_with_repeated_and_null_ids(spark, tmp_path):
    """Only the rejected row goes, not others with its id; contaminated rows without an id go too."""
    import corpus_pipeline as P

    spark.createDataFrame([(1, H.FAR)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, H.BASE), (5, H.EDITED), (5, "clean text of five"), (5, H.FAR), (None, H.FAR), (None, "clean"), (None, None)]
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    docs = H.frame(spark, rows)
    assert texts(P.minhash_dedup(spark, docs, "")) == sorted((r for r in rows if r != (5, H.EDITED)), key=str)
    assert texts(P.decontamination(spark, docs, str(tmp_path))) == sorted((r for r in rows if r[1] != H.FAR), key=str)


def test_runs_of_the_pipeline_are_independent(spark, sf_dir, tmp_path):
    """A second run, and stages called again, leave a first result readable; an empty table has an empty result."""
    import corpus_pipeline as P

    H.frame(spark, [(i, f"{H.BASE} {i}") for i in range(3)] + [(9, "short")]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, H.FAR)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first, stage = P.run(spark, str(tmp_path)), P.minhash_dedup(spark, docs, str(tmp_path))
    second, other = P.run(spark, str(tmp_path)), P.minhash_dedup(spark, docs.where("doc_id > 0"), str(tmp_path))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(first) == ids(second) == ids(stage) == [0, 9] and ids(other) == [1, 9]
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).write.parquet(str(empty / f"{name}.parquet"))
    assert P.run(spark, str(empty)).count() == 0


def test_workspaces(spark):
    from cadenza.llm.common import Workspace

    work = Workspace(spark)
    a, _ = work.keep(spark.range(3), "a"), work.keep(spark.range(4), "b")
    work.only("a")
    assert a.count() == 3 and not Path(work.root.removeprefix("file://"), "b").exists()
    work.release()
    assert not Path(work.root.removeprefix("file://")).exists()
