import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.vectors import hash_number
from cadenza.operators import feedback, ingest, playlist, profile, rerank, similarity
from cadenza.sources import sinks

TRACK = "uri string, name string, artists array<string>, album string, embedding array<double>"


@pytest.fixture(scope="module")
def tracks(spark):
    rng = np.random.default_rng(5)
    rows = [(f"t{i:02}", f"n{i}", [f"a{i % 4}"] if i % 7 else [f"a{i % 4}", "x"], f"b{i % 3}", rng.normal(size=6).tolist()) for i in range(40)]
    rows += [("none", "n", ["a1"], "b0", None), ("zero", "z", [], "b0", [0.0] * 6)]
    return spark.createDataFrame(rows, TRACK)


def near(rows, start, floor):
    m = {r.uri: np.array(r.embedding) for r in rows if r.embedding is not None and np.any(r.embedding)}
    q = m[start]
    sim = {u: float(v @ q / np.sqrt((v @ v) * (q @ q))) for u, v in m.items()}
    return sorted(((u, s) for u, s in sim.items() if s > floor), key=lambda x: (-x[1], x[0]))


def test_searches_agree(spark, tracks):
    queries = tracks.where("uri < 't05'").select(F.col("uri").alias("query"), F.col("embedding").alias("vector"))
    fold = lambda df: {(r.query, r.pos): (r.uri, round(r.similarity, 9)) for r in df.collect()}
    blas = fold(similarity.top_k(tracks, queries, 5, 0.1))
    assert blas == fold(similarity.top_k_expressions(tracks, queries, 5, 0.1)) == fold(similarity.top_k(tracks.repartition(7), queries, 5, 0.1, block=2))
    want = near(tracks.collect(), "t00", 0.1)[:5]
    assert [blas["t00", i + 1] for i in range(len(want))] == [(u, round(s, 9)) for u, s in want]


def test_related_errors(spark, tracks):
    with pytest.raises(LookupError):
        similarity.related(tracks, "unknown")
    with pytest.raises(ValueError):
        similarity.related(tracks, "none")
    found = similarity.related(tracks, "t00", 3, floor=-1.0).orderBy("pos").collect()
    assert found[0].uri == "t00" and found[0].similarity == 1.0
    assert similarity.related(tracks, "t00", 3, ["t00"], -1.0).where("uri = 't00'").count() == 0


def test_groups(spark, tracks):
    asked = spark.createDataFrame([("t01",), ("none",)], "query string")
    literal = {r.query: r.vector for r in similarity.group_queries(tracks, asked, "album", "literal").collect()}
    assert literal["t01"] == tracks.where("uri = 't01'").first().embedding and literal["none"] is None
    centre = {r.query: r.vector for r in similarity.group_queries(tracks, asked, "album", "centroid").collect()}
    own = [r.embedding for r in tracks.where("album = 'b1' and embedding is not null").collect()]
    assert centre["t01"] == pytest.approx(np.mean(own, axis=0).tolist())
    assert similarity.similar_groups(tracks, asked, "album", 30, "literal", -1.0).where("query = 't01' and uri = 't01'").count() == 0


def test_feedback(spark, tracks):
    names = spark.createDataFrame([("a1",), ("x",)], "name string")
    left = {r.uri for r in feedback.without_skipped_artists(tracks, names).collect()}
    assert left == {r.uri for r in tracks.collect() if not {"a1", "x"} & set(r.artists)}
    songs = spark.createDataFrame([("t00",)], "uri string")
    assert feedback.skip_track(songs, "t00").count() == 1 and feedback.skip_track(songs, "t01").count() == 2
    assert feedback.skip_artists(names, []) is names and feedback.skip_artists(names, ["x", "y", "y"]).count() == 3
    dropped = tracks.count() - feedback.soft_skip(tracks, names, 3).count()
    assert 0 < dropped < len([1 for r in tracks.collect() if {"a1", "x"} & set(r.artists)])


def test_profile(spark, tracks):
    requests = spark.createDataFrame([("r", ["t00", "t01", "none", "unknown"]), ("empty", [])], "query string, seeds array<string>")
    liked = spark.createDataFrame([("t02",), ("none",)], "uri string")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    v = {r.uri: unit(r.embedding) for r in tracks.where("uri like 't%'").collect()}
    got = {r.query: r.vector for r in profile.query_vectors(tracks, requests, liked).collect()}
    assert got["r"] == pytest.approx(unit(0.6 * unit(v["t00"] + v["t01"]) + 0.4 * v["t02"]).tolist())
    assert got["empty"] == pytest.approx(v["t02"].tolist())
    none = {r.query: r.vector for r in profile.query_vectors(tracks, requests, liked.limit(0)).collect()}
    assert np.linalg.norm(none["empty"]) == pytest.approx(1.0)


def model(vectors, artists, q, p):
    """The selection rule, step by step and without shortcuts, for argmax without noise."""
    unit = [v / np.linalg.norm(v) for v in vectors]
    left, picks, counts, last, streak = list(range(len(unit))), [], {}, [], 0
    while left and len(picks) < p.limit:
        best = None
        for i in left:
            spread = max((unit[i] @ unit[j] for j in picks), default=0.0)
            over = max(0, (streak if set(artists[i]) & set(last) else 0) - p.free_streak)
            s = p.weight * (unit[i] @ q) - (1 - p.weight) * spread - p.penalty_global * sum(counts.get(a, 0) for a in artists[i]) - p.penalty_streak * over
            if best is None or s > best[0]:
                best = s, i
        i = best[1]
        left.remove(i)
        picks.append(i)
        streak = streak + 1 if set(artists[i]) & set(last) else 1
        last = artists[i]
        for a in last:
            counts[a] = counts.get(a, 0) + 1
        q = p.inertia * q + (1 - p.inertia) * unit[i]
        q = q / np.linalg.norm(q)
    return picks


def test_selection():
    rng = np.random.default_rng(1)
    vectors, artists, q = rng.normal(size=(30, 5)), [[f"a{i % 3}"] for i in range(30)], rng.normal(size=5)
    q /= np.linalg.norm(q)
    p = rerank.Selection(limit=12, selection="argmax", noise=0.0)
    assert rerank.select(vectors, artists, q, p)[0] == model(vectors, artists, q, p)
    plain = rerank.Selection(limit=30, weight=1.0, selection="argmax", noise=0.0, inertia=1.0, penalty_global=0, penalty_streak=0)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert rerank.select(vectors, artists, q, plain)[0] == np.argsort(-(unit @ q), kind="stable").tolist()
    capped = rerank.Selection(limit=30, selection="argmax", noise=0.0, max_per_artist=2, enforce_max_per_artist=True)
    assert len(rerank.select(vectors, artists, q, capped)[0]) == 6
    assert len(set(rerank.select(vectors, artists, q, rerank.Selection(limit=30))[0])) == 30


def test_softmax_index():
    assert rerank.softmax_index(np.array([-1e9, -1e9]), 0.12, 0.7) == 0
    assert rerank.softmax_index(np.array([0.1, np.nan, 0.2]), 0.12, 0.5) == 2
    scores, rng = np.array([0.0, 0.1, 0.2]), np.random.default_rng(0)
    seen = np.bincount([rerank.softmax_index(scores, 0.12, rng.random()) for _ in range(6000)], minlength=3) / 6000
    want = np.exp(scores / 0.12) / np.exp(scores / 0.12).sum()
    assert np.abs(seen - want).max() < 0.03


def test_streaks(spark):
    lists = [("q", i, f"u{i}", a) for i, a in enumerate([["a"], ["a", "b"], ["b"], ["b"], ["b"], ["c"], [], []])]
    rows = spark.createDataFrame(lists, "query string, pos int, uri string, artists array<string>")
    assert [r.streak for r in playlist.streaks(rows).orderBy("pos").collect()] == [1, 2, 3, 4, 5, 1, 1, 1]
    assert [r.pos for r in playlist.cap_streaks(rows, 3).orderBy("pos").collect()] == [0, 1, 2, 5, 6, 7]


def test_first_wins(spark):
    rows = spark.createDataFrame([("q", 3, "a"), ("q", 1, "a"), ("q", 2, "b"), ("q", 4, None), ("q", 5, "")], "query string, pos int, uri string")
    once = playlist.first_wins(rows)
    assert {(r.uri, r.pos) for r in once.collect()} == {("a", 1), ("b", 2)} and playlist.first_wins(once).count() == 2


def test_chain(spark, tracks):
    rows = tracks.collect()
    lists = {u: near(rows, u, 0.0) for u in (r.uri for r in rows if r.uri.startswith("t"))}
    for floor in (0.0,):
        seeds = spark.createDataFrame([("t00",), ("t05",), ("none",)], "query string")
        want = {s: [u for u, _ in playlist.walk(s, lists, 10, 3)] for s in ("t00", "t05")}
        got = playlist.chain_walk(tracks, seeds, 10, 3, floor).orderBy("pos").collect()
        for s in want:
            assert [r.uri for r in got if r.query == s] == want[s]
        assert not [r for r in got if r.query == "none"]
    graph = similarity.top_k(tracks, tracks.select(F.col("uri").alias("query"), F.col("embedding").alias("vector")), 12, 0.0)
    again = playlist.chain_from_graph(graph, seeds, 10, 3).orderBy("pos").collect()
    assert [r.uri for r in again if r.query == "t00"] == want["t00"]


def test_weave():
    t = lambda u, *a: {"uri": u, "artists": list(a)}
    solos = {"a": [t("s1", "a"), t("s2", "a"), t("s3", "a")], "b": [t("s4", "b")]}
    rows = [t("x", "a"), t("y", "a"), t("z", "b")]
    out = [r["uri"] for r in playlist.weave(rows, solos, {"x": 0.9, "y": 0.9, "z": 0.1})]
    # z: nobody beside it, two wanted and one there; y: x before it, one; x: the next row (s1) shares its artist.
    assert out == ["x", "s1", "y", "s4", "z"]


@pytest.mark.parametrize("drawn", [32, 2, 0])
def test_draw_solos(spark, monkeypatch, drawn):
    """The three smallest hashes of all pairs, however few of them the first cut leaves."""
    monkeypatch.setattr(playlist, "DRAWN", drawn)
    library = [(f"u{i}", f"n{i}", [f"a{i % 3}"], "b", None) for i in range(300)] + [("s", "n", ["few"], "b", None), ("d", "n", ["a0", "a1"], "b", None)]
    rows = spark.createDataFrame([(q, a) for q in ("q1", "q2") for a in (["a0", "few"], ["a0"], ["none", "a2"])], "query string, artists array<string>")
    got = playlist.draw_solos(rows, spark.createDataFrame(library, TRACK), 4).collect()
    want = set()
    for q in ("q1", "q2"):
        for a in ("a0", "a2", "few"):
            own = sorted((hash_number(u, q, 4), u) for u, _, artists, _, _ in library if artists == [a])[:3]
            want |= {(q, a, n, u) for n, (_, u) in enumerate(own, 1)}
    assert len(got) == len(want) and {(r.query, r.artist, r.n, r.uri) for r in got} == want


def test_lists_are_made_once(spark, tracks):
    """The lists that are woven are made once, not by each of their readers."""
    made = spark.sparkContext.accumulator(0)

    def count(artists):
        made.add(1)
        return artists

    rows = [("q", i, f"t{i:02}", f"n{i}", [f"a{i % 4}"], 0.5, "related") for i in range(1, 6)]
    counted = spark.createDataFrame(rows, playlist.ROW).withColumn("artists", F.udf(count, "array<string>")("artists"))
    assert playlist.interleave(counted, tracks, 1).count() >= 5 and made.value == 5


def test_playlist(spark, tracks):
    none = spark.createDataFrame([], "uri string")
    nobody = spark.createDataFrame([], "name string")
    asked = spark.createDataFrame([("t00",)], "query string")
    found = playlist.similar_tracks(tracks, asked, spark.createDataFrame([("t00",)], "uri string"), nobody, floor=0.2, seed=1, limit=6).orderBy("pos").collect()
    uris = [r.uri for r in found]
    assert uris and len(set(uris)) == len(uris) and "t00" not in uris and [r.pos for r in found] == list(range(1, len(uris) + 1))
    assert none.count() == 0


def test_sinks(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "uri string, n int")
    added = sinks.insert_ignore(target, spark.createDataFrame([("b", 9), ("c", 3), ("c", 4), (None, 5)], "uri string, n int"), "uri", "n")
    assert {(r.uri, r.n) for r in added.collect()} == {("a", 1), ("b", 2), ("c", 3)}
    updates = spark.createDataFrame([("a", 7, 1), ("a", 8, 2), ("unknown", 1, 1)], "uri string, n int, at int")
    assert {(r.uri, r.n) for r in sinks.keyed_update(target, updates, "uri", "n", "at").collect()} == {("a", 8), ("b", 2)}
    quoted = spark.createDataFrame([("o'x", [1.0])], "uri string, embedding array<double>")
    assert sinks.update_statements(quoted).first().value == "UPDATE track SET embedding = '[1.000000]'::vector WHERE uri = 'o''x';"
    assert sinks.post_playlist(quoted, None) == "skipped"


def test_media(spark):
    tracks = spark.createDataFrame([("u1", "1000 doves", ["Lady Gaga"], "Chromatica"), ("u2", "a/b", ["", "X"], ""), ("u3", "X", ["Y"], "Z"), ("u4", None, ["Y"], "Z")], "uri string, name string, artists array<string>, album string")
    keys = ["Lady Gaga/Chromatica/15 - 1000 Doves.MP3", "X/any/deep/a_b.flac", "Y/Z/5 - X.mp3", "Y/Z/105 - X.mp3", "Y/Z/X.txt", "Lady Gaga/Other/1000 doves.mp3"]
    listing = spark.createDataFrame([(k,) for k in keys], "key string")
    assert {(r.uri, r.key) for r in ingest.match_media(tracks, listing).collect()} == {("u1", keys[0]), ("u2", keys[1])}
    exact = spark.createDataFrame([("Y/Z/X.mp3",)], "key string")
    assert [r.uri for r in ingest.match_media_exact(tracks, exact).collect()] == ["u3"]


def test_embed(spark):
    files = spark.createDataFrame([("a", b"some bytes"), ("b", b""), ("c", None)], "uri string, content binary")
    got = {r.uri: r.embedding for r in ingest.embed(files, 8).collect()}
    assert set(got) == {"a"} and len(got["a"]) == 8
    frames = spark.createDataFrame([("a", [[1.0, 2.0], [3.0, 4.0]]), ("n", [[float("nan")]]), ("e", [])], "uri string, frames array<array<double>>")
    assert {r.uri: r.embedding for r in ingest.frame_mean(frames).collect()} == {"a": [2.0, 3.0]}


def test_streams_go_on(spark, tmp_path):
    from cadenza.streaming import feedback as stream

    folder = str(tmp_path / "events")
    schema = "uri string"
    spark.createDataFrame([("a",), ("a",), ("b",)], schema).write.parquet(folder)
    read = lambda: spark.readStream.schema(schema).parquet(folder)
    run = lambda: {r.uri for r in stream.upsert_keys(read(), "uri", str(tmp_path / "t"), str(tmp_path / "c")).collect()}
    assert run() == {"a", "b"}
    spark.createDataFrame([("b",), ("c",)], schema).write.mode("append").parquet(folder)
    assert run() == {"a", "b", "c"} == run()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_engine(spark, tracks, tmp_path):
    from cadenza.plans.api import Engine
    from cadenza.sources.tables import Config

    empty = lambda c: spark.createDataFrame([], f"{c} string")
    engine = Engine(spark, Config(str(tmp_path)), tracks, empty("uri"), empty("uri"), empty("name"))
    first = engine.recommend(["t00"], limit=5, floor=-1.0, selection=rerank.Selection(selection="argmax", noise=0.0)).orderBy("pos").collect()
    assert len(first) == 5 and first[0].uri == "t00"
    engine.skip_track("t00")
    again = engine.recommend(["t00"], limit=5, floor=-1.0)
    assert "t00" not in {r.uri for r in again.collect()}
    assert engine.play_next(seeds=["t01"], limit=3, floor=-1.0).count() == 3 and engine.status()["prepared"]
    assert engine.coverage() == {"completed": 41, "missing": 1}
    with pytest.raises(ValueError):
        Config("")


def test_mmr_of_thirty_picks_against_a_plain_version():
    rng = np.random.default_rng(11)
    vectors, q = rng.normal(size=(50, 8)), rng.normal(size=8)
    p = rerank.Selection(limit=30, selection="argmax", penalty_global=0.0, penalty_streak=0.0, inertia=1.0, noise=0.0)
    u, v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True), q / np.linalg.norm(q)
    picks, scores = rerank.select(vectors, [[] for _ in vectors], v, p)
    want = []
    for _ in range(30):
        value = {i: 0.7 * float(u[i] @ v) - 0.3 * max((float(u[i] @ u[j]) for j in want), default=0.0) for i in range(50) if i not in want}
        want.append(max(value, key=value.get))
        assert scores[len(want) - 1] == pytest.approx(value[want[-1]])
    assert list(picks) == want


def test_selection_draws():
    rng = np.random.default_rng(2)
    vectors, artists, q = rng.normal(size=(20, 4)), [[f"a{i % 3}", "x"] if i % 2 else [] for i in range(20)], rng.normal(size=4)
    for kind in ("softmax", "gumbel", "epsilon"):
        runs = [rerank.select(vectors, artists, q, rerank.Selection(limit=20, selection=kind, seed=s), name=n)[0] for s, n in ((1, "r"), (1, "r"), (2, "r"), (1, "other"))]
        assert runs[0] == runs[1] and all(sorted(r) == list(range(20)) for r in runs)
        assert kind == "epsilon" or len({tuple(r) for r in runs}) == 3
    # Gumbel draws at a temperature are softmax draws.
    same, wide = np.eye(3), rerank.Selection(limit=1, selection="gumbel", noise=0.0, weight=1.0)
    picks = [rerank.select(same, [[]] * 3, np.array([0.1, 0.0, -0.1]), wide, name=str(n))[0][0] for n in range(4000)]
    want = np.exp(np.array([0.1, 0.0, -0.1]) / 0.12)
    assert np.abs(np.bincount(picks, minlength=3) / 4000 - want / want.sum()).max() < 0.03
    state = rerank.State({"a0": 5}, ("a0",), 4)
    p = rerank.Selection(limit=1, selection="argmax", noise=0.0, weight=1.0)
    scores = rerank.select(vectors[:2], [["a0", "a0"], []], q, p, state)[1]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert scores[0] == pytest.approx(max(unit[0] @ q - 0.03 * 10 - 0.06 * 2, unit[1] @ q))


def test_candidates_of_any_pool(spark, tracks):
    none, nobody = spark.createDataFrame([], "uri string"), spark.createDataFrame([], "name string")
    asked = tracks.where("uri in ('t00', 't03')").select(F.col("uri").alias("query"), F.col("embedding").alias("vector"))
    every = similarity.candidates(tracks, asked, none, nobody, 2000, jitter=0.5, floor=0.0, seed=3).collect()
    few = similarity.candidates(tracks.repartition(5), asked, none, nobody, 4, jitter=0.5, floor=0.0, seed=3).collect()
    assert {(r.query, r.uri, r.pos) for r in few} == {(r.query, r.uri, r.pos) for r in every if r.pos <= 4} and len(few) == 8
    assert {r.uri for r in every if r.query == "t00"} == {u for u, _ in near(tracks.collect(), "t00", 0.0)}


def test_updates_to_null_and_ties(spark):
    target = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "uri string, x double")
    updates = spark.createDataFrame([("a", None), ("b", 5.0), ("b", 7.0)], "uri string, x double")
    assert {(r.uri, r.x) for r in sinks.keyed_update(target, updates, "uri", "x").collect()} == {("a", None), ("b", 7.0), ("c", 3.0)}
    later = spark.createDataFrame([("a", 4.0, 1), ("a", None, 2)], "uri string, x double, at int")
    assert sinks.keyed_update(target, later, "uri", "x", "at").where("uri = 'a'").first().x is None


def test_current_item_in_order_of_the_response(spark):
    from cadenza.sources import tables

    body = '{"service_response": {"z": {"active": true, "current_item": {"media_item": {"uri": "first", "artists": [{"name": "A"}]}}}, "b": {"active": true, "current_item": {"media_item": {"uri": "second"}}}}}'
    queue = spark.createDataFrame([(body,)], "body string").select(F.from_json("body", tables.QUEUE).alias("r")).select("r.*")
    assert [(r.uri, r.artists) for r in ingest.current_item(queue).collect()] == [("first", ["A"])]


def test_work_list_and_media_folder(spark, tmp_path):
    from cadenza.sources import tables

    (tmp_path / "list.json").write_text('[{"uri": "u1", "name": "N", "artists": "One, Two", "album": "A"}, {"uri": "u2", "artists": ["x", " ", null, "y"]}, {"uri": "u3", "artist": "Solo"}, {"uri": "u4"}]')
    got = {r.uri: r.artists for r in tables.read_work_list(spark, str(tmp_path / "list.json")).collect()}
    assert got == {"u1": ["One, Two"], "u2": ["x", "y"], "u3": ["Solo"], "u4": []}
    folder = tmp_path / "a+b (c) [d].e$"
    (folder / "X" / "Y").mkdir(parents=True)
    (folder / "X" / "Y" / "n.mp3").write_bytes(b"sound")
    assert [(r.key, bytes(r.content)) for r in tables.list_media(spark, str(folder) + "/", content=True).collect()] == [("X/Y/n.mp3", b"sound")]
    rows = [("u1", "n", ["X"], "Y", None), ("u2", "gone", ["X"], "Y", None), ("u3", "n", ["X"], "Y", [0.5] * 4)]
    tracks = spark.createDataFrame(rows, "uri string, name string, artists array<string>, album string, embedding array<float>")
    done = {r.uri: r.embedding for r in ingest.embed_local(tracks, str(folder), 4).collect()}
    assert len(done["u1"]) == 4 and done["u2"] is None and done["u3"] == [0.5] * 4
    files, store = tables.list_media(spark, str(folder), content=True), str(tmp_path / "store")
    first = ingest.store_embeddings(tracks, files.select("key"), files, store, 4, rounds=2).collect()
    assert [r.uri for r in first] == ["u1"] and first[0].embedding == done["u1"]
    fail = lambda content, dimension: 1 / 0
    assert ingest.store_embeddings(tracks, files.select("key"), files, store, 4, fail, rounds=2).count() == 1  # nothing is made again
    assert {r.uri for r in ingest.shuffled(tracks, 3).collect()} == {"u1", "u2", "u3"}


def test_configuration():
    from cadenza.sources.tables import Config

    assert Config.from_environment({"DATABASE_URL": "/t", "TOKEN": "x", "DIMENSION": "8"}) == Config("/t", None, "x", None, 8)
    with pytest.raises(ValueError):
        Config.from_environment({})


def test_listing_has_three_decimals(spark):
    rows = spark.createDataFrame([("q", 1, "u", "n", ["a", "b"], 0.12345)], "query string, pos int, uri string, name string, artists array<string>, similarity double")
    assert playlist.listing(rows).first().line == "a, b: n, similarity: 0.123, uri: u"


def test_work_folder_is_named_on_a_cluster():
    from cadenza.sources import work

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        work.base(Session)


def test_service(spark, tracks, tmp_path):
    """Routes of the service, and the readers and writers of other services, against local servers."""
    import json
    import threading
    import time
    import urllib.error
    import urllib.request
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from cadenza.plans.api import Engine
    from cadenza.plans.service import Service
    from cadenza.sources import tables

    seen, playing = [], [True]
    queue = lambda: {"service_response": {"p": {"active": playing[0], "current_item": {"media_item": {"uri": "t05", "name": "n", "artists": [{"name": "a1"}]}}}}}

    class Other(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.path, self.headers.get("Authorization"), json.loads(body)))
            data = json.dumps(queue()).encode()
            self.send_response(500 if self.path == "/broken" else 200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    other = HTTPServer(("127.0.0.1", 0), Other)
    threading.Thread(target=other.serve_forever, daemon=True).start()
    host = f"http://127.0.0.1:{other.server_port}"
    fetched = tables.fetch(spark, f"{host}/queue", "secret", {"a": 1}, tables.QUEUE)
    assert ingest.current_item(fetched).first().uri == "t05" and ("/queue", "Bearer secret", {"a": 1}) in seen
    with pytest.raises(urllib.error.HTTPError):
        sinks.post_playlist(spark.createDataFrame([("u", 1)], "uri string, pos int"), f"{host}/broken")
    (tmp_path / "queue.json").write_text(json.dumps(queue(), indent=1))
    assert ingest.current_item(tables.read_queue(spark, str(tmp_path / "queue.json"))).first().uri == "t05"
    sinks.write_json(tracks.select("uri").limit(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2

    polled = ingest.current_item(tables.poll(spark, f"{host}/poll", "secret", {}, tables.QUEUE))
    stream = polled.writeStream.format("memory").queryName("polled").trigger(processingTime="200 milliseconds").start()
    begun = time.monotonic()
    while spark.table("polled").count() < 2 and time.monotonic() < begun + 60:
        time.sleep(0.2)
    stream.stop()
    assert {r.uri for r in spark.table("polled").collect()} == {"t05"} and sum(p == "/poll" for p, *_ in seen) >= 2

    empty = lambda c: spark.createDataFrame([], f"{c} string")
    engine = Engine(spark, tables.Config(str(tmp_path), webhook=f"{host}/hook"), tracks, empty("uri"), empty("uri"), empty("name"))
    service = Service(engine, lambda: tables.fetch(spark, f"{host}/queue", None, {}, tables.QUEUE), {"seeds": ["t00"], "limit": 3, "floor": -1.0})
    server = service.serve(0)

    def ask(method, path):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", b"" if method == "POST" else None, method=method)
        try:
            with urllib.request.urlopen(request, timeout=120) as answer:
                return answer.status, answer.read().decode()
        except urllib.error.HTTPError as error:
            return error.code, error.read().decode()

    assert ask("GET", "/api/status") == (200, "OK") and ask("GET", "/elsewhere") == (404, "Not Found") == ask("GET", "/track/skip")
    assert json.loads(ask("GET", "/music/play")[1]) == {"uri": "t05", "artists": ["a1"]}
    assert ask("POST", "/track/skip")[0] == 200
    assert [r.uri for r in engine.skipped_songs.collect()] == ["t05"] and [r.name for r in engine.skipped_artists.collect()] == ["a1"]
    played = json.loads(ask("POST", "/music/play")[1])
    assert played["success"] and len(played["tracks"]) == 3 and not any("a1" in t["artists"] for t in played["tracks"])
    assert [b for p, _, b in seen if p == "/hook"] == [{"media_ids": [t["uri"] for t in played["tracks"]]}]
    service.preparing.join()
    playing[0] = False
    assert ask("GET", "/music/play") == (404, "No track found") == ask("POST", "/track/skip")
    server.shutdown()
    other.shutdown()
