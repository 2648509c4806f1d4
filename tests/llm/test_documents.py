"""Operators on documents against plain versions, with empty, null, long, repeated and strange rows."""

import base64
import hashlib
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from cadenza.llm import byte_bpe, common, decontaminate, kneser_ney, license_scan, minmax_dedup, substring_dedup, token_counts, toxicity_crf


@pytest.fixture(scope="module")
def edges(spark):
    return H.frame(spark, H.EDGES)


@pytest.fixture(scope="module")
def nothing(spark):
    return H.frame(spark, [])


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = byte_bpe.read_ranks(Path(public_tokenizers.path(byte_bpe.RANKS)).read_bytes())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---------------------------------------------------------------- 1


def test_licences(spark, edges, nothing):
    extra = [
        (20, "Under the GNU General\nPublic LICENSE; or the apache-license. mit license mit license"),
        (21, "Released under the MIT Licence."), (22, "licensed under the aapache licens version 2.0"), (23, "summit licenses of cc bye"),
        (24, "permission is hereby granted, free of charge, to any persom"), (25, "cc by"),
    ]
    got = {r.doc_id: r for r in license_scan.scan(H.frame(spark, H.EDGES + extra)).collect()}
    for i, text in H.EDGES + extra:
        n, places, labels = H.phrases(text, license_scan.BASE)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(places), min(places, default=None), max(places, default=None), labels), i
        assert 0 <= r.score <= 1 and set(filter(None, labels.split(","))) <= set(r.labels.split(",")) | {""}
    assert got[20].n_base == 4 and got[20].base_labels == "apache,gpl,mit"
    assert got[21].n_base == 0 and "mit" in got[21].labels and got[21].spans[0].edits == 1
    assert "apache" in got[22].labels and got[23].labels == "" and got[23].score == 0 and "mit" in got[24].labels
    assert license_scan.scan(nothing).count() == 0


def test_licence_seeds_miss_nothing():
    """Every edit of a notice within its bound is found."""
    scanner = license_scan.Scanner(license_scan.BASE, license_scan.NOTICES)
    rng = np.random.default_rng(3)
    for phrase, label, edits in license_scan.NOTICES:
        for _ in range(20):
            text = list(phrase)
            for _ in range(edits):
                at = int(rng.integers(1, len(text) - 1))
                kind = rng.integers(3)
                if kind == 0:
                    text[at] = "q"
                elif kind == 1:
                    del text[at]
                else:
                    text.insert(at, "q")
            _, _, spans = scanner.scan(("so " + "".join(text) + " it is").encode())
            assert label in {s[0] for s in spans}, "".join(text)


# ---------------------------------------------------------------- 2


def test_bpe(spark, edges, nothing, library):
    got = {r.doc_id: r for r in byte_bpe.digests(edges).collect()}
    for i, text in H.EDGES:
        ids = library.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), i
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.digests(nothing).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.PrefixEncoder(byte_bpe.read_ranks(Path(public_tokenizers.path(byte_bpe.RANKS)).read_bytes())), byte_bpe.Splitter(public_tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "aa", "ab", " ", "  ", "\n", "the", "'", "re", "s", "é", "日", "1", "!", "\x1c", "\U0001F600"]), max_size=24), st.data())
def test_prefixes(encoder, library, parts, data):
    text = "".join(parts)
    held = byte_bpe.EncodedText(*encoder, text)
    assert held.ids == library.encode_ordinary(text)
    more = data.draw(st.sampled_from(["", "e", "the", " ", "'s"]))
    held.append(more)
    text += more
    assert held.ids == library.encode_ordinary(text)
    begin = data.draw(st.integers(0, len(text)))
    end = data.draw(st.integers(begin, len(text)))
    held.replace(begin, end, "x y")
    assert held.ids == library.encode_ordinary(text[:begin] + "x y" + text[end:])


def test_splitter_characters(encoder, library):
    """Each code point is cut as the library cuts it."""
    own, split = encoder
    for block in range(0, 0x3000, 64):
        text = "".join(f"a{chr(c)}b {chr(c)}1" for c in range(block, block + 64) if not 0xD800 <= c < 0xE000)
        assert [t for p in split(text) for t in own.encode(p.encode())] == library.encode_ordinary(text), hex(block)


def test_small_vocabulary():
    """Encoding by prefixes equals merging by rank, on a vocabulary with many ties."""
    ranks = {bytes([b]): b for b in range(256)}
    for token in (b"aa", b"ab", b"aaa", b"ba", b"aab", b"abab", b"bb", b"aaaa"):
        ranks[token] = len(ranks)

    def merge(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not found:
                return [ranks[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    own, rng = byte_bpe.PrefixEncoder(ranks), np.random.default_rng(0)
    for _ in range(500):
        data = bytes(rng.choice([97, 98], rng.integers(0, 14)).tolist())
        assert own.encode(data) == merge(data), data
    assert base64.b64encode(b"aa") == b"YWE="


# ---------------------------------------------------------------- 3


def test_near_duplicates(spark, edges, nothing):
    got = {r.doc_id: r for r in minmax_dedup.near_duplicates(edges).collect()}
    want = H.near_duplicates(H.EDGES)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items()) and got[4].component_id == 1 and got[13].component_id == 12
    assert minmax_dedup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("limits", [(512, 1 << 18), (9, 1 << 18), (512, 700)])
def test_groups_of_edited_copies(spark, monkeypatch, limits):
    """Copies at several distances from one text, where only some pairs link; also in many blocks."""
    monkeypatch.setattr(minmax_dedup, "BLOCK", limits[0])
    monkeypatch.setattr(minmax_dedup, "BLOCK_SHINGLES", limits[1])
    rng, rows = np.random.default_rng(2), []
    words = [f"w{i}" for i in range(120)]
    for i in range(160):
        own = list(words)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            own[at] = f"e{rng.integers(1000)}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax_dedup.near_duplicates(H.frame(spark, rows)).collect()}
    assert got == H.near_duplicates(rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, H.BASE), (1, H.BASE), (1, H.BASE), (2, H.BASE)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(H.frame(spark, rows)).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]
    cut = sorted(((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(H.frame(spark, rows)).collect()), key=str)
    assert cut == [(1, 0), (1, 0), (2, 120), (None, 0)]


def test_tile_labels():
    sets = [np.arange(0, 100, dtype=np.int64), np.arange(5, 105, dtype=np.int64), np.arange(10, 110, dtype=np.int64), np.arange(500, 600, dtype=np.int64)]
    assert minmax_dedup.joined(np.array([7, 3, 5, 9]), sets, 85).tolist() == [3, 3, 3, 9]
    assert minmax_dedup.joined(np.array([7, 3, 5, 9]), sets, 85, 2).tolist() == [7, 3, 3, 9]
    assert minmax_dedup.joined(np.array([7, 3, 5, 9]), sets, 85, 1).tolist() == [3, 3, 5, 9]


# ---------------------------------------------------------------- 4


def test_repeats(spark, edges, nothing):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(edges).collect()}
    assert got == H.without_repeats(H.EDGES)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_repeats_at_random(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "c"], 60))) for i in range(30)]
    rows += [(100 + i, rows[i][1][20:90] + " z " + rows[i + 1][1][5:70]) for i in range(20)]
    want = H.without_repeats(rows)
    read = lambda: {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(H.frame(spark, rows)).collect()}
    assert read() == want
    monkeypatch.setattr(substring_dedup, "SHARD_PASSAGES", 1)  # every anchor is hot
    assert read() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=12), min_size=1, max_size=5), st.lists(st.sampled_from("ab"), max_size=14), st.integers(1, 4))
def test_automaton(texts, asked, n):
    automaton = substring_dedup.SuffixAutomaton()
    for label, text in enumerate(texts):
        automaton.add(text, label)
    automaton.finish()
    want = []
    for i in range(len(asked) - n + 1):
        window = asked[i : i + n]
        want.append(min((label for label, text in enumerate(texts) if any(text[j : j + n] == window for j in range(len(text) - n + 1))), default=float("inf")))
    assert automaton.first_labels(asked, n) == want


def test_reference_shards(spark, nothing, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 40)  # reference texts are cut, with overlaps
    docs = H.frame(spark, [(1, "x " + H.BASE + " y"), (2, H.FAR), (3, None), (None, H.BASE), (1, "x " + H.BASE + " y")])
    reference = H.frame(spark, [(7, H.BASE), (8, H.FAR[:60]), (9, None), (10, "")])
    for words in (200_000, 60):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_reference(docs, reference, shard_words=words).collect()), key=str)
        assert got == sorted([(1, 122, 120, "x y"), (1, 122, 120, "x y"), (2, 120, 0, H.FAR), (3, 0, 0, ""), (None, 120, 120, "")], key=str)
    assert [r.n_removed for r in substring_dedup.remove_reference(docs, nothing).collect()] == [0] * 5
    assert substring_dedup.remove_reference(nothing, reference).count() == 0


# ---------------------------------------------------------------- 5


def test_contamination(spark, edges, nothing):
    items = [(1, " ".join(H.BASE.split()[10:50])), (2, H.LONG[5000:5400]), (3, "one two"), (4, None), (5, ""), (6, "nowhere to be found in any of the documents")]
    partly = " ".join(H.BASE.split()[10:46])
    rows = H.EDGES + [(30, "before " + partly + " after"), (31, " ".join(H.BASE.split()[10:35]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = H.containment(rows, items)
    for broadcast in (500_000, 0):
        got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contaminated(H.frame(spark, rows), bench, broadcast_rows=broadcast).collect()}
        assert got == want, broadcast
    assert {d for d, *_ in want} >= {1, 2, 3, 4, 12, 15, 30} and 31 not in {d for d, *_ in want}
    assert decontaminate.contaminated(nothing, bench).count() == 0 == decontaminate.contaminated(edges, bench.limit(0)).count()


def test_short_items_inside_documents(spark):
    items = [(1, "alpha beta"), (2, "Gamma"), (3, "one two three four")]
    rows = [(1, "x y z alpha-beta q r s t"), (2, "beta alpha beta"), (3, "beta alpha one two three"), (4, "a b c gamma one TWO three, four five"), (5, "gammas alphabeta"), (6, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for broadcast in (500_000, 0):
        got = {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contaminated(H.frame(spark, rows), bench, broadcast_rows=broadcast).collect()}
        assert got == {(1, 1, 1), (2, 1, 1), (4, 2, 1), (4, 3, 1)}, broadcast


def test_contamination_with_repeated_ids(spark):
    """Rows and items that share an id are judged one by one, whether signatures are broadcast or not."""
    w = H.BASE.split()
    items = [(1, " ".join(w[:24])), (1, " ".join(w[40:64])), (2, " ".join(w[:24])), (None, " ".join(w[70:90]))]
    rows = [(1, " ".join(w[:16])), (1, " ".join(w[12:24])), (2, " ".join(w[:20] + ["x"] + w[44:64])), (3, H.BASE), (None, " ".join(w[:24])), (None, "clean")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for broadcast in (500_000, 0):
        got = sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contaminated(H.frame(spark, rows), bench, broadcast_rows=broadcast).collect()), key=str)
        want = {(2, 1, 20, 16), (2, 2, 20, 16), (3, 1, 20, 20), (3, 2, 20, 20), (3, None, 16, 16), (None, 1, 20, 20), (None, 2, 20, 20)}
        assert got == sorted(want, key=str), broadcast


# ---------------------------------------------------------------- 7


def test_language_model(spark, nothing):
    rng = np.random.default_rng(7)
    sound = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "mat", "and", "dog"], 40))
    rows = [(i, sound()) for i in range(60)] + [(100, "zzq xkcd!! 77%% $$$ qqq ((("), (101, None), (102, "")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(100, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.quality(H.frame(spark, rows), labels).collect()}
    assert not got[100].kept and got[100].perplexity > 5 * got[55].perplexity and sum(got[i].kept for i in range(60)) >= 54
    assert got[101].perplexity is None and not got[101].kept and not got[102].kept
    assert kneser_ney.quality(nothing, labels).count() == 0
    uniform = kneser_ney.quality(H.frame(spark, rows), labels.limit(0)).collect()
    assert all(r.perplexity is None or abs(r.perplexity - kneser_ney.SYMBOLS) < 1e-3 for r in uniform)


def test_word_model(spark):
    """Perplexities against the formula over words, term by term; each of many languages has its own model."""
    from collections import Counter

    rng = np.random.default_rng(5)
    words = ["été", "èté", "cat", "sat", "on", "日本", "本日", "mat"]
    rows = [(i, f"l{i % 40}" if i >= 60 else "en", " ".join(rng.choice(words, 30))) for i in range(180)]
    rows += [(1000, "xx", "cat sat on"), (1001, "en", "été cat"), (1002, "en", "éta cat, unseen"), (1003, "en", " \n ")]
    labels = spark.createDataFrame([(i, 1) for i in range(180)], "doc_id bigint, quality int")
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    got = {r.doc_id: r for r in kneser_ney.quality(docs, labels, shard=2000, passes=2).collect()}
    held = {r.doc_id for r in docs.where("lang = 'en' and doc_id < 180").where(kneser_ney.held_out()).collect()}
    assert held and len({r.threshold for r in got.values() if r.lang == "en"}) == 1
    assert max(got[i].perplexity for i in held) == pytest.approx(got[0].threshold)
    assert len(got) == len(rows) and got[1003].perplexity is None and got[1000].perplexity > 1

    def cuts(counts):
        often = Counter(counts.values())
        y = often[1] / max(often[1] + 2 * often[2], 1)
        return [min(max(i - (i + 1) * y * often[i + 1] / max(often[i], 1), 0.1), i - 0.1) for i in (1, 2, 3)]

    def model(texts, base):
        counts = {3: Counter(g for t in texts for g in zip(["^", "^", *t], ["^", *t], t))}
        for k in (2, 1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        cut = {k: cuts(c) for k, c in counts.items()}

        def p(k, g):
            if k == 0:
                return base(g)
            after = [v for x, v in counts[k].items() if x[:-1] == g[-k:-1]]
            if not after:
                return p(k - 1, g)
            own = counts[k].get(g[-k:], 0)
            return (own - cut[k][min(own, 3) - 1] if own else 0) / sum(after) + sum(cut[k][min(v, 3) - 1] for v in after) / sum(after) * p(k - 1, g)

        return p

    def perplexity(lang, text):
        texts = [kneser_ney_words(t) for j, x, t in rows[:180] if lang in (x, "*") and j not in held]
        codes = lambda w: [int(c) for c in kneser_ney.grams(np.frombuffer((w + " ").encode(), np.uint8), np.array([0, len(w.encode()) + 1]))[0]]
        counts = {4: Counter(c for t in texts for w in t for c in codes(w))}
        size = kneser_ney.SYMBOLS
        for k in (3, 2, 1):
            counts[k] = Counter(c % size**k for c in counts[k + 1])
        cut = {k: cuts(c) for k, c in counts.items()}

        def symbol(k, c):
            if k == 0:
                return 1 / size
            c %= size**k
            after = [v for x, v in counts[k].items() if x // size == c // size]
            if not after:
                return symbol(k - 1, c)
            own = counts[k].get(c, 0)
            return (own - cut[k][min(own, 3) - 1] if own else 0) / sum(after) + sum(cut[k][min(v, 3) - 1] for v in after) / sum(after) * symbol(k - 1, c)

        p = model(texts, lambda g: np.prod([symbol(4, c) for c in codes(g[-1])]))
        t = kneser_ney_words(text)
        logs = [np.log(p(3, g)) for g in zip(["^", "^", *t], ["^", *t], t)]
        return np.exp(-sum(logs) / sum(len(w.encode()) + 1 for w in t))

    for i, lang in ((0, "en"), (100, "l20"), (179, "l19"), (1000, "*"), (1001, "en"), (1002, "en")):
        text = next(t for j, _, t in rows if j == i)
        assert got[i].perplexity == pytest.approx(perplexity(lang, text), rel=1e-3), i


def test_shards_turns_and_common_words_change_nothing(spark):
    """One shard against many, with words and pairs of several shards and ends that are joined instead of broadcast."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(200)]
    text = lambda: " ".join(x for _ in range(15) for x in ("the", "of", *rng.choice(words, 2)))
    rows = [(i, ["en", "de", None, "*"][i % 4], text() if i % 9 else "never seen " + text()) for i in range(200)]
    rows += [rows[3], (3, "*", text()), (None, "fr", text()), (300, "en", None), (301, "", ""), (302, None, " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(5, 0), (None, 1)], "doc_id bigint, quality int")
    by = lambda **o: sorted(((r.doc_id, r.lang, r.perplexity and round(r.perplexity, 4), r.threshold and round(r.threshold, 4), r.kept) for r in kneser_ney.quality(docs, labels, **o).collect()), key=str)
    plain = by(passes=1)
    assert len(plain) == len(rows) and {r[1] for r in plain} == {"en", "de", "", "*", "fr"}
    assert plain == by(shard=2500, passes=2, known=20, sample=1)
    assert plain == by(shard=2500, passes=1, known=0, sample=1)


def test_shards_follow_the_trusted_text():
    """Shards that only stream text are few, so that packs of n-grams aren't cut too small; none counts too much."""
    of = lambda size, trusted: kneser_ney.shards_of(size, trusted, 8)
    assert of(0, 0) == 1 and of(80, 8) == 10 and of(800, 80) == kneser_ney.SPREAD
    assert of(8000, 800) == 8000 // (8 * kneser_ney.STREAMED) == 125
    assert of(8000, 8000) == 1000


def test_packed_arrays():
    columns = [np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.uint16), np.array([1.5, -2.0], np.float32)]
    back = kneser_ney.unpack(kneser_ney.pack(*columns))
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(columns, back))
    assert [len(x) for x in kneser_ney.unpack(kneser_ney.pack(np.zeros(0, np.int64)))] == [0]


def test_each_language_has_its_own_model(spark):
    """40 languages with the same trusted text: the same model, so the same perplexity, in all of them."""
    rows = [(i, f"l{i:02}", "the cat sat on the mat and the dog sat on the cat") for i in range(40)]
    docs = spark.createDataFrame([*rows, (50, "l39", "the dog sat on the mat"), (51, "l00", "the dog sat on the mat")], "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, quality int")
    got = {r.doc_id: r.perplexity for r in kneser_ney.quality(docs, labels).collect()}
    assert len(got) == 42 and [got[i] for i in range(40)] == pytest.approx([got[0]] * 40) and got[50] == pytest.approx(got[51])


def test_kneser_ney_places():
    """Keys are found where halving finds them, and bytes are classed and folded as the tables say."""
    rng = np.random.default_rng(3)
    ends = np.array([-(2**63), 2**63 - 1])
    for n in (0, 1, 2, 1000):
        for low, high in ((-(2**63), 2**63 - 1), (5, 5 + 4 * n + 1)):  # spread, and all in one place
            keys = np.unique(rng.integers(low, high, n))
            wanted = np.concatenate([keys, rng.integers(low, high, 500), ends])
            at, seen = kneser_ney.Places(keys)(wanted)
            assert (seen == np.isin(wanted, keys)).all() and (keys[at[seen]] == wanted[seen]).all()
            assert (at < max(1, n)).all()
    every = np.arange(256, dtype=np.uint8)
    assert (common.alnum(every) == common.ALNUM).all()
    assert (common.word_hashes(every, every[:-1].astype(int), every[1:].astype(int), True) == common.word_hashes(common.FOLD[every], every[:-1].astype(int), every[1:].astype(int), False)).all()
    # A row doesn't see the one before it, however short they are.
    data, offs = np.frombuffer(b"ab cdef ", np.uint8), np.array([0, 0, 1, 2, 8, 8])
    alone = [kneser_ney.grams(data[a:b], np.array([0, b - a]))[0] for a, b in zip(offs, offs[1:])]
    assert (kneser_ney.grams(data, offs)[0] == np.concatenate(alone)).all()


def test_kneser_ney_workers_hold_little():
    """A spelling model keeps the rows of its contexts only and gives what the whole table does; trigrams are summed without many copies."""
    import tracemalloc

    rng = np.random.default_rng(11)
    size, contexts = kneser_ney.SYMBOLS, kneser_ney.SYMBOLS ** (kneser_ney.ORDER - 1)
    codes = np.arange(contexts * size)
    for seen in (np.zeros(0, np.int64), rng.choice(contexts, 5000, replace=False), np.arange(contexts)):
        rows = np.tile(rng.random((contexts // size, size), np.float32), (size, 1))
        rows[seen] = rng.random((len(seen), size), np.float32)
        log_p, shift = kneser_ney.compact(rows.reshape(-1), seen)
        assert (log_p[codes + shift[codes // size]] == rows.reshape(-1)).all()
        assert len(log_p) <= (len(seen) + contexts // size) * size
    words = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    parts = [[rng.integers(0, 300, 50_000).astype(np.uint16) for _ in range(3)] + [rng.integers(1, 9, 50_000).astype(np.uint16)] for _ in range(4)]
    y, x, z, c = (np.concatenate([p[i] for p in parts]) for i in range(4))
    want = kneser_ney.key(words[x], words[y], words[z])
    keys, at, where = np.unique(want, return_index=True, return_inverse=True)
    blobs = [[np.diff(words, prepend=np.uint64(0)), *p] for p in parts]
    tracemalloc.start()
    got = kneser_ney._trigrams(blobs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for mine, theirs in zip(got, (keys, words[x][at], words[y][at], words[z][at], np.bincount(where, c).astype(int)), strict=True):
        assert (mine == theirs).all()
    assert most < 100 * len(y)  # it was 129 bytes for each n-gram
    keys, totals, number = kneser_ney._totals(want[:0], c[:0])
    assert not len(keys) and totals.shape == (0, 4) and not len(number)
    keys, totals, number = kneser_ney._totals(want % 50, c)
    assert (keys[number] == want % 50).all()
    mine = c[number == 3]
    assert totals[3].tolist() == [mine.sum(), (mine == 1).sum(), (mine == 2).sum(), (mine > 2).sum()]


def kneser_ney_words(text):
    import re

    return re.findall(r"[a-z0-9\x80-\U0010ffff]+|[^\x00-\x20]", text)


def test_kneser_ney_numbers(spark):
    """Probabilities against the formula, computed term by term from the text's counts."""
    from collections import Counter

    from cadenza.llm.common import Workspace

    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcab "), 3000))
    n, size = kneser_ney.ORDER, kneser_ney.SYMBOLS
    code, _ = kneser_ney.grams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    rows = [("en", int(c), int(k)) for c, k in Counter(code.tolist()).items()]
    table = kneser_ney.estimate(spark.createDataFrame(rows, "lang string, code bigint, c bigint"), Workspace(spark)).toPandas()
    log_p = kneser_ney.assemble(table.n.to_numpy(), table.code.to_numpy(), table.alpha.to_numpy(float), table.gamma.to_numpy(float))
    counts = {n: Counter(code.tolist())}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(c % size**k for c in counts[k + 1])

    def p(k, c):
        if k == 0:
            return 1 / size
        often = Counter(counts[k].values())
        y = often[1] / max(often[1] + 2 * often[2], 1)
        cut = [min(max(i - (i + 1) * y * often[i + 1] / max(often[i], 1), 0.1), i - 0.1) for i in (1, 2, 3)]
        after = {x: v for x, v in counts[k].items() if x // size == c // size}
        lower = p(k - 1, c % size ** (k - 1))
        if not after:
            return lower
        total = sum(after.values())
        spare = sum(cut[min(v, 3) - 1] for v in after.values())
        own = counts[k].get(c, 0)
        return (own - cut[min(own, 3) - 1] if own else 0) / total + spare / total * lower

    for c in list(counts[n])[:20] + [0, 5, 77]:
        assert np.exp(log_p[c]) == pytest.approx(p(n, c), rel=1e-4)
    assert np.exp(log_p.reshape(-1, size)).sum(axis=1) == pytest.approx(1.0, abs=1e-3)


# ---------------------------------------------------------------- 8


def toxic_rows(seed, n):
    rng = np.random.default_rng(seed)
    plain = [f"{a}{b}" for a in ("ba", "ko", "lu", "mi", "sa") for b in ("rin", "tol", "ved", "gas", "nop")]
    bad = ["vile", "scumlike", "grumba", "grumbo", "grumbi"]
    rows = []
    for i in range(n):
        words, toxic = list(rng.choice(plain, 40)), int(rng.random() < 0.3)
        for at in rng.choice(40, 3, replace=False) if toxic else []:
            words[at] = str(rng.choice(bad))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity(spark, nothing):
    rows = toxic_rows(0, 400)
    docs = H.frame(spark, [(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, H.LONG), (None, "a vile thing")])
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(None, 1, 1), (5000, 0, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity_crf.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity_crf.tag(docs, model).collect()}
    held = [(i, x) for i, _, x in rows if got[i].held_out]
    assert 40 < len(held) < 130 and np.mean([got[i].predicted == x for i, x in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[1000].score == got[1001].score < 0.5 and got[1002].predicted == 0 and not got[None].held_out
    text = dict((i, t) for i, t, _ in rows)
    spans = {w for i, _, x in rows if x for s in got[i].spans for w in text[i][s.begin : s.end].split()}
    assert spans <= {"vile", "scumlike", "grumba", "grumbo", "grumbi"} and len(spans) >= 4
    assert {r.doc_id for r in toxicity_crf.filter_rows(docs, model).collect()} == {i for i, r in got.items() if not r.predicted}
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert all(r.predicted == 0 for r in toxicity_crf.tag(docs, toxicity_crf.fit(docs, some)).collect())
    assert toxicity_crf.tag(nothing, model).count() == 0


def test_marginals():
    """Forward-backward sums against the sum over all labellings."""
    import itertools

    rng = np.random.default_rng(0)
    field = toxicity_crf.Field(moves=rng.normal(size=(2, 2, 2)), constant=None)
    emission, apart = rng.normal(size=6), np.array([0, 1, 0, 0, 1, 0])
    weight = {}
    for y in itertools.product((0, 1), repeat=6):
        weight[y] = np.exp(sum(emission[i] * y[i] for i in range(6)) + sum(field.moves[apart[i], y[i - 1], y[i]] for i in range(1, 6)))
    want = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(6)]
    assert field.marginals(emission, apart) == pytest.approx(want)


def test_sample_is_bounded(spark, monkeypatch):
    """An id that is repeated many times brings no more rows than the sample has; texts beyond the length don't train."""
    rows = toxic_rows(3, 60)
    ids = [i for i, _, x in rows if x]
    repeated = [(ids[0], f"{i} a vile thing") for i in range(300)]
    docs = H.frame(spark, [(i, t) for i, t, _ in rows] + repeated + repeated)
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity_crf, "train", lambda texts, toxic: seen.append((texts, toxic)))
    toxicity_crf.fit(docs, labels, sample_rows=25)
    toxicity_crf.fit(docs, labels, sample_chars=30)
    assert 25 < len(seen[0][0]) <= 50 and all((seen[0][1] == x).sum() <= 25 for x in (0, 1)) and len({*seen[0][0]}) == len(seen[0][0])
    assert all(len(t) <= 30 for t in seen[1][0])


# ---------------------------------------------------------------- 10


def test_token_counts(spark, edges, nothing, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    extra = [(40, "x <|endoftext|> y <|startoftext|>z"), (41, "it's  I'LL \t DON'T 123"), (42, "Å Å"), (43, " " + H.BASE.replace(" ", "  ") + "\n")]
    docs = H.frame(spark, H.EDGES + extra)
    cache = str(tmp_path / "cache")
    first = {r.doc_id: r for r in token_counts.count_tokens(docs, cache=cache).collect()}
    for i, text in H.EDGES + extra:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (first[i].n_bytes, first[i].n_tokens, first[i].over_limit) == (len((text or "").encode()), n, n > 2048), i
    size = spark.read.parquet(cache).count()
    again = {r.doc_id: r for r in token_counts.count_tokens(docs, cache=cache).collect()}
    assert again == first and spark.read.parquet(cache).count() == size == len({(t or "").replace("\t", " ") if i not in (8, 41, 43) else i for i, t in H.EDGES + extra if i not in (6, 7, 8, 16, 43)}) + 1
    assert token_counts.count_tokens(nothing).count() == 0


def test_token_counts_of_other_vocabularies(spark, edges):
    """Files whose rules aren't those of pieces, and sentencepiece, count whole texts as their libraries do."""
    import sentencepiece
    from tokenizers import Tokenizer

    extra = [(50, "  two  spaces\n\n and <|endoftext|> A a <s> </s>\t")]
    docs = H.frame(spark, H.EDGES + extra)
    json_path, model_path = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    one, two = Tokenizer.from_file(json_path), sentencepiece.SentencePieceProcessor(model_file=model_path)
    for path, count in ((json_path, lambda t: len(one.encode(t, add_special_tokens=False).ids)), (model_path, lambda t: len(two.encode(t)))):
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path=path).collect()}
        assert got == {i: count(t or "") for i, t in H.EDGES + extra}


def test_rules_of_a_vocabulary():
    import json

    with open(public_tokenizers.path(token_counts.VOCABULARY), encoding="utf-8") as file:
        own = {k: v for k, v in json.load(file).items() if k != "model"}
    read = lambda **change: token_counts.rules(json.dumps(own | change).encode())
    assert read()[1] == ["<|startoftext|>", "<|endoftext|>"] and read(normalizer=None) is None and read(pre_tokenizer=None) is None
    assert read(added_tokens=[{"content": "x", "normalized": True}]) is None and read(added_tokens=[])[1] == []
    other = json.loads(json.dumps(own["pre_tokenizer"]))
    for pattern in ("a b", r"\s+|a", r"\S+", "(?i:a)", "[^a]+", "."):
        other["pretokenizers"][0]["pattern"]["Regex"] = pattern
        assert read(pre_tokenizer=other) is None, pattern
    assert token_counts.rules(b"\x0a\x0e no json") is None


@pytest.mark.parametrize("broadcast", [10, 0])
def test_hits_are_not_counted_again(spark, tmp_path, broadcast):
    """A cache that has all but one content; copies and hits cost nothing."""
    cache = str(tmp_path / "cache")
    docs = H.frame(spark, H.EDGES)
    first = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, cache=cache).collect()}
    size = spark.read.parquet(cache).count()
    more = H.frame(spark, [*H.EDGES, (60, "a new text"), (61, "a new  text"), (62, H.FAR)])
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(more, cache=cache, broadcast_misses=broadcast).collect()}
    assert got == first | {60: 3, 61: 3, 62: first[5]} and spark.read.parquet(cache).count() == size + 1
    other = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(more, path=public_tokenizers.path("byte_bpe_50k.json"), cache=cache).collect()}
    assert other[60] != other[61]


# ---------------------------------------------------------------- 1, again


def test_places_take_linear_time():
    import time

    scanner = license_scan.Scanner(license_scan.BASE, license_scan.NOTICES)
    begun = time.process_time()
    n, places, _ = scanner.scan(("mit license " * 83_333).encode())
    assert n == 166_666 and len(places) == 83_333 and places[-1][1] == 166_664
    assert time.process_time() - begun < 6  # some hundred times that if each place counted the words before it


def test_an_edit_is_one_of_a_character():
    scanner = license_scan.Scanner({}, (("mozilla public license", "mpl", 1),))
    assert [s[0] for s in scanner.scan("the mözilla public license".encode())[2]] == ["mpl"]
    assert scanner.scan("日本 mozilla public license 日本".encode())[2] == [("mpl", 1, 3, 0)]
    assert not scanner.scan("the mözilla püblic license".encode())[2]
