"""Documents that every operator must cope with, and plain versions of what the operators compute."""

import collections
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, digest int, anchor string"
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows):
    """(doc_id, text) rows as documents, with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in rows], DOCS)


BASE = " ".join(f"word{i} and" for i in range(60))
EDITED = BASE.replace("word30", "other", 1)
FAR = " ".join(f"thing{i} or" for i in range(60))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
EDGES = [
    (1, BASE), (2, BASE), (3, BASE.upper()), (4, EDITED), (5, FAR), (6, None), (7, ""), (8, " \n\t "), (9, "one two"), (10, "One TWO"),
    (11, "three four five six seven"), (12, LONG), (13, LONG + " end"), (14, "é ß 　 日本語 \U0001F600 \x1c\x85 İ"), (15, BASE + "\n" + FAR), (16, None), (17, "x" * 5000),
]


def near_duplicates(rows, percent=85):
    sets = {}
    for i, text in rows:
        w = SPACE_WORDS.findall(fold(text))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def without_repeats(rows, n=13):
    first, words = {}, {}
    for i, text in rows:
        words[i] = SPACE_WORDS.findall(text or "")
        for j in range(len(words[i]) - n + 1):
            key = tuple(words[i][j : j + n])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone[j : j + n] = [True] * n
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def containment(docs, items, share=0.8):
    def grams(text):
        w = [x for x in ALNUM_WORDS.findall((text or "").lower())]
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({("short", *w)} if w else set())

    out = set()
    for i, d in docs:
        for j, b in items:
            q, s = grams(b), grams(d)
            if q and len(q & s) >= share * len(q) - 1e-9:
                out.add((i, j, len(q), len(q & s)))
    return out


def phrases(text, base):
    w = ALNUM_WORDS.findall(fold(text))
    places, labels = [], set()
    for phrase, label in base.items():
        q = phrase.split()
        for j in range(len(w) - len(q) + 1):
            if w[j : j + len(q)] == q:
                places.append(j)
                labels.add(label)
    return len(w), sorted(places), ",".join(sorted(labels))


def counts(rows):
    return collections.Counter(rows)
