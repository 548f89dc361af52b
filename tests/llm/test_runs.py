"""Periodic runs beside a search over all periods of all texts."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from flowgauge.llm import runs as own

rng = random.Random(9)


def plain_runs(words):
    """Every run, by every period from the smallest: the stretches in which words q apart agree."""
    seen = {}
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at < len(words) - q:
            if words[at] != words[at + q]:
                at += 1
                continue
            start = at
            while at < len(words) - q and words[at] == words[at + q]:
                at += 1
            if at + q - start >= max(6, 4 * q):
                seen.setdefault((start, at + q - start), q)
    return sorted((s, n, q) for (s, n), q in seen.items())


def plain_row(doc_id, text, change=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if change and doc_id is not None and h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def hostile():
    """Texts of one-letter words: random ones over few letters, powers, powers of powers, broken powers."""
    out = ["", "a" * 5, "a" * 6, "a" * 300, "ab" * 3, "ab" * 4, "abab" * 5 + "c" + "ab" * 9, fibonacci(300), "aab" * 40 + "aaab" * 40]
    for _ in range(400):
        letters = "abcd"[: rng.randint(1, 4)]
        out.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 90))))
    for _ in range(400):
        u = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        v = (u * rng.randint(1, 9) + rng.choice(["", "c", u[:3]])) * rng.randint(1, 6)
        w = list("".join(rng.choice("abc") for _ in range(rng.randint(0, 20))) + v + v[: rng.randint(0, 9)])
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice("abx")
        out.append("".join(w)[:400])
    u = "".join(rng.choice("ab") for _ in range(37))
    return [*out, u * 9 + "z" + u * 5, ("aaaaaaaab" * 7 + "c") * 6, ("aaaaaaab" * 3 + "b") * 5]


def test_runs_of_hostile_words():
    texts = hostile()
    words = own.Words([" ".join(t).encode() for t in texts])
    doc, start, length, period = own.runs_of(words.ids, words.bounds)
    got = collections.defaultdict(list)
    for d, *run in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[d].append(tuple(run))
    for i, text in enumerate(texts):
        assert got[i] == plain_runs(text), text


def test_wavelet_tree():
    values = np.array([rng.randrange(50) for _ in range(700)])
    tree = own.WaveletTree(values, 6)
    low = np.array([rng.randrange(700) for _ in range(500)])
    high = np.array([rng.randrange(a, 701) for a in low])
    bound = np.array([rng.randrange(70) for _ in range(500)])
    want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(low, high, bound)]
    assert tree.successor(low, high, bound).tolist() == want


def test_words_of_long_texts_are_cut_at_blanks(monkeypatch):
    text = b" ".join(rng.choice([b"a", b"\xc3\xa9" * 9, b"x" * 50]) + rng.choice([b"", b"\n", b"\t "]) for _ in range(500))
    monkeypatch.setattr(own, "CUT", 7)
    assert [w for part in own.words_of(text) for w in part] == text.split()


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["", None, "  \n ", "a", "la " * 200, "x " * 5, "é ü " * 9 + "é", "\x1c\x85 " * 8, "buy now " * 30 + "end",
             " ".join(f"w{i % 700}" for i in range(4000)), "x" * 3_000_000, "do re mi " * 40_000]
    rows = [(i, t, 1, "clash") for i, t in enumerate(texts)] + [(4, texts[4], 1, ""), (None, texts[4], 1, "")]
    rows += [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(200))), 1, "") for i in range(100, 220)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_runs int, period string"), rows


def test_digests(docs):
    df, rows = docs
    small = [r for r in rows if len(r[1] or "") < 30_000]
    got = collections.Counter(tuple(r) for r in own.digests(df).collect())
    assert got.total() == len(rows)
    assert not collections.Counter(plain_row(*r[:2]) for r in small) - got
    long = {r[0]: r for r in got}[11]
    assert zlib.crc32(b"11") % 10 and long[1:6] == (1, 0, 120_000, 3, 40_000_000)
    assert own.digests(df.limit(0)).count() == 0


def test_runs_and_collapsed_text(docs):
    df, _ = docs
    got = {r.doc_id: r for r in own.runs(df).collect()}
    assert got[8].runs == [(0, 60, 2)] and got[8].collapsed == "buy now end"
    assert got[1].runs == [] and got[1].collapsed == "" and own.runs(df.limit(0)).count() == 0


def test_query_beside_plain_search(spark):
    from flowgauge.llm import queries
    from flowgauge.llm.common import table

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        if len(text or "") < 20_000:
            assert got[doc_id] == plain_row(doc_id, text)
