"""Alignment of two tokenizers beside plain loops over the libraries' own ids."""

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowgauge.llm import align, queries
from flowgauge.llm.common import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "a", "  two  spaces ", "Hello, world! don't <|endoftext|> </s> <s><unk>x", "tab\tand\nline\r\n\nend ", "ünïcödé ß 日本語 🙂 é",
         "a▁b", "x" * 3000, "\x00\x1f\x85\xa0  wide", "1234567 3.14 --- ....", "ﬁ ﬂ Å Å", "word " * 50, "#" * 70, "naïve‍café ﻿"]
SCHEMA = "doc_id long, text string, n_a string, links string"


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    names = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table_ = {chr(x): x for x in names} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in names)}
    bytes_a = lambda i: bytes(table_[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, bytes_a, bytes_b


def plain(docs, sides):
    """One row per document: both token lists, cut at every byte where tokens of both end."""
    a, b, bytes_a, bytes_b = sides
    made, pairs = [], collections.Counter()
    for doc_id, text in docs:
        spaced = (" " + (text or "")).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text) if text else []
        if not text or b"".join(map(bytes_a, ids_a)) != spaced or b"".join(map(bytes_b, ids_b)) != spaced:
            made.append((doc_id, [], [], []))
            continue
        ends = []
        for ids, of in ((ids_a, bytes_a), (ids_b, bytes_b)):
            at, own = 0, {}
            for k, i in enumerate(ids):
                at += len(of(i))
                own[at] = k + 1
            ends.append(own)
        groups, i, j = [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            groups.append((ids_a[i : ends[0][end]], ids_b[j : ends[1][end]]))
            i, j = ends[0][end], ends[1][end]
        pairs.update((g[0][-1], g[1][-1]) for g in groups)
        made.append((doc_id, ids_a, ids_b, groups))
    top = collections.defaultdict(int)
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    out = collections.Counter()
    for doc_id, ids_a, ids_b, groups in made:
        counts = [(pairs[g[0][-1], g[1][-1]], top[g[1][-1]]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[doc_id, len(ids_a), len(ids_b), len(groups), len(groups), sum(n == t for n, t in counts), sum(n for n, _ in counts),
            hashlib.sha256(text.encode()).hexdigest() if groups else ""] += 1
    return out


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_linked_equals_plain_loops(spark, sides):
    docs = list(enumerate(TEXTS)) + [(5, TEXTS[5]), (None, TEXTS[5]), (99, "long word soup, ünd mehr. " * 8000)]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], SCHEMA).repartition(3)
    got = rows(align.linked(df, A, B))
    assert got == plain(docs, sides) and sum(r[1] > 0 for r in got) > 10
    assert align.linked(df.limit(0), A, B).count() == 0


def test_windows_do_not_depend_on_what_is_remembered(monkeypatch, sides):
    monkeypatch.setattr(align, "REMEMBERED", 2_000)
    made = align.Aligner(A, B)
    one = list(made.documents(TEXTS))
    assert list(made.documents(TEXTS)) == one and made.held <= 20_000
    encoded = zip(*(side.encode([t or "" for t in TEXTS]) for side in made.sides))
    whole = [made.aligned(a.tolist(), b.tolist()) if n else ("", b"") for (a, b), (n, *_) in zip(encoded, one)]
    assert whole == [(groups, links) for _, _, groups, links in one]


def test_pairs_are_bounded_by_the_vocabularies():
    assert align.possible_pairs([b"ab", b"b", b"b"], [b"b", b"cab", b"x"]) == 1 + 2 + 1 + 2
    made = align.aligner(A, B)
    assert align.possible_pairs(*(s.bytes for s in made.sides)) < 400_000


def test_query_on_its_table(spark, sides):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_token_alignment"](spark, sf)
    assert rows(got) == plain(docs, sides) and got.where(F.col("n_best") < F.col("n_links")).count()


def test_each_piece_is_encoded_once(monkeypatch, sides):
    made, sent = align.Aligner(A, B), []
    for side, name in ((made.sides[0].encoder, "batch"), (made.sides[1], "ids")):
        monkeypatch.setattr(side, name, lambda words, f=getattr(side, name): sent.extend(words) or f(words))
    texts = [f"word soup, ünd\nmehr {i % 3}" for i in range(600)]
    got = list(made.documents(texts))
    assert sum(map(len, sent)) < 100 and made.sides[1].splits
    assert got[:3] * 200 == got and [r[:2] for r in got[:2]] == [
        (len(sides[0].encode(" " + t).ids), len(sides[1].encode(t))) for t in texts[:2]]


def test_a_model_that_joins_words_encodes_whole_texts():
    made, whole = align.Aligner(A, B), align.Aligner(A, B)
    whole.sides[1].splits = False
    assert list(made.documents(TEXTS)) == list(whole.documents(TEXTS))
