"""The registered queries beside their SQL, and the pipeline's stages beside their operators."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from flowgauge.llm import queries, toxicity
from flowgauge.llm.common import table, written
from tools.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, SF), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == names and set(after) <= set(before)
        assert name == "secret_scans" or all(before[d] == t for d, t in after.items())
        sizes.append(len(after))
    assert sizes[0] > sizes[2] and sizes[2] == sizes[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_stages_take_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, SF, "documents").limit(0), SF).count() == 0


def test_last_stage_makes_sequences(spark):
    docs = table(spark, SF, "documents").limit(40)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for r in docs.collect()}
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    held, made = defaultdict(bytes), defaultdict(bytes)
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        held[r.doc_id] += bytes(r.ids)
    assert held == want
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert len(made[r.sequence_id]) == 4 * r.offset and len(r.ids) == 4 * r.length
        made[r.sequence_id] += bytes(r.ids)
    assert all(0 < len(ids) <= 4 * 2048 for ids in made.values())


def test_no_two_near_copies_stay(spark):
    docs = table(spark, SF, "documents")
    kept = written(corpus_pipeline.near_duplicates(spark, docs, SF), "kept")
    sets = {}
    for r in kept.collect():
        w = "".join(c.lower() if c.isascii() else c for c in r.text or "").split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    big = [s for s in sets.values() if len(s) > 20]
    assert not any(len(a & b) * 100 >= 80 * len(a | b) for i, a in enumerate(big) for b in big[:i])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.classified(table(spark, sf, "documents"), table(spark, sf, "labels")).join(
        table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9
