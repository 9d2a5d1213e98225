"""The pipeline's stages on documents with planted cases."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from acequia.llm.piece_encoding import decode_pieces
from acequia.llm.queries import QUERIES, SQL, tokenizer
from compare import database, rows_of_duckdb, rows_of_spark
from conftest import SF_SMALL
from llm_helpers import words


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(5)

    def prose(n):
        return " ".join(f"{rng.choice('abcdefg')}{rng.randrange(3000)}" for _ in range(n))
    rows = [(i, prose(rng.randrange(30, 200)), "en", rng.choice(["a", "b", None]), 0) for i in range(80)]
    rows += [(100 + i, rows[0][1].upper(), "en", "a", 0) for i in range(12)]
    base = rows[1][1].split() + prose(150).split()
    for i in range(15):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"n{i}"
        rows.append((200 + i, " ".join(copy), "en", "b", 0))
    rows += [(300, None, "en", "a", 0), (301, "", None, "a", 0), (302, "same words " * 40, "en", "a", 0), (None, prose(50), "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_take_effect(spark, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs, outs = documents, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        outs.append(docs)
    quality, exact, near, mixed, pieces = outs
    assert len(names) == 5 and all(o.columns == documents.columns for o in outs[:4])
    kept = {r.doc_id for r in quality.collect()}
    assert {300, 301, 302}.isdisjoint(kept) and {*range(80), *range(100, 112), *range(200, 215), None} == kept
    kept = {r.doc_id for r in exact.collect()}
    assert {0, *range(100, 112)} & kept == {111} and len(kept) == 80 + 15 + 1
    kept = {r.doc_id for r in near.collect()}
    assert set(range(200, 215)) & kept == {200} and len(kept) == 82
    size = {r.doc_id: len(words(r.text)) for r in near.collect()}
    taken = Counter(r.doc_id for r in mixed.collect())
    assert set(taken) <= set(size) and max(taken.values()) <= 2
    total = sum(size[i] * n for i, n in taken.items())
    assert abs(total - 1.5 * sum(size.values())) <= 3 * max(size.values())
    texts = {r.doc_id: r.text for r in near.collect()}
    decoded = decode_pieces(pieces, tokenizer("piece_bpe_32k.model")).collect()
    assert Counter(r.doc_id for r in decoded) == taken and all(r.text == texts[r.doc_id] for r in decoded)


def test_run_over_a_sample(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert rows and {"doc_id", "ids", "score", "n_chunks"} == set(rows[0].asDict())


def test_empty_documents(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    names, got = rows_of_spark(QUERIES[name](spark, SF_SMALL))
    expected_names, _, expected = rows_of_duckdb(database(SF_SMALL), SQL[name])
    assert names == expected_names and got == expected


def test_every_operator_has_a_query():
    assert [f"op{n}_" for n in range(1, 14)] == sorted({f"{k.split('_')[0]}_" for k in QUERIES}, key=lambda k: int(k[2:-1]))


def test_a_step_lets_go_what_others_left_in_its_worker():
    """Workers serve all steps, also idle, so what a task keeps counts against steps that have no use for it."""
    import numpy as np
    import pyarrow as pa

    from acequia.llm import piece_encoding, quality_rules, words as arrays
    from acequia.llm.shared import lean

    model = tokenizer("piece_bpe_32k.model")
    encoder = piece_encoding.slice_encoder(model)

    def later(batches):
        yield from batches
    later.__module__ = piece_encoding.__name__
    assert list(lean(later)(iter([]))) == [] and piece_encoding.slice_encoder(model) is encoder
    texts = [f"text {i} " * 9 for i in range(2 * quality_rules.ROWS + 1)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    found = list(lean(quality_rules._with_hash)(iter([batch])))
    assert [b.num_rows for b in found] == [quality_rules.ROWS, quality_rules.ROWS, 1]
    assert [x for b in found for x in b.column("text").to_pylist()] == texts
    whole = np.concatenate([b.column("acequia_hash").to_numpy() for b in found])
    s = next(arrays.slices(pa.array(texts), 1 << 30))
    assert (whole == arrays.Prefix(arrays.byte_values(s.buf)).of(s.at[:-1], s.at[1:]).view(np.int64)).all()
    assert piece_encoding.slice_encoder(model) is not encoder
    list(lean(quality_rules._with_hash)(iter([batch])))
    assert not arrays._powers
