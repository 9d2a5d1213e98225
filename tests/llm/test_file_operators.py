"""Token files, WARC fixity and piece encoding: exact round trips and planted damage."""

import glob
import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from acequia.llm import piece_encoding as pe
from acequia.llm.piece_encoding import decode_pieces, encode_pieces
from acequia.llm.queries import QUERIES, tokenizer
from acequia.llm.shared import new_path
from acequia.llm.token_coder import _shape, decode_block, encode_block
from acequia.llm.token_files import WordEncoder, token_files, word_encoder
from acequia.llm.warc_fixity import _inflate, audit, merkle_tree, read_records, warc_fixity, write_warc
from acequia.llm.words import slices
from conftest import SF_SMALL
from llm_helpers import by_id, table  # noqa: F401

ODD = ["", None, " ", "\n\n", "Hello  world", "<|endoftext|> x", "été\u0301 e\u0301", "a" * 5000, "中文 字", "\x85\x1c\xa0y", "ΑΣ ΣΑΣ", "it's 'Tis 12ab", "😀\u200d👍", "▁ ▁▁x ▁"]

# -- Token files ------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 511, 5000, 70_001])
@pytest.mark.parametrize("kind", ["random", "same", "text"])
def test_block_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"random": rng.integers(0, 49408, n), "same": np.full(n, 49407), "text": rng.zipf(1.3, n) % 3000}[kind]
    block = encode_block(ids, 49408)
    assert (decode_block(block) == ids).all()
    if kind == "same" and n > 10_000:
        assert len(block) < n / 10


def test_repeated_contexts_are_learnt():
    ids = np.tile(np.random.default_rng(1).integers(0, 49408, 300), 200)
    assert len(encode_block(ids, 49408)) < len(ids) * 0.6


def test_large_blocks_take_few_steps():
    """A step of numpy calls costs much the same for any number of lanes."""
    ids = np.random.default_rng(2).zipf(1.2, 300_000) % 49408
    lanes, steps = _shape(len(ids))
    assert steps < 100 and lanes * steps >= len(ids)
    assert (decode_block(encode_block(ids, 49408)) == ids).all()


def test_a_worker_remembers_parts_of_earlier_tasks():
    encoder = word_encoder(tokenizer("word_bpe_49k.json"))
    (s,) = slices(pa.array(["remembered words, of an earlier task"]))
    ids, _ = encoder.encode(s)
    known = encoder.used
    again = word_encoder(tokenizer("word_bpe_49k.json"))
    (s,) = slices(pa.array(["words of an earlier task, remembered"]))
    assert again is encoder and sorted(again.encode(s)[0]) == sorted(ids)
    assert again.used == known


def test_words_before_marks_are_plain_parts():
    """They skip the tokenizer's normaliser, and a slice's new plain parts are encoded in one call."""
    from tokenizers import Tokenizer

    encoder, calls = WordEncoder(tokenizer("word_bpe_49k.json")), []
    marks = [chr(b) for b in range(33, 127) if not chr(b).isalnum()]
    words = [w + m * n for w in ("Word", "Été", "don't", "it's", "x9", "") for m in marks for n in (1, 3)] + ["<|endoftext|>", "a<|endoftext|>"]
    whole = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    fast = encoder._fast
    encoder._fast = lambda t: lambda texts, **k: calls.append((t, len(texts))) or fast(t)(texts, **k)
    (s,) = slices(pa.array([" ".join(words)]))
    assert encoder.encode(s)[0].tolist() == whole.encode(" ".join(words), add_special_tokens=False).ids
    odd = [n for t, n in calls if t is encoder.tokenizer]
    assert [n for t, n in calls if t is encoder.plain] == [1] and odd[0] < len(words) * 0.7
    calls.clear()
    (s,) = slices(pa.array(["new*** words|| before## marks%%"]))
    encoder.encode(s)
    assert [t for t, _ in calls] == [encoder.plain]


def test_damage_is_found():
    block = bytearray(encode_block(np.arange(5000) % 700, 1000))
    for at in (len(block) - 3, 40, 30):
        block[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            decode_block(bytes(block))
        block[at] ^= 1
    decode_block(bytes(block))


def test_token_files(table):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [*ODD, *(" ".join(rng.choice(["the", "Of", "tion's", "x9", "é"]) + str(rng.randrange(60)) for _ in range(rng.randrange(80)))
                     for _ in range(300)), " ".join(f"long{i}" for i in range(40_000))]
    ids = rng.sample(range(-500, 5000), len(texts))
    docs = table([(i, t, "s") for i, t in zip(ids, texts, strict=True)]).repartition(5)
    path = tokenizer("word_bpe_49k.json")
    got, at = by_id(token_files(docs, path, 2)), 0
    reference = Tokenizer.from_file(path)
    for i, text in sorted(zip(ids, texts, strict=True), key=lambda x: x[0]):
        expected = [*reference.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[i].start == at and np.frombuffer(got[i].ids, "<u4").tolist() == expected, (i, text)
        at += len(expected)
    assert token_files(table([]), path, 2).count() == 0
    twice = token_files(table([(1, "a", "s"), (1, "a", "s"), (None, "b c", "s")]), path, 2).collect()
    assert sorted((r.doc_id is not None, r.start) for r in twice) == [(False, 0), (True, 3), (True, 5)]


# -- WARC fixity ------------------------------------------------------------------

@pytest.fixture
def pages(spark):
    rows = [(i, f"http://h{i % 7}.org/{i}\r\n", f"<p>{i}\r\n\r\nWARC/1.1 é {'x' * (i % 50)}") for i in range(90)]
    rows += [(None, "http://n/", "no id"), (200, None, None), (201, "", ""), (202, "u", "y" * 300_000), (5, "http://h5.org/5", "<p>twin")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS part", "2 AS file", "3 AS hash").repartition(3)


def replicas(spark, pages):
    paths = [new_path(spark, "test-warc") for _ in range(2)]
    for path in paths:
        write_warc(pages, path)
    return paths


def test_intact_replicas(spark, pages, monkeypatch):
    got = warc_fixity(pages).collect()
    assert len(got) == 95 and all(r.intact and len(r.sha256) == 64 for r in got)
    assert sorted(r.page_id for r in got if r.page_id is not None) == sorted([*range(90), 5, 200, 201, 202])
    assert warc_fixity(pages.limit(0)).count() == 0


def test_records_are_warc(spark, pages):
    path, _ = replicas(spark, pages)
    rows = read_records(spark, path).collect()
    assert len(rows) == 95
    for name in glob.glob(f"{path}/part-*.gz"):
        data = gzip.open(name).read()
        part = int(name.split("part-")[1][:5])
        for r in (r for r in rows if r.part == part):
            record = data[r.offset : r.offset + r.length]
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: resource\r\n") and record.endswith(b"\r\n\r\n")


def damage(path, at, how):
    name = sorted(glob.glob(f"{path}/part-*.gz"))[at]
    data = bytearray(gzip.open(name).read())
    with open(name, "wb") as out:
        out.write(how(data))
    for crc in glob.glob(f"{path}/.*.crc"):
        open(crc, "wb").close()


@pytest.mark.parametrize("which", ["member", "trailer", "checksum", "zeros"])
def test_damage_outside_the_records_is_reported(spark, pages, which):
    """Records in a further gzip member, a lost or wrong checksum and bytes after the end are found."""
    spark._jsc.hadoopConfiguration().set("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
    spark._jsc.hadoopConfiguration().set("fs.file.impl.disable.cache", "true")
    try:
        one, two = replicas(spark, pages)
        record = b"WARC/1.1\r\nPage-ID: 77\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"

        def wrong_sum(data):
            raw = bytearray(gzip.compress(bytes(data)))
            raw[-6] ^= 1
            return bytes(raw)
        damage(two, 0, {"member": lambda d: gzip.compress(bytes(d)) + gzip.compress(record),
                        "trailer": lambda d: gzip.compress(bytes(d))[:-8], "checksum": wrong_sum,
                        "zeros": lambda d: gzip.compress(bytes(d)) + bytes(20)}[which])
        got = audit(spark, one, two).collect()
    finally:
        spark._jsc.hadoopConfiguration().unset("fs.file.impl")
    assert [(r.page_id, r.sha256) for r in got if not r.intact] == [(None, None)]
    assert len([r for r in got if r.sha256]) == 95


def test_members_are_read_one_after_the_other():
    whole = gzip.compress(b"a" * 50_000) + gzip.compress(b"") + gzip.compress(b"b" * 9)
    assert _inflate(whole) == (b"a" * 50_000 + b"b" * 9, 0)
    for cut in (1, 8, len(whole) - 5):
        data, unsound = _inflate(whole[:-cut])
        assert unsound > 0 and (b"a" * 50_000 + b"b" * 9).startswith(data)


def test_the_query_finds_the_pages_that_differ(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    changed = {p.page_id for p in pages if zlib.crc32(str(p.page_id).encode()) % 97 == 0 and p.html and p.html != p.html[::-1]}
    got = QUERIES["op7_warc_fixity"](spark, SF_SMALL).collect()
    assert changed and {r.page_id for r in got if not r.intact} == changed
    assert sorted(r.page_id for r in got) == sorted(p.page_id for p in pages)


def brute_root(hashes):
    """Root over one file of one part, by plain recursion over ranges of neighbours."""
    nodes = hashes
    while True:
        nodes = [(c[0][0], c[-1][1], hashlib.sha256(";".join(f"{a}:{b}:{h}" for a, b, h in c).encode()).hexdigest())
                 for c in (nodes[i : i + 16] for i in range(0, len(nodes), 16))]
        if len(nodes) == 1:
            return nodes[0]


def test_the_root_is_that_of_a_plain_tree(spark, pages):
    path = new_path(spark, "test-warc")
    write_warc(pages.coalesce(1), path)
    records = read_records(spark, path)
    rows = sorted(records.collect(), key=lambda r: r.idx)
    file = brute_root([(r.offset, r.offset + r.length, r.hash) for r in rows])
    expected = brute_root([file])  # of the only part's only file
    (root,) = merkle_tree(records)[-1].collect()
    assert root.hash == expected[2]


@pytest.mark.parametrize("which", ["byte", "cut", "gzip", "lost"])
def test_planted_damage_is_located(spark, pages, which):
    spark._jsc.hadoopConfiguration().set("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
    spark._jsc.hadoopConfiguration().set("fs.file.impl.disable.cache", "true")
    try:
        one, two = replicas(spark, pages)
        before = {(r.part, r.file, r.idx): r for r in read_records(spark, two).collect()}
        hit = sorted(before)[7]

        def flip(data):
            data[before[hit].offset + before[hit].length - 6] ^= 1
            return gzip.compress(bytes(data))
        how = {"byte": flip, "cut": lambda d: gzip.compress(bytes(d[: before[hit].offset + 9])),
               "gzip": lambda d: gzip.compress(bytes(d))[:-400], "lost": lambda d: gzip.compress(b"")}[which]
        damage(two, 0, how)
        got = audit(spark, one, two).collect()
    finally:
        spark._jsc.hadoopConfiguration().unset("fs.file.impl")
    wrong = sorted((r.part, r.file, r.offset) for r in got if not r.intact and r.sha256)
    everything = sorted(before)
    first_file = [k for k in everything if k[:2] == everything[0][:2]]
    expected = {"byte": [hit], "cut": [k for k in first_file if k >= hit], "lost": first_file}.get(which)
    if expected:
        assert wrong == [(*k[:2], before[k].offset) for k in expected]
    else:
        assert wrong and {w[:2] for w in wrong} == {first_file[0][:2]}
    assert len([r for r in got if r.sha256]) == 95


def test_tree_has_one_root(spark, pages):
    path, _ = replicas(spark, pages)
    levels = merkle_tree(read_records(spark, path))
    counts = [x.count() for x in levels]
    assert counts[0] == 95 and counts[-1] == 1 and counts == sorted(counts, reverse=True)
    for low, high in zip(levels, levels[1:], strict=False):
        parents = {r.up for r in low.collect()}
        assert parents == {f"{r.part}/{r.file}/{r.idx}" for r in high.collect()}


# -- Pieces -----------------------------------------------------------------------

MODEL = tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pe.with_places(pe.vocabulary(MODEL))


def giant_texts():
    rng = random.Random(7)
    return [
        " ".join(rng.choice(["the", "station", "  spaced", "über", "中文字", "\n"]) for _ in range(400)),
        "".join(rng.choice("abcdetionéß ▁") for _ in range(1500)), "x" * 900, " " * 700, "ab▁" * 300, "😀" * 500,
    ]


def ids_of(v, text):
    """Ids of the best cut of a whole text, without chunks or units."""
    return [i for p in pe.best_cut(v, pe.marked(pe.prepared(text or "")))[1] for i in pe._ids(v, p)]


@pytest.mark.parametrize("chunk, fan", [(16, 2), (16, 64), (50, 3), (333, 64), (1 << 14, 64)])
def test_ids_do_not_depend_on_chunks(table, vocabulary, monkeypatch, chunk, fan):
    """Equal scores are cut alike everywhere, also where products are combined in several levels."""
    monkeypatch.setattr(pe, "FAN", fan)
    rng = random.Random(chunk)
    texts = giant_texts() + ODD + ["".join(rng.choice("aabn l▁é ") for _ in range(rng.randrange(40, 400))) for _ in range(80)]
    texts += ["a" * n for n in range(30, 60)] + ["na" * 40, "  " * 50 + "a" * 50]
    got = by_id(encode_pieces(table([(i, t, "s") for i, t in enumerate(texts)]), MODEL, chunk))
    for i, text in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids_of(vocabulary, text), text and text[:40]


def test_units_cut_together_equal_those_cut_alone(vocabulary):
    rng = random.Random(4)
    units = [" " * rng.randrange(3) + "".join(rng.choice("abcenoitß▁中😀\n") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    units += ["the", " the", " station", "aaaaaaaaaaaa", "▁", " ▁", "\x00", "😀"]
    raw = [u.encode().replace("▁".encode(), b"\xff\x80\x80").replace(b" ", "▁".encode()) for u in units]
    scores, counts, ids = pe.best_cuts(vocabulary, raw)
    ends = np.cumsum(counts)
    for i, u in enumerate(units):
        score, pieces = pe.best_cut(vocabulary, pe.marked(u))
        assert scores[i] == score
        assert ids[ends[i] - counts[i] : ends[i]].tolist() == [x for p in pieces for x in pe._ids(vocabulary, p)], u


def test_characters_are_looked_up_while_a_piece_may_go_on(vocabulary, monkeypatch):
    """Most stretches of a text begin no piece, so only few of them are hashed and looked up."""
    rng, asked, places = random.Random(5), [], pe.Vocabulary.places
    monkeypatch.setattr(pe.Vocabulary, "places", lambda v, hashes: asked.append(len(hashes)) or places(v, hashes))
    units = [("▁" + "".join(rng.choice("qxzjkvwy#*09") for _ in range(15))).encode() for _ in range(500)]
    pe.best_cuts(vocabulary, units)
    assert sum(asked) < 4 * 16 * len(units)


def test_every_piece_is_found_by_hash(vocabulary):
    assert (vocabulary.places(vocabulary.hashes) == np.arange(len(vocabulary.ids))).all()
    assert (vocabulary.places(vocabulary.hashes + np.uint64(1)) == -1).all()


@pytest.mark.parametrize("chunk", [16, 50, 333])
def test_chunks_give_the_best_score_and_the_text(table, vocabulary, chunk):
    texts = giant_texts() + ODD
    encoded = encode_pieces(table([(i, t, "s") for i, t in enumerate(texts)]), MODEL, chunk)
    got = by_id(decode_pieces(encoded, MODEL))
    of_id = {i: p for p, i in vocabulary.ids.items()}
    for i, text in enumerate(texts):
        text = text or ""
        assert got[i].text == text
        best = pe.best_cut(vocabulary, pe.marked(pe.prepared(text)))[0]
        own = sum(vocabulary.scores[of_id[k]] if k in of_id else vocabulary.byte_score for k in np.frombuffer(got[i].ids, "<u4").tolist())
        assert got[i].score == best == own, text[:40]
        assert (got[i].n_chunks > 1) == (len(text) + 1 > 2 * chunk)


def test_products_are_associative(vocabulary):
    encoder = pe.SliceEncoder(MODEL)
    text = pe.marked(" " + giant_texts()[1])
    a, b, c = (pe.transfer(encoder, text[i : i + 60 + vocabulary.longest - 1], 60) for i in (0, 60, 120))
    left = pe.product(pe.product(a, b), c)
    assert (left == pe.product(a, pe.product(b, c))).all()
    whole = pe.transfer(encoder, text[: 180 + vocabulary.longest - 1], 180)
    assert (np.maximum(left, pe.NEVER // 2)[0] == np.maximum(whole, pe.NEVER // 2)[0]).all()


def test_whole_units_of_a_chunk_are_cut_once(vocabulary, monkeypatch):
    encoder = pe.slice_encoder(MODEL)
    assert pe.slice_encoder(MODEL) is encoder
    text = pe.marked(" " + "some whole units and one more " * 9)
    start = np.where(np.arange(vocabulary.longest) == 0, 0, pe.NEVER)
    matrix, middle = pe.transfer_and_middle(encoder, text, 100)
    monkeypatch.setattr(pe.SliceEncoder, "encode", None)  # tracing back cuts none of them again
    found = pe.trace(vocabulary, text, 100, start, 0, middle)
    score, pieces = pe.best_cut(vocabulary, text[:100])
    assert found.tolist() == [i for p in pieces for i in pe._ids(vocabulary, p)] and matrix[0, 0] == score


def test_pieces_of_odd_rows(table):
    assert encode_pieces(table([]), MODEL).count() == 0
    rows = encode_pieces(table([(None, "a b", "s"), (1, "a b", "s"), (1, "a b", "s"), (2, None, "s")]), MODEL).collect()
    assert len({bytes(r.ids) for r in rows if r.doc_id != 2}) == 1
    assert [(bytes(r.ids), r.score) for r in rows if r.doc_id == 2] == [(b"", 0)]
    assert zlib.crc32(b"") == 0


def test_the_coder_looks_up_by_whole_indices():
    """Others would be converted at each step; confidences go up to 7 and down to 1, then the id is replaced."""
    from acequia.llm import token_coder, token_files

    assert token_files.AT_ONCE <= 1 << 19
    model = token_coder._Model(3, 50)
    for ids in ([1, 2, 3], [1, 2, 4], [1, 2, 3]):
        p2, p1, _ = model.predict()
        ids = np.array(ids, np.int32)
        model.learn(ids, np.where(ids == p2, 0, np.where(ids == p1, 1, 2)))
        assert model.one.dtype == model.two.dtype == model.at2.dtype == model.row.dtype == np.int64
    assert model.after1[1] == (1 << 3 | 2) and model.after1[4] == (3 << 3 | 1)
    for sure in range(8):
        assert token_coder._STEPS[sure] == -1 and token_coder._STEPS[8 + sure] == (sure < 7)
