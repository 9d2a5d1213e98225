"""Exact dedup, Jaccard join and suffix dedup against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from acequia.llm import suffix_dedup as sd
from acequia.llm.components import components
from acequia.llm.exact_dedup import build_index, directory, distinct_documents, exact_dedup
from acequia.llm.jaccard_join import LEVEL_BITS, LOT, Levels, jaccard_join, near_distinct, rarer
from acequia.llm.suffix_dedup import suffix_dedup
from llm_helpers import by_id, lowered, table, words  # noqa: F401


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# -- Exact dedup ------------------------------------------------------------------

TEXTS = [
    (1, "Same", "a"), (2, "same", "b"), (3, "SAME", None), (4, "", "a"), (5, None, "a"),
    (6, "ÄÖ", "a"), (7, "äö", "a"), (8, "x" * 300_000, "a"), (9, "X" * 300_000, "a"), (10, "alone", "a"),
    (10, "alone", "a"), (None, "same", "a"), (11, "é", "a"), (12, "é", "a"),
]


@pytest.mark.parametrize("key_bits", [64, 2])
def test_exact_groups(table, key_bits):
    rows = exact_dedup(table(TEXTS), capacity=2, key_bits=key_bits).collect()
    groups = {}
    for i, text, _ in TEXTS:
        groups.setdefault(lowered(text), []).append(i)
    expected = sorted(
        (str(i), max((x for x in groups[lowered(t)] if x is not None), default=None), len(groups[lowered(t)]),
         hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t, _ in TEXTS)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in rows) == expected
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)
    if key_bits == 2:  # texts that collide are links of one chain
        assert max(r.link for r in rows) > 1


def test_kept_documents_are_one_for_each_text(table):
    docs = table(TEXTS)
    kept = distinct_documents(docs, capacity=2)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 9, 10, 11, 12]


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    slots, depth = directory(keys, capacity=50)
    rows = slots.collect()
    assert len(rows) == 2**depth and depth >= 6
    count = {}
    for (key,) in keys.collect():
        slot = (key % (1 << 64)) >> (64 - depth)
        bucket = next(r.bucket for r in rows if r.slot == slot)
        count[bucket] = count.get(bucket, 0) + 1
    assert max(count.values()) <= 50
    for r in rows:  # slots of a bucket share its leading bits
        assert r.slot >> (depth - r.local_depth) == r.bucket >> (depth - r.local_depth)


def test_index_keeps_a_key_in_one_bucket(table):
    rows = build_index(table([(i, f"text {i % 70}", "s") for i in range(300)]), capacity=10).collect()
    assert len(rows) == 70 and sum(r.copies for r in rows) == 300 and len({r.bucket for r in rows}) > 4


def test_bytes_tell_apart_the_texts_of_a_key(table):
    """With two bits of a key only four keys are left: the comparison alone keeps the texts apart."""
    rows = [(i, f"text {i % 30}", "s") for i in range(300)]
    index = build_index(table(rows).repartition(5), capacity=10, key_bits=2).collect()
    assert len(index) == 30 and len({r.key for r in index}) <= 4
    for key in {r.key for r in index}:
        links = sorted(r.link for r in index if r.key == key)
        assert links == list(range(1, len(links) + 1))
    assert {r.copies for r in index} == {10} and sorted(r.newest for r in index) == list(range(270, 300))
    assert {bytes(r.sha256) for r in index} == {hashlib.sha256(f"text {i}".encode()).digest() for i in range(30)}


def test_exact_of_an_empty_table(table):
    assert exact_dedup(table([])).count() == 0 and distinct_documents(table([])).count() == 0


# -- Jaccard join -----------------------------------------------------------------

def shingle_set(text, n):
    w = [x.lower() for x in words(text)]
    return frozenset(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            label[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(seed, percent):
    """Groups around the threshold, chains, near misses of one text, and short texts."""
    rng, rows = random.Random(seed), []
    for size in (12, 40, 150, 600):
        for _ in range(4):
            base = prose(rng, size)
            for _ in range(6):
                base = list(base)
                copy = list(base) if rng.random() < 0.5 else base
                for _ in range(max(1, round(size * rng.choice((0.004, 0.01, 0.02, 0.05))))):
                    copy[rng.randrange(size)] = f"n{rng.random()}"
                rows.append(" ".join(copy))
    base = prose(rng, 300)
    for _ in range(60):
        copy = list(base)
        for _ in range(8):
            copy[rng.randrange(300)] = f"n{rng.random()}"
        rows.append(" ".join(copy))
    rows += ["one", "One", "one two", "one two three", "one two three four", "", None, " \t\n", rows[0], rows[3].upper()]
    rows += [f"k{i} " + " ".join(["same"] * 3) for i in range(5)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("n, percent, seed", [(3, 90, 1), (3, 90, 2), (5, 80, 3), (5, 80, 4)])
def test_jaccard_components(table, n, percent, seed):
    rows = near_copies(seed, percent)
    got = by_id(jaccard_join(table([(i, t, "s") for i, t in rows]).repartition(5), n, percent))
    expected = brute_components(rows, n, percent)
    assert len({c for _, c in expected.values()}) < len(rows) - 10
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected


def test_jaccard_edge_cases(table):
    assert jaccard_join(table([])).count() == 0
    docs = table([(None, "a b c d e f", "s"), (5, "a b c d e f", "s"), (5, "a b c d e f", "s"), (None, None, "s")])
    rows = jaccard_join(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.n_shingles) for r in rows) == [
        (-1, -1, 0), (-1, 5, 2), (5, 5, 2), (5, 5, 2)]
    long = " ".join(prose(random.Random(5), 60_000))
    got = by_id(jaccard_join(table([(1, long, "s"), (2, long + " end", "s"), (3, "other", "s")])))
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 1, 3]


def test_one_document_of_each_component_stays(table):
    rows = near_copies(9, 80)
    docs = table([(i, t, "s") for i, t in rows])
    kept = near_distinct(docs)
    assert kept.columns == docs.columns
    expected = brute_components(rows, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in expected.items() if i == c)


@pytest.mark.parametrize("percent", [80, 90])
def test_levels_hold_all_partners(percent):
    """A pair's sizes are in one level or the next, and bands are enough for its differences."""
    levels = Levels(percent, 3000)
    for small in range(1, 2500):
        k = int(np.searchsorted(levels.start, small, "right")) - 1
        large = small * 100 // percent
        assert large < levels.start[k + 2] if k + 2 < len(levels.start) else True
        differ = small * (100 - percent) // percent
        assert differ == 0 or levels.bands[k] >= differ + 1 + 2 * levels.spare[k]


@pytest.mark.parametrize("percent", [80, 90])
def test_bands_allow_for_all_that_are_left_out(percent):
    levels = Levels(percent, 3000)
    assert levels.spare == [e + c for e, c in zip(levels.empty, levels.common, strict=True)]
    for k, bands in enumerate(levels.bands):
        differ = (levels.start[k + 1] - 1) * (100 - percent) // percent
        assert differ == 0 or bands == differ + 1 + 2 * levels.spare[k]
        assert levels.common[k] == differ // 8


def test_nodes_leave_their_most_common_groups(spark):
    """A group that grows with the input is left where a level has bands to spare; rarer keys stay."""
    level = Levels(80, 3000).common.index(1)
    rows = [((7 << LEVEL_BITS) | at, x) for x in range(4 * LOT) for at in (0, level)]
    rows += [((100 + x // 2 << LEVEL_BITS) | level, x) for x in range(4 * LOT)]
    got = {tuple(r) for r in rarer(spark.createDataFrame(rows, "key long, x long"), 80).collect()}
    assert got == {r for r in rows if r[0] != (7 << LEVEL_BITS) | level}


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 200)] + [(300, 299), (301, 299)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 200)}, 299: 299, 300: 299, 301: 299}


# -- Suffix dedup -----------------------------------------------------------------

def brute_suffix(rows, length):
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for i, text in order:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            x = data[p : p + length]
            if seen.setdefault(x, (i, p)) != (i, p):
                gone[p : p + length] = b"\1" * length
        runs = [k for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1])]
        out[i] = (len(data), sum(gone), len(runs), bytes(c for c, g in zip(data, gone, strict=True) if not g))
    return out


def passages(seed, length):
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choice("abcdeé ") for _ in range(n))
    shared = [text(rng.randrange(length // 2, 4 * length)) for _ in range(6)]
    rows = []
    for _ in range(70):
        rows.append("".join(rng.choice(shared) if rng.random() < 0.4 else text(rng.randrange(0, 2 * length)) for _ in range(5)))
    rows += ["x" * 1000, "x" * 99, "x" * 100, "ab" * 400, "", None, rows[0], rows[1][3:], "\0" * 250, "z" + "\0" * 250]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, length, many", [(1, 100, None), (2, 40, None), (3, 100, 3), (4, 40, 2)])
def test_suffix_dedup(table, monkeypatch, seed, length, many):
    if many:  # small bounds, so that anchors are dealt over tasks and shards and merged again
        for name, value in (("MANY", many), ("MANY_HERE", 3), ("SALTS", 4), ("SHARD", 3000), ("GROUP", 20), ("PIECE", 500)):
            monkeypatch.setattr(sd, name, value)
    rows = passages(seed, length)
    got = by_id(suffix_dedup(table([(i, t, "s") for i, t in rows]).repartition(6), length))
    expected = brute_suffix(rows, length)
    assert {i: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for i, r in got.items()} == expected
    for i, r in got.items():
        data = (dict(rows)[i] or "").encode()
        assert r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans)
        assert b"".join(data[a:b] for a, b in zip([0, *(s.end for s in r.spans)], [*(s.start for s in r.spans), len(data)],
                                                  strict=True)) == bytes(r.kept)


def test_suffix_dedup_edge_cases(table):
    assert suffix_dedup(table([])).count() == 0
    text = "abcdefghij" * 30
    got = [(r.doc_id, len(r.kept)) for r in suffix_dedup(table([(7, text, "s"), (7, text, "s"), (None, text, "s")])).collect()]
    # Rows of one document are not each other's copies; a null id comes last.
    assert sorted(got, key=str) == [(7, 10), (7, 10), (None, 0)]


_letters = random.Random(9)
A, B, X = ("".join(_letters.choice("abcdefgh") for _ in range(400)) for _ in range(3))


@pytest.mark.parametrize("rows, kept", [
    # Null ids are documents of their own: clean B stays, the second A goes.
    ([(1, A), (None, A), (None, B)], {(1, A): A, (None, A): "", (None, B): B}),
    # Of null ids the shorter text comes first, so the longer one loses the passage.
    ([(None, A), (None, X + A)], {(None, A): A, (None, X + A): X}),
    ([(None, X + A), (None, A), (3, None)], {(None, A): A, (None, X + A): X, (3, None): ""}),
    ([(1, A), (5, A), (5, B)], {(1, A): A, (5, A): "", (5, B): B}),
    ([(5, B + X), (5, A), (5, A + B), (5, None), (None, None), (None, "")],
     {(5, A): A, (5, B + X): B + X, (5, None): "", (None, None): "", (None, ""): ""}),
])
def test_suffix_dedup_of_null_and_repeated_ids(table, rows, kept):
    sizes = sorted((i is None, i or 0, len((t or "").encode())) for i, t in rows)
    got = suffix_dedup(table([(i, t, "s") for i, t in rows])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes) for r in got) == sizes
    for (i, text), left in kept.items():
        if (i, text) not in ((5, A + B), (5, B + X)):
            found = [bytes(r.kept) for r in got if r.doc_id == i and r.n_bytes == len((text or "").encode())]
            assert left.encode() in found


def test_suffix_dedup_refuses_long_strings(table):
    with pytest.raises(ValueError):
        suffix_dedup(table([]), sd.LONGEST)


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    cut = np.array([0, 700, 701, 2000, 3000])
    string = np.repeat(np.arange(4), np.diff(cut))
    end = cut[1:][string]
    padded, place = np.append(data, np.zeros(8, np.uint8)), np.arange(3000)
    w = np.zeros(3000, np.uint64)
    for i in range(8):
        w |= np.where(place + i < end, padded[i : i + 3000], 0).astype(np.uint64) << np.uint64(56 - 8 * i)
    sa = sd.suffix_array(w, end, 100)
    suffix = [bytes(data[i : min(end[i], i + 100)]) for i in sa]
    assert suffix == sorted(suffix) and sorted(sa) == list(range(3000))
    lcp = sd.common_prefixes(w, sa, end, string, 100)
    for i in range(1, 3000):
        a, b = suffix[i - 1], suffix[i]
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[i] == n
