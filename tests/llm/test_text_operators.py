"""Quality rules, mixing, suffix-tree scores and URL filters against brute force."""

import math
import random
import zlib
from collections import Counter

import pytest

from acequia.llm.mixing import mix, mixed_documents, water_level
from acequia.llm.quality_rules import Limits, clean, quality_rules
from acequia.llm.suffix_tree_lm import Settings, suffix_tree_scores
from acequia.llm.url_filters import Rule, bloom_filter, filter_urls, with_bits
from llm_helpers import by_id, lowered, table, words  # noqa: F401

# -- Quality rules ----------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), failed


def brute_frequent(rows, limits):
    held, hosts = {}, {}
    for _, text, host in rows:
        hosts.setdefault(host, set()).add(text or "")
        for line in (text or "").split("\n"):
            if words(line):
                held.setdefault((host, tuple(words(lowered(line)))), set()).add(text)
    return {k for k, v in held.items() if len(v) > limits.documents and len(v) > limits.share * len(hosts[k[0]])}


def site(seed):
    rng = random.Random(seed)

    def line(n):
        return " ".join(f"{rng.choice('aébc')}{rng.randrange(500)}" for _ in range(n))
    menus = ["Home  About CONTACT", "all rights reserved by nobody at all", "été à la plage"]
    rows = []
    for i in range(120):
        lines = [line(rng.randrange(1, 15)) for _ in range(rng.randrange(1, 9))]
        for m in menus:
            if rng.random() < 0.5:
                lines.insert(rng.randrange(len(lines) + 1), m.upper() if rng.random() < 0.2 and m.isascii() else m)
        if rng.random() < 0.2:
            lines += lines[:2]
        rows.append((i, "\n".join(lines), rng.choice(["h1", "h2", None])))
    only = [(200 + i, "\n".join(menus) + "\n" + line(3) + " **#", "h1") for i in range(10)]
    odd = [(300, None, "h1"), (301, "", "h1"), (302, "\n\n \t\n", None), (303, "é" * 50_000, "h2"), (304, "a b c d e f " * 5000, "h2"),
           (305, "x", None), (305, "x", None), (None, line(20), "h1"), (306, line(12) + "\n\n", "h1"), (307, "\x85 \x1c\xa0 y", "h2")]
    return rows + only + odd + [(400 + i, rows[0][1], rows[0][2]) for i in range(40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_rules(table, seed):
    rows, limits = site(seed), Limits(documents=8, share=0.1)
    got = quality_rules(table(rows).repartition(4), limits).collect()
    frequent = brute_frequent(rows, limits)
    assert len(frequent) >= 3
    expected = []
    for i, text, host in rows:
        *measures, failed = brute_measures(text)
        removed = sum(len(words(x)) for x in (text or "").split("\n") if (host, tuple(words(lowered(x)))) in frequent)
        left = measures[0] - removed
        kept = not failed and left >= limits.words and left >= limits.part * measures[0]
        expected.append((str(i), *measures, failed, removed, kept))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                   r.base_failed, r.removed_words, r.kept) for r in got) == sorted(expected)
    assert {e[-1] for e in expected if not e[6]} == {True, False}


def test_cleaned_documents(table):
    rows, limits = site(3), Limits(documents=8, share=0.1)
    docs = table(rows)
    frequent = brute_frequent(rows, limits)
    verdicts = {(r.doc_id, r.host): r.kept for r in quality_rules(docs, limits).collect()}
    out = clean(docs, limits)
    assert out.columns == docs.columns
    expected = sorted((str(i), "\n".join(x for x in (text or "").split("\n") if (host, tuple(words(lowered(x)))) not in frequent),
                       str(host)) for i, text, host in rows if verdicts[i, host])
    assert sorted((str(r.doc_id), r.text, str(r.source)) for r in out.collect()) == expected


def test_copies_of_a_page_are_no_boilerplate(table):
    page = " ".join(f"word{i}" for i in range(30))
    got = quality_rules(table([(i, page, "h") for i in range(100)]), Limits(documents=5, share=0.0)).collect()
    assert all(r.kept and not r.removed_words for r in got)
    assert quality_rules(table([])).count() == 0 and clean(table([])).count() == 0


def test_production_limits_remove_lines_and_reject_documents(table):
    """51 of 60 texts hold the menu, 50 the notice; a document of little but the menu is depleted."""
    menu, notice = "Home News Contact Press Jobs Help Terms", "all rights reserved by nobody"
    rows = []
    for i in range(60):
        own = " ".join(f"own{i}x{k}" for k in range(3 if i < 5 else 20))
        rows.append((i, "\n".join([own] + [menu] * (i < 51) + [notice] * (i < 50)), "h"))
    assert brute_frequent(rows, Limits()) == {("h", tuple(words(lowered(menu))))}
    got = by_id(quality_rules(table(rows)))
    assert {i: r.removed_words for i, r in got.items()} == {i: 7 * (i < 51) for i in range(60)}
    assert {i for i, r in got.items() if not r.kept and not r.base_failed} == set(range(5))


# -- Mixing -----------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        unit = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if unit * weight[n] > epochs * sizes[n]}
        if not over:
            return target | {n: unit * weight[n] for n in open_}
        for n in over:
            target[n] = epochs * sizes[n]
            left -= target[n]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_meets_its_targets(table, seed):
    rng, rows = random.Random(seed), []
    for k, name in enumerate(["b", "a", "é", "Z", None, "zz"]):
        for _ in range(rng.randrange(30, 300) * (6 if name == "a" else 1)):
            rows.append((len(rows), " ".join("w" * rng.randrange(1, 60)), name))
    rows += [(9001, None, "b"), (9002, "", "empty"), (9003, "\t", "empty")]
    docs = table(rows).repartition(5)
    got = mix(docs).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for (_, text, name) in rows:
        sizes[name] += len(words(text))
    names = {i: name for i, _, name in rows}
    targets = brute_targets(sizes)
    for r in got:
        name = names[r.doc_id]
        assert r.size == len(words(dict((i, t) for i, t, _ in rows)[r.doc_id])) if r.doc_id > 9000 else True
        assert (r.source_size, r.target) == (sizes[name], pytest.approx(targets[name]))
        assert r.taken in (0, r.size, 2 * r.size)
        taken[name] += r.taken
        largest[name] = max(largest[name], r.size)
    for name in sizes:
        assert abs(taken[name] - targets[name]) <= largest[name] / 2 + 1e-6, name
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(docs.repartition(3)).collect()), key=str)
    mixed = Counter(r.doc_id for r in mixed_documents(docs).collect())
    assert {r.doc_id: r.taken // r.size for r in got if r.taken} == {i: n for i, n in mixed.items() if i < 9000}
    assert mixed_documents(docs).columns == docs.columns


def test_mixing_edge_cases(table, spark):
    assert mix(table([])).count() == 0 and mixed_documents(table([])).count() == 0
    (row,) = mix(table([(1, "a b", "s")])).collect()
    assert (row.size, row.source_size, row.target) == (2, 2, 3.0) and row.taken in (2, 4)
    same = mix(table([(1, "a b", "s")] * 4 + [(2, "c " * 8, "s")])).collect()
    assert len({r.taken for r in same if r.doc_id == 1}) == 1
    sources = spark.createDataFrame([("a", 10, 5.0), ("b", 1000, 1.0)], "source string, source_size long, weight double")
    assert water_level(sources, 100.0, 2) == 80.0


# -- Suffix tree ------------------------------------------------------------------

def markov(rng, n):
    out, w = [], 0
    for _ in range(n):
        w = (w * 3 + 1) % 40 if rng.random() < 0.7 else rng.randrange(40)
        out.append(f"W{w}")
    return " ".join(out)


def test_suffix_tree_scores(table):
    rng = random.Random(1)
    rows = [(i, markov(rng, rng.randrange(0, 200)) + (f" rare{i}" if i % 3 else ""), "s") for i in range(400)]
    rows += [(1000, None, "s"), (1001, "", "s"), (None, markov(rng, 20), "s"), (1002, markov(rng, 50_000), "s"), (1003, "a b", "s"), (1003, "a b", "s")]
    got = suffix_tree_scores(table(rows).repartition(4), Settings(word_share=1e-4, string_share=1e-4)).collect()
    assert len(got) == len(rows)

    def out(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2

    def tokens(t):
        return [*words(lowered(t)), None]
    count = Counter(w for i, t, _ in rows if not out(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    expected = sorted((str(i), out(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n,
                       round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    held = [r for r in got if r.held_out]
    per = sum(r.score for r in held) / sum(r.n_tokens for r in held)
    base = sum(r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert per > base + 0.3  # the chain is predictable, and the tree learns it from the others


class PlainTree:
    """The model in dictionaries: strings are tuples of words, counted and smoothed one by one."""

    def __init__(self, texts, least, divergence):
        self.count = [Counter(tuple(t[i : i + m]) for t in texts for i in range(len(t) - m + 1)) for m in (1, 2, 3)]
        self.tokens, self.share, self.rest = sum(self.count[0].values()), {}, {}
        for shorter, longer in zip(self.count, self.count[1:], strict=False):
            gain, share = Counter(), Counter()
            often = {s: n for s, n in longer.items() if n >= least}
            for s, n in often.items():
                gain[s[:-1]] += n * math.log(n / shorter[s[:-1]] / self.probability(s[1:-1], s[-1]))
                share[s[:-1]] += (n - 0.75) / shorter[s[:-1]]
            kept = {c for c in gain if gain[c] >= divergence}
            self.share |= {s: (n - 0.75) / shorter[s[:-1]] for s, n in often.items() if s[:-1] in kept}
            self.rest |= {c: max(1 - share[c], 1e-12) for c in kept}

    def probability(self, context, word):
        if not context:
            return max(self.count[0][(word,)], 1) / (self.tokens + 1)
        return self.share.get((*context, word), 0.0) + self.rest.get(context, 1.0) * self.probability(context[1:], word)

    def score(self, text):
        return sum(math.log10(self.probability(tuple(text[max(0, i - 2) : i]), w)) for i, w in enumerate(text))


def test_tree_distributions_sum_to_one():
    rng = random.Random(2)
    texts = [[*markov(rng, 200).split(), None] for _ in range(30)]
    tree = PlainTree(texts, 2, 5.0)
    kinds = {w for (w,) in tree.count[0]}
    assert min(len([c for c in tree.rest if len(c) == m]) for m in (1, 2)) > 0
    for context in tree.rest:  # one unseen word has a place of its own
        total = sum(tree.probability(context, w) for w in [*kinds, "unseen"])
        assert total == pytest.approx(1.0, abs=1e-9)


def brute_tree_scores(rows, least, divergence):
    """Scores of each row under the plain model."""
    def out(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2

    texts = [[*words(lowered(t)), None] for _, t, _ in rows]
    tree = PlainTree([t for (i, _, _), t in zip(rows, texts, strict=True) if not out(i)], least, divergence)
    assert {len(c) for c in tree.rest} == {1, 2}
    return sorted((str(i), round(tree.score(t), 6)) for (i, _, _), t in zip(rows, texts, strict=True))


@pytest.mark.parametrize("share", [1.0, 0.01, 0.0])
def test_contexts_do_not_depend_on_the_share_of_tokens(table, share):
    """Strings of two occurrences count however many tokens there are, in memory or joined."""
    rng = random.Random(4)
    rows = [(i, markov(rng, rng.randrange(0, 80)) + (f" name{i % 90} of place{i % 90} W1" if i % 3 else ""), "s") for i in range(400)]
    rows += [(1000, None, "s"), (None, markov(rng, 20), "s"), (1002, markov(rng, 3000), "s"), (1003, "a b", "s"), (1003, "a b", "s")]
    got = suffix_tree_scores(table(rows).repartition(4), Settings(word_share=share, string_share=share)).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == brute_tree_scores(rows, 2, 10.0)


def test_scores_without_training_or_rows(table):
    assert suffix_tree_scores(table([])).count() == 0
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = suffix_tree_scores(table([(out, "a b", "s")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score == 0.0


# -- URL filters ------------------------------------------------------------------

RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("allow", "org", "/fr/"))


def test_url_filters(spark):
    urls = {
        1: ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("https://net/de", "net", "/de", "net/", "block"),
        3: ("https://notnet/de", "notnet", "/de", None, "allow"),
        4: ("https://xexample.net/en/", "xexample.net", "/en/", "net/", "block"),
        5: ("https://a.org?q=/fr/", "a.org", "", None, "allow"),
        6: ("https://a.org/fr/x", "a.org", "/fr/x", "org/fr/", "allow"),
        7: (None, "", "", None, "allow"), 8: ("no scheme/net/", "", "", None, "allow"), 9: ("", "", "", None, "allow"),
        10: ("https://www.bad.com/p.html#top", "www.bad.com", "/p.html", None, "block"),
        11: ("http://m.bad.com/p/?a=b", "m.bad.com", "/p/", None, "block"),
        12: ("http://bad.com/q", "bad.com", "/q", None, "allow"), 13: ("http://n.net", "n.net", "", None, "allow"),
        14: ("a://b://c/d", "b:", "//c/d", None, "allow"), 15: ("http://ÉX.com/É", "Éx.com", "/É", None, "allow"),
        16: ("http://l.org/" + "z" * 100_000, "l.org", "/" + "z" * 100_000, None, "allow"),
    }
    pages = spark.createDataFrame([(i, u[0], "h", "r") for i, u in urls.items()] + [(None, urls[10][0], "h", "r")] * 2,
                                  "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("bad.com/p",), ("bad.com/p",), (None,), ("else.com/",)], "canonical string")
    got = filter_urls(pages, listed, RULES).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got if r.page_id} == {i: u[1:] for i, u in urls.items()}
    assert [r.verdict for r in got if r.page_id is None] == ["block", "block"]
    assert all(r.possible for r in got if r.listed)
    assert filter_urls(pages.limit(0), listed, RULES).count() == 0
    assert filter_urls(pages, listed.limit(0), ()).where("verdict = 'block'").count() == 0


def test_bloom_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(3000).selectExpr("concat('l', id) AS canonical")
    filled = bloom_filter(listed, 250)
    others = spark.range(5000).selectExpr("concat('o', id) AS canonical")

    def passed(df):
        joined = with_bits(df, 250).join(filled, "block")
        return joined.where(" AND ".join(f"(w{i} & f{i}) = w{i}" for i in range(4))).count()
    assert passed(listed) == 3000 and passed(others) < 250


def test_tree_tasks_give_memory_back(table, monkeypatch):
    """Workers are used again: what a task of one step keeps counts against the tasks of the next."""
    from acequia.llm import suffix_tree_lm

    wrapped = []
    monkeypatch.setattr(suffix_tree_lm, "lean", lambda run: wrapped.append(run.__name__) or run)
    suffix_tree_lm.suffix_tree_scores(table([(i, "a b c a b c", "s") for i in range(9)])).count()
    assert wrapped == ["_count_words", "part", "part", "run", "ask"]


def test_strings_are_sorted_range_by_range(table, monkeypatch):
    """Sorting takes several copies of what a task holds, so it takes a few ranges of buckets in turn; groups give memory back."""
    from acequia.llm import suffix_tree_lm

    for buckets in (1, 3, 4, 10, 211):
        ranges = [(int(a), int(b)) for a, b in suffix_tree_lm._ranges(buckets)]
        assert ranges[0][0] == 0 and ranges[-1][1] == 2**64 - 1 and len(ranges) == min(buckets, suffix_tree_lm.RANGES)
        assert all(b + 1 == c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False))
        assert all((((b >> 32) * buckets) >> 32) < (((b + 1 >> 32) * buckets) >> 32) for _, b in ranges[:-1])  # whole buckets
    wrapped = []
    monkeypatch.setattr(suffix_tree_lm, "lean_groups", lambda run: wrapped.append(run.__name__) or run)
    suffix_tree_lm.suffix_tree_scores(table([(i, "a b c a b c", "s") for i in range(9)])).count()
    assert wrapped == ["total", "total", "answer", "total"]


def test_tree_words_are_found_in_small_slices():
    """Half a megabyte at once: what is computed for it stays in a core's cache. Longer texts are slices of their own."""
    import pyarrow as pa

    from acequia.llm import suffix_tree_lm

    texts = ["ab cd " * 30_000] * 6 + [None, "x " * 300_000, "y"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "text": texts})
    found = list(suffix_tree_lm._tokens(batch))
    assert [s.n for s, *_ in found] == [2, 2, 3, 1, 1]
    assert sum(len(h) for _, _, h, _ in found) == 6 * 60_000 + 300_000 + 1 + 9
