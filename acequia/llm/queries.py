"""The registered queries of these operators, and their results as SQL where SQL can state them."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from acequia.llm.exact_dedup import exact_dedup
from acequia.llm.importance_resampling import importance_ranks
from acequia.llm.jaccard_join import jaccard_join
from acequia.llm.merkle_manifest import audited, leaf, manifest
from acequia.llm.mixing import mix
from acequia.llm.piece_encoding import decode_pieces, encode_pieces
from acequia.llm.quality_classifier import quality_scores
from acequia.llm.quality_rules import quality_rules
from acequia.llm.suffix_dedup import suffix_dedup
from acequia.llm.suffix_tree_lm import suffix_tree_scores
from acequia.llm.token_files import token_files
from acequia.llm.url_filters import Rule, filter_urls, listed_by_content, listed_by_host_words
from acequia.llm.warc_fixity import warc_fixity

RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
#: Host labels of advertising, gambling and spam sites.
BAD_LABELS = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")

#: A page with more such runs of symbols is taken for spam.
SYMBOL_RUNS, MOST_RUNS = "[#*$%]{3}", 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def tokenizer(name: str) -> str:
    """Path of a public vocabulary file, the same on every machine: in ``TOKENIZER_DIR`` if that is set,
    else where the package of public tokenizers has it."""
    folder = os.environ.get("TOKENIZER_DIR")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(_documents(spark, folder)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(_documents(spark, folder), n=3, percent=90)


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup(_documents(spark, folder), length=100).select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op4_suffix_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree_scores(_documents(spark, folder))


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    listed = listed_by_host_words(pages, BAD_LABELS).unionByName(listed_by_content(pages, SYMBOL_RUNS, MOST_RUNS))
    return filter_urls(pages, listed, RULES).select(
        "page_id", "host", "path", "rule", "verdict", "listed")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(_documents(spark, folder), tokenizer("word_bpe_49k.json"), end_id=2).select(
        "doc_id", "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


def op7_warc_fixity(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    damaged = F.when(F.crc32(F.col("page_id").cast("string").cast("binary")) % 97 == 0, F.reverse("html")).otherwise(F.col("html"))
    return warc_fixity(pages, damaged)


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(_documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "removed_words", "kept")


def op9_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    return decode_pieces(encode_pieces(_documents(spark, folder), model), model).select(
        "doc_id", "score", "n_chunks",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_documents(spark, folder))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    target = spark.read.parquet(f"{folder}/benchmark.parquet")
    return importance_ranks(_documents(spark, folder), target, n=1).select(
        "doc_id", "n_features", "weight", "score", "rank")


def _crc32(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held_out = _crc32(F.col("doc_id")) % 5 == 0
    return quality_scores(_documents(spark, folder), labels, learnable=~held_out).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    lowered = F.translate("text", _UPPER, _LOWER)
    changed = F.when(_crc32(F.col("doc_id")) % 5 == 0, leaf(lowered)).alias("changed")
    proofs = manifest(_documents(spark, folder), carried=[changed])
    rows = audited(proofs.withColumn("claimed", F.coalesce("changed", "leaf")), "claimed")
    return rows.select(
        "doc_id", *(F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")),
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"),
        F.lower(F.hex("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_jaccard_join, op3_suffix_dedup, op4_suffix_tree_scores, op5_url_filters,
        op6_token_files, op7_warc_fixity, op8_quality_rules, op9_piece_encoding, op10_mixing, op11_importance_resampling,
        op12_quality_classifier, op13_merkle_manifest)
}

_WORDS = r"[^\x20\x09-\x0D]+"
_FEATURES = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS x FROM documents),
        g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(x) AS text_sha256
        FROM t JOIN g USING (x)""",
    "op5_url_filters": rf"""
        WITH a AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x,
                   len(regexp_extract_all(coalesce(html, ''), '{SYMBOL_RUNS}')) > {MOST_RUNS} AS spam
            FROM pages),
        p AS (
            SELECT page_id, spam, translate(regexp_extract(coalesce(x, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                   regexp_extract(coalesce(x, ''), '^[^/?#]*([^?#]*)', 1) AS path
            FROM a),
        c AS (
            SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '') AS address,
                   spam OR regexp_matches('.' || host || '.', '\.({"|".join(BAD_LABELS)})\.') AS bad
            FROM p),
        l AS (SELECT *, address IN (SELECT address FROM c WHERE bad) AS listed FROM c),
        r AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM l)
        SELECT page_id, host, path, rule, listed, CASE
            WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict
        FROM r""",
    # Links of all pairs with a common shingle, then what links reach.
    "op2_jaccard_join": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3
                THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i : i + 2]) WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS s
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
        r AS (SELECT doc_id, doc_id AS found FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.found = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.found) AS component_id
        FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
    "op8_quality_rules": rf"""
        WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, host, t, regexp_extract_all(t, '{_WORDS}') AS ws FROM d),
        g AS (
            SELECT doc_id, i, ws[i : i + 4] AS five FROM (
                SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
        c AS (
            SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (
                SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1)
            CROSS JOIN range(0, 5) AS five_places(k) GROUP BY doc_id),
        y AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
        z AS (
            SELECT doc_id, host, t, line, regexp_extract_all(translate(line, '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS norm
            FROM y WHERE regexp_matches(line, '{_WORDS}')),
        u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM z GROUP BY doc_id),
        h AS (SELECT host, count(DISTINCT t) AS texts FROM d GROUP BY host),
        f AS (
            SELECT z.host, z.norm FROM z JOIN h ON h.host IS NOT DISTINCT FROM z.host
            GROUP BY z.host, z.norm, h.texts HAVING count(DISTINCT z.t) > 50 AND count(DISTINCT z.t) > 0.02 * h.texts),
        x AS (
            SELECT z.doc_id, sum(len(z.norm))::bigint AS removed_words
            FROM z JOIN f ON f.host IS NOT DISTINCT FROM z.host AND f.norm = z.norm GROUP BY z.doc_id),
        m AS (
            SELECT w.doc_id, len(ws) AS n_words,
                   coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0)::bigint AS word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                   coalesce(removed_words, 0) AS removed_words
            FROM w LEFT JOIN u USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id))
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
               AND n_words - removed_words >= 10 AND n_words - removed_words >= 0.2 * n_words AS kept
        FROM m""",
    # CRC-32 by the usual table of 256 remainders, over the bytes of each distinct word.
    "op11_importance_resampling": rf"""
        WITH remainders AS (
            SELECT list(v ORDER BY k) AS r FROM (
                SELECT k, list_reduce([k::bigint] || [0::bigint, 0, 0, 0, 0, 0, 0, 0],
                    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
                FROM range(256) AS b(k))),
        d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_FEATURES}') AS ws
            FROM documents),
        b AS (
            SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_FEATURES}') AS ws
            FROM benchmark),
        s AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY doc_id, w),
        t AS (SELECT unnest(ws) AS w FROM b),
        hexed AS (SELECT w, hex(w) AS x FROM (SELECT w FROM s UNION SELECT w FROM t)),
        bytes AS (SELECT w, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint) AS x FROM hexed),
        k AS (
            SELECT w, xor(list_reduce([4294967295::bigint] || x, lambda c, y: xor(r[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
            FROM bytes, remainders),
        sb AS (SELECT bucket, sum(n)::double AS s FROM s JOIN k USING (w) GROUP BY bucket),
        tb AS (SELECT bucket, count(*)::double AS t FROM t JOIN k USING (w) GROUP BY bucket),
        totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM sb) AS all_s, (SELECT coalesce(sum(t), 0) FROM tb) AS all_t),
        gains AS (
            SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000))))::bigint AS gain
            FROM sb LEFT JOIN tb USING (bucket), totals),
        weights AS (SELECT doc_id, sum(n * gain)::bigint AS weight FROM s JOIN k USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
        scored AS (
            SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
                (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::ubigint + 0.5::double) / 4294967296)))::bigint AS score
            FROM d LEFT JOIN weights USING (doc_id)),
        ordered AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible
            FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * eligible // 100 THEN place END AS rank
        FROM scored LEFT JOIN ordered USING (doc_id)""",
    # One recursion builds all levels of the sources' trees, one those of the tree above, and one
    # folds each leaf upwards with the siblings on its way.
    "op13_merkle_manifest": rf"""
        WITH RECURSIVE remainders AS (
            SELECT list(v ORDER BY k) AS r FROM (
                SELECT k, list_reduce([k::bigint] || [0::bigint, 0, 0, 0, 0, 0, 0, 0],
                    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
                FROM range(256) AS b(k))),
        d AS (
            SELECT doc_id, source, lang, n_chars, text, CASE WHEN xor(list_reduce(
                [4294967295::bigint] || list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ord(substr(doc_id::varchar, i, 1))::bigint),
                lambda c, y: xor(r[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % 5 = 0
                THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS claimed
            FROM documents, remainders),
        p AS (
            SELECT doc_id, source, text, claimed, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-')
                || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') AS fields
            FROM d),
        h AS (
            SELECT doc_id, source, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(fields || coalesce(strlen(claimed) || ':' || claimed, '-')) AS claimed
            FROM p),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS i,
                   dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
            FROM h),
        low AS (
            SELECT 0 AS level, tree, i, leaf AS node FROM leaves
            UNION ALL
            SELECT level + 1, tree, i // 16, sha256(string_agg(node, '' ORDER BY i))
            FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS nodes FROM low) WHERE nodes > 1 GROUP BY level, tree, i // 16),
        tops AS (SELECT tree, max(level) AS level FROM low GROUP BY tree),
        subroots AS (SELECT tree, node AS subroot FROM low JOIN tops USING (tree, level)),
        high AS (
            SELECT 0 AS level, tree AS i, subroot AS node FROM subroots
            UNION ALL
            SELECT level + 1, i // 16, sha256(string_agg(node, '' ORDER BY i))
            FROM (SELECT *, count(*) OVER () AS nodes FROM high) WHERE nodes > 1 GROUP BY level, i // 16),
        last AS (SELECT level AS last, node AS root FROM high ORDER BY level DESC LIMIT 1),
        runs AS (
            SELECT low.level, tree, i // 16 AS run, list(node ORDER BY i) AS nodes FROM low JOIN tops USING (tree)
            WHERE low.level < tops.level GROUP BY low.level, tree, i // 16),
        high_runs AS (SELECT level, i // 16 AS run, list(node ORDER BY i) AS nodes FROM high, last WHERE level < last GROUP BY level, i // 16),
        way AS (
            SELECT l.tree, l.i, r.level AS step, r.nodes, (l.i // (16 ** r.level)::bigint) % 16 AS own
            FROM leaves l JOIN runs r ON r.tree = l.tree AND r.run = l.i // (16 ** (r.level + 1))::bigint
            UNION ALL
            SELECT l.tree, l.i, t.level + r.level, r.nodes, (l.tree // (16 ** r.level)::bigint) % 16
            FROM leaves l JOIN tops t ON t.tree = l.tree JOIN high_runs r ON r.run = l.tree // (16 ** (r.level + 1))::bigint),
        proofs AS (
            SELECT tree, i, sha256(string_agg(array_to_string(list_concat(nodes[1:own], nodes[own + 2:]), ''), '' ORDER BY step)) AS proof_sha256
            FROM way GROUP BY tree, i),
        fold AS (
            SELECT tree, i, 0 AS step, claimed AS node FROM leaves
            UNION ALL
            SELECT f.tree, f.i, f.step + 1, sha256(array_to_string(list_concat(list_append(nodes[1:own], f.node), nodes[own + 2:]), ''))
            FROM fold f JOIN way w ON w.tree = f.tree AND w.i = f.i AND w.step = f.step),
        folded AS (SELECT tree, i, arg_max(node, step) AS folded_root FROM fold GROUP BY tree, i)
        SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM leaves JOIN subroots USING (tree) JOIN folded USING (tree, i) LEFT JOIN proofs USING (tree, i), last""",
}
