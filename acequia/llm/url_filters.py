"""URL filters: host and path rules, and a blocked Bloom filter before an exact join.

Each listed canonical URL sets eight bits in one 256-bit block. A page reads its single
block; only pages whose bits are all set go on to the exact join with the list, which
removes the false positives.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from acequia.llm.shared import saved

#: Listed URLs for each block of 256 bits.
PER_BLOCK = 12


@dataclass(frozen=True)
class Rule:
    """Blocks or allows a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without ``://``."""
    after = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One form for the spellings of an address: no scheme, query, fragment, ``www.`` or ``m.``,
    closing slash or ``.html``."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))


def matching_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. ``rules`` is a caller's short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, r.text).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def _bits(address: Column, blocks: int) -> list[Column]:
    """Block of an address and the two bits it sets in each of the block's four words."""
    h = F.xxhash64(address, F.lit(1))
    words = [
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {12 * i}) & 63 AS int))"
               f" | shiftleft(1L, cast(shiftrightunsigned(h, {12 * i + 6}) & 63 AS int))").alias(f"w{i}")
        for i in range(4)]
    return [F.pmod(F.xxhash64(address), F.lit(blocks)).alias("block"), h.alias("h")], words


def with_bits(df: DataFrame, blocks: int) -> DataFrame:
    place, words = _bits(F.col("canonical"), blocks)
    return df.select("*", *place).select("*", *words).drop("h")


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table: ``block`` and its four words."""
    return with_bits(listed, blocks).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"f{i}") for i in range(4)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """Judge every url by the rules, else by the list of blocked canonical addresses.

    ``pages`` has ``page_id`` and ``url``, ``listed`` has ``canonical``; other columns are ignored.
    Returns one row per page: ``page_id``, ``host``, ``path``, ``rule`` (null if none fits),
    ``verdict`` (``block`` or ``allow``), ``possible`` (the filter passed it) and ``listed``. A null
    or malformed url has empty host and path and is allowed unless the empty address is listed;
    null addresses of the list are ignored and repeated ones count once; repeated pages are judged
    alike; empty tables are fine on either side. Of two rules of one length, the longer host wins.
    """
    names = saved(listed.select("canonical").where(F.col("canonical").isNotNull()).distinct(), "listed")
    blocks = max(1, math.ceil(names.count() / PER_BLOCK))
    filled = saved(bloom_filter(names, blocks), "bloom")
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(rules, F.col("host"), F.col("path"))
    cut = cut.withColumns({"rule": rule, "ruled": verdict, "canonical": canonical(F.col("host"), F.col("path"))})
    set_ = F.lit(True)
    for i in range(4):
        set_ = set_ & (F.col(f"w{i}").bitwiseAND(F.col(f"f{i}")) == F.col(f"w{i}"))
    probed = with_bits(cut, blocks).join(filled, "block", "left").select(
        "page_id", "host", "path", "rule", "ruled", "canonical", F.coalesce(set_, F.lit(False)).alias("possible"))
    probed = saved(probed, "probed")
    exact = probed.where("possible").join(names.withColumn("listed", F.lit(True)), "canonical", "left")
    rest = probed.where(~F.col("possible")).withColumn("listed", F.lit(None).cast("boolean"))
    both = exact.unionByName(rest).withColumn("listed", F.coalesce("listed", F.lit(False)))
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return both.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "possible", "listed")


def listed_by_host_words(pages: DataFrame, words: Sequence[str]) -> DataFrame:
    """Canonical addresses of the pages on hosts with one of ``words`` as a label."""
    host, path = parts(F.col("url"))
    labels = F.split("host", r"\.")
    return pages.select(host.alias("host"), path.alias("path")).where(
        F.arrays_overlap(labels, F.array(*map(F.lit, words)))).select(
        canonical(F.col("host"), F.col("path")).alias("canonical"))


def listed_by_content(pages: DataFrame, pattern: str, most: int) -> DataFrame:
    """Canonical addresses of the pages whose html holds more than ``most`` matches of ``pattern``. A page
    of the same address under another spelling or query is then blocked whatever its own html holds."""
    host, path = parts(F.col("url"))
    bad = F.coalesce(F.regexp_count(F.col("html"), F.lit(pattern)) > most, F.lit(False))
    return pages.where(bad).select(host.alias("host"), path.alias("path")).select(
        canonical(F.col("host"), F.col("path")).alias("canonical"))
