"""Shared by the tests of the llm package."""

import re

import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture
def table(spark):
    """Documents with extra columns whose names the operators use inside."""
    def make(rows, schema="doc_id long, text string, source string"):
        df = spark.createDataFrame(rows, schema)
        for name in ("key", "row", "node", "size", "place", "host", "kept", "label", "times", "whole", "removed_lines"):
            df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return make


def words(text):
    return WORD.findall((text or "").encode())


def lowered(text):
    """A-Z lower-cased, nothing else."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}
