"""An inverted index of trigrams, for searches of a text inside a code or name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from acequia.functions import contains_text, is_plain_text

#: Letters of an indexed run. A shorter text, or one with wildcards, is searched in all rows.
LENGTH = 3


def _runs(text: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(text) - LENGTH + 1)
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(LENGTH))))


def postings(table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(columna, trigrama, texto): the distinct texts of the columns by each run of three letters."""
    texts = F.array(*(F.struct(F.lit(c).alias("columna"), F.col(c).alias("texto")) for c in columns))
    long_enough = table.select(F.inline(texts)).distinct().where(F.length("texto") >= LENGTH)
    return long_enough.select("columna", F.explode(_runs(F.col("texto"))).alias("trigrama"), "texto")


def is_indexed(text: str) -> bool:
    return is_plain_text(text) and len(text) >= LENGTH


def texts_with(index: DataFrame, column: str, text: str) -> DataFrame:
    """The texts of a column that contain ``text``: those that hold all of its runs, then compared."""
    runs = sorted({text[i : i + LENGTH] for i in range(len(text) - LENGTH + 1)})
    held = index.where((F.col("columna") == column) & F.col("trigrama").isin(runs)).groupBy("texto").agg(
        F.count(F.lit(1)).alias("n"))
    return held.where((F.col("n") == len(runs)) & contains_text(F.col("texto"), text)).select("texto")


def rows_with(table: DataFrame, index: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose ``column`` contains ``text``; postings are joined first, where the text is indexed."""
    if not is_indexed(text):
        return table.where(contains_text(F.col(column), text))
    found = texts_with(index, column, text)
    return table.join(found, F.col(column) == F.col("texto"), "left_semi")
