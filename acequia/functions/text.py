"""Names, substring search and date text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from acequia.schema import UNKNOWN_LABEL

_OUTER_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# No text carries this character, so it can serve as a LIKE escape that never fires.
_NO_ESCAPE = "\u0001"


def full_name(*parts: Column) -> Column:
    """Trimmed non-blank parts joined by one space, or 'Desconocido' if none is left."""
    kept = [F.nullif(F.regexp_replace(p, _OUTER_BLANKS, ""), F.lit("")) for p in parts]
    return F.coalesce(F.nullif(F.concat_ws(" ", *kept), F.lit("")), F.lit(UNKNOWN_LABEL))


def contains_text(column: Column, text: str) -> Column:
    """Substring search in which ``%``, ``_`` and ``[..]`` in the text are wildcards."""
    if "[" in text:
        return column.rlike(r"(?s)\A.*" + _wildcards_to_regex(text) + r".*\z")
    return F.like(column, F.lit(f"%{text}%"), F.lit(_NO_ESCAPE))


def is_plain_text(text: str) -> bool:
    """Whether a searched text has no wildcard, so that it is found letter by letter."""
    return not any(c in text for c in "%_[")


def _wildcards_to_regex(text: str) -> str:
    """Java regular expression of a LIKE text that holds character classes."""
    out, i = [], 0
    while i < len(text):
        close = text.find("]", i + 1) if text[i] == "[" else -1
        if close > i + 1:
            body = text[i + 1:close]
            negate = "^" if body.startswith("^") and len(body) > 1 else ""
            body = body[len(negate):]
            out.append(f"[{negate}" + "".join(c if c == "-" else rf"\x{{{ord(c):x}}}" for c in body) + "]")
            i = close + 1
            continue
        out.append({"%": ".*", "_": "."}.get(text[i], rf"\x{{{ord(text[i]):x}}}"))
        i += 1
    return "".join(out)


def date_text(date: Column) -> Column:
    return date.cast("string")


def timestamp_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, with six decimals only when there is a fraction.

    The cast, unlike ``date_format``, does not pass through the session time zone.
    """
    text = ts.cast("string")
    return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)
