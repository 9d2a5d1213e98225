"""Column expressions. All are built-in Spark expressions; none is a Python UDF."""

from acequia.functions.numbers import round_half_even, round_or_null_if_zero, zero_if_null
from acequia.functions.places import interleaved, lon_lat
from acequia.functions.shapes import coordinate, false_if_null, month_map, right_type_label
from acequia.functions.text import contains_text, date_text, full_name, is_plain_text, timestamp_text

__all__ = [
    "contains_text", "coordinate", "date_text", "false_if_null", "full_name", "interleaved",
    "is_plain_text", "lon_lat", "month_map", "right_type_label", "round_half_even", "round_or_null_if_zero",
    "timestamp_text", "zero_if_null",
]
