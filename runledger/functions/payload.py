"""Access to JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Where :func:`parse_line` keeps the line's own value.
LINE = "$[0]"


def parse_line(line: Column) -> Column:
    """A line holding exactly one JSON value, as a VARIANT that has it at ``LINE``; else null.

    Spark's parser stops after the first value. Wrapping the line in an array with its own
    length as a second element makes a tail of any kind visible. The value stays in that array, as
    taking it out would copy it.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), line, F.lit(","), F.length(line).cast("string"), F.lit("]")))
    closed = F.try_variant_get(wrapped, "$[1]", "int") == F.length(line)
    alone = F.try_variant_get(wrapped, "$[2]", "variant").isNull()
    return F.when(closed & alone, wrapped)


def parse_strict(line: Column) -> Column:
    """A line holding exactly one JSON value, as a VARIANT; else null."""
    return F.try_variant_get(parse_line(line), LINE, "variant")


def text_at(value: Column, path: str) -> Column:
    """Text of a path; objects and arrays come back as JSON text, numbers as written."""
    return F.try_variant_get(value, path, "string")


def is_present(value: Column, path: str) -> Column:
    """True where the path exists, even with an explicit null."""
    return F.try_variant_get(value, path, "variant").isNotNull()


def texts_at(value: Column, path: str, *names: str) -> Column:
    """Texts of the named fields of an object, as a struct; null where the path holds no object.

    The fields come out in one walk and short code: the JVM leaves a method of more than 8,000 bytes uncompiled.
    """
    return F.try_variant_get(value, path, f"struct<{', '.join(f'`{name}`: string' for name in names)}>")


def json_default(value: Column, path: str, default: str) -> Column:
    """Text of a path, the default only where the key is absent: an explicit null stays null."""
    return F.coalesce(text_at(value, path), F.when(~is_present(value, path), F.lit(default)))


def valid_epoch(text: Column, quoted: Column | None = None) -> Column:
    """Epoch of at least 1: a number is cut to an integer, quoted text must be an integer."""
    whole = text.try_cast("int")
    cut = F.coalesce(whole, text.try_cast("double").try_cast("int"))
    number = cut if quoted is None else F.when(quoted, whole).otherwise(cut)
    return F.when(number >= 1, number)


def reward_pct(metrics_json: Column) -> Column:
    """Share of right answers in an evaluation's metrics."""
    return F.get_json_object(metrics_json, "$.answer_reward.percentage").try_cast("double")
