"""Column functions that Spark lacks, from built-in ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def source_of(doc_id: Column) -> Column:
    """What stands before the first ``::``; all of it without one."""
    return F.substring_index(doc_id, "::", 1)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths, empty ones and ones of norm 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def md5_short(text: Column) -> Column:
    """The first four bytes of the MD5 as a little-endian number, in hexadecimal without leading zeros."""
    m = F.md5(text.cast("binary"))
    swapped = F.concat(F.substring(m, 7, 2), F.substring(m, 5, 2), F.substring(m, 3, 2), F.substring(m, 1, 2))
    return F.lower(F.conv(swapped, 16, 16))


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` bytes, cut between characters, with an ellipsis if cut."""
    chars = F.substring(text, 1, most)
    over = F.octet_length(chars) - most
    cut = F.when(over <= 0, chars).otherwise(_fit(chars, most))
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit("..."))).otherwise(text)


def _fit(chars: Column, most: int) -> Column:
    """The longest head of ``chars`` of at most ``most`` bytes: bytes beyond it are cut, and so is a split character."""
    head = F.substring(F.encode(chars, "UTF-8"), 1, most)
    whole = F.try_validate_utf8(head.cast("string"))
    shorter = [F.try_validate_utf8(F.substring(F.encode(chars, "UTF-8"), 1, most - k).cast("string")) for k in (1, 2, 3)]
    return F.coalesce(whole, *shorter, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)
