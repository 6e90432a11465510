"""Content hashes and the 31-based string hash."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecall.functions.text import strip_controls


def _safe(c: Column) -> Column:
    return F.coalesce(strip_controls(c), F.lit(""))


def content_hash(canonical_url, date_posted, description, employment_type, identifier,
                 location_text, org_name, title) -> Column:
    """SHA-256 hex of a JSON object with sorted keys; nulls count as empty text."""
    fields = F.struct(
        _safe(canonical_url).alias("canonical_url"),
        F.coalesce(date_posted.cast("string"), F.lit("")).alias("date_posted"),
        _safe(description).alias("description"),
        _safe(employment_type).alias("employment_type"),
        _safe(identifier).alias("identifier"),
        _safe(location_text).alias("location_text"),
        _safe(org_name).alias("org_name"),
        _safe(title).alias("title"),
    )
    return F.sha2(F.to_json(fields), 256)


def string_hash_hex(c: Column) -> Column:
    """Eight upper-case hex digits of the 32-bit h*31+char hash of ASCII text."""
    chars = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    code = F.aggregate(
        chars,
        F.lit(0).cast("bigint"),
        lambda h, x: (h * 31 + x.cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")),
    )
    return F.lpad(F.hex(code), 8, "0")


def packed_hash(c: Column) -> Column:
    """A hash as bytes, half as long if it is lower-case hex; null is the empty string, so packed ones compare."""
    text = c.cast("string")
    pairs = text.rlike("\\A([0-9a-f]{2})+\\z")
    packed = F.when(pairs, F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(
        F.concat(F.lit(b"\x00"), text.cast("binary")))
    return F.coalesce(packed, F.lit(b""))


def unpacked_hash(c: Column) -> Column:
    rest = F.substring(c, 2, 0x7FFFFFFF)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).when(
        F.length(c) > 0, rest.cast("string"))
