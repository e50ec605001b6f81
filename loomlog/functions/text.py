"""Text functions of the log as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .eventxml import KEY_VALUE, SPACE

#: Names of levels.
LEVELS = {1: "Critical", 2: "Error", 3: "Warning", 4: "Information", 5: "Verbose"}
UI_LEVELS = {0: "LogAlways"} | LEVELS
#: Characters and their entities, in the order in which they are replaced.
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def level_text(level: Column, names: dict[int, str] = LEVELS) -> Column:
    named = reduce(lambda c, kv: c.when(level == kv[0], kv[1]), names.items(), F.when(level.isNull(), None))
    return named.otherwise(F.concat(F.lit("Level "), level.cast("string")))


def xml_escape(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), _ESCAPES, text)


def entity_decode(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[1]), F.lit(kv[0])), (*_ESCAPES[1:], _ESCAPES[0]), text)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def hex32(n: Column) -> Column:
    """At least eight digits; larger and negative numbers keep all of theirs."""
    digits = F.lower(F.hex(n))
    return F.concat(F.lit("0x"), F.lpad(digits, F.greatest(F.length(digits), F.lit(8)), F.lit("0")))


def hex_dump(data: Column) -> Column:
    return F.trim(F.regexp_replace(F.hex(data), "(..)", "$1 "))


def format_bytes(n: Column) -> Column:
    """Whole bytes with two decimals in B, KB, MB or GB."""
    at = lambda k, unit: F.concat(F.format_string("%.2f", n.cast("double") / float(1024**k)), F.lit(f" {unit}"))
    return F.when(n == 0, "0 B").when(n < 1024, at(0, "B")).when(n < 1024**2, at(1, "KB")).when(n < 1024**3, at(2, "MB")).otherwise(at(3, "GB"))


def file_type(name: Column) -> Column:
    low = F.lower(name)
    ends = lambda *xs: reduce(lambda a, b: a | b, [low.endswith(x) for x in xs])
    return F.when(ends(".evtx"), "evtx").when(ends(".json"), "json").when(ends(".txt", ".log"), "txt").when(ends(".xml"), "xml").otherwise("unknown")


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.evtx$", "")


def tag_text(xml: Column, tag: str) -> Column:
    """Text of the first element ``tag``, empty where there is none or it closes itself (well-formed text)."""
    return F.coalesce(F.regexp_extract(xml, rf"(?s)<{tag}(?:[ /\t\n\r](?:[^>]*[^/>])?)?>(.*?)</{tag}>", 1), F.lit(""))


def attribute_value(xml: Column, tag: str, attribute: str) -> Column:
    return F.coalesce(F.regexp_extract(xml, rf'<{tag}(?=[> /\t\n\r])[^>]*?{attribute}="([^">]*)"[^>]*>', 1), F.lit(""))


def data_pairs(section: Column) -> Column:
    """Lines of the Data elements of a section of well-formed text."""
    whole = F.regexp_extract_all(section, F.lit(r"(?s)(<Data(?:[^>]*[^/>])?>.*?</Data>)"), 1)
    name = lambda x: F.regexp_extract(x, r'^<Data[^>]*?Name="([^">]*)"', 1)
    value = lambda x: entity_decode(F.regexp_extract(x, r"(?s)^<Data[^>]*>(.+)</Data>$", 1))
    whole = F.filter(whole, lambda x: value(x) != "")
    return F.array_join(F.transform(whole, lambda x: F.when(x.rlike(r'^<Data[^>]*?Name="[^">]*"'), F.concat(name(x), F.lit(": "), value(x))).otherwise(value(x))), "\n")


def leaf_pairs(section: Column) -> Column:
    """Lines ``tag: text`` of the elements of a section of well-formed text that hold only text."""
    whole = F.regexp_extract_all(section, F.lit(r"(<([^ >/!?\t\n\r]+)(?:[ \t\n\r][^>]*[^/>]|)>[^<]*</\2>)"), 1)
    tag = lambda x: F.regexp_extract(x, r"^<([^ >/\t\n\r]+)", 1)
    value = lambda x: trim(F.regexp_extract(x, r"^<[^>]*>([^<]*)<", 1))
    return F.array_join(F.transform(F.filter(whole, lambda x: value(x) != ""), lambda x: F.concat(tag(x), F.lit(": "), entity_decode(value(x)))), "\n")


def key_values(event_data: Column) -> Column:
    """Array of (label, value) of the lines ``key: value``, in order; labels may repeat."""
    pattern = f"^{KEY_VALUE}$"
    lines = F.filter(F.transform(F.split(event_data, "\n"), trim), lambda x: x.rlike(pattern))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("label"), F.regexp_extract(x, pattern, 2).alias("value")))


def message_lines(event_data: Column) -> Column:
    """The other lines."""
    pattern = f"^{KEY_VALUE}$"
    return F.array_join(F.filter(F.transform(F.split(event_data, "\n"), trim), lambda x: (x != "") & ~x.rlike(pattern)), "\n")


def stats_line(records: Column, chunks: Column, size: Column, millis: Column, definitions: Column, references: Column, missing: Column, errors: Column) -> Column:
    n = lambda c: c.cast("string")
    parts = [F.concat(n(records), F.lit(" records")), F.concat(n(chunks), F.lit(" chunks")), F.concat(F.format_string("%.1f", size / 1024.0), F.lit(" KB")), F.concat(F.format_string("%.0f", millis.cast("double")), F.lit("ms")), F.concat(n(definitions), F.lit(" templates")), F.concat(n(references), F.lit(" refs"))]
    tails = [F.when(missing > 0, F.concat(n(missing), F.lit(" missing!"))), F.when(errors > 0, F.concat(n(errors), F.lit(" errors")))]
    return F.concat_ws(" · ", *parts, *tails)
