"""The log's functions for SQL text, as temporary SQL functions: Catalyst inlines them, no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .eventxml import KEY_VALUE

_LE32 = "conv(concat(hex(substring(b, {0} + 4, 1)), hex(substring(b, {0} + 3, 1)), hex(substring(b, {0} + 2, 1)), hex(substring(b, {0} + 1, 1))), 16, 10)"
_KEY_VALUE = "'^" + KEY_VALUE.replace("\\", "\\\\") + "$'"

FUNCTIONS = {
    "guid_text(b BINARY) RETURNS STRING": """CASE WHEN length(b) < 16 THEN '' ELSE concat('{',
        lower(concat(hex(substring(b, 4, 1)), hex(substring(b, 3, 1)), hex(substring(b, 2, 1)), hex(substring(b, 1, 1)))), '-',
        lower(concat(hex(substring(b, 6, 1)), hex(substring(b, 5, 1)))), '-', lower(concat(hex(substring(b, 8, 1)), hex(substring(b, 7, 1)))), '-',
        hex(substring(b, 9, 2)), '-', hex(substring(b, 11, 6)), '}') END""",
    "sid_text(b BINARY) RETURNS STRING": f"""CASE WHEN length(b) < 8 THEN '' ELSE array_join(concat(
        array('S', conv(hex(substring(b, 1, 1)), 16, 10), conv(hex(substring(b, 3, 6)), 16, 10)),
        transform(filter(sequence(0, 255), i -> i < cast(conv(hex(substring(b, 2, 1)), 16, 10) AS INT) AND 12 + 4 * i <= length(b)), i -> {_LE32.format("8 + 4 * i")})), '-') END""",
    "filetime_ticks(b BINARY) RETURNS DECIMAL(20,0)": "CAST(conv(concat(" + ", ".join(f"hex(substring(b, {i}, 1))" for i in range(8, 0, -1)) + "), 16, 10) AS DECIMAL(20,0))",
    "filetime_iso(ticks BIGINT) RETURNS STRING": """CASE WHEN ticks = 0 THEN '' ELSE concat(date_format(timestamp_seconds(floor(ticks / 10000000BD) - 11644473600), "yyyy-MM-dd'T'HH:mm:ss."), lpad(CAST(pmod(ticks, 10000000) AS STRING), 7, '0'), 'Z') END""",
    "hex32(n BIGINT) RETURNS STRING": "concat('0x', lower(lpad(hex(n), greatest(length(hex(n)), 8), '0')))",
    "xml_escape(s STRING) RETURNS STRING": """replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), "'", '&apos;')""",
    "event_data_kv(s STRING) RETURNS TABLE (label STRING, value STRING)": f"SELECT regexp_extract(x, {_KEY_VALUE}, 1), regexp_extract(x, {_KEY_VALUE}, 2) FROM (SELECT explode(transform(split(s, '\\n'), y -> trim(y))) AS x) WHERE x RLIKE {_KEY_VALUE}",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
