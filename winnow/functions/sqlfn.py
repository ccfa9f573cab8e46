"""Column helpers under names for ``spark.sql`` users.

Each body states in SQL what the column helper of that name does; tests hold the two against each other.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Each temporary SQL function is a plain expression over its arguments.
SQL_FUNCTIONS = {
    "w_slug(s STRING) RETURNS STRING": (
        r"coalesce(nullif(regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-'), '^-+|-+$', ''), ''), 'unknown')"
    ),
    "w_name(s STRING) RETURNS STRING": (
        r"trim(regexp_replace(regexp_replace(lower(s), r'(?U)[^\p{L}\p{N}_\s-]', ' '), r'(?U)\s+', ' '))"
    ),
    "w_caip2(ns STRING, ref STRING) RETURNS STRING": "concat(trim(lower(ns)), ':', trim(ref))",
    "w_endpoint_hash(u STRING) RETURNS STRING": "sha2(trim(coalesce(u, '')), 256)",
    # Exact for ASCII; other channels need the Column, whose case-folding SQL does not have.
    "w_channel_hash(u STRING) RETURNS STRING": r"sha2(lower(regexp_replace(coalesce(u, ''), r'(?U)^\s+|\s+$', '')), 256)",
    "w_bucket(t TIMESTAMP, m INT) RETURNS STRING": (
        "concat(m, 'm:', cast(floor(unix_timestamp(t) / (greatest(1, m) * 60)) as bigint))"
    ),
    "w_age_days(t TIMESTAMP, as_of TIMESTAMP) RETURNS DOUBLE": (
        "(unix_micros(as_of) - unix_micros(t)) / 86400000000D"
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions and return their names."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in SQL_FUNCTIONS]
