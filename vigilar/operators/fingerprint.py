"""Order-aware fingerprints of tables, combined level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FAN_BITS = 12
_LEVELS = 6  # 6 * 12 bits cover every LONG id
_SIGN = -(1 << 63)  # flipped, so that ids compare as unsigned numbers


def table_fingerprint(df: DataFrame, value: str | Column = "full_query", row_id: str = "row_id", salt: str = "") -> DataFrame:
    """One row, ``fingerprint``: a digest over all rows in the order of their (unique) ids.

    Rows are hashed (a NULL unlike an empty text), then ids sharing all but their last 12
    bits are combined in order, and so on upwards; no step gathers more than 4096 digests.
    """
    c = F.col(value) if isinstance(value, str) else value
    level = df.select(F.col(row_id).cast("long").alias("id"), F.md5(F.coalesce(c.cast("string"), F.lit("\0null"))).alias("h"))
    level = level.withColumn("id", F.col("id").bitwiseXOR(F.lit(_SIGN)))
    for _ in range(_LEVELS):
        grouped = level.groupBy(F.shiftrightunsigned("id", _FAN_BITS).alias("up")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("id").bitwiseXOR(F.lit(_SIGN)).alias("id"), "h"))).alias("parts")
        )
        joined = F.array_join(F.transform("parts", lambda p: p["h"]), "")
        level = grouped.select(F.col("up").alias("id"), F.md5(joined).alias("h"))
    return level.select(F.md5(F.concat(F.lit(salt), F.lit(":"), F.col("h"))).alias("fingerprint"))


def table_digest(df: DataFrame) -> str:
    """Digest of the rows of a table in any order, with their number; one pass, one small row."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    row = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum((h % 1_000_000_007).cast("decimal(38,0)"))).first()
    return ":".join(map(str, row))
