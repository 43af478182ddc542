"""Display helpers: sizes, ages and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.expr import ColumnLike, col, first_case, lits

UNITS = ["Bytes", "KB", "MB", "GB", "TB"]


def format_bytes(size: ColumnLike) -> Column:
    b = col(size).cast("double")
    step = first_case([(b < 1024.0**k, k - 1) for k in range(1, len(UNITS))], len(UNITS) - 1)
    shown = F.regexp_replace(
        F.format_string("%.2f", F.round(b / F.pow(F.lit(1024.0), step), 2)), r"\.?0+$", ""
    )
    return first_case(
        [(b.isNull(), F.lit(None).cast("string")), (b == 0, "0 Bytes")],
        F.concat(shown, F.lit(" "), F.element_at(lits(UNITS), step + 1)),
    )


def time_ago(moment: ColumnLike, as_of: ColumnLike) -> Column:
    secs = F.floor(
        (F.unix_micros(col(as_of).cast("timestamp")) - F.unix_micros(col(moment).cast("timestamp"))) / 1_000_000
    ).cast("bigint")

    def spoken(unit: str, seconds: int) -> Column:
        n = F.floor(secs / seconds).cast("bigint")
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))

    return first_case(
        [
            (col(moment).isNull(), "Unknown time"),
            (secs < 60, "Just now"),
            (secs < 3600, spoken("minute", 60)),
            (secs < 86400, spoken("hour", 3600)),
        ],
        spoken("day", 86400),
    )


def parse_iso(value: ColumnLike) -> Column:
    """ISO text to timestamp in the session zone (UTC); a trailing Z means UTC, bad text is null."""
    return F.try_to_timestamp(F.regexp_replace(col(value), "Z$", "+00:00"))
