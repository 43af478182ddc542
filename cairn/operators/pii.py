"""Personal data in column names and in values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn import rules
from cairn.functions.expr import compact, names
from cairn.functions.pii import (
    pii_categories,
    pii_match_count,
    pii_risks,
    pii_types_in_text,
    privacy_risk,
    redact,
    risk_bits,
    sensitive_matches,
)


def column_categories(columns_long: DataFrame) -> DataFrame:
    """(fingerprint, ordinal, column_name, category), a column may have several."""
    return columns_long.select(
        "fingerprint", "ordinal", "column_name", F.explode(pii_categories("column_name")).alias("category")
    )


def pii_findings(columns_long: DataFrame) -> DataFrame:
    """One row per (column, PII type) with its risk tier and tag; a narrow projection."""
    return columns_long.select(
        "fingerprint", "ordinal", "column_name", F.explode(pii_risks("column_name")).alias("r")
    ).select(
        "fingerprint",
        "ordinal",
        "column_name",
        F.col("r.pii_type").alias("pii_type"),
        F.col("r.risk").alias("risk"),
        F.concat(F.lower("r.risk"), F.lit("-risk-"), F.col("r.pii_type")).alias("tag"),
    )


def with_pii_summary(assets: DataFrame) -> DataFrame:
    """Add high/medium/low counts, risk and tags, read from the columns array (no shuffle).

    Each column name is tested once and leaves one bit per (risk, type) rule.
    """
    tiers = {t: sum(1 << i for i, (risk, _, _) in enumerate(rules.PII_RISKS) if risk == t) for t in ("High", "Medium", "Low")}
    tagged = sorted((f"{risk.lower()}-risk-{kind}", 1 << i) for i, (risk, kind, _) in enumerate(rules.PII_RISKS))

    def counted(tier: str) -> Column:
        return F.aggregate(
            "_pii", F.lit(0), lambda n, b: n + F.bit_count(b.bitwiseAND(tiers[tier])).cast("int")
        )

    return (
        assets.withColumn("_pii", F.transform(names("columns"), risk_bits))
        .withColumn("_any", F.aggregate("_pii", F.lit(0), lambda a, b: a.bitwiseOR(b)))
        .withColumns(
            {
                "high_risk_pii_count": counted("High"),
                "medium_risk_pii_count": counted("Medium"),
                "low_risk_pii_count": counted("Low"),
                "pii_tags": compact(*[F.when(F.col("_any").bitwiseAND(bit) > 0, F.lit(tag)) for tag, bit in tagged]),
            }
        )
        .withColumn(
            "pii_risk",
            F.when(F.col("high_risk_pii_count") > 0, "High")
            .when(F.col("medium_risk_pii_count") > 0, "Medium")
            .otherwise("Low"),
        )
        .drop("_pii", "_any")
    )


def pii_summary(assets: DataFrame) -> DataFrame:
    return with_pii_summary(assets).select(
        "fingerprint",
        "high_risk_pii_count",
        "medium_risk_pii_count",
        "low_risk_pii_count",
        "pii_risk",
        "pii_tags",
    )


def sensitive_columns(columns_long: DataFrame) -> DataFrame:
    """One row per column and matching pattern."""
    return columns_long.select(
        "fingerprint", "ordinal", "column_name", F.explode(sensitive_matches("column_name")).alias("pattern")
    )


def asset_privacy(assets: DataFrame) -> DataFrame:
    """PII types in name and location, sensitive column entries, and the privacy risk."""
    entries = F.coalesce(
        F.flatten(F.transform("columns", lambda c: sensitive_matches(c["name"]))), F.array().cast("array<string>")
    )
    return (
        assets.select(
            "fingerprint",
            pii_types_in_text(
                F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("location", F.lit("")))
            ).alias("pii_types"),
            entries.alias("entries"),
        )
        .withColumn("privacy_risk", privacy_risk("pii_types", "entries"))
        .select("fingerprint", "pii_types", F.size("entries").alias("sensitive_entries"), "privacy_risk")
    )


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def pii_scan(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Matches and rows hit per column and kind, over whole values of every string column.

    One pass: counting happens in the scan's tasks, only one row per task is shuffled.
    """
    cols = cols or text_columns(df)
    pairs = [(c, kind) for c in cols for kind in rules.PII_VALUE_PATTERNS]
    counts = df.select(*[pii_match_count(c, kind).alias(f"m{i}") for i, (c, kind) in enumerate(pairs)])
    one = counts.agg(
        *[F.coalesce(F.sum(f"m{i}"), F.lit(0)).alias(f"s{i}") for i in range(len(pairs))],
        *[F.count_if(F.col(f"m{i}") > 0).alias(f"r{i}") for i in range(len(pairs))],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(kind).alias("pii_type"),
                F.col(f"s{i}").alias("matches"),
                F.col(f"r{i}").alias("rows_hit"),
            )
            for i, (c, kind) in enumerate(pairs)
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def redact_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The same table with personal values replaced in the given (default: all) text columns."""
    return df.withColumns({c: redact(c) for c in (cols or text_columns(df))})


def rows_with_pii(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text holds personal data, with the kinds found."""
    return df.withColumn("pii_types", pii_types_in_text(column)).filter(F.size("pii_types") > 0)


