"""Business metadata of assets.

Every rule reads only the asset's own row (its columns are an array in that row), so the
whole of business_metadata is one narrow projection: no join, no shuffle, any catalog size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import rules
from cairn.functions.expr import (
    ColumnLike,
    col,
    compact,
    days_between,
    first_case,
    has_any,
    lits,
    lookup,
    low,
    names,
)
from cairn.operators.maintenance import moment
from cairn.operators.pii import with_pii_summary
from cairn.operators.quality import with_schema_analysis

MIB = 1024 * 1024


def simple_domain(name: ColumnLike, location: ColumnLike) -> Column:
    both = F.concat(low(name), F.lit(" "), low(location))
    return first_case([(has_any(both, words), d) for d, words in rules.SIMPLE_DOMAINS], "unknown")


def importance(domain: ColumnLike, size: ColumnLike) -> Column:
    s = F.coalesce(col(size), F.lit(0))
    return first_case(
        [(col(domain).isin("finance", "hr") | (s > 1_000_000), "high"), (s > 100_000, "medium")], "low"
    )


def with_business_domain(assets: DataFrame) -> DataFrame:
    """Add the best scoring domain: a point per keyword in the name, half a point per matching column.

    Among equal scores the domain met first wins: name hits in list order, then columns by
    ordinal.  Each column name is tested once and leaves a bit per domain; the steps are kept
    apart so that no step is evaluated twice.
    """
    all_words = [w for _, words in rules.DOMAINS for w in words]

    def bits(name: Column) -> Column:
        each = [F.when(has_any(name, words), 1 << i).otherwise(0) for i, (_, words) in enumerate(rules.DOMAINS)]
        return F.when(has_any(name, all_words), sum(each[1:], each[0])).otherwise(0)

    def points(words: list[str]) -> Column:
        return sum((_one("_name", w) for w in words[1:]), _one("_name", words[0]))

    return (
        assets.withColumns({"_name": low("name"), "_bits": F.transform(names("columns"), bits)})
        .withColumn("_points", F.array(*[points(words) for _, words in rules.DOMAINS]))
        .withColumn("_best", F.array_max(F.array(*[_domain_entry(i, d) for i, (d, _) in enumerate(rules.DOMAINS)])))
        .withColumn(
            "business_domain",
            F.when(F.col("_best.score") > 0, F.col("_best.domain")).otherwise(rules.DEFAULT_DOMAIN),
        )
        .drop("_name", "_bits", "_points", "_best")
    )


def _one(column: str, word: str) -> Column:
    return F.when(F.col(column).contains(word), 1).otherwise(0)


def _domain_entry(i: int, domain: str) -> Column:
    """Score of one domain; structs compare field by field, so their maximum is the winner."""
    in_name = F.get("_points", F.lit(i))
    in_columns = F.aggregate("_bits", F.lit(0), lambda n, b: n + F.getbit(b, F.lit(i)).cast("int"))
    first = F.array_position(F.transform("_bits", lambda b: F.getbit(b, F.lit(i)).cast("int")), 1)
    return F.struct(
        (in_name + in_columns * 0.5).cast("double").alias("score"),
        F.when(in_name > 0, 1).otherwise(0).alias("by_name"),
        F.when(in_name > 0, F.lit(0)).otherwise(-first).cast("bigint").alias("first"),
        F.lit(-i).alias("rank"),
        F.lit(domain).alias("domain"),
    )


def size_category(size: ColumnLike) -> Column:
    return first_case([(col(size) > 100 * MIB, "Large"), (col(size) > 10 * MIB, "Medium")], "Small")


def volume_analysis(assets: DataFrame) -> DataFrame:
    return assets.select("fingerprint", *[c.alias(n) for n, c in _volume().items()])


def _volume() -> dict[str, Column]:
    n = F.coalesce(F.size("columns"), F.lit(0))
    size = F.coalesce(F.col("size"), F.lit(0))
    grown = days_between("modified_date", "created_date")
    return {
        "size_category": size_category(size),
        "is_large_dataset": size > 100 * MIB,
        "estimated_records": F.when(n > 0, F.floor(size / (n * 50)).cast("bigint")).otherwise(F.lit(0).cast("bigint")),
        "growth_rate": first_case(
            [(grown.isNull() | (grown <= 0), "Unknown"), (grown < 30, "High"), (grown < 90, "Medium")], "Low"
        ),
    }


def usage_patterns(assets: DataFrame, as_of: str | Column) -> DataFrame:
    return assets.select("fingerprint", *[c.alias(n) for n, c in _usage(as_of).items()])


def _usage(as_of: str | Column) -> dict[str, Column]:
    now = moment(as_of)
    word = has_any(low("name"), rules.HEAVY_USE_WORDS)
    dated = F.col("last_scanned").isNotNull() & F.col("modified_date").isNotNull()
    scan, change = days_between(now, "last_scanned"), days_between(now, "modified_date")
    return {
        "usage_frequency": first_case(
            [
                (dated & (scan < 1), "High"),
                (dated & (scan < 7), "Medium"),
                (dated, "Low"),
                (word, "High"),
            ],
            "Medium",
        ),
        "is_highly_used": word | (dated & (scan < 1)),
        "access_pattern": first_case(
            [(dated & (change < 7), "Active"), (dated & (change < 30), "Regular"), (dated, "Archive")], "Regular"
        ),
        "business_criticality": F.when(word, "High").otherwise("Medium"),
    }


def compliance(name: ColumnLike, columns: ColumnLike, high_risk: ColumnLike) -> dict[str, Column]:
    """required_compliance and compliance_tags from PII tier, column names and asset name."""
    n = low(name)
    privacy = col(high_risk) > 0
    cards = F.exists(names(columns), lambda c: has_any(c, rules.PCI_WORDS))
    health, finance = has_any(n, rules.HIPAA_WORDS), has_any(n, rules.SOX_WORDS)
    when = lambda cond, word: F.when(cond, F.lit(word))
    return {
        "required_compliance": compact(
            when(privacy, "GDPR"),
            when(privacy, "CCPA"),
            when(cards, "PCI-DSS"),
            when(health, "HIPAA"),
            when(finance, "SOX"),
            when(finance, "Basel III"),
        ),
        "compliance_tags": compact(
            when(privacy, "gdpr"),
            when(privacy, "ccpa"),
            when(privacy, "privacy"),
            when(cards, "pci-dss"),
            when(health, "hipaa"),
            when(finance, "sox"),
            when(finance, "basel"),
        ),
    }


def sensitivity(high: ColumnLike, medium: ColumnLike) -> Column:
    return first_case([(col(high) > 0, "High"), (col(medium) > 0, "Medium")], "Low")


def classification(sensitivity_level: ColumnLike, required: ColumnLike) -> Column:
    level = col(sensitivity_level)
    return first_case(
        [
            ((level == "High") | F.array_contains(col(required), "GDPR"), "Confidential"),
            (level == "Medium", "Internal"),
        ],
        "Public",
    )


def business_tags(*tag_lists: ColumnLike) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[col(t) for t in tag_lists])))


def criticality(sensitivity_level: ColumnLike, large: ColumnLike, highly_used: ColumnLike) -> Column:
    level = col(sensitivity_level)
    points = (
        first_case([(level == "High", 3), (level == "Medium", 2)], 1)
        + F.when(col(large), 2).otherwise(0)
        + F.when(col(highly_used), 2).otherwise(0)
    )
    return first_case([(points >= 5, "High"), (points >= 3, "Medium")], "Low")


def retention_policy(domain: ColumnLike) -> Column:
    return lookup(rules.RETENTION, col(domain), F.lit(rules.DEFAULT_RETENTION))


def related_processes(domain: ColumnLike) -> Column:
    cases = [(col(domain) == d, lits(p)) for d, p in rules.PROCESSES.items()]
    return first_case(cases, lits(rules.DEFAULT_PROCESSES))


def last_review() -> Column:
    return F.coalesce("last_scanned", "modified_date", "created_date")


def purpose(domain: ColumnLike, high_risk: ColumnLike, large: ColumnLike) -> Column:
    start = first_case(
        [
            (col(high_risk) > 0, "Data asset containing personal information for "),
            (col(large), "Large-scale data asset supporting "),
        ],
        "Data asset supporting ",
    )
    return F.concat(start, F.lower(col(domain)), F.lit(" operations"))


def business_metadata(assets: DataFrame, as_of: str | Column) -> DataFrame:
    """Full business metadata of every asset."""
    wide = with_pii_summary(with_schema_analysis(assets))
    wide = wide.withColumns({**_volume(), **_usage(as_of), **compliance("name", "columns", "high_risk_pii_count")})
    wide = with_business_domain(wide).withColumn(
        "sensitivity_level", sensitivity("high_risk_pii_count", "medium_risk_pii_count")
    )
    return wide.select(
        "fingerprint",
        "business_domain",
        classification("sensitivity_level", "required_compliance").alias("data_classification"),
        F.lit("To be assigned").alias("business_owner"),
        F.lit("To be assigned").alias("data_steward"),
        purpose("business_domain", "high_risk_pii_count", "is_large_dataset").alias("business_purpose"),
        retention_policy("business_domain").alias("retention_policy"),
        "sensitivity_level",
        F.col("required_compliance").alias("compliance_requirements"),
        business_tags("schema_tags", "pii_tags", "compliance_tags").alias("business_tags"),
        "data_quality_score",
        "usage_frequency",
        criticality("sensitivity_level", "is_large_dataset", "is_highly_used").alias("criticality"),
        last_review().alias("last_business_review"),
        F.col("business_terms").alias("business_glossary_terms"),
        related_processes("business_domain").alias("related_processes"),
        F.lit("Available").alias("data_lineage_status"),
        "size_category",
        "growth_rate",
        "estimated_records",
        "access_pattern",
        "high_risk_pii_count",
        "medium_risk_pii_count",
        "low_risk_pii_count",
    )
