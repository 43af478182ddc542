"""Quality scores and the normaliser of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn import rules
from cairn.functions.expr import ColumnLike, col, days_between, first_case, has_any, names, text
from cairn.operators.maintenance import moment


def quality_columns(as_of: str | Column) -> dict[str, Column]:
    """Completeness, freshness, consistency, accuracy and their mean, by name."""
    age = days_between(moment(as_of), "modified_date")
    parts = {
        "completeness_score": F.when(F.coalesce(F.size("columns"), F.lit(0)) > 0, 0.8).otherwise(0.0),
        "freshness_score": first_case(
            [(F.col("modified_date").isNull(), 0.0)] + [(age < d, s) for d, s in rules.FRESHNESS_STEPS], 0.3
        ),
        "consistency_score": F.when(text("name").rlike(rules.CONSISTENT_NAME), 0.8).otherwise(0.6),
        "accuracy_score": F.lit(0.0),
    }
    return {**parts, "overall_quality_score": F.round(sum(parts.values(), F.lit(0.0)) / len(parts), 6)}


def quality_metrics(assets: DataFrame, as_of: str | Column) -> DataFrame:
    return assets.select("fingerprint", *[c.alias(n) for n, c in quality_columns(as_of).items()])


def field_types(columns: Column) -> Column:
    """(type, fields) of a columns array, by type; a field without a type counts as unknown."""
    kinds = F.transform(columns, lambda c: F.coalesce(c["type"], F.lit("unknown")))
    counted = F.transform(
        F.array_sort(F.array_distinct(kinds)),
        lambda t: F.struct(t.alias("type"), F.size(F.filter(kinds, lambda k: k == t)).alias("fields")),
    )
    return F.coalesce(counted, F.array().cast("array<struct<type:string,fields:int>>"))


def _any_contains(strings: Column, word: str) -> Column:
    return F.exists(strings, lambda s: s.contains(word))


def with_schema_analysis(assets: DataFrame) -> DataFrame:
    """Add field counts, description coverage, quality score, glossary terms and tags.

    Everything is read from the columns array of the row, so nothing is shuffled.
    """
    cols = F.col("columns")
    total = F.greatest(F.coalesce(F.size(cols), F.lit(0)), F.lit(0))
    described = F.coalesce(
        F.size(F.filter(cols, lambda c: F.trim(F.coalesce(c["description"], F.lit(""))) != "")), F.lit(0)
    )
    glossary = [w for group in rules.GLOSSARY_WORDS for w in group]
    held = F.col("_names")
    tags = [F.when(_any_contains(held, word), F.lit(tag)) for word, tag in rules.SCHEMA_TAGS]
    return (
        assets.withColumn("_names", names("columns"))
        .withColumns(
            {
                "total_fields": total,
                "fields_with_descriptions": F.greatest(described, F.lit(0)),
                "business_terms": F.coalesce(
                    F.transform(F.filter(cols, lambda c: has_any(F.lower(c["name"]), glossary)), lambda c: c["name"]),
                    F.array().cast("array<string>"),
                ),
                "schema_tags": F.array_compact(F.array(*tags)),
            }
        )
        .withColumn(
            "completeness",
            F.when(F.col("total_fields") > 0, F.col("fields_with_descriptions") / F.col("total_fields") * 100)
            .otherwise(0.0),
        )
        .withColumn(
            "data_quality_score",
            F.when(F.col("total_fields") == 0, 75).otherwise(
                F.least(F.lit(100), F.greatest(F.lit(60), F.floor("completeness").cast("int")))
            ),
        )
        .drop("_names")
    )


def schema_analysis(assets: DataFrame) -> DataFrame:
    return with_schema_analysis(assets).select(
        "fingerprint",
        "total_fields",
        "fields_with_descriptions",
        F.round("completeness", 4).alias("completeness"),
        "data_quality_score",
        "business_terms",
        "schema_tags",
        field_types(F.col("columns")).alias("field_types"),
    )


def _label(points: Column) -> Column:
    return first_case([(points >= 80, "High"), (points >= 60, "Medium")], "Low")


def quality_label(columns: ColumnLike, metadata: ColumnLike) -> Column:
    """High, Medium or Low: 50 for columns, 30 for metadata, 20 always."""
    points = (
        F.when(F.coalesce(F.size(col(columns)), F.lit(0)) > 0, 50).otherwise(0)
        + F.when(F.coalesce(F.size(col(metadata)), F.lit(0)) > 0, 30).otherwise(0)
        + 20
    )
    return _label(points)


def maintainability(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Label per asset: 50 if it is described, 30 with at most five edges, 20 always.

    `edges` has a target_id per lineage edge; counts are reduced before the join.
    """
    n = edges.groupBy(F.col("target_id").alias("fingerprint")).agg(F.count("*").alias("edges"))
    described = F.coalesce(F.element_at("metadata", "description"), F.lit("")) != ""
    counted = assets.join(n, "fingerprint", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    points = F.when(described, 50).otherwise(0) + F.when(F.col("edges") <= 5, 30).otherwise(0) + 20
    return counted.select("fingerprint", "edges", _label(points).alias("maintainability"))


# Default and fallback answers are fixed values.
_ANALYSIS = T.StructType(
    [
        T.StructField("summary", T.StringType()),
        T.StructField("insights", T.ArrayType(T.StringType())),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("quality_notes", T.StringType()),
        T.StructField("issues", T.ArrayType(T.StringType())),
        T.StructField("recommendations", T.StringType()),
        T.StructField("_bad", T.StringType()),
    ]
)
_ANALYSIS_DEFAULTS = {
    "summary": "AI analysis completed",
    "insights": ["Analysis completed successfully"],
    "quality_score": 75.0,
    "quality_notes": "Quality assessment completed",
    "issues": [],
    "recommendations": "No specific recommendations available",
}
_ANALYSIS_FALLBACK = {
    "summary": "AI analysis completed but response format was invalid",
    "insights": ["Analysis response received but could not be parsed"],
    "quality_score": 50.0,
    "quality_notes": "Could not assess quality due to parsing error",
    "issues": ["Response parsing failed"],
    "recommendations": "Please try again or contact support",
}
_SCAN = T.StructType(
    [
        T.StructField("pii_fields_count", T.LongType()),
        T.StructField("sensitive_fields_count", T.LongType()),
        T.StructField("total_fields_scanned", T.LongType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("pii_fields", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("sensitive_fields", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("compliance_notes", T.StringType()),
        T.StructField("_bad", T.StringType()),
    ]
)


def unfence(answer: ColumnLike) -> Column:
    """Answer text without a surrounding ```json fence."""
    body = F.regexp_replace(_strip(col(answer)), r"^```json", "")
    return _strip(F.regexp_replace(body, r"```$", ""))


def _strip(c: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _literal(value) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast("array<string>")
    return F.lit(value)


def _parsed(answers: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    body = unfence(column)
    # an answer that is not one JSON object is invalid as a whole
    return answers.withColumn("_p", F.from_json(body, schema, options)).withColumn(
        "_ok", F.col("_p").isNotNull() & F.col("_p._bad").isNull() & body.startswith("{")
    )


def parse_analysis(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Normalised analysis answers: defaults for absent keys, score clamped to 0..100."""
    p = _parsed(answers, column, _ANALYSIS)
    out = {}
    for name, default in _ANALYSIS_DEFAULTS.items():
        good = F.coalesce(F.col(f"_p.{name}"), _literal(default))
        if name == "quality_score":
            good = F.least(F.lit(100.0), F.greatest(F.lit(0.0), good))
        out[name] = F.when(F.col("_ok"), good).otherwise(_literal(_ANALYSIS_FALLBACK[name]))
    return p.withColumns(out).drop("_p", "_ok")


def parse_pii_scan(answers: DataFrame, column: str = "answer", fields: str = "field_count") -> DataFrame:
    """Normalised PII-scan answers; `fields` names the column with the number of fields asked about."""
    p = _parsed(answers, column, _SCAN)
    ok, asked = F.col("_ok"), F.col(fields).cast("bigint")
    zero = F.lit(0).cast("bigint")
    empty = F.array().cast("array<map<string,string>>")
    return p.withColumns(
        {
            "pii_fields_count": F.when(ok, F.coalesce("_p.pii_fields_count", zero)).otherwise(zero),
            "sensitive_fields_count": F.when(ok, F.coalesce("_p.sensitive_fields_count", zero)).otherwise(zero),
            "total_fields_scanned": F.when(ok, F.coalesce("_p.total_fields_scanned", asked)).otherwise(asked),
            "risk_level": F.when(ok, F.coalesce("_p.risk_level", F.lit("LOW"))).otherwise("UNKNOWN"),
            "pii_fields": F.when(ok, F.coalesce("_p.pii_fields", empty)).otherwise(empty),
            "sensitive_fields": F.when(ok, F.coalesce("_p.sensitive_fields", empty)).otherwise(empty),
            "compliance_notes": F.when(
                ok, F.coalesce("_p.compliance_notes", F.lit("No specific compliance issues identified"))
            ).otherwise("PII scan completed but response format was invalid"),
        }
    ).drop("_p", "_ok")
