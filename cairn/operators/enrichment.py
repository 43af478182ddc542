"""All facts of an asset in one narrow projection: the enrichment step of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import classify as C
from cairn.functions.expr import text
from cairn.functions.pii import pii_types_in_text, privacy_risk, sensitive_matches
from cairn.operators.governance import importance, simple_domain
from cairn.operators.lineage import hint_columns
from cairn.operators.maintenance import moment
from cairn.operators.quality import quality_columns


def extract_metadata(assets: DataFrame, as_of: str | Column, detect_pii: bool = True) -> DataFrame:
    """One row per asset: fingerprint, basic facts, and a struct each for quality, personal data,
    business context, technical facts and lineage hints.

    Row by row, so nothing is shuffled.  `file` is null for other types; `table` (row and column counts,
    keys) is null unless the source names a database.  A missing text counts as empty, a missing list as
    empty, a missing size as 0.
    """
    entries = F.coalesce(F.flatten(F.transform("columns", _sensitive)), F.array().cast("array<string>"))
    domain = simple_domain("name", "location")
    keys = C.key_flags("columns")
    facts = {
        "discovery_timestamp": moment(as_of),
        "data_classification": C.data_classification("type"),
        "estimated_value": C.estimated_value("name", "location", "size"),
        "file": C.file_facts("type", "location", "metadata"),
        "quality_metrics": F.struct(*[c.alias(n) for n, c in quality_columns(as_of).items()]),
        "business_context": F.struct(
            domain.alias("domain"),
            importance(domain, "size").alias("business_importance"),
            F.lit("unknown").alias("usage_frequency"),
        ),
        "technical_metadata": C.technical_flags("type", "name", "location"),
        "table": F.when(
            text("source").contains("database"),
            F.struct(F.coalesce("num_rows", F.lit(0)).alias("row_count"), keys.alias("keys")),
        ),
        "lineage_hints": F.struct(*[c.alias(n) for n, c in hint_columns().items()]),
    }
    if not detect_pii:
        return assets.select("fingerprint", *[c.alias(n) for n, c in facts.items()])
    kinds = pii_types_in_text(F.concat(text("name"), F.lit(" "), text("location")))
    # kinds and entries are columns of their own first, so that each is worked out once
    found = assets.withColumns({"_kinds": kinds, "_entries": entries})
    risk = F.coalesce(privacy_risk("_kinds", "_entries"), F.lit("low"))
    facts["pii_detection"] = F.struct(
        ((F.size("_kinds") > 0) | (F.size("_entries") > 0)).alias("contains_pii"),
        F.col("_kinds").alias("pii_types"),
        F.col("_entries").alias("sensitive_columns"),
        risk.alias("privacy_risk_level"),
    )
    return found.select("fingerprint", *[c.alias(n) for n, c in facts.items()])


def _sensitive(column: Column) -> Column:
    """The column's name, once for every sensitive pattern that it meets."""
    return F.transform(sensitive_matches(column["name"]), lambda _: column["name"])
