"""Personal-data rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import rules
from cairn.functions.expr import ColumnLike, col, compact, first_case, has_any, low


def pii_categories(column_name: ColumnLike) -> Column:
    """Categories suggested by a column name; possibly several."""
    n = low(column_name)
    return compact(*[F.when(has_any(n, words), F.lit(label)) for label, words in rules.PII_CATEGORIES])


def pii_risks(column_name: ColumnLike) -> Column:
    """(risk, pii_type) structs, at most one per type, for a column name."""
    n = low(column_name)
    return compact(
        *[
            F.when(has_any(n, words), F.struct(F.lit(risk).alias("risk"), F.lit(kind).alias("pii_type")))
            for risk, kind, words in rules.PII_RISKS
        ]
    )


def risk_bits(lower_name: Column) -> Column:
    """The rules of pii_risks a lower-cased column name meets, as one bit each in list order."""
    bits = [F.when(has_any(lower_name, words), 1 << i).otherwise(0) for i, (_, _, words) in enumerate(rules.PII_RISKS)]
    return sum(bits[1:], bits[0])


def sensitive_matches(column_name: ColumnLike) -> Column:
    """Every sensitive pattern matched by a column name, in list order."""
    n = low(column_name)
    return compact(*[F.when(n.rlike("^" + p), F.lit(p)) for p in rules.SENSITIVE_COLUMN_PATTERNS])


# Every match of the kind holds this character, so a text without it needs no regular expression.
_MARK = {"email": "@", "ssn": "-", "ip_address": "."}


def _possible(value: Column, kind: str) -> Column:
    return value.contains(_MARK[kind]) if kind in _MARK else F.lit(True)


def pii_types_in_text(value: ColumnLike) -> Column:
    """Kinds of personal data present in a text, case-insensitive."""
    v = col(value)
    return compact(
        *[F.when(_possible(v, k) & v.rlike("(?i)" + p), F.lit(k)) for k, p in rules.PII_VALUE_PATTERNS.items()]
    )


def pii_match_count(value: ColumnLike, kind: str) -> Column:
    """Matches of one kind in a text; 0 for null."""
    v = col(value)
    n = F.regexp_count(v, F.lit("(?i)" + rules.PII_VALUE_PATTERNS[kind]))
    return F.coalesce(F.when(_possible(v, kind), n).otherwise(0), F.lit(0))


def privacy_risk(pii_types: ColumnLike, sensitive_entries: ColumnLike) -> Column:
    """high, medium or low from the number of types and of sensitive entries; null without any."""
    t, s = F.size(col(pii_types)), F.size(col(sensitive_entries))
    return first_case(
        [
            ((t == 0) & (s == 0), F.lit(None).cast("string")),
            ((t > 2) | (s > 3), "high"),
            ((t > 0) | (s > 1), "medium"),
        ],
        "low",
    )


def redact(value: ColumnLike, kinds: list[str] | None = None) -> Column:
    """Replace every personal value by `[kind]`.

    Kinds are applied from the longest digit pattern to the shortest, so a card number is
    not first taken apart as a phone number.
    """
    order = ["email", "credit_card", "ip_address", "ssn", "phone"]
    out = col(value)
    for kind in order:
        if kinds is None or kind in kinds:
            cut = F.regexp_replace(out, "(?i)" + rules.PII_VALUE_PATTERNS[kind], f"[{kind}]")
            out = F.when(out.contains(_MARK[kind]), cut).otherwise(out) if kind in _MARK else cut
    return out
