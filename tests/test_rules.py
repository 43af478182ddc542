"""Truth tables of the scalar and array rules."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairn.functions import classify as C
from cairn.functions import display as D
from cairn.functions import masking, pii
from cairn.operators import governance as G
from cairn.operators import quality as DQ
from cairn.operators.enrichment import extract_metadata
from cairn.operators.pii import with_pii_summary
from cairn.operators.stats import merge_profiles, profile_sketches, profile_table
from cairn.schema import ASSETS, COLUMN, as_assets

MIB = 1024 * 1024


def values(spark, rows, schema, expr):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.select(expr.alias("v"), "i").orderBy("i").select("v").collect()]


@pytest.mark.parametrize(
    "fn,cases",
    [
        (C.file_type, {"a.csv": "csv_file", "a.XLS": "excel_file", ".csv": "data_file", "a": "data_file", "x/a.db": "sqlite_database"}),
        (C.sftp_file_type, {"a.tar.gz": "Archive", "b.docx": "Word Document", "c.bin": "Data File"}),
        (C.azure_blob_type, {"d/a.ORC": "azure_orc_file", "a.txt": "azure_data_file"}),
        (C.data_classification, {"csv_file": "structured", "json_table": "semi-structured", "sql_table": "structured", "catalog": "unstructured", "parquet_file": "unknown"}),
        (C.data_format, {"mysql_view": "sql_view", "table_view": "sql_table", "avro": "avro", "x": "unknown"}),
        (C.is_data_file, {"a.CSV": True, "a.csv.gz": False, "b.yml": True}),
    ],
)
def test_names(spark, fn, cases):
    assert values(spark, [(k,) for k in cases], "s string", fn("s")) == list(cases.values())


def test_size_tag_bounds(spark):
    got = values(spark, [(MIB - 1,), (MIB,), (100 * MIB - 1,), (100 * MIB,)], "n bigint", C.size_tag("n"))
    assert got == ["size_small", "size_medium", "size_medium", "size_large"]


def test_tags_keep_order(spark):
    got = values(spark, [("data/Archive/x/f.Csv",), ("plain",)], "s string", C.file_tags("s", F.lit(5)))
    assert got == [["ext_Csv", "category_data", "category_archive", "size_small"], ["size_small"]]
    got = values(spark, [("raw/data.csv/f.PARQUET",), ("data",)], "s string", C.blob_tags("s"))
    assert got == [["ext_parquet", "folder_raw"], []]


def test_format_bytes(spark):
    cases = {0: "0 Bytes", 1: "1 Bytes", 1023: "1023 Bytes", 1024: "1 KB", 1536: "1.5 KB", 1024**3 * 2: "2 GB", 1024**4 * 5000: "5000 TB"}
    assert values(spark, [(k,) for k in cases], "n bigint", D.format_bytes("n")) == list(cases.values())


def test_time_ago(spark):
    now = datetime(2024, 1, 10)
    ages = {59: "Just now", 60: "1 minute ago", 119: "1 minute ago", 120: "2 minutes ago", 3600: "1 hour ago", 86399: "23 hours ago", 86400: "1 day ago", 172800: "2 days ago"}
    rows = [(now - timedelta(seconds=s),) for s in ages] + [(None,)]
    got = values(spark, rows, "t timestamp", D.time_ago("t", F.lit(now)))
    assert got == list(ages.values()) + ["Unknown time"]


def test_parse_iso(spark):
    got = values(spark, [("2024-01-02T03:04:05Z",), ("2024-01-02T05:04:05+02:00",), ("bad",)], "s string", D.parse_iso("s"))
    assert got[0] == got[1] == datetime(2024, 1, 2, 3, 4, 5) and got[2] is None


def test_mask(spark):
    df = spark.createDataFrame(
        [("abcdefghij", 7, {"api_key": "short", "Auth": "123456789", "x": "y"})],
        "password string, token_count int, m map<string,string>",
    )
    row = masking.mask_columns(df).first()
    assert row["password"] == "abcd**ghij" and row["token_count"] == "***"
    assert row["m"] == {"api_key": "***", "Auth": "1234*6789", "x": "y"}


def test_mask_reaches_nested(spark):
    df = spark.createDataFrame([(("user1", "longsecretvalue"),)], "conf struct<name:string,secret:string>")
    assert masking.mask_columns(df).select("conf.*").first() == ("user1", "long*******alue")


def test_pii_names(spark):
    got = values(spark, [("zip_code",), ("customer_name",), ("page",)], "s string", pii.pii_categories("s"))
    assert got == [["Address", "IP Address"], ["Personal Name"], []]
    got = values(spark, [("page",), ("email_address",)], "s string", F.transform(pii.pii_risks("s"), lambda r: r["pii_type"]))
    assert got == [["birth"], ["email", "address"]]
    got = values(spark, [("password",), ("protein",), ("credit_card_token",)], "s string", pii.sensitive_matches("s"))
    assert [len(g) for g in got] == [2, 1, 2]


def test_pii_text_and_redaction(spark):
    text = "mail a.b@c.org, card 1234-5678 9012-3456, ip 10.0.0.1, ssn 123-45-6789, call (555) 123-4567"
    kinds = values(spark, [(text,), ("nothing",), (None,)], "s string", pii.pii_types_in_text("s"))
    assert sorted(kinds[0]) == ["credit_card", "email", "ip_address", "phone", "ssn"] and kinds[1] == []
    red = values(spark, [(text,)], "s string", pii.redact("s"))[0]
    assert red == "mail [email], card [credit_card], ip [ip_address], ssn [ssn], call [phone]"


def test_privacy_risk_bounds(spark):
    expr = pii.privacy_risk("t", "e")
    mk = lambda t, e: (["x"] * t, ["y"] * e)
    got = values(spark, [mk(0, 0), mk(0, 1), mk(0, 2), mk(1, 0), mk(3, 0), mk(0, 4)], "t array<string>, e array<string>", expr)
    assert got == [None, "low", "medium", "medium", "high", "high"]


def assets(spark, rows):
    """rows: (name, columns, extra dict)."""
    full = []
    for name, cols, extra in rows:
        columns = [
            (i + 1, c, "string", True, None, d, False, None, None, None, None) for i, (c, d) in enumerate(cols)
        ]
        full.append((name, columns, extra.get("size", 0), extra.get("created"), extra.get("modified"), extra.get("scanned")))
    df = spark.createDataFrame(
        full,
        f"name string, columns array<{COLUMN.simpleString()}>, size bigint, created_date timestamp, "
        "modified_date timestamp, last_scanned timestamp",
    )
    return as_assets(df.withColumn("fingerprint", F.col("name")))


def test_quality_freshness_bounds(spark):
    now = datetime(2024, 6, 1)
    ages = {0.99: 1.0, 1: 0.9, 6.99: 0.9, 7: 0.7, 29.9: 0.7, 30: 0.5, 90: 0.3}
    rows = [(f"a{i}", [("c", None)], {"modified": now - timedelta(days=d)}) for i, d in enumerate(ages)]
    rows += [("b.c", [], {})]
    out = {r["fingerprint"]: r for r in DQ.quality_metrics(assets(spark, rows), F.lit(now)).collect()}
    assert [out[f"a{i}"]["freshness_score"] for i in range(len(ages))] == list(ages.values())
    assert out["a0"]["overall_quality_score"] == pytest.approx((0.8 + 1.0 + 0.8) / 4)
    last = out["b.c"]
    assert (last["completeness_score"], last["freshness_score"], last["consistency_score"]) == (0.0, 0.0, 0.6)


def test_schema_analysis_clamps(spark):
    rows = [("none", [], {}), ("low", [("a", None), ("b", " ")], {}), ("full", [("order_id", "x"), ("created", "y")], {})]
    out = {r["fingerprint"]: r for r in DQ.schema_analysis(assets(spark, rows)).collect()}
    assert [out[k]["data_quality_score"] for k in ("none", "low", "full")] == [75, 60, 100]
    assert out["full"]["business_terms"] == ["order_id", "created"] and out["low"]["fields_with_descriptions"] == 0


def test_domain_ties(spark):
    rows = [
        ("x", [("audit_flag", None), ("order_no", None)], {}),  # a tie of columns: the first ordinal wins
        ("order_thing", [("employee", None), ("employee_no", None)], {}),  # a tie: the name hit wins
        ("bank_customer", [], {}),  # two name hits: list order
        ("order_x", [("employee", None), ("staff", None), ("payroll", None)], {}),  # columns outweigh the name
        ("zzz", [], {}),
    ]
    out = {r["name"]: r["business_domain"] for r in G.with_business_domain(assets(spark, rows)).collect()}
    assert out["x"] == "Security & Audit"
    assert out["order_thing"] == "Sales & Revenue"
    assert out["bank_customer"] == "Customer Management"
    assert out["order_x"] == "HR & Employee"
    assert out["zzz"] == "General Business Data"


def test_business_metadata_bounds(spark):
    now = datetime(2024, 6, 1)
    rows = [
        ("core_patient", [("email", "e")], {"size": 100 * MIB + 1, "created": now - timedelta(days=40), "modified": now - timedelta(days=11), "scanned": now}),
        ("plain", [("v", None)], {"size": 10 * MIB, "created": now - timedelta(days=100), "modified": now - timedelta(days=10), "scanned": now - timedelta(days=7)}),
    ]
    out = {r["fingerprint"]: r for r in G.business_metadata(assets(spark, rows), F.lit(now)).collect()}
    a, b = out["core_patient"], out["plain"]
    assert (a["criticality"], a["size_category"], a["growth_rate"], a["usage_frequency"]) == ("High", "Large", "High", "High")
    assert a["compliance_requirements"] == ["GDPR", "CCPA", "HIPAA"] and a["data_classification"] == "Confidential"
    assert a["business_purpose"].startswith("Data asset containing personal information")
    assert (b["criticality"], b["size_category"], b["growth_rate"], b["usage_frequency"]) == ("Low", "Small", "Low", "Low")
    assert b["access_pattern"] == "Regular" and b["estimated_records"] == 10 * MIB // 50


def test_answers(spark):
    rows = [('```json\n{"summary": "s", "quality_score": 250}\n```',), ('{"issues": ["a"]}',), ("no",), ("[1]",), (None,)]
    out = DQ.parse_analysis(spark.createDataFrame(rows, "answer string")).collect()
    assert [r["quality_score"] for r in out] == [100.0, 75.0, 50.0, 50.0, 50.0]
    assert out[1]["issues"] == ["a"] and out[2]["issues"] == ["Response parsing failed"]


def test_missing_columns_are_harmless(spark):
    bare = as_assets(spark.createDataFrame([("f", "n")], "fingerprint string, name string"))
    row = with_pii_summary(bare).first()
    assert (row["high_risk_pii_count"], row["pii_risk"], row["pii_tags"]) == (0, "Low", [])
    assert G.business_metadata(bare, "2024-01-01").first()["data_quality_score"] == 75


def test_profile_table(spark):
    df = spark.createDataFrame([(1, None, [1]), (2, "a", [1]), (2, "b", None)], "n int, s string, a array<int>")
    out = {r["column_name"]: r for r in profile_table(df, exact=True).collect()}
    assert (out["n"]["distinct_values"], out["s"]["nulls"], out["a"]["distinct_values"]) == (2, 1, 1)
    assert (out["s"]["min_value"], out["n"]["max_value"], out["n"]["row_count"]) == ("a", "2", 3)


def test_extract_metadata(spark):
    columns = [{"ordinal": i + 1, "name": n, "type": t, "primary_key": i == 0} for i, (n, t) in enumerate([("user_pass_token", "string"), ("x_id", None), (None, "string")])]
    rows = [
        ("f1", "Etl_daily.csv.gz", "csv_file", "database_x", "/archive/year=2024/payroll.csv", 2_000_000, columns, datetime(2024, 1, 9), {"permissions": "644"}),
        ("f2", None, None, None, None, None, None, None, None),
        ("f3", "notes", "blob", "s", "a@b.example", 200_000, [], datetime(2023, 1, 1), {}),
    ]
    names = ["fingerprint", "name", "type", "source", "location", "size", "columns", "modified_date", "metadata"]
    assets = spark.createDataFrame([dict(zip(names, r, strict=True)) for r in rows], ASSETS)
    full, bare, plain = extract_metadata(assets, "2024-01-10 00:00:00").orderBy("fingerprint").collect()
    assert (full["data_classification"], full["estimated_value"], full["file"]["file_extension"], full["file"]["permissions"]) == ("structured", "medium", ".csv", "644")
    assert full["quality_metrics"]["freshness_score"] == 0.9 and full["quality_metrics"]["overall_quality_score"] == 0.575
    assert full["pii_detection"].asDict() == {"contains_pii": True, "pii_types": [], "sensitive_columns": ["user_pass_token"] * 2, "privacy_risk_level": "medium"}
    assert (full["business_context"]["domain"], full["business_context"]["business_importance"]) == ("hr", "high")
    assert full["technical_metadata"].asDict() == {"data_format": "csv", "encoding": "utf-8", "compression": "compressed", "partitioning": "partitioned"}
    assert full["table"]["keys"].asDict() == {"has_primary_key": True, "has_foreign_keys": True, "column_count": 3}
    assert full["lineage_hints"].asDict() == {"transformation_hints": ["etl", "archived"], "update_frequency": "daily"}
    assert (bare["data_classification"], bare["estimated_value"], bare["file"], bare["table"]) == ("unknown", "low", None, None)
    assert bare["pii_detection"].asDict() == {"contains_pii": False, "pii_types": [], "sensitive_columns": [], "privacy_risk_level": "low"}
    assert (plain["pii_detection"]["pii_types"], plain["pii_detection"]["privacy_risk_level"], plain["business_context"]["business_importance"]) == (["email"], "medium", "medium")
    types = {r["fingerprint"]: [tuple(t) for t in r["field_types"]] for r in DQ.schema_analysis(assets).collect()}
    assert types == {"f1": [("string", 2), ("unknown", 1)], "f2": [], "f3": []}
    assert "pii_detection" not in extract_metadata(assets, "2024-01-10 00:00:00", detect_pii=False).columns


def test_profiles_of_old_and_new_rows_merge_to_that_of_all(spark, tmp_path):
    rows = spark.range(30_000).select(
        "id",
        (F.col("id") % 1000).cast("string").alias("text"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 7 - 3.5).alias("number"),
        F.array(F.col("id") % 2).alias("list"),
        F.lit(None).cast("date").alias("nothing"),
        (F.col("id") % 4).alias("file"),
    )
    shape = rows.drop("file").schema
    profile_sketches(rows.filter("file < 3"), "file").write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    merged = merge_profiles(kept.unionByName(profile_sketches(rows.filter("file = 3"), "file")), shape).orderBy("ordinal").collect()
    exact = profile_table(rows.drop("file"), exact=True).orderBy("ordinal").collect()
    for got, want in zip(merged, exact, strict=True):
        got, want = got.asDict(), want.asDict()
        assert abs(got.pop("distinct_values") - want["distinct_values"]) <= 0.05 * want.pop("distinct_values")
        assert got == want
    none = merge_profiles(profile_sketches(rows.filter("false"), "file"), shape).collect()
    assert [(r["row_count"], r["distinct_values"], r["min_value"]) for r in none] == [(0, 0, None)] * 5
