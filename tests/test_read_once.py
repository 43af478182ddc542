"""What is read once, written once and packed, so that large catalogs are not moved again and again."""

import hashlib
import os
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from cairn.functions.expr import as_json, from_text, packed, unpacked
from cairn.operators import column_lineage as CL
from cairn.operators import lineage as L
from cairn.operators import maintenance as M
from cairn.operators import sinks
from cairn.operators import transformations as T
from cairn.operators.maintenance import with_fingerprint
from cairn.plans.fixtures import TABLES, Inputs
from cairn.schema import RELATIONSHIPS, as_assets, column_struct


@pytest.fixture
def catalog(spark, tmp_path):
    """Stored assets raw_0 to raw_5 and declared edges, one of them of an asset to itself, one to an unknown end."""
    rows = spark.range(6).select(
        F.concat(F.lit("raw_"), "id").alias("name"),
        F.lit("table").alias("type"),
        F.lit("s").alias("source"),
        F.concat(F.lit("/"), "id").alias("location"),
        F.lit("2024-01-01").cast("timestamp").alias("last_scanned"),
        F.array(column_struct(name=F.lit("Id")), column_struct(name=F.concat(F.lit("c"), "id"))).alias("columns"),
    )
    as_assets(with_fingerprint(as_assets(rows))).write.parquet(str(tmp_path / "assets"))
    assets = spark.read.parquet(str(tmp_path / "assets"))
    key = {r["name"]: r["fingerprint"] for r in assets.collect()}
    edges = [("raw_1", "raw_0", "joins_with"), ("raw_0", "raw_2", "copied_to"), ("raw_0", "raw_0", "copied_to")]
    data = [(None, key[a], key[b], kind, 0.5, None, "user", None) for a, b, kind in edges]
    data += [(None, "unknown", key["raw_0"], "joins_with", 0.5, "x", "user", None), (None, None, key["raw_0"], "joins_with", 0.5, "x", "user", None)]
    spark.createDataFrame(data, RELATIONSHIPS).write.parquet(str(tmp_path / "rel"))
    return assets, spark.read.parquet(str(tmp_path / "rel")), key


def test_declared_edges_are_read_once_for_both_directions(catalog):
    assets, rel, key = catalog
    found = L.custom_edges(assets.filter("name = 'raw_0'"), assets, rel)
    name = {v: k for k, v in key.items()}
    got = sorted((name[r["id"]], r["direction"], name[r["source_id"]], name[r["sink_id"]], r["description"]) for r in found.collect())
    assert got == [
        ("raw_0", "upstream", "raw_0", "raw_0", ""),
        ("raw_1", "upstream", "raw_1", "raw_0", ""),
        ("raw_2", "downstream", "raw_0", "raw_2", ""),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert len([x for x in plan if "Relation" in x and "relationship_type" in x]) == 1


def test_a_graph_is_read_from_what_was_written_for_it(catalog, tmp_path):
    assets, rel, _ = catalog
    nodes, edges = L.lineage_graph(assets.filter("name = 'raw_0'"), assets, rel)
    for df in (nodes, edges, T.schema_transformations(nodes, assets)):
        assert df.count() > 0
        assert not [f for f in df.inputFiles() if str(tmp_path) in f]


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_an_export_can_be_packed(spark, catalog, tmp_path, fmt):
    path = str(tmp_path / "out")
    sinks.export_catalog(catalog[0], path, fmt, compression="gzip")
    assert all(f.endswith(f".{fmt}.gz") for f in os.listdir(path) if f.startswith("part-"))
    back = spark.read.json(path) if fmt == "json" else spark.read.options(header=True, escape='"').csv(path)
    assert sorted(r["name"] for r in back.collect()) == [f"raw_{k}" for k in range(6)]


ODD_KEYS = ["", "ab", "AB", "0AB", "abc", "\u0001ab", "nation:7", "a-b", "sixteen letters!", "\u00fc\u4e2d", "f" * 32, "F" * 32, "f" * 32 + "\n", None]


def test_packed_keys_come_back_and_stay_apart(spark):
    rows = spark.createDataFrame([(k,) for k in ODD_KEYS], "k string").select("k", packed("k").alias("p"))
    got = [(r["k"], r["p"], r["back"]) for r in rows.select("*", unpacked("p").alias("back")).collect()]
    assert [k for k, _, _ in got] == [back for _, _, back in got]
    assert len({p for _, p, _ in got}) == len(ODD_KEYS)
    assert {k: p for k, p, _ in got}["f" * 32] == b"\x01" + b"\xff" * 16


@pytest.fixture
def by_shuffle(spark):
    """Joins by shuffle, in the plan as first made, whose nodes then hold what they did."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def moved_bytes(df) -> int:
    """What the shuffles of a frame that has run have written."""

    def under(node) -> int:
        exchange = node.getClass().getSimpleName() == "ShuffleExchangeExec"
        children = node.children()
        own = node.metrics().apply("shuffleBytesWritten").value() if exchange else 0
        return own + sum(under(children.apply(i)) for i in range(children.size()))

    return under(df._jdf.queryExecution().executedPlan())


def test_relationships_move_to_their_names_without_what_their_ends_tell(spark, by_shuffle):
    key = [hashlib.md5(str(k).encode()).hexdigest() for k in range(1000)]
    held = [(k, f"n{i}") for i, k in enumerate(key)] + [("ab", "short"), ("AB", "upper"), ("ab", "again"), (None, "none"), ("", "empty")]
    odd = [(f"{s}-{t}-x", s, t) for s in ODD_KEYS for t in ("ab", key[0])]
    odd += [("a-b-c-d", "a", "b-c"), ("a-b-c-d", "a-b", "c"), ("other", "ab", key[1]), ("ab-", "ab", "ab"), (None, "ab", "AB"), ("x", None, None)]
    rel = [(f"{key[i % 1000]}-{key[i * 7 % 999]}-joins_with", key[i % 1000], key[i * 7 % 999]) for i in range(8000)] + odd
    assets = spark.createDataFrame(held, "fingerprint string, name string")
    found = M.relationships_named(spark.createDataFrame(rel, "id string, source_asset string, target_asset string"), assets)
    assert found.columns == ["id", "source_asset", "target_asset", "source_name", "target_name"]
    names: dict = {}
    for k, name in held:
        if k is not None:
            names.setdefault(k, []).append(name)
    want = Counter((i, s, t, a, b) for i, s, t in rel for a in names.get(s, [s]) for b in names.get(t, [t]))
    assert Counter(tuple(r) for r in found.collect()) == want
    # an id of two keys alone is 65 bytes that do not compress, and every row moves twice
    assert 0 < moved_bytes(found) < 2 * 65 * len(rel)


def test_other_ids_are_left_as_they_are(spark):
    rel = spark.createDataFrame([(1, "a", "b")], "id int, source_asset string, target_asset string")
    assets = spark.createDataFrame([("a", "A")], "fingerprint string, name string")
    for r in (rel, rel.drop("id")):
        found = M.relationships_named(r, assets)
        assert found.dtypes[: len(r.columns)] == r.dtypes
        assert [tuple(x)[-2:] for x in found.collect()] == [("A", "b")]


def test_declared_edges_are_built_from_packed_keys(spark, by_shuffle, sf_dir):
    i = Inputs(spark, sf_dir)
    edges = i.asset_relationships().select("source_asset", "target_asset")
    key = {r["row_id"]: r["fingerprint"] for r in i.catalog().select("row_id", "fingerprint").collect()}
    want = Counter((key[k // 2], key[k]) for k in key if k > 0 and k // 2 in key)
    assert Counter(tuple(r) for r in edges.collect()) == want
    assert 0 < moved_bytes(edges) < 2 * 32 * len(key)  # a key is 32 bytes of hex, and every asset moves as child and as parent


def nodes_of(plan) -> list:
    children = plan.children()
    return [plan] + [n for k in range(children.size()) for n in nodes_of(children.apply(k))]


def test_columns_of_all_assets_move_nowhere_for_a_few_targets(spark, tmp_path):
    names = F.array(F.lit("Id"), F.concat(F.lit("c"), F.col("id") % 3), F.when(F.col("id") % 2 == 0, "total_price"))
    rows = spark.range(3000).select(
        F.concat(F.lit("raw_"), "id").alias("name"),
        F.lit("s").alias("source"),
        F.concat(F.lit("/"), "id").alias("location"),
        F.transform(F.array_compact(names), lambda c, k: column_struct(ordinal=k, name=c)).alias("columns"),
    )
    as_assets(with_fingerprint(as_assets(rows))).write.parquet(str(tmp_path / "assets"))
    assets = spark.read.parquet(str(tmp_path / "assets"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40k")  # less than the assets
    try:
        found = CL.column_edges(assets.filter("name = 'raw_0'"), assets)
        got = Counter((r["column_name"], r["other_asset"], r["other_column"], r["confidence"]) for r in found.collect())
        joins = found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in joins and "SortMergeJoin" not in joins  # known before anything runs, so nothing is dealt out
    want = Counter(("Id", f"raw_{k}", "Id", 0.95) for k in range(1, 3000))
    want += Counter(("c0", f"raw_{k}", "c0", 0.95) for k in range(3, 3000, 3))
    want += Counter(("total_price", f"raw_{k}", "total_price", 0.95) for k in range(2, 3000, 2))
    assert got == want


def test_targets_are_ranked_without_their_columns(spark, tmp_path):
    held = [(k, k % 7, "O", 30000.0 + k, f"1996-01-{k % 28 + 1:02d}", "x") for k in range(60)]
    held += [(5, 3, "O", 40000.0, "1999-01-01", "x"), (5, 4, "F", 1.0, "2000-01-01", "x"), (5, 9, "F", 50000.0, None, "y"), (None, 3, "F", 50000.0, "2001-01-01", "y")]
    kinds = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    dated = F.col("o_orderdate").cast("timestamp_ntz")
    spark.createDataFrame(held, kinds).withColumn("o_orderdate", dated).write.parquet(str(tmp_path / "orders.parquet"))
    i = Inputs(spark, str(tmp_path))
    for name in set(TABLES) - {"orders"}:
        spark.range(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    w = Window.partitionBy("source").orderBy(F.desc("last_scanned"), "fingerprint")
    want = i.catalog().filter("is_active").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    targets = i.targets()
    text = lambda df: Counter(r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect())
    assert targets.columns == want.columns and text(targets) == text(want) and targets.count() == 6
    windows = [n for n in nodes_of(targets._jdf.queryExecution().optimizedPlan()) if n.getClass().getSimpleName() == "Window"]
    assert len(windows) == 2 and min(n.output().size() for n in windows) <= 6  # that over all assets


def test_arrays_of_structs_come_back_from_their_text(spark):
    kind = K.ArrayType(K.StructType([K.StructField("k", K.IntegerType()), K.StructField("b", K.BooleanType()), K.StructField("s", K.StringType())]))
    odd = ["", " a ", "null", "NaN", '"', "\\", "\n\r\t\u0000\u001f\u2028", "\u00fc\u4e2d\U0001f600", "{}", "[1", "1e5", None, "x" * 1_100_000]
    rows = [(None,), ([],), ([None],), ([(None, None, None), None, (1, True, "a")],)] + [([(-5, False, x), (2, None, x)],) for x in odd]
    df = spark.createDataFrame(rows, K.StructType([K.StructField("c", kind)]))
    broken = F.array(F.struct(F.lit(1).alias("k"), F.lit(True).alias("b"), F.expr("cast(x'61ff' as string)").alias("s")))
    df = df.unionByName(spark.range(1).select(broken.alias("c")))
    told, rest = as_json("c")
    held = df.withColumns({"t": told, "r": rest}).withColumn("back", from_text("t", "r", kind))
    assert held.filter(~F.col("back").eqNullSafe(F.col("c"))).count() == 0
    assert held.filter("t is not null and r is not null").count() == 0
    assert held.filter("r is not null").count() == 2  # the long text and the one that is not UTF-8
