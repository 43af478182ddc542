"""Column-level lineage between targets and other assets with a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import rules
from cairn.functions.expr import ColumnLike, col, first_case, has_any, lits, low
from cairn.operators.lineage import is_upstream
from cairn.session import cut_lineage


#: Names are met by their first so many characters, which stand in any name that holds them.
GRAM = 3


def grams(c: Column) -> Column:
    """Distinct substrings of one to GRAM characters, and the empty one."""
    n = F.length(c)

    def of_size(q: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.substring(c, i, F.lit(q)))
        return F.when(n >= q, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array(F.lit("")), *[of_size(q) for q in range(1, GRAM + 1)]))


def match_confidence(a: ColumnLike, a_type: ColumnLike, b: ColumnLike, b_type: ColumnLike) -> Column:
    """0.95, 0.8, 0.6 or 0.0 for two columns; a missing type counts as STRING."""
    x, y = low(a), low(b)
    bare = lambda c: F.replace(c, F.lit("_"), F.lit(""))
    token = lambda c: F.substring_index(c, "_", 1)
    near = (
        y.contains(x)
        | x.contains(y)
        | (bare(x) == bare(y))
        | (x.endswith("_id") & y.endswith("_id") & (token(x) == token(y)))
    )
    types = F.coalesce(col(a_type), F.lit("STRING")) == F.coalesce(col(b_type), F.lit("STRING"))
    topic = (
        types
        & (F.length(x) > 2)
        & has_any(x, rules.COLUMN_TOPIC_WORDS)
        & has_any(y, rules.COLUMN_TOPIC_WORDS)
    )
    return first_case([(x == y, 0.95), (near, 0.8), (topic, 0.6)], 0.0)


def _columns(assets: DataFrame, asset: dict[str, str], column: str, type_: str, key: str) -> DataFrame:
    """A row per column of an asset: the asset's fields as named in `asset`, ordinal, name, type and lower-cased name."""
    return assets.select(*[F.col(old).alias(new) for new, old in asset.items()], F.explode("columns").alias("c")).select(
        *asset,
        F.col("c.ordinal").alias("ordinal"),
        F.col("c.name").alias(column),
        F.coalesce("c.type", F.lit("STRING")).alias(type_),
        low("c.name").alias(key),
    )


def _name_pairs(mine: DataFrame, others: DataFrame) -> DataFrame:
    """(x, y): names of the two sides that match with 0.8 or more.

    Names are made distinct first, so one that every asset has is compared once.  Each way of
    matching is an equi-join: if x stands in y, its first characters are among y's short substrings.
    """
    x, y = mine.select("x").distinct(), others.select("y").distinct()
    head = lambda c: F.substring(c, 1, GRAM)
    bare = lambda c: F.replace(c, F.lit("_"), F.lit(""))
    token = lambda c: F.when(c.endswith("_id"), F.substring_index(c, "_", 1))

    def met(of_x, of_y) -> DataFrame:
        return x.withColumn("key", of_x(F.col("x"))).join(y.withColumn("key", of_y(F.col("y"))), "key").select("x", "y")

    inside = met(head, lambda c: F.explode(grams(c))).filter(F.col("y").contains(F.col("x")))
    around = met(lambda c: F.explode(grams(c)), head).filter(F.col("x").contains(F.col("y")))
    return inside.unionAll(around).unionAll(met(bare, bare)).unionAll(met(token, token)).distinct()


def _scored_names(mine: DataFrame, others: DataFrame) -> DataFrame:
    """(x, t_type, y, o_type, confidence): names with types that match, alike or of the same type and on a topic."""
    on_topic = lambda df, c: df.filter(has_any(F.col(c), rules.COLUMN_TOPIC_WORDS))
    alike = mine.join(_name_pairs(mine, others), "x").join(others, "y")
    topic = on_topic(mine, "x").filter(F.length("x") > 2).join(on_topic(others, "y"), F.col("t_type") == F.col("o_type"))
    score = match_confidence("x", "t_type", "y", "o_type")
    return alike.withColumn("confidence", score).unionByName(
        topic.withColumn("confidence", score).filter("confidence < 0.8")
    )


def _of_all(mine: DataFrame, others: DataFrame) -> DataFrame:
    """Matches with every other asset: by names alike, and of the same type by names on a topic.

    Names with types are matched before any asset is.  What the targets look for is written, so that Spark
    knows its size: where it is small, the columns of the others pass by it in their tasks and move nowhere.
    """
    mine = cut_lineage(mine)
    names = cut_lineage(others.select("y", "o_type").distinct())
    wanted = cut_lineage(mine.join(_scored_names(mine.select("x", "t_type").distinct(), names), ["x", "t_type"]))
    return wanted.join(others, ["y", "o_type"]).filter("target_id != other_id")


def _of_newest(mine: DataFrame, others: DataFrame, partners: DataFrame, limit: int) -> DataFrame:
    """Matches with the newest `limit` other assets of each target, out of limit + 1 that suffice for all of them."""
    w = Window.partitionBy("target_id").orderBy(F.desc("last_scanned"), "other_id")
    chosen = (
        mine.select("target_id")
        .distinct()
        .join(F.broadcast(partners), F.col("target_id") != F.col("other_id"))
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= limit)
        .select("target_id", "other_id")
    )
    paired = mine.join(chosen, "target_id").join(others, "other_id")
    return paired.withColumn("confidence", match_confidence("x", "t_type", "y", "o_type")).filter("confidence > 0.5")


def column_edges(targets: DataFrame, assets: DataFrame, limit: int | None = None) -> DataFrame:
    """Column matches of each target against all other active assets with a schema, or the newest `limit` of them."""
    mine = _columns(targets, {"target_id": "fingerprint", "target_name": "name"}, "column_name", "t_type", "x")
    known = assets.filter(F.col("is_active") & (F.size("columns") > 0))
    named = {"other_id": "fingerprint", "other_asset": "name"}
    if limit is None:
        paired = _of_all(mine, _columns(known, named, "other_column", "o_type", "y").drop("ordinal"))
    else:
        newest = known.orderBy(F.desc("last_scanned"), "fingerprint").limit(limit + 1)
        partners = newest.select(F.col("fingerprint").alias("other_id"), "last_scanned")
        paired = _of_newest(mine, _columns(newest, named, "other_column", "o_type", "y").drop("ordinal"), partners, limit)
    return paired.select(
        "target_id",
        "ordinal",
        "column_name",
        "other_id",
        "other_asset",
        "other_column",
        F.when(is_upstream("target_name", "other_asset"), "upstream").otherwise("downstream").alias("direction"),
        "confidence",
    )


def column_transformations(name: ColumnLike, type_: ColumnLike, has_upstream: ColumnLike) -> Column:
    n, t = low(name), low(F.coalesce(col(type_), F.lit("STRING")))
    extra = first_case(
        [
            (has_any(n, ["total", "sum"]), lits(["sum"])),
            (n.contains("count"), lits(["count"])),
            (n.contains("avg"), lits(["average"])),
        ],
        F.array().cast("array<string>"),
    )
    joined = F.when(n.contains("name"), lits(["concatenation"])).otherwise(F.array().cast("array<string>"))
    return first_case(
        [
            (has_any(n, ["id", "key", "pk", "fk"]) & col(has_upstream), lits(["direct_copy", "key_lookup"])),
            (has_any(n, ["id", "key", "pk", "fk"]), lits(["generated_key"])),
            (
                has_any(n, ["total", "sum", "count", "avg", "max", "min"]),
                F.concat(lits(["aggregation", "mathematical_operation"]), extra),
            ),
            (has_any(t, ["date", "time"]), lits(["date_formatting", "timezone_conversion"])),
            (
                has_any(t, ["string", "varchar", "text"]),
                F.concat(lits(["string_formatting", "data_cleaning"]), joined),
            ),
            (
                has_any(t, ["int", "float", "decimal", "number"]),
                lits(["data_type_conversion", "mathematical_operation"]),
            ),
        ],
        lits(["data_transformation"]),
    )


def column_lineage_matrix(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per target column: upstream and downstream lists, transformations, confidence.

    The lists are text in one row: give it edges to a limited number of partners (column_edges with
    a limit).  The edges themselves are the form without a limit.
    """
    label = F.concat("other_asset", F.lit("."), "other_column")
    side = lambda d: F.sort_array(F.collect_list(F.when(F.col("direction") == d, label)))
    grouped = edges.groupBy("target_id", "ordinal").agg(
        side("upstream").alias("up"),
        side("downstream").alias("down"),
        F.avg("confidence").alias("mean"),
    )
    cols = targets.select(F.col("fingerprint").alias("target_id"), F.explode("columns").alias("c")).select(
        "target_id", F.col("c.ordinal").alias("ordinal"), F.col("c.name").alias("column_name"), F.col("c.type").alias("t")
    )
    listed = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(c, ", ")).otherwise("None")
    has_up = F.coalesce(F.size("up"), F.lit(0)) > 0
    return cols.join(grouped, ["target_id", "ordinal"], "left").select(
        "target_id",
        "ordinal",
        "column_name",
        listed("up").alias("upstream_columns"),
        listed("down").alias("downstream_columns"),
        F.array_join(column_transformations("column_name", "t", has_up), ", ").alias("transformations"),
        F.coalesce(F.floor(F.round(F.col("mean") * 100, 6) + 0.5), F.lit(0)).cast("bigint").alias("confidence"),
    )
