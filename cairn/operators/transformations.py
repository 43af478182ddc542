"""Transformations, complexity and recommendations read from a lineage graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import rules
from cairn.functions.expr import compact, first_case, has_any, low, names
from cairn.session import cut_lineage

NAMES_PER_LIST = 10_000


def edge_text(kind: Column, source: Column, target: Column) -> Column:
    def fill(template: str) -> Column:
        return F.replace(F.replace(F.lit(template), F.lit("{s}"), source), F.lit("{t}"), target)

    return first_case(
        [(kind == k, fill(v)) for k, v in rules.EDGE_TEXTS.items()],
        F.concat(kind, F.lit(" transformation from "), source, F.lit(" to "), target),
    )


def edge_transformations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge that is not `feeds_into`, with its own or a generated description."""
    named = nodes.select("target_id", "id", "name").dropDuplicates(["target_id", "id"])
    s = named.select("target_id", F.col("id").alias("source_id"), F.col("name").alias("s_name"))
    t = named.select("target_id", F.col("id").alias("sink_id"), F.col("name").alias("t_name"))
    e = (
        edges.filter(F.col("relationship") != "feeds_into")
        .join(s, ["target_id", "source_id"], "left")
        .join(t, ["target_id", "sink_id"], "left")
    )
    generated = edge_text(
        F.col("relationship"), F.coalesce("s_name", F.lit("source")), F.coalesce("t_name", F.lit("target"))
    )
    return e.select(
        "target_id",
        F.col("relationship").alias("type"),
        F.coalesce(F.nullif("description", F.lit("")), generated).alias("description"),
        F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.8)).alias("confidence"),
        F.coalesce("s_name", "source_id").alias("source"),
        F.coalesce("t_name", "sink_id").alias("target"),
    )


def _against_target(nodes: DataFrame) -> DataFrame:
    """Upstream nodes next to their target node."""
    up = nodes.filter("level < 0").select(
        "target_id", "id", F.col("name").alias("u_name"), F.col("type").alias("u_type")
    )
    target = nodes.filter("level = 0").select(
        "target_id", F.col("name").alias("t_name"), F.col("type").alias("t_type")
    )
    return up.join(target, "target_id")


def _found(df: DataFrame, *cases: Column) -> DataFrame:
    return (
        df.withColumn("f", F.explode(compact(*cases)))
        .select(
            "target_id",
            F.col("f.type").alias("type"),
            F.col("f.description").alias("description"),
            F.col("f.confidence").alias("confidence"),
            F.col("u_name").alias("source"),
            F.col("t_name").alias("target"),
        )
    )


def _case(cond: Column, kind: str, description: Column | str, confidence: float) -> Column:
    text_ = description if isinstance(description, Column) else F.lit(description)
    return F.when(
        cond,
        F.struct(
            F.lit(kind).alias("type"), text_.alias("description"), F.lit(confidence).alias("confidence")
        ),
    )


def schema_transformations(nodes: DataFrame, assets: DataFrame) -> DataFrame:
    """Projection, expansion and mapping per upstream node, from column counts and names."""
    # the assets are read once, for those that stand in a pair; pairs and names are written, so that Spark knows
    # their size: with few of them no column of the other assets is moved
    against = cut_lineage(_against_target(nodes))
    needed = against.select(F.col("id").alias("fingerprint")).unionAll(against.select("target_id"))
    found = assets.select("fingerprint", "columns").join(needed, "fingerprint", "left_semi")
    held = cut_lineage(found.select("fingerprint", names("columns").alias("cols")))
    upstream = held.select(F.col("fingerprint").alias("id"), F.col("cols").alias("u_cols"))
    target = held.select(F.col("fingerprint").alias("target_id"), F.col("cols").alias("t_cols"))
    pairs = (
        against.join(upstream, "id")
        .join(target, "target_id")
        .withColumns(
            {
                "u": F.size("u_cols"),
                "t": F.size("t_cols"),
                "common": F.size(F.array_intersect("u_cols", "t_cols")),
            }
        )
        .filter((F.col("u") > 0) & (F.col("t") > 0))
    )
    u, t = F.col("u"), F.col("t")
    counts = lambda word: F.format_string(f"Column {word} from %d to %d columns", u, t)
    # whole-number forms of t < 0.7 u and t > 1.3 u
    return _found(
        pairs,
        _case(t * 10 < u * 7, "column_projection", counts("reduction"), 0.85),
        _case(t * 10 > u * 13, "column_expansion", counts("expansion"), 0.80),
        _case(
            F.col("common") > 0,
            "column_mapping",
            F.format_string("%d columns mapped between assets", F.col("common")),
            0.90,
        ),
    )


def type_transformations(nodes: DataFrame) -> DataFrame:
    u, t = low("u_type"), low("t_type")
    return _found(
        _against_target(nodes),
        _case(
            u.contains("table") & t.contains("view"),
            "table_to_view",
            "Table data transformed into view with business logic",
            0.88,
        ),
        _case(
            u.contains("raw") & ~t.contains("raw"), "data_cleansing", "Raw data cleansing and standardization", 0.85
        ),
        _case(
            u.contains("file") & t.contains("table"), "file_ingestion", "File data ingested into structured table", 0.92
        ),
    )


def pattern_transformations(nodes: DataFrame) -> DataFrame:
    """From the target's name, if it has an upstream node; source lists the upstream names.

    A list holds about NAMES_PER_LIST names: a target with more upstream nodes gets one row per
    part of them, so no task gathers all names of a hot target.
    """
    words = [w for group, _, _, _ in rules.NAME_TRANSFORMATIONS for w in group]
    ups = _against_target(nodes).filter(has_any(low("t_name"), words))
    parts = ups.groupBy("target_id").agg(F.ceil(F.count("*") / NAMES_PER_LIST).alias("parts"))
    listed = (
        ups.join(parts, "target_id")
        .groupBy("target_id", "t_name", F.pmod(F.xxhash64("id"), "parts").alias("part"))
        .agg(F.array_join(F.sort_array(F.collect_list("u_name")), ", ").alias("u_name"))
    )
    n = low("t_name")
    return _found(
        listed, *[_case(has_any(n, w), kind, text_, conf) for w, kind, text_, conf in rules.NAME_TRANSFORMATIONS]
    )


def all_transformations(nodes: DataFrame, edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Declared and inferred transformations in one table."""
    return (
        edge_transformations(nodes, edges)
        .withColumn("inferred", F.lit(False))
        .unionByName(
            schema_transformations(nodes, assets)
            .unionByName(type_transformations(nodes))
            .unionByName(pattern_transformations(nodes))
            .withColumn("inferred", F.lit(True))
        )
    )


def lineage_complexity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("target_id").agg(F.count("*").alias("nodes"), F.max(F.abs("level")).alias("depth"))
    e = edges.groupBy("target_id").agg(F.count("*").alias("edges"))
    both = n.join(e, "target_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    ratio = F.col("edges") / F.col("nodes")
    grade = lambda v, low_, mid: first_case([(v < low_, "Low"), (v < mid, "Medium")], "High")
    return both.select(
        "target_id",
        "nodes",
        "edges",
        "depth",
        grade(ratio * 20, 20, 50).alias("cyclomatic"),
        grade(F.col("depth") * 15, 30, 60).alias("data_flow"),
        grade(ratio * 10, 3, 6).alias("complexity"),
        first_case([(F.col("depth") <= 2, "High"), (F.col("depth") <= 4, "Medium")], "Low").alias("performance"),
    )


def lineage_recommendations(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Advice rows (target_id, position, severity, text); two defaults when nothing applies."""
    n = nodes.groupBy("target_id").agg(
        F.count_if(F.col("level") < 0).alias("up"), F.count_if(F.col("level") > 0).alias("down")
    )
    base = (
        targets.select(
            F.col("fingerprint").alias("target_id"),
            low("type").alias("type"),
            F.greatest(F.coalesce(F.size("columns"), F.lit(0)), F.lit(0)).alias("width"),
            F.greatest(F.coalesce(F.size("metadata"), F.lit(0)), F.lit(0)).alias("facts"),
        )
        .join(n, "target_id", "left")
        .withColumns({"up": F.coalesce("up", F.lit(0)), "down": F.coalesce("down", F.lit(0))})
    )

    def say(cond: Column, severity: str, words: str, number: Column | None = None) -> Column:
        text_ = F.lit(words) if number is None else F.format_string(words, number)
        return F.when(cond, F.struct(F.lit(severity).alias("severity"), text_.alias("text")))

    width, up, down, type_ = F.col("width"), F.col("up"), F.col("down"), F.col("type")
    # the texts are fixed values
    advice = compact(
        say(width == 0, "warning", "No schema information detected - consider documenting column definitions"),
        say(
            width > 50,
            "info",
            "Large schema detected (%d columns) - consider normalizing data structure",
            width,
        ),
        say(up == 0, "primary", "No upstream sources detected - this appears to be a source system"),
        say(
            up > 5,
            "warning",
            "High upstream dependency (%d sources) - monitor data quality and availability",
            up,
        ),
        say(
            down > 10,
            "danger",
            "Critical asset with %d downstream dependencies - implement change management",
            down,
        ),
        say(type_.contains("view"), "success", "View detected - ensure underlying tables are properly indexed"),
        say(
            type_.contains("table") & (up > 0),
            "info",
            "Consider implementing incremental loading for better performance",
        ),
        say(
            F.col("facts") < 3, "warning", "Limited metadata available - add descriptions and business context"
        ),
    )
    defaults = F.array(
        F.struct(
            F.lit("success").alias("severity"),
            F.lit("Asset appears well-structured with good lineage connectivity").alias("text"),
        ),
        F.struct(
            F.lit("info").alias("severity"),
            F.lit("Monitor data quality and performance metrics regularly").alias("text"),
        ),
    )
    chosen = base.withColumn("advice", advice).withColumn(
        "advice", F.when(F.size("advice") == 0, defaults).otherwise(F.col("advice"))
    )
    return chosen.select("target_id", F.posexplode("advice").alias("position", "a")).select(
        "target_id", "position", F.col("a.severity").alias("severity"), F.col("a.text").alias("text")
    )
