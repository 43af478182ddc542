"""Asset lineage as node and edge tables.

Lineage is asked for a set of target assets, of any size, against the whole catalog.  Targets are
scored against classes of assets, and only the members that the levels need come back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import rules
from cairn.functions.expr import ColumnLike, col, first_case, has_any, lits, low, text
from cairn.session import cut_lineage, scratch_path

PER_LEVEL = 3


def lineage_id(carried: ColumnLike, source: ColumnLike, location: ColumnLike, name: ColumnLike) -> Column:
    """The fingerprint, else a short text id cut from base64 (compatibility only: it collides often)."""
    plain = F.concat(text(source), F.lit("-"), text(location), F.lit("-"), text(name))
    short = F.substring(F.regexp_replace(F.base64(F.encode(plain, "UTF-8")), "[=+/\r\n]", ""), 1, 16)
    return F.coalesce(F.nullif(col(carried), F.lit("")), short)


def lineage_assets(assets: DataFrame) -> DataFrame:
    n = F.greatest(F.coalesce(F.size("columns"), F.lit(0)), F.lit(0))
    return assets.filter("is_active").select(
        lineage_id("fingerprint", "source", "location", "name").alias("id"),
        "name",
        "type",
        "source",
        (n > 0).alias("has_schema"),
        n.alias("column_count"),
    )


# --- related assets -----------------------------------------------------------
#
# A score is a sum over evidence: the source, the words of the name, the leading segments of a dotted name, and
# whether a text of the target (a "needle": its name, a segment, its location) stands in a text of the asset.
# Assets with the same evidence for every target form a class.  Targets meet classes, by equi-joins on
# evidence, and never the assets themselves: a source with a third of the catalog is as many rows there as
# it has sorts of names.  Members of a class come back in order of their last scan.

#: Words of 64 bits in the filter that cuts of texts pass before they are joined with needles.
FILTER_WORDS = 4096

_RELATED = ["target_id", "target_name", "target_type", "id", "name", "type", "source", "last_scanned", "score"]


def _dotted(source: str, name: str) -> Column:
    return F.col(source).contains("bigquery") & F.col(name).contains(".")


def _words(name: str) -> Column:
    return F.filter(lits(rules.LINEAGE_WORDS), lambda w: F.col(name).contains(w))


def _target_side(targets: DataFrame) -> DataFrame:
    n = low("name")
    return targets.select(
        F.col("fingerprint").alias("target_id"),
        F.col("name").alias("target_name"),
        low("type").alias("target_type"),
        text("source").alias("t_source"),
        n.alias("t_name"),
        low("location").alias("t_location"),
        F.when(n.contains("."), F.array_distinct(F.split(n, r"\."))).otherwise(F.array().cast("array<string>")).alias("segments"),
    ).withColumn("t_words", _words("t_name"))


def _asset_side(assets: DataFrame) -> DataFrame:
    return assets.filter("is_active").select(
        F.col("fingerprint").alias("id"),
        "name",
        "type",
        text("source").alias("source"),
        "last_scanned",
        low("name").alias("o_name"),
        low("location").alias("o_location"),
    )


def _needle(kind: str, x: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), x.alias("x"), F.md5(F.concat(F.lit(kind + ":"), x)).alias("needle"))


def _own_segments() -> Column:
    """Segments that count by themselves: words are counted as words, the empty one stands in every name."""
    return F.array_except("segments", F.concat(lits(rules.LINEAGE_WORDS), F.array(F.lit(""))))


def _needles(t: DataFrame) -> DataFrame:
    """kind, x, needle of every distinct text of the targets that assets are searched for.

    in_name and in_place: x stands in the asset's name or location; around: the asset's name stands in x.
    """
    every = F.concat(
        F.transform(_own_segments(), lambda x: _needle("in_name", x)),
        F.array(_needle("in_name", F.col("t_name")), _needle("around", F.col("t_name")), _needle("in_place", F.col("t_location"))),
    )
    return t.select(F.explode(every).alias("n")).select("n.*").filter("x <> ''").distinct()


def _slot(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(64 * FILTER_WORDS))


def _key_filter(df: DataFrame, *keys: str) -> Column:
    """One value of fixed size, 64 * FILTER_WORDS bits: those that the keys of df fall on are set."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (_slot(*keys) % 64).cast("int"))
    words = df.groupBy((_slot(*keys) / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits"))
    by_word = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    every = F.sequence(F.lit(0).cast("long"), F.lit(FILTER_WORDS - 1).cast("long"))
    return words.agg(F.transform(every, lambda w: F.coalesce(F.element_at(by_word, w), F.lit(0).cast("long")))).scalar()


def _may_hold(filter_: Column, *keys: str) -> Column:
    """Whether a row's keys may be among those of the filter; never false for one that is."""
    word = F.element_at(filter_, (_slot(*keys) / 64).cast("int") + 1)
    return F.getbit(word, (_slot(*keys) % 64).cast("int")) == 1


def _is_mark(at: str) -> Column:
    return F.expr(f"instr('abcdefghijklmnopqrstuvwxyz0123456789', substring(x, {at}, 1)) = 0")


def _cut_out(texts: DataFrame, marked: Column, free: Column) -> DataFrame:
    """texts (with a column x) once for each place `at` in x and length: those of `marked` from a mark (no letter or digit) on, those of `free` from anywhere."""
    sizes = F.when(_is_mark("at"), F.array_union(marked, free)).otherwise(free)
    left = F.length("x") - F.array_min(F.array_union(marked, free)) + 1
    places = texts.withColumn("at", F.explode(F.when(left > 0, F.sequence(F.lit(1), left))))
    every = places.withColumn("size", F.explode(sizes))
    return every.filter(F.col("at") + F.col("size") - 1 <= F.length("x")).withColumn("cut", F.expr("substring(x, at, size)"))


def _matched(needles: DataFrame, o: DataFrame) -> DataFrame:
    """o_name, o_location, matched: the needles that an asset's texts hold.

    A needle is looked for by its part from the first mark on, where that is at least half of it, else by the
    whole of it: texts are cut at marks (else everywhere) into pieces of the lengths that some needle has,
    and met by equality.  So one piece of text, however common, brings together what really matches.
    """
    keys, n = ["o_name", "o_location"], F.length("x")
    mark = F.regexp_instr("x", F.lit("[^a-z0-9]"))
    anchored = needles.withColumn("lead", F.when((mark > 0) & (2 * (n - mark + 1) >= n), mark - 1))
    sized = anchored.withColumn("size", n - F.coalesce("lead", F.lit(0)))
    held = sized.filter("kind <> 'around'").select(
        "kind",
        F.expr("substring(x, 1 + coalesce(lead, 0))").alias("cut"),
        F.coalesce("lead", F.lit(0)).alias("lead"),
        F.col("x").alias("wanted"),
        "needle",
    )

    texts = o.select(*keys).distinct()

    def inside(kind: str, c: str) -> DataFrame:
        wanted = sized.filter(F.col("kind") == kind)
        marked = wanted.filter("lead is not null").agg(F.collect_set("size")).scalar()
        free = wanted.filter("lead is null").agg(F.collect_set("size")).scalar()
        mine = texts.select(*keys, F.lit(kind).alias("kind"), F.col(c).alias("x")).filter("x <> ''")
        # nearly all pieces are no needle's: they end here, before the join moves them
        met = _cut_out(mine, marked, free).filter(_may_hold(_key_filter(held, "kind", "cut"), "kind", "cut"))
        found = met.join(held, ["kind", "cut"]).filter("at > lead and substring(x, at - lead, length(wanted)) = wanted")
        return found.select(*keys, "needle")

    # the other way round the texts of the targets are cut, and the name of an asset is one piece
    lengths = texts.filter("o_name <> ''").agg(F.collect_set(F.length("o_name"))).scalar()
    around = needles.filter("kind = 'around'").withColumn("at", F.explode(F.sequence(F.lit(1), n)))
    around = around.withColumn("size", F.explode(lengths)).filter("at + size - 1 <= length(x)")
    around = around.select(F.expr("substring(x, at, size)").alias("o_name"), "needle").distinct()
    named = texts.filter(_may_hold(_key_filter(around, "o_name"), "o_name"))
    found = inside("in_name", "o_name").unionByName(inside("in_place", "o_location"))
    found = found.unionByName(named.join(around, "o_name").select(*keys, "needle"))
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set("needle")).alias("matched"))


def _classed(t: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets with their class: equal evidence for every one of the targets, and equal facts about levels.

    Read for the classes and again for their members, so it is written once, with the few columns of an asset
    that lineage shows; reading `assets` itself takes two narrow scans.
    """
    o = _asset_side(assets)
    name, type_ = F.col("o_name"), low("type")
    evidence = {
        "words": _words("o_name"),
        "head": F.when(_dotted("source", "o_name"), F.substring_index(name, ".", 1)),
        "two": F.when(_dotted("source", "o_name"), F.substring_index(name, ".", 2)),
        "matched": F.coalesce("matched", F.array().cast("array<string>")),
        "nameless": name == "",
    }
    facts = [
        *(has_any(name, w) for w in (rules.UPSTREAM_WORDS, rules.DOWNSTREAM_WORDS, rules.MODEL_WORDS)),
        *(type_.contains(w) for w in ("dataset", "view")),
        type_ == "bigquery_table",
        F.length(name),
    ]
    joined = o.join(_matched(_needles(t), o), ["o_name", "o_location"], "left").withColumns(evidence)
    same = F.struct("source", *evidence, *(f.alias(f"f{k}") for k, f in enumerate(facts)))
    shown = ["id", "name", "type", "source", "last_scanned", *evidence]
    return cut_lineage(joined.withColumn("class", F.md5(F.to_json(same))).select(*shown, "class"))


def _scored_classes(t: DataFrame, classed: DataFrame) -> DataFrame:
    """target_id, class, score of every class that scores two or more: one equi-join on pieces of evidence."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    each = lambda kind, c: F.transform(c, lambda x: key(kind, x))
    classes = classed.groupBy("class").agg(
        *(F.first(c).alias(c) for c in ("source", "words", "head", "two", "matched", "nameless"))
    )
    shown = F.concat(
        F.array(key("source", F.col("source")), F.lit("any:"), F.when(F.col("nameless"), F.lit("nameless:"))),
        each("word", F.col("words")),
        F.array(key("head", F.col("head")), key("two", F.col("two"))),
        each("needle", F.col("matched")),
    )
    shown = classes.select("class", F.explode(F.array_compact(shown)).alias("key"))
    dotted = _dotted("t_source", "t_name")
    worth = lambda k, points, named=False: F.struct(
        k.alias("key"), F.lit(points).alias("points"), F.lit(named).alias("named")
    )
    needle = lambda kind, c: key("needle", _needle(kind, c)["needle"])
    n = F.col("t_name")
    asked = F.concat(
        F.array(
            worth(key("source", F.col("t_source")), 2),
            worth(F.when(dotted, key("head", F.substring_index(n, ".", 1))), 2),
            worth(F.when(dotted, key("two", F.substring_index(n, ".", 2))), 1),
            worth(F.when(n != "", needle("in_name", n)), 0, True),
            worth(F.when(n != "", needle("around", n)), 0, True),
            worth(F.when(n == "", F.lit("any:")).otherwise("nameless:"), 0, True),
            worth(F.when(F.col("t_location") != "", needle("in_place", F.col("t_location"))), 1),
        ),
        F.transform("t_words", lambda w: worth(key("word", w), 1)),
        F.transform(_own_segments(), lambda x: worth(needle("in_name", x), 1)),
    )
    bonus = F.array_contains("segments", "").cast("int")  # an empty segment stands in every name
    asked = t.select("target_id", bonus.alias("bonus"), F.explode(asked).alias("e")).select("target_id", "bonus", "e.*")
    score = F.max("bonus") + F.sum("points") + 2 * F.max(F.col("named").cast("int"))
    return (
        asked.filter("key is not null")
        .join(shown, "key")
        .groupBy("target_id", "class")
        .agg(score.cast("int").alias("score"))
        .filter("score >= 2")
    )


def related_assets(targets: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets scoring two or more against a target: every pair, so as many rows as a source has assets.

    For the few that levels need, leading_assets does not list the pairs.
    """
    t = cut_lineage(_target_side(targets))
    classed = _classed(t, assets)
    named = t.select("target_id", "target_name", "target_type")
    return (
        _scored_classes(t, classed)
        .join(named, "target_id")
        .join(classed, "class")
        .filter("id <> target_id")
        .select(*_RELATED)
    )


def leading_assets(targets: DataFrame, assets: DataFrame, direction: str = "both", depth: int = 3) -> DataFrame:
    """The related assets that lineage_levels needs, in one plan for any number of targets.

    Of each class only the newest members can stand at a level, and for each target only the leading
    classes: one more of each than there are places, since the target may be among them.
    """
    places = PER_LEVEL * depth + 1
    t = cut_lineage(_target_side(targets))
    classed = _classed(t, assets)
    newest = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("last_scanned"), "id"))
    member = F.struct("rn", "id", "name", "type", "source", "last_scanned")
    members = (
        classed.withColumn("rn", newest)
        .filter(F.col("rn") <= places)
        .groupBy("class")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
    )
    first = F.col("members")[0]
    shown = ["target_id", "target_name", "target_type", "class", "score"]
    classes = (
        _scored_classes(t, classed)
        .join(t.select("target_id", "target_name", "target_type"), "target_id")
        .join(members, "class")
        .withColumns({"name": first["name"], "type": first["type"], "last_scanned": first["last_scanned"], "id": first["id"]})
    )
    order = Window.partitionBy("target_id", "direction", "q").orderBy(F.desc("score"), F.desc("last_scanned"), "id")
    return (
        classes.withColumn("v", F.explode(_votes(direction)))
        .select(*shown, "members", "last_scanned", "id", "v.direction", "v.q")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= places)
        .select(*shown, F.explode("members").alias("m"))
        .select("target_id", "target_name", "target_type", "m.id", "m.name", "m.type", "m.source", "m.last_scanned", "score")
        .filter("id <> target_id")
        .distinct()
    )


# --- levels -------------------------------------------------------------------


def _eligible() -> dict[str, tuple[Column, Column]]:
    """Per direction: whether a related asset stands at any level, or only near (level 1)."""
    t_name, t_type = F.lower("target_name"), F.col("target_type")
    name, type_, score = low("name"), low("type"), F.col("score")
    bigquery = type_ == "bigquery_table"
    upstream = (
        has_any(name, rules.UPSTREAM_WORDS)
        | (type_.contains("dataset") & t_type.contains("table"))
        | (has_any(t_name, rules.UPSTREAM_TARGET_WORDS) & bigquery)
    )
    downstream = (
        has_any(name, rules.DOWNSTREAM_WORDS)
        | (type_.contains("view") & t_type.contains("table"))
        | (has_any(t_name, rules.DOWNSTREAM_TARGET_WORDS) & bigquery)
        | (has_any(name, rules.MODEL_WORDS) & (score >= 3))
    )
    return {
        "upstream": (upstream, score >= 4),
        "downstream": (downstream, (score >= 3) & (F.length(name) > F.length(t_name))),
    }


def _votes(direction: str) -> Column:
    """The directions that a related asset may stand in, and whether at any level or only near."""
    sides = {d: e for d, e in _eligible().items() if direction in ("both", d)}
    if not sides:
        raise ValueError("direction is one of both, upstream, downstream")
    return F.array_compact(
        F.array(
            *[
                F.when(standing | near, F.struct(F.lit(d).alias("direction"), standing.alias("q")))
                for d, (standing, near) in sides.items()
            ]
        )
    )


def lineage_levels(related: DataFrame, direction: str = "both", depth: int = 3) -> DataFrame:
    """Related assets with direction and level (negative upstream), in one pass over `related`.

    Greedy levels in closed form: level 1 takes the first three standing or near assets, each
    further level the next three standing ones.  At most 3 * depth rows per target, direction
    and kind can matter; the row_number filter drops the others before the shuffle.
    """
    order = [F.desc("score"), F.desc("last_scanned"), F.asc("id")]
    kept = (
        related.withColumn("v", F.explode(_votes(direction)))
        .select(*_RELATED, "v.direction", "v.q")
        .withColumn("rn", F.row_number().over(Window.partitionBy("target_id", "direction", "q").orderBy(*order)))
        .filter(F.col("rn") <= PER_LEVEL * depth)
    )
    first = F.row_number().over(Window.partitionBy("target_id", "direction").orderBy(*order)) <= PER_LEVEL
    rest = F.row_number().over(Window.partitionBy("target_id", "direction", "is_first").orderBy(*order))
    level = F.when(F.col("is_first"), 1).otherwise(2 + F.floor((F.col("rest") - 1) / PER_LEVEL)).cast("int")
    return (
        kept.withColumn("is_first", first)
        .filter("is_first or q")
        .withColumn("rest", rest)
        .withColumn("level", level)
        .filter(F.col("level") <= depth)
        .withColumn("level", F.when(F.col("direction") == "upstream", -F.col("level")).otherwise(F.col("level")))
        .select(*_RELATED, "direction", "level")
    )


def upstream_levels(related: DataFrame, depth: int = 3) -> DataFrame:
    return lineage_levels(related, "upstream", depth)


def downstream_levels(related: DataFrame, depth: int = 3) -> DataFrame:
    return lineage_levels(related, "downstream", depth)


# --- graph --------------------------------------------------------------------


def custom_edges(targets: DataFrame, assets: DataFrame, rel: DataFrame) -> DataFrame:
    """Declared relationships of the targets whose other end the catalog knows, with that end."""
    t = targets.select(F.col("fingerprint").alias("target_id"))
    known = assets.filter("is_active").select(F.col("fingerprint").alias("id"), "name", "type", "source")
    source, target = F.col("source_asset"), F.col("target_asset")
    end = lambda at, other, up: F.struct(at.alias("target_id"), other.alias("id"), F.lit(up).alias("up"))
    ends = F.array_compact(F.array(end(target, source, True), F.when(source != target, end(source, target, False))))
    # `rel` is read once for both directions, and a row moves without what its ends tell again
    told = rel.select(F.explode(ends).alias("e"), "relationship_type", "confidence", "description")
    return (
        told.select("e.*", "relationship_type", "confidence", "description")
        .join(t, "target_id")
        .join(known, "id")
        .select(
            "target_id",
            "id",
            "name",
            "type",
            "source",
            F.when(F.col("up"), "upstream").otherwise("downstream").alias("direction"),
            F.when(F.col("up"), F.col("id")).otherwise(F.col("target_id")).alias("source_id"),
            F.when(F.col("up"), F.col("target_id")).otherwise(F.col("id")).alias("sink_id"),
            F.col("relationship_type").alias("relationship"),
            "confidence",
            F.coalesce("description", F.lit("")).alias("description"),
        )
    )


def merge_custom(
    nodes: DataFrame, edges: DataFrame, targets: DataFrame, assets: DataFrame, rel: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Add declared relationships, one hop, to a graph; a node already present is not added again.

    Those of the targets are read three times, for the nodes and for the edges, and written once.
    """
    declared = cut_lineage(custom_edges(targets, assets, rel))
    level = F.when(F.col("direction") == "upstream", -1).otherwise(1)
    fresh = (
        declared.filter(F.col("id") != F.col("target_id"))
        .select("target_id", "id", "name", "type", "source", level.alias("level"), "direction")
        .dropDuplicates(["target_id", "id", "direction"])
        .withColumn("custom", F.lit(True))
    )
    # what is declared stands at one hop, so a guessed node for the same end gives way
    guessed = nodes.join(fresh.select("target_id", "id", "direction"), ["target_id", "id", "direction"], "left_anti")
    all_nodes = guessed.select(fresh.columns).unionByName(fresh)
    added = declared.select(
        "target_id",
        "source_id",
        "sink_id",
        "relationship",
        "confidence",
        F.lit(True).alias("custom"),
        "description",
    )
    return all_nodes, edges.unionByName(added)


def lineage_graph(
    targets: DataFrame,
    assets: DataFrame,
    rel: DataFrame | None = None,
    direction: str = "both",
    depth: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the targets: guessed levels plus declared relationships.

    Guessed nodes of any level are linked straight to the target.  The levels, a few rows per target, are
    read for the nodes and for the edges and written once; so are the targets, with what a graph shows of them.
    """
    targets = cut_lineage(targets.select("fingerprint", "name", "type", "source", "location"))
    levels = cut_lineage(lineage_levels(leading_assets(targets, assets, direction, depth), direction, depth))
    shape = ["target_id", "id", "name", "type", "source", "level", "direction", "custom"]
    own = targets.select(
        F.col("fingerprint").alias("target_id"),
        F.col("fingerprint").alias("id"),
        "name",
        "type",
        "source",
        F.lit(0).alias("level"),
        F.lit("target").alias("direction"),
        F.lit(False).alias("custom"),
    )
    nodes = own.unionByName(levels.withColumn("custom", F.lit(False)).select(*shape))
    up = F.col("direction") == "upstream"
    edges = levels.select(
        "target_id",
        F.when(up, F.col("id")).otherwise(F.col("target_id")).alias("source_id"),
        F.when(up, F.col("target_id")).otherwise(F.col("id")).alias("sink_id"),
        F.lit("feeds_into").alias("relationship"),
        F.lit(0.8).alias("confidence"),
        F.lit(False).alias("custom"),
        F.lit("").alias("description"),
    )
    if rel is not None:
        nodes, edges = merge_custom(nodes, edges, targets, assets, rel)
    label = F.when(F.col("level") == 0, "Target").when(F.col("level") < 0, "Upstream").otherwise("Downstream")
    return nodes.withColumn("label", label), edges


#: Links of one node that stand together in the stored adjacency; a node with more is spread over several buckets.
HUB = 10_000


def _adjacency(pairs: DataFrame, seed: DataFrame) -> tuple[str, DataFrame]:
    """Links (id, next) written once as (id, slice, next, slices), bucketed by id and slice: the name of
    the table, and the seed with its slices.

    A node with many links has them in several slices; `slices` is the number that the links of `next` have,
    so that a hop knows where to look without asking again.
    """
    spark = pairs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # at most one row for each HUB links: the nodes that have more than that
    hubs = cut_lineage(
        pairs.groupBy("id")
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(HUB)).cast("int").alias("slices"))
        .filter("slices > 1")
    )

    def with_slices(df: DataFrame, of: str, name: str) -> DataFrame:
        joined = df.join(hubs.select(F.col("id").alias(of), F.col("slices").alias(name)), of, "left")
        return joined.withColumn(name, F.coalesce(name, F.lit(1)))

    links = with_slices(with_slices(pairs, "id", "own"), "next", "slices").select(
        "id", F.pmod(F.hash("next"), F.col("own")).alias("slice"), "next", "slices"
    )
    table = f"cairn_links_{uuid.uuid4().hex}"
    (
        links.repartition(buckets, "id", "slice")
        .write.bucketBy(buckets, "id", "slice")
        .sortBy("id", "slice")
        .option("path", scratch_path(spark, "links"))
        .saveAsTable(table)
    )
    return table, with_slices(seed, "id", "slices")


def _hop(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """(root_id, id, slices) one link further; only the frontier is moved, links stay in their buckets."""
    spread = frontier.select(
        "root_id", "id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    )
    met = spread.join(links, ["id", "slice"]).select("root_id", F.col("next").alias("id"), links["slices"])
    return met.distinct()


def trace(
    rel: DataFrame, start: DataFrame, direction: str = "both", depth: int = 3
) -> DataFrame:
    """Nodes within `depth` declared hops of each start id, with the shortest level.

    Upstream levels are negative.  Links are written once for each side, bucketed by node, and a hop joins
    the frontier with them where they lie; each frontier is written to the shared checkpoint
    folder, so the plan stays short and a lost executor re-reads it.  Cycles, repeated links and links
    of a node to itself add nothing; null ids are met by nothing.
    """
    spark = rel.sparkSession
    pairs = cut_lineage(
        rel.select("source_asset", "target_asset").filter("source_asset != target_asset").distinct()
    )
    roots = start.select(F.col("id").alias("root_id")).distinct()
    seed = roots.select("root_id", F.col("root_id").alias("id"), F.lit(0).alias("level"))
    out = seed
    sides = {
        "upstream": pairs.select(F.col("target_asset").alias("id"), F.col("source_asset").alias("next")),
        "downstream": pairs.select(F.col("source_asset").alias("id"), F.col("target_asset").alias("next")),
    }
    for side, hops in sides.items():
        if direction not in ("both", side):
            continue
        sign = -1 if side == "upstream" else 1
        table, frontier = _adjacency(hops, seed.drop("level"))
        seen = seed
        for step in range(1, depth + 1):
            reached = (
                _hop(frontier, spark.table(table))
                .join(seen.select("root_id", "id"), ["root_id", "id"], "left_anti")
                .withColumn("level", F.lit(sign * step))
            )
            frontier = cut_lineage(reached)
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier.drop("slices"))
        # all that is returned has been written; the files of the links stay in the scratch folder
        spark.sql(f"drop table {table}")
        out = out.unionByName(seen.filter("level != 0"))
    return out


# --- names --------------------------------------------------------------------


def is_upstream(target: ColumnLike, related: ColumnLike) -> Column:
    t, r = low(target), low(related)
    return first_case(
        [
            (has_any(r, rules.DIRECTION_RELATED_WORDS), True),
            (has_any(t, rules.DIRECTION_TARGET_WORDS), True),
            (t.contains("view") & r.contains("table"), True),
        ],
        F.length(text(related)) < F.length(text(target)),
    )


def hint_columns() -> dict[str, Column]:
    """transformation_hints and update_frequency, from name and location."""
    n, loc = low("name"), low("location")
    archived = F.when(has_any(loc, rules.ARCHIVE_WORDS), F.array(F.lit("archived"))).otherwise(
        F.array().cast("array<string>")
    )
    return {
        "transformation_hints": F.concat(
            F.filter(lits(rules.HINT_WORDS), lambda w: n.contains(w) | loc.contains(w)), archived
        ),
        "update_frequency": first_case([(n.contains(w), w) for w in rules.FREQUENCY_WORDS], "unknown"),
    }


def lineage_hints(assets: DataFrame) -> DataFrame:
    return assets.select("fingerprint", *[c.alias(n) for n, c in hint_columns().items()])
