"""Search, facets, suggestions and top-k listings over the catalog."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.expr import low
from cairn.session import cut_lineage

_NO_ESCAPE = "\x01"


def _ascii_fold(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def like_ascii(c: str, pattern: str) -> Column:
    """LIKE that ignores ASCII case only; % and _ are wildcards, nothing escapes them."""
    return F.call_function("like", _ascii_fold(F.col(c)), _ascii_fold(F.lit(pattern)), F.lit(_NO_ESCAPE))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("last_scanned"), "fingerprint")


def search_assets(
    assets: DataFrame, query: str = "", type: str | None = None, source: str | None = None, limit: int | None = None
) -> DataFrame:
    """Active assets whose name or location holds the query, newest scan first; a top-k where a limit is given."""
    hit = assets.filter("is_active")
    if query:
        hit = hit.filter(like_ascii("name", f"%{query}%") | like_ascii("location", f"%{query}%"))
    if type:
        hit = hit.filter(F.col("type") == type)
    if source:
        hit = hit.filter(F.col("source") == source)
    ordered = newest_first(hit)
    return ordered if limit is None else ordered.limit(limit)


def assets_by_type(assets: DataFrame, type: str) -> DataFrame:
    return assets.filter(F.col("is_active") & (F.col("type") == type))


def assets_by_source(assets: DataFrame, source: str) -> DataFrame:
    return assets.filter(F.col("is_active") & (F.col("source") == source))


def asset_details(assets: DataFrame, name: str) -> DataFrame:
    return search_assets(assets, name, limit=1)


def filter_assets(assets: DataFrame, term: str = "", type: str | None = None, source: str | None = None) -> DataFrame:
    """Free text over name, type, source or any column name, combined with exact facets."""
    out = assets
    t = term.lower()
    if t.strip():
        out = out.filter(
            low("name").contains(t)
            | low("type").contains(t)
            | low("source").contains(t)
            | F.coalesce(F.exists("columns", lambda c: F.lower(c["name"]).contains(t)), F.lit(False))
        )
    if type:
        out = out.filter(F.col("type") == type)
    if source:
        out = out.filter(F.col("source") == source)
    return out


_FIELDS = ["name", "type", "source"]


def _field_values(assets: DataFrame) -> DataFrame:
    """(field index, field, value), exploded inside each task."""
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("rank"), F.lit(f).alias("category"), F.col(f).alias("value"))
            for i, f in enumerate(_FIELDS)
        ]
    )
    return assets.select(F.explode(rows).alias("v")).select("v.*")


def recommend(assets: DataFrame, term: str, k: int = 8) -> DataFrame:
    """Distinct names, types and sources holding the term, by assets matching in that field."""
    t = term.lower()
    values = (
        _field_values(assets)
        .filter(F.lower("value").contains(t))
        .groupBy("rank", "category", "value")
        .agg(F.count("*").alias("n"))
    )
    totals = values.groupBy("rank").agg(F.sum("n").alias("matches"))
    # totals has one row per field, so at most three rows are broadcast
    return (
        values.join(F.broadcast(totals), "rank")
        .orderBy(F.desc("matches"), "rank", "value")
        .limit(k)
        .select("category", "value", "matches")
    )


def fuzzy_suggest(assets: DataFrame, term: str, keep: int = 3) -> DataFrame:
    """Spelling suggestions, only when nothing holds the term.

    Candidates come in the order names, types, sources; each kept one is returned with
    the number of assets holding it.
    """
    t = term.lower()
    d = len(t) // 3
    values = _field_values(assets)
    direct = values.filter(F.lower("value").contains(t)).limit(1).select(F.lit(1).alias("hit"))
    near = (
        values.groupBy("rank", "value")
        .agg(F.count("*").alias("n"))
        .withColumn("distance", F.levenshtein(F.lower("value"), F.lit(t), d))
        .filter(F.col("distance") > 0)
        .orderBy("rank", "value")
        .limit(keep)
        .join(direct, F.lit(True), "left_anti")
        .select("rank", F.col("value").alias("suggestion"), F.lower("value").alias("needle"))
    )
    # `near` holds at most `keep` rows, so this is a single pass over the assets
    held = assets.join(
        F.broadcast(near),
        low("name").contains(F.col("needle"))
        | low("type").contains(F.col("needle"))
        | low("source").contains(F.col("needle")),
    )
    return held.groupBy("suggestion", "rank").agg(F.count("*").alias("matches")).select("suggestion", "matches")


def fuzzy_join(terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """All (term, candidate, distance) with 0 < distance <= floor(length(term) / 3), ignoring case.

    Exact and without comparing all pairs: a term allowing d errors is cut into d + 1
    pieces, so one piece must stand unchanged in the candidate.  Where it can stand follows from the
    candidate's length: the i-th piece (from 0) is moved by at most i places, counted from the left, and at most
    d - i, counted from the right, or another piece stands as well.  Each term lists those places, so
    the join is on piece, length of the candidate and place, and a short piece meets few names.
    Repeats are removed first; nulls meet nothing.
    """
    t = (
        terms.select(F.lower("term").alias("term"))
        .distinct()
        .withColumn("len", F.length("term"))
        .withColumn("d", F.floor(F.col("len") / 3).cast("int"))
        .filter("d > 0")
    )
    pieces = t.withColumn("piece_len", F.floor(F.col("len") / (F.col("d") + 1)).cast("int")).withColumn(
        "longer", F.col("len") % (F.col("d") + 1)
    )
    # the last `longer` pieces take one character more
    pieces = (
        pieces.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
        .withColumn("over", F.greatest(F.lit(0), F.col("i") - (F.col("d") + 1 - F.col("longer"))))
        .withColumn("pos", F.col("i") * F.col("piece_len") + F.col("over"))
        .withColumn(
            "width", F.col("piece_len") + F.when(F.col("i") >= F.col("d") + 1 - F.col("longer"), 1).otherwise(0)
        )
        .withColumn("more", F.explode(F.sequence(-F.col("d"), F.col("d"))))
        .withColumn("clen", F.col("len") + F.col("more"))
        .withColumn("lowest", F.greatest(F.lit(0), F.col("pos") - F.col("i"), F.col("pos") + F.col("more") - F.col("d") + F.col("i")))
        .withColumn(
            "highest",
            F.least(
                F.col("clen") - F.col("width"), F.col("pos") + F.col("i"), F.col("pos") + F.col("more") + F.col("d") - F.col("i")
            ),
        )
        .filter("lowest <= highest")
        .withColumn("cpos", F.explode(F.sequence("lowest", "highest")))
        .select("term", "d", "clen", "cpos", F.expr("substring(term, pos + 1, width)").alias("piece"))
    )
    c = candidates.select(F.lower("candidate").alias("candidate")).distinct().withColumn("clen", F.length("candidate"))
    grams = (
        c.withColumn("q", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
        .filter(F.col("clen") >= F.col("q"))
        .withColumn("cpos", F.explode(F.sequence(F.lit(0), F.col("clen") - F.col("q"))))
        .select("candidate", "clen", "cpos", F.expr("substring(candidate, cpos + 1, q)").alias("piece"))
    )
    # the distance is tested inside the join, so only true matches are shuffled for the distinct
    return (
        pieces.join(grams, ["piece", "clen", "cpos"])
        .withColumn("distance", F.expr("levenshtein(term, candidate, d)"))
        .filter("distance > 0")
        .select("term", "candidate", "distance")
        .distinct()
    )


def pick_assets(assets: DataFrame, term: str) -> DataFrame:
    return assets.filter(F.lower(F.concat_ws(" ", "name", "type", "source")).contains(term.lower()))


def recent_activity(assets: DataFrame, n: int, newest: int) -> DataFrame:
    """Activity feed: the newest scans, then the newest discoveries among them."""
    feed = search_assets(assets, limit=newest).select(
        "fingerprint",
        F.col("discovered_date").alias("timestamp"),
        F.format_string("Discovered %s '%s' from %s", "type", "name", "source").alias("message"),
    )
    return feed.orderBy(F.desc("timestamp"), "fingerprint").limit(n)


def assets_by_source_grouped(assets: DataFrame) -> DataFrame:
    """Every active asset under its source: (source, position, name), newest scan first.

    A row per asset, so that a source of any size stays spread over many rows.  The assets are put in
    order once, over all sources: ranges of (source, time, fingerprint) are sorted each in its task and written with
    the number of the range and the row in it.  A position is then the row's own number and the rows of its source in
    earlier ranges, so one source, one day or one moment of a scan may hold nearly all assets.
    """
    order = ["source", F.desc_nulls_last("last_scanned"), "fingerprint"]
    rows = assets.filter("is_active").select(
        F.coalesce("source", F.lit("unknown")).alias("source"), "last_scanned", "fingerprint", "name"
    )
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id that Spark counts up has the task in its upper 31 bits and the row in its lower 33
    placed = cut_lineage(ranged.select("source", "name", F.monotonically_increasing_id().alias("at")))
    placed = placed.select("source", "name", F.shiftright("at", 33).alias("range"), "at")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("source", "range")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
        .select("source", "range", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    return placed.join(before, ["source", "range"]).select(
        "source", (F.col("before") + F.col("at") - F.col("first") + 1).alias("position"), "name"
    )
