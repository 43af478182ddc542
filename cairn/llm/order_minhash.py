"""Order MinHash fingerprints, with built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import let

BINS, PER_BIN, WORDS = 32, 2, 3
#: About so many occurrences of a long text, those with the smallest hashes, are looked at first; a bin that lacks some looks at all.
SMALLEST = BINS * PER_BIN * 8
_HALF = 1 << 63


def shingles(text: Column, words: int = WORDS) -> Column:
    """The hash of every run of `words` words, in text order; a shorter text has one run of all its words.

    A word longer than 32 characters counts as several.
    """
    split = F.regexp_extract_all(text, F.lit(r"\S{1,32}"), F.lit(0))

    def runs(w: Column) -> Column:
        several = F.transform(
            F.sequence(F.lit(1), F.size(w) - (words - 1)),
            lambda i: F.xxhash64(*(F.element_at(w, (i + k).cast("int")) for k in range(words))),
        )
        one = F.array(F.xxhash64(F.concat_ws(" ", w.cast("array<string>"))))
        return F.when(F.size(w) >= words, several).when(F.size(w) > 0, one).otherwise(F.array().cast("array<long>"))

    return let(F.transform(split, lambda x: F.xxhash64(x)), runs)


def occurrences(hashes: Column) -> Column:
    """(v, at) for every shingle: a hash of the shingle and its number among equal ones, and its place in the text."""
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))

    def numbered(s: Column) -> Column:
        n = F.size(s)

        def of_runs(starts: Column) -> Column:
            numbers = F.flatten(
                F.transform(
                    starts,
                    lambda a, k: F.sequence(F.lit(1), F.coalesce(F.get(starts, k + 1), n) - a),
                )
            )
            return F.zip_with(
                s, numbers, lambda x, k: F.struct(F.xxhash64(x["h"], k).alias("v"), x["at"].alias("at"))
            )

        begins = F.filter(
            F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (F.get(s, j)["h"] != F.get(s, j - 1)["h"])
        )
        return let(begins, of_runs)

    once = F.transform(placed, lambda x: F.struct(F.xxhash64(x["h"], F.lit(1)).alias("v"), x["at"].alias("at")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), once).otherwise(
        let(F.array_sort(placed), numbered)
    )


def fingerprint(text: Column, words: int = WORDS, bins: int = BINS, per_bin: int = PER_BIN) -> Column:
    """`bins` hexadecimal values of 8 digits joined by commas ("-" for an empty bin); null and empty texts have only "-".

    Occurrence-numbered shingles fall into bins by hash; of each bin the `per_bin` smallest are put
    back in text order and hashed as a tuple.  Equal texts have equal fingerprints.
    """
    low = float(_HALF)

    def chosen(of: Column) -> Column:
        long = F.size(of) > 2 * SMALLEST
        share = F.lit(2.0 * low * SMALLEST) / F.size(of)
        # Thinned by the value that ranks: whatever is left of a bin are its smallest.
        few = F.when(long, F.filter(of, lambda x: x["v"].cast("double") + low < share)).otherwise(of)

        def by_bin(kept: Column) -> Column:
            def value(b: Column) -> Column:
                def in_bin(some: Column) -> Column:
                    return F.filter(some, lambda x: F.pmod(x["v"], F.lit(bins)) == b)

                def hashed(mine: Column) -> Column:
                    smallest = F.slice(F.array_sort(mine), 1, per_bin)
                    ordered = F.array_sort(F.transform(smallest, lambda x: F.struct(x["at"], x["v"])))
                    tuple_hash = F.xxhash64(F.transform(ordered, lambda x: x["v"]))
                    eight = F.lower(F.lpad(F.hex(F.shiftrightunsigned(tuple_hash, 32)), 8, "0"))
                    return F.when(F.size(mine) > 0, eight).otherwise("-")

                enough = let(in_bin(kept), lambda m: F.when(long & (F.size(m) < per_bin), in_bin(of)).otherwise(m))
                return let(enough, hashed)

            return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), value), ",")

        return let(few, by_bin)

    return let(let(shingles(F.coalesce(text, F.lit("")), words), occurrences), chosen)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal values among bins that either fingerprint fills; 1 where neither fills any."""

    def share(p: Column) -> Column:
        filled = F.size(F.filter(p, lambda x: (x["a"] != "-") | (x["b"] != "-")))
        same = F.size(F.filter(p, lambda x: (x["a"] == x["b"]) & (x["a"] != "-")))
        return F.when(filled == 0, F.lit(1.0)).otherwise(same / filled)

    pairs = F.zip_with(F.split(a, ","), F.split(b, ","), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.when(a.isNotNull() & b.isNotNull(), let(pairs, share))


def _ranges(docs: DataFrame, rows: int) -> Column:
    """The number of the range of doc_id that a row falls in: about `rows` documents to a range, at most 10,000 ranges.

    The bounds are quantiles (at most 10,000 numbers on the driver); a row finds its range among a
    hundred bounds and then among the hundred below.
    """
    many = min(10_000, max(1, docs.count() // rows))
    found = docs.agg(F.percentile_approx("doc_id", [k / many for k in range(1, many)] or [0.5], 10 * many)).first()[0]
    bounds = sorted(set(found or []))
    groups = [bounds[k : k + 100] for k in range(0, len(bounds), 100)] or [[]]
    heads = F.array(*(F.lit(g[0]) for g in groups if g)).cast("array<long>")
    parts = F.array(*(F.array(*(F.lit(x) for x in g)).cast("array<long>") for g in groups))
    above = F.size(F.filter(heads, lambda x: x <= F.col("doc_id")))
    below = F.size(F.filter(F.element_at(parts, F.greatest(above, F.lit(1))), lambda x: x <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), -1).when(above == 0, 0).otherwise(100 * (above - 1) + below).cast("int")


def with_next(docs: DataFrame, rows: int = 1500) -> DataFrame:
    """Each document (doc_id, text, fp) with the next one's text and fp by doc_id; after the last comes the first.

    Documents of equal doc_id stand in the order of their texts; those without an id come first.  Rows
    are dealt by ranges of doc_id and ordered inside; the first row of each range serves the last of
    the one before.
    """
    dealt = docs.withColumn("range", _ranges(docs, rows))
    order = Window.partitionBy("range").orderBy("doc_id", "text")
    inside = dealt.select(
        "*",
        F.lead("text").over(order).alias("inner_text"),
        F.lead("fp").over(order).alias("inner_fp"),
        F.lead(F.lit(True)).over(order).alias("inner"),
    )
    heads = (
        dealt.groupBy("range")
        .agg(F.min(F.struct("doc_id", "text")).alias("head"))
        .select("range", "head.doc_id", "head.text")
        .select("range", F.struct("doc_id", "text", fingerprint(F.col("text")).alias("fp")).alias("head"))
    )
    along = Window.partitionBy(F.lit(0)).orderBy("range")
    whole = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select(
        F.col("range"), F.coalesce(F.lead("head").over(along), F.first("head").over(whole)).alias("after")
    )
    return inside.join(after, "range").select(
        "doc_id",
        "text",
        "fp",
        F.when(F.col("inner"), F.col("inner_text")).otherwise(F.col("after.text")).alias("next_text"),
        F.when(F.col("inner"), F.col("inner_fp")).otherwise(F.col("after.fp")).alias("next_fp"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness and that with the next document.

    Edited text: the last half (rounded down) of the code points replaced by as many of the next
    document's first.  A null text is empty; an only document is its own next one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text")).withColumn("fp", fingerprint(F.col("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    joined = with_next(own).select("doc_id", "text", "fp", "next_fp", edited.alias("edited"))
    return joined.withColumn("edited_fp", fingerprint(F.col("edited"))).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
