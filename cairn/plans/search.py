"""Queries: search, facets, statistics, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import rules
from cairn.operators import search as Q
from cairn.operators import stats as A
from cairn.plans.classification import any_of
from cairn.plans.fixtures import AS_OF
from cairn.plans.maintenance import sql_ts, ts
from cairn.plans.registry import query

_FOLD = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _like(c: str, pattern: str) -> str:
    return f"{_FOLD.format(c=c)} like {_FOLD.format(c=repr(pattern))}"


@query(
    "qry1_search_assets",
    f"""select fingerprint, name, {sql_ts("last_scanned")} as last_scanned from catalog
        where is_active and ({_like("name", "%Mart_c%")} or {_like("location", "%Mart_c%")})
        order by catalog.last_scanned desc, fingerprint limit 100""",
    ["catalog"],
)
def _(i):
    return Q.search_assets(i.catalog(), "Mart_c", limit=100).select("fingerprint", "name", ts("last_scanned").alias("last_scanned"))


@query(
    "qry1_search_all_filters",
    f"""select fingerprint, name from catalog
        where is_active and ({_like("name", "%2000%")} or {_like("location", "%2000%")})
          and type = 'oracle_table' and source = 'oracle'
        order by last_scanned desc, fingerprint""",
    ["catalog"],
)
def _(i):
    return Q.search_assets(i.catalog(), "2000", "oracle_table", "oracle", limit=None).select("fingerprint", "name")


@query("qry2_by_type", "select fingerprint from catalog where is_active and type = 'csv_file'", ["catalog"])
def _(i):
    return Q.assets_by_type(i.catalog(), "csv_file").select("fingerprint")


@query("qry2_by_source", "select fingerprint from catalog where is_active and source = 'trino'", ["catalog"])
def _(i):
    return Q.assets_by_source(i.catalog(), "trino").select("fingerprint")


@query(
    "qry3_asset_details",
    f"""select fingerprint, name, size from catalog
        where is_active and ({_like("name", "%dim_bank%")} or {_like("location", "%dim_bank%")})
        order by last_scanned desc, fingerprint limit 1""",
    ["catalog"],
)
def _(i):
    return Q.asset_details(i.catalog(), "dim_bank").select("fingerprint", "name", "size")


@query(
    "qry4_filter_assets",
    """select fingerprint from catalog where type = 'mysql_view' and
         (contains(lower(name), 'phone') or contains(lower(type), 'phone') or contains(lower(source), 'phone')
          or fingerprint in (select fingerprint from columns_long where contains(lower(column_name), 'phone')))""",
    ["catalog", "columns_long"],
)
def _(i):
    return Q.filter_assets(i.catalog(), "Phone", type="mysql_view").select("fingerprint")


def _recommend_sql(term: str) -> str:
    parts = " union all ".join(
        f"select {n} as rank, '{f}' as category, {f} as value from mixed where contains(lower({f}), '{term}')"
        for n, f in enumerate(["name", "type", "source"])
    )
    return f"""with hits as ({parts}), totals as (select rank, count(*) as matches from hits group by rank)
        select category, value, matches from (select distinct rank, category, value from hits) join totals using (rank)
        order by matches desc, rank, value limit 8"""


@query("qry5_recommend", _recommend_sql("small"), ["mixed"])
def _(i):
    return Q.recommend(i.projection("mixed"), "Small")


@query(
    "qry6_fuzzy_suggest",
    """with vals as (select distinct 0 as rank, name as value from mixed union select distinct 1, type from mixed
                     union select distinct 2, source from mixed),
         near as (select rank, value from vals where levenshtein(lower(value), 'standart_tabel') between 1 and 4
                    and not exists (select 1 from mixed where contains(lower(name), 'standart_tabel')
                      or contains(lower(type), 'standart_tabel') or contains(lower(source), 'standart_tabel'))
                  order by rank, value limit 3)
       select value as suggestion, count(*) as matches from near join mixed
         on contains(lower(name), lower(value)) or contains(lower(type), lower(value)) or contains(lower(source), lower(value))
       group by rank, value""",
    ["mixed"],
)
def _(i):
    return Q.fuzzy_suggest(i.projection("mixed"), "standart_tabel")


@query(
    "qry7_fuzzy_join",
    """with terms as (select distinct lower(substr(name, 2)) as term from mixed where origin = 'part'
                      union select distinct lower(n_name || 's') from nation),
         cands as (select distinct lower(name) as candidate from mixed union select distinct lower(n_name) from nation)
       select term, candidate, cast(levenshtein(term, candidate) as integer) as distance from terms, cands
       where abs(length(term) - length(candidate)) <= length(term) // 3
         and levenshtein(term, candidate) between 1 and length(term) // 3""",
    ["mixed"],
)
def _(i):
    mixed, nations = i.projection("mixed"), i.table("nation")
    terms = (
        mixed.filter("origin = 'part'")
        .select(F.expr("substring(name, 2)").alias("term"))
        .unionAll(nations.select(F.concat("n_name", F.lit("s")).alias("term")))
    )
    names = mixed.select(F.col("name").alias("candidate")).unionAll(nations.select(F.col("n_name").alias("candidate")))
    return Q.fuzzy_join(terms, names)


@query(
    "qry8_pick_assets",
    "select origin, row_id from mixed where contains(lower(name || ' ' || type || ' ' || source), 'text_file src1')",
    ["mixed"],
)
def _(i):
    return Q.pick_assets(i.projection("mixed"), "Text_file Src1").select("origin", "row_id")


@query(
    "qry9_recent_activity",
    f"""with newest as (select * from catalog where is_active order by last_scanned desc, fingerprint limit 20)
        select fingerprint, {sql_ts("discovered_date")} as at,
          'Discovered ' || type || ' ''' || name || ''' from ' || source as message
        from newest order by newest.discovered_date desc, fingerprint limit 10""",
    ["catalog"],
)
def _(i):
    return Q.recent_activity(i.catalog(), 10, 20).select("fingerprint", ts("timestamp").alias("at"), "message")


@query(
    "qry1_search_whole",
    f"""select fingerprint, name from catalog
        where is_active and ({_like("name", "%Mart_c%")} or {_like("location", "%Mart_c%")})""",
    ["catalog"],
)
def _(i):
    return Q.search_assets(i.catalog(), "Mart_c").select("fingerprint", "name")


@query(
    "qry10_grouped_by_source",
    """select coalesce(source, 'unknown') as source, name,
         row_number() over (partition by coalesce(source, 'unknown') order by last_scanned desc nulls last, fingerprint) as position
       from catalog where is_active""",
    ["catalog"],
)
def _(i):
    return Q.assets_by_source_grouped(i.catalog())


_STATS = f"""select 'total' as scope, '' as key, * from (select count(*) as assets, cast(coalesce(sum(size), 0) as bigint) as bytes,
         count(*) filter (discovered_date >= timestamp '{AS_OF}' - interval 7 day) as recent from catalog where is_active)
       union all select 'type', type, count(*), cast(sum(size) as bigint),
         count(*) filter (discovered_date >= timestamp '{AS_OF}' - interval 7 day) from catalog where is_active group by type
       union all select 'source', source, count(*), cast(sum(size) as bigint),
         count(*) filter (discovered_date >= timestamp '{AS_OF}' - interval 7 day) from catalog where is_active group by source"""


@query("agg1_catalog_statistics", _STATS, ["catalog"])
def _(i):
    return A.catalog_statistics(i.catalog(), AS_OF)


@query("agg2_inventory", f"select scope, key, assets from ({_STATS})", ["catalog"])
def _(i):
    return A.inventory(i.catalog())


@query(
    "agg3_discovered_today",
    f"""select count(*) filter (floor((epoch_us(timestamp '{AS_OF}') - epoch_us(discovered_date)) / 86400000000) < 1)
          as discovered_today from catalog where is_active""",
    ["catalog"],
)
def _(i):
    return A.discovered_today(i.catalog(), AS_OF)


@query(
    "agg4_connector_health",
    """select count(*) as total_connectors, count(*) filter (connected) as connected_connectors,
         count(*) filter (enabled and connected) as active_connectors,
         case when count(*) filter (connected) > 0 then 'healthy' else 'degraded' end as status from status""",
    ["status"],
)
def _(i):
    return A.connector_health(i.projection("status"))


@query(
    "agg5_connectors_by_category",
    f"""with fixed as (select unnest({rules.CONNECTOR_CATEGORIES}) as category),
          counted as (select case when category in (select category from fixed) then category else 'other' end as category,
                        count(*) as n from status group by 1)
        select coalesce(f.category, c.category) as category, coalesce(n, 0) as connectors
        from fixed f full join counted c on f.category = c.category""",
    ["status"],
)
def _(i):
    return A.connectors_by_category(i.projection("status"))


@query(
    "agg6_facets",
    """select 'type' as facet, type as value, count(*) as assets from mixed group by type
       union all select 'source', source, count(*) from mixed group by source""",
    ["mixed"],
)
def _(i):
    return A.facets(i.projection("mixed"))


def _categories_sql() -> str:
    return "[x for x in [" + ", ".join(
        f"case when {any_of('lower(column_name)', words)} then '{label}' end" for label, words in rules.PII_CATEGORIES
    ) + "] if x is not null]"


@query(
    "agg7_profile_assets",
    f"""with marked as (select *, {_categories_sql()} as cats from columns_long)
        select m.fingerprint, cast(count(*) as integer) as total_columns,
          cast(count(*) filter (mode = 'NULLABLE') as integer) as nullable_columns, any_value(num_rows) as estimated_rows,
          coalesce(string_agg(column_name, ',' order by ordinal) filter (len(cats) > 0), '') as pii_columns,
          array_to_string(list_sort(list_distinct(flatten(list(cats)))), ',') as pii_types
        from marked m join catalog c on c.fingerprint = m.fingerprint group by m.fingerprint""",
    ["columns_long"],
)
def _(i):
    return A.profile_assets(i.catalog()).select(
        "fingerprint",
        "total_columns",
        "nullable_columns",
        "estimated_rows",
        F.array_join("pii_columns", ",").alias("pii_columns"),
        F.array_join("pii_types", ",").alias("pii_types"),
    )


@query(
    "agg7_type_distribution",
    """select fingerprint, column_type, cast(count(*) as integer) as n,
         round(count(*) * 100.0 / sum(count(*)) over (partition by fingerprint), 1) as percentage
       from columns_long group by fingerprint, column_type""",
    ["columns_long"],
)
def _(i):
    return A.type_distribution(i.catalog())


def _profile_sql(table: str, cols: list[tuple[str, str]]) -> str:
    def shown(c: str, kind: str, f: str) -> str:
        if kind == "timestamp_ntz":
            return f"strftime({f}({c}), '%Y-%m-%d %H:%M:%S')"
        return f"cast(round({f}({c}), 6) as varchar)" if kind == "double" else f"cast({f}({c}) as varchar)"

    return " union all ".join(
        f"select {n + 1} as ordinal, '{c}' as column_name, '{k}' as column_type, count(*) as row_count, "
        f"count(*) filter ({c} is null) as nulls, count(distinct {c}) as distinct_values, "
        f"{shown(c, k, 'min')} as min_value, {shown(c, k, 'max')} as max_value from {table}"
        for n, (c, k) in enumerate(cols)
    )


def _short(c):
    """Timestamps to whole seconds and doubles without a trailing exponent, as the SQL shows them."""
    return F.when(F.col("column_type") == "timestamp_ntz", F.substring(c, 1, 19)).otherwise(F.col(c))


_EVENTS = [
    ("event_id", "bigint"),
    ("ts", "timestamp_ntz"),
    ("user_id", "bigint"),
    ("event_type", "string"),
    ("value", "double"),
    ("props", "string"),
]
_LINEITEM = [
    ("l_orderkey", "bigint"),
    ("l_partkey", "bigint"),
    ("l_suppkey", "bigint"),
    ("l_linenumber", "int"),
    ("l_quantity", "double"),
    ("l_extendedprice", "double"),
    ("l_discount", "double"),
    ("l_tax", "double"),
    ("l_returnflag", "string"),
    ("l_linestatus", "string"),
    ("l_shipdate", "timestamp_ntz"),
]


def _shown(profile):
    return profile.withColumns({"min_value": _short("min_value"), "max_value": _short("max_value")})


@query("agg8_profile_events_exact", _profile_sql("events", _EVENTS))
def _(i):
    return _shown(A.profile_table(i.table("events"), exact=True))


@query("agg8_profile_lineitem", f"select * exclude (distinct_values) from ({_profile_sql('lineitem', _LINEITEM)})")
def _(i):
    return _shown(A.profile_table(i.table("lineitem"))).drop("distinct_values")


@query("agg8_profile_merged", f"select * exclude (distinct_values), true as near from ({_profile_sql('events', _EVENTS)})")
def _(i):
    # a sketch of every day, as if kept when the day's file came, and all of them merged
    events = i.table("events")
    days = A.profile_sketches(events.withColumn("day", F.to_date("ts")), "day")
    merged = _shown(A.merge_profiles(days, events.schema))
    exact = A.profile_table(events, exact=True).select("ordinal", F.col("distinct_values").alias("n"))
    near = F.abs(F.col("distinct_values") - F.col("n")) <= F.col("n") * 0.08
    return merged.join(exact, "ordinal").withColumn("near", near).drop("distinct_values", "n")
