"""Queries: asset lineage, column lineage, transformations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import rules
from cairn.operators import column_lineage as CL
from cairn.operators import lineage as L
from cairn.operators import sinks
from cairn.operators import stats as A
from cairn.operators import transformations as T
from cairn.plans.classification import any_of
from cairn.plans.registry import query

_WORDS = "[" + ", ".join(f"'{w}'" for w in rules.LINEAGE_WORDS) + "]"

RELATED = f"""tgt as (select fingerprint as target_id, name as target_name, lower(type) as target_type, source as t_source,
     lower(name) as t_name, lower(location) as t_location,
     list_distinct(list_concat(case when contains(name, '.') then string_split(lower(name), '.') else [] end,
       [w for w in {_WORDS} if contains(lower(name), w)])) as parts from targets),
  scored as (select target_id, target_name, target_type, c.fingerprint as id, c.name, c.type, c.source, c.last_scanned,
     case when c.source = t_source then 2 else 0 end
     + case when contains(t_source, 'bigquery') and contains(c.source, 'bigquery') and contains(t_name, '.') and contains(c.name, '.')
         then case when string_split(t_name, '.')[1:2] = string_split(lower(c.name), '.')[1:2] then 3
                   when split_part(t_name, '.', 1) = split_part(lower(c.name), '.', 1) then 2 else 0 end else 0 end
     + len([p for p in parts if contains(lower(c.name), p)])
     + case when contains(lower(c.name), t_name) or contains(t_name, lower(c.name)) then 2 else 0 end
     + case when t_location <> '' and c.location <> '' and contains(lower(c.location), t_location) then 1 else 0 end as score
     from tgt join catalog c on c.fingerprint <> target_id where c.is_active),
  rel as (select * from scored where score >= 2)"""

_N, _TN = "lower(name)", "lower(target_name)"
_UP_Q = f"""({any_of(_N, rules.UPSTREAM_WORDS)} or (contains(lower(type), 'dataset') and contains(target_type, 'table'))
   or ({any_of(_TN, rules.UPSTREAM_TARGET_WORDS)} and lower(type) = 'bigquery_table'))"""
_DOWN_Q = f"""({any_of(_N, rules.DOWNSTREAM_WORDS)} or (contains(lower(type), 'view') and contains(target_type, 'table'))
   or ({any_of(_TN, rules.DOWNSTREAM_TARGET_WORDS)} and lower(type) = 'bigquery_table')
   or ({any_of(_N, rules.MODEL_WORDS)} and score >= 3))"""
_ORDER = "order by score desc, last_scanned desc, id"


def _side(name: str, q: str, p: str, sign: str, depth: int = 3) -> str:
    return f"""{name}_c as (select *, {q} as q, row_number() over (partition by target_id {_ORDER}) as rn from rel where {q} or {p}),
  {name}_r as (select *, row_number() over (partition by target_id, rn <= 3 {_ORDER}) as rest from {name}_c where rn <= 3 or q),
  {name}_lv as (select target_id, id, name, type, source, score, '{name}' as direction,
     cast({sign}(case when rn <= 3 then 1 else 2 + (rest - 1) // 3 end) as integer) as level from {name}_r
     where rn <= 3 or 2 + (rest - 1) // 3 <= {depth})"""


_UP = _side("upstream", _UP_Q, "score >= 4", "-")
_DOWN = _side("downstream", _DOWN_Q, f"(score >= 3 and length({_N}) > length({_TN}))", "")

GRAPH = f"""{RELATED}, {_UP}, {_DOWN},
  guessed as (select * exclude (score) from upstream_lv union all select * exclude (score) from downstream_lv),
  declared as (
    select t.fingerprint as target_id, c.fingerprint as id, c.name, c.type, c.source, 'upstream' as direction,
      r.source_asset as source_id, r.target_asset as sink_id, r.relationship_type as relationship, r.confidence, r.description
      from asset_rel r join targets t on r.target_asset = t.fingerprint join catalog c on c.fingerprint = r.source_asset and c.is_active
    union all
    select t.fingerprint, c.fingerprint, c.name, c.type, c.source, 'downstream', r.source_asset, r.target_asset,
      r.relationship_type, r.confidence, r.description
      from asset_rel r join targets t on r.source_asset = t.fingerprint join catalog c on c.fingerprint = r.target_asset and c.is_active
      where r.source_asset <> r.target_asset),
  fresh as (select distinct target_id, id, name, type, source, direction,
      case when direction = 'upstream' then -1 else 1 end as level, true as custom from declared where id <> target_id),
  nodes as (
    select fingerprint as target_id, fingerprint as id, name, type, source, 'target' as direction, 0 as level, false as custom from targets
    union all select target_id, id, name, type, source, direction, level, custom from fresh
    union all select target_id, id, name, type, source, direction, level, false from guessed
      where (target_id, id, direction) not in (select (target_id, id, direction) from fresh)),
  edges as (
    select target_id, case when direction = 'upstream' then id else target_id end as source_id,
      case when direction = 'upstream' then target_id else id end as sink_id, 'feeds_into' as relationship,
      cast(0.8 as double) as confidence, false as custom, '' as description from guessed
    union all select target_id, source_id, sink_id, relationship, confidence, true, description from declared)"""


def graph(i):
    return L.lineage_graph(i.targets(), i.catalog(), i.asset_relationships())


@query(
    "lin1_lineage_id",
    """select row_id, origin, substr(regexp_replace(to_base64(encode(source || '-' || location || '-' || name)), '[=+/]', '', 'g'), 1, 16)
         as id from mixed""",
    ["mixed"],
)
def _(i):
    return i.projection("mixed").select(
        "origin", "row_id", L.lineage_id(F.lit(""), "source", "location", "name").alias("id")
    )


@query(
    "lin2_lineage_assets",
    """select c.fingerprint as id, name, true as has_schema, cast(n as integer) as column_count from catalog c
       join (select fingerprint, count(*) as n from columns_long group by fingerprint) w on w.fingerprint = c.fingerprint
       where is_active""",
    ["columns_long"],
)
def _(i):
    return L.lineage_assets(i.catalog()).select("id", "name", "has_schema", "column_count")


@query(
    "lin3_related_assets",
    f"with {RELATED} select target_id, id, cast(score as integer) as score from rel",
    ["targets"],
)
def _(i):
    return L.related_assets(i.targets(), i.catalog()).select("target_id", "id", "score")


@query(
    "lin3_related_assets_by_keys",
    f"with {RELATED} select target_id, id, cast(score as integer) as score from rel",
    ["targets"],
)
def _(i):
    # targets that come as keys only
    targets = i.catalog().join(i.targets().select("fingerprint"), "fingerprint", "left_semi")
    return L.related_assets(targets, i.catalog()).select("target_id", "id", "score")


@query(
    "lin4_upstream_levels",
    f"with {RELATED}, {_UP} select target_id, id, cast(score as integer) as score, level from upstream_lv",
    ["targets"],
)
def _(i):
    return L.upstream_levels(L.leading_assets(i.targets(), i.catalog(), "upstream")).select("target_id", "id", "score", "level")


@query(
    "lin5_downstream_levels",
    f"with {RELATED}, {_DOWN} select target_id, id, cast(score as integer) as score, level from downstream_lv",
    ["targets"],
)
def _(i):
    return L.downstream_levels(L.leading_assets(i.targets(), i.catalog(), "downstream")).select("target_id", "id", "score", "level")


@query(
    "lin6_lineage_nodes",
    f"""with {GRAPH} select target_id, id, name, level, direction, custom,
          case when level = 0 then 'Target' when level < 0 then 'Upstream' else 'Downstream' end as label from nodes""",
    ["targets", "asset_rel"],
)
def _(i):
    return graph(i)[0].select("target_id", "id", "name", "level", "direction", "custom", "label")


@query(
    "lin6_lineage_edges",
    f"with {GRAPH} select target_id, source_id, sink_id, relationship, confidence, custom, description from edges",
    ["targets", "asset_rel"],
)
def _(i):
    return graph(i)[1]


@query(
    "lin7_custom_edges",
    """select t.fingerprint as target_id, case when r.target_asset = t.fingerprint then r.source_asset else r.target_asset end as id,
         r.relationship_type as relationship, r.confidence from asset_rel r
       join (select fingerprint from catalog where is_active) t on r.target_asset = t.fingerprint or r.source_asset = t.fingerprint
       join catalog c on c.is_active and c.fingerprint = case when r.target_asset = t.fingerprint then r.source_asset else r.target_asset end""",
    ["asset_rel"],
)
def _(i):
    assets = i.catalog()
    return L.custom_edges(assets.filter("is_active"), assets, i.asset_relationships()).select(
        "target_id", "id", "relationship", "confidence"
    )


@query(
    "lin8_trace",
    """with recursive down(root_id, id, level) as (
         select 'nation:' || n_nationkey, 'nation:' || n_nationkey, 0 from nation
         union select d.root_id, r.target_asset, d.level + 1 from down d join relationships r on r.source_asset = d.id where d.level < 3),
       up(root_id, id, level) as (
         select 'nation:' || n_nationkey, 'nation:' || n_nationkey, 0 from nation
         union select u.root_id, r.source_asset, u.level - 1 from up u join relationships r on r.target_asset = u.id where u.level > -3)
       select root_id, id, min(level) as level from down group by root_id, id
       union all select root_id, id, max(level) from up where level < 0 group by root_id, id""",
    ["relationships"],
)
def _(i):
    start = i.table("nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    return L.trace(i.projection("relationships"), start, "both", 3)


_CONF = f"""case when x = y then 0.95
   when contains(y, x) or contains(x, y) or replace(x, '_', '') = replace(y, '_', '')
     or (ends_with(x, '_id') and ends_with(y, '_id') and split_part(x, '_', 1) = split_part(y, '_', 1)) then 0.8
   when x_type = y_type and length(x) > 2 and {any_of("x", rules.COLUMN_TOPIC_WORDS)} and {any_of("y", rules.COLUMN_TOPIC_WORDS)} then 0.6
   else 0.0 end"""
_IS_UP = f"""case when {any_of("lower(other_asset)", rules.DIRECTION_RELATED_WORDS)} then true
   when {any_of("lower(target_name)", rules.DIRECTION_TARGET_WORDS)} then true
   when contains(lower(target_name), 'view') and contains(lower(other_asset), 'table') then true
   else length(other_asset) < length(target_name) end"""
COLUMN_EDGES = f"""partners as materialized (select * from catalog where is_active order by last_scanned desc, fingerprint limit 6),
  pairs as materialized (select * from (select t.fingerprint as target_id, t.name as target_name, p.fingerprint as other_id, p.name as other_asset,
      row_number() over (partition by t.fingerprint order by p.last_scanned desc, p.fingerprint) as rn
      from targets t join partners p on p.fingerprint <> t.fingerprint) where rn <= 5),
  held as materialized (select fingerprint, ordinal, column_name, column_type from columns_long
      where fingerprint in (select target_id from pairs union select other_id from pairs)),
  matched as materialized (select target_id, a.ordinal, a.column_name, other_id, other_asset, b.column_name as other_column,
      case when {_IS_UP} then 'upstream' else 'downstream' end as direction,
      lower(a.column_name) as x, lower(b.column_name) as y, a.column_type as x_type, b.column_type as y_type
      from pairs join held a on a.fingerprint = target_id join held b on b.fingerprint = other_id),
  cedges as (select target_id, ordinal, column_name, other_id, other_asset, other_column, direction,
      cast({_CONF} as double) as confidence from matched where {_CONF} > 0.5)"""

# with all partners: names and types are scored once, then met with the columns that have them
ALL_COLUMN_EDGES = f"""tcols as (select t.fingerprint as target_id, t.name as target_name, a.ordinal, a.column_name,
      lower(a.column_name) as x, a.column_type as x_type from targets t join columns_long a on a.fingerprint = t.fingerprint),
  ocols as (select fingerprint as other_id, asset_name as other_asset, column_name as other_column,
      lower(column_name) as y, column_type as y_type from columns_long where is_active),
  scored_names as (select x, x_type, y, y_type, cast({_CONF} as double) as confidence
      from (select distinct x, x_type from tcols) cross join (select distinct y, y_type from ocols)),
  cedges as (select target_id, ordinal, column_name, other_id, other_asset, other_column,
      case when {_IS_UP} then 'upstream' else 'downstream' end as direction, confidence
      from tcols join (select * from scored_names where confidence > 0.5) using (x, x_type)
      join ocols using (y, y_type) where other_id <> target_id)"""


@query(
    "lin9_column_edges",
    f"with {ALL_COLUMN_EDGES} select * from cedges",
    ["targets", "columns_long"],
)
def _(i):
    return CL.column_edges(i.targets(), i.catalog())


@query(
    "lin9_column_edges_newest",
    f"with {COLUMN_EDGES} select * from cedges",
    ["targets", "columns_long"],
)
def _(i):
    return CL.column_edges(i.targets(), i.catalog(), limit=5)


def _transformations_sql(n: str, t: str, up: str) -> str:
    return f"""case when {any_of(n, ["id", "key", "pk", "fk"])} then case when {up} then 'direct_copy, key_lookup' else 'generated_key' end
      when {any_of(n, ["total", "sum", "count", "avg", "max", "min"])} then 'aggregation, mathematical_operation' ||
        case when contains({n}, 'total') or contains({n}, 'sum') then ', sum' when contains({n}, 'count') then ', count'
          when contains({n}, 'avg') then ', average' else '' end
      when {any_of(t, ["date", "time"])} then 'date_formatting, timezone_conversion'
      when {any_of(t, ["string", "varchar", "text"])} then 'string_formatting, data_cleaning' ||
        case when contains({n}, 'name') then ', concatenation' else '' end
      when {any_of(t, ["int", "float", "decimal", "number"])} then 'data_type_conversion, mathematical_operation'
      else 'data_transformation' end"""


@query(
    "lin9b_column_matrix",
    f"""with {COLUMN_EDGES},
          grouped as (select target_id, ordinal,
            string_agg(other_asset || '.' || other_column, ', ' order by other_asset || '.' || other_column)
              filter (direction = 'upstream') as up,
            string_agg(other_asset || '.' || other_column, ', ' order by other_asset || '.' || other_column)
              filter (direction = 'downstream') as down,
            floor(round(avg(confidence) * 100, 6) + 0.5) as mean from cedges group by target_id, ordinal)
        select c.fingerprint as target_id, c.ordinal, c.column_name, coalesce(up, 'None') as upstream_columns,
          coalesce(down, 'None') as downstream_columns,
          {_transformations_sql("lower(c.column_name)", "lower(c.column_type)", "up is not null")} as transformations,
          cast(coalesce(mean, 0) as bigint) as confidence
        from columns_long c join targets t on t.fingerprint = c.fingerprint
        left join grouped g on g.target_id = c.fingerprint and g.ordinal = c.ordinal""",
    ["targets", "columns_long"],
)
def _(i):
    targets = i.targets()
    return CL.column_lineage_matrix(targets, CL.column_edges(targets, i.catalog(), limit=5))


@query(
    "agg9_avg_confidence",
    f"""with {ALL_COLUMN_EDGES}, m as (select target_id, column_name, avg(confidence) as mean from cedges group by target_id, column_name)
        select c.fingerprint as target_id, c.column_name, cast(coalesce(floor(round(mean * 100, 6) + 0.5), 0) as bigint) as confidence
        from (select distinct c.fingerprint, column_name from columns_long c join targets t on t.fingerprint = c.fingerprint) c
        left join m on m.target_id = c.fingerprint and m.column_name = c.column_name""",
    ["targets", "columns_long"],
)
def _(i):
    targets = i.targets()
    cols = targets.select(F.col("fingerprint").alias("target_id"), F.explode("columns").alias("c")).select(
        "target_id", F.col("c.name").alias("column_name")
    )
    return A.avg_confidence(CL.column_edges(targets, i.catalog()), cols.distinct())


@query(
    "lin10_is_upstream",
    f"""select target_id, other_id, {_IS_UP} as is_upstream from (select t.fingerprint as target_id, t.name as target_name,
          c.fingerprint as other_id, c.name as other_asset from asset_rel r join catalog t on t.fingerprint = r.target_asset
          join catalog c on c.fingerprint = r.source_asset)""",
    ["asset_rel"],
)
def _(i):
    named = i.catalog().select("fingerprint", "name")
    t = named.select(F.col("fingerprint").alias("target_asset"), F.col("name").alias("t_name"))
    o = named.select(F.col("fingerprint").alias("source_asset"), F.col("name").alias("o_name"))
    return (
        i.asset_relationships()
        .join(t, "target_asset")
        .join(o, "source_asset")
        .select(
            F.col("target_asset").alias("target_id"),
            F.col("source_asset").alias("other_id"),
            L.is_upstream("t_name", "o_name").alias("is_upstream"),
        )
    )


@query(
    "lin11_column_transformations",
    f"""select fingerprint, ordinal, {_transformations_sql("lower(column_name)", "lower(column_type)", "ordinal > 1")}
          as transformations from columns_long""",
    ["columns_long"],
)
def _(i):
    cols = i.catalog().select("fingerprint", F.explode("columns").alias("c"))
    return cols.select(
        "fingerprint",
        F.col("c.ordinal").alias("ordinal"),
        F.array_join(CL.column_transformations("c.name", "c.type", F.col("c.ordinal") > 1), ", ").alias(
            "transformations"
        ),
    )


@query(
    "lin12_lineage_hints",
    f"""select fingerprint, array_to_string(list_concat(
          [w for w in {rules.HINT_WORDS} if contains(lower(name), w) or contains(lower(location), w)],
          case when {any_of("lower(location)", rules.ARCHIVE_WORDS)} then ['archived'] else [] end), ',') as transformation_hints,
          case when contains(lower(name), 'daily') then 'daily' when contains(lower(name), 'hourly') then 'hourly'
            when contains(lower(name), 'weekly') then 'weekly' when contains(lower(name), 'monthly') then 'monthly'
            else 'unknown' end as update_frequency
        from catalog""",
    ["catalog"],
)
def _(i):
    return L.lineage_hints(i.catalog()).withColumn("transformation_hints", F.array_join("transformation_hints", ","))


def _edge_text_sql(kind: str, s: str, t: str) -> str:
    out = []
    for k, v in rules.EDGE_TEXTS.items():
        text = v.replace("{s}", f"' || {s} || '").replace("{t}", f"' || {t} || '")
        out.append(f"when {kind} = '{k}' then '{text}'")
    return f"case {' '.join(out)} else {kind} || ' transformation from ' || {s} || ' to ' || {t} end"


EDGE_T = f"""edge_t as (select e.target_id, e.relationship as type,
    case when e.description <> '' then e.description else
      {_edge_text_sql("e.relationship", "coalesce(s.name, 'source')", "coalesce(t.name, 'target')")} end as description,
    case when e.confidence is null or e.confidence = 0 then 0.8 else e.confidence end as confidence,
    coalesce(s.name, e.source_id) as source, coalesce(t.name, e.sink_id) as target
  from edges e left join (select distinct target_id, id, name from nodes) s on s.target_id = e.target_id and s.id = e.source_id
    left join (select distinct target_id, id, name from nodes) t on t.target_id = e.target_id and t.id = e.sink_id
  where e.relationship <> 'feeds_into')"""

_PAIRS = """pairs_u as (select u.target_id, u.id, u.name as u_name, u.type as u_type, t.name as t_name, t.type as t_type
  from nodes u join nodes t on t.target_id = u.target_id and t.level = 0 where u.level < 0)"""

SCHEMA_T = """lists as (select fingerprint, count(*) as n, list(distinct lower(column_name)) as l from columns_long group by 1),
  wide as (select p.*, u.n as un, t.n as tn, len(list_intersect(u.l, t.l)) as common
    from pairs_u p join lists u on u.fingerprint = p.id join lists t on t.fingerprint = p.target_id),
  schema_t as (
    select target_id, 'column_projection' as type, 'Column reduction from ' || un || ' to ' || tn || ' columns' as description,
      cast(0.85 as double) as confidence, u_name as source, t_name as target from wide where tn * 10 < un * 7
    union all select target_id, 'column_expansion', 'Column expansion from ' || un || ' to ' || tn || ' columns', 0.8, u_name, t_name
      from wide where tn * 10 > un * 13
    union all select target_id, 'column_mapping', common || ' columns mapped between assets', 0.9, u_name, t_name
      from wide where common > 0)"""

TYPE_T = """type_t as (
    select target_id, 'table_to_view' as type, 'Table data transformed into view with business logic' as description,
      cast(0.88 as double) as confidence, u_name as source, t_name as target from pairs_u
      where contains(lower(u_type), 'table') and contains(lower(t_type), 'view')
    union all select target_id, 'data_cleansing', 'Raw data cleansing and standardization', 0.85, u_name, t_name from pairs_u
      where contains(lower(u_type), 'raw') and not contains(lower(t_type), 'raw')
    union all select target_id, 'file_ingestion', 'File data ingested into structured table', 0.92, u_name, t_name from pairs_u
      where contains(lower(u_type), 'file') and contains(lower(t_type), 'table'))"""

PATTERN_T = "pattern_t as (" + " union all ".join(
    f"""select target_id, '{kind}' as type, '{text}' as description, cast({conf} as double) as confidence,
        string_agg(u_name, ', ' order by u_name) as source, t_name as target from pairs_u
        where {any_of("lower(t_name)", words)} group by target_id, t_name"""
    for words, kind, text, conf in rules.NAME_TRANSFORMATIONS
) + ")"

_T = "target_id, type, description, confidence, source, target"
_NEEDS = ["targets", "asset_rel", "columns_long"]


@query("lin13_edge_transformations", f"with {GRAPH}, {EDGE_T} select {_T} from edge_t", _NEEDS)
def _(i):
    return T.edge_transformations(*graph(i))


@query("lin14_schema_transformations", f"with {GRAPH}, {_PAIRS}, {SCHEMA_T} select {_T} from schema_t", _NEEDS)
def _(i):
    return T.schema_transformations(graph(i)[0], i.catalog())


def renamed_nodes(i):
    """Nodes of the graph with types that reach every type rule."""
    nodes = graph(i)[0]
    return nodes.withColumn(
        "type",
        F.when(F.col("level") == 0, F.concat(F.col("type"), F.lit("_view_table")))
        .when(F.col("level") == -1, F.concat(F.lit("raw_file_"), "type"))
        .otherwise(F.concat(F.col("type"), F.lit("_table"))),
    )


_RENAMED = """renamed as (select * replace (case when level = 0 then type || '_view_table' when level = -1 then 'raw_file_' || type
    else type || '_table' end as type) from nodes)"""


@query(
    "lin15_type_transformations",
    f"with {GRAPH}, {_RENAMED}, {_PAIRS.replace('from nodes u join nodes t', 'from renamed u join renamed t')}, {TYPE_T} select {_T} from type_t",
    _NEEDS,
)
def _(i):
    return T.type_transformations(renamed_nodes(i))


@query("lin16_pattern_transformations", f"with {GRAPH}, {_PAIRS}, {PATTERN_T} select {_T} from pattern_t", _NEEDS)
def _(i):
    return T.pattern_transformations(graph(i)[0])


@query(
    "agg11_transformation_counts",
    f"""with {GRAPH}, {_PAIRS}, {EDGE_T}, {SCHEMA_T}, {TYPE_T}, {PATTERN_T}
        select type, count(*) as n from (select type from edge_t union all select type from schema_t
          union all select type from type_t union all select type from pattern_t) group by type""",
    _NEEDS,
)
def _(i):
    nodes, edges = graph(i)
    return A.transformation_counts(T.all_transformations(nodes, edges, i.catalog()))


@query(
    "agg10_lineage_counts",
    f"""with {GRAPH} select target_id, count(*) filter (level < 0) as upstream, count(*) filter (level = 0) as current,
          count(*) filter (level > 0) as downstream, max(abs(level)) as max_level from nodes group by target_id""",
    ["targets", "asset_rel"],
)
def _(i):
    return A.lineage_counts(graph(i)[0])


@query(
    "lin17_complexity",
    f"""with {GRAPH}, n as (select target_id, count(*) as nodes, max(abs(level)) as depth from nodes group by target_id),
          e as (select target_id, count(*) as edges from edges group by target_id),
          b as (select n.target_id, nodes, coalesce(edges, 0) as edges, depth, coalesce(edges, 0) / nodes as r
                from n left join e on e.target_id = n.target_id)
        select target_id, nodes, edges, depth, case when r * 20 < 20 then 'Low' when r * 20 < 50 then 'Medium' else 'High' end as cyclomatic,
          case when depth * 15 < 30 then 'Low' when depth * 15 < 60 then 'Medium' else 'High' end as data_flow,
          case when r * 10 < 3 then 'Low' when r * 10 < 6 then 'Medium' else 'High' end as complexity,
          case when depth <= 2 then 'High' when depth <= 4 then 'Medium' else 'Low' end as performance from b""",
    ["targets", "asset_rel"],
)
def _(i):
    return T.lineage_complexity(*graph(i))


@query(
    "lin18_recommendations",
    f"""with {GRAPH}, n as (select target_id, count(*) filter (level < 0) as up, count(*) filter (level > 0) as down from nodes group by 1),
          w as (select fingerprint, count(*) as width from columns_long group by 1),
          b as (select t.fingerprint as target_id, lower(t.type) as type, width, up, down,
                  2 + case when t.description is null then 0 else 1 end as facts
                from targets t join n on n.target_id = t.fingerprint join w on w.fingerprint = t.fingerprint),
          a as (select target_id, [x for x in [
            case when width > 50 then 'Large schema detected (' || width || ' columns) - consider normalizing data structure' end,
            case when up = 0 then 'No upstream sources detected - this appears to be a source system' end,
            case when up > 5 then 'High upstream dependency (' || up || ' sources) - monitor data quality and availability' end,
            case when down > 10 then 'Critical asset with ' || down || ' downstream dependencies - implement change management' end,
            case when contains(type, 'view') then 'View detected - ensure underlying tables are properly indexed' end,
            case when contains(type, 'table') and up > 0 then 'Consider implementing incremental loading for better performance' end,
            case when facts < 3 then 'Limited metadata available - add descriptions and business context' end] if x is not null] as texts from b),
          d as (select target_id, case when len(texts) = 0 then ['Asset appears well-structured with good lineage connectivity',
             'Monitor data quality and performance metrics regularly'] else texts end as texts from a)
        select target_id, cast(unnest(range(len(texts))) as integer) as position, unnest(texts) as text from d""",
    _NEEDS,
)
def _(i):
    return T.lineage_recommendations(i.targets(), graph(i)[0]).select("target_id", "position", "text")


@query(
    "snk2_lineage_bundle",
    f"""with {GRAPH}, {ALL_COLUMN_EDGES}
        select target_id, 'node' as kind, id as a, name as b, cast(level as varchar) as c from nodes
        union all select target_id, 'edge', source_id, sink_id, relationship from edges
        union all select target_id, 'column', cast(ordinal as varchar), other_id, other_column from cedges""",
    _NEEDS,
)
def _(i):
    nodes, edges = graph(i)
    bundle = sinks.lineage_bundle(nodes, edges, CL.column_edges(i.targets(), i.catalog()))
    fields = {"node": ("id", "name", "level"), "edge": ("source_id", "sink_id", "relationship")}
    fields["column"] = ("ordinal", "other_id", "other_column")

    def field(k: int):
        return F.coalesce(*(F.when(F.col("kind") == kind, F.get_json_object("body", f"$.{f[k]}")) for kind, f in fields.items()))

    return bundle.select("target_id", "kind", *(field(k).alias(n) for k, n in enumerate("abc")))
