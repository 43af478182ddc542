"""Projections that turn the driver tables into catalog inputs.

Each projection is one SQL text understood by Spark and by DuckDB alike, so both sides start
from the same rows.  All of them read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.expr import packed, unpacked
from cairn.operators.maintenance import fingerprint
from cairn.schema import ASSETS, column_struct

AS_OF = "2001-08-01 00:00:00"

TABLES = [
    "benchmark",
    "conversations",
    "customer",
    "documents",
    "embeddings",
    "events",
    "labels",
    "lineitem",
    "nation",
    "orders",
    "pages",
    "part",
    "region",
    "supplier",
]

MIXED = """
select 'pages' as origin, cast(page_id as bigint) as row_id,
       regexp_extract(url, '([^/?#]+)/?([?#].*)?$', 1) as name,
       case when url like '%.html%' then 'html_file' else 'web_page' end as type,
       regexp_extract(url, '^[a-z]+://([^/]+)', 1) as source,
       url as location, cast(length(html) as bigint) as size from {pages}
union all
select 'documents', doc_id, concat('doc_', cast(doc_id as varchar(20)), '.txt'), concat(lang, '_text_file'), source,
       concat('/data/', source, '/', lang), n_chars from {documents}
union all
select 'part', p_partkey, replace(p_name, ' ', '_'), concat(lower(p_type), '_table'),
       lower(replace(p_brand, '#', '_')),
       concat('/warehouse/', lower(p_type), '/', cast(p_partkey as varchar(20))), cast(p_size as bigint) * 40000
  from {part}
"""

KW = """
select o_orderkey as row_id, o_custkey as owner_id,
 concat(case when o_custkey % 6 = 3 then concat('proj', cast(o_orderkey % 3 as varchar(20)), '.ds',
                  cast(o_orderkey % 5 as varchar(20)), '.') else '' end,
        split_part('raw,staging,base,mart,agg,summary,report,fact,dim,master,core,processed', ',',
                   cast(o_orderkey % 12 as int) + 1), '_',
        split_part('customer,order,payment,employee,product,campaign,inventory,audit,patient,bank,user_log,daily_sales',
                   ',', cast(cast(floor(o_orderkey / 12.0) as bigint) % 12 as int) + 1), '_',
        cast(o_orderkey as varchar(20))) as name,
 split_part('postgresql_table,mysql_view,oracle_table,bigquery_table,trino_table,csv_file', ',',
            cast(o_custkey % 6 as int) + 1) as type,
 split_part('postgresql,mysql,oracle,gcp_bigquery,trino,file_system', ',', cast(o_custkey % 6 as int) + 1) as source,
 concat('/warehouse/', lower(o_orderstatus), '/year=', cast(extract(year from o_orderdate) as varchar(4)), '/',
        cast(o_orderkey as varchar(20))) as location,
 cast(floor(o_totalprice * 1000) as bigint) as size,
 o_orderdate as created_date,
 o_orderdate + interval '1' day * cast(o_orderkey % 120 as int) as modified_date,
 o_orderdate + interval '1' day * cast(o_orderkey % 150 as int) as last_scanned,
 o_totalprice >= 20000 as is_active,
 cast(o_orderkey % 1000 as bigint) as num_rows,
 split_part('email_address,phone_number,ssn,zip_code,birth_date,payment_method,password_hash,client_ip,session_id,total_amount',
            ',', cast(o_orderkey % 10 as int) + 1) as extra_column
from {orders}
"""

CHANGES = """
select event_id, md5(cast(user_id as varchar(20))) as asset_fingerprint,
 case event_type when 'signup' then 'CREATED' when 'error' then 'DEACTIVATED' else 'UPDATED' end as change_type,
 ts as change_date, props as new_values from {events}
"""

RELATIONSHIPS = """
select concat(source_asset, '-', target_asset, '-', relationship_type) as id, * from (
 select concat('region:', cast(n_regionkey as varchar(20))) as source_asset,
        concat('nation:', cast(n_nationkey as varchar(20))) as target_asset,
        'derived_from' as relationship_type, cast(0.9 as double) as confidence from {nation}
 union all select concat('nation:', cast(c_nationkey as varchar(20))),
        concat('customer:', cast(c_custkey as varchar(20))), 'joins_with', cast(0.8 as double) from {customer}
 union all select concat('customer:', cast(o_custkey as varchar(20))),
        concat('orders:', cast(o_orderkey as varchar(20))), 'aggregates_to', cast(0.7 as double) from {orders}) t
"""

STATUS = """
select s_name as connector,
 split_part('cloud_providers,databases,data_warehouses,network_storage,streaming,data_lakes,network,saas_platforms',
            ',', cast(s_suppkey % 8 as int) + 1) as category,
 s_acctbal > 0 as enabled, (s_acctbal > 0 and s_suppkey % 3 <> 0) as connected from {supplier}
"""

# one bucket holds every click, view and purchase: most of the rows
FILES = """
select event_id as file_id,
 case when event_type in ('click', 'view', 'purchase') then 'hot' else concat('bucket', cast(user_id % 7 as varchar(20))) end
   as bucket,
 concat(split_part('data,Database,export,backup,archive,reports,raw,processed,logs,misc', ',',
                   cast(user_id % 10 as int) + 1), '/', event_type, '/', repeat('sub/', cast(user_id % 7 as int)),
        event_type, '_', cast(event_id as varchar(20)),
        split_part('.csv,.json,.parquet,.avro,.orc,.txt,.tsv,.xlsx,.xml,.yaml,.yml,.sql,.db,.sqlite3,.log,.pdf,.docx,.zip,.tar.gz,.CSV,.Json,,.pptx,.xls',
                   ',', cast(event_id % 24 as int) + 1)) as key,
 cast(floor(abs(value) * abs(value) * 200) as bigint) as size,
 ts as modified_date
from {events}
"""

_USES = {
    "mixed": (MIXED, ["pages", "documents", "part"]),
    "kw": (KW, ["orders"]),
    "changes": (CHANGES, ["events"]),
    "relationships": (RELATIONSHIPS, ["nation", "customer", "orders"]),
    "status": (STATUS, ["supplier"]),
    "files": (FILES, ["events"]),
}


_SHAPES: dict[str, list[list[tuple[str, str]]]] = {}


class Inputs:
    """The driver tables of one folder and the projections over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def projection(self, name: str) -> DataFrame:
        sql, tables = _USES[name]
        return self.spark.sql(sql, **{t: self.table(t) for t in tables})

    def table_columns(self):
        """Columns of the driver table numbered row_id % 14, read from the table schemas."""
        if self.sf_dir not in _SHAPES:
            _SHAPES[self.sf_dir] = [
                [(f.name, f.dataType.simpleString()) for f in self.table(name).schema.fields] for name in TABLES
            ]
        shapes = ", ".join(
            "array("
            + ", ".join(f"named_struct('ordinal', {j + 1}, 'name', '{n}', 'type', '{t}')" for j, (n, t) in enumerate(fields))
            + ")"
            for fields in _SHAPES[self.sf_dir]
        )
        return F.expr(f"element_at(array({shapes}), cast(row_id % 14 + 1 as int))")

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def catalog(self) -> DataFrame:
        """Assets of projection kw with the columns of the driver tables and one more."""
        return self._once("catalog", lambda: self._assets(self._kw()))

    def _kw(self) -> DataFrame:
        return self.spark.sql(KW, orders=self.table("orders"))

    def _assets(self, kw: DataFrame) -> DataFrame:
        joined = kw.withColumn("cols", self.table_columns())
        every = F.concat(
            "cols",
            F.array(
                F.struct(
                    (F.size("cols") + 1).alias("ordinal"),
                    F.col("extra_column").alias("name"),
                    F.lit("string").alias("type"),
                )
            ),
        )

        def described(c):
            return column_struct(
                ordinal=c["ordinal"],
                name=c["name"],
                type=c["type"],
                mode=F.when(c["ordinal"] == 1, "REQUIRED").otherwise("NULLABLE"),
                nullable=c["ordinal"] != 1,
                primary_key=c["ordinal"] == 1,
                description=F.when((c["ordinal"] + F.col("row_id")) % 3 == 0, F.concat(F.lit("about "), c["name"])),
            )

        facts = F.map_filter(
            F.create_map(
                F.lit("owner"),
                F.concat(F.lit("team"), (F.col("row_id") % 7).cast("string")),
                F.lit("api_key"),
                F.concat(F.lit("k"), F.md5(F.col("row_id").cast("string"))),
                F.lit("description"),
                F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("about "), "name")),
            ),
            lambda k, v: v.isNotNull(),
        )
        stamps = {c: F.col(c).cast("timestamp") for c in ("created_date", "modified_date", "last_scanned")}
        full = joined.withColumns(stamps).withColumns(
            {
                "fingerprint": fingerprint("source", "location", "name"),
                "discovered_date": F.col("created_date"),
                "columns": F.transform(every, described),
                "tags": F.array("source", "type"),
                "metadata": facts,
            }
        )
        return full.select(*[f.name for f in ASSETS.fields], "row_id", "owner_id")

    def targets(self) -> DataFrame:
        """The newest asset of every source."""
        return self._once("targets", self._targets)

    def _targets(self) -> DataFrame:
        w = Window.partitionBy("source").orderBy(F.desc("last_scanned"), "fingerprint")

        def newest(assets: DataFrame) -> DataFrame:
            return assets.filter("is_active").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")

        # ranked without their columns; the rows of the few that lead are then built whole, and ranked again, as ids may repeat
        ranked = self.catalog().select("row_id", "source", "last_scanned", "fingerprint", "is_active")
        lead = newest(ranked).select(F.col("row_id").alias("_lead")).distinct()
        return newest(self._assets(self._kw().join(F.broadcast(lead), F.col("row_id").eqNullSafe(F.col("_lead")), "left_semi")))

    def asset_relationships(self) -> DataFrame:
        """Declared edges between catalog assets: a binary tree over the order keys."""
        return self._once("asset_relationships", self._asset_relationships)

    def _asset_relationships(self) -> DataFrame:
        kinds = "derived_from,transforms_to,aggregates_to,joins_with,filters_to,enriches_to,feeds_into,copied_to"
        child = self.catalog().select("row_id", packed("fingerprint").alias("fingerprint"), "created_date")
        parent = child.select(F.col("row_id").alias("parent_id"), F.col("fingerprint").alias("source_asset"))
        tree = child.filter("row_id > 0").withColumn("parent_id", F.expr("row_id div 2")).join(parent, "parent_id")
        tree = tree.withColumns({c: unpacked(c) for c in ("source_asset", "fingerprint")})
        return tree.select(
            "source_asset",
            F.col("fingerprint").alias("target_asset"),
            F.split_part(F.lit(kinds), F.lit(","), (F.col("row_id") % 8 + 1).cast("int")).alias("relationship_type"),
            ((F.col("row_id") % 6 + 5).cast("double") / 10).alias("confidence"),
            F.when(F.col("row_id") % 4 == 0, F.concat(F.lit("declared "), F.col("row_id").cast("string")))
            .otherwise("")
            .alias("description"),
            F.lit("user").alias("created_by"),
            F.col("created_date").alias("created_at"),
        ).select(F.concat_ws("-", "source_asset", "target_asset", "relationship_type").alias("id"), "*")


# --- the same in DuckDB ------------------------------------------------------------

_COLUMNS = [
    ("benchmark", "item_id bigint, text string"),
    ("conversations", "conv_id bigint, turn bigint, role string, text string"),
    ("customer", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    ("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"),
    ("embeddings", "vec_id bigint, embedding array<float>, label int"),
    ("events", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"),
    ("labels", "doc_id bigint, quality int, toxic int"),
    (
        "lineitem",
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz",
    ),
    ("nation", "n_nationkey int, n_name string, n_regionkey int"),
    (
        "orders",
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string",
    ),
    ("pages", "page_id bigint, url string, html string"),
    (
        "part",
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    ),
    ("region", "r_regionkey int, r_name string"),
    ("supplier", "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
]


def _column_values() -> str:
    rows = []
    for t, (_, fields) in enumerate(_COLUMNS):
        for i, f in enumerate(fields.split(", ")):
            name, kind = f.split(" ")
            rows.append(f"({t}, {i + 1}, '{name}', '{kind}')")
    return ", ".join(rows)


def _plain(name: str) -> str:
    sql, tables = _USES[name]
    return sql.format(**{t: t for t in tables})


CTES: dict[str, tuple[str, list[str]]] = {
    **{name: (_plain(name), []) for name in _USES},
    "cols": (f"select * from (values {_column_values()}) v(t, ordinal, column_name, column_type)", []),
    "catalog": (
        """select md5(concat(source, '-', location, '-', name)) as fingerprint, name, type, source, location, size,
             created_date, modified_date, created_date as discovered_date, last_scanned, num_rows, is_active,
             'team' || cast(row_id % 7 as varchar) as owner, 'k' || md5(cast(row_id as varchar)) as api_key,
             case when row_id % 3 = 0 then 'about ' || name end as description, row_id, owner_id, extra_column
           from kw""",
        ["kw"],
    ),
    "columns_long": (
        """select fingerprint, asset_name, asset_type, source, ordinal, column_name, column_type,
             case when ordinal = 1 then 'REQUIRED' else 'NULLABLE' end as mode,
             case when (ordinal + row_id) % 3 = 0 then 'about ' || column_name end as description, is_active
           from (
             select c.fingerprint, c.name as asset_name, c.type as asset_type, c.source, v.ordinal, v.column_name,
                    v.column_type, c.row_id, c.is_active
             from catalog c join cols v on v.t = c.row_id % 14
             union all
             select c.fingerprint, c.name, c.type, c.source, w.n + 1, c.extra_column, 'string', c.row_id, c.is_active
             from catalog c join (select t, cast(count(*) as integer) as n from cols group by t) w on w.t = c.row_id % 14)""",
        ["catalog", "cols"],
    ),
    "targets": (
        """select * exclude (rn) from (select *, row_number() over (partition by source
             order by last_scanned desc, fingerprint) as rn from catalog where is_active) where rn = 1""",
        ["catalog"],
    ),
    "asset_rel": (
        """select concat(source_asset, '-', target_asset, '-', relationship_type) as id, * from (
             select p.fingerprint as source_asset, c.fingerprint as target_asset,
               split_part('derived_from,transforms_to,aggregates_to,joins_with,filters_to,enriches_to,feeds_into,copied_to',
                          ',', cast(c.row_id % 8 + 1 as int)) as relationship_type,
               cast(c.row_id % 6 + 5 as double) / 10 as confidence,
               case when c.row_id % 4 = 0 then 'declared ' || c.row_id else '' end as description,
               'user' as created_by, c.created_date as created_at
             from catalog c join catalog p on p.row_id = c.row_id // 2 where c.row_id > 0)""",
        ["catalog"],
    ),
}


def oracle(body: str, uses: list[str]) -> str:
    """Prefix a DuckDB query with the projections it reads, in dependency order."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in CTES[name][1]:
            need(dep)
        if name not in order:
            order.append(name)

    for u in uses:
        need(u)
    ctes = ",\n".join(f"{n} as ({CTES[n][0]})" for n in order)
    body = body.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{body[14:].strip()}" if ctes else body
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}" if ctes else body
    return f"with {ctes}\n{body}" if ctes else body
