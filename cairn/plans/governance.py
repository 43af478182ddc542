"""Queries: personal data, quality, business metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import rules
from cairn.operators import enrichment as E
from cairn.operators import governance as G
from cairn.operators import pii as P
from cairn.operators import quality as DQ
from cairn.plans.classification import any_of
from cairn.plans.fixtures import AS_OF
from cairn.plans.maintenance import sql_ts, ts
from cairn.plans.registry import query
from cairn.plans.search import _categories_sql
from cairn.schema import columns_long

COL = "lower(column_name)"


def sql_case(cases: list[tuple[str, str]], default: str) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in cases) + f" else {default} end"


def join(c):
    return F.array_join(c, ",")


# --- personal data ----------------------------------------------------------------


@query(
    "pii1_column_categories",
    f"select fingerprint, ordinal, column_name, unnest({_categories_sql()}) as category from columns_long",
    ["columns_long"],
)
def _(i):
    return P.column_categories(columns_long(i.catalog()))


_RISKS = " union all ".join(
    f"select fingerprint, ordinal, column_name, '{kind}' as pii_type, '{risk}' as risk, "
    f"'{risk.lower()}-risk-{kind}' as tag from columns_long where {any_of(COL, words)}"
    for risk, kind, words in rules.PII_RISKS
)


@query("pii2_findings", _RISKS, ["columns_long"])
def _(i):
    return P.pii_findings(columns_long(i.catalog()))


PII_SUMMARY = f"""select c.fingerprint, cast(count(*) filter (risk = 'High') as integer) as high_risk_pii_count,
    cast(count(*) filter (risk = 'Medium') as integer) as medium_risk_pii_count,
    cast(count(*) filter (risk = 'Low') as integer) as low_risk_pii_count,
    case when count(*) filter (risk = 'High') > 0 then 'High' when count(*) filter (risk = 'Medium') > 0 then 'Medium'
      else 'Low' end as pii_risk,
    coalesce(string_agg(distinct tag, ',' order by tag), '') as pii_tags
  from catalog c left join ({_RISKS}) f on f.fingerprint = c.fingerprint group by c.fingerprint"""


@query("pii2_summary", PII_SUMMARY, ["columns_long"])
def _(i):
    return P.pii_summary(i.catalog()).withColumn("pii_tags", join("pii_tags"))


_SENSITIVE = " union all ".join(
    f"select fingerprint, ordinal, column_name, '{p}' as pattern from columns_long where regexp_matches({COL}, '^{p}')"
    for p in rules.SENSITIVE_COLUMN_PATTERNS
)


@query("pii3_sensitive_columns", _SENSITIVE, ["columns_long"])
def _(i):
    return P.sensitive_columns(columns_long(i.catalog()))


def _kinds_sql(value: str) -> str:
    return "array_to_string([x for x in [" + ", ".join(
        f"case when regexp_matches({value}, '(?i){p}') then '{k}' end" for k, p in rules.PII_VALUE_PATTERNS.items()
    ) + "] if x is not null], ',')"


@query(
    "pii4_types_in_documents",
    f"select doc_id, pii_types from (select doc_id, {_kinds_sql('text')} as pii_types from documents) where pii_types <> ''",
)
def _(i):
    return P.rows_with_pii(i.table("documents").select("doc_id", "text"), "text").select("doc_id", join("pii_types").alias("pii_types"))


_SCANNED = [("documents", "text"), ("conversations", "text"), ("pages", "html")]


@query(
    "pii5_scan",
    " union all ".join(
        f"select '{t}' as table_name, '{c}' as column_name, '{k}' as pii_type, "
        f"cast(sum(len(regexp_extract_all({c}, '(?i){p}'))) as bigint) as matches, "
        f"count(*) filter (regexp_matches({c}, '(?i){p}')) as rows_hit from {t}"
        for t, c in _SCANNED
        for k, p in rules.PII_VALUE_PATTERNS.items()
    ),
)
def _(i):
    out = None
    for t, c in _SCANNED:
        found = P.pii_scan(i.table(t).select(c), [c]).withColumn("table_name", F.lit(t))
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "pii6_privacy_risk",
    f"""with s as (select fingerprint, count(*) as n from ({_SENSITIVE}) group by fingerprint),
          t as (select c.fingerprint, {_kinds_sql("name || ' ' || location")} as pii_types, coalesce(n, 0) as n
                from catalog c left join s on s.fingerprint = c.fingerprint),
          k as (select *, case when pii_types = '' then 0 else len(string_split(pii_types, ',')) end as types from t)
        select fingerprint, pii_types, cast(n as integer) as sensitive_entries,
          case when types = 0 and n = 0 then null when types > 2 or n > 3 then 'high' when types > 0 or n > 1 then 'medium'
            else 'low' end as privacy_risk from k""",
    ["columns_long"],
)
def _(i):
    return P.asset_privacy(i.catalog()).withColumn("pii_types", join("pii_types"))


def _redact_sql(c: str) -> str:
    for k in ["email", "credit_card", "ip_address", "ssn", "phone"]:
        c = f"regexp_replace({c}, '(?i){rules.PII_VALUE_PATTERNS[k]}', '[{k}]', 'g')"
    return c


@query("pii7_redact", f"select doc_id, md5({_redact_sql('text')}) as digest, lang from documents")
def _(i):
    return P.redact_columns(i.table("documents").select("doc_id", "text", "lang"), ["text"]).select("doc_id", F.md5("text").alias("digest"), "lang")


# --- quality ------------------------------------------------------------------------

_AGE = f"floor((epoch_us(timestamp '{AS_OF}') - epoch_us(modified_date)) / 86400000000.0)"


@query(
    "dq1_quality_metrics",
    f"""select *, round((completeness_score + freshness_score + consistency_score + accuracy_score) / 4, 6) as overall_quality_score
        from (select fingerprint, cast(0.8 as double) as completeness_score,
          cast({sql_case([(f"{_AGE} < {d}", str(s)) for d, s in rules.FRESHNESS_STEPS], "0.3")} as double) as freshness_score,
          cast(case when regexp_matches(name, '^[a-zA-Z][a-zA-Z0-9_]*$') then 0.8 else 0.6 end as double) as consistency_score,
          cast(0 as double) as accuracy_score from catalog)""",
    ["catalog"],
)
def _(i):
    return DQ.quality_metrics(i.catalog(), AS_OF)


_GLOSSARY = any_of(COL, [w for g in rules.GLOSSARY_WORDS for w in g])
_TAGS = "[x for x in [" + ", ".join(
    f"case when bool_or(contains({COL}, '{w}')) then '{t}' end" for w, t in rules.SCHEMA_TAGS
) + "] if x is not null]"
SCHEMA = f"""select fingerprint, cast(count(*) as integer) as total_fields,
    cast(count(*) filter (trim(coalesce(description, '')) <> '') as integer) as fields_with_descriptions,
    round(count(*) filter (trim(coalesce(description, '')) <> '') * 100.0 / count(*), 4) as completeness,
    cast(least(100, greatest(60, floor(count(*) filter (trim(coalesce(description, '')) <> '') * 100.0 / count(*)))) as integer)
      as data_quality_score,
    coalesce(string_agg(column_name, ',' order by ordinal) filter ({_GLOSSARY}), '') as business_terms,
    array_to_string({_TAGS}, ',') as schema_tags
  from columns_long group by fingerprint"""


_TYPES = """select fingerprint, string_agg(t || '=' || n, ',' order by t) as field_types from (
    select fingerprint, coalesce(column_type, 'unknown') as t, count(*) as n from columns_long group by 1, 2) group by 1"""


@query(
    "dq2_schema_analysis",
    f"select s.*, field_types from ({SCHEMA}) s join ({_TYPES}) t on t.fingerprint = s.fingerprint",
    ["columns_long"],
)
def _(i):
    pairs = F.transform("field_types", lambda x: F.concat_ws("=", x["type"], x["fields"].cast("string")))
    return DQ.schema_analysis(i.catalog()).withColumns(
        {"business_terms": join("business_terms"), "schema_tags": join("schema_tags"), "field_types": join(pairs)}
    )


@query(
    "dq3_quality_label",
    """select fingerprint, case when row_id % 4 = 0 then 'Low' when row_id % 3 = 0 then 'Medium' else 'High' end as label
       from catalog""",
    ["catalog"],
)
def _(i):
    columns = F.when(F.col("row_id") % 4 != 0, F.col("columns"))
    metadata = F.when(F.col("row_id") % 3 != 0, F.col("metadata"))
    return i.catalog().select("fingerprint", DQ.quality_label(columns, metadata).alias("label"))


@query(
    "dq4_maintainability",
    """with n as (select source_asset as fingerprint, count(*) as edges from
                    (select source_asset from asset_rel union all select target_asset from asset_rel) group by 1),
         p as (select c.fingerprint, coalesce(edges, 0) as edges, case when coalesce(description, '') <> '' then 50 else 0 end
                 + case when coalesce(edges, 0) <= 5 then 30 else 0 end + 20 as points
               from catalog c left join n on n.fingerprint = c.fingerprint)
       select fingerprint, edges, case when points >= 80 then 'High' when points >= 60 then 'Medium' else 'Low' end
         as maintainability from p""",
    ["asset_rel"],
)
def _(i):
    rel = i.asset_relationships()
    ends = rel.select(F.col("source_asset").alias("target_id")).unionAll(
        rel.select(F.col("target_asset").alias("target_id"))
    )
    return DQ.maintainability(i.catalog(), ends)


@query(
    "dq5_parse_analysis",
    """select event_id, case when value < 2 then 'AI analysis completed but response format was invalid' else event_type end as summary,
         cast(case when value < 2 then 50 when value < 10 then 75 else least(100, greatest(0, user_id * 3 - 40)) end as double) as quality_score,
         case when value < 2 then 'Response parsing failed' else '' end as issues
       from events""",
)
def _(i):
    e = i.table("events")
    score = F.col("user_id") * 3 - 40
    body = F.when(
        F.col("value") < 10, F.to_json(F.struct(F.col("event_type").alias("summary")))
    ).otherwise(F.to_json(F.struct(F.col("event_type").alias("summary"), score.alias("quality_score"))))
    answer = F.when(F.col("value") < 2, "sorry, no answer").otherwise(
        F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    )
    return DQ.parse_analysis(e.select("event_id", answer.alias("answer"))).select(
        "event_id", "summary", "quality_score", join("issues").alias("issues")
    )


@query(
    "dq5_parse_pii_scan",
    """select event_id, case when value < 2 then 0 else user_id end as pii_fields_count,
         case when value < 2 then 12 when value < 10 then 12 else event_id end as total_fields_scanned,
         case when value < 2 then 'UNKNOWN' when value < 10 then 'LOW' else 'HIGH' end as risk_level
       from events""",
)
def _(i):
    e = i.table("events")
    short = F.to_json(F.struct(F.col("user_id").alias("pii_fields_count")))
    full = F.to_json(
        F.struct(
            F.col("user_id").alias("pii_fields_count"),
            F.col("event_id").alias("total_fields_scanned"),
            F.lit("HIGH").alias("risk_level"),
        )
    )
    answer = F.when(F.col("value") < 2, "{broken").when(F.col("value") < 10, short).otherwise(full)
    return DQ.parse_pii_scan(e.select("event_id", answer.alias("answer"), F.lit(12).alias("field_count"))).select(
        "event_id", "pii_fields_count", "total_fields_scanned", "risk_level"
    )


# --- business metadata ------------------------------------------------------------------

_BOTH = "lower(name || ' ' || location)"
_SIMPLE = sql_case([(any_of(_BOTH, w), f"'{d}'") for d, w in rules.SIMPLE_DOMAINS], "'unknown'")


@query("gov1_simple_domain", f"select fingerprint, {_SIMPLE} as domain from catalog", ["catalog"])
def _(i):
    return i.catalog().select("fingerprint", G.simple_domain("name", "location").alias("domain"))


@query(
    "gov1_simple_domain_mixed",
    f"select origin, row_id, {_SIMPLE} as domain from mixed",
    ["mixed"],
)
def _(i):
    return i.projection("mixed").select("origin", "row_id", G.simple_domain("name", "location").alias("domain"))


@query(
    "gov2_importance",
    f"""select fingerprint, case when {_SIMPLE} in ('finance', 'hr') or size > 1000000 then 'high'
          when size > 100000 then 'medium' else 'low' end as importance from catalog""",
    ["catalog"],
)
def _(i):
    return i.catalog().select(
        "fingerprint", G.importance(G.simple_domain("name", "location"), "size").alias("importance")
    )


_DOMAIN_ROWS = " union all ".join(
    "select {n} as idx, '{d}' as domain, [{w}] as words".format(n=n, d=d, w=", ".join(f"'{x}'" for x in w))
    for n, (d, w) in enumerate(rules.DOMAINS)
)
DOMAIN = f"""domains as ({_DOMAIN_ROWS}),
  by_name as (select fingerprint, idx, domain, len([w for w in words if contains(lower(name), w)]) as pts
              from catalog, domains where len([w for w in words if contains(lower(name), w)]) > 0),
  by_col as (select fingerprint, idx, domain, count(*) * 0.5 as pts, min(ordinal) as first
             from columns_long, domains where len([w for w in words if contains({COL}, w)]) > 0
             group by fingerprint, idx, domain),
  scored as (select coalesce(n.fingerprint, c.fingerprint) as fingerprint, coalesce(n.idx, c.idx) as idx,
               coalesce(n.domain, c.domain) as domain, coalesce(n.pts, 0) + coalesce(c.pts, 0) as score,
               case when n.pts is null then 1 else 0 end as late, case when n.pts is null then c.first else 0 end as first
             from by_name n full join by_col c on n.fingerprint = c.fingerprint and n.idx = c.idx),
  best as (select fingerprint, domain from (select *, row_number() over (partition by fingerprint
             order by score desc, late, first, idx) as rn from scored) where rn = 1),
  dom as (select c.fingerprint, coalesce(b.domain, 'General Business Data') as domain
          from catalog c left join best b on b.fingerprint = c.fingerprint)"""


@query(
    "gov3_business_domain",
    f"with {DOMAIN} select fingerprint, domain as business_domain from dom",
    ["columns_long"],
)
def _(i):
    return G.with_business_domain(i.catalog()).select("fingerprint", "business_domain")


_GROWN = "floor((epoch_us(modified_date) - epoch_us(created_date)) / 86400000000.0)"
VOLUME = f"""select c.fingerprint, case when size > 104857600 then 'Large' when size > 10485760 then 'Medium' else 'Small' end
      as size_category, size > 104857600 as is_large_dataset, size // (w.n * 50) as estimated_records,
    case when {_GROWN} <= 0 then 'Unknown' when {_GROWN} < 30 then 'High' when {_GROWN} < 90 then 'Medium' else 'Low' end
      as growth_rate
  from catalog c join (select fingerprint, count(*) as n from columns_long group by fingerprint) w using (fingerprint)"""


@query("gov4_volume_analysis", VOLUME, ["columns_long"])
def _(i):
    return G.volume_analysis(i.catalog())


_SCAN_AGE = f"floor((epoch_us(timestamp '{AS_OF}') - epoch_us(last_scanned)) / 86400000000.0)"
_HEAVY = any_of("lower(name)", rules.HEAVY_USE_WORDS)
USAGE = f"""select fingerprint, case when {_SCAN_AGE} < 1 then 'High' when {_SCAN_AGE} < 7 then 'Medium' else 'Low' end
      as usage_frequency, {_HEAVY} or {_SCAN_AGE} < 1 as is_highly_used,
    case when {_AGE} < 7 then 'Active' when {_AGE} < 30 then 'Regular' else 'Archive' end as access_pattern,
    case when {_HEAVY} then 'High' else 'Medium' end as business_criticality from catalog"""


@query("gov5_usage_patterns", USAGE, ["catalog"])
def _(i):
    return G.usage_patterns(i.catalog(), AS_OF)


COMPLIANCE = f"""select c.fingerprint,
    [x for x in [case when s.high_risk_pii_count > 0 then 'GDPR' end, case when s.high_risk_pii_count > 0 then 'CCPA' end,
      case when pci then 'PCI-DSS' end, case when {any_of("lower(name)", rules.HIPAA_WORDS)} then 'HIPAA' end,
      case when {any_of("lower(name)", rules.SOX_WORDS)} then 'SOX' end,
      case when {any_of("lower(name)", rules.SOX_WORDS)} then 'Basel III' end] if x is not null] as required,
    [x for x in [case when s.high_risk_pii_count > 0 then 'gdpr' end, case when s.high_risk_pii_count > 0 then 'ccpa' end,
      case when s.high_risk_pii_count > 0 then 'privacy' end, case when pci then 'pci-dss' end,
      case when {any_of("lower(name)", rules.HIPAA_WORDS)} then 'hipaa' end,
      case when {any_of("lower(name)", rules.SOX_WORDS)} then 'sox' end,
      case when {any_of("lower(name)", rules.SOX_WORDS)} then 'basel' end] if x is not null] as tags
  from catalog c join pii s using (fingerprint)
  join (select fingerprint, bool_or({any_of(COL, rules.PCI_WORDS)}) as pci from columns_long group by fingerprint) p
    using (fingerprint)"""


@query(
    "gov6_compliance",
    f"""with pii as ({PII_SUMMARY}), comp as ({COMPLIANCE})
        select fingerprint, array_to_string(required, ',') as required_compliance, array_to_string(tags, ',') as compliance_tags
        from comp""",
    ["columns_long"],
)
def _(i):
    a = P.with_pii_summary(i.catalog()).withColumns(G.compliance("name", "columns", "high_risk_pii_count"))
    return a.select(
        "fingerprint",
        join("required_compliance").alias("required_compliance"),
        join("compliance_tags").alias("compliance_tags"),
    )


def _classified(i):
    a = P.with_pii_summary(i.catalog()).withColumns(G.compliance("name", "columns", "high_risk_pii_count"))
    return a.withColumn("sensitivity_level", G.sensitivity("high_risk_pii_count", "medium_risk_pii_count"))


_CLASS = """case when pii_risk = 'High' then 'Confidential' when pii_risk = 'Medium' then 'Internal' else 'Public' end"""


@query(
    "gov7_sensitivity",
    f"""with pii as ({PII_SUMMARY})
        select fingerprint, pii_risk as sensitivity_level, {_CLASS} as data_classification from pii""",
    ["columns_long"],
)
def _(i):
    return _classified(i).select(
        "fingerprint",
        "sensitivity_level",
        G.classification("sensitivity_level", "required_compliance").alias("data_classification"),
    )


_ALL_TAGS = """array_to_string(list_sort(list_distinct([x for x in list_concat(string_split(sc.schema_tags, ','),
   string_split(p.pii_tags, ','), c.tags) if x <> ''])), ',')"""


@query(
    "gov8_business_tags",
    f"""with pii as ({PII_SUMMARY}), comp as ({COMPLIANCE}), sc as ({SCHEMA})
        select sc.fingerprint, {_ALL_TAGS} as business_tags from sc join pii p using (fingerprint) join comp c using (fingerprint)""",
    ["columns_long"],
)
def _(i):
    a = DQ.with_schema_analysis(_classified(i))
    return a.select(
        "fingerprint", join(G.business_tags("schema_tags", "pii_tags", "compliance_tags")).alias("business_tags")
    )


_POINTS = """case pii_risk when 'High' then 3 when 'Medium' then 2 else 1 end
   + case when is_large_dataset then 2 else 0 end + case when is_highly_used then 2 else 0 end"""
_CRITICAL = f"case when {_POINTS} >= 5 then 'High' when {_POINTS} >= 3 then 'Medium' else 'Low' end"


@query(
    "gov9_criticality",
    f"""with pii as ({PII_SUMMARY}), vol as ({VOLUME}), usg as ({USAGE})
        select fingerprint, {_CRITICAL} as criticality from pii join vol using (fingerprint) join usg using (fingerprint)""",
    ["columns_long"],
)
def _(i):
    a = _classified(i)
    parts = {**G._volume(), **G._usage(AS_OF)}
    a = a.withColumns({k: parts[k] for k in ("is_large_dataset", "is_highly_used")})
    return a.select(
        "fingerprint", G.criticality("sensitivity_level", "is_large_dataset", "is_highly_used").alias("criticality")
    )


_RETAIN = sql_case([(f"domain = '{d}'", f"'{v}'") for d, v in rules.RETENTION.items()], f"'{rules.DEFAULT_RETENTION}'")
_PROCESS = sql_case(
    [(f"domain = '{d}'", f"'{','.join(v)}'") for d, v in rules.PROCESSES.items()],
    f"'{','.join(rules.DEFAULT_PROCESSES)}'",
)


@query(
    "gov10_domain_lookup",
    f"with {DOMAIN} select fingerprint, {_RETAIN} as retention_policy, {_PROCESS} as related_processes from dom",
    ["columns_long"],
)
def _(i):
    d = "business_domain"
    return G.with_business_domain(i.catalog()).select(
        "fingerprint",
        G.retention_policy(d).alias("retention_policy"),
        join(G.related_processes(d)).alias("related_processes"),
    )


_PURPOSE = """case when high_risk_pii_count > 0 then 'Data asset containing personal information for '
   when is_large_dataset then 'Large-scale data asset supporting ' else 'Data asset supporting ' end
   || lower(domain) || ' operations'"""


@query(
    "gov11_review_and_purpose",
    f"""with {DOMAIN}, pii as ({PII_SUMMARY}), vol as ({VOLUME})
        select fingerprint, {sql_ts("last_scanned")} as last_business_review, {_PURPOSE} as business_purpose
        from catalog join dom using (fingerprint) join pii using (fingerprint) join vol using (fingerprint)""",
    ["columns_long"],
)
def _(i):
    a = G.with_business_domain(P.with_pii_summary(i.catalog())).withColumn("large", G._volume()["is_large_dataset"])
    return a.select(
        "fingerprint",
        ts(G.last_review()).alias("last_business_review"),
        G.purpose("business_domain", "high_risk_pii_count", "large").alias("business_purpose"),
    )


@query(
    "gov12_business_metadata",
    f"""with {DOMAIN}, pii as ({PII_SUMMARY}), vol as ({VOLUME}), usg as ({USAGE}), comp as ({COMPLIANCE}), sc as ({SCHEMA})
        select fingerprint, domain as business_domain, {_CLASS} as data_classification, {_PURPOSE} as business_purpose,
          {_RETAIN} as retention_policy, pii_risk as sensitivity_level, array_to_string(c.required, ',') as compliance_requirements,
          {_ALL_TAGS} as business_tags, data_quality_score, usage_frequency, {_CRITICAL} as criticality,
          {sql_ts("last_scanned")} as last_business_review, business_terms as business_glossary_terms,
          {_PROCESS} as related_processes, size_category, growth_rate, estimated_records, access_pattern,
          'To be assigned' as business_owner, 'To be assigned' as data_steward, 'Available' as data_lineage_status
        from catalog join dom using (fingerprint) join pii p using (fingerprint) join vol using (fingerprint)
          join usg using (fingerprint) join comp c using (fingerprint) join sc using (fingerprint)""",
    ["columns_long"],
)
def _(i):
    m = G.business_metadata(i.catalog(), AS_OF)
    lists = ["compliance_requirements", "business_tags", "business_glossary_terms", "related_processes"]
    return m.drop("high_risk_pii_count", "medium_risk_pii_count", "low_risk_pii_count").withColumns(
        {**{c: join(c) for c in lists}, "last_business_review": ts("last_business_review")}
    )


# --- enrichment -----------------------------------------------------------------------

_HINTS = f"""array_to_string(list_concat(
    [w for w in {rules.HINT_WORDS} if contains(lower(name), w) or contains(lower(location), w)],
    case when {any_of("lower(location)", rules.ARCHIVE_WORDS)} then ['archived'] else [] end), ',')"""
_FREQUENCY = sql_case([(f"contains(lower(name), '{w}')", f"'{w}'") for w in rules.FREQUENCY_WORDS], "'unknown'")
_CLASS = sql_case([(any_of("lower(type)", words), f"'{label}'") for words, label in rules.DATA_CLASSES], "'unknown'")
_FORMAT = sql_case([(f"contains(lower(type), '{k}')", f"'{v}'") for k, v in rules.DATA_FORMATS], "'unknown'")
_VALUE = sql_case(
    [
        (any_of("lower(name || ' ' || location)", rules.HIGH_VALUE_WORDS), "'high'"),
        (any_of("lower(name || ' ' || location)", rules.MEDIUM_VALUE_WORDS) + " or size > 1000000", "'medium'"),
    ],
    "'low'",
)


@query(
    "enr1_extract_metadata",
    f"""with named as (select *, case when row_id % 2 = 0 then source || '_database' else source end as from_source from catalog),
      sensitive as (select fingerprint, string_agg(column_name, ',' order by ordinal) as listed, count(*) as n
                    from ({_SENSITIVE}) group by fingerprint),
      keyed as (select fingerprint, bool_or(ordinal = 1) as has_primary_key, count(*) as column_count,
                  bool_or(lower(column_name) like '%\\_id' escape '\\') as has_foreign_keys from columns_long group by fingerprint),
      facts as (select c.fingerprint, {_CLASS} as data_classification, {_VALUE} as estimated_value,
          case when contains(type, 'file') then regexp_extract(location, '^(.*)/[^/]*$', 1) end as file_directory,
          cast({sql_case([(f"{_AGE} < {d}", str(s)) for d, s in rules.FRESHNESS_STEPS], "0.3")} as double) as freshness_score,
          cast(case when regexp_matches(name, '^[a-zA-Z][a-zA-Z0-9_]*$') then 0.8 else 0.6 end as double) as consistency_score,
          {_kinds_sql("name || ' ' || location")} as pii_types, coalesce(listed, '') as sensitive_columns, coalesce(n, 0) as n,
          {_SIMPLE} as domain, size, {_FORMAT} as data_format,
          case when {any_of("lower(name)", rules.COMPRESSED_MARKS)} then 'compressed' end as compression,
          case when {any_of("lower(location)", rules.PARTITION_MARKS)} then 'partitioned' end as partitioning,
          case when contains(from_source, 'database') then num_rows end as row_count,
          case when contains(from_source, 'database') then cast(column_count as integer) end as column_count,
          case when contains(from_source, 'database') then has_primary_key end as has_primary_key,
          case when contains(from_source, 'database') then has_foreign_keys end as has_foreign_keys,
          {_HINTS} as transformation_hints, {_FREQUENCY} as update_frequency
        from named c join keyed k on k.fingerprint = c.fingerprint left join sensitive s on s.fingerprint = c.fingerprint),
      counted as (select *, case when pii_types = '' then 0 else len(string_split(pii_types, ',')) end as types from facts)
    select * exclude (n, types, size), round((0.8 + freshness_score + consistency_score) / 4, 6) as overall_quality_score,
      types + n > 0 as contains_pii,
      case when types > 2 or n > 3 then 'high' when types > 0 or n > 1 then 'medium' else 'low' end as privacy_risk_level,
      case when domain in ('finance', 'hr') or size > 1000000 then 'high' when size > 100000 then 'medium' else 'low' end
        as business_importance
    from counted""",
    ["columns_long"],
)
def _(i):
    assets = i.catalog().withColumn(
        "source", F.when(F.col("row_id") % 2 == 0, F.concat("source", F.lit("_database"))).otherwise(F.col("source"))
    )
    return E.extract_metadata(assets, AS_OF).select(
        "fingerprint",
        "data_classification",
        "estimated_value",
        F.col("file.directory").alias("file_directory"),
        "quality_metrics.freshness_score",
        "quality_metrics.consistency_score",
        "quality_metrics.overall_quality_score",
        "pii_detection.contains_pii",
        join("pii_detection.pii_types").alias("pii_types"),
        join("pii_detection.sensitive_columns").alias("sensitive_columns"),
        "pii_detection.privacy_risk_level",
        "business_context.domain",
        "business_context.business_importance",
        "technical_metadata.data_format",
        "technical_metadata.compression",
        "technical_metadata.partitioning",
        "table.row_count",
        "table.keys.column_count",
        "table.keys.has_primary_key",
        "table.keys.has_foreign_keys",
        join("lineage_hints.transformation_hints").alias("transformation_hints"),
        "lineage_hints.update_frequency",
    )
