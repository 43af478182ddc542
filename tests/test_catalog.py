"""Upserts, history, relationships, search and lineage against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairn import rules
from cairn.operators import column_lineage as CL
from cairn.operators import lineage as L
from cairn.operators import maintenance as M
from cairn.operators import search as Q
from cairn.operators import transformations as T
from cairn.schema import as_assets
from cairn.session import cut_lineage

NOW = datetime(2024, 6, 1)


def make(spark, rows):
    """rows: (name, type, source, location, size, days since scan)."""
    df = spark.createDataFrame(
        [(*r[:5], NOW - timedelta(days=r[5]), NOW - timedelta(days=100)) for r in rows],
        "name string, type string, source string, location string, size bigint, last_scanned timestamp, created_date timestamp",
    )
    return as_assets(M.with_fingerprint(df))


def test_fingerprint_treats_null_as_empty_and_keeps_a_carried_one(spark):
    df = spark.createDataFrame(
        [("a", None, "l", None), ("a", "", "l", None), ("a", None, "l", "mine")],
        "name string, source string, location string, fingerprint string",
    )
    got = [r["fingerprint"] for r in M.with_fingerprint(df).collect()]
    assert got[0] == got[1] and got[2] == "mine"


def test_dedupe_last_wins_first_created_stays(spark):
    rows = [("k", i, NOW + timedelta(days=i), f"n{i}") for i in range(500)] + [("z", 1, NOW, "only")]
    df = spark.createDataFrame(rows, "fingerprint string, seq int, created_date timestamp, name string").withColumns(
        {"type": F.lit("t"), "location": F.lit("l")}
    )
    out = {r["fingerprint"]: r for r in M.dedupe_batch(df, "seq").collect()}
    assert len(out) == 2 and out["k"]["name"] == "n499" and out["k"]["created_date"] == NOW


def test_upsert_is_idempotent_and_keeps_dates(spark):
    old = make(spark, [("a", "t", "s", "l", 1, 10), ("b", "t", "s", "l", 1, 10)])
    new = make(spark, [("a", "t", "s", "l", 9, 0), ("c", "t", "s", "l", 3, 0)])
    once = M.upsert_assets(old, new, F.lit(NOW))
    twice = M.upsert_assets(once, new, F.lit(NOW))
    key = lambda df: sorted((r["name"], r["size"], r["created_date"], r["discovered_date"], r["is_active"]) for r in df.collect())
    # c is discovered by the first run; a second run keeps that date
    assert key(once)[0][:2] == ("a", 9) and len(key(once)) == 3 and key(once) == key(twice)


def test_change_log_only_changed(spark):
    old = make(spark, [("a", "t", "s", "l", 1, 10), ("b", "t", "s", "l", 1, 10)])
    new = make(spark, [("a", "t", "s", "l", 1, 0), ("b", "t", "s", "l", 2, 0), ("c", "t", "s", "l", 2, 0)])
    assert M.change_log(old, new, F.lit(NOW)).count() == 3
    assert sorted(r["change_type"] for r in M.change_log(old, new, F.lit(NOW), True).collect()) == ["CREATED", "UPDATED"]


def test_relationship_upsert_takes_the_latest(spark):
    schema = "source_asset string, target_asset string, relationship_type string, confidence double, created_at timestamp"
    new = spark.createDataFrame(
        [("a", "b", "x", 0.1, NOW), ("a", "b", "x", 0.9, NOW + timedelta(days=1)), ("a", None, "x", 0.5, NOW)], schema
    )
    from cairn.schema import RELATIONSHIPS

    out = M.upsert_relationships(spark.createDataFrame([], RELATIONSHIPS), new).collect()
    assert [(r["id"], r["confidence"], r["description"], r["created_by"]) for r in out] == [("a-b-x", 0.9, "", "user")]


def test_search_wildcards_and_case(spark):
    a = make(spark, [("Sales_1", "t", "s", "x", 1, 1), ("sales%1", "t", "s", "x", 1, 2), ("ÄSALES\\", "t", "s", "x", 1, 3)])
    names = lambda q: sorted(r["name"] for r in Q.search_assets(a, q).collect())
    assert names("SALES_1") == ["Sales_1", "sales%1"]  # _ is a wildcard
    assert names("äsales") == []  # only ASCII case is folded
    assert names("sales\\") == ["ÄSALES\\"]


def levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_fuzzy_join_equals_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abc_") for _ in range(rnd.randint(1, 12)))
    terms, cands = [word() for _ in range(120)], [word().upper() for _ in range(150)]
    got = {tuple(r) for r in Q.fuzzy_join(
        spark.createDataFrame([(t,) for t in terms], "term string"),
        spark.createDataFrame([(c,) for c in cands], "candidate string"),
    ).collect()}
    want = set()
    for t in set(terms):
        for c in {c.lower() for c in cands}:
            d = levenshtein(t, c)
            if 0 < d <= len(t) // 3:
                want.add((t, c, d))
    assert got == want and len(want) > 50


def test_fuzzy_join_on_names_that_share_their_beginning(spark):
    rnd = random.Random(11)

    def damaged(name, edits):
        for _ in range(edits):
            at = rnd.randrange(len(name) + 1)
            name = rnd.choice([name[:at] + rnd.choice("ab_é") + name[at:], name[:at] + name[at + 1 :], name[at:] + name[:at][:-1]])
        return name

    terms = [f"customer_{rnd.choice(['order', 'orders', 'ab'])}_{k % 7}"[: rnd.randint(3, 18)] for k in range(60)] + ["aaaaaaaaa", None, ""]
    cands = [damaged(rnd.choice(terms[:60]), rnd.randint(0, 6)) for _ in range(400)] + ["aaaa", "a" * 12, "aaaaaabaaa", None, ""]
    got = {tuple(r) for r in Q.fuzzy_join(
        spark.createDataFrame([(t,) for t in terms], "term string"),
        spark.createDataFrame([(c,) for c in cands], "candidate string"),
    ).collect()}
    pairs = ((t, c, levenshtein(t, c)) for t in {*terms} - {None} for c in {*cands} - {None})
    want = {(t, c, d) for t, c, d in pairs if 0 < d <= len(t) // 3}
    assert got == want and len(want) > 500
    plan = Q.fuzzy_join(*[spark.range(9).select(F.col("id").cast("string").alias(n)) for n in ("term", "candidate")])
    keys = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(keys) == 1 and all(k in keys[0] for k in ("piece", "clen", "cpos"))


def test_fuzzy_suggest_only_without_direct_hits(spark):
    a = make(spark, [("customer", "table", "mysql", "x", 1, 1), ("orders", "view", "mysql", "x", 1, 2)])
    assert [tuple(r) for r in Q.fuzzy_suggest(a, "custmer").collect()] == [("customer", 1)]
    assert Q.fuzzy_suggest(a, "order").count() == 0


# --- lineage ---------------------------------------------------------------------


def random_assets(rnd, n):
    words = ["raw", "customer", "order", "mart", "agg", "dim", "p1", "ds.x", "x", "report", "base", "user"]
    out = []
    for k in range(n):
        name = rnd.choice(["", "_", "."]).join(rnd.sample(words, rnd.randint(1, 4)))
        if k == 0:
            name = ""
        if k == 1:
            name = "a..customer"
        out.append(
            (
                name,
                rnd.choice(["bigquery_table", "mysql_view", "bq_dataset", "csv_file"]),
                rnd.choice(["gcp_bigquery", "my_bigquery", "mysql", "files"]),
                rnd.choice(["/a", "/a/b", "/a/b/" + str(k), "", "/z" + str(k)]),
                1,
                k % 17,
            )
        )
    return list({(r[0], r[2], r[3]): r for r in out}.values())


def brute_score(t, o):
    """The scoring rule, restated plainly."""
    tn, on = t["name"].lower(), o["name"].lower()
    parts = set(tn.split(".")) if "." in tn else set()
    parts |= {w for w in rules.LINEAGE_WORDS if w in tn}
    s = 2 * (t["source"] == o["source"])
    if "bigquery" in t["source"] and "bigquery" in o["source"] and "." in tn and "." in on:
        if tn.split(".")[:2] == on.split(".")[:2]:
            s += 3
        elif tn.split(".")[0] == on.split(".")[0]:
            s += 2
    s += sum(p in on for p in parts)
    s += 2 * (tn in on or on in tn)
    s += bool(t["location"] and o["location"] and t["location"].lower() in o["location"].lower())
    return s


@pytest.fixture(scope="module")
def many(spark):
    return make(spark, random_assets(random.Random(5), 90)).cache()


def test_related_assets_equal_brute_force(spark, many):
    rows = [r.asDict() for r in many.collect()]
    want = {
        (t["fingerprint"], o["fingerprint"], brute_score(t, o))
        for t in rows
        for o in rows
        if t["fingerprint"] != o["fingerprint"] and brute_score(t, o) >= 2
    }
    got = L.related_assets(many, many).select("target_id", "id", "score").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def greedy(target, related, upstream, depth):
    """Levels by walking the sorted list level by level."""
    tn, tt = target["name"].lower(), target["type"].lower()
    used, out = set(), {}

    def eligible(o, level):
        n, k, s = o["name"].lower(), o["type"].lower(), o["score"]
        has = lambda text, words: any(w in text for w in words)
        if upstream:
            return (
                has(n, rules.UPSTREAM_WORDS)
                or ("dataset" in k and "table" in tt)
                or (has(tn, rules.UPSTREAM_TARGET_WORDS) and k == "bigquery_table")
                or (s >= 4 and level == 1)
            )
        return (
            has(n, rules.DOWNSTREAM_WORDS)
            or ("view" in k and "table" in tt)
            or (has(tn, rules.DOWNSTREAM_TARGET_WORDS) and k == "bigquery_table")
            or (has(n, rules.MODEL_WORDS) and s >= 3)
            or (s >= 3 and level == 1 and len(n) > len(tn))
        )

    for level in range(1, depth + 1):
        taken = 0
        for o in related:
            if taken < 3 and o["id"] not in used and eligible(o, level):
                used.add(o["id"])
                out[o["id"]] = -level if upstream else level
                taken += 1
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_levels_equal_the_greedy_walk(spark, many, depth):
    related = L.related_assets(many, many).cache()
    rows = [r.asDict() for r in related.collect()]
    targets = {r["fingerprint"]: r.asDict() for r in many.collect()}
    for upstream, fn in ((True, L.upstream_levels), (False, L.downstream_levels)):
        found = sorted(tuple(r) for r in fn(related, depth).select("target_id", "id", "level", "score").collect())
        leading = L.leading_assets(many, many, "upstream" if upstream else "downstream", depth)
        assert sorted(tuple(r) for r in fn(leading, depth).select("target_id", "id", "level", "score").collect()) == found
        got = {}
        for target_id, other, level, _ in found:
            got.setdefault(target_id, {})[other] = level
        for tid, t in targets.items():
            mine = sorted(
                (r for r in rows if r["target_id"] == tid),
                key=lambda r: (-r["score"], -r["last_scanned"].timestamp(), r["id"]),
            )
            assert got.get(tid, {}) == greedy(t, mine, upstream, depth)


def test_levels_of_a_thousand_targets_on_a_hot_source(spark):
    word = ["raw_customer", "agg_order", "mart_customer", "base_user", "report_order", "dim_product", "misc"]
    rows = spark.range(2000).select(
        F.concat(F.element_at(F.array(*map(F.lit, word)), (F.col("id") % 7 + 1).cast("int")), F.lit("_"), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") % 3 == 0, "mysql_view").otherwise("mysql_table").alias("type"),
        F.when(F.col("id") % 10 == 9, "other").otherwise("hot").alias("source"),
        F.concat(F.lit("/w/"), (F.col("id") % 50).cast("string")).alias("location"),
        F.lit(1).alias("size"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 90 * 86400).alias("last_scanned"),
    )
    assets = as_assets(M.with_fingerprint(rows))
    targets = assets.filter("cast(regexp_extract(name, '[0-9]+$', 0) as int) < 1000")
    leading = L.leading_assets(targets, assets)
    levels = L.lineage_levels(leading)
    plan = levels._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    got = {}
    for r in levels.select("target_id", "direction", "id", "level").collect():
        got.setdefault((r["target_id"], r["direction"]), {})[r["id"]] = r["level"]
    assert len({t for t, _ in got}) == 1000
    every = [r.asDict() for r in assets.collect()]
    for t in [r for r in every if r["name"].endswith(("_7", "_501", "_994", "_999"))][:6]:
        related = [{**o, "id": o["fingerprint"], "score": brute_score(t, o)} for o in every if o["fingerprint"] != t["fingerprint"]]
        related = sorted((o for o in related if o["score"] >= 2), key=lambda o: (-o["score"], -o["last_scanned"].timestamp(), o["id"]))
        for upstream in (True, False) if int(t["name"].rsplit("_", 1)[1]) < 1000 else ():
            side = "upstream" if upstream else "downstream"
            assert got.get((t["fingerprint"], side), {}) == greedy(t, related, upstream, 3)


def brute_confidence(a, a_type, b, b_type):
    """The matching rule, restated plainly."""
    x, y = (a or "").lower(), (b or "").lower()
    if x == y:
        return 0.95
    ids = x.endswith("_id") and y.endswith("_id") and x.split("_")[0] == y.split("_")[0]
    if x in y or y in x or x.replace("_", "") == y.replace("_", "") or ids:
        return 0.8
    topic = lambda n: any(w in n for w in rules.COLUMN_TOPIC_WORDS)
    return 0.6 if (a_type or "STRING") == (b_type or "STRING") and len(x) > 2 and topic(x) and topic(y) else 0.0


def test_column_edges_meet_every_partner(spark):
    rnd = random.Random(11)
    words = ["customer", "order", "id", "User", "name", "cu", "account", "a_b", "ab", "date"]
    name = lambda: "_".join(rnd.sample(words, rnd.randint(1, 3))) + rnd.choice(["", "", "_id"])
    column = lambda k: (k, rnd.choice([None, "", name(), name(), name(), "id"]), rnd.choice([None, "STRING", "int"]))
    rows = [
        (f"f{k:02d}", f"asset{'x' * (k % 5)}", k % 7 != 0, NOW, [column(c) for c in range(rnd.randint(0, 4))]) for k in range(40)
    ]
    schema = (
        "fingerprint string, name string, is_active boolean, last_scanned timestamp, "
        "columns array<struct<ordinal:int,name:string,type:string>>"
    )
    assets = spark.createDataFrame(rows, schema)
    want = sorted(
        (t[0], a[0], o[0], b[1] or "", brute_confidence(a[1], a[2], b[1], b[2]))
        for t in rows[:10]
        for o in rows
        for a in t[4]
        for b in o[4]
        if o[2] and t[0] != o[0] and brute_confidence(a[1], a[2], b[1], b[2]) > 0.5
    )
    key = lambda r: (r["target_id"], r["ordinal"], r["other_id"], r["other_column"] or "", r["confidence"])
    got = sorted(map(key, CL.column_edges(assets.limit(10), assets).collect()))
    assert got == want and {r[4] for r in want} == {0.95, 0.8, 0.6}
    newest = [r[0] for r in rows if r[2] and r[4]]  # all scanned at one time, so by id
    few = sorted(map(key, CL.column_edges(assets.limit(10), assets, limit=5).collect()))
    assert few == [r for r in want if r[2] in [n for n in newest if n != r[0]][:5]]


def test_declared_node_replaces_a_guess(spark):
    a = make(spark, [("raw_x", "csv_table", "s", "/1", 1, 1), ("mart_x", "csv_table", "s", "/2", 1, 2)])
    ids = {r["name"]: r["fingerprint"] for r in a.collect()}
    rel = spark.createDataFrame(
        [("1", ids["raw_x"], ids["mart_x"], "derived_from", 0.5, "", "u", NOW), ("2", "ghost", ids["mart_x"], "x", 0.5, "", "u", NOW)],
        "id string, source_asset string, target_asset string, relationship_type string, confidence double, "
        "description string, created_by string, created_at timestamp",
    )
    nodes, edges = L.lineage_graph(a.filter("name = 'mart_x'"), a, rel)
    up = [(r["name"], r["level"], r["custom"]) for r in nodes.filter("level < 0").collect()]
    assert up == [("raw_x", -1, True)]
    assert sorted(r["relationship"] for r in edges.filter("sink_id = target_id").collect()) == ["derived_from", "feeds_into"]
    text = T.edge_transformations(nodes, edges).first()["description"]
    assert text == "mart_x is derived from raw_x through data transformation"


def test_trace_survives_cycles_and_diamonds(spark):
    rel = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "d"), ("d", "e")], "source_asset string, target_asset string"
    )
    start = spark.createDataFrame([("a",)], "id string")
    got = {(r["id"], r["level"]) for r in L.trace(rel, start, "downstream", 10).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    up = {(r["id"], r["level"]) for r in L.trace(rel, start, "upstream", 10).collect()}
    assert up == {("a", 0), ("c", -1), ("b", -2)}


def test_trace_over_hubs_equals_search_by_hand(spark, monkeypatch):
    monkeypatch.setattr(L, "HUB", 20)
    rnd = random.Random(5)
    # one node holds a third of all links, some repeat, some have no node at one end
    links = [("hub", f"n{rnd.randrange(300)}") for _ in range(300)] + [(f"n{rnd.randrange(300)}", "hub2") for _ in range(150)]
    links += [(f"n{rnd.randrange(300)}", f"n{rnd.randrange(300)}") for _ in range(450)] + [(None, "n1"), ("n2", None), ("hub", "hub")]
    rel = spark.createDataFrame(links, "source_asset string, target_asset string")
    roots = ["hub", "n1", "n5", "nowhere"]
    got = {tuple(r) for r in L.trace(rel, spark.createDataFrame([(r,) for r in [*roots, "n1"]], "id string")).collect()}
    want = set()
    for sign, pairs in ((1, links), (-1, [(b, a) for a, b in links])):
        for root in roots:
            level, edge = {root: 0}, {root}
            for step in (1, 2, 3):
                edge = {b for a, b in pairs if a in edge and None not in (a, b) and b not in level}
                level |= dict.fromkeys(edge, sign * step)
            want |= {(root, k, v) for k, v in level.items()}
    assert got == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cairn_links")]


def test_a_hop_moves_the_frontier_and_not_the_links(spark, monkeypatch):
    monkeypatch.setattr(L, "HUB", 50)
    pairs = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("n"), F.col("id") % 40)).alias("id"),
        F.concat(F.lit("m"), "id").alias("next"),
    )
    seed = spark.createDataFrame([("r", "hub"), ("r", "n1")], "root_id string, id string")
    table, seed = L._adjacency(pairs, seed)
    seed = cut_lineage(seed)
    assert {r["id"]: r["slices"] for r in seed.collect()} == {"hub": 14, "n1": 1}
    biggest = spark.table(table).groupBy("id", "slice").count().agg(F.max("count")).first()[0]
    assert biggest < 4 * 50
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = L._hop(seed, spark.table(table))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"drop table {table}")
    scan = next(x for x in plan.splitlines() if "cairn_links" in x)
    assert "Bucketed: true" in scan
    # one exchange for the frontier's side, one for distinct; the side of the links has none
    assert plan.count("Exchange hashpartitioning(id") == 1


def hub(spark, n):
    """A graph whose one target has n upstream nodes."""
    nodes = [("t", "t", "agg_total", "v", 0)] + [("t", f"u{i:03d}", f"up{i:03d}", "table", -1) for i in range(n)]
    return spark.createDataFrame(nodes, "target_id string, id string, name string, type string, level int")


def test_name_lists_of_a_hot_target_are_split(spark, monkeypatch):
    whole = T.pattern_transformations(hub(spark, 40)).collect()
    assert len(whole) == 1 and whole[0]["source"] == ", ".join(f"up{i:03d}" for i in range(40))
    monkeypatch.setattr(T, "NAMES_PER_LIST", 10)
    parts = T.pattern_transformations(hub(spark, 40)).collect()
    assert 1 < len(parts) <= 4
    assert sorted(n for r in parts for n in r["source"].split(", ")) == [f"up{i:03d}" for i in range(40)]


def test_complexity_and_counts(spark):
    from cairn.operators.stats import lineage_counts

    nodes = hub(spark, 2)
    edges = spark.createDataFrame([("t",)] * 9, "target_id string")
    got = T.lineage_complexity(nodes, edges).first()
    assert (got["nodes"], got["edges"], got["cyclomatic"], got["complexity"], got["performance"]) == (3, 9, "High", "High", "High")
    assert lineage_counts(nodes).first()["upstream"] == 2


def test_recommendation_defaults(spark):
    targets = spark.createDataFrame(
        [("t", "file", [(1,)], {"a": "1", "b": "2", "c": "3"})],
        "fingerprint string, type string, columns array<struct<ordinal:int>>, metadata map<string,string>",
    )
    out = T.lineage_recommendations(targets, hub(spark, 1)).orderBy("position").collect()
    assert [r["severity"] for r in out] == ["success", "info"]
    out = T.lineage_recommendations(targets.withColumn("type", F.lit("view table")), hub(spark, 6)).orderBy("position").collect()
    assert [r["severity"] for r in out] == ["warning", "success", "info"]


@pytest.mark.parametrize("same_moment", [True, False])
def test_one_source_and_day_with_nearly_all_assets_is_ranked_in_many_tasks(spark, monkeypatch, same_moment):
    n, written = 4000, []
    moment = F.lit(1_700_000_000) + (F.lit(0) if same_moment else F.col("id") % 997)
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, "cold").alias("source"),
        F.when(F.col("id") % 50 != 7, F.timestamp_seconds(moment)).alias("last_scanned"),
        F.md5(F.col("id").cast("string")).alias("fingerprint"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"),
        (F.col("id") != 3).alias("is_active"),
    )

    def watched(df):
        written.append(cut_lineage(df))
        return written[-1]

    monkeypatch.setattr(Q, "cut_lineage", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = Q.assets_by_source_grouped(rows).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    groups = {}
    for r in rows.filter("is_active").collect():
        at = r["last_scanned"].timestamp() if r["last_scanned"] else 0
        groups.setdefault(r["source"] or "unknown", []).append((at == 0, -at, r["fingerprint"], r["name"]))
    want = [(s, k, x[3]) for s, xs in groups.items() for k, x in enumerate(sorted(xs), 1)]
    assert sorted((r["source"], r["position"], r["name"]) for r in got) == sorted(want)
    sizes = [r["count"] for r in written[0].groupBy(F.shiftright("at", 33)).count().collect()]
    assert sum(sizes) == n - 1 and len(sizes) == 4 and max(sizes) < 0.4 * n
