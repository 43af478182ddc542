"""Versioned tables of parts: what a change writes, who may commit, what expiry deletes."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from cairn.operators import snapshots as P
from cairn.operators.maintenance import deactivate, upsert_assets, with_fingerprint
from cairn.schema import ASSETS, as_assets
from cairn.streaming import ingest as I

NOW = "2024-06-01 00:00:00"


def assets(spark, names, size=1):
    name = F.explode(F.split(F.lit(" ".join(names)), " "))
    rows = spark.range(1).select(name.alias("name")).filter("name <> ''")
    facts = {"type": "t", "source": "s", "size": size}
    rows = rows.withColumns({k: F.lit(v) for k, v in facts.items()} | {"location": F.concat(F.lit("/"), "name")})
    return as_assets(with_fingerprint(rows.withColumn("created_date", F.lit("2024-01-01").cast("timestamp"))))


def files(root):
    return {
        os.path.relpath(os.path.join(d, f), root): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(root)
        for f in names
        if f.endswith(".parquet")
    }


def sizes(spark, root, version=None):
    return {r["name"]: r["size"] for r in P.read_snapshot(spark, root, version=version).collect()}


def upsert(spark, root, names, size):
    batch = assets(spark, names, size)
    return P.update_snapshot(batch, root, lambda current: upsert_assets(current, batch, NOW), ASSETS)


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "catalog")
    P.write_snapshot(assets(spark, [f"n{k}" for k in range(200)]), path, parts=8)
    return path


def test_a_change_writes_only_the_parts_of_its_keys(spark, root):
    before, old = files(root), P.load_manifest(spark, root)
    assert len(old.folders) == 8
    upsert(spark, root, ["n3", "fresh"], 7)
    new, after = P.load_manifest(spark, root), files(root)
    touched = set(map(str, P.touched_parts(assets(spark, ["n3", "fresh"]), old)))
    assert 1 <= len(touched) <= 2
    assert {k for k in new.folders if new.folders[k] != old.folders[k]} == touched
    assert before.items() <= after.items()  # nothing that stood was touched
    assert {f.split("/")[2] for f in after.keys() - before.keys()} == {f"_part={k}" for k in touched}
    want = {f"n{k}": 1 for k in range(200)} | {"n3": 7, "fresh": 7}
    assert sizes(spark, root) == want and sizes(spark, root, 1) == {f"n{k}": 1 for k in range(200)}


def test_a_change_reads_only_the_parts_of_its_keys(spark, root):
    seen = []

    def change(current):
        seen.append({f.split("_part=")[1].split("/")[0] for f in current.inputFiles()})
        return current

    keys = assets(spark, ["n3"])
    P.update_snapshot(keys, root, change, ASSETS)
    assert seen == [set(map(str, P.touched_parts(keys, P.load_manifest(spark, root))))] and len(seen[0]) == 1
    found = P.find_in_snapshot(spark, root, keys.first()["fingerprint"])
    assert len({f.split("_part=")[1].split("/")[0] for f in found.inputFiles()}) == 1
    assert [r["name"] for r in found.collect()] == ["n3"]


def test_two_writers_cannot_commit_one_version(spark, root):
    base = P.load_manifest(spark, root)
    drafts = [P.replace(base, version=2, tag=f"writer {k}") for k in range(8)]
    won = []
    threads = [threading.Thread(target=lambda d=d: won.append((P._publish(spark, root, d), d.tag))) for d in drafts]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(w for w, _ in won) == [False] * 7 + [True]
    assert P.load_manifest(spark, root).tag == next(tag for w, tag in won if w)
    assert not [n for n in os.listdir(f"{root}/_manifests") if n.startswith(".") and not n.endswith(".crc")]


def test_a_slower_writer_keeps_what_the_faster_one_wrote(spark, root):
    old = P.load_manifest(spark, root)
    part = {f"n{k}": P.touched_parts(assets(spark, [f"n{k}"]), old)[0] for k in range(30)}
    a = "n0"
    same = next(n for n in part if n != a and part[n] == part[a])
    other = next(n for n in part if part[n] != part[a])
    for rival, calls in ((other, 1), (same, 2)):  # another part: rebased; the same part: asked again
        count = []
        batch = assets(spark, [a], 10)

        def change(current, rival=rival, batch=batch, count=count):
            if not count:
                upsert(spark, root, [rival], 20)
            count.append(1)
            return upsert_assets(current, batch, NOW)

        P.update_snapshot(batch, root, change, ASSETS)
        got = sizes(spark, root)
        assert (got[a], got[rival], len(count), len(got)) == (10, 20, calls, 200)


def test_lost_parts_of_a_whole_write_are_a_conflict(spark, root):
    base = P.load_manifest(spark, root)
    upsert(spark, root, ["n1"], 2)
    with pytest.raises(P.Conflict):
        P._commit(spark, root, base, base, dict.fromkeys(base.folders), "late", {})
    with pytest.raises(P.Conflict):
        P._commit(spark, root, base, P.replace(base, parts=4), {"0": None}, "cut anew", {})
    with pytest.raises(P.Conflict):
        P._commit(spark, root, None, base, {}, "made twice", {})


def test_expiry_deletes_what_no_kept_version_names(spark, root):
    for k in range(4):
        upsert(spark, root, [f"n{k}"], 100 + k)
    want = sizes(spark, root)
    before = files(root)
    gone = P.expire_snapshots(spark, root, keep=2)
    assert P.manifest_versions(spark, root) == [4, 5] and sizes(spark, root) == want
    kept = {(w, k) for v in (4, 5) for k, w in P.load_manifest(spark, root, v).folders.items()}
    assert {tuple(f.split("/")[1:3]) for f in files(root)} == {(w, f"_part={k}") for w, k in kept}
    assert gone == len({tuple(f.split("/")[1:3]) for f in before}) - len(kept) > 0
    assert P.expire_snapshots(spark, root, keep=2) == 0
    assert upsert(spark, root, ["n9"], 5) == 6


def test_parts_without_rows_and_a_new_cut(spark, root):
    keys = assets(spark, ["n5"])
    P.update_snapshot(keys, root, lambda current: current.filter("false"), ASSETS)
    assert len(P.load_manifest(spark, root).folders) == 7
    left = sizes(spark, root)
    upsert(spark, root, ["n5"], 3)
    assert sizes(spark, root) == left | {"n5": 3} and len(P.load_manifest(spark, root).folders) == 8
    P.write_snapshot(P.read_snapshot(spark, root), root, parts=3)
    assert len(P.load_manifest(spark, root).folders) == 3 and sizes(spark, root) == left | {"n5": 3}
    gone = assets(spark, ["n5", "unknown"]).select("fingerprint")
    P.update_snapshot(gone, root, lambda current: deactivate(current, gone, NOW)[0], ASSETS)
    assert [r["name"] for r in P.read_snapshot(spark, root).filter("not is_active").collect()] == ["n5"]
    version = P.load_manifest(spark, root).version
    assert P.update_snapshot(keys.filter("false"), root, lambda c: c, ASSETS) == version


def test_tables_without_rows_or_fingerprint(spark, tmp_path):
    root = str(tmp_path / "t")
    assert P.load_manifest(spark, root) is None and P.read_snapshot(spark, root) is None
    P.write_snapshot(spark.range(0), root)
    assert P.read_snapshot(spark, root).count() == 0
    rows = spark.range(50).withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    P.write_snapshot(rows, root)
    assert P.read_snapshot(spark, root).count() == 50 and P.load_manifest(spark, root).key == ["id"]


def test_a_batch_of_a_stream_touches_its_parts_only(spark, tmp_path):
    root = str(tmp_path / "cat")
    events = lambda names, size: assets(spark, names, size).withColumn("seq", F.lit(1)).drop("fingerprint")
    I.upsert_batch(events([f"n{k}" for k in range(100)], 1), 0, root, "seq", NOW, parts=8)
    before, old = files(f"{root}/assets"), P.load_manifest(spark, f"{root}/assets")
    for _ in range(2):  # a replay of the batch changes nothing
        I.upsert_batch(events(["n1"], 2), 1, root, "seq", NOW)
    new = P.load_manifest(spark, f"{root}/assets")
    assert new.version == 2 and new.done == {"main": 1}
    assert sum(new.folders[k] != old.folders[k] for k in new.folders) == 1
    assert before.items() <= files(f"{root}/assets").items()
    assert I.stream_history(spark, root).count() == 101
    I.upsert_batch(events([], 2), 2, root, "seq", NOW)
    assert P.load_manifest(spark, f"{root}/assets").done == {"main": 2} and I.stream_history(spark, root).count() == 101


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    root, key = str(tmp_path / "wide"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "20k")
    try:
        rows = spark.range(0, 20000, 1, 6).select(F.md5(F.col("id").cast("string")).alias("fingerprint"), "id")
        P.write_snapshot(rows, root, parts=2)
        P.update_snapshot(rows, root, lambda current: current.withColumn("id", F.col("id") + 1), rows.schema)
    finally:
        spark.conf.set(key, old)
    stored = P.read_snapshot(spark, root)
    per_part = {}
    for f in stored.inputFiles():
        per_part.setdefault(f.split("_part=")[1].split("/")[0], []).append(f)
    assert set(per_part) == {"0", "1"} and all(len(fs) > 1 for fs in per_part.values())
    for f in stored.inputFiles():
        held = [r[0] for r in spark.read.parquet(f).collect()]
        assert held == sorted(held)
    assert sorted(r["id"] for r in stored.collect()) == list(range(1, 20001))
    assert P.find_in_snapshot(spark, root, rows.first()["fingerprint"]).first()["id"] == 1


def nodes(plan, out):
    out.append(plan)
    for k in range(plan.children().size()):
        nodes(plan.children().apply(k), out)
    return out


def test_an_upsert_in_order_gives_the_rows_of_the_join(spark, tmp_path):
    one = assets(spark, [f"n{k}" for k in range(60)])
    twice = one.filter("name in ('n3', 'n4', 'n50')").withColumn("created_date", F.lit("2023-01-01").cast("timestamp"))
    no_key = one.filter("name = 'n9'").withColumn("fingerprint", F.lit(None).cast("string"))
    now = F.lit("2024-02-02").cast("timestamp")
    stood = one.unionByName(twice).unionByName(no_key).withColumn("discovered_date", now).withColumn("is_active", F.col("name") != "n7")
    stood = stood.withColumn("created_date", F.when(F.col("name") != "n5", F.col("created_date")))
    seen = assets(spark, [f"n{k}" for k in range(40, 80)] + ["n3", "n5", "n7"], 9)
    batch = seen.unionByName(seen.filter("name in ('n3', 'n55', 'n70')").withColumn("size", F.lit(10).cast("bigint"))).unionByName(no_key)
    part = F.pmod(F.xxhash64("fingerprint"), F.lit(4)).cast("int")
    ordered, joined = upsert_assets(stood, batch, NOW, part), upsert_assets(stood, batch, NOW)
    assert ordered.columns == [*joined.columns, "_part"]
    text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*joined.columns))).collect())
    assert text(ordered) == text(joined)
    assert joined.filter("name = 'n3'").count() == 4 and joined.filter("fingerprint is null").count() == 2
    root = str(tmp_path / "t")
    P.write_snapshot(stood, root, parts=4)
    P.update_snapshot(batch, root, lambda current, part: upsert_assets(current, batch, NOW, part), ASSETS, in_order=True)
    stored = P.read_snapshot(spark, root)
    assert text(stored) == text(joined)
    for f in stored.inputFiles():
        held = [r[0] or "" for r in spark.read.parquet(f).select("fingerprint").collect()]
        assert held == sorted(held)
    found = P.find_in_snapshot(spark, root, one.filter("name = 'n1'").first()["fingerprint"])
    assert [r["name"] for r in found.collect()] == ["n1"]


def test_an_upsert_in_order_moves_its_rows_once(spark, root, monkeypatch):
    batch, written = assets(spark, ["n3", "fresh"], 7), []
    write = P._write_parts
    monkeypatch.setattr(P, "_write_parts", lambda rows, *a: write(written.append(rows) or rows, *a))
    P.update_snapshot(batch, root, lambda current, part: upsert_assets(current, batch, NOW, part), ASSETS, in_order=True)
    assert sizes(spark, root) == {f"n{k}": 1 for k in range(200)} | {"n3": 7, "fresh": 7}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = written[0].select("*")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [n.getClass().getSimpleName() for n in nodes(plan, [])].count("ShuffleExchangeExec") == 1
    assert "_part" in written[0].columns  # so that they are not dealt again
