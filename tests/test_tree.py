"""Listing in tasks, looks at a growing folder, keys kept for ever."""

import os

import pytest
from pyspark.sql import functions as F

from cairn.sources import files as S
from cairn.sources import tree
from cairn.streaming import seen


@pytest.fixture()
def forest(tmp_path):
    """Wide and deep folders, one that holds most files, an empty one, hidden names and a link back to the root."""
    top = tmp_path / "forest"
    for folder, n in [("", 1), ("hot", 700), ("a/b/c/d", 3), ("a b/ü=1", 2), ("_x=1", 1), ("_temporary", 2), (".git", 2)]:
        (top / folder).mkdir(parents=True, exist_ok=True)
        for k in range(n):
            (top / folder / f"f{k}.csv").write_text("x" * k)
    (top / "empty").mkdir()
    (top / "hot" / ".part.crc").write_text("zz")
    os.symlink(top, top / "a" / "loop")
    os.symlink(top / "gone", top / "a" / "broken")
    return top


def _walk(top):
    out = set()
    for folder, below, names in os.walk(top):
        below[:] = [d for d in below if tree._visible(d)]
        out |= {
            (f"file:{folder}/{n}", os.path.getsize(f"{folder}/{n}"))
            for n in names
            if tree._visible(n) and os.path.exists(f"{folder}/{n}")
        }
    return out


def test_names_and_sizes_are_those_of_the_file_system(spark, forest):
    found = [(r["location"], r["size"]) for r in tree.tree_files(spark, str(forest)).collect()]
    assert len(found) == len(set(found)) == 707
    assert set(found) == _walk(forest)


def test_same_rows_as_the_listing_of_spark(spark, forest):
    (forest / "a" / "loop").unlink()  # Spark follows links and would not end
    (forest / "a" / "broken").unlink()
    mine = {tuple(r) for r in tree.tree_files(spark, str(forest)).collect()}
    # Spark's reader passes over files without bytes
    assert {r for r in mine if r[1]} == {tuple(r) for r in S.scan_files(spark, str(forest)).collect()}
    assert sum(not r[1] for r in mine) == 5


def test_folders_of_a_level_are_listed_in_several_tasks(spark, tmp_path):
    for k in range(40):
        (tmp_path / "wide" / f"d{k}").mkdir(parents=True)
        (tmp_path / "wide" / f"d{k}" / "f.csv").write_text("x")

    def told(folder):
        for at, is_folder, size, when in tree.entries(folder):
            yield (at if is_folder else f"{at}#{os.getpid()}"), is_folder, size, when

    pids = {r["location"].split("#")[1] for r in tree.list_tree(spark, str(tmp_path / "wide"), list_folder=told).collect()}
    assert len(pids) > 1


def test_an_unreadable_folder_is_lost_alone(spark, forest):
    def picky(folder):
        if folder.endswith("/hot"):
            raise PermissionError("no entry")
        return tree.entries(folder)

    rows = tree.list_tree(spark, str(forest), list_folder=picky).collect()
    assert [(r["location"], r["error"]) for r in rows if r["error"]] == [(f"file:{forest}/hot", "PermissionError: no entry")]
    assert sum(not r["is_folder"] for r in rows) == 7


def test_roots_depth_and_filters(spark, forest):
    assert tree.tree_files(spark, str(forest / "nowhere")).count() == 0
    assert tree.tree_files(spark, str(forest / "empty")).count() == 0
    assert tree.tree_files(spark, [str(forest), f"file://{forest}", f"{forest}/"]).count() == 707
    assert tree.list_tree(spark, str(forest), max_depth=0).count() == 1
    assert tree.list_tree(spark, str(forest), hidden=True).filter("not is_folder").count() == 712
    assert tree.tree_files(spark, str(forest), exts=[".json"]).count() == 0


def test_a_growing_folder_is_read_exactly_once(spark, tmp_path):
    data, root = tmp_path / "in", str(tmp_path / "out")
    data.mkdir()
    assert seen.discovered(spark, root).count() == 0
    (data / "a.csv").write_text("1")
    seen.discover(spark, str(data), root)
    (data / "sub").mkdir()
    (data / "sub" / "b.csv").write_text("22")
    seen.discover(spark, str(data), root)
    seen.discover(spark, str(data), root)
    (data / "a.csv").write_text("333")
    os.utime(data / "a.csv", (2_000_000_000, 2_000_000_000))
    seen.discover(spark, str(data), root)
    told = sorted((r["batch"], r["location"].rsplit("/", 1)[1], r["size"]) for r in seen.discovered(spark, root).collect())
    assert told == [(0, "a.csv", 1), (1, "b.csv", 2), (3, "a.csv", 3)]


def _rows(spark, rows):
    return spark.createDataFrame(rows, "k string, at int, v string")


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "seen")
    write = lambda rows, n: seen.first_seen_batch(_rows(spark, rows), n, root, ["k"], ["at"])
    write([("a", 2, "late"), ("a", 1, "early"), (None, 1, "null")], 0)
    write([("a", 0, "known"), (None, 0, "known"), ("b", 1, None)], 1)
    write([("a", 0, "known"), (None, 0, "known"), ("b", 1, None)], 1)  # after a failure
    write([], 2)
    write([("b", 0, "known"), ("c", 1, "new")], 3)
    got = {(r["batch"], r["k"], r["v"]) for r in seen.first_seen(spark, root, "k string, at int, v string").collect()}
    assert got == {(0, "a", "early"), (0, None, "null"), (1, "b", None), (3, "c", "new")}


def test_half_written_keys_do_not_count(spark, tmp_path):
    root = str(tmp_path / "half")
    seen.first_seen_batch(_rows(spark, [("a", 1, "x")]), 0, root, ["k"], ["at"])
    seen.first_seen_batch(_rows(spark, [("b", 1, "y")]), 1, root, ["k"], ["at"])
    os.remove(f"{root}/keys/batch=1/_SUCCESS")
    schema = "k string, at int, v string"
    assert [r["k"] for r in seen.first_seen(spark, root, schema).collect()] == ["a"]
    seen.first_seen_batch(_rows(spark, [("a", 1, "x"), ("b", 1, "y")]), 1, root, ["k"], ["at"])
    assert sorted(r["k"] for r in seen.first_seen(spark, root, schema).collect()) == ["a", "b"]


def test_merged_keys_are_still_known(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "LOOSE", 3)
    root = str(tmp_path / "merged")
    for n in range(8):
        rows = [(f"k{j}", n, "x") for j in range(n + 1)]
        seen.first_seen_batch(_rows(spark, rows), n, root, ["k"], ["at"])
    merged, loose = seen._steps(spark, f"{root}/keys")
    assert merged >= 3 and len(loose) <= 4 and len(os.listdir(f"{root}/keys")) == len(loose) + 1
    got = sorted((r["batch"], r["k"]) for r in seen.first_seen(spark, root, "k string, at int, v string").collect())
    assert got == [(n, f"k{n}") for n in range(8)]


def test_a_stream_started_again_tells_nothing_twice(spark, tmp_path):
    data, root = str(tmp_path / "events"), str(tmp_path / "seen")
    schema = "k string, at int, v string"
    for n in range(3):
        _rows(spark, [(f"k{j}", n, "x") for j in range(n, n + 3)]).coalesce(1).write.mode("append").parquet(data)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(data)
        seen.stream_first_seen(stream, root, ["k"], ["at"]).awaitTermination()
    got = [r["k"] for r in seen.first_seen(spark, root, schema).collect()]
    assert sorted(got) == [f"k{j}" for j in range(5)]



def test_a_small_batch_stays_few_files(spark, tmp_path):
    root = str(tmp_path / "few")
    for n in range(2):  # a batch that meets known keys is not dealt out to a task for each shuffle partition
        seen.first_seen_batch(_rows(spark, [(f"k{j}", n, "x") for j in range(40 * n, 40 * n + 50)]).repartition(3), n, root, ["k"], ["at"])
    assert len([f for f in os.listdir(f"{root}/rows/batch=1") if f.startswith("part-")]) == 1
    assert os.listdir(f"{root}/heads") == []
    assert seen.first_seen(spark, root, "k string, at int, v string").count() == 90


def test_a_larger_table_comes_in_as_many_files(spark, tmp_path):
    from cairn.plans.fixtures import Inputs
    from cairn.plans.sources import event_files

    kind = F.element_at(F.array(F.lit("click"), F.lit("view")), (F.col("id") % 2 + 1).cast("int"))
    spark.range(0, 6000, 1, 1).select(F.col("id").alias("event_id"), kind.alias("event_type")).write.parquet(str(tmp_path / "events.parquet"))
    files = spark.read.parquet(event_files(Inputs(spark, str(tmp_path)), "many", files=4))
    assert len(files.inputFiles()) == 4 and files.count() == 6000
