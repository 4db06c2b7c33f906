import pytest
from pyspark.sql import functions as F

from gapscope.plans import steps
from gapscope.sources import sinks as sk
from gapscope.sources import tables as tb

COLS = "run_id string, source string, source_id string, cluster_id long, cluster_label string, service_type string"


@pytest.fixture
def current(spark):
    return spark.createDataFrame(
        [("r1", "i", "1", 1, "one", "net"), ("r1", "i", "2", 2, "two", "mail"), ("r2", "i", "1", 9, "nine", "net")], COLS
    )


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_upsert_updates_inserts_and_keeps(spark, current):
    new = spark.createDataFrame([("r1", "i", "2", 5, "five", "ignored"), ("r1", "w", "3", 6, "six", "new")], COLS)
    got = sk.upsert_table("cluster_assignments", current, new)
    assert rows(got) == {("r1", "i", "1", 1, "one", "net"), ("r1", "i", "2", 5, "five", "mail"), ("r1", "w", "3", 6, "six", "new")}
    assert rows(sk.upsert_table("cluster_assignments", got, new)) == rows(got)


def test_update_to_null_is_kept(spark, current):
    new = spark.createDataFrame([("r1", "i", "1", None, None, None)], COLS)
    got = rows(sk.upsert_table("cluster_assignments", current, new))
    assert ("r1", "i", "1", None, None, "net") in got


def test_written_table_replaces_only_its_runs(spark, current, tmp_path):
    path = str(tmp_path / "cluster_assignments")
    sk.write_runs(current, path)
    stored = spark.read.parquet(path).select(*current.columns)
    new = spark.createDataFrame([("r1", "i", "2", 5, "five", "x")], COLS)
    sk.write_runs(sk.upsert_table("cluster_assignments", stored, new), path)
    again = spark.read.schema(current.schema).parquet(path).select(*current.columns)
    assert rows(again) == {("r1", "i", "1", 1, "one", "net"), ("r1", "i", "2", 5, "five", "mail"), ("r2", "i", "1", 9, "nine", "net")}


def test_delete_run_covers_the_child_tables(spark, current):
    ledger = spark.createDataFrame([("r1", "complete"), ("r2", "failed")], "run_id string, status string")
    left, tables, removed = sk.delete_run(ledger, {"cluster_assignments": current, "other": current}, "r1")
    assert rows(left) == {("r2", "failed")} and removed.first()["removed"] == 1
    assert rows(tables["cluster_assignments"].select("run_id")) == {("r2",)} and "other" not in tables
    assert sk.delete_run(ledger, {}, "nope")[2].first()["removed"] == 0
    assert len(sk.RUN_TABLES) == 20


def test_patch_and_review(spark):
    a = spark.createDataFrame([("r", 1, "A1", "t1", None, False), ("r", 2, "A2", "t2", "n", True)], "run_id string, cluster_id long, article_id string, title string, additional_notes string, needs_review boolean")
    p = spark.createDataFrame([("r", 1, None, "note"), ("r", 2, None, None), ("x", 1, "no", "no")], "run_id string, cluster_id long, title string, additional_notes string")
    got = {r["article_id"]: (r["title"], r["additional_notes"], r["patched"]) for r in sk.patch_articles(a, p, ["title", "additional_notes"]).collect()}
    assert got == {"A1": ("t1", "note", True), "A2": ("t2", "n", False)}
    flagged = sk.flag_for_review(a, spark.createDataFrame([("A1",), ("A1",)], "article_id string"))
    assert {r["article_id"]: r["needs_review"] for r in flagged.collect()} == {"A1": True, "A2": True}


def test_text_ranges_select_every_id_once(spark):
    ids = ["", "0", "00ff", "3a", "9", "f", "ffff", "g", "Z", " ", None, "a0", "9f-1"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    for length in (1, 2):
        ranges = tb.text_ranges("id", length)
        assert len(ranges) == 16**length + 1
        assert [df.select(sum(F.coalesce(F.expr(r), F.lit(False)).cast("int") for r in ranges).alias("n")).where("n <> 1").count()] == [0]


def test_runs_on_disk(spark, current, tmp_path):
    path = str(tmp_path / "t")
    odd = current.where("run_id = 'r2'").withColumn("run_id", F.lit("a/b: c%"))
    sk.write_runs(current.unionByName(odd), path)
    read = lambda: rows(spark.read.schema(current.schema).parquet(path).select("run_id", "source_id"))
    assert read() == {("r1", "1"), ("r1", "2"), ("r2", "1"), ("a/b: c%", "1")}
    sk.write_runs(current.where("run_id = 'none'"), path, ["r1"])
    assert read() == {("r2", "1"), ("a/b: c%", "1")}
    sk.drop_run(spark, str(tmp_path), ["t", "missing"], "a/b: c%")
    assert read() == {("r2", "1")} and [p.name for p in tmp_path.iterdir() if p.name.startswith("t-")] == []


def test_failed_write_changes_nothing(spark, current, tmp_path):
    path = str(tmp_path / "t")
    sk.write_runs(current, path)
    with pytest.raises(Exception):
        sk.write_runs(current.withColumn("cluster_label", F.raise_error(F.lit("stop")).cast("string")), path)
    assert spark.read.parquet(path).count() == 3


@pytest.mark.parametrize("fails_at", range(1, 6))
def test_failed_move_changes_nothing(spark, current, tmp_path, monkeypatch, fails_at):
    """A store whose rename returns false or raises at any of the moves leaves all tables of a step as they were."""
    folder = str(tmp_path)
    steps.store({"a": current, "b": current}, folder, "r1")
    new = current.where("run_id = 'r1'").withColumn("cluster_label", F.lit("new"))
    real, calls = sk._move, []

    def move(files, source, target):
        calls.append(source)
        if len(calls) == fails_at:
            if fails_at % 2:
                raise RuntimeError("store is gone")
            raise OSError("not moved")
        real(files, source, target)

    monkeypatch.setattr(sk, "_move", move)
    read = lambda t: rows(spark.read.schema(current.schema).parquet(f"{folder}/{t}").select(*current.columns))
    before = read("a"), read("b")
    if fails_at < 5:  # two moves a table
        with pytest.raises((RuntimeError, OSError)):
            steps.store({"a": new, "b": new}, folder, "r1")
        assert (read("a"), read("b")) == before
    else:
        steps.store({"a": new, "b": new}, folder, "r1")
        assert {r[4] for r in read("a") if r[0] == "r1"} == {"new"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_rename_that_returns_false_is_an_error():
    class Store:
        def rename(self, source, target):
            return False

    with pytest.raises(OSError):
        sk._move(Store(), "x", "y")


def test_rows_that_cannot_be_moved_back_are_kept(spark, current, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sk.write_runs(current, path)
    real, calls = sk._move, []

    def move(files, source, target):
        calls.append(source)
        if len(calls) > 1:
            raise OSError("no")
        real(files, source, target)

    monkeypatch.setattr(sk, "_move", move)
    with pytest.raises(sk.StuckMove):
        sk.write_runs(current.where("run_id = 'r1'"), path)
    kept = [p for p in tmp_path.iterdir() if p.name.startswith("t-old-")]
    assert len(kept) == 1 and spark.read.parquet(str(kept[0])).count() == 2


def test_kb_entries_once_per_article(spark):
    index = spark.createDataFrame(
        [("r1", "existing", "7", "old", None, [1.0, 0.0], False), ("r2", "existing", "7", "new", None, [0.0, 2.0], False), ("r2", "generated", "1", "g", None, [1.0, 1.0], True)],
        "run_id string, source string, source_id string, title string, category string, embedding array<double>, is_generated boolean",
    )
    articles = spark.createDataFrame([("7", "seven", [1.0, 0.0]), ("8", "eight", [0.0, 1.0])], "id string, title string, kb_vec array<double>")
    got = {r["id"]: (r["title"], r["kb_vec"]) for r in tb.kb_entries(index, articles).collect()}
    assert got == {"7": ("new", [0.0, 1.0]), "8": ("eight", [0.0, 1.0])}
    none = tb.kb_entries(index.where(F.lit(False)), articles)
    assert {r["id"] for r in none.collect()} == {"7", "8"}
