import sqlite3
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from textledger.operators.queries import list_files, run_summary, search, statistics
from textledger.operators.versions import already_processed, current_versions, pending, replaced_keys, upsert
from textledger.schema import LEDGER
from textledger.sources import ledger as source
from textledger.sources.ledger import batch_ids, compact, read_ledger, read_versions, snapshot, vacuum, write_batch

AT = datetime(2024, 1, 1)


def row(path, hash_, text="text", method="direct", at=AT, seconds=1.0):
    failed = method == "error"
    return (path, hash_, len(text), method, text, 1, seconds, at, not failed, "broken" if failed else None)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), LEDGER)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "ledger")


def texts(rows):
    return sorted(((r.file_path, r.file_hash, r.extracted_text) for r in rows.collect()), key=repr)


FIRST = [row("a", "1", "old a"), row("b", "1", "old b"), row("c", None, "c1"), row("d", "1", "", "error")]
SECOND = [row("a", "1", "new a"), row("b", "2", "new b"), row("c", None, "c2"), row("e", "1", "e")]


def test_batches_upsert_as_insert_or_replace_does(spark, path):
    assert batch_ids(spark, path) == []
    assert read_ledger(spark, path).count() == 0
    assert write_batch(frame(spark, *FIRST), path) == {"processed": 4, "successful": 3, "failed": 1}
    assert write_batch(frame(spark, *SECOND), path) == {"processed": 4, "successful": 4, "failed": 0}
    assert batch_ids(spark, path) == [1, 2]

    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (file_path TEXT, file_hash TEXT, extracted_text TEXT, UNIQUE (file_path, file_hash))")
    for r in FIRST + SECOND:
        con.execute("INSERT OR REPLACE INTO t VALUES (?, ?, ?)", (r[0], r[1], r[4]))
    expected = sorted(con.execute("SELECT * FROM t").fetchall(), key=repr)
    assert sorted(map(tuple, read_ledger(spark, path).select("file_path", "file_hash", "extracted_text").collect()), key=repr) == expected
    by_plan = current_versions(read_versions(spark, path)).select("file_path", "file_hash", "extracted_text")
    assert sorted(map(tuple, by_plan.collect()), key=repr) == expected


def test_one_row_is_a_batch(spark, path):
    write_batch(frame(spark, row("a", "1", "old")), path)
    write_batch(frame(spark, row("a", "1", "new")), path)
    assert texts(read_ledger(spark, path)) == [("a", "1", "new")]


def test_repeating_a_batch_replaces_it(spark, path):
    write_batch(frame(spark, *FIRST[:2]), path, batch_id=7)
    write_batch(frame(spark, FIRST[0]), path, batch_id=7)
    assert batch_ids(spark, path) == [7]
    assert read_versions(spark, path).count() == 1


def test_load_time_is_utc_in_whole_seconds(spark, path):
    east = timezone(timedelta(hours=2))
    write_batch(frame(spark, FIRST[0]), path, loaded_at=datetime(2024, 5, 6, 1, 2, 3, 999999, east))
    assert read_ledger(spark, path).first().timestamp == datetime(2024, 5, 5, 23, 2, 3)
    write_batch(frame(spark, FIRST[1]), path)
    age = datetime.now(timezone.utc).replace(tzinfo=None) - read_ledger(spark, path).where("file_path = 'b'").first().timestamp
    assert timedelta(seconds=-1) < age < timedelta(minutes=5)


def test_shown_time_does_not_depend_on_the_session_zone(spark, path):
    write_batch(frame(spark, FIRST[0]), path, loaded_at=datetime(2024, 3, 10, 2, 30, 0))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert search(read_versions(spark, path), "old").first().timestamp == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_sequence_orders_rows_of_one_key(spark, path):
    rows = frame(spark, row("a", "1", "1st"), row("a", "1", "2nd"), row("a", None, "n1"), row("a", None, "n2"))
    with pytest.raises(ValueError, match="sequence"):
        write_batch(rows, path)
    ordered = rows.withColumn("seq", F.expr("CASE extracted_text WHEN '1st' THEN 1 WHEN '2nd' THEN 2 ELSE 0 END"))
    write_batch(ordered, path, sequence="seq")
    assert texts(read_ledger(spark, path).where("file_hash IS NOT NULL")) == [("a", "1", "2nd")]
    assert read_ledger(spark, path).count() == 3
    history = upsert(frame(spark).withColumn("batch_id", F.lit(0).cast("bigint")), ordered, 1, sequence="seq")
    assert texts(current_versions(history).where("file_hash IS NOT NULL")) == [("a", "1", "2nd")]


@pytest.mark.parametrize("fault", [{"file_path": None}, {"success": None}, {"extraction_method": "guess"}, {"extraction_method": None}])
def test_rows_out_of_schema_are_refused(spark, path, fault):
    (name, value), = fault.items()
    rows = frame(spark, FIRST[0]).withColumn(name, F.lit(value).cast(LEDGER[name].dataType))
    with pytest.raises(Exception, match=name):
        write_batch(rows, path, unique=True)
    assert batch_ids(spark, path) == [] or read_versions(spark, path).count() == 0


def test_compaction_keeps_current_rows(spark, path, tmp_path):
    write_batch(frame(spark, *FIRST), path, loaded_at=AT)
    write_batch(frame(spark, *SECOND), path, loaded_at=AT + timedelta(days=1))
    new_path = str(tmp_path / "compacted")
    compact(spark, path, new_path)
    assert batch_ids(spark, new_path) == [1]
    assert sorted(read_ledger(spark, new_path).collect(), key=repr) == sorted(read_ledger(spark, path).collect(), key=repr)
    with pytest.raises(Exception, match="(?i)exists"):
        compact(spark, path, new_path)


def test_done_and_pending(spark, path):
    write_batch(frame(spark, *FIRST), path)
    listing = spark.createDataFrame([("a", "1"), ("a", "2"), ("c", None), ("d", "1"), ("z", "1")], "file_path string, file_hash string")
    history = read_versions(spark, path)
    assert {tuple(r) for r in already_processed(listing, history).collect()} == {("a", "1"), ("d", "1")}
    assert {tuple(r) for r in pending(listing, history).collect()} == {("a", "2"), ("c", None), ("z", "1")}


def test_queries_over_history_see_current_rows_only(spark, path):
    write_batch(frame(spark, *FIRST), path, loaded_at=AT)
    write_batch(frame(spark, *SECOND), path, loaded_at=AT + timedelta(days=1))
    history = read_versions(spark, path)
    assert search(history, "OLD").select("file_path").collect() == [("b",)]
    assert [r.preview for r in search(history, "a").collect()] == ["new a"]
    assert [r.file_path for r in search(history, "", 3).collect()] == ["a", "b", "c"]
    assert tuple(statistics(history).first()) == (7, 6, 1, 600.0 / 7, 1.0)
    assert [r.file_path for r in list_files(history).collect()] == ["a", "b", "b", "c", "c", "e"]
    assert [r.file_path for r in list_files(history, include_failed=True).collect()] == list("abbccde")
    assert [r.file_path for r in list_files(history, method="error", include_failed=True).collect()] == ["d"]
    assert "extracted_text" not in list_files(history).columns
    assert tuple(run_summary(history, 1).first()) == (4, 3, 1)


def test_statistics_of_nothing(spark):
    assert tuple(statistics(frame(spark)).first()) == (0, 0, 0, None, 0.0)
    assert tuple(statistics(frame(spark, FIRST[3])).first()) == (1, 0, 1, 0.0, 0.0)


def test_narrow_queries_read_no_text(spark, path):
    write_batch(frame(spark, *FIRST), path)
    write_batch(frame(spark, *SECOND), path)
    history = read_versions(spark, path)
    for query in [statistics(history), list_files(history), run_summary(history, 1), pending(history.select("file_path", "file_hash"), history)]:
        assert "extracted_text" not in query._jdf.queryExecution().executedPlan().toString()


def test_search_shuffles_previews_not_texts(spark, path):
    write_batch(frame(spark, *FIRST), path)
    write_batch(frame(spark, *SECOND), path)
    plan = search(read_versions(spark, path), "old")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "PushedFilters: [IsNotNull(success), EqualTo(success,true)" in plan.replace("IsNotNull(extracted_text), ", "")


def test_hot_key_written_by_many_batches(spark):
    hot = spark.range(2000).select(
        F.lit("hot").alias("file_path"), F.lit("1").alias("file_hash"), F.col("id").alias("batch_id"), F.col("id").cast("string").alias("v")
    )
    rest = spark.range(4000).select(
        F.col("id").cast("string").alias("file_path"), F.lit("1").alias("file_hash"), F.lit(1).cast("bigint").alias("batch_id"), F.lit("r").alias("v")
    )
    current = current_versions(hot.unionByName(rest))
    assert current.count() == 4001
    assert current.where("file_path = 'hot'").first().v == "1999"


@pytest.fixture
def small_partitions(spark):
    """Make the adaptive planner treat test data as it would treat big data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "30KB",
        "spark.sql.shuffle.partitions": "20",
    }
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def final_plan(frame):
    total = frame.agg(F.sum("r"), F.count("*"))
    return total.collect()[0][1], total._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_split(spark, tmp_path, small_partitions):
    hot = "IF(id % 3 = 0, 'hot', string(id)) AS file_path", "IF(id % 3 = 0, 'h', sha2(string(id), 256)) AS file_hash"
    spark.range(0, 600_000, 1, 8).selectExpr(*hot, "rand(1) AS r", "IF(id % 3 = 0, id, 1) AS batch_id").write.parquet(str(tmp_path / "rows"))
    spark.range(0, 300_000, 1, 8).selectExpr(*hot).write.parquet(str(tmp_path / "known"))
    rows, known = spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "known"))
    count, plan = final_plan(already_processed(rows, known))
    assert count == 400_000 and "skew=true" in plan
    count, plan = final_plan(pending(rows, known))
    assert count == 200_000
    # The hot key was written by 200,000 batches here, of which one is current.
    count, plan = final_plan(current_versions(rows))
    assert count == 400_001 and "hashpartitioning(file_path" in plan and "batch_id" in plan.split("SortMergeJoin")[1].split("\n")[0]


def test_writers_at_once_get_batches_of_their_own(spark, path):
    from concurrent.futures import ThreadPoolExecutor

    frames = [frame(spark, *[row(f"{n}-{at}", "1") for at in range(5)]) for n in range(2)]
    with ThreadPoolExecutor(2) as pool:
        written = list(pool.map(lambda rows: write_batch(rows, path), frames))
    assert written == [{"processed": 5, "successful": 5, "failed": 0}] * 2
    assert batch_ids(spark, path) == [1, 2]
    assert read_ledger(spark, path).count() == 10


def test_null_and_equal_sequences_keep_one_row_of_each_key(spark, path):
    rows = frame(spark, row("a", "1", "x"), row("b", "1", "x"), row("b", "1", "y"), row("c", "1", "x"), row("c", "1", "y"), row("d", None), row("d", None))
    numbered = rows.withColumn("seq", F.expr("CASE WHEN file_path = 'a' THEN NULL WHEN file_path = 'b' THEN 1 WHEN extracted_text = 'x' THEN 0 END"))
    write_batch(numbered, path, sequence="seq")
    assert texts(read_ledger(spark, path).where("file_hash IS NOT NULL")) == [("a", "1", "x"), ("b", "1", "y"), ("c", "1", "x")]
    assert read_ledger(spark, path).where("file_path = 'd'").count() == 2


def test_upsert_refuses_repeated_keys(spark):
    history = frame(spark).withColumn("batch_id", F.lit(0).cast("bigint"))
    rows = frame(spark, row("a", "1", "x"), row("a", "1", "y"), row("n", None), row("n", None))
    with pytest.raises(Exception, match="several rows of one key"):
        upsert(history, rows, 1).count()
    assert upsert(history, rows.where("file_hash IS NULL"), 1).count() == 2


def test_unfinished_batches_are_not_read(spark, path):
    write_batch(frame(spark, FIRST[0]), path)
    with pytest.raises(ValueError, match="sequence"):
        write_batch(frame(spark, FIRST[1], FIRST[1]), path)
    with pytest.raises(ValueError, match="sequence"):
        write_batch(frame(spark, FIRST[1], FIRST[1]), path, batch_id=1)
    frame(spark, FIRST[3]).write.parquet(f"{path}/batch_id=5/ab")  # a writer that was lost before it was done
    assert batch_ids(spark, path) == [1]
    assert texts(read_ledger(spark, path)) == [("a", "1", "old a")]
    write_batch(frame(spark, FIRST[1]), path)
    assert batch_ids(spark, path) == [1, 3]  # the number that a failed batch reserved stays unused


def test_replaced_keys_are_one_row_each_by_plain_aggregation(spark):
    versions = frame(spark, row("a", "1"), row("b", "1")).crossJoin(spark.range(5).withColumnRenamed("id", "batch_id"))
    versions = versions.where("file_path = 'a' OR batch_id = 0")
    replaced = replaced_keys(versions)
    assert [tuple(r) for r in replaced.collect()] == [("a", "1", 4)]
    assert "ObjectHashAggregate" not in replaced._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stop", ["write", "commit", None])
def test_a_rebuilt_batch_is_the_old_or_the_new_one_never_neither(spark, path, monkeypatch, stop):
    write_batch(frame(spark, *FIRST), path, batch_id=7)
    write_batch(frame(spark, row("z", "1", "other")), path)
    before, held = snapshot(spark, path), read_versions(spark, path)
    seen = []

    def stopped(*_):
        seen.append(texts(read_ledger(spark, path)))
        raise KeyboardInterrupt

    if stop == "commit":
        monkeypatch.setattr(source, "_commit", stopped)
    rows = frame(spark, row("a", "1", "rebuilt"))
    if stop == "write":
        rows = rows.withColumn("page_count", F.raise_error(F.lit("lost")).cast("int"))
    try:
        write_batch(rows, path, batch_id=7)
    except BaseException:  # noqa: S110
        pass
    monkeypatch.undo()
    old = [("a", "1", "old a"), ("b", "1", "old b"), ("c", None, "c1"), ("d", "1", ""), ("z", "1", "other")]
    assert all(each == old for each in seen)
    assert texts(read_ledger(spark, path)) == (old if stop else [("a", "1", "rebuilt"), ("z", "1", "other")])
    assert texts(held) == old  # a reader keeps its snapshot
    assert (snapshot(spark, path) == before) == bool(stop) and batch_ids(spark, path) == [7, 8]


def test_vacuum_leaves_what_counts(spark, path, tmp_path):
    for text in ("one", "two", "three"):
        write_batch(frame(spark, row("a", "1", text)), path, batch_id=1)
    frame(spark, FIRST[3]).write.parquet(f"{path}/batch_id=9/ab")  # a writer that was lost before its commit
    vacuum(spark, path)
    assert texts(read_ledger(spark, path)) == [("a", "1", "three")]
    assert len(list((tmp_path / "ledger" / "batch_id=1").iterdir())) == 1 and not list((tmp_path / "ledger" / "batch_id=9").iterdir())
    assert batch_ids(spark, path) == [1]


def test_the_last_commit_of_a_batch_counts(spark, path):
    for number, name in ((1, "aa"), (3, "0b"), (2, "cc"), (3, "0a")):
        frame(spark, row("a", "1", name)).write.parquet(f"{path}/batch_id=4/{name}")
        source._create(spark, path, source.LOG, f"commit-{number:012d}-batch-4-{name}")
    assert snapshot(spark, path) == {4: f"{path}/batch_id=4/0b"}
    assert texts(read_ledger(spark, path)) == [("a", "1", "0b")]
    assert read_versions(spark, path).columns[-1] == "batch_id" and read_versions(spark, path).first().batch_id == 4


def history(spark, path, batches=4):
    """Batches that each write some keys of the ones before again, more rows than a byte of flags has bits."""
    for batch in range(batches):
        rows = spark.range(200).where(f"id % {batch + 2} = 0 OR {batch} = 0").selectExpr(
            "concat('f', id) AS file_path", "IF(id % 10 = 3, NULL, 'h') AS file_hash", "1L AS file_size", "'direct' AS extraction_method",
            f"concat('text ', id, ' of {batch}') AS extracted_text", "1 AS page_count", "0.5D AS processing_time_seconds", "true AS success", "CAST(NULL AS string) AS error_message",
        )
        write_batch(rows, path, loaded_at=AT)


def test_no_text_is_shuffled_to_leave_replaced_rows_out(spark, path, monkeypatch):
    history(spark, path)
    by_join = texts(current_versions(read_versions(spark, path)))
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
    try:
        current = read_ledger(spark, path)
        plan = current._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and "extracted_text" in plan
        assert texts(current) == by_join and len(by_join) > 200
        monkeypatch.setattr(source.shared, "BROADCAST_BYTES", 1)
        assert texts(read_ledger(spark, path)) == by_join
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)


def test_batches_without_a_common_key(spark, path):
    write_batch(frame(spark, row("a", "1"), row("n", None)), path)
    write_batch(frame(spark, row("b", "1"), row("n", None)), path)
    assert read_ledger(spark, path).count() == 4
