"""Commit logs, snapshots and sessions under writers that die, race or change what was written."""

import json
import os
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from codelode.commits import CommitLog, Conflict
from codelode.store import SessionLog, SnapshotStore, content
from codelode.streaming import sessions


@pytest.fixture
def rows(spark):
    return lambda n: spark.range(n).select(F.format_string("s%d", "id").alias("id"), (F.col("id") % 3).alias("x"))


def test_a_writer_that_dies_leaves_the_last_commit(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert log.last() is None and log.append({"v": 1}, 0) == 1
    log.write_aside({"v": "never moved"})  # died between writing and moving
    assert log.last() == (1, {"v": 1})
    for torn in (b"", b'{"v": 2', b'{"v": 2}\nnot its digest'):  # died in place, on a store that can't move
        number = max(log.numbers()) + 1
        Path(f"{tmp_path}/log/{number:012d}").write_bytes(torn)
        assert log.last()[1] == {"v": 1} and log.read(number) is None
    assert log.append({"v": 2}, 1) == 5 and log.last() == (5, {"v": 2})


def test_of_two_writers_of_a_commit_the_second_fails(spark, tmp_path):
    one, two = (CommitLog(spark, f"file://{tmp_path}/log") for _ in range(2))
    one.append({"v": "base"}, 0)
    a, b = one.write_aside({"v": "a"}), two.write_aside({"v": "b"})  # both have read commit 1
    one.move(a, 2)
    with pytest.raises(Conflict):
        two.move(b, 2)
    assert two.last() == one.last() == (2, {"v": "a"})
    with pytest.raises(Conflict):
        two.append({"v": "late"}, 1)
    assert two.append({"v": "c"}, 2) == 3 and not [n for n in os.listdir(f"{tmp_path}/log") if n.startswith("aside")]
    for k in range(3, 20):
        one.append({"v": k}, k)
    assert one.last() == (20, {"v": 19}) and len(one.numbers()) <= CommitLog.KEEP + 1


def test_readers_survive_a_writer_that_dies(spark, tmp_path, rows, monkeypatch):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.publish("p", "one", {"symbols": rows(3)})
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "move", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.publish("p", "two", {"symbols": rows(5)})
    other = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert other.active("p") == "one" and other.load("p", "symbols").count() == 3
    other.publish("p", "three", {"symbols": rows(7)}, expected="one")
    assert store.active("p") == "three" and store.counts("p") == {"symbols": 7} and store.load("p", "symbols").count() == 7
    other.promote("p", "one", expected="three")  # back: its counts are still known
    assert store.counts("p") == {"symbols": 3} and store.load("p", "symbols").count() == 3


def test_changed_files_are_refused(spark, tmp_path, rows):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.publish("p", "one", {"symbols": rows(40), "maps": spark.range(4).select(F.create_map(F.lit("k"), "id").alias("m"))})
    assert store.load("p", "symbols").count() == 40 and store.load("p", "maps").count() == 4
    part = next(Path(f"{tmp_path}/s/p/one/symbols").glob("*.parquet"))
    table = pq.read_table(part)
    pq.write_table(table.set_column(1, "x", pa.array([9] * table.num_rows, pa.int64())), part)  # as many rows, other values
    Path(f"{part.parent}/.{part.name}.crc").unlink()
    fresh = SnapshotStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError, match="isn't what was published"):
        fresh.load("p", "symbols")
    assert fresh.load("p", "symbols", verify=False).count() == 40
    with pytest.raises(ValueError, match="duplicate id"):
        store.publish("p", "bad", {"symbols": rows(2).union(rows(1))})
    assert not Path(f"{tmp_path}/s/p/bad").exists() and store.active("p") == "one"


def test_content_does_not_depend_on_order(spark, rows):
    a, b = rows(50).repartition(5), rows(50).orderBy(F.desc("id")).coalesce(1)
    assert a.agg(*content(a)).first() == b.agg(*content(b)).first() != rows(49).agg(*content(a)).first()


SESSION = "project_id string, session_id string, source_sha256 string, hits long"


def test_sessions_stay_within_a_projects_bounds(spark, tmp_path):
    batch = lambda *keys, sha="a": spark.createDataFrame([(p, s, sha, k) for p, s in keys for k in range(3)], SESSION)
    log = SessionLog(spark, f"file://{tmp_path}/log", most_sessions=3, most_bytes=5000, most_session_bytes=1000)
    with pytest.raises(LookupError):
        log.load()
    first = {(r["project_id"], r["session_id"]): (r["rows"], r["already_present"]) for r in log.append(batch(("p", "1"), ("p", "2"), ("q", "1"))).collect()}
    assert first == {("p", "1"): (3, False), ("p", "2"): (3, False), ("q", "1"): (3, False)}
    assert {r["session_id"]: r["already_present"] for r in log.append(batch(("p", "2"), ("p", "3"))).collect()} == {"2": True, "3": False}
    for wrong, said in ((batch(("p", "1"), sha="b"), "other content"), (batch(("p", "4")), "4 sessions"), (batch(("p", "5")).union(batch(("p", "5"), sha="c")), "no single"), (spark.createDataFrame([("r", "1", "a", k) for k in range(99)], SESSION), "the largest")):
        with pytest.raises(ValueError, match=said):
            log.append(wrong)
    assert log.load().count() == 12 and SessionLog(spark, f"file://{tmp_path}/log").load().count() == 12
    assert log.append(batch().limit(0)).count() == 0 and log.load().count() == 12


def test_of_two_writers_of_sessions_both_are_kept(spark, tmp_path, monkeypatch):
    batch = lambda s: spark.createDataFrame([("p", s, "a", 1)], SESSION)
    one, two = (SessionLog(spark, f"file://{tmp_path}/log") for _ in range(2))
    one.append(batch("0"))
    append = CommitLog.append

    def late(log, row, after):  # the other writer commits between the checks and the commit
        monkeypatch.setattr(CommitLog, "append", append)
        two.append(batch("2"))
        return append(log, row, after)

    monkeypatch.setattr(CommitLog, "append", late)
    assert [r["already_present"] for r in one.append(batch("1")).collect()] == [False]
    assert sorted(r["session_id"] for r in two.load().collect()) == ["0", "1", "2"]


def test_a_session_delivered_twice_in_a_batch_is_there_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = "\n".join(json.dumps({"project_id": "p", "session_id": "s", "source_sha256": "a", "hits": k}) for k in (1, 1, 2))
    for name in ("x", "y"):
        (tmp_path / f"in/{name}.json").write_text(rows)
    for checkpoint in ("c1", "c1", "c2"):  # run on, and a replay of all batches
        sessions.ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/log", f"file://{tmp_path}/{checkpoint}").awaitTermination()
    assert sorted(r["hits"] for r in SessionLog(spark, f"file://{tmp_path}/log").load().collect()) == [1, 1, 2]


def test_saved_sessions_of_the_query_have_no_bound_of_a_project():
    from codelode.plans import library

    assert min(library.UNBOUNDED.values()) > 1 << 50 and set(library.UNBOUNDED) == {"most_sessions", "most_bytes", "most_session_bytes"}
