"""The jobs over growing input, repeated runs, half-done batches, and rows that must not pass."""

import datetime as dt
import hashlib
import json
import logging
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fogline.session import held
from jobs import queries, request_batches, track_moves
from jobs.common import pattern, settings

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
TURNS = "conv_id long, turn long, role string, text string, extra string"


def event(i, minute, user, cell, props=None):
    at = None if minute is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    return (i, at, user, "view", 1.0, props if props is not None else json.dumps({"k": cell}))


def judge(rows, most=72 * 60):
    """What one run over all rows in order of time gives, entity by entity."""
    out, last = {}, {}
    for i, at, user, _, _, props in sorted(rows, key=lambda r: (r[1], r[0])):
        cell = json.loads(props)["k"]
        before = last.get(user)
        minutes = None if before is None else (at - before[0]).total_seconds() / 60
        outcome = "first" if before is None else "break" if minutes > most else "stay" if before[1] == cell else "move"
        out[i] = (outcome, before and before[1])
        last[user] = (at, cell)
    return out


def write(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode(mode).parquet(path)


def test_moves_over_growing_input_equal_one_run(spark, tmp_path):
    rng = random.Random(1)
    rows = [event(i, i * 17 + rng.randrange(17), 7 if i % 3 == 0 else rng.randrange(5), rng.randrange(4)) for i in range(900)]
    src, out = str(tmp_path / "events.parquet"), str(tmp_path / "out")
    write(spark, rows[:500], src)
    first = track_moves.run(spark, src, out)
    assert first.count() == 500
    files = {r["f"] for r in first.select(F.input_file_name().alias("f")).distinct().collect()}
    write(spark, rows[500:], src)
    second = track_moves.run(spark, src, out)
    assert {r["event_id"]: (r["outcome"], r["from_cell"]) for r in second.collect()} == judge(rows)
    # what the first run wrote is left alone, and a run without new files changes nothing
    after = {r["f"] for r in second.select(F.input_file_name().alias("f")).distinct().collect()}
    assert files < after
    third = track_moves.run(spark, src, out)
    assert {r["f"] for r in third.select(F.input_file_name().alias("f")).distinct().collect()} == after
    # one run over all of it agrees, chains included
    both = str(tmp_path / "both")
    track_moves.run(spark, src, both)
    assert sorted(map(tuple, track_moves.chains(spark, both).collect())) == sorted(map(tuple, track_moves.chains(spark, out).collect()))
    moved = [x for x in judge(rows).values() if x[0] in ("stay", "move")]
    assert sum(r["n"] for r in track_moves.chains(spark, out).collect()) == len(moved)


def test_rows_that_are_no_moves(spark, tmp_path):
    src, out = str(tmp_path / "events.parquet"), str(tmp_path / "out")
    write(spark, [event(1, 10, 1, 3), event(2, 10, 1, 5), event(2, 10, 1, 5), event(3, None, 1, 5), event(4, 11, None, 5), event(5, 12, 1, 0, "no json"), event(6, 12, 1, 5000), event(7, 12, 1, None), event(None, 13, 1, 2), event(8, 60 * 24 * 9, 1, 5)], src)
    track_moves.run(spark, src, out)
    # before the mark of entity 1, at the mark with a smaller event, after it; an entity without a mark
    write(spark, [event(9, 11, 1, 4), event(7, 60 * 24 * 9, 1, 4), event(10, 60 * 24 * 9, 1, 5), event(11, 1, 2, 4)], src)
    got = track_moves.run(spark, src, out)
    found = sorted((r["event_id"] or 0, r["outcome"], r["from_cell"]) for r in got.collect())
    assert found == sorted([(1, "first", None), (2, "move", 3), (2, "repeat", 5), (3, "invalid", None), (4, "invalid", None), (5, "invalid", None), (6, "invalid", None), (7, "invalid", None), (0, "invalid", None), (8, "break", 5), (9, "late", None), (7, "late", None), (10, "stay", 5), (11, "first", None)])


def test_a_batch_done_again_gives_the_same(spark, tmp_path):
    src, out = str(tmp_path / "events.parquet"), str(tmp_path / "out")
    write(spark, [event(i, i, i % 3, i % 4) for i in range(30)], src)
    track_moves.run(spark, src, out)
    write(spark, [event(i, i, i % 3, i % 4) for i in range(30, 60)], src)
    want = sorted(map(str, track_moves.run(spark, src, out).collect()))
    # the last batch's commit is lost, as if the driver had died after writing: the stream does it again
    commits = sorted(Path(out, "checkpoint", "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].rename(tmp_path / "lost-commit")
    Path(out, "checkpoint", "commits", f".{commits[-1].name}.crc").rename(tmp_path / "lost-crc")
    assert sorted(map(str, track_moves.run(spark, src, out).collect())) == want


def test_files_by_batch(spark, tmp_path):
    src, out = str(tmp_path / "events.parquet"), str(tmp_path / "out")
    rows = [event(i, i, 1, i % 4) for i in range(40)]
    for k in range(4):
        write(spark, rows[10 * k : 10 * k + 10], src)
    got = track_moves.run(spark, src, out, settings("track_moves") | {"files_a_batch": 1})
    assert spark.read.parquet(f"{out}/moves").select("batch").distinct().count() == 4 and got.count() == 40


def test_empty_events(spark, tmp_path):
    src, out = str(tmp_path / "events.parquet"), str(tmp_path / "out")
    write(spark, [], src)
    assert track_moves.run(spark, src, out).collect() == [] and track_moves.chains(spark, out).collect() == []


def turns(*texts, conv=1):
    return [(conv, i, "assistant" if t.startswith(">") else "system" if t.startswith("!") else "user", t.lstrip(">!"), "x") for i, t in enumerate(texts)]


def test_requests(spark, tmp_path):
    rows = turns("!be brief", "where is it", ">a" * 40, "and now", ">   ", "then", "again")
    rows += turns("!be brief", "where is it", ">other answer", conv=2) + turns("!be brief", "where is it", ">  ", conv=3)
    rows += [(None, 1, "user", "x", ""), (4, 1, "tool", "x", ""), (4, 2, "user", None, ""), (4, None, "user", "x", "")]
    rows += [(5, 0, "user", "long " * 50_000, ""), (5, 0, "user", "tie", ""), (6, 0, "user", "twice", ""), (6, 0, "user", "twice", "")]
    src, out = str(tmp_path / "c.parquet"), str(tmp_path / "out")
    spark.createDataFrame(rows, TURNS).write.parquet(src)
    got = {r["key"]: r for r in request_batches.run(spark, src, out).collect()}
    key = lambda *lines: hashlib.sha256("\x1e".join("\x1f".join(x) for x in lines).encode()).hexdigest()
    where = got[key(("system", "be brief"), ("user", "where is it"))]
    assert (where["n_asked"], where["conv_id"], where["turn"], where["status"], where["batch"]) == (3, 1, 1, "answered", None)
    assert where["tokens_out"] == len("other answer") / 4  # the last usable answer, not the last turn
    assert where["cost"] == pytest.approx((where["tokens_in"] * 0.4 + 3.0 * 1.6) / 1e6)
    status = sorted(r["status"] for r in got.values())
    assert status.count("failed") == 1 and len(got) == 8 and sum(r["n_asked"] for r in got.values()) == 10
    long = got[key(("user", "long " * 50_000))]
    assert long["status"] == "pending" and long["tokens_in"] == len("user\x1f" + "long " * 50_000) / 4 and long["cost"] == 0


def test_batches_keep_the_budget_and_reruns_agree(spark, tmp_path):
    rng = random.Random(2)
    rows = [r for c in range(200) for r in turns(*("x" * rng.randrange(1, 4000) + str((c, i)) for i in range(3)), conv=c)]
    src, out = str(tmp_path / "c.parquet"), str(tmp_path / "out")
    spark.createDataFrame(rows, TURNS).write.parquet(src)
    conf = settings("request_batches") | {"batch_tokens": 3000, "groups": 4, "context": 0}
    got = request_batches.run(spark, src, out, conf)
    sums = {}
    for r in got.orderBy("key").collect():
        sums.setdefault(r["batch"], []).append(r["tokens_in"])
    # a batch passes the budget by its last request at most
    assert len(sums) > 50 and all(sum(x[:-1]) <= 3000 for x in sums.values())
    want = sorted(map(str, got.collect()))
    assert sorted(map(str, request_batches.run(spark, src, out, conf).collect())) == want
    # grown input: no file of the earlier run is left
    spark.createDataFrame(turns("x1", conv=900), TURNS).write.mode("append").parquet(src)
    grown = request_batches.run(spark, src, out, conf)
    assert grown.count() == len(want) + 1
    p = spark.read.parquet(f"{out}/prices").collect()
    assert sum(r["requests"] for r in p) == len(want) + 1 and {r["split"] for r in p} <= {"train", "val", "test"}


def test_projection(spark, tmp_path):
    src, out = str(tmp_path / "c.parquet"), str(tmp_path / "out")
    spark.createDataFrame([r for c in range(40) for r in turns(f"q{c}", *([">" + "a" * 400] if c % 2 else []), conv=c)], TURNS).write.parquet(src)
    request_batches.run(spark, src, out)
    for r in spark.read.parquet(f"{out}/prices").collect():
        want = 0 if r["status"] == "answered" else (r["tokens_in"] * 0.4 + r["requests"] * 100 * 1.6) / 1e6
        assert r["projected"] == pytest.approx(want)


def test_empty_conversations(spark, tmp_path):
    src, out = str(tmp_path / "c.parquet"), str(tmp_path / "out")
    spark.createDataFrame([], TURNS).write.parquet(src)
    assert request_batches.run(spark, src, out).collect() == []


def test_settings_and_patterns(spark, tmp_path, caplog):
    own = tmp_path / "own.json"
    own.write_text('{"groups": 2}')
    assert settings("request_batches", spark, str(own))["groups"] == 2
    own.write_text('{"group": 2}')
    with pytest.raises(ValueError):
        settings("request_batches", spark, str(own))
    assert pattern("/a/b.parquet/") == "/a/b.parque[t]" and pattern("/a/*.parquet") == "/a/*.parquet"
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    with pytest.raises(RuntimeError), held(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        raise RuntimeError
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    caplog.set_level(logging.INFO)
    spark.createDataFrame(turns("a", ">b"), TURNS).write.parquet(str(tmp_path / "c.parquet"))
    request_batches.run(spark, str(tmp_path / "c.parquet"), str(tmp_path / "out"))
    assert "2 turns, 2 of them usable" in caplog.text and "answered 1" in caplog.text


def test_command_line(spark, tmp_path):
    src, out = str(tmp_path / "c.parquet"), str(tmp_path / "out")
    spark.createDataFrame(turns("a", ">b"), TURNS).write.parquet(src)
    done = subprocess.run([sys.executable, "-m", "jobs.request_batches", src, out], cwd=Path(queries.__file__).parents[1], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "answered 1" in done.stderr and spark.read.parquet(f"{out}/requests").count() == 1
