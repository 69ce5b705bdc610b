"""Reading recordings: whole ones are read once, broken ones are logged and tried again."""

import json

import pytest

from fogline.sources import recordings as rec
from fogline.sources.store import MatchStore


def recording(root, source, demo, rows, end=True, raw=None):
    folder = root / f"source={source}" / f"demo_id={demo}"
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"table": "meta", "map_name": "m", "n_rounds": 1, "tickrate": 64})] + [json.dumps({"table": t, **r}) for t, r in rows] + [json.dumps({"table": "end"})] * end
    (folder / "recording.jsonl").write_bytes(raw if raw is not None else "\n".join(lines).encode())


SHOT = ("shots", {"tick": 5, "round_num": 1, "player_steamid": 76561198000000001, "weapon": "ak47", "silenced": False, "unknown": 1})


def test_one_bad_recording_among_three(spark, tmp_path):
    raw, store = tmp_path / "raw", MatchStore(spark, str(tmp_path / "store"))
    recording(raw, "a", "1", [SHOT, ("kills", {"tick": 7, "weapon": "awp"})])
    recording(raw, "a", "2", [SHOT], end=False)
    recording(raw, "b", "1", [SHOT, SHOT])
    read, failed = rec.ingest(store, str(raw))
    assert sorted(map(tuple, read.collect())) == [("a", "1"), ("b", "1")]
    assert [(r.source, r.demo_id, r.reason) for r in failed.collect()] == [("a", "2", "ValueError: truncated")]
    shots = store.read("shots").collect()
    assert sorted((r.source, r.demo_id) for r in shots) == [("a", "1"), ("b", "1"), ("b", "1")]
    assert shots[0].player_steamid == 76561198000000001 and shots[0].silenced is False and store.read("kills").count() == 1
    assert store.read("bomb").count() == 0 and {(r.demo_id, r.map_name, r.tickrate) for r in store.demos().collect()} == {("1", "m", 64)}
    assert [(r.source, r.demo_id) for r in rec.quarantined(store).collect()] == [("a", "2")] and "recording.jsonl" in rec.quarantined(store).first().file
    # again: nothing is read twice; the broken one is tried, and is read once it is whole
    read, failed = rec.ingest(store, str(raw))
    assert read.collect() == [] and failed.count() == 1 and store.read("shots").count() == 3
    recording(raw, "a", "2", [SHOT])
    read, failed = rec.ingest(store, str(raw))
    assert [tuple(r) for r in read.collect()] == [("a", "2")] and failed.count() == 0
    assert rec.quarantined(store).count() == 0 and store.read("shots").count() == 4 and store.demos().count() == 3


@pytest.mark.parametrize(("raw", "reason"), [(b"\n", "truncated"), (b"\xff\xfe", "UnicodeDecodeError"), (b'{"table": "nowhere"}', "no table"), (b'{"x": 1}', "KeyError"), (b'{"table": "end"}\n{"table": "end"}', "after the end"), (b"{", "JSONDecodeError")])
def test_reasons(spark, tmp_path, raw, reason):
    recording(tmp_path / "raw", "a", "1", [], raw=raw)
    store = MatchStore(spark, str(tmp_path / "store"))
    _, failed = rec.ingest(store, str(tmp_path / "raw"))
    assert reason in failed.first().reason and store.demos().count() == 0


def test_filters_prune_folders_and_unselected_content_is_not_read(spark, tmp_path):
    for demo in "123":
        recording(tmp_path, "a", demo, [SHOT])
        recording(tmp_path, "b", demo, [SHOT])
    one = rec.recordings(spark, str(tmp_path)).where("source = 'a' and demo_id = '2'")
    plan = one._jdf.queryExecution().toString()
    assert one.count() == 1 and "PartitionFilters: [isnotnull(source" in plan
    listed = rec.recordings(spark, str(tmp_path)).select("source", "demo_id")
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString() and listed.distinct().count() == 6


def test_a_recording_is_decoded_some_rows_at_a_time(spark, tmp_path, monkeypatch):
    """What is sent before a fault is not kept, and a decoder is never far ahead of what was sent."""
    monkeypatch.setattr(rec, "SENT", 3)
    raw, store = tmp_path / "raw", MatchStore(spark, str(tmp_path / "store"))
    recording(raw, "a", "1", [SHOT] * 10)
    recording(raw, "a", "2", [SHOT] * 10, end=False)
    read, failed = rec.ingest(store, str(raw))
    assert [tuple(r) for r in read.collect()] == [("a", "1")] and [r.reason for r in failed.collect()] == ["ValueError: truncated"]
    assert store.read("shots").count() == 10
    rows = rec.decoded(rec.recordings(spark, str(raw)), rec.jsonl)
    assert rows.where("error is not null").count() == 1 and rows.where("error is null and demo_id = '2'").count() >= 9
    text = "a\r\nb c\n\nd\x0be\r"
    assert list(rec._lines(text)) == text.splitlines()
