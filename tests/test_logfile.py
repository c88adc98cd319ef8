import json

from lodestone.sources import logfile as L
from lodestone.sources.dataset import Dataset

VALUES = {"user:1": {"id": 1, "name": "Ann", "on": True, "score": 1.5, "none": None, "deep": {"x": {"y": "é"}}}, "ключ": {}, "big": {"n": 1 << 40}}


def test_round_trip():
    data = b"".join(L.encode_record(k, v) for k, v in VALUES.items()) + L.encode_record("user:1", None)
    got = [(op, k, v) for _, op, k, v in L.records(data)]
    assert got == [("put", "user:1", VALUES["user:1"]), ("put", "ключ", {}), ("put", "big", {"n": str(1 << 40)}), ("delete", "user:1", None)]
    assert len(list(L.records(data[:-1]))) == 3 and list(L.records(b"")) == [] and list(L.records(b"\0" * 30)) == []


def test_hints_and_snapshots():
    entry = lambda k, o: len(k).to_bytes(4, "big") + k + o.to_bytes(8, "big")
    data = entry(b"a", 0) + entry(b"bc", 17)
    assert list(L.hints(data)) == [("a", 0), ("bc", 17)] and list(L.hints(data[:-1])) == [("a", 0)]
    body = (1).to_bytes(4, "big") + (2).to_bytes(4, "big") + (9).to_bytes(8, "big") + b"bc"
    snap = b"DBIX\1" + len(body).to_bytes(4, "big") + body
    assert L.snapshot(snap) == {"bc": 9}
    assert L.snapshot(snap[:-1]) is None and L.snapshot(b"X" + snap[1:]) is None and L.snapshot(b"") is None


def test_scan(spark, tmp_path):
    (tmp_path / "users.db").write_bytes(b"".join(L.encode_record(f"item:{i}", {"id": i, "group": i % 10}) for i in range(1000)) + b"".join(L.encode_record(f"item:{i}", None) for i in (1, 3, 5)) + b"\0\0")
    state = L.state_of_log(spark, str(tmp_path / "users.db"))
    assert state.count() == 997
    assert json.loads(state.where("key = 'item:42'").first().value) == {"id": 42, "group": 2}
    assert L.read_log(spark, str(tmp_path)).count() == 1003


def test_scopes(spark):
    d = Dataset.of(spark.range(10), "id")
    d.scopes["big"] = lambda q: q.where("id", gte=7)
    assert d.query().count().first().n == 3 and d.query("big").count().first().n == 10
