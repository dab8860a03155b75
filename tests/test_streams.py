"""Streams with state: bursts in and out of order, landings that settle, state that goes."""

import json
import time


from shotframe.streaming import triggers as live


def settle(q, files, limit=20.0):
    """Wait until the query has taken so many files and has nothing more to do (event-time timeouts may need a batch without data)."""
    began, still = time.time(), 0
    while still < 8 and time.time() - began < limit:
        assert q.exception() is None, q.exception()
        taken = sum(p["numInputRows"] > 0 for p in q.recentProgress)
        still = still + 1 if taken >= files and not q.status["isDataAvailable"] else 0
        time.sleep(0.25)


def run(spark, tmp_path, batches, schema, query, name):
    """The rows that each batch of a stream gives; a batch is a file."""
    folder = tmp_path / name
    folder.mkdir()
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    q = query(rows).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    out, seen = [], 0
    try:
        for i, batch in enumerate(batches):
            (tmp_path / "part").write_text("\n".join(map(json.dumps, batch)))
            (tmp_path / "part").rename(folder / f"{i:03d}.json")
            settle(q, i + 1)
            got = [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]
            out.append(got[seen:])
            seen = len(got)
        kept = [s for p in q.recentProgress for s in p["stateOperators"]]
    finally:
        q.stop()
    return out, kept


def touches(*ms, line="A"):
    return [{"line": line, "ms": t} for t in ms]


def test_bursts_at_once_with_late_touches(spark, tmp_path):
    batches = [touches(0, 400, 1300), touches(9000), touches(5000, 8500, 1500), touches(9100, 20_000, line="B") + touches(10_200)]
    got, _ = run(spark, tmp_path, batches, "line string, ms long", lambda rows: live.collapsed(rows, "line", "ms", 1200), "at_once")
    assert [sorted(ms for _, ms in b) for b in got] == [[0, 1300], [9000], [5000], [9100, 10_200, 20_000]]


def test_bursts_in_order(spark, tmp_path):
    """A touch that came before the others of its batch is judged in its place; what is later than the watermark is dropped."""
    batches = [touches(3000, 4100), touches(2000, 2500), touches(20_000), touches(100), touches(40_000), touches(60_000)]
    got, _ = run(spark, tmp_path, batches, "line string, ms long", lambda rows: live.collapsed_in_order(rows, "line", "ms", 1200, wait_ms=5000), "in_order")
    flat = [ms for b in got for _, ms in b]
    assert flat == [2000, 4100, 20_000, 40_000]


def seen(*rows):
    return [{"file": f, "size": s, "modified": m, "seen": f"1970-01-01T00:{t // 60:02d}:{t % 60:02d}Z"} for f, s, m, t in rows]


def test_landings_settle(spark, tmp_path):
    schema = "file string, size long, modified long, seen timestamp"
    batches = [
        seen(("a", 10, 1, 1), ("b", 10, 1, 1), ("c", 0, 1, 1)),  # a and b land, c is empty
        seen(("a", 10, 2, 4), ("b", 20, 2, 4)),  # a held still, b grew
        seen(("b", 20, 3, 8), ("a", 10, 2, 8)),  # b held still; a again, of the same landing
        seen(("a", 10, 2, 12), ("d", 5, 9, 12)),  # still the same landing
        seen(("a", 15, 13, 15)), seen(("a", 15, 13, 19)),  # written again: a landing of its own
        seen(("z", 1, 1, 60)), seen(("z", 2, 2, 240)), seen(("z", 3, 3, 460))]
    query = lambda rows: live.settled(rows, "file", "size", "modified", 3000, 100_000)
    got, state = run(spark, tmp_path, batches, schema, query, "landings")
    told = [[(f, s, m) for f, s, m, _ in b] for b in got]
    assert sorted(told[1]) == [("a", 10, 2)] and ("b", 20, 3) in told[2]
    flat = [x for b in told for x in b]
    assert sorted(x for x in flat if x[0] != "z") == [("a", 10, 2), ("a", 15, 13), ("b", 20, 3), ("d", 5, 9)]
    assert not any(f in "cz" for f, *_ in flat)  # c is empty, z had another size each time it was seen
    assert state[-1]["numRowsTotal"] < max(s["numRowsTotal"] for s in state)


