"""The stateful watcher: restarts, late and repeated events, moves."""

import datetime as dt
import json

import pytest

from lexmill.streaming import watch


def at(minute):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%S")


def run(spark, tmp_path, batches, seen, fail=None):
    """Each list of events is a file and a micro-batch; every batch is a stream of its own on the same checkpoint."""
    source = tmp_path / "events"
    source.mkdir(exist_ok=True)
    for events in batches:
        n = len(list(source.iterdir()))
        (source / f"{n:04d}.json").write_text("\n".join(json.dumps({"ts": at(m), "path": p, "event_type": e, "checksum": c}) for m, p, e, c in events) + "\n")

        def apply(df, i):
            rows = sorted((r["path"], r["kind"], r["dest"]) for r in df.collect())
            if fail is not None and fail.pop("once", False):
                raise RuntimeError("index is down")
            seen.extend((i, *r) for r in rows)

        stream = spark.readStream.schema(watch.SUMS).option("maxFilesPerTrigger", 1).json(str(source))
        q = watch.watch_moves(watch.path_changes(stream), apply, f"file://{tmp_path}/state", wait_seconds=300)
        q.awaitTermination()


def kinds(seen):
    return [r[1:] for r in seen]


def test_state_outlives_restarts(spark, tmp_path):
    seen = []
    run(spark, tmp_path, [[(0, "a.md", "created", "c1"), (0, "b.md", "created", "c2"), (1, "b.md", "modified", "c3"), (1, "b.md", "modified", "c3")]], seen)
    assert sorted(kinds(seen)) == [("a.md", "created", None), ("b.md", "created", None), ("b.md", "modified", None)]
    seen.clear()
    # repeated, late and idle events change nothing
    run(spark, tmp_path, [[(1, "b.md", "modified", "c3"), (0, "a.md", "deleted", None), (2, "a.md", "modified", "c1")]], seen)
    assert seen == []
    # a delete waits, and the create of its checksum under another path is a move
    run(spark, tmp_path, [[(3, "a.md", "deleted", None)]], seen)
    assert seen == [] and [r["path"] for r in watch.still_waiting(spark, f"file://{tmp_path}/state").collect()] == ["a.md"]
    run(spark, tmp_path, [[(4, "z.md", "created", "c1")]], seen)
    assert kinds(seen) == [("a.md", "moved", "z.md")] and watch.still_waiting(spark, f"file://{tmp_path}/state").count() == 0
    seen.clear()
    # both in one batch, in either order; a delete without a partner comes when it has waited
    run(spark, tmp_path, [[(5, "b2.md", "created", "c3"), (6, "b.md", "deleted", None), (6, "z.md", "deleted", None), (6, "never.md", "deleted", None)]], seen)
    assert kinds(seen) == [("b.md", "moved", "b2.md")]
    run(spark, tmp_path, [[(30, "n.md", "created", "c9")]], seen)
    assert sorted(kinds(seen)[1:]) == [("n.md", "created", None), ("never.md", "deleted", None), ("z.md", "deleted", None)]


def test_a_failed_batch_is_run_again(spark, tmp_path):
    seen, fail = [], {}
    run(spark, tmp_path, [[(0, "a.md", "created", "c1")], [(1, "a.md", "deleted", None)]], seen, fail)
    fail["once"] = True
    with pytest.raises(Exception, match="index is down"):
        run(spark, tmp_path, [[(2, "b.md", "created", "c1")]], seen, fail)
    assert kinds(seen) == [("a.md", "created", None)]
    run(spark, tmp_path, [[(3, "c.md", "created", "c5")]], seen, fail)
    assert kinds(seen)[1:] == [("a.md", "moved", "b.md"), ("c.md", "created", None)]
    assert len({r[0] for r in seen}) == 3, "the batch that failed kept its number"


def test_pairs_by_brute_force(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    changes = [("x", "deleted", "s", t(1)), ("y", "deleted", "s", t(2)), ("u", "created", "s", t(3)), ("k", "deleted", None, t(3)), ("l", "created", None, t(3)), ("m", "modified", "s", t(3)), ("v", "created", "r", t(9))]
    pending = [("w", "deleted", "s", t(0)), ("o", "deleted", "q", t(8))]
    table = lambda rows: spark.createDataFrame(rows, watch.CHANGES)
    out, waits = watch.paired(table(changes), table(pending), 300)
    assert sorted((r["path"], r["kind"], r["dest"] or "") for r in out.collect()) == [("k", "deleted", ""), ("l", "created", ""), ("m", "modified", ""), ("v", "created", ""), ("w", "moved", "u"), ("x", "deleted", ""), ("y", "deleted", "")]
    assert [r["path"] for r in waits.collect()] == ["o"]
    out, waits = watch.paired(table([]), table([]), 300)
    assert out.count() == 0 and waits.count() == 0
