"""Background jobs as a stateful stream: repeats, cancellation, expiry, a restart."""

import json

import pytest

from quillspark.streaming import jobs


@pytest.fixture
def rocks(spark):
    spark.conf.set(*jobs.STATE_STORE)
    yield spark
    spark.conf.unset(jobs.STATE_STORE[0])


def event(job, kind, source=None, n=None, at="10:00", error=None):
    return {"job_id": job, "kind": kind, "source": source, "n": n, "error": error, "at": f"2024-01-01 {at}:00"}


def test_jobs_on_a_stream_with_a_restart(rocks, tmp_path):
    spark, landing = rocks, tmp_path / "in"
    landing.mkdir()

    def feed(n, *events):
        (landing / f"{n}.json").write_text("\n".join(map(json.dumps, events)))
        rows = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).json(str(landing))
        out = jobs.progressed(rows, late="1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        out.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    start = [event(j, "start", s) for j in ("a", "b", "c", "d") for s in ("arxiv", "core")]
    first = feed(1, *start, event("a", "fetched", "arxiv", 3), event("a", "fetched", "arxiv", 9, at="10:01"), event("b", "failed", "core", error="x" * 300), event("c", "fetched", "core", 1))
    assert {(r.job_id, r.source, r.papers_fetched) for r in first.collect()} == {("a", "arxiv", 3), ("b", "core", 0), ("c", "core", 1)}
    assert first.where("error is not null").first().error == "x" * 200
    feed(2, event("a", "fetched", "arxiv", 9, at="10:02"), event("a", "fetched", "core", 4, at="10:02"), event("b", "cancel", at="10:02"), event("b", "fetched", "arxiv", 5, at="10:03"))
    feed(3, event("b", "fetched", "arxiv", 5, at="10:04"), event("z", "start", "arxiv", at="11:00"))
    last = feed(4, event("z", "fetched", "arxiv", None, at="11:01"))
    got = {(r.job_id, r.source): (r.papers_fetched, r.total_papers, r.status) for r in last.collect()}
    assert last.count() == len(got)
    assert got["a", "core"] == (4, 7, "running") and got["a", "__all__"] == (0, 7, "done") and got["b", "__all__"] == (0, 0, "cancelled") and ("b", "arxiv") not in got
    assert got["c", "__all__"] == (0, 1, "expired") and got["d", "__all__"] == (0, 0, "expired") and got["z", "__all__"] == (0, 0, "done")
    status = {r.job_id: (r.status, r.total_papers, r.failed_sources) for r in jobs.job_status(last).collect()}
    assert status["b"] == ("cancelled", 0, ["core"]) and status["a"] == ("done", 7, []) and status["c"] == ("expired", 1, [])


def test_stream_equals_table(rocks, tmp_path):
    import random

    rng, landing = random.Random(5), tmp_path / "in"
    landing.mkdir()
    kinds = ["start", "start", "fetched", "fetched", "failed", "other", None]
    events = [event(rng.choice("abcdefgh"), rng.choice(kinds), rng.choice(["p", "q", "r", None]), rng.choice([None, 1, 2]), at=f"10:{rng.randrange(60):02d}", error=rng.choice([None, "e"])) for _ in range(200)]
    events += [event(j, "cancel", at=f"10:{m}") for j, m in (("a", 10), ("b", 40), ("b", 50))] + [event(None, "start", "p"), event("i", "start", "p"), event("j", "cancel")]
    (landing / "1.json").write_text("\n".join(map(json.dumps, events)))
    rows = jobs.progressed(rocks.readStream.schema(jobs.EVENTS).json(str(landing)), idle_seconds=None)
    rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    told = lambda df: sorted(map(repr, df.select("job_id", "source", "papers_fetched", "total_papers", "is_complete", "status", "error").collect()))
    want = told(jobs.progressed(rocks.read.schema(jobs.EVENTS).json(str(landing))))
    assert told(rocks.read.parquet(str(tmp_path / "out"))) == want and len(want) > 20
