"""Streaming jobs: replays, late rows, persistent gaps and re-opened entries."""

from pyspark.sql import functions as F

from curator.streaming import core, jobs


def feed(spark, folder, rows, schema, step):
    """Add one landed file to the input folder of a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={step}")


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def test_ingest_replay_and_conflict(spark, tmp_path):
    schema, folder, out = "run_id string, content string", str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: jobs.stream_ingest(source(spark, folder, schema), out, str(tmp_path / "cp"), "run_id", "content")
    feed(spark, folder, [("a", "1"), ("b", "1")], schema, 0)
    run()
    feed(spark, folder, [("a", "1"), ("b", "2"), ("c", "1")], schema, 1)
    run()
    run()
    log = sorted((r["run_id"], r["content"]) for r in spark.read.parquet(f"{out}/log").collect())
    assert log == [("a", "1"), ("b", "1"), ("c", "1")]
    assert [tuple(r)[:3] for r in spark.read.parquet(f"{out}/conflicts").select("run_id", "content", "recorded_hash").collect()] == [("b", "2", "1")]


def test_earlier_discovery_wins_later(spark, tmp_path):
    schema, folder, out = "id string, seen int", str(tmp_path / "in"), str(tmp_path / "out")
    for step, rows in enumerate(([("a", 5), ("b", 7)], [("a", 3)], [("a", 9)])):
        feed(spark, folder, rows, schema, step)
        jobs.stream_first_seen(source(spark, folder, schema), out, str(tmp_path / "cp"), ["id"], "seen")
    assert {r["id"]: r["seen"] for r in core.latest_rows(spark, out, ["id"]).collect()} == {"a": 3, "b": 7}


def test_gap_persists_until_closed(spark, tmp_path):
    schema = "source_id string, polled_at string, entries array<struct<key:string,published_at:string>>, backfilled boolean"
    # Every feed reaches back to the first day, so only the overlap decides.
    poll = lambda day, keys, backfilled=False: ("s", f"2024-01-{day:02d}T12:00:00Z", [(k, "2024-01-01T00:00:00Z") for k in keys], backfilled)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    days = ([poll(1, ["k1"])], [poll(2, ["k2", "k1"]), poll(3, ["k9"])], [poll(4, ["k10", "k9"])], [poll(5, ["k11"], True)], [poll(6, ["k12", "k11"])])
    for step, rows in enumerate(days):
        feed(spark, folder, rows, schema, step)
        jobs.stream_gaps(source(spark, folder, schema), out, str(tmp_path / "cp"))
    got = [(r["has_gap"], r["reason"]) for r in spark.read.parquet(out).orderBy("polled_at").collect()]
    assert got == [
        (False, ""), (False, ""), (True, "no_ledger_overlap"), (True, "no_ledger_overlap"),  # k10 does not overlap the old anchor k2
        (False, ""), (False, ""),
    ]


def test_lifecycle_reopens(spark, tmp_path):
    schema = "release_key string, seq long, event string, verdict string, policy_version string, content_hash string, item_type string"
    record = lambda seq, verdict="pending_review", policy="1", content="h", kind="release": ("k", seq, "record", verdict, policy, content, kind)
    decide = lambda seq, verdict: ("k", seq, "decision", verdict, None, None, None)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    steps = (
        [record(1), decide(2, "accept")], [record(3)], [record(4, policy="2")], [decide(5, "reject"), decide(6, "accept")],
        [record(7, policy="2", content="new", kind="security")], [record(8, "withdrawn", "2", "newer", "security")],
    )
    for step, rows in enumerate(steps):
        feed(spark, folder, rows, schema, step)
        jobs.stream_ledger(source(spark, folder, schema), out, str(tmp_path / "cp"))
    got = [(r["seq"], r["status"]) for r in spark.read.parquet(out).orderBy("seq").collect()]
    assert got == [(1, "pending_review"), (2, "accepted"), (4, "pending_review"), (5, "rejected"), (7, "pending_review"), (8, "withdrawn")]


def test_late_rows_reach_their_period(spark, tmp_path):
    schema, folder, out = "at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    for step, text in enumerate(("2024-02-10 00:00:00", "2024-03-10 00:00:00", "2024-01-31 17:00:00")):
        feed(spark, folder, [(1,)], "x int", f"raw{step}")
        spark.range(1).select(F.lit(text).cast("timestamp").alias("at")).coalesce(1).write.parquet(f"{folder}/part={step}")
        jobs.stream_periods(spark.readStream.schema(schema).parquet(f"{folder}/part=[0-9]"), out, str(tmp_path / "cp"), "at", "monthly")
    assert {r["period"]: r["n"] for r in core.latest_rows(spark, out, ["period"]).collect()} == {"2024-02": 2, "2024-03": 1}


def test_notices_by_meaning(spark, tmp_path):
    schema, folder, out = "issue_key string, items array<string>, failures array<string>", str(tmp_path / "in"), str(tmp_path / "out")
    for step, rows in enumerate(([("w", ["b", "a"], [])], [("w", ["a", "b", "a"], [])], [("w", ["a"], ["x"]), ("v", ["a", "b"], [])])):
        feed(spark, folder, rows, schema, step)
        jobs.stream_notices(source(spark, folder, schema), out, str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 3


def many(n, seed=3):
    import random

    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def test_ingest_over_many_batches_reads_no_log(spark, tmp_path):
    import shutil

    schema, folder, out = "content string, run_id long, note string", str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: jobs.stream_ingest(source(spark, folder, schema), out, str(tmp_path / "cp"), "run_id", "content")
    row = lambda i, content: (content, i, f"n{i}")
    feed(spark, folder, [row(i, "a") for i in range(50)] + [row(None, "x"), row(99, None)], schema, 0)
    run()
    feed(spark, folder, [row(i, "b" if i % 2 else "a") for i in range(60)], schema, 1)
    feed(spark, folder, [row(7, "c"), row(7, "d"), row(7, "a"), row(70, "z"), row(70, "y"), row(70, "y"), row(None, "x"), row(None, "w")], schema, 2)
    run()
    conflicts = sorted(map(tuple, spark.read.parquet(f"{out}/conflicts").select("run_id", "content", "recorded_hash").collect()), key=str)
    want = [(i, "b", "a") for i in range(1, 50, 2)] + [(7, "c", "a"), (7, "d", "a"), (70, "z", "y"), (None, "w", "x")]
    assert conflicts == sorted(want, key=str)
    log = {(r.run_id, r.content, r.note) for r in spark.read.parquet(f"{out}/log").collect()}
    assert log == {(i, "a", f"n{i}") for i in range(50)} | {(i, "b" if i % 2 else "a", f"n{i}") for i in range(50, 60)} | {(70, "y", "n70"), (None, "x", "nNone")}
    # The log may be moved away: what a key held is in the state.
    shutil.move(f"{out}/log", str(tmp_path / "kept"))
    feed(spark, folder, [row(3, "q"), row(3, "a")], schema, 3)
    run()
    assert not [r for r in spark.read.schema(schema).parquet(f"{out}/log").collect()]
    assert (3, "q", "a") in {tuple(r)[:3] for r in spark.read.parquet(f"{out}/conflicts").select("run_id", "content", "recorded_hash").collect()}


def test_the_polls_of_a_source_are_folded_in_pieces(spark, tmp_path):
    schema = "source_id string, polled_at string, entries array<struct<key:string,published_at:string>>, backfilled boolean"
    at = lambda i: f"2024-01-{1 + i // 1440:02d}T{i // 60 % 24:02d}:{i % 60:02d}:00Z"
    # Every tenth poll overlaps nothing; the next one overlaps the last closed poll again.
    keys = lambda i: [f"lost{i}"] if i % 10 == 5 else [f"k{i}", f"k{i - 1}", f"k{i - 2}"]
    rows = [("s", at(i), [(k, "2024-01-01T00:00:00Z") for k in keys(i)], False) for i in many(3000)]
    found = []
    for name, held in (("small", 100), ("large", None)):
        folder, out = str(tmp_path / f"in-{name}"), str(tmp_path / f"out-{name}")
        feed(spark, folder, rows, schema, 0)
        jobs.stream_gaps(source(spark, folder, schema), out, str(tmp_path / f"cp-{name}"), held)
        found.append([(r.polled_at, r.has_gap) for r in spark.read.parquet(out).orderBy("polled_at").collect()])
    assert found[0] == found[1] and [g for _, g in found[0]] == [i % 10 == 5 for i in range(3000)]


def test_a_late_poll_moves_nothing(spark, tmp_path):
    schema = "source_id string, polled_at string, entries array<struct<key:string,published_at:string>>, backfilled boolean"
    poll = lambda day, keys: ("s", f"2024-01-{day:02d}T12:00:00Z", [(k, "2024-01-01T00:00:00Z") for k in keys], False)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for step, rows in enumerate(([poll(5, ["k5"])], [poll(3, ["k5", "k3"])], [poll(6, ["k6", "k5"])])):
        feed(spark, folder, rows, schema, step)
        jobs.stream_gaps(source(spark, folder, schema), out, str(tmp_path / "cp"))
    assert [r.has_gap for r in spark.read.parquet(out).orderBy("polled_at").collect()] == [False, False, False]


def test_the_rows_of_a_release_are_folded_in_pieces(spark, tmp_path):
    schema = "release_key string, seq long, event string, verdict string, policy_version string, content_hash string, item_type string"
    rows = [("k", i, "record", "pending_review" if i % 2 else "filtered", str(i), "h", "release") for i in many(5000)]
    rows.append(("other", 1, "record", "filtered", "1", "h", "release"))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, folder, rows, schema, 0)
    jobs.stream_ledger(source(spark, folder, schema), out, str(tmp_path / "cp"), 200)
    got = spark.read.parquet(out).where("release_key = 'k'").orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(5000)) and all(r.status == ("pending_review" if r.seq % 2 else "filtered") for r in got)


def test_suppression_by_a_log_that_grows(spark, tmp_path):
    import datetime
    import random

    from curator.operators.filters import cooled_down

    rng, start = random.Random(6), datetime.datetime(2024, 1, 1)
    at = lambda: start + datetime.timedelta(hours=rng.randrange(24 * 60))
    asks = sorted([(i, rng.choice(["a", "b", "c", None]), at()) for i in range(150)], key=lambda r: r[2])
    done = sorted([(rng.choice(["a", "b", "c", None]), at()) for _ in range(12)], key=lambda r: r[1])
    kinds = ("id int, key string, at timestamp", "key string, at timestamp")
    folders, out = [str(tmp_path / n) for n in ("asks", "log")], str(tmp_path / "out")
    last = start + datetime.timedelta(days=300)
    # Both grow in steps; a last row far ahead on each side lets the watermark pass.
    for step in range(4):
        low, high = start + datetime.timedelta(days=15 * step), start + datetime.timedelta(days=15 * (step + 1))
        for folder, rows, kind, key in zip(folders, (asks, done), kinds, (2, 1)):
            feed(spark, folder, [r for r in rows if low <= r[key] < high], kind, step)
        jobs.stream_suppress_growing(*[source(spark, f, k) for f, k in zip(folders, kinds)], out, str(tmp_path / "cp"), "key", "at", 14)
    for step in (4, 5):
        for folder, rows, kind in zip(folders, ([(-step, "end", last)], [("never", last)]), kinds):
            feed(spark, folder, rows, kind, step)
        jobs.stream_suppress_growing(*[source(spark, f, k) for f, k in zip(folders, kinds)], out, str(tmp_path / "cp"), "key", "at", 14)
    want = cooled_down(spark.createDataFrame(asks, kinds[0]), spark.createDataFrame(done, kinds[1]), "key", "at", 14)
    got = [r.id for r in spark.read.parquet(out).where("id >= 0").collect()]
    assert len(got) == len(set(got)) and sorted(got) == sorted(r.id for r in want.collect())
    assert 0 < len(got) < 150


def test_a_notice_may_be_sent_again_after_it_is_forgotten(spark, tmp_path):
    schema, folder, out = "issue_key string, items array<string>, failures array<string>, at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    import datetime

    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    for step, n in enumerate((0, 1, 3, 40, 41)):
        feed(spark, folder, [("w", ["a"], [], day(n)), (f"other{n}", ["a"], [], day(n))], schema, step)
        jobs.stream_notices(source(spark, folder, schema), out, str(tmp_path / "cp"), "at", "7 days")
    assert spark.read.parquet(out).where("issue_key = 'w'").count() == 2


def test_keys_of_one_bucket_keep_their_own_state(spark, tmp_path, monkeypatch):
    # One bucket for all keys: one call of Python handles them, and each has its own entry.
    monkeypatch.setattr(jobs, "BUCKETS", 1)
    schema, folder, out = "run_id long, content string", str(tmp_path / "in"), str(tmp_path / "out")
    steps = ([(i, c) for i in range(40) for c in ("m", "k")], [(i, "k" if i % 2 else "z") for i in range(80)], [(None, "a"), (41, "k"), (2, "k"), (2, "z")])
    for step, rows in enumerate(steps):
        feed(spark, folder, rows, schema, step)
        jobs.stream_ingest(source(spark, folder, schema), out, str(tmp_path / "cp"), "run_id", "content")
    log = sorted(map(tuple, spark.read.parquet(f"{out}/log").select("run_id", "content").collect()), key=str)
    assert log == sorted([(i, "k") for i in range(40)] + [(i, "k" if i % 2 else "z") for i in range(40, 80)] + [(None, "a")], key=str)
    conflicts = sorted(map(tuple, spark.read.parquet(f"{out}/conflicts").select("batch", "run_id", "content", "recorded_hash").collect()))
    assert conflicts == [(0, i, "m", "k") for i in range(40)] + [(1, i, "z", "k") for i in range(0, 40, 2)] + [(2, 2, "z", "k")]


def test_releases_of_one_bucket_keep_their_own_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 1)
    schema = "release_key string, seq long, event string, verdict string, policy_version string, content_hash string, item_type string"
    record = lambda key, seq, verdict="pending_review", policy="1": (key, seq, "record", verdict, policy, "h", "release")
    steps = (
        [record(f"k{i}", i) for i in range(30)] + [record(None, 5)], [(f"k{i}", 100 - i, "decision", "accept", None, None, None) for i in range(0, 30, 2)],
        [record(f"k{i}", 200, "filtered") for i in range(30)] + [record(None, 200, "filtered", "2")])
    got = []
    for held in (None, 7):
        folder, out = str(tmp_path / f"in{held}"), str(tmp_path / f"out{held}")
        for step, rows in enumerate(steps):
            feed(spark, folder, rows, schema, step)
            jobs.stream_ledger(source(spark, folder, schema), out, str(tmp_path / f"cp{held}"), held)
        got.append(sorted(map(tuple, spark.read.parquet(out).collect()), key=str))
    want = [(f"k{i}", i, "pending_review", "1") for i in range(30)] + [(None, 5, "pending_review", "1"), (None, 200, "filtered", "2")]
    want += [(f"k{i}", 100 - i, "accepted", "1") for i in range(0, 30, 2)] + [(f"k{i}", 200, "filtered", "1") for i in range(1, 30, 2)]
    assert got[0] == got[1] == sorted(want, key=str)
