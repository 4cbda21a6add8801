"""Streams with state against their batch forms, on shuffled files."""

import random
import time
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vacantia.operators.lifecycle import miss_counts
from vacantia.streaming import events as ev
from vacantia.streaming import state as st
from vacantia.streaming.run import run_available, state_in_rocksdb
from vacantia.streaming.store import KeyedStore, Merge

pytestmark = pytest.mark.usefixtures("few_partitions")
T0 = datetime(2026, 8, 1)
EVENTS = "user_id string, ts timestamp, event_id long"


def shuffled(spark, rows, schema, folder, files, seed=1):
    """A stream over the rows, one file a batch, in any order."""
    random.Random(seed).shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_violations_in_any_order(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "a", "c"]), T0 + timedelta(seconds=r.randrange(5000), microseconds=r.choice([0, 0, 1])), k) for k in range(900)]
    last = [("end", T0 + timedelta(days=5), 10_000)]
    stream = shuffled(spark, rows, EVENTS, str(tmp_path / "in"), 5)
    spark.createDataFrame(last, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_available(st.stream_violations(stream, 60, 4, "user_id", late="2 days"))
    want = ev.rate_violations(spark.createDataFrame(rows, EVENTS), 60, 4, "user_id")
    key = lambda df: sorted(map(tuple, df.select("user_id", "event_id", "ts", "in_window").collect()))
    assert key(got) == key(want) and len(key(want)) > 100


class OneKey:
    """The state and timers of one key, and how often a processor turned to them."""

    def __init__(self):
        self.rows, self.timers, self.calls = {}, set(), 0

    def getMapState(self, *_, **__):
        called = lambda f: lambda *a: (setattr(self, "calls", self.calls + 1), f(*a))[1]
        return SimpleNamespace(updateValue=called(self.rows.__setitem__), removeKey=called(self.rows.pop), iterator=called(lambda: iter(list(self.rows.items()))))

    def getValueState(self, *_, **__):
        was = []
        return SimpleNamespace(exists=lambda: bool(was), get=lambda: was[0], update=lambda v: was.__setitem__(slice(None), [v]), clear=was.clear)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_violations_settle_all_buckets_of_a_key_at_once(spark):
    """The calls to the state grow with batches and not with the buckets that a key's events lie in, and no state is left."""
    r, handle, rate = random.Random(7), OneKey(), st._Rate(60_000_000, 2, "user_id", "bigint")
    rate.init(handle)
    at, got = [r.randrange(300 * 60) * 1_000_000 + r.randrange(2) for _ in range(900)], []
    for k, watermark in enumerate((0, 7_000_000, 60_000_000_000)):
        batch = pd.DataFrame({"ts": pd.to_datetime([t for j, t in enumerate(at) if j % 3 == k and t >= 7_000_000_000 * (k == 2)], unit="us"), "event_id": [j for j, t in enumerate(at) if j % 3 == k and t >= 7_000_000_000 * (k == 2)]})
        rate.handleInputRows(("a",), iter([batch]), None)
        while due := sorted(t for t in handle.timers if t <= watermark):
            handle.timers.discard(due[0])
            now = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w)
            got += [x for df in rate.handleExpiredTimer(("a",), now, SimpleNamespace(getExpiryTimeInMs=lambda d=due[0]: d)) for x in zip(df["event_id"], df["in_window"], strict=True)]
    seen = [(j, t) for j, t in enumerate(at) if j % 3 < 2 or t >= 7_000_000_000]
    want = [(j, n) for j, t in seen if (n := sum(t - 60_000_000 < u <= t for _, u in seen)) > 2]
    assert sorted(got) == want and want and not handle.rows and not handle.timers
    assert handle.calls < 30


def test_fresh_verdicts_in_any_order(spark, tmp_path):
    r = random.Random(4)
    schema = "job_id long, ts timestamp, check_id long, verdict string"
    rows = [(r.randrange(40), T0 + timedelta(minutes=r.randrange(200)), k, r.choice(["open", "closed", "unknown"])) for k in range(300)]
    changes = run_available(st.stream_fresh(shuffled(spark, rows, schema, str(tmp_path / "in"), 6), 30, late="1 day"), "update")
    now = T0 + timedelta(minutes=200)
    want = ev.fresh_status(spark.createDataFrame(rows, schema), F.lit(now))
    assert sorted(map(tuple, st.fresh_at(changes, F.lit(now)).collect())) == sorted(map(tuple, want.collect())) != []


def test_verdicts_end_with_the_watermark(spark, tmp_path):
    schema = "job_id long, ts timestamp, check_id long, verdict string"
    for k, (job, minute, verdict) in enumerate([(1, 0, "open"), (2, 10, "open"), (1, 5, "closed"), (3, 41, "open"), (3, 42, "unknown")]):
        spark.createDataFrame([(job, T0 + timedelta(minutes=minute), k, verdict)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = run_available(st.stream_fresh(stream, 30, late="1 minute"), "update")
    assert sorted(r.job_id for r in changes.where("verdict is null").collect()) == [1, 2]  # the watermark ends at minute 41
    assert {r.job_id: r.verdict for r in st.fresh_at(changes, F.lit(T0 + timedelta(minutes=36))).collect()} == {2: "open", 3: "unknown"}


def test_verdicts_by_the_machines_clock(spark, tmp_path):
    schema = "job_id long, ts timestamp, check_id long, verdict string"
    spark.createDataFrame([(1, T0, 1, "open"), (1, T0, 2, "closed"), (2, T0, 1, "open")], schema).write.parquet(str(tmp_path / "in"))
    stream = st.stream_fresh(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 30, by_events=False)
    found, until = [], time.time() + 60
    with state_in_rocksdb(spark):
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).start()
    try:  # such a stream looks for what has expired until it is stopped
        while len(found) < 2 and time.time() < until:
            time.sleep(0.2)
    finally:
        q.stop()
    assert sorted((r.job_id, r.verdict) for r in found) == [(1, "closed"), (2, "open")]


OBS = "job_id long, obs_id long, is_official boolean, verified_at timestamp, title string, location string"
FIELDS = ("title", "location")


def folded(rows):
    """Observations merged one after the other in the order of their times."""
    out = {}
    for job, _, official, at, *said in sorted(rows, key=lambda r: (r[3], r[1])):
        had, since = out.get(job, (["", ""], None))
        new = [(n or h or "") if official else (h or n or "") for h, n in zip(had, said, strict=True)]
        # What an official one has said is never filled from elsewhere, and others never replace.
        out[job] = (new, at if official else since)
    return out


def test_merging_observations_in_any_order(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.randrange(30), k, r.choice([True, False, None]), T0 + timedelta(minutes=r.randrange(300)), r.choice(["", None, f"t{k}"]), r.choice(["", f"l{k}"])) for k in range(400)]
    # An official value replaces what others said; fold by official last to see it.
    want = {}
    for job in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == job), key=lambda x: (x[3], x[1]))
        value = lambda k, mine=mine: next((x[4 + k] for x in reversed(mine) if x[2] and x[4 + k]), next((x[4 + k] for x in mine if not x[2] and x[4 + k]), ""))
        want[job] = (value(0), value(1), max((x[3] for x in mine if x[2]), default=None))
    assert {j: (a, b, t) for j, ((a, b), t) in folded(rows).items()} == want
    table = st.merge_observations(spark.createDataFrame(rows, OBS), "job_id", FIELDS)
    assert {x.job_id: tuple(x)[1:] for x in table.collect()} == want
    stream = st.merge_observations(shuffled(spark, rows, OBS, str(tmp_path / "in"), 5), "job_id", FIELDS)
    store = KeyedStore(spark, str(tmp_path / "store"), "job_id long, title string, location string, verified_at timestamp, batch long", ["job_id"], Merge(("batch",)), buckets=4)
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: store.upsert(df.withColumn("batch", F.lit(n).cast("long")), n)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {x.job_id: (x.title, x.location, x.verified_at) for x in store.rows().collect()} == want


STORE = "listing_id long, hash string, first_seen_at timestamp, last_seen_at timestamp"


def a_store(spark, path, **more):
    return KeyedStore(spark, str(path), STORE, ["listing_id"], Merge(("last_seen_at",), ("first_seen_at",), ("last_seen_at",)), **{"buckets": 8, "most": 3, **more})


def merged(rows):
    out = {}
    for k, h, first, last in rows:
        was = out.get(k)
        best = (last, h) if was is None else max(was[1], (last, h))
        out[k] = (min(first, was[0]) if was else first, best)
    return {k: (h, first, last) for k, (first, (last, h)) in out.items()}


def seen(df):
    return {r.listing_id: (r.hash, r.first_seen_at, r.last_seen_at) for r in df.collect()}


def test_store_appends_repeats_and_compacts(spark, tmp_path):
    r, store, every = random.Random(6), a_store(spark, tmp_path), []
    assert store.rows().count() == 0
    for n in range(12):
        at = T0 + timedelta(hours=r.randrange(50))
        rows = [(r.randrange(60), f"h{n}", at, at) for _ in range(15)]
        every += rows
        df = spark.createDataFrame(rows, STORE)
        assert store.upsert(df, n) and not store.upsert(df, n) and not store.upsert(df, n - 1)
        assert seen(store.rows()) == merged(every)
    assert len(store.versions()) <= 2 and max(map(len, store.manifest()["buckets"].values())) <= 4
    only = store.touched(spark.createDataFrame([(1,)], "listing_id long"))
    assert 0 < store.rows(only).count() < store.rows().count()
    assert len(store.files.names("data")) <= 12


def test_store_writes_what_the_batch_has(spark, tmp_path):
    store = a_store(spark, tmp_path, most=100)
    store.upsert(spark.range(5000).select(F.col("id").alias("listing_id"), F.md5(F.col("id").cast("string")).alias("hash"), F.lit(T0).alias("first_seen_at"), F.lit(T0).alias("last_seen_at")), 0)
    size = lambda: sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    before = size()
    store.upsert(spark.createDataFrame([(7, "new", T0, T0 + timedelta(1))], STORE), 1)
    assert size() - before < before / 20
    assert store.rows().where("listing_id = 7").first().hash == "new" and store.rows().count() == 5000


def test_store_survives_a_batch_that_dies(spark, tmp_path, monkeypatch):
    store = a_store(spark, tmp_path)
    row = lambda k, h: spark.createDataFrame([(k, h, T0, T0)], STORE)
    store.upsert(row(1, "a"), 0)
    with monkeypatch.context() as m:
        m.setattr(type(store.files), "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.upsert(row(2, "b"), 1)
    assert seen(store.rows()).keys() == {1}
    assert store.upsert(row(2, "b"), 1) and seen(store.rows()).keys() == {1, 2}
    orphans = len(store.files.names("data"))
    store.sweep()
    assert len(store.files.names("data")) == orphans - 1 and seen(store.rows()).keys() == {1, 2}
    first, second = a_store(spark, tmp_path), a_store(spark, tmp_path)
    stale = second.manifest()
    first.upsert(row(3, "c"), 2)
    monkeypatch.setattr(second, "manifest", lambda: stale)
    with pytest.raises(FileExistsError):
        second.upsert(row(4, "d"), 2)
    assert seen(first.rows()).keys() == {1, 2, 3}


def test_late_sightings_and_closure(spark, tmp_path):
    """Sightings and runs in any order: only complete runs close, and an older sighting that comes late changes nothing."""
    r = random.Random(8)
    sightings = [(r.randrange(3), r.randrange(20), r.randrange(12)) for _ in range(150)]
    runs = [(c, n, r.random() < 0.6) for c in range(3) for n in range(12)]
    s, q = "connector_id long, listing_id long, run_no long", "connector_id long, run_no long, complete boolean"
    seen_ = KeyedStore(spark, str(tmp_path / "seen"), s, ["connector_id", "listing_id"], Merge((), greatest=("run_no",)), buckets=4)
    ran = KeyedStore(spark, str(tmp_path / "ran"), q, ["connector_id", "run_no"], Merge(("complete",)), buckets=2)
    for store, stream, name in ((seen_, shuffled(spark, list(sightings), s, str(tmp_path / "s"), 4), "a"), (ran, shuffled(spark, list(runs), q, str(tmp_path / "r"), 3), "b")):
        stream.writeStream.foreachBatch(store.sink()).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    got = miss_counts(seen_.rows(), ran.rows()).collect()
    want = miss_counts(spark.createDataFrame(sightings, s), spark.createDataFrame(runs, q)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {x.active for x in got} == {True, False}


@pytest.mark.parametrize("folded", [0, 5, 10_000])
def test_cooldown_of_hot_keys(spark, folded):
    r = random.Random(11)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), T0 + timedelta(seconds=r.randrange(4000) * r.choice([1, 1, 20])), k) for k in range(900)] + [("few", T0, 1), ("few", T0, 0), ("few", T0 + timedelta(days=400), 2)]
    want = []
    for key in {x[0] for x in rows}:
        last = None
        for _, at, k in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2])):
            if last is None or at - last >= timedelta(seconds=60):
                last = at
                want.append((key, at, k))
    got = ev.cooldown(spark.createDataFrame(rows, EVENTS).repartition(5), 60, "user_id", folded)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and got.columns == ["user_id", "ts", "event_id"]


def test_outbox_against_a_fold(spark):
    r = random.Random(12)
    jobs = [(k, T0) for k in range(40)] + [(3, T0 - timedelta(days=1)), (99, T0)]
    tries = [(r.choice([0, 0, r.randrange(45)]), T0 + timedelta(seconds=r.randrange(6000)), k, r.choice(["error", "error", "error", "ok", "gone"] if k % 3 else ["error"])) for k in range(700)]
    want = {}
    for job in {j for j, _ in jobs}:
        n, status, last = 0, "pending", None
        for _, at, _, outcome in sorted((x for x in tries if x[0] == job), key=lambda x: x[1:3]):
            if status == "pending" and (last is None or at - last >= timedelta(seconds=300)):
                n, last = n + 1, at
                status = "sent" if outcome == "ok" else "failed" if outcome == "gone" or n >= 5 else "pending"
        want[job] = (min(at for j, at in jobs if j == job), status, n)
    got = ev.outbox_final(spark.createDataFrame(jobs, "job_id long, at timestamp"), spark.createDataFrame(tries, "job_id long, ts timestamp, attempt_id long, outcome string"))
    assert {x.job_id: (x.enqueued_at, x.status, x.attempts) for x in got.collect()} == want
    assert {s for _, s, _ in want.values()} == {"sent", "failed", "pending"}
