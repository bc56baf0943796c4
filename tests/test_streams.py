"""Deep pages by an ordinal index; job states kept by a stream."""

import random

from pyspark.sql import functions as F

from sparkloom.operators import jobs, paging
from sparkloom.sources import files
from sparkloom.streaming import events, states


def test_deep_pages_read_only_their_files(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(k, rnd.choice(["a", "b", None]), rnd.random()) for k in range(5000)]
    df = spark.createDataFrame(rows, "id long, kind string, score double").repartition(7)
    index = paging.OrdinalIndex.write(df, [F.col("kind").asc_nulls_last(), F.desc("score")], 400, str(tmp_path))
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", -r[2]))
    assert index.total() == 5000
    for limit, offset in ((10, 0), (50, 4321), (3, 4999), (10, 5000), (0, -5), (900, 100)):
        got = index.page(limit, offset)
        low = max(0, offset)
        assert [tuple(r)[:3] for r in got.collect()] == want[low : low + max(1, limit)]
        files = {r[0] for r in got.select(F.input_file_name()).collect()}
        assert len(files) <= 2 + limit // 100
    again = paging.OrdinalIndex(spark, index.path)
    assert [r.place for r in again.page(5, 2500).collect()] == list(range(2500, 2505))
    assert paging.OrdinalIndex.write(df.limit(0), ["id"], folder=str(tmp_path)).page().count() == 0


def test_states_of_many_jobs_in_one_stream_over_a_restart(spark, tmp_path):
    rnd = random.Random(5)
    kinds = ["signup", "view", "click", "purchase", "error"]
    rows = [(k, rnd.randint(0, 30), rnd.choice(kinds), rnd.random() * 600, "{}") for k in range(600)]
    schema = "event_id long, user_id long, event_type string, value double, props string"
    # without batches that hold no data a run ends; a stream that stays up has them, for its idle timers
    conf = states.STATE_STORE | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)

    def run():
        stream = states.job_states(events.event_stream(spark, str(tmp_path / "in")), 3_600_000)
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)

    try:
        for part in (rows[:250], rows[250:400], rows[400:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            run()  # each a new query that goes on from the checkpoint
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    told = spark.read.parquet(str(tmp_path / "out")).collect()
    latest = {}
    for r in sorted(told, key=lambda r: r.event_id):
        latest[r.job_id] = r
    batch = {}
    status = {"signup": "queued", "view": "running", "click": "running", "purchase": "completed", "error": "failed"}
    for k, user, kind, value, _ in rows:
        n = batch.get(f"job-{user}", (0, 0, 0, 0))[3]
        batch[f"job-{user}"] = (k, status[kind], min(value / 500, 1.0), n + 1)
    assert {j: (r.event_id, r.status, round(r.percent, 9), r.events) for j, r in latest.items()} == {j: (a, b, round(c, 9), d) for j, (a, b, c, d) in batch.items()}
    assert all(r.ended == (r.status in events.TERMINAL) and not r.idle for r in told) and len(told) == len({(r.job_id, r.event_id) for r in told})


def plain_breaker(at, failed, window, threshold, least, cooldown, successes):
    state, recent, opened, good, out = "closed", [], 0.0, 0, []
    for t, bad in zip(at, failed, strict=True):
        refuse = state == "open" and t - opened < cooldown
        if state == "open" and not refuse:
            state, good = "half_open", 0
        if not refuse:
            recent = [*recent, bad][-window:]
            good += not bad
            if bad and (state == "half_open" or (len(recent) >= least and sum(recent) / len(recent) >= threshold)):
                state, opened = "open", t
            elif state == "half_open" and not bad and good >= successes:
                state, recent = "closed", []
        out.append((state, refuse))
    return out


def test_breakers_by_phases_are_breakers_call_by_call(spark):
    rnd = random.Random(1)
    calls, want = [], {}
    for b in range(40):
        n, p = rnd.choice([0, 1, 7, 300]), rnd.choice([0.05, 0.3, 0.45, 0.6, 0.95])
        t, at, failed = 0, [], []
        for _ in range(n):
            t += rnd.choice([0, 1, 5, 40])
            at.append(float(t + (rnd.choice([0, -50, 20]) if b % 3 == 0 else 0)))
            failed.append(rnd.random() < p)
        calls += [(f"b{b}", k, at[k], failed[k]) for k in range(n)]
        want |= {(f"b{b}", k): x for k, x in enumerate(plain_breaker(at, failed, 20, 0.5, 5, 30.0, 2))}
    rnd.shuffle(calls)
    df = spark.createDataFrame(calls, "name string, seq long, at double, failed boolean")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (old, "37"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert {(r.name, r.seq): (r.state, r.refused) for r in jobs.breaker_states(df).collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_names_of_links_in_large_families(spark):
    rnd = random.Random(8)
    stems = [f"scan-{k}" for k in range(1, 200)] + ["report"] * 60 + ["a", "a-1", "a", "a-1-1", "a-2", "a", "a-1"] * 3 + ["b-1", "b-1", "b", "b-1-1-1", "-1", "-1", "c-01", "c", "c"] + ["x.tar"] * 3
    rnd.shuffle(stems)
    paths = [(k, f"/in/{s}{rnd.choice(['.pdf', '.pdf', '.PDF', ''])}") for k, s in enumerate(stems)]
    used, last, want = set(), {}, {}
    for k, path in paths:
        own = path.rsplit("/", 1)[-1]
        cut = own.rfind(".")
        stem, suffix = (own[:cut], own[cut:]) if cut > 0 else (own, "")
        name = stem
        while (name, suffix) in used:
            last[stem, suffix] = last.get((stem, suffix), 0) + 1
            name = f"{stem}-{last[stem, suffix]}"
        used.add((name, suffix))
        want[k] = name + suffix
    df = spark.createDataFrame(paths, "ord long, path string").repartition(3)
    assert {r.ord: r.name for r in files.link_names(df).collect()} == want
