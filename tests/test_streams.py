"""Streams with timers and models of several classes: event by event against plain versions, over one batch and over many."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import learning
from quern.sources.model_store import ModelStore
from quern.streaming import jobs

HOUR = 3600 * 10**6


def written(spark, tmp_path, rows, parts):
    """Events (event_id, us, user, kind, value) as files, oldest first; each is a batch of its own."""
    path = tmp_path / "e"
    for n, part in enumerate(parts(rows)):
        df = spark.createDataFrame(part, "event_id bigint, us bigint, user_id bigint, event_type string, value double")
        df = df.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("").alias("props"))
        df.coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def stream_of(spark, path, one):
    return spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1 if one else 1000).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def events(seed=1, n=400):
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([1, 5, 40, 600]) * HOUR // 10
        rows.append((i, at, rng.randrange(4), rng.choice("xy"), rng.choice([10.0, 20.0, 90.0])))
    return rows


def thirds(rows):
    k = len(rows) // 3
    return [rows[:k], rows[k : 2 * k], rows[2 * k :]]


def trainings(rows, size, wait, rest, window, threshold, late=600 * 10**6):
    """By the rules, user by user."""
    end, out = max(r[1] for r in rows) - late, []
    for user in sorted({r[2] for r in rows}):
        s = None
        for i, t, _, _, v in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            paused = s and s["held"] and sum(s["held"]) > threshold * len(s["held"])
            if s and s["n"] and not paused and s["last"] + wait <= t:
                out.append((user, s["since"], s["batch"], s["n"], s["first"], s["id"], s["last"] + wait, "time"))
                s |= {"batch": s["batch"] + 1, "n": 0, "last": s["last"] + wait}
            if not s or t - s["seen"] >= rest:
                s = {"held": [], "since": t, "batch": 0, "n": 0, "last": t, "first": 0}
            s["held"] = [*s["held"], int(v > 60)][-window:]
            s |= {"seen": t, "id": i, "first": s["first"] if s["n"] else i, "n": s["n"] + 1}
            if sum(s["held"]) <= threshold * len(s["held"]) and (s["n"] >= size or t - s["last"] >= wait):
                out.append((user, s["since"], s["batch"], s["n"], s["first"], i, t, "count" if s["n"] >= size else "time"))
                s |= {"batch": s["batch"] + 1, "n": 0, "last": t}
        if s["n"] and sum(s["held"]) <= threshold * len(s["held"]) and s["last"] + wait < end:
            out.append((user, s["since"], s["batch"], s["n"], s["first"], s["id"], s["last"] + wait, "time"))
    return sorted(out)


@pytest.mark.parametrize("one", [False, True])
def test_trainings_by_number_time_and_drift(spark, tmp_path, one):
    rows = events()
    path = written(spark, tmp_path, rows, thirds)
    job = jobs.scheduled_training(stream_of(spark, path, one), 60.0, 5, 20 * 3600, 60 * 3600, window=6, threshold=0.5)
    got = sorted(map(tuple, jobs.drain(job).collect()))
    want = trainings(rows, 5, 20 * HOUR, 60 * HOUR, 6, 0.5)
    assert got == want and {r[-1] for r in want} == {"count", "time"} and max(r[3] for r in want) > 5 and len({r[1] for r in want}) > 4


def test_users_and_pairs_are_forgotten(spark, tmp_path):
    rows = events(2, 60)
    rows += [(1000, rows[-1][1] + 10**6 * HOUR, 99, "x", 1.0), (1001, rows[-1][1] + 10**6 * HOUR + 1, 99, "x", 1.0)]
    path = written(spark, tmp_path, rows, lambda r: [r])
    for job, kept in ((jobs.scheduled_training(stream_of(spark, path, False), 60.0, 5, 3600, 7200), 1), (jobs.decaying_pairs(stream_of(spark, path, False), 0.5), 1)):
        query = job.writeStream.format("noop").option("checkpointLocation", str(tmp_path / f"c{id(job)}")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1] == kept


@pytest.mark.parametrize("one", [False, True])
def test_pairs_decay_and_fall(spark, tmp_path, one):
    rows = events(3)
    path = written(spark, tmp_path, rows, thirds)
    got = sorted(((r.user_id, r.event_type, r.at, -1 if r.event_id is None else r.event_id, round(r.score, 9)) for r in jobs.drain(jobs.decaying_pairs(stream_of(spark, path, one), 0.25)).collect()))
    want, half, end = [], 6 * HOUR, max(r[1] for r in rows) - 600 * 10**6
    for pair in {(r[2], r[3]) for r in rows}:
        score, last = 0.0, 0
        for i, t, u, k, _ in rows:
            if (u, k) == pair:
                fall = last + math.ceil(half * math.log2(score / 0.01)) if score else 0
                if score and fall <= t:
                    want.append((*pair, fall, -1, 0.0))
                    score = 0.0
                score, last = score * 2.0 ** ((last - t) / half) + 1.0, t
                want.append((*pair, t, i, round(score, 9)))
        if (fall := last + math.ceil(half * math.log2(score / 0.01))) < end:
            want.append((*pair, fall, -1, 0.0))
    assert got == sorted(want) and sum(r[3] == -1 for r in want) > 5


def samples(spark, tmp_path, dim, n=95):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((3, dim)) * 2
    rows = [(int(i % 2), int(i), (centres[i % 3] + rng.standard_normal(dim) * 0.5).tolist(), int(i % 3)) for i in range(n)]
    rows += [(0, 1000, None, 1), (0, 1001, [1.0], 1), (1, 1002, rows[0][2], None), (5, 1, [0.0] * dim, 0)]
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, "key bigint, id bigint, x array<double>, label int").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    return rows, spark.readStream.schema("key bigint, id bigint, x array<double>, label int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s*")


@pytest.mark.parametrize("kind", ["logistic", "passive_aggressive", "kmeans"])
def test_models_of_several_classes(spark, tmp_path, kind):
    rows, stream = samples(spark, tmp_path, 64)
    out = jobs.drain(jobs.online_classifier(stream, kind, 3, size=10), "update")
    last = {r["key"]: r for r in out.orderBy("_batch").collect()}
    for key in (0, 1, 5):
        own = [(x, -1 if y is None else y) for k, i, x, y in sorted(rows, key=lambda r: r[1]) if k == key and x is not None and len(x) == 64]
        w, b, sizes = np.zeros((3, 64)), np.zeros(3), [0, 0, 0]
        full = len(own) // 10 * 10
        for lo in range(0, full, 10):
            part = own[lo : lo + 10]
            if kind == "logistic":
                g = [[(float(y == c) - 1 / (1 + math.exp(-(np.dot(w[c], x) + b[c])))) for c in range(3)] for x, y in part]
                for c in range(3):
                    w[c] = w[c] + 0.5 * sum(g[i][c] * np.array(x) for i, (x, _) in enumerate(part)) / 10
                    b[c] += 0.5 * sum(r[c] for r in g) / 10
            elif kind == "passive_aggressive":
                for x, y in part:
                    for c in range(3):
                        side = 1.0 if y == c else -1.0
                        step = min(0.5, max(0.0, 1 - side * (np.dot(w[c], x) + b[c])) / (np.dot(x, x) + 1)) * side
                        w[c], b[c] = w[c] + step * np.array(x), b[c] + step
            else:
                rest = [np.array(x) for x, _ in part]
                while rest and 0 in sizes:
                    w[sizes.index(0)] = rest.pop(0)
                    sizes[sizes.index(0)] = 1
                near = [min(range(3), key=lambda c: (((x - w[c]) ** 2).sum(), c)) for x in rest]
                for c in range(3):
                    mine = [x for x, k in zip(rest, near, strict=True) if k == c]
                    if mine:
                        w[c] = (w[c] * sizes[c] + sum(mine)) / (sizes[c] + len(mine))
                        sizes[c] += len(mine)
        assert last[key].n == full and np.allclose(last[key].weights, w) and np.allclose(last[key].bias, b) and last[key].sizes == sizes
    models = out.where("key < 2").groupBy("key").agg(F.max_by(F.struct("kind", "n", "weights", "bias", "sizes"), "_batch").alias("m")).select("key", "m.*")
    asked = spark.createDataFrame([r[:3] for r in rows[:95]], "key bigint, id bigint, x array<double>")
    got = {r.id: r for r in learning.predicted(models, asked).collect()}
    assert all(abs(sum(r.proba) - 1) < 1e-9 and r.label == int(np.argmax(r.proba)) for r in got.values())
    if kind != "kmeans":
        assert sum(got[i].label == i % 3 for i in range(95)) > 85


def test_models_are_stored_in_versions(spark, tmp_path):
    store = ModelStore(spark, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        store.load()
    table = lambda *rows: spark.createDataFrame(rows, "key int, w double")
    read = lambda *v: sorted(map(tuple, store.load(*v).collect()))
    assert [store.save(t) for t in (table((1, 0.1), (2, 0.2)), table((1, 1.1)), table((3, 3.3)))] == [0, 1, 2]
    assert read() == [(1, 1.1), (2, 0.2), (3, 3.3)] and read(0) == [(1, 0.1), (2, 0.2)]
    store.rollback(0)
    assert read() == [(1, 0.1), (2, 0.2), (3, 3.3)] and store.versions() == [0, 1, 2, 3]
    assert store.thin(2) == [0, 1] and store.versions() == [2, 3] and read() == [(1, 0.1), (2, 0.2), (3, 3.3)]


def test_pairs_get_no_columns_that_they_do_not_need(spark):
    stream = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet*")
    plan = jobs.decaying_pairs(stream, 0.25)._jdf.queryExecution().analyzed().children().head()
    assert sorted(a.name() for a in map(plan.output().apply, range(plan.output().size()))) == ["event_id", "event_type", "ts", "us", "user_id"]
