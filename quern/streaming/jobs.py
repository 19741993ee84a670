"""Streams over events: drift, decayed scores, batch triggers and windows. Each reads a folder of Parquet as a stream and runs until its input is used up."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of events; timestamps with the session's zone, as watermarks need them. A glob, since a stream takes a plain path for a folder."""
    return spark.readStream.schema(EVENTS).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; without one a temporary folder if all executors are on this machine, else an error."""
    to = spark.conf.get("spark.checkpoint.dir", None)
    if not to and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(to or tempfile.mkdtemp(prefix='quern-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream until its input is used up, into Parquet with checkpoints in the shared folder; what it wrote."""
    spark, to = stream.sparkSession, shared_dir(stream.sparkSession)
    if mode == "append":
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{to}/rows").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    else:  # updates: every batch's rows with its number, of which the last counts
        def put(batch: DataFrame, n: int) -> None:
            batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{to}/rows/_b={n}")

        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    schema = stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{to}/rows")


def error_drift(stream: DataFrame, limit: float, window: int = 50, threshold: float = 0.3) -> DataFrame:
    """(user_id, event_id, error_rate, drift): error rate of each user's last so many events, kept as state; events of a batch count in the order of time."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for i, v in zip(rows["event_id"], rows["value"], strict=True):
            held = [*held, int(v > limit)][-window:]
            rate = sum(held) / len(held)
            out.append((key[0], i, rate, rate > threshold))
        state.update((held,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "error_rate", "drift"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, error_rate double, drift boolean", "held array<int>", "append", GroupStateTimeout.NoTimeout)


def page_hinkley(stream: DataFrame, delta: float = 0.005, limit: float = 50.0) -> DataFrame:
    """(user_id, event_id, statistic, drift): the Page-Hinkley test on each user's values; it starts anew after a drift."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, total, least = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for i, v in zip(rows["event_id"], rows["value"], strict=True):
            n += 1
            mean += (v - mean) / n
            total += v - mean - delta
            least = min(least, total)
            found = total - least > limit
            out.append((key[0], i, total - least, found))
            if found:
                n, mean, total, least = 0, 0.0, 0.0, 0.0
        state.update((n, mean, total, least))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "statistic", "drift"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, statistic double, drift boolean", "n bigint, mean double, total double, least double", "append", GroupStateTimeout.NoTimeout)


def batch_trigger(stream: DataFrame, size: int = 10, seconds: float = 60.0) -> DataFrame:
    """(user_id, batch, n, first_id, last_id): a row whenever a user has had so many events since the last one, or so many seconds passed between events."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, n, first, start = state.get if state.exists else (0, 0, -1, 0.0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for i, t in zip(rows["event_id"], rows["ts"], strict=True):
            now = t.timestamp()
            if not n:
                first, start = i, now
            n += 1
            if n >= size or now - start >= seconds:
                out.append((key[0], batch, n, first, i))
                batch, n = batch + 1, 0
        state.update((batch, n, int(first), start))
        yield pd.DataFrame(out, columns=["user_id", "batch", "n", "first_id", "last_id"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, batch bigint, n bigint, first_id bigint, last_id bigint", "batch bigint, n bigint, first bigint, start double", "append", GroupStateTimeout.NoTimeout)


def _after(state: GroupState, at_us: int) -> bool:
    """Ask to be called once the watermark has passed a time; false if it has already."""
    ms = -(-at_us // 1000)
    if ms <= state.getCurrentWatermarkMs():
        return False
    state.setTimeoutTimestamp(ms)
    return True


_TRAINED = "user_id bigint, since bigint, batch bigint, n bigint, first_id bigint, last_id bigint, at bigint, reason string"


def scheduled_training(stream: DataFrame, limit: float, size: int = 10, seconds: float = 60.0, idle: float = 86_400.0, window: int = 50, threshold: float = 0.3, late: str = "10 minutes") -> DataFrame:
    """(user_id, since, batch, n, first_id, last_id, at, reason): when each user's samples are trained on: so many of them, or so many seconds since the last training with a sample waiting.

    Values above the limit are errors; while the error rate of the last so many samples is above the threshold, training is
    paused and samples wait. All times are event times in microseconds. The time rule needs no further sample: a timer fires
    when the watermark has passed. A user without a sample for idle seconds (no fewer than seconds) is forgotten, samples
    that wait on a pause included; since is the first sample's time, which tells a user's lives apart.
    """
    wait, rest = int(seconds * 1e6), int(idle * 1e6)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        held, since, batch, n, first, last_id, last, seen = state.get if state.exists else ([], 0, 0, 0, 0, 0, 0, -1)
        held = list(held)

        def paused() -> bool:
            return sum(held) > threshold * len(held)

        def train(at: int, reason: str) -> None:
            nonlocal batch, n, last
            out.append((key[0], since, batch, n, first, last_id, at, reason))
            batch, n, last = batch + 1, 0, at

        if state.hasTimedOut:
            if n and not paused():
                train(last + wait, "time")
        else:
            rows = pd.concat(list(parts)).sort_values(["us", "event_id"])
            for i, v, t in zip(rows["event_id"].tolist(), rows["value"].tolist(), rows["us"].tolist(), strict=True):
                if seen >= 0 and n and not paused() and last + wait <= t:
                    train(last + wait, "time")
                if seen < 0 or t - seen >= rest:
                    held, since, batch, n, last = [], t, 0, 0, t
                seen = t
                held = [*held, int(v > limit)][-window:]
                first, last_id, n = i if not n else first, i, n + 1
                if not paused() and (n >= size or t - last >= wait):
                    train(t, "count" if n >= size else "time")
        waiting = n and not paused()
        if waiting and not _after(state, last + wait):
            train(last + wait, "time")
            waiting = False
        if waiting or _after(state, seen + rest):
            state.update((held, since, batch, n, first, last_id, last, seen))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _TRAINED.split(", ")])

    timed = stream.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(step, _TRAINED, "held array<int>, since bigint, batch bigint, n bigint, first bigint, last_id bigint, last bigint, seen bigint", "append", GroupStateTimeout.EventTimeTimeout)


_PAIR = "user_id bigint, event_type string, event_id bigint, at bigint, score double"


def decaying_pairs(stream: DataFrame, half_life_days: float = 90.0, least: float = 0.01, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_type, event_id, at, score): the decayed number of a pair's events after each one; a row without event_id and with score 0 when it has decayed below the least, after which the pair is forgotten.

    at: event time in microseconds, of the event or of the moment at which the score falls below the least.
    """
    half = half_life_days * 86_400e6
    shortest = math.ceil(half * math.log2(1.0 / least))  # after an event a score is 1 at least

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, last = state.get if state.exists else (0.0, 0)
        ids, times, scores = [], [], []

        def end() -> int:
            return last + math.ceil(half * math.log2(score / least))

        def put(i: int | None, t: int, s: float) -> None:
            ids.append(i)
            times.append(t)
            scores.append(s)

        if state.hasTimedOut:
            put(None, end(), 0.0)
            score = 0.0
        else:
            frames = list(parts)
            us, events_ = (np.concatenate([p[c].to_numpy() for p in frames]) for c in ("us", "event_id"))
            order = np.lexsort((events_, us))
            for i, t in zip(events_[order].tolist(), us[order].tolist(), strict=True):
                if score and t - last >= shortest and end() <= t:
                    put(None, end(), 0.0)
                    score = 0.0
                score, last = score * 2.0 ** ((last - t) / half) + 1.0, t
                put(i if i == i else None, t, score)
        if score and not _after(state, end()):
            put(None, end(), 0.0)
            score = 0.0
        if score:
            state.update((score, last))
        elif state.exists:
            state.remove()
        n = len(ids)  # plain arrays: there is a frame for each of very many pairs
        yield pd.DataFrame({"user_id": np.full(n, key[0], object), "event_type": np.full(n, key[1], object), "event_id": np.array(ids, object), "at": np.array(times, np.int64), "score": np.array(scores, float)}, copy=False)

    timed = stream.select("user_id", "event_type", "event_id", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    return timed.groupBy("user_id", "event_type").applyInPandasWithState(step, _PAIR, "score double, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def decayed(stream: DataFrame, now: str, half_life_days: float = 90.0) -> DataFrame:
    """(user_id, event_type, score): decayed counts as of a time, as a running sum."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("ts")) / 86_400e6
    return stream.groupBy("user_id", "event_type").agg(F.sum(F.pow(F.lit(2.0), -age / half_life_days)).alias("score"))


def hourly(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): counts and sums by hour, with a watermark for late events. Spark's own addition: the other jobs have batch twins."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def online_logistic(stream: DataFrame, rate: float = 0.05, classes_at: float = 50.0) -> DataFrame:
    """(user_id, n, error_rate, w, b): a logistic model for each user, learnt event by event: each value (scaled) is judged before it is learnt from. Label: whether the event's id is even; a stand-in for feedback."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, wrong, w, b = state.get if state.exists else (0, 0, 0.0, 0.0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for i, v in zip(rows["event_id"], rows["value"], strict=True):
            x, y = v / classes_at - 1, float(i % 2 == 0)
            p = 1 / (1 + math.exp(-(w * x + b)))
            wrong += int((p > 0.5) != (y > 0.5))
            n, w, b = n + 1, w + rate * (y - p) * x, b + rate * (y - p)
        state.update((n, wrong, w, b))
        yield pd.DataFrame([(key[0], n, wrong / n, w, b)], columns=["user_id", "n", "error_rate", "w", "b"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, error_rate double, w double, b double", "n bigint, wrong bigint, w double, b double", "update", GroupStateTimeout.NoTimeout)


def passive_aggressive(stream: DataFrame, most: float = 1.0, classes_at: float = 50.0) -> DataFrame:
    """(user_id, n, error_rate, w, b): as online_logistic, but a step is just long enough to put an event at a margin of one, and no longer than most."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, wrong, w, b = state.get if state.exists else (0, 0, 0.0, 0.0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for i, v in zip(rows["event_id"], rows["value"], strict=True):
            x, y = v / classes_at - 1, 1.0 if i % 2 == 0 else -1.0
            margin = y * (w * x + b)
            length = min(most, max(0.0, 1 - margin) / (x * x + 1))
            n, wrong, w, b = n + 1, wrong + int(margin <= 0), w + length * y * x, b + length * y
        state.update((n, wrong, w, b))
        yield pd.DataFrame([(key[0], n, wrong / n, w, b)], columns=["user_id", "n", "error_rate", "w", "b"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, error_rate double, w double, b double", "n bigint, wrong bigint, w double, b double", "update", GroupStateTimeout.NoTimeout)


_MODEL = "key bigint, kind string, n bigint, weights array<array<double>>, bias array<double>, sizes array<bigint>"


def _logistic(w: np.ndarray, b: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, rate: float) -> None:
    """One step along the mean gradient of each class against the others."""
    off = (y[:, None] == np.arange(len(b))) - 1 / (1 + np.exp(-np.clip(x @ w.T + b, -500, 500)))
    w += rate * off.T @ x / len(x)
    b += rate * off.mean(0)


def _aggressive(w: np.ndarray, b: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, rate: float) -> None:
    """Sample by sample, each class against the others: just so far that its margin is one, and no farther than rate times the sample."""
    for xi, yi in zip(x, y, strict=True):
        side = np.where(np.arange(len(b)) == yi, 1.0, -1.0)
        step = np.minimum(rate, np.maximum(0.0, 1 - side * (w @ xi + b)) / (xi @ xi + 1)) * side
        w += step[:, None] * xi
        b += step


def _centres(w: np.ndarray, b: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, rate: float) -> None:
    """Samples go to the centre nearest before this batch (empty ones are filled first, in order); a centre is the mean of what it has met."""
    for xi in x[: int((sizes == 0).sum())]:
        k = int(np.argmax(sizes == 0))
        w[k], sizes[k] = xi, 1
        x = x[1:]
    if len(x):
        near = ((x[:, None, :] - w[None]) ** 2).sum(2).argmin(1)
        for k in np.unique(near):
            own = x[near == k]
            w[k] += (own - w[k]).sum(0) / (sizes[k] + len(own))
            sizes[k] += len(own)


LEARNERS = {"logistic": _logistic, "passive_aggressive": _aggressive, "kmeans": _centres}


def online_classifier(stream: DataFrame, kind: str, classes: int, size: int = 10, rate: float = 0.5) -> DataFrame:
    """(key, kind, n, weights, bias, sizes): a model of several classes for each key, learnt from samples (key, id, x array<double>, label int from 0) in batches of so many, in the order of ids.

    Samples of a batch that isn't full wait in the state. n: samples learnt from; weights: a row for each class, or for each
    centre (kind kmeans, which has sizes and no labels). A sample without x, or of another length, is left out; labels beyond
    the classes, and null, are none of them.
    """
    learn = LEARNERS[kind]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, flat, bias, sizes, waiting, labels = state.get if state.exists else (0, [], [], [], [], [])
        rows = pd.concat(list(parts)).sort_values("id")
        x = [np.asarray(e, float) for e in rows["x"] if e is not None]
        y = [-1 if v is None or v != v else int(v) for v, e in zip(rows["label"], rows["x"], strict=True) if e is not None]
        if not flat and x:
            flat, bias, sizes = [0.0] * (classes * len(x[0])), [0.0] * classes, [0] * classes
        dim = len(flat) // classes
        w, b, c = np.array(flat, float).reshape(classes, dim), np.array(bias, float), np.array(sizes, np.int64)
        x = [*np.array(waiting, float).reshape(-1, dim), *(v for v in x if len(v) == dim)] if dim else []
        y = [*labels, *y]
        full = len(x) // size * size
        for lo in range(0, full, size):
            learn(w, b, c, np.array(x[lo : lo + size]), np.array(y[lo : lo + size]), rate)
        n += full
        rest = np.array(x[full:], float).ravel().tolist()
        state.update((n, w.ravel().tolist(), b.tolist(), c.tolist(), rest, y[full:]))
        yield pd.DataFrame({"key": [key[0]], "kind": [kind], "n": [n], "weights": [w.tolist()], "bias": [b.tolist()], "sizes": [c.tolist()]})

    return stream.groupBy("key").applyInPandasWithState(step, _MODEL, "n bigint, flat array<double>, bias array<double>, sizes array<bigint>, waiting array<double>, labels array<int>", "update", GroupStateTimeout.NoTimeout)


def online_kmeans(stream: DataFrame, k: int = 3) -> DataFrame:
    """(user_id, n, centres): each user's first k values are centres; a later one moves its nearest centre (the first of equally near ones) to the mean of what that has met."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sizes, centres = map(list, state.get) if state.exists else ([], [])
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            if len(centres) < k:
                sizes.append(1)
                centres.append(float(v))
                continue
            j = min(range(k), key=lambda i: abs(v - centres[i]))
            sizes[j] += 1
            centres[j] += (v - centres[j]) / sizes[j]
        state.update((sizes, centres))
        yield pd.DataFrame([(key[0], sum(sizes), centres)], columns=["user_id", "n", "centres"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, centres array<double>", "sizes array<bigint>, centres array<double>", "update", GroupStateTimeout.NoTimeout)
