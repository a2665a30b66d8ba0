"""Structured Streaming jobs over live frames, sessions and requests.

All of them go by the rows' own time. Rows may come in any order within the watermark's
delay; those beyond it are dropped by Spark and counted (``late_rows``). Where order
matters, a key's state has a reorder buffer: rows wait there until the watermark has
passed them, when none before them can come any more, and are then taken in order.
State leaves by event-time timeouts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinelake.functions.labels import SHOTS
from kinelake.operators.segmentation import SEGMENT, Automaton

WATERMARK, SESSION_GAP, FRAME_GAP = "10 minutes", "1 hour", "5 seconds"
SHOT = "session_id string, start_frame int, end_frame int, peak_frame int, trigger_frame int, completion_reason string"
#: An automaton, the last frame it took, what a segment sums up, the latest time seen, and frames that wait.
FRAMES_STATE = (
    "state string, count int, begun int, ended int, trigger int, swing int, peak int, peak_energy double, energy double, last int, "
    "triggers int, highest double, total double, frames int, latest bigint, wait_t array<int>, wait_at array<bigint>, wait_energy array<double>"
)
#: Of each supported shot: results, results with a score, sum of scores; and the latest time seen.
LIVE_STATE = "n array<bigint>, scored array<bigint>, total array<double>, latest bigint"
#: Times of the allowed requests in the window; requests that wait.
REQUEST_STATE = "held array<bigint>, wait_at array<bigint>, wait_id array<bigint>"


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, over the progress that the query keeps."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def _micros(interval: str) -> int:
    """An interval text in microseconds."""
    return int(pd.Timedelta(interval).value // 1000)


def _timed(rows: DataFrame, watermark: str) -> DataFrame:
    """rows with a watermark on ts, and at, ts in microseconds."""
    return rows.withWatermark("ts", watermark).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def _wake(state: GroupState, at: int) -> None:
    """Time out once the watermark (milliseconds) has passed a time (microseconds)."""
    state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs() + 1))


def _rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    return [row for pdf in batches for row in pdf[columns].itertuples(index=False, name=None)]


class _Sequence:
    """Frames of one sequence: those that wait, and the automaton that took the others."""

    def __init__(self, key: str, live: bool, saved: tuple | None) -> None:
        self.key, self.live = key, live
        self.machine = Automaton(saved=tuple(saved[:9]) if saved else None)
        self.last, self.triggers, self.highest, self.total, self.frames, self.latest = saved[9:15] if saved else (-1, 0, 0.0, 0.0, 0, 0)
        self.waiting = {t: (at, e) for t, at, e in zip(*saved[15:18], strict=True)} if saved else {}

    def saved(self) -> tuple:
        held = sorted(self.waiting.items())
        own = (*self.machine.saved(), self.last, self.triggers, self.highest, self.total, self.frames, self.latest)
        return (*own, [t for t, _ in held], [at for _, (at, _) in held], [e for _, (_, e) in held])

    def add(self, t: int, at: int, energy: float) -> None:
        self.latest = max(self.latest, at)
        if t > self.last:
            self.waiting.setdefault(t, (at, energy))

    def take(self, passed: int | None) -> list[tuple]:
        """Take frames that follow the last one or lie before passed, all of them if it is None."""
        m, out = self.machine, []
        for t in sorted(self.waiting):
            at, e = self.waiting[t]
            if passed is not None and at > passed and t != self.last + 1:
                break
            del self.waiting[t]
            _, fired = m.step(t, e)
            self.highest = max(self.highest, e) if self.frames else e
            self.last, self.triggers, self.frames, self.total = t, self.triggers + fired, self.frames + 1, self.total + e
            if fired and self.live:
                out.append((self.key, m.begun, m.ended, m.peak, m.trigger, "stabilized_follow_through"))
                m.begun, m.trigger, m.swing, m.peak, m.peak_energy = -1, -1, 0, -1, 0.0
        return out

    def end(self) -> list[tuple]:
        out, m = self.take(None), self.machine
        forced = m.finish(self.last)
        self.triggers += forced
        found = (m.begun, m.ended, m.peak, m.trigger)
        if self.live:
            return [*out, (self.key, *found, "sequence_end_completion")] if forced else out
        whole = m.begun >= 0 and m.trigger >= 0
        reason = "sequence_end_completion" if forced else "stabilized_follow_through" if self.triggers else "no_shot_detected"
        return [(self.key, *[x if whole and x >= 0 else None for x in found], self.triggers, reason, self.highest, self.total / self.frames)] if self.frames else []


def segment_stream(energy: DataFrame, watermark: str = WATERMARK, gap: str = FRAME_GAP, live: bool = True) -> DataFrame:
    """ST1-ST3, U1: frames (session_id, t, ts, smoothed) to segments, whatever order they come in within the watermark.

    A frame is taken at once if it follows the last one, else when the watermark has
    passed it. A sequence ends when the watermark is gap beyond its latest frame; a
    shot that is under way is completed then, and the state leaves. live gives one row a
    completed shot, when it is completed, and arms the automaton again; without it there is
    one row a sequence, at its end, the same as ``segments`` gives of all its frames.
    A frame number that was taken already is passed over; after the end numbers begin anew.
    """
    quiet = _micros(gap)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        sequence, out = _Sequence(key[0], live, state.get if state.exists else None), []
        if state.exists and sequence.latest + quiet <= passed:
            # Frames that come with the end belong to the next sequence.
            out += sequence.end()
            sequence = _Sequence(key[0], live, None)
        for t, at, e in _rows(batches, ["t", "at", "smoothed"]):
            sequence.add(int(t), int(at), float(e))
        out += sequence.take(passed)
        if sequence.latest:
            state.update(sequence.saved())
            _wake(state, min([sequence.latest + quiet, *(at for at, _ in sequence.waiting.values())]))
        else:
            state.remove()
        made = pd.DataFrame(out, columns=columns)
        yield made if live else made.astype(dict.fromkeys(columns[1:5], "Int32"))

    schema = SHOT if live else SEGMENT.replace("clip_id bigint", "session_id string")
    columns = [field.split()[0] for field in schema.split(", ")]
    timed = _timed(energy, watermark).select("session_id", "t", "smoothed", "ts", "at")
    return timed.groupBy("session_id").applyInPandasWithState(run, schema, FRAMES_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_results(results: DataFrame, watermark: str = WATERMARK, gap: str = SESSION_GAP) -> DataFrame:
    """ST4, ST5: after each micro-batch, the shots (session_id, shot, n, mean_score) of the sessions that it has results of.

    results has session_id, shot, score, ts. All four supported shots are counted, zeros
    too; mean_score passes over NULL and NaN scores and is NULL where there are none. Other
    shots are passed over. State is 13 numbers a session and leaves when the watermark is
    gap beyond its latest result. For ``update`` mode.
    """
    quiet = _micros(gap)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["session_id", "shot", "n", "mean_score"])
            return
        n, scored, total, latest = [0] * len(SHOTS), [0] * len(SHOTS), [0.0] * len(SHOTS), 0
        if state.exists and state.get[3] + quiet > state.getCurrentWatermarkMs() * 1000:
            n, scored, total, latest = [*(list(x) for x in state.get[:3]), state.get[3]]
        for shot, score, at in _rows(batches, ["shot", "score", "at"]):
            latest = max(latest, int(at))
            if shot in SHOTS:
                place = SHOTS.index(shot)
                n[place] += 1
                if score is not None and score == score:
                    scored[place] += 1
                    total[place] += float(score)
        state.update((n, scored, total, latest))
        _wake(state, latest + quiet)
        means = [round(t / k, 1) if k else None for t, k in zip(total, scored, strict=True)]
        yield pd.DataFrame({"session_id": key[0], "shot": SHOTS, "n": n, "mean_score": pd.array(means, dtype="Float64")})

    timed = _timed(results, watermark).select("session_id", "shot", "score", "ts", "at")
    return timed.groupBy("session_id").applyInPandasWithState(run, "session_id string, shot string, n bigint, mean_score double", LIVE_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def running_scores(results: DataFrame, watermark: str = WATERMARK, gap: str = SESSION_GAP) -> DataFrame:
    """ST4: mean score of each session's supported shots that have scores."""
    return live_results(results, watermark, gap).where("mean_score is not null").select("session_id", "shot", "mean_score")


def running_counts(results: DataFrame, watermark: str = WATERMARK, gap: str = SESSION_GAP) -> DataFrame:
    """ST5: results of each session's four supported shots, zeros kept."""
    return live_results(results, watermark, gap).select("session_id", "shot", "n")


def shots_per_day(results: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """ST6: tumbling days of each user."""
    return results.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "user_id", "n")


def request_windows(requests: DataFrame, limit: int, seconds: int, watermark: str = WATERMARK) -> DataFrame:
    """ST7 (fixed windows): requests and rejections of each key and window."""
    n = F.count(F.lit(1))
    counted = requests.withWatermark("ts", watermark).groupBy(F.window("ts", f"{seconds} seconds"), "key").agg(n.alias("n"))
    return counted.select(F.col("window.start").alias("start"), "key", "n", F.greatest(F.lit(0), F.col("n") - limit).alias("rejected") if limit > 0 else F.lit(0).alias("rejected"))


def sliding_requests(requests: DataFrame, limit: int, seconds: float, watermark: str = WATERMARK) -> DataFrame:
    """ST7 (sliding window), W15 as a stream: each request (request_id, key, ts) with its decision.

    Requests wait until the watermark has passed them and are decided in the order of time
    and id, so that the order of arrival doesn't matter: the decisions are those of
    ``sliding_window``. State holds limit times a key, and the requests of the watermark's delay.
    """
    window = round(seconds * 1e6)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, at, ids = (list(x) for x in state.get) if state.exists else ([], [], [])
        waiting = sorted([*zip(at, ids, strict=True), *((int(a), int(i)) for a, i in _rows(batches, ["at", "request_id"]))])
        passed = state.getCurrentWatermarkMs() * 1000
        out = []
        for t, request in waiting:
            if t > passed:
                break
            held = [h for h in held if t - h <= window]
            ok = limit <= 0 or len(held) < limit
            if ok and limit > 0:
                held.append(t)
            out.append((request, key[0], ok))
        waiting = waiting[len(out) :]
        if waiting or (held and held[-1] + window > passed):
            state.update((held, [t for t, _ in waiting], [i for _, i in waiting]))
            _wake(state, waiting[0][0] if waiting else held[-1] + window)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["request_id", "key", "allowed"])

    timed = _timed(requests, watermark).select("request_id", "key", "ts", "at")
    return timed.groupBy("key").applyInPandasWithState(run, "request_id bigint, key bigint, allowed boolean", REQUEST_STATE, "append", GroupStateTimeout.EventTimeTimeout)
