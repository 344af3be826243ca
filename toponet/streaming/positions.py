"""Position streams: fences, movement gate, ambient picks, check-ins, windows.

Streams join places on cells (stream-static), then keep small state per user.
State is bounded: what a user heard is forgotten after a day, and fixes later
than the watermark are dropped by Spark and counted in its progress metrics.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import visits

c = F.col

WATERMARK = "10 minutes"
DAY_MS = 86_400_000
FIRED = "user_id long, place_id long, fix_id long, ts timestamp, metres double"


def hits(fixes: DataFrame, places: DataFrame, radius_m: float, extra: list[str] | None = None) -> DataFrame:
    """Fence hits of a stream of fixes, watermarked."""
    return visits.fence_hits(fixes.withWatermark("ts", WATERMARK), places, radius_m, extra)


def _millis(stamp) -> int:
    return int(pd.Timestamp(stamp).timestamp() * 1000)


def _expire(state: GroupState, watermark_ms: int) -> None:
    """Forget the user a day after the last event seen."""
    state.setTimeoutTimestamp(watermark_ms + DAY_MS)


def geofence(fence_hits: DataFrame) -> DataFrame:
    """Each fix fires the nearest stop not yet heard that day, once per stop and user."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        heard = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["ts", "fix_id", "metres", "place_id"])
        out = []
        for fix, near in rows.groupby("fix_id", sort=False):
            now = _millis(near["ts"].iloc[0])
            day = str(now // DAY_MS)
            for row in near.itertuples():
                if heard.get(str(row.place_id)) != day:
                    heard[str(row.place_id)] = day
                    out.append((key[0], row.place_id, fix, row.ts, row.metres))
                    break
        newest = _millis(rows["ts"].max())
        fresh = {p: d for p, d in heard.items() if int(d) >= newest // DAY_MS - 1}
        state.update((json.dumps(fresh),))
        _expire(state, max(newest, state.getCurrentWatermarkMs()))
        yield pd.DataFrame(out, columns=["user_id", "place_id", "fix_id", "ts", "metres"])

    return fence_hits.groupBy("user_id").applyInPandasWithState(
        run, FIRED, "heard string", "append", GroupStateTimeout.EventTimeTimeout
    )


def movement(fixes: DataFrame) -> DataFrame:
    """Fixes at least 12 m from the last processed one of the user that day."""
    import numpy as np

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "fix_id"])
        out = []
        for row in rows.itertuples():
            day = _millis(row.ts) // DAY_MS
            if last is not None and last[2] == day:
                lat1, lat2 = np.radians(last[0]), np.radians(row.lat)
                h = (
                    np.sin((lat2 - lat1) / 2) ** 2
                    + np.cos(lat1) * np.cos(lat2) * np.sin(np.radians(row.lng - last[1]) / 2) ** 2
                )
                if np.floor(2 * 6371000.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) + 0.5) < visits.MOVE_M:
                    continue
            last = (float(row.lat), float(row.lng), int(day))
            out.append((key[0], row.fix_id, row.ts))
        state.update(last)
        _expire(state, max(_millis(rows["ts"].max()), state.getCurrentWatermarkMs()))
        yield pd.DataFrame(out, columns=["user_id", "fix_id", "ts"])

    return (
        visits.usable(fixes)
        .select("user_id", "fix_id", "ts", "lat", "lng")
        .withWatermark("ts", WATERMARK)
        .groupBy("user_id")
        .applyInPandasWithState(
            run, "user_id long, fix_id long, ts timestamp", "lat double, lng double, day long",
            "append", GroupStateTimeout.EventTimeTimeout,
        )
    )


def ambient(fence_hits: DataFrame) -> DataFrame:
    """Checked places first, more works, nearer; not twice, not within 30 m of a told
    spot, and quiet for 15 seconds after each telling."""
    import numpy as np

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        told, quiet, day_now = json.loads(state.get[0]) if state.exists else ([], 0, None)
        rows = pd.concat(list(frames))
        rows = rows.assign(
            unchecked=~rows["checked"].astype(bool), few=-rows["work_count"].fillna(0)
        ).sort_values(["ts", "fix_id", "unchecked", "few", "metres", "place_id"])
        out = []
        for fix, near in rows.groupby("fix_id", sort=False):
            now = _millis(near["ts"].iloc[0])
            if now // DAY_MS != day_now:
                told, quiet, day_now = [], 0, now // DAY_MS
            if now < quiet:
                continue
            for row in near.itertuples():
                lat = np.radians(row.a_lat)

                def close(spot) -> bool:
                    other = np.radians(spot[1])
                    h = (
                        np.sin((other - lat) / 2) ** 2
                        + np.cos(lat) * np.cos(other) * np.sin(np.radians(spot[2] - row.a_lng) / 2) ** 2
                    )
                    m = 2 * 6371000.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
                    return m <= visits.SAME_SPOT_M

                if any(spot[0] == row.place_id or close(spot) for spot in told):
                    continue
                told.append([int(row.place_id), float(row.a_lat), float(row.a_lng)])
                quiet = now + visits.QUIET_S * 1000
                out.append((key[0], row.place_id, fix, row.ts, row.metres))
                break
        state.update((json.dumps([told, quiet, day_now]),))
        _expire(state, max(_millis(rows["ts"].max()), state.getCurrentWatermarkMs()))
        yield pd.DataFrame(out, columns=["user_id", "place_id", "fix_id", "ts", "metres"])

    return fence_hits.groupBy("user_id").applyInPandasWithState(
        run, FIRED, "told string", "append", GroupStateTimeout.EventTimeTimeout
    )


def check_ins(fixes: DataFrame, places: DataFrame) -> DataFrame:
    """One visit per user and place within a day."""
    near = visits.fence_hits(fixes.withWatermark("ts", "1 day"), places, visits.CHECK_IN_M)
    return near.dropDuplicatesWithinWatermark(["user_id", "place_id"]).select(
        "user_id", "place_id", "ts", "metres"
    )


def windowed_visits(rows: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Visits per place and closed window of a stream (place_key, ts)."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.withWatermark("ts", WATERMARK).groupBy("place_key", span.alias("w")).agg(
        F.count(F.lit(1)).alias("visits")
    )


def walk_sessions(rows: DataFrame, gap: str) -> DataFrame:
    """Walks of a stream: runs of fixes without a gap of the given length."""
    return visits.sessions(rows.withWatermark("ts", WATERMARK), gap)
