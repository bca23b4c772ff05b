"""Events of a stream of photos: the fold of ``operators.events`` as state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mediacat.functions.scalars import is_located
from mediacat.operators.events import MAX_GAP_S, Cutter

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = ["at", "id", "located", "latitude", "longitude"]


class EventProcessor(StatefulProcessor):
    """Holds a key's photos until the watermark has passed them, then names them in time order.

    State is the open event (its island, first photo, last photo's time and last place) and the
    photos within the allowed delay. A timer at the earliest photo held wakes the key; one at
    the end of the gap after the last photo forgets the open event, as none can join it.
    """

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, id long, located boolean, latitude double, longitude double")
        self.open = handle.getValueState("open", "island long, first_id long, first_at long, last_at long, located boolean, lat double, lon double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for b in rows:
            if len(b):
                self.held.appendList(list(b[_ROW].itertuples(index=False, name=None)))
                least = int(b["at"].min())
                earliest = least if earliest is None else min(earliest, least)
        if earliest is not None:
            self.handle.registerTimer(earliest * 1000)
        yield self._named(None, [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(r) for r in self.held.get()), key=lambda r: r[:2])
        ripe = [r for r in held if r[0] * 1000 <= passed]
        machine, last = Cutter(), None
        if self.open.exists():
            island, first_id, first_at, last, located, lat, lon = self.open.get()
            machine = Cutter(island, first_id, first_at, (lat, lon) if located else None)
        events = []
        for at, media_id, located, lat, lon in ripe:
            island = at if last is None or at - last > MAX_GAP_S else machine.island
            # The machine opens an event where a gap, a span or a step ends one; its island is the run's start.
            events.append(machine((island, at, media_id, located, lat, lon)))
            last = at
        left = held[len(ripe) :]
        if ripe:
            if left:
                self.held.put(left)
            else:
                self.held.clear()
            place = machine.place or (0.0, 0.0)
            self.open.update((machine.island, machine.first_id, machine.first_at, last, machine.place is not None, *place))
            self.handle.registerTimer((last + MAX_GAP_S + 1) * 1000)
        elif last is not None and not held and (last + MAX_GAP_S) * 1000 < passed:
            self.open.clear()
        if left:
            self.handle.registerTimer(left[0][0] * 1000)
        yield self._named(key[0], [r[1] for r in ripe], events)

    def _named(self, key, ids: list[int], events: list[int]) -> pd.DataFrame:
        return pd.DataFrame({self.key: pd.Series([key] * len(ids), dtype=object), "id": pd.Series(ids, dtype="int64"), "event": pd.Series(events, dtype="int64")})


def event_stream(media: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """``(key, id, event)`` of the dated photos of a stream, by ``key`` (a camera, a person): the
    events that :func:`mediacat.operators.events.event_members` finds among a key's photos.

    A photo is named once the watermark, ``late`` behind the newest photo, has passed it; one
    that comes later than that is dropped. A null key is a key. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``). The stream's checkpoint survives restarts.
    """
    photos = media.where("media_type = 'photo' AND date_taken <> 0").select(key, F.col("date_taken").alias("at"), "id", is_located().alias("located"), "latitude", "longitude", F.timestamp_seconds("date_taken").alias("mediacat_time"))
    kind = dict(photos.dtypes)[key]
    return (
        photos.withWatermark("mediacat_time", late)
        .groupBy(key)
        .transformWithStateInPandas(EventProcessor(key), f"`{key}` {kind}, id long, event long", "Append", "EventTime")
    )
