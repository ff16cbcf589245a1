"""Streaming forms of upsert (see `store`), price log and ageing out."""

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..operators.clean import AGE_DAYS
from .store import snapshot, upsert_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _PriceLog(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("price", DoubleType()), StructField("known", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = self.last.get() if self.last.exists() else None
        price = None if seen is None else seen[0]
        all_ = pd.concat(list(rows)).sort_values(["ts", "seq"])
        out = []
        for ts, seq, p in zip(all_.ts, all_.seq, all_.price_rub, strict=True):
            p = None if pd.isna(p) else float(p)
            if p is not None and p != price:
                out.append((key[0], ts, seq, p))
            price = p
        self.last.update((price, True))
        yield pd.DataFrame(out, columns=["listing_id", "ts", "seq", "price_rub"])

    def close(self) -> None:
        pass


def price_log(observed: DataFrame) -> DataFrame:
    """ST2: price changes of a stream (listing_id, ts, seq, price_rub) that brings a listing's
    rows in order; its state is one price a listing."""
    return observed.groupBy("listing_id").transformWithStateInPandas(_PriceLog(), "listing_id long, ts timestamp, seq long, price_rub double", "append", "None")


_ROW = StructType([StructField("ts", LongType()), StructField("seq", LongType()), StructField("price", DoubleType())])
_LOGGED = "listing_id long, ts timestamp, seq long, price_rub double, late boolean"


class _OrderedPriceLog(StatefulProcessor):
    """Rows wait in a list until the event clock has passed them by; then they are logged in
    order. Spark's watermark runs `grace` behind that clock, so that rows that come too late
    still reach us."""

    def __init__(self, grace_ms: int) -> None:
        self.grace = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("price", DoubleType()), StructField("known", BooleanType())]))
        self.waiting = handle.getListState("waiting", _ROW)

    def _clock(self, timerValues) -> int:  # noqa: N803
        mark = timerValues.getCurrentWatermarkInMs()
        return (mark + self.grace) * 1000 if mark > 0 else -(1 << 62)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        clock, new, late = self._clock(timerValues), [], []
        for part in rows:
            at = part.ts.astype("datetime64[us]").astype("int64")
            for us, seq, p in zip(at, part.seq, part.price_rub, strict=True):
                (late if us < clock else new).append((int(us), int(seq), None if pd.isna(p) else float(p)))
        self.waiting.appendList(new) if new else None
        for ms in {us // 1000 for us, _, _ in new}:
            self.handle.registerTimer(max(1, ms - self.grace + 1))
        yield self._told(key, [(us, seq, p, True) for us, seq, p in late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        clock = self._clock(timerValues)
        held = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        ready, rest = [tuple(r) for r in held if r[0] < clock], [tuple(r) for r in held if r[0] >= clock]
        price, out = self.last.get()[0] if self.last.exists() else None, []
        for us, seq, p in ready:
            if p is not None and p != price:
                out.append((us, seq, p, False))
            price = p
        if ready:
            self.last.update((price, True))
            self.waiting.put(rest) if rest else self.waiting.clear()
        yield self._told(key, out)

    @staticmethod
    def _told(key, rows: list[tuple]) -> pd.DataFrame:
        ts, seq, price, late = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pd.DataFrame({"listing_id": pd.Series([key[0]] * len(rows), dtype="int64"), "ts": pd.to_datetime(pd.Series(ts, dtype="int64"), unit="us"), "seq": pd.Series(seq, dtype="int64"), "price_rub": pd.Series(price, dtype="float64"), "late": pd.Series(late, dtype="bool")})

    def close(self) -> None:
        pass


def ordered_price_log(observed: DataFrame, delay_s: int = 86_400, grace_s: int = 365 * 86_400) -> DataFrame:
    """ST2: price changes of a stream (listing_id, ts, seq, price_rub) whose rows may come up to
    `delay_s` late, by event time: listing_id, ts, seq, price_rub, late. Rows wait until the
    greatest `ts` of earlier batches is `delay_s` past them, and are then logged in order, as W2
    would. Rows that come later still are told as they are, with `late`, and change nothing;
    those more than `grace_s` later than that are dropped by Spark. The state of a listing is its
    rows of the last `delay_s`, and one price."""
    kept = observed.withWatermark("ts", f"{delay_s + grace_s} seconds").groupBy("listing_id")
    return kept.transformWithStateInPandas(_OrderedPriceLog(grace_s * 1000), _LOGGED, "append", "EventTime")


class _Ageing(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", StructType([StructField("at", LongType()), StructField("deal", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        all_ = pd.concat(list(rows)).sort_values("last_seen")
        at, deal = int(all_.last_seen.iloc[-1].timestamp() * 1000), all_.deal_type.iloc[-1]
        if self.seen.exists() and self.seen.get()[0] >= at:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, (list, tuple)) else t)
        self.seen.update((at, deal))
        if deal in AGE_DAYS:
            self.handle.registerTimer(at + AGE_DAYS[deal] * 86_400_000)
        yield pd.DataFrame({"id": pd.Series([], dtype="int64"), "last_seen": pd.Series([], dtype="datetime64[ns]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = self.seen.get()[0]
        self.seen.clear()
        yield pd.DataFrame({"id": [key[0]], "last_seen": [pd.Timestamp(at, unit="ms")]})

    def close(self) -> None:
        pass


def aged_out(sightings: DataFrame, late: str = "1 day") -> DataFrame:
    """ST3: (id, last_seen) of listings whose deal type's days pass without a sighting, by
    event time over a stream (id, deal_type, last_seen); the watermark is our own."""
    kept = sightings.withWatermark("last_seen", late).groupBy("id")
    return kept.transformWithStateInPandas(_Ageing(), "id long, last_seen timestamp", "append", "EventTime")
