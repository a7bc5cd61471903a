"""Stateful processors with event-time timers, kept in the state store.

Rows wait in the state of their key until the watermark has passed them, so that they are judged in order of time
however they arrive. Rows behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BUSY = ("processing", "extracting", "enriching")


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


class StallAlerts(StatefulProcessor):
    """One row per span in which the counters of a busy search stay the same for more than ``seconds``.

    A span begins with the first report of its counters and ends with other counters or a status that is not busy. The
    alert comes when the watermark has passed the limit, or with the report that ends a longer span. A search that is
    not heard of for ``keep`` seconds after its last span has been told is forgotten.

    A key is a part of the searches, which share its state and timers: state calls cost per key, not per search. Reports
    are rows of numbers (none, search, at, busy, extracted, enriched), where none marks the search without an id.
    """

    COLUMNS = 6

    def __init__(self, seconds: float, keep: float) -> None:
        self.limit, self.keep = int(seconds * 1_000_000), int(keep * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "reports binary")
        self.spans = handle.getValueState("spans", "spans binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = []
        for frame in rows:
            numbers = frame[["extracted_count", "enriched_count"]].fillna(0).astype("int64")
            reports = np.column_stack([frame["none"].astype("int64"), frame["search_id"].astype("int64"), _micros(frame["ts"]),
                                       frame["status"].isin(BUSY).astype("int64"), numbers.to_numpy()])
            new.append(reports[reports[:, 2] > passed])
        reports = np.concatenate(new)
        if len(reports):
            self.waiting.appendValue((reports.astype(np.int64).tobytes(),))
            self.handle.registerTimer(-(-int(reports[:, 2].min()) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        reports = np.concatenate([np.zeros((0, self.COLUMNS), np.int64), *[
            np.frombuffer(r[0], np.int64).reshape(-1, self.COLUMNS) for r in self.waiting.get()]])
        is_due = reports[:, 2] <= passed
        due, later = reports[is_due], reports[~is_due]
        if len(due):
            self.waiting.put([(later.tobytes(),)]) if len(later) else self.waiting.clear()
        # a span is (since, extracted, enriched, told, last)
        known = np.frombuffer(self.spans.get()[0], np.int64).reshape(-1, 7).tolist() if self.spans.exists() else []
        spans = {(r[0], r[1]): tuple(r[2:]) for r in known}
        told: list[tuple] = []

        def tell(search: tuple[int, int], until: int) -> None:
            span = spans.get(search)
            if span and not span[3] and until - span[0] > self.limit:
                told.append((*search, *span[:3]))
                spans[search] = (*span[:3], 1, span[4])
        for none, search_id, at, busy, *counters in due[np.lexsort(due.T[::-1])].tolist():
            search = (none, search_id)
            tell(search, at)
            span = spans.get(search)
            if not busy:
                spans.pop(search, None)
            elif span is None or list(span[1:3]) != counters:
                spans[search] = (at, *counters, 0, at)
            else:
                spans[search] = (*span[:4], at)
        expected = set(map(tuple, later[:, :2].tolist()))
        wakes = [-(-int(later[:, 2].min()) // 1000)] if len(later) else []
        for search in list(spans):
            tell(search, passed)
            since, _, _, is_told, last = spans[search]
            if is_told and search not in expected and passed - last > self.keep * 1000:
                del spans[search]
            else:
                wakes.append((since + self.limit) // 1000 + 1 if not is_told else last // 1000 + self.keep + 1)
        if spans:
            self.spans.update((np.array([(*search, *span) for search, span in spans.items()], np.int64).tobytes(),))
        elif known:
            self.spans.clear()
        wakes = [w for w in wakes if w * 1000 > passed]
        if wakes:
            self.handle.registerTimer(min(wakes))
        if told:
            none, search_id, since, extracted, enriched = (list(x) for x in zip(*told))
            yield pd.DataFrame({"search_id": pd.array([None if n else i for n, i in zip(none, search_id)], dtype="Int64"), "extracted_count": extracted,
                                "enriched_count": enriched, "since": pd.to_datetime(pd.Series(since), unit="us")})

    def close(self) -> None:
        pass


class RangeSums(StatefulProcessor):
    """Running sum and its lowest value before each entry, inside one range of a company's entry numbers.

    State is (sum, lowest) of the range alone: a batch touches the ranges of its own entries, and a company with most
    of the entries is as many keys as it has ranges. Entries of a range come in order from batch to batch.
    """

    def __init__(self, keys: list[str], order: str, value: str) -> None:
        self.keys, self.order, self.value = keys, order, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "total long, low long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, low = tuple(self.state.get()) if self.state.exists() else (0, None)
        entries = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # at most the entries of one range
        sums = total + np.cumsum(entries[self.value].to_numpy(np.int64))
        lowest = np.minimum.accumulate(sums if low is None else np.append(low, sums))
        before = pd.array(([None] if low is None else []) + lowest[:-1].tolist(), dtype="Int64")
        self.state.update((int(sums[-1]), int(lowest[-1])))
        yield entries.assign(**dict(zip(self.keys, key)), in_sum=sums, in_low=before)

    def close(self) -> None:
        pass


class ClosedBuckets(StatefulProcessor):
    """Rows of one part of the keys and bucket of time in order, once the watermark has passed the bucket.

    Each row carries ``leave``, the last time accepted in the bucket if it is the first one accepted, and ``step``,
    whether the bucket needs it to be composed with others. Rows wait as Arrow batches, so that state calls cost per
    part and bucket, not per key or row.
    """

    def __init__(self, keys: list[str], tie: str, width: int, gap: int) -> None:
        self.keys, self.tie, self.width, self.gap = keys, tie, width, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end = -(-(key[-1] + 1) * self.width // 1000)
        if end > timerValues.getCurrentWatermarkInMs():
            for frame in rows:
                batch = pa.RecordBatch.from_pandas(frame[[*self.keys, self.tie, "t"]], preserve_index=False)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch)
                self.waiting.appendValue((sink.getvalue().to_pybytes(),))
            self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        from leadloom.operators.queue import bucket_steps, ordered

        # a column of nulls alone has another type in its batch
        rows = pa.concat_tables([pa.ipc.open_stream(r[0]).read_all() for r in self.waiting.get()], promote_options="permissive")
        self.waiting.clear()
        rows, code = ordered(rows, self.keys, self.tie)
        times = rows["t"].to_numpy()
        leave, step = bucket_steps(times, self.gap, key[-1] * self.width, code)
        yield rows.to_pandas().assign(bucket=key[-1], leave=leave, step=step)[[*self.keys, "bucket", self.tie, "t", "leave", "step"]]

    def close(self) -> None:
        pass
