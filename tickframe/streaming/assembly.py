"""Chunks from pieces (R1, R6) and counts with a side output of late rows.

Both pass every row on with what became of it, so what is kept and what is rejected add up to what
was delivered.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickframe.streaming.runtime import ARRIVED, by_arrival

# Spark also loads processors in a process of the driver that knows neither its path nor shipped files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CALL, REPEATED, PARTIAL = "call", "repeated", "partial"


BUCKET = "_bucket"
BUCKETS = 1024


def by_bucket(stream: DataFrame, keys: list[str], buckets: int) -> GroupedData:
    """Groups many keys to one call of Python state, which costs more than what is done for a key.

    The state is still kept by key, so a call reads and writes that of the keys it meets and no other.
    """
    return stream.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).groupBy(BUCKET)


class Reminders:
    """Timers of the keys of a bucket: one timer for all that are due at the same time.

    A key keeps the time of its own timer in its state; a reminder of another time is out of date.
    """

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.due = handle, handle.getMapState("due", "at long", "keys binary")

    def add(self, at: int, keys: list[tuple]) -> None:
        known = self.due.getValue((at,))
        self.due.updateValue((at,), (pickle.dumps((pickle.loads(known[0]) if known else []) + keys),))
        if known is None:
            self.handle.registerTimer(at)

    def take(self, at: int) -> list[tuple]:
        known = self.due.getValue((at,))
        if known is None:
            return []
        self.due.removeKey((at,))
        return list(dict.fromkeys(pickle.loads(known[0])))


class _Assembler(StatefulProcessor):
    """State of one chunk: the pieces that came, how many calls they hold, whether the chunk is sealed."""

    def __init__(self, columns: list[str], keys: list[T.StructField], gap_ms: int | None, keep_ms: int):
        self.columns, self.keys, self.gap_ms, self.keep_ms = columns, keys, gap_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        own = T.StructType(self.keys)
        self.pieces = handle.getMapState("pieces", T.StructType([*self.keys, T.StructField("piece", T.IntegerType())]), "calls binary")
        self.progress = handle.getMapState("progress", own, "calls int, sealed boolean, timer long, pieces int")
        self.reminders = Reminders(handle)

    def _held(self, key: tuple, pieces: int) -> pa.Table:
        own = [pa.ipc.open_stream(self.pieces.getValue((*key, n))[0]).read_all() for n in range(pieces)]
        return pa.concat_tables(own, promote_options="permissive")

    def _forget(self, key: tuple, pieces: int) -> None:
        for n in range(pieces):
            self.pieces.removeKey((*key, n))

    def _told(self, frame: pd.DataFrame, outcome: str) -> pd.DataFrame:
        return frame[self.columns].assign(outcome=outcome)

    def _names(self, frame: pd.DataFrame) -> list[tuple]:
        """Keys of the rows of ``frame`` as Python values; a column of whole numbers with nulls came as floats."""
        columns = []
        for field in self.keys:
            values = frame[field.name].tolist()
            whole = isinstance(field.dataType, T.IntegralType)
            columns.append([None if v is None or v != v else int(v) if whole else v for v in values])
        return list(zip(*columns))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due: dict[int, set] = {}
        for frame in rows:
            yield from self._take(frame, due)
        for at, keys in due.items():
            self.reminders.add(at, list(keys))

    def _take(self, frame: pd.DataFrame, due: dict[int, set]) -> Iterator[pd.DataFrame]:
        now = int(frame[ARRIVED].max().timestamp() * 1000)
        names = [f.name for f in self.keys]
        frame = frame.assign(_chunk=frame.groupby(names, sort=False, dropna=False).ngroup())
        chunks = self._names(frame.drop_duplicates("_chunk").sort_values("_chunk"))
        known = [self.progress.getValue(c) or (0, False, None, 0) for c in chunks]
        sealed = np.array([k[1] for k in known], bool)
        over = sealed[frame["_chunk"].to_numpy()]
        if over.any():
            yield self._told(frame[over], REPEATED)
            frame = frame[~over]
        if not len(frame):
            return
        held = {n: self._held(chunks[n], known[n][3]) for n in np.flatnonzero(~sealed).tolist() if known[n][3]}
        earlier = pd.DataFrame({"_chunk": np.repeat(list(held), [len(t) for t in held.values()]),
                                "call_no": np.concatenate([t["call_no"].to_numpy() for t in held.values()])}) if held else None
        own = frame[["_chunk", "call_no"]]
        again = (own if earlier is None else pd.concat([earlier, own])).duplicated().to_numpy()[-len(own):]
        if again.any():
            yield self._told(frame[again], REPEATED)
        fresh = frame[~again] if again.any() else frame
        calls = np.array([k[0] for k in known]) + np.bincount(fresh["_chunk"], minlength=len(known))
        expected = frame.groupby("_chunk")["chunk_calls"].max().reindex(range(len(known))).to_numpy(float)
        whole = ~sealed & (calls >= expected)
        ready = whole[fresh["_chunk"].to_numpy()]
        complete = [t for n, t in held.items() if whole[n]]
        if complete:
            table = pa.concat_tables(complete, promote_options="permissive").to_pandas()
            yield self._told(pd.concat([table, fresh[ready]], ignore_index=True) if ready.any() else table, CALL)
        elif ready.any():
            yield self._told(fresh[ready], CALL)
        waits = fresh[~ready].sort_values("_chunk", kind="stable")
        number = np.bincount(waits["_chunk"], minlength=len(known))
        upto = np.cumsum(number)
        batch = pa.RecordBatch.from_pandas(waits[self.columns], preserve_index=False).replace_schema_metadata(None)
        for n in np.flatnonzero(~sealed).tolist():
            _, _, timer, pieces = known[n]
            if whole[n]:
                self._forget(chunks[n], pieces)
                self._seal(chunks[n], int(calls[n]), now, due)
                continue
            if self.gap_ms is not None:
                timer = now + self.gap_ms
                due.setdefault(timer, set()).add(chunks[n])
            if number[n]:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch.slice(upto[n] - number[n], number[n]))
                self.pieces.updateValue((*chunks[n], pieces), (sink.getvalue().to_pybytes(),))
                pieces += 1
            self.progress.updateValue(chunks[n], (int(calls[n]), False, timer, pieces))

    def _seal(self, chunk: tuple, calls: int, now: int, due: dict[int, set]) -> None:
        self.progress.updateValue(chunk, (calls, True, now + self.keep_ms, 0))
        due.setdefault(now + self.keep_ms, set()).add(chunk)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, due = expiredTimerInfo.getExpiryTimeInMs(), {}
        for chunk in self.reminders.take(at):
            calls, sealed, timer, pieces = self.progress.getValue(chunk) or (0, False, None, 0)
            if timer != at:
                continue
            if sealed:
                self.progress.removeKey(chunk)
                continue
            if pieces:
                yield self._told(self._held(chunk, pieces).to_pandas(), PARTIAL)
                self._forget(chunk, pieces)
            self._seal(chunk, calls, timerValues.getCurrentWatermarkInMs(), due)
        for at, keys in due.items():
            self.reminders.add(at, list(keys))

    def close(self) -> None:
        pass


def complete_chunks(stream: DataFrame, keys: list[str], gap_ms: int | None = None, keep_ms: int = 7 * 86_400_000,
                    slack: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Every row of ``stream`` once, with its ``outcome``.

    ``keys`` name a chunk, ``call_no`` a row of it, and ``chunk_calls`` says how many rows it has, as its
    manifest does. Rows wait in the state until the chunk is whole, however many files and batches it comes in, and
    then go on together as ``call``. A row that came before, or for a chunk passed on within the last ``keep_ms``, is
    ``repeated``. A chunk that gets nothing new for ``gap_ms`` goes on as it is, as ``partial``. ``buckets``, the
    number of groups that keys are dealt to, stays the same for the life of a checkpoint.
    """
    shape = T.StructType([*stream.schema.fields, T.StructField("outcome", T.StringType())])
    own = [stream.schema[k] for k in keys]
    return by_bucket(by_arrival(stream, slack), keys, buckets).transformWithStateInPandas(
        _Assembler(stream.columns, own, gap_ms, keep_ms), outputStructType=shape, outputMode="Append", timeMode="EventTime")


_COUNTED = "session_id string, what string, window_start timestamp, rows long, ts timestamp, call_no long"


class _Counter(StatefulProcessor):
    """State of one session: its newest time and the counts of its open windows, as pairs of start and rows.

    Times are nanoseconds as the session's time zone shows them. Open windows span little more than the lateness.
    """

    def __init__(self, length: str, lateness: str):
        self.length, self.lateness = pd.Timedelta(length), pd.Timedelta(lateness)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState("sessions", "session_id string", "newest long, open binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before: dict[str | None, int | None] = {}  # what earlier batches brought
        newest: dict[str | None, int | None] = {}
        opened: dict[str | None, dict[int, int]] = {}
        ended = set()
        for frame in rows:
            codes, names = pd.factorize(frame["session_id"], use_na_sentinel=False)
            names = [n if isinstance(n, str) else None for n in names]
            for name in names:
                if name not in before:
                    at, windows = self.sessions.getValue((name,)) or (None, b"")
                    before[name] = newest[name] = at
                    opened[name] = dict(np.frombuffer(windows, np.int64).reshape(-1, 2).tolist())
            bound = pd.to_datetime([before[n] for n in names]).as_unit("ns") - self.lateness
            ts = frame["ts"].astype("datetime64[ns]")
            late = (ts.isna() | (ts.to_numpy() < bound.to_numpy()[codes])).to_numpy()
            if late.any():
                yield pd.DataFrame({"session_id": frame["session_id"][late], "what": "late", "window_start": pd.NaT, "rows": 1,
                                    "ts": ts[late], "call_no": frame["call_no"][late]})
            kept, own = ts[~late], codes[~late]
            for (code, start), n in kept.groupby([own, kept.dt.floor(self.length)]).size().items():
                windows = opened[names[code]]
                windows[start.value] = windows.get(start.value, 0) + int(n)
            for code, at in kept.groupby(own).max().items():
                known = newest[names[code]]
                newest[names[code]] = at.value if known is None else max(known, at.value)
            ended.update(names[code] for code in np.unique(codes[frame["ended"].eq(True).to_numpy()]))
        told = []
        for name, windows in opened.items():
            done = sorted(start for start in windows if name in ended or
                          start + self.length.value <= newest[name] - self.lateness.value)
            told += [(name, start, windows.pop(start)) for start in done]
            left = np.array(sorted(windows.items()), np.int64).tobytes()
            self.sessions.updateValue((name,), (newest[name], left))
        if told:
            names, starts, number = zip(*told)
            yield pd.DataFrame({"session_id": names, "what": "window", "window_start": pd.to_datetime(starts),
                                "rows": number, "ts": pd.NaT, "call_no": None})

    def close(self) -> None:
        pass


def window_counts(stream: DataFrame, length: str = "5 minutes", lateness: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """Rows per session and tumbling window, and the rows that came too late for theirs.

    A ``window`` row comes when its session's time has passed the window's end by ``lateness``, or when the
    session has ``ended``. A row that lies more than ``lateness`` behind what earlier batches brought of its session, or
    has no time, is passed on as ``late``. A window opened again after the end of its session is told again.
    """
    rows = stream.select("session_id", "ts", "call_no", "ended")
    return by_bucket(rows, ["session_id"], buckets).transformWithStateInPandas(
        _Counter(length, lateness), outputStructType=_COUNTED, outputMode="Append", timeMode="None")
