"""A live call from its first row to its report, in one stateful operator.

The state of a call: its figures, the samples of an unfinished window, the last vectors, the rows
that wait for an earlier one, when it last alerted, and, where the retention mode keeps raw audio,
the chunks. The last two carry a time to live, and so does the mark that a call has ended.

Rows may come in any order. One waits until all before it are there, or until the call's own
watermark, its newest time less ``delay``, has passed it; then what is missing counts as lost. A
row that comes after its turn is not judged: it goes out as ``late`` and is counted.

With a limit on open calls, the starts and stops (no audio) pass a gate first, which marks the
starts that find no room; such a call goes out as one ``refused`` row and is never judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import dims
from ..operators.call import OUT, ROWS, Alerted, Call, Judge, enrolment, frame, with_enrolments
from ..operators.layers import Policy, Registry

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "seq long, at long, content binary, control string, facts string, centroid array<double>, samples long, spread double"


class Gate(StatefulProcessor):
    """Starts, stops and deletes of all calls of a gate, in order of time: a start beyond
    ``capacity`` open calls becomes "refused". A call that never stops is forgotten after
    ``longest`` seconds. The state holds at most ``capacity`` names."""

    def __init__(self, capacity: int, longest: float):
        self.capacity, self.longest = capacity, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "session_id string", "at long", ttlDurationMs=int(self.longest * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf.sort_values(["at", "session_id", "seq"], kind="stable").reset_index(drop=True)
            told = []
            here = {k[0] for k in self.open.keys()}
            for session, at, control in zip(pdf["session_id"], pdf["at"], pdf["control"], strict=True):
                if control != "start":
                    if session in here:
                        here.discard(session)
                        self.open.removeKey((session,))
                elif session not in here:
                    if len(here) >= self.capacity:
                        control = "refused"
                    else:
                        here.add(session)
                        self.open.updateValue((session,), (int(at),))
                told.append(control)
            yield pdf.assign(control=told)[[x.split()[0] for x in ROWS.split(", ")]]

    def close(self) -> None:
        pass


def gated(rows: DataFrame, limit: int, gates: int = 1, longest: float = 4 * 3600.0) -> DataFrame:
    """Streaming ROWS with the starts beyond ``limit`` open calls marked "refused". With one gate
    the limit is exact; with more, calls are dealt to them by session, each with its share of the
    limit rounded down, so that together they never open more. Only control rows pass a gate."""
    control = rows.filter("control in ('start', 'stop', 'delete')")
    other = rows.filter("control is null or control not in ('start', 'stop', 'delete')")
    dealt = control.withColumn("gate", F.pmod(F.xxhash64("session_id"), F.lit(gates)).cast("int"))
    return dealt.groupBy("gate").transformWithStateInPandas(Gate(max(1, limit // gates), longest), ROWS, "Append", "ProcessingTime").unionByName(other)


class OneCall(StatefulProcessor):
    """``delay``: seconds that a row may be older than the newest of its call. ``raw_ttl``: seconds
    that raw audio is kept (0: never). ``alert_ttl``: seconds that an alert silences others, and
    an ended call's late rows are known."""

    def __init__(self, judge: Judge, delay: float, idle: float, raw_ttl: float, alert_ttl: float):
        self.judge, self.delay, self.idle, self.raw_ttl, self.alert_ttl = judge, int(delay * 1e6), idle, raw_ttl, alert_ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "json string")
        self.held = handle.getValueState("held", "samples binary")
        self.vectors = handle.getListState("vectors", "v array<double>")
        self.waiting = handle.getListState("waiting", WAITING)
        self.alerted = handle.getValueState("alerted", "top int, last long", ttlDurationMs=int(self.alert_ttl * 1000))
        self.ended = handle.getValueState("ended", "seq long", ttlDurationMs=int(self.alert_ttl * 1000))
        self.raw = handle.getListState("raw", "seq long, content binary", ttlDurationMs=int(self.raw_ttl * 1000)) if self.raw_ttl else None

    # -- a call's state in hand --------------------------------------------------------------

    def _load(self) -> tuple:
        call = Call.loads(self.facts.get()[0]) if self.facts.exists() else Call()
        held = np.frombuffer(self.held.get()[0], np.float32) if self.held.exists() else np.zeros(0, np.float32)
        vectors = [list(v[0]) for v in self.vectors.get()] if self.vectors.exists() else []
        alerted = Alerted(*self.alerted.get()) if self.alerted.exists() else Alerted()
        return call, held, vectors, alerted

    def _store(self, call: Call, held: np.ndarray, vectors: list, alerted: Alerted, waiting: list) -> None:
        self.facts.update((call.dumps(),))
        self.held.update((held.tobytes(),))
        self._put(self.vectors, [(v,) for v in vectors])
        self._put(self.waiting, [tuple(w) for w in waiting])
        if alerted.last is not None:
            self.alerted.update((alerted.top, alerted.last))

    @staticmethod
    def _put(state, rows: list) -> None:
        state.put(rows) if rows else state.clear()

    def _clear(self) -> None:
        for state in (self.facts, self.held, self.vectors, self.waiting, self.alerted, *([self.raw] if self.raw else [])):
            state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def _retained(self) -> float | None:
        """Seconds of raw audio that are kept now."""
        return None if self.raw is None else sum(len(r[1]) for r in self.raw.get()) / 2 / dims.SAMPLE_RATE if self.raw.exists() else 0.0

    # -- rows --------------------------------------------------------------------------------

    def _drained(self, session: str, call: Call, held: np.ndarray, vectors: list, alerted: Alerted, waiting: list, all_of_it: bool) -> tuple[list[tuple], np.ndarray, list, bool]:
        """Judge what is in turn: (rows, held, still waiting, whether the call has ended)."""
        out: list[tuple] = []
        waiting = sorted(waiting, key=lambda w: w.seq)
        while waiting:
            w = waiting[0]
            if w.seq > call.next and not all_of_it and min(x.at for x in waiting) > call.newest - self.delay:
                break
            waiting = waiting[1:]
            if w.seq < call.next:
                out.append(self.judge.late(session, call, int(w.seq), int(w.at)))
                continue
            call.created_at = int(w.at) if call.created_at is None else call.created_at
            call.lost += int(w.seq) - call.next
            call.next = int(w.seq) + 1
            if w.control == "start":
                self.judge.start(call, w.facts, enrolment(w))
            if w.content and self.raw is not None:
                self.raw.appendValue((int(w.seq), bytes(w.content)))
            rows, held = self.judge.audio(session, call, held, vectors, alerted, bytes(w.content or b""), int(w.at), end=w.control == "stop")
            out += rows
            if w.control == "stop":
                out += [self.judge.late(session, call, int(x.seq), int(x.at)) for x in waiting]
                out.append(self.judge.closed(session, call, int(w.at), self._retained()))
                return out, held, [], True
        return out, held, waiting, False

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, new = key[0], [r for pdf in rows for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False)]
        if any(r.control == "delete" for r in new):  # erased: nothing of the call comes out any more
            self._clear()
            self.ended.update((max(int(r.seq) for r in new),))
            return
        if refused := [r for r in new if r.control == "refused"]:
            self._clear()
            self.ended.update((int(refused[0].seq),))
            yield frame([(session, "refused", *[None] * 10, int(refused[0].at), int(refused[0].seq), refused[0].facts)])
            return
        again = any(r.control == "start" for r in new)
        if self.ended.exists() and not self.facts.exists() and not again:
            call = Call()  # nothing of it is kept
            yield frame([self.judge.late(session, call, int(r.seq), int(r.at)) for r in new])
            return
        self.ended.clear()
        call, held, vectors, alerted = self._load()
        call.newest = max(call.newest, *(int(r.at) for r in new))
        waiting = [_Row(*w) for w in self.waiting.get()] if self.waiting.exists() else []
        taken, out = {w.seq for w in waiting}, []
        for r in new:
            if r.seq < call.next or r.seq in taken:
                out.append(self.judge.late(session, call, int(r.seq), int(r.at)))
            else:
                taken.add(r.seq)
                waiting.append(_Row(int(r.seq), int(r.at), r.content, r.control, r.facts, r.centroid, r.samples, r.spread))
        more, held, waiting, over = self._drained(session, call, held, vectors, alerted, waiting, False)
        if over:
            self._end(call)
        else:
            self._store(call, held, vectors, alerted, waiting)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield frame(out + more)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Idle too long: what waits is judged, the last short window as well, and the call closes."""
        if not self.facts.exists():
            return
        call, held, vectors, alerted = self._load()
        waiting = [_Row(*w) for w in self.waiting.get()] if self.waiting.exists() else []
        out, held, _, over = self._drained(key[0], call, held, vectors, alerted, waiting, True)
        if not over:
            rows, _ = self.judge.audio(key[0], call, held, vectors, alerted, b"", call.newest, end=True)
            out += [*rows, self.judge.closed(key[0], call, call.newest, self._retained())]
        self._end(call)
        yield frame(out)

    def _end(self, call: Call) -> None:
        self._clear()
        self.ended.update((call.next,))


class _Row:
    __slots__ = ("seq", "at", "content", "control", "facts", "centroid", "samples", "spread")

    def __init__(self, *values):
        for name, value in zip(self.__slots__, values, strict=True):
            setattr(self, name, value)

    def __iter__(self):
        return (getattr(self, n) for n in self.__slots__)


def live_calls(events: DataFrame, registry: Registry | None = None, policy: Policy | None = None, enrolments: DataFrame | None = None, delay: float = 30.0, idle: float = dims.IDLE_SECONDS, raw_ttl: float = 0.0, alert_ttl: float = 3600.0, limit: int | None = None, gates: int = 1) -> DataFrame:
    """Streaming rows of calls (session_id, seq, ts, content, control, facts) to ``call.OUT``:
    judged windows, alerts, late rows and one report a call. ``seq`` counts a call's rows from 0.
    With a ``limit`` a call that starts while so many are open is refused (see ``gated``).

    Enrolments (identity, centroid, samples, spread) are a static side. The session must use the
    RocksDB state store (``STORE``). The state of a call is bounded: thirty seconds of samples,
    twelve vectors, its figures, and the rows of at most ``delay`` seconds that wait.
    """
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    rows = with_enrolments(events, enrolments).filter("session_id is not null and seq is not null")
    if limit is not None:
        rows = gated(rows, limit, gates)
    return rows.groupBy("session_id").transformWithStateInPandas(OneCall(Judge(registry, policy), delay, idle, raw_ttl, alert_ttl), OUT, "Append", "ProcessingTime")
