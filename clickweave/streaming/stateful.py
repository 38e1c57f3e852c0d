"""Keyed steps with state and timers of their own: what needs the order of a key's events, whatever micro-batches they come in.

Events wait in a list of their key until the watermark has passed them, and are then settled in the order of event time. State that outlives its
time is dropped by timers of event time and not by a time to live, which Spark counts in processing time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.scrub import DEBOUNCE_MS, SESSION_GAP_MS
from ..sources.events import with_watermark

def _apply(view: list | None, rows: list[tuple]) -> tuple[list[list], list | None]:
    """The views that rows (eventId, eventType, pageUrl, us, ..., in order) close and the one that stays open; a view is eventId, pageUrl, us, clicks, clicks reported."""
    done = []
    for event_id, kind, page, us, *_ in rows:
        if kind == "PAGE_VIEW":
            done += [view] if view else []
            view = [event_id, page, us, 0, -1]
        elif view and page is not None and view[1] == page:
            view = [*view[:3], view[3] + 1, view[4]]
    return done, view


def _passes(us: int) -> int:
    """The time of a timer that fires once the watermark has reached an event."""
    return max(-(-us // 1000) - 1, 1)


MINUTE_MS = 60_000
ROCKSDB_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def keyed_state(spark: SparkSession) -> None:
    """State in RocksDB, which operators with state of their own need; changes are uploaded instead of whole snapshots."""
    for name, value in ROCKSDB_SETTINGS.items():
        spark.conf.set(name, value)


class ClickProcessor(StatefulProcessor):
    """Clicks per view of the sessions of one bucket. A bucket and not a session is the key, since every key costs a dozen calls between Python and the state
    store in each batch, whatever it holds.

    State: a list of the events that wait for the watermark; a map from sessions to their open views; an agenda, a map from minutes to the sessions to
    look at once the watermark has passed the minute. Timers come for the first waiting event and for the minutes of the agenda. Only sessions that a
    batch touches or the agenda names are read and written.
    """

    waiting = "userId string, sessionId string, eventId string, eventType string, pageUrl string, us long"
    session = "userId string, sessionId string"
    view = "eventId string, pageUrl string, us long, clicks long, reported long, last long"
    output = "userId string, sessionId string, eventId string, pageUrl string, us long, clicksOnPage long, revision long, settled boolean"

    def __init__(self, timeout_ms: int, keep_ms: int, early: bool):
        self.timeout_ms, self.forget_ms, self.early = timeout_ms, max(keep_ms, timeout_ms), early

    def init(self, handle) -> None:
        self.handle, self.events = handle, handle.getListState("waiting", self.waiting)
        self.open = handle.getMapState("open", self.session, self.view)
        self.agenda = handle.getMapState("agenda", "minute long", f"sessions array<struct<{self.session.replace(' string', ':string')}>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.userId, r.sessionId, r.eventId, r.eventType, r.pageUrl, r.us) for r in rows]
        out = []
        if self.early:  # what the events above the watermark close so far
            sessions, held = {r[:2] for r in new}, self.open.exists()
            for session, waiting in _by_session([*(r for r in self.events.get() if r[:2] in sessions), *new]).items():
                found = self.open.getValue(session) if held else None
                done, _ = _apply(list(found[:5]) if found else None, waiting)
                out += self._reports(session, done, timerValues, False)
        self.events.appendList(new)
        self.handle.registerTimer(_passes(min(r[5] for r in new)))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark, minute = timerValues.getCurrentWatermarkInMs(), -(-expiredTimerInfo.getExpiryTimeInMs() // MINUTE_MS)
        due = self.agenda.getValue((minute,))
        if due:
            self.agenda.removeKey((minute,))
        events = list(self.events.get())
        passed, later = [r for r in events if r[5] <= mark * 1000], [tuple(r) for r in events if r[5] > mark * 1000]
        if passed:
            self.events.put(later) if later else self.events.clear()
        if later:
            self.handle.registerTimer(_passes(min(r[5] for r in later)))
        touched, busy, held = _by_session(passed), {r[:2] for r in later}, self.open.exists()
        out, meetings = [], {}
        for session in {**touched, **{tuple(s): None for s in (due[0] if due else [])}}:
            rows, found = touched.get(session), self.open.getValue(session) if held else None
            last = max(rows[-1][3] if rows else 0, found[5] if found else 0)
            done, view = _apply(list(found[:5]) if found else None, rows or [])
            if view and session not in busy and last // 1000 + self.timeout_ms < mark:
                done.append(view)
                view = [*view[:4], view[3]]
            out += self._reports(session, done, timerValues, True)
            if view and (session in busy or last // 1000 + self.forget_ms >= mark):
                if rows or done:
                    self.open.updateValue(session, (*view, last))
                    at = last // 1000 + (self.forget_ms if view[3] == view[4] else self.timeout_ms)
                    meetings.setdefault(max(at, mark) // MINUTE_MS + 1, []).append(session)
            elif found:
                self.open.removeKey(session)
        for at, sessions in meetings.items():
            others = self.agenda.getValue((at,))
            self.agenda.updateValue((at,), ([*(tuple(s) for s in (others[0] if others else [])), *sessions],))
            self.handle.registerTimer(at * MINUTE_MS)
        return iter(out)

    def _reports(self, session, views: list[list], timerValues, settled: bool) -> list[Row]:
        revision = 2 * timerValues.getCurrentProcessingTimeInMs() + settled  # of batches in their order; timers come after rows
        return [Row(userId=session[0], sessionId=session[1], eventId=v[0], pageUrl=v[1], us=v[2], clicksOnPage=v[3], revision=revision, settled=settled) for v in views if v[3] != v[4]]

    def close(self) -> None:
        pass


def _by_session(events: list[tuple]) -> dict[tuple, list[tuple]]:
    """(eventId, eventType, pageUrl, us) of every session in the order of time."""
    out: dict[tuple, list[tuple]] = {}
    for user, session, *event in events:
        out.setdefault((user, session), []).append(tuple(event))
    for rows in out.values():
        rows.sort(key=lambda r: (r[3], r[0] is not None, r[0] or ""))
    return out


def clicks_by_view_stream(events: DataFrame, watermark: str = "10 minutes", timeout_ms: int = 1_800_000, keep_ms: int = 86_400_000, early: bool = False, buckets: int = 256) -> DataFrame:
    """Streaming clicks per page view, as clicks_by_view counts them, whatever micro-batches the events come in.

    State holds the events that the watermark hasn't passed and the open view of each session. Events are settled in the order of (ts, eventId)
    once the watermark has passed them. A view is reported when a later one is settled or the session has been silent for timeout_ms of
    event time (looked at once a minute); a click after such a silence reports its view again, until the session has been silent for keep_ms and is forgotten. early
    also reports views that an event above the watermark closes so far (settled is false). Of a view's rows that with the highest revision counts.
    Sessions are dealt over `buckets` keys, which stay those of the checkpoint: some hundred sessions that are open at once for each are few.
    """
    timed = with_watermark(events.filter(F.col("eventType").isin("PAGE_VIEW", "CLICK")), watermark)
    bucket = F.pmod(F.xxhash64("userId", "sessionId"), F.lit(buckets)).cast("int").alias("bucket")
    timed = timed.select(bucket, "userId", "sessionId", "eventId", "eventType", "pageUrl", "ts", F.unix_micros("ts").alias("us"))
    keyed_state(events.sparkSession)
    out = timed.groupBy("bucket").transformWithState(ClickProcessor(timeout_ms, keep_ms, early), ClickProcessor.output, "append", "eventTime")
    return out.select("userId", "sessionId", "eventId", "pageUrl", F.timestamp_micros("us").alias("ts"), "clicksOnPage", "revision", "settled")


def last_reports(reports: DataFrame) -> DataFrame:
    """Of the rows of clicks_by_view_stream the last of every view."""
    last = F.max_by(F.struct("pageUrl", "ts", "clicksOnPage"), "revision").alias("last")
    return reports.groupBy("userId", "sessionId", "eventId").agg(last).select("userId", "sessionId", "eventId", "last.*")


class SessionNumbers(StatefulProcessor):
    """Numbers the sessions of one user. State: the events that wait (as text), and the user's last settled event and number."""

    held = "timestamp long, eventId string, event string"
    output = "userId string, event string, number long"

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle) -> None:
        self.handle, self.waiting, self.state = handle, handle.getListState("waiting", self.held), handle.getValueState("state", "last long, number long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.timestamp, r.eventId, r.event) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        passed = [r for r in waiting if r[0] < mark]  # those of the watermark's own millisecond may still get company
        later = [tuple(r) for r in waiting[len(passed) :]]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(max(later[0][0], mark + 1))
        else:
            self.waiting.clear()
        last, number = self.state.get() or (None, 0)
        out = []
        for timestamp, _, event in passed:
            number += last is None or timestamp - last >= self.gap_ms
            last = timestamp
            out.append(Row(userId=key[0], event=event, number=int(number)))
        if passed:
            self.state.update((last, int(number)))
        return iter(out)

    def close(self) -> None:
        pass


def assign_sessions_stream(events: DataFrame, watermark: str = "10 minutes", gap_ms: int = SESSION_GAP_MS, column: str = "sessionId") -> DataFrame:
    """scrub.assign_sessions for a stream: session ids userId-n, given once the watermark has passed an event. A user's last number is kept."""
    events = events.drop(column)
    keyed_state(events.sparkSession)
    micro = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    held = with_watermark(events, watermark).select("userId", "eventId", "timestamp", "ts", F.to_json(F.struct(*events.columns), micro).alias("event"))
    out = held.groupBy("userId").transformWithState(SessionNumbers(gap_ms), SessionNumbers.output, "append", "eventTime")
    numbered = out.select(F.from_json("event", events.schema, micro).alias("event"), F.concat_ws("-", "userId", F.col("number").cast("string")).alias("_session"))
    return numbered.select("event.*", F.col("_session").alias(column))


def debounce_stream(events: DataFrame, watermark: str = "10 minutes", keys: tuple[str, ...] = ("userId", "sessionId", "targetElement"), gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """scrub.debounce for a stream: a burst of clicks is a session window, of which the last click is given once the watermark has passed the burst; other
    events go on at once. Times have milliseconds, and clicks gap_ms apart are no burst, so the window's gap is a microsecond less."""
    events = with_watermark(events, watermark)
    click = F.col("eventType") == "CLICK"
    last = F.max_by(F.struct(*events.columns), F.struct("timestamp", "eventId")).alias("last")
    bursts = events.filter(click).groupBy(F.session_window("ts", f"{gap_ms * 1000 - 1} microseconds").alias("burst"), *(F.col(k).alias(f"_{k}") for k in keys)).agg(last)
    return bursts.select("last.*").union(events.filter(~click | F.col("eventType").isNull()))
