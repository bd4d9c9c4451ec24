"""The state of R8: open runs of a matter's events, closed by timers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: A run: its first and last moment (microseconds), the latest event with its state, and the number of events.
RUN = "opened long, last long, event_id long, state string, n_events long"
OUTPUT = f"matter string, {RUN}"


def with_event(runs: list[tuple], us: int, event_id: int | None, state: str | None, idle: int) -> list[tuple]:
    """The runs with one event more; runs that it brings within less than `idle` of each other become one."""
    merged = (us, us, event_id, state, 1)
    apart = []
    for run in runs:
        if run[0] - idle < merged[1] and merged[0] < run[1] + idle:
            late = max(merged, run, key=lambda r: (r[1], r[2] is not None, r[2] or 0))
            merged = (min(run[0], merged[0]), late[1], late[2], late[3], run[4] + merged[4])
        else:
            apart.append(run)
    return sorted([*apart, merged], key=lambda r: r[:2])


class IdleMatters(StatefulProcessor):
    """Keeps the open runs of each matter and gives each out when the watermark is `idle` microseconds past its last event."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.runs = handle, handle.getListState("runs", RUN)

    def _due(self, run: tuple) -> int:
        """The timer of a run, in milliseconds, not before it ended."""
        return -(-(run[1] + self.idle) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterable[Row], timerValues: TimerValues) -> Iterator[Row]:
        runs = [tuple(r) for r in self.runs.get()] if self.runs.exists() else []
        before = {self._due(r) for r in runs}
        for row in rows:
            runs = with_event(runs, row.us, row.event_id, row.state, self.idle)
        self.runs.put(runs)
        after = {self._due(r) for r in runs}
        for due in before - after:
            self.handle.deleteTimer(due)
        for due in after - before:
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        runs = [tuple(r) for r in self.runs.get()] if self.runs.exists() else []
        ended, going = [r for r in runs if self._due(r) <= now], [r for r in runs if self._due(r) > now]
        if going:
            self.runs.put(going)
        else:
            self.runs.clear()
        for run in ended:
            yield Row(matter=key[0], opened=run[0], last=run[1], event_id=run[2], state=run[3], n_events=run[4])

    def close(self) -> None:
        pass
