"""A driver-side event bus: handlers of an event and of all events, in order of subscription.

Events of jobs are sent when the job has run, with what it has counted: a plan that is never run sends
none. `observed` attaches the counts to a DataFrame; `StreamEvents` does the same for each batch of a stream.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener

Handler = Callable[[str, dict], None]
log = logging.getLogger(__name__)


class Bus:
    """Passes events on; a handler that fails stops neither the others nor the sender."""

    def __init__(self) -> None:
        self.named: dict[str, list[Handler]] = {}
        self.every: list[Handler] = []

    def subscribe(self, event: str, handler: Handler) -> None:
        self.named.setdefault(event, []).append(handler)

    def subscribe_all(self, handler: Handler) -> None:
        self.every.append(handler)

    def emit(self, event: str, **payload) -> None:
        for handler in [*self.named.get(event, ()), *self.every]:
            try:
                handler(event, payload)
            except Exception:
                log.exception("a handler of %s failed", event)


bus = Bus()


def observed(df: DataFrame, events: dict[str, dict[str, Column]], to: Bus = bus) -> DataFrame:
    """The rows of `df`; when the first action over them has ended, each event is sent with its aggregates over those rows.

    A thread waits for that action; it ends with the driver.
    """
    observation = Observation()
    names = {f"{event}/{name}": (event, name) for event, metrics in events.items() for name in metrics}
    seen = df.observe(observation, *[events[event][name].alias(k) for k, (event, name) in names.items()])

    def wait() -> None:
        try:
            got = observation.get
        except Py4JError:  # the session has ended
            return
        for event in events:
            to.emit(event, **{name: got[k] for k, (e, name) in names.items() if e == event})

    threading.Thread(target=wait, daemon=True, name="observed").start()
    return seen


class StreamEvents(StreamingQueryListener):
    """Sends what `DataFrame.observe(name, ...)` has counted in each batch of a stream, under that name, and how streams begin and end."""

    def __init__(self, to: Bus = bus):
        self.to = to

    def onQueryStarted(self, event) -> None:
        self.to.emit("stream:started", id=str(event.id), name=event.name)

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.to.emit(name, batch=event.progress.batchId, **row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.to.emit("stream:ended", id=str(event.id), error=event.exception)
