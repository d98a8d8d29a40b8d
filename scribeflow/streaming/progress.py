"""Progress of streams to a function of the caller (T5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class ProgressListener(StreamingQueryListener):
    """Hands (event, detail) of every stream of a session to a function."""

    def __init__(self, tell: Callable[[str, dict], None]):
        self.tell = tell

    def onQueryStarted(self, event):
        self.tell("started", {"id": str(event.id), "name": event.name})

    def onQueryProgress(self, event):
        p = event.progress
        self.tell("progress", {"id": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event):
        self.tell("idle", {"id": str(event.id)})

    def onQueryTerminated(self, event):
        self.tell("failed" if event.exception else "completed", {"id": str(event.id), "error": event.exception})
