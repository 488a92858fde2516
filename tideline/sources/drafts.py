"""The boundary to what drafts events: a table function over the ordered shots of a scene.

Spark hands each scene's rows, in order, to one object; it holds one open draft, whatever the
scene's length. Drafts are only proposals: their ranges and evidence are checked afterwards."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: How long a shot's value holds a draft open, and how far its evidence lies, in milliseconds for each unit.
HOLD_MS, EVIDENCE_MS = 300_000, 400_000


@F.udtf(returnType="user_id long, scene long, draft long, kind string, start_ms long, end_ms long, evidence_ms long, shots long")
class EventDrafts:
    """A draft for each run of shots of one kind: from its first shot to as long as one of them
    holds, with the first shot's evidence."""

    def __init__(self) -> None:
        self.open: list | None = None
        self.drafts = 0

    def eval(self, shot: Row) -> Iterator[tuple]:
        end = shot["start_ms"] + round(shot["value"] * HOLD_MS)
        if self.open is not None and self.open[3] == shot["event_type"]:
            self.open[5] = max(self.open[5], end)
            self.open[7] += 1
            return
        if self.open is not None:
            yield tuple(self.open)
        evidence = shot["start_ms"] + round(shot["value"] * EVIDENCE_MS)
        self.open = [shot["user_id"], shot["scene"], self.drafts, shot["event_type"], shot["start_ms"], end, evidence, 1]
        self.drafts += 1

    def terminate(self) -> Iterator[tuple]:
        if self.open is not None:
            yield tuple(self.open)


def drafts(shots: DataFrame) -> DataFrame:
    """Drafts of all scenes of shots (user_id, scene, ordinal, event_type, value, start_ms)."""
    rows = shots.select("user_id", "scene", "ordinal", "event_type", "value", "start_ms")
    return EventDrafts(rows.asTable().partitionBy("user_id", "scene").orderBy("ordinal"))
