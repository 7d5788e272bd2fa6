"""Keyed state: the last record of a key in capture order."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor


class LastRecord(StatefulProcessor):
    """Pairs each record with the one before it and marks records that arrive too late."""

    def __init__(self, columns, order, fields, schema):
        self.columns, self.order, self.fields, self.schema = columns, order, fields, schema

    def init(self, handle):
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        at = self.fields.index(self.order)
        held = self.last.get() if self.last.exists() else None
        held = tuple(held) if held is not None else None
        moved = False
        # a key has one record per capture, so one batch holds few of them
        for row in sorted(rows, key=lambda r: r[self.order]):
            late = held is not None and row[self.order] <= held[at]
            before = None if held is None or late else Row(*self.fields)(*held)
            yield Row(*self.columns, "p", "late")(*[row[c] for c in self.columns], before, late)
            if not late:
                held, moved = tuple(row[f] for f in self.fields), True
        if moved:
            self.last.update(held)

    def close(self):
        pass
