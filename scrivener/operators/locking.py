"""Corrections that are applied only if the text is still the one they were made for.

A session's events come in order of seq: a *snapshot* gives the text as its editor has it,
a *correction* (version, length, start, end, original, replacement) was decided on a version
of the text some time ago.  It is applied if that version still stands, the text has the
length it had, and the range holds the original; applying it makes a new version, so of
several corrections that saw one version the first wins.  Marks of applied corrections
move with later edits, and are lost when one touches them.

:class:`Session` is one session's state; :func:`locked` drives it over a table,
``streaming.sessions`` over a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from .snapshots import hunks

EVENTS = "session string, seq long, kind string, text string, version long, length int, start int, end int, original string, replacement string"
RESULTS = "session string, seq long, result string, version long, start int, end int"


@dataclass
class Session:
    """Version and text, and the places of marks by the seq of their correction; a new session has version nought and no text."""

    version: int = 0
    text: str | None = None
    marks: dict[int, tuple[int, int]] = field(default_factory=dict)

    def edited(self, text: str) -> list[int]:
        """Takes a new text on: the marks that are lost."""
        if text == self.text:
            return []
        edits = hunks(self.text, text) if self.text is not None else []
        lost, kept = [], {}
        for seq, (start, end) in self.marks.items():
            if any(s < end and e > start and (e > s or start < s) for s, e, *_ in edits):
                lost.append(seq)
            else:
                shift = [n - e for s, e, _, n in edits if e <= start]
                kept[seq] = (start + (shift[-1] if shift else 0), end + (shift[-1] if shift else 0))
        self.version, self.text, self.marks = self.version + 1, text, kept
        return lost

    def take(self, event: dict) -> list[tuple[int, str, int, int | None, int | None]]:
        """(seq, result, version, start, end) rows of one event: what became of a correction, and marks that it or a snapshot lost."""
        seq = int(event["seq"])
        if event["kind"] == "snapshot":
            lost = self.edited(event["text"] or "")
            return [(k, "lost", self.version, None, None) for k in sorted(lost)]
        number = lambda c: None if event[c] is None or event[c] != event[c] else int(event[c])
        start, end, text = number("start"), number("end"), self.text
        fits = text is not None and number("version") == self.version and number("length") == len(text) and start is not None and end is not None and 0 <= start <= end <= len(text) and text[start:end] == event["original"]
        if not fits or event["replacement"] is None:
            return [(seq, "stale", self.version, start, end)]
        lost = self.edited(text[:start] + event["replacement"] + text[end:])
        self.marks[seq] = (start, start + len(event["replacement"]))
        return [(seq, "applied", self.version, *self.marks[seq]), *((k, "lost", self.version, None, None) for k in sorted(lost))]


def rows(session: str, found: list[tuple]) -> pd.DataFrame:
    kinds = {"seq": "int64", "version": "int64", "start": "Int32", "end": "Int32"}
    return pd.DataFrame([(session, *r) for r in found], columns=["session", "seq", "result", "version", "start", "end"]).astype(kinds)


def drive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events in order of session and seq; one session's state is all that is held."""
    key, state = None, Session()
    for batch in batches:
        for session, events in batch.groupby("session", sort=False):
            if session != key:
                key, state = session, Session()
            found = [r for e in events.to_dict("records") for r in state.take(e)]
            if found:
                yield rows(session, found)


def locked(events: DataFrame) -> DataFrame:
    """Results (columns of RESULTS) of a table of events (columns of EVENTS, session of any type).

    A session's events stream through one task in order; its text and living marks are held.
    Null texts are empty; corrections without a place, a version or a replacement are stale.
    """
    kind = events.schema["session"].dataType.simpleString()
    plain = events.selectExpr("cast(session as string) session", *[c for c in events.columns if c != "session"]).select(*[c.split()[0] for c in EVENTS.split(", ")])
    found = plain.repartition("session").sortWithinPartitions("session", "seq").mapInPandas(drive, RESULTS)
    return found.selectExpr(f"cast(session as {kind}) session", "seq", "result", "version", "start", "end")
