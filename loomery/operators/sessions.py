"""Ordered folds over the events of a session, and bracket sessions replayed by them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(events: DataFrame, session: str, order: list[str], schema: str, start: Callable, step: Callable, end: Callable) -> DataFrame:
    """One row of ``schema`` for each session: ``end(key, state)`` after ``step(state, row)`` for each of its
    events in ``order``, from ``start(row)`` of its first.

    Sessions are dealt to tasks and sorted there (Spark spills what doesn't fit); a task reads
    its events as a stream, a batch at a time, and holds the state of one session. Events of a null
    session are left out.
    """
    columns = [session, *(c for c in events.columns if c != session)]

    def of(batches):
        key, state, out = None, None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if state is None or row[0] != key:
                    if state is not None:
                        out.append(end(key, state))
                    key, state = row[0], start(row)
                state = step(state, row)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if state is not None:
            out.append(end(key, state))
        if out:
            yield pd.DataFrame(out, columns=names)

    rows = events.where(F.col(session).isNotNull()).select(*columns)
    names = events.sparkSession.createDataFrame([], schema).columns
    return rows.repartition(session).sortWithinPartitions(session, *order).mapInPandas(of, schema)


class Bracket:
    """A champion meets one challenger after the other; every decision can be undone and redone.

    ``before`` and ``after`` hold champions: of each decision taken, the one before it, and of each
    decision undone, the one after it. A new decision forgets those undone; what can't be done (no
    challenger left, nothing to undo or redo) changes nothing.
    """

    def __init__(self, total: int):
        self.total, self.champion, self.challenger = total, 0, 1
        self.before: list[int] = []
        self.after: list[int] = []

    def act(self, action: str) -> None:
        if action == "undo":
            if self.before:
                self.after.append(self.champion)
                self.champion = self.before.pop()
                self.challenger -= 1
        elif action == "redo":
            if self.after:
                self.before.append(self.champion)
                self.champion = self.after.pop()
                self.challenger += 1
        elif action in ("champion", "challenger", "skip") and self.challenger < self.total:
            self.before.append(self.champion)
            self.after = []
            self.champion = self.challenger if action == "challenger" else self.champion
            self.challenger += 1


def brackets(events: DataFrame) -> DataFrame:
    """Where each bracket stands after its events (``session``, ``seq``, ``action``, ``total``): ``champion``,
    ``challenger`` (places from 0), ``done``, and how many decisions can be undone and redone."""

    def step(state: Bracket, row) -> Bracket:
        state.act(row.action)
        return state

    return folded(
        events.select("session", "seq", "action", "total"), "session", ["seq"], "session long, champion int, challenger int, done boolean, undoable int, redoable int",
        lambda row: Bracket(row.total), step, lambda key, b: (key, b.champion, b.challenger, b.challenger >= b.total, len(b.before), len(b.after)),
    )
