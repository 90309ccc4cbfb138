"""Keyed state of the streams that remember something for ever.

Each processor keeps one small value per key in the state store, and optionally a timer that forgets a key after a time without
events. A micro-batch reads and writes the state of its own keys only. All rows that one batch brings for a key are
ordered in one task, so ``maxFilesPerTrigger`` or the like bounds what a hot key can bring at once.

The processors are sent to the executors by value, so workers need not have this package.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor

#: Stands for null in whole numbers, which pandas would turn into floating point.
NIL = -2**63


class Forgetful(StatefulProcessor):
    """A value per key. With ``idle`` (microseconds of event time) a key starts anew after a longer time without rows; a timer takes its
    value out of the store once the watermark has passed that time."""

    schema = ""

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)

    def spells(self, us: np.ndarray, last: int) -> list[tuple[int, int, bool]]:
        """(from, to, whether it starts anew) of the rows, ordered by time, between two long times without rows."""
        if self.idle is None:
            return [(0, len(us), False)]
        new = np.diff(np.concatenate([[us[0] if last == NIL else last], us])) > self.idle
        cuts = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), len(us)]
        return [(a, z, bool(new[a])) for a, z in zip(cuts, cuts[1:])]

    def until(self, last: int) -> None:
        """Set the timer of the key at hand anew."""
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer((last + self.idle) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


class Fragments(Forgetful):
    """Running sums of a file's fragment events."""

    schema = "bytes bigint, number bigint, started bigint, finished bigint, last bigint"

    def handleInputRows(self, key, rows, timerValues):
        d = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        state = self.value.get() if self.value.exists() else (0, 0, NIL, NIL, NIL)
        parts = []
        for a, z, new in self.spells(d["us"].to_numpy(), state[-1]):
            part = d.iloc[a:z].copy()
            done, number, started, finished, _ = (0, 0, NIL, NIL, NIL) if new else state
            us, fin, total = part["us"].to_numpy(), (part["status"] == "finished").to_numpy(), part["total_bytes"].to_numpy()
            started = int(us[0]) if started == NIL else started
            part["sum_bytes"] = done + np.cumsum(np.where(fin & (total != NIL), total, 0))
            part["sum_index"] = number + np.cumsum(fin)
            ends = np.maximum.accumulate(np.concatenate([[finished], np.where(fin, us, NIL)]))
            part["frag_started"], part["started"] = ends[:-1], started
            state = (int(part["sum_bytes"].iloc[-1]), int(part["sum_index"].iloc[-1]), started, int(ends[-1]), int(us[-1]))
            parts.append(part)
        self.value.update(state)
        self.until(state[-1])
        yield pd.concat(parts)


class LivePolls(Forgetful):
    """The highest segment number of a live stream; gives the new ones of each poll's last two. A poll comes whole, in one batch."""

    schema = "top bigint, last bigint"

    def handleInputRows(self, key, rows, timerValues):
        d = pd.concat(list(rows))
        when = d.groupby("poll")["us"].max().sort_index() if self.idle is not None else pd.Series(0, index=np.unique(d["poll"]))
        d = d[["stream", "poll", "seq"]].drop_duplicates().sort_values(["poll", "seq"], ascending=[True, False])
        two = d[d.groupby("poll").cumcount() < 2]
        tops = two.drop_duplicates("poll")["seq"].to_numpy()
        top, last = self.value.get() if self.value.exists() else (NIL, NIL)
        limits = []
        for a, z, new in self.spells(when.to_numpy(), last):
            before = np.maximum.accumulate(np.concatenate([[NIL if new else top], tops[a:z]]))
            limits.append(before[:-1])
            top = int(before[-1])
        limit = pd.Series(np.concatenate(limits), index=when.index)
        self.value.update((top, int(when.iloc[-1])))
        self.until(int(when.iloc[-1]))
        yield two[two["seq"].to_numpy() > limit.loc[two["poll"].to_numpy()].to_numpy()]


class Archive(Forgetful):
    """Ids that were seen; gives each new one once."""

    schema = "seen boolean"

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.value.update((True,))

    def handleInputRows(self, key, rows, timerValues):
        for _ in rows:
            pass
        if not self.value.exists():
            self.value.update((True,))
            yield pd.DataFrame({"archive_id": [key[0]]})


cloudpickle.register_pickle_by_value(sys.modules[__name__])
