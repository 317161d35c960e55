"""An extension: journals as streams, their state kept up to date and broken sequences told as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.journal import EVENTS

RESULT = "job string, event_id long, event string, rule string"
#: Started, complete, masters and a bit for each archive seen.
STATE = "started boolean, complete boolean, masters long, archives string"


def follow(events: DataFrame, archive_count: int, master_expected: bool) -> DataFrame:
    """(job, event_id, event, rule) for events of a stream (job, event_id, event, archive_index) that break their journal's sequence.

    Events of a journal have to come in order, as a single writer leaves them; a batch's are sorted by event_id. The
    state of a job is as small as its number of archives.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, complete, masters, seen = state.get if state.exists else (False, False, 0, "")
        archives, out = {int(x) for x in seen.split(",") if x}, []
        for r in pd.concat(list(batches)).sort_values("event_id").itertuples():
            whole = len(archives) >= archive_count
            rule = None
            if not started and r.event != "START":
                rule = "no_start"
            elif complete:
                rule = "after_complete"
            elif r.event == "START":
                rule = "second_start" if started else None
            elif r.event == "ARCHIVE_VERIFIED":
                index = None if pd.isna(r.archive_index) else int(r.archive_index)
                rule = "index_range" if index is None or not 0 <= index < archive_count else "index_repeated" if index in archives else "archive_after_master" if masters else None
                if rule in (None, "archive_after_master"):
                    archives.add(index)
            elif r.event == "MASTER_VERIFIED":
                rule = None if master_expected and not masters and whole else "master"
                masters += 1
            elif r.event == "COMPLETE":
                rule = None if whole and (masters or not master_expected) else "premature_complete"
                complete = True
            elif r.event not in EVENTS:
                rule = "unknown_event"
            started = True
            if rule:
                out.append((key[0], r.event_id, r.event, rule))
        state.update((started, complete, masters, ",".join(map(str, sorted(archives)))))
        yield pd.DataFrame(out, columns=["job", "event_id", "event", "rule"])

    return events.groupBy("job").applyInPandasWithState(run, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def totals(events: DataFrame, time: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events and archive bytes a job and window, late ones up to ``late`` counted: plain windowed aggregation."""
    timed = events.withWatermark(time, late)
    return timed.groupBy("job", F.window(time, window)).agg(F.count("*").alias("n_events"), F.sum("size_bytes").alias("size_bytes"))
