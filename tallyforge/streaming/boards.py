"""Labelling events as streams: combos with a gap, milestones that count once, files in batches.

A combo ends where an answer comes at or after the last one's time plus the timeout; a session window would still join
answers at exactly the gap, so the state is kept by hand. State is one small row for each team. Events of a batch are
taken in the order of time and id; an event older than the team's last answer belongs to the running combo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COMBO = "team string, combo long, started_at timestamp, ended_at timestamp, amount long, answers long"
_STATE = "combo long, started_at timestamp, ended_at timestamp, amount long, answers long"


def combo_updates(answers: DataFrame, timeout: timedelta = timedelta(minutes=5)) -> DataFrame:
    """A stream of the combos that each batch changed. ``answers``: team, at, amount, id."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        changed = []
        for at, amount in zip(rows["at"], rows["amount"], strict=True):
            if now is None or at >= now[2] + timeout:
                if now is not None and changed and changed[-1][1] == now[0]:
                    changed[-1] = (key[0], *now)
                now = [(now[0] if now else 0) + 1, at, at, int(amount), 1]
                changed.append((key[0], *now))
            else:
                now = [now[0], now[1], max(now[2], at), now[3] + int(amount), now[4] + 1]
                if changed and changed[-1][1] == now[0]:
                    changed[-1] = (key[0], *now)
                else:
                    changed.append((key[0], *now))
        state.update((now[0], now[1].to_pydatetime() if hasattr(now[1], "to_pydatetime") else now[1], now[2].to_pydatetime() if hasattr(now[2], "to_pydatetime") else now[2], now[3], now[4]))
        yield pd.DataFrame(changed, columns=["team", "combo", "started_at", "ended_at", "amount", "answers"])

    return answers.groupBy("team").applyInPandasWithState(update, COMBO, _STATE, "update", GroupStateTimeout.NoTimeout)


def first_claims(claims: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of the first claim of each milestone. ``claims``: team, milestone, at. State is dropped ``late`` after."""
    return claims.withWatermark("at", late).dropDuplicatesWithinWatermark(["team", "milestone"])


def expired(leases: DataFrame, late: str = "1 minute") -> DataFrame:
    """Counts of leases by the minute in which they end, once that minute is over. ``leases``: row_id, expires_at."""
    return leases.withWatermark("expires_at", late).groupBy(F.window("expires_at", "1 minute")).agg(F.count(F.lit(1)).alias("leases"))


def in_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Transform each batch of a stream and write it under its number: a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
