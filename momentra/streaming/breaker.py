"""Circuit breaker over an outcome stream: batch form as windows, streaming form as keyed state.

Open after three consecutive transient failures, or a full window of eight outcomes with six
failures; a success resets; 4xx outcomes are ignored; while open, calls are skipped for a while, then
one probe decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW, SHARE, CONSECUTIVE, SECONDS = 8, 0.75, 3, 120.0


def openings(outcomes: DataFrame, window: int = WINDOW, share: float = SHARE, consecutive: int = CONSECUTIVE) -> DataFrame:
    """``model, n, opens`` of ordered ``outcomes (model, n, failed)``: where the rule would open.

    Failures since the last success are counted by gaps and islands, so both rules read one window.
    """
    own = Window.partitionBy("model").orderBy("n")
    told = outcomes.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.withColumn("run", F.sum(F.col("failed").cast("int")).over(Window.partitionBy("model", "island").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    last = own.rowsBetween(1 - window, 0)
    told = told.withColumn("seen", F.count("*").over(last)).withColumn("bad", F.sum(F.col("failed").cast("int")).over(last))
    need = -(-int(share * 100) * window // 100)
    opens = F.col("failed") & ((F.col("run") >= consecutive) | ((F.col("seen") == window) & (F.col("bad") >= need)))
    return told.select("model", "n", opens.alias("opens"))


def step(state: tuple, at: float, failed: bool) -> tuple[tuple, str]:
    """One outcome: ``(recent failures, run, open until)`` and what the breaker did."""
    recent, run, until = state
    if at < until:
        return state, "skipped"
    probing = until > 0
    if not failed:
        return ("", 0, 0.0), "closed"
    recent, run = (recent + "1")[-WINDOW:], run + 1
    full = len(recent) == WINDOW and recent.count("1") >= SHARE * WINDOW
    if probing or run >= CONSECUTIVE or full:
        return (recent, run, at + SECONDS), "opened"
    return (recent, run, 0.0), "counted"


def breaker_stream(outcomes: DataFrame) -> DataFrame:
    """Structured Streaming form: ``model, n, action`` for a stream ``(model, n, at, failed)``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("", 0, 0.0)
        for b in batches:
            out = []
            for r in b.sort_values("n").itertuples():
                now, did = step(now, float(r.at), bool(r.failed))
                out.append((key[0], int(r.n), did))
            yield pd.DataFrame(out, columns=["model", "n", "action"])
        state.update(now)

    return outcomes.groupBy("model").applyInPandasWithState(run, "model long, n long, action string", "recent string, run int, until double", "append", GroupStateTimeout.NoTimeout)
