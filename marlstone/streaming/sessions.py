"""Ticket dialogues as keyed state: a reason, then an email address in at most three tries, then a ticket."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.answers import CANCEL, EMAIL, MOST_LOCAL

# Fixed value: tries for an address.
MOST_TRIES = 3
#: Milliseconds after its last turn in which a dialogue can go on.
IDLE_MS = 24 * 3_600_000
STATE = "stage string, tries int"
OUTPUT = "conv_id long, stage string, turns int"


def step(stage: str, tries: int, text: str) -> tuple[str, int]:
    """The next (stage, tries) of a dialogue: reason, email, then ticket, cancelled or abandoned."""
    if stage in ("ticket", "cancelled", "abandoned"):
        return stage, tries
    low = text.lower()
    if "@" not in low and any(c in low for c in CANCEL):
        return "cancelled", tries
    if stage == "reason":
        return "email", 0
    address = text.strip()
    if re.match(EMAIL, address) and address.index("@") <= MOST_LOCAL:
        return "ticket", tries
    return ("abandoned", tries + 1) if tries + 1 >= MOST_TRIES else ("email", tries + 1)


class TicketDialogue(StatefulProcessor):
    """A conversation's stage as a value in the state store, and a timer that ends it when it has been idle too long."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.dialogue = handle, handle.getValueState("dialogue", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Moves the stage on by the new turns, in order."""
        stage, tries = self.dialogue.get() if self.dialogue.exists() else ("reason", 0)
        turns = pd.concat(list(rows)).sort_values("turn")
        for text in turns["text"]:
            stage, tries = step(stage, tries, text or "")
        self.dialogue.update((stage, tries))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "stage": [stage], "turns": [len(turns)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Forgets the conversation: its next turn begins a new dialogue."""
        self.dialogue.clear()
        yield pd.DataFrame({"conv_id": [key[0]], "stage": ["expired"], "turns": [0]})

    def close(self) -> None:
        pass


def stream(turns: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """(conv_id, stage, turns) updates of a stream of user turns (conv_id, turn, text). A dialogue goes on over batches and
    restarts; one that has had no turn for idle_ms ends as `expired`, and its state goes, at the next batch. State of this
    kind needs Spark's RocksDB store, which is set for the session; and no batches without data, as with timers of the
    clock a run of what is available would have them without end.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return turns.groupBy("conv_id").transformWithStateInPandas(TicketDialogue(idle_ms), OUTPUT, "update", "processingTime")


def replay(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The final stage of each conversation of a stored table, by the same steps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stage, tries = "reason", 0
        for text in pdf.sort_values("turn")["text"]:
            stage, tries = step(stage, tries, text or "")
        return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]], "stage": [stage], "turns": [len(pdf)]})

    return turns.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandas(run, OUTPUT)
