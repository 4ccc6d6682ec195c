"""Chat sessions as they go on: every turn is answered with the turns before it, which are state.

An extension of :func:`quernel.operators.conversations.respond` to arriving turns.  A session's
turns are a list in the state store, to which an answered turn is appended, so no turn carries
a copy of all earlier ones; what a session said before a restart is there after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The state store that can hold lists.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TURN = "text string, answer string"

Responder = Callable[[list[dict], str], str]


class Session(StatefulProcessor):
    """One session: its last turns, and how many there were."""

    def __init__(self, responder: Responder, last: int | None):
        self.responder, self.last = responder, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", TURN)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("turn", kind="stable")
        history = [{"text": t[0], "answer": t[1]} for t in self.turns.get()]
        n = self.count.get()[0] if self.count.exists() else 0
        out = []
        for turn, text in zip(new["turn"], new["text"], strict=True):
            answer = self.responder(history if self.last is None else history[len(history) - min(self.last, len(history)) :], text)
            out.append((key[0], turn, n, answer))
            history.append({"text": text, "answer": answer})
            n += 1
        added = [(t["text"], t["answer"]) for t in history[len(history) - len(out) :]]
        if self.last is None:
            self.turns.appendList(added)
        else:
            self.turns.put([(t["text"], t["answer"]) for t in history[len(history) - min(self.last, len(history)) :]])
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["session", "turn", "n_history", "answer"])

    def close(self) -> None:
        pass


def answered(turns: DataFrame, responder: Responder, last: int | None = None) -> DataFrame:
    """(session, turn, n_history, answer) of a stream with (session, turn, text).

    Turns of one trigger are taken in order of ``turn``; turns of a later one come after them.  With ``last`` only so many
    turns are kept as history; without, a session's turns are held while it answers.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind = turns.schema["session"].dataType.simpleString()
    return turns.groupBy("session").transformWithStateInPandas(
        statefulProcessor=Session(responder, last), outputStructType=f"session {kind}, turn long, n_history long, answer string", outputMode="Append", timeMode="None"
    )


def turns_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def write_answers(answers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append answers as Parquet, once each, and stop when all present turns are answered."""
    return answers.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
