"""State of repositories in a stream.

ST5, S18: ``Refresher`` keeps for each repository the hashes with which it was
last handled and a timer for its next refresh; ``Framing`` keeps what a source
of chunks has sent since its last line feed.  Both states are in Spark's state
store, so a stream that is started again goes on where it was.  The rows of a
key in one batch are put in order in memory: what a source gives in a batch
(``maxFilesPerTrigger``) bounds them.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds between refreshes, bytes of a message.
REFRESH_SECONDS, MESSAGE_BYTES = 3600, 512
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Refresher(StatefulProcessor):
    """``skip``, ``changed`` or ``all`` for each event by the hashes stored; ``refresh`` when nothing came for a period, with the number of periods passed."""

    def __init__(self, seconds: int = REFRESH_SECONDS):
        self.period = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "commit_hash string, code_hash string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.seen.get() if self.seen.exists() else None
        commit, code, last = before if before else (None, None, None)
        known = before is not None
        for r in sorted(rows, key=lambda r: (r["at"], r["number"])):
            same_code = known and r["code_hash"] == code
            action = "all" if not same_code else "skip" if r["commit_hash"] == commit else "changed"
            commit, code, known = r["commit_hash"], r["code_hash"], True
            last = max(last or 0, int(r["at"].timestamp() * 1000))
            yield Row(repo=key[0], number=r["number"], action=action, periods=0)
        self.seen.update((commit, code, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(last + self.period)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        commit, code, last = self.seen.get()
        passed = max(1, (timerValues.getCurrentWatermarkInMs() - last) // self.period)
        self.seen.update((commit, code, last + passed * self.period))
        self.handle.registerTimer(last + (passed + 1) * self.period)
        yield Row(repo=key[0], number=None, action="refresh", periods=passed)

    def close(self) -> None:
        pass


def refreshed(events: DataFrame, seconds: int = REFRESH_SECONDS, late: str = "0 seconds") -> DataFrame:
    """(repo, number, action, periods) of a stream of (repo, number, commit_hash, code_hash, at)."""
    marked = events.withWatermark("at", late)
    return marked.groupBy("repo").transformWithState(Refresher(seconds), "repo string, number long, action string, periods long", "Append", "EventTime")


class Framing(StatefulProcessor):
    """Lines of chunks that may end anywhere; a line of more than ``most`` bytes is no message and gives null."""

    def __init__(self, most: int = MESSAGE_BYTES):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "text string, lines long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        text, lines = self.rest.get() if self.rest.exists() else ("", 0)
        for r in sorted(rows, key=lambda r: r["number"]):
            *whole, text = (text + (r["chunk"] or "")).split("\n")
            for line in whole:
                yield Row(source=key[0], line=lines, name=line if len(line.encode()) <= self.most else None)
                lines += 1
        self.rest.update((text, lines))

    def close(self) -> None:
        pass


def framed(chunks: DataFrame, most: int = MESSAGE_BYTES) -> DataFrame:
    """(source, line, name) of a stream of (source, number, chunk); a source's chunks come in order of their numbers."""
    return chunks.groupBy("source").transformWithState(Framing(most), "source string, line long, name string", "Append", "None")


@contextlib.contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Processors need a store with column families; a query takes the setting when it starts."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """All that the stream has now goes to ``folder``/rows; started again, it goes on from ``folder``/checkpoint."""
    spark = stream.sparkSession
    with _state_store(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
