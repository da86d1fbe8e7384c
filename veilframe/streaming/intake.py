"""What comes in by stream: requests within a rate for each user, and rows written in batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilframe.ship import ship

#: Requests a second that a user's bucket refills with, and what it holds.
RATE, BURST = 25.0, 100.0


@dataclass
class Bucket:
    """A token bucket; times are seconds and may repeat, but a time before the last one refills nothing."""

    rate: float = RATE
    burst: float = BURST
    tokens: float | None = None
    last: float = 0.0

    def allow(self, at: float) -> bool:
        if self.tokens is None:
            self.tokens, self.last = self.burst, at
        self.tokens = min(self.burst, self.tokens + max(0.0, at - self.last) * self.rate)
        self.last = max(self.last, at)
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True


def limit(requests: DataFrame, rate: float = RATE, burst: float = BURST) -> DataFrame:
    """requests (username, id, at in seconds) with ``allowed``; users' rows are sorted and streamed, one bucket at a time.
    A null time is refused."""
    ship(requests.sparkSession)
    kinds = dict(requests.dtypes)
    rows = requests.select("username", "id", requests["at"].cast("double").alias("at")).repartition("username").sortWithinPartitions("username", "at", "id")

    def run(frames):
        import pandas as pd

        current, bucket = object(), Bucket(rate, burst)
        for pdf in frames:
            out = []
            for user, id_, at in zip(pdf["username"], pdf["id"], pdf["at"]):
                if user != current:
                    current, bucket = user, Bucket(rate, burst)
                out.append((user, id_, bool(at == at and bucket.allow(at))))
            yield pd.DataFrame(out, columns=["username", "id", "allowed"])

    return rows.mapInPandas(run, f"username string, id {kinds['id']}, allowed boolean")


class _Limited(StatefulProcessor):
    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - Spark's names
        import pandas as pd

        bucket = Bucket(self.rate, self.burst, *(self.kept.get() if self.kept.exists() else ()))
        asked = sorted((at, id_) for pdf in rows for at, id_ in zip(pdf["at"], pdf["id"]))
        out = [(key[0], id_, bucket.allow(at)) for at, id_ in asked]
        self.kept.update((bucket.tokens, bucket.last))
        yield pd.DataFrame(out, columns=["username", "id", "allowed"])

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, rate: float = RATE, burst: float = BURST) -> DataFrame:
    """The same over a stream (username, id string, at double), with a bucket kept for each user; needs the RocksDB state store."""
    ship(requests.sparkSession)
    return requests.filter("at IS NOT NULL").groupBy("username").transformWithStateInPandas(_Limited(rate, burst), "username string, id string, allowed boolean", "Append", "none")


def write_batches(stream: DataFrame, path: str, checkpoint: str, every: str | None = "100 milliseconds"):
    """Appends a stream to Parquet, once each interval (None: all that is there, then ends); returns the query.

    A batch is committed as a whole or not at all, and after a loss goes on where the checkpoint says.
    """
    out = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if every is None else out.trigger(processingTime=every)).start()
