"""Incremental ingest with Structured Streaming: page sink, first-seen dedup, live counters and rates."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siteglass.sources.sinks import newest_by_url


def rate_limited(spark: SparkSession, schema: str, folder: str, files: int) -> DataFrame:
    """A stream of fetched pages from a folder, of which a trigger takes so many files at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


class Progress(StreamingQueryListener):
    """Events of a session's streams, the newest last: (kind, name, batch, rows, rows a second). Keeps the last ``most``."""

    def __init__(self, most: int = 1000):
        self.events: deque[tuple[str, str, int, int, float]] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.events.append(("started", event.name or "", -1, 0, 0.0))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.events.append(("progress", p.name or "", p.batchId, p.numInputRows, p.processedRowsPerSecond or 0.0))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.events.append(("idle", "", -1, 0, 0.0))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.events.append(("ended" if event.exception is None else "failed", "", -1, 0, 0.0))


def notable(pages: DataFrame, slow_ms: int = 3000) -> DataFrame:
    """(url, why) of pages worth showing while a crawl runs: failures, errors of the server and the client, and slow answers."""
    why = F.when(F.col("state") == "error", "no response").when(F.col("status_code") >= 500, "server error").when(F.col("status_code") >= 400, "client error").when(F.col("response_time_ms") > slow_ms, "slow")
    return pages.select("url", why.alias("why")).where("why IS NOT NULL")


def page_sink(pages: DataFrame, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, every: str = "") -> StreamingQuery:
    """Append each batch under its number, so that a repeated batch overwrites itself; reading takes the newest row of a URL.

    ``every`` is the least time between batches, such as '2 seconds'.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if each is not None:
            each(batch, number)

    out = pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out).start()


def stored_pages(spark: SparkSession, folder: str) -> DataFrame:
    return newest_by_url(spark.read.parquet(folder).drop("batch"))


def first_seen(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key; keys are forgotten once the watermark has passed them."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def sliding_rate(events: DataFrame, ts: str = "ts", width: str = "4 seconds", slide: str = "1 second") -> DataFrame:
    """(start, end, n, rate): events a second over a sliding window; for a stream or a table."""
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return events.groupBy(F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n", (F.col("n") / seconds).alias("rate"))


def counters(events: DataFrame, by: str, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """(start, by, n) over tumbling windows."""
    return events.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select("w.start", by, "n")


def sessions(events: DataFrame, by: str, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(by, start, end, n) of runs of events with gaps below the given one."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, "w.start", "w.end", "n")


def admitted(items: DataFrame, per_host: int) -> DataFrame:
    """Stream items (host, url, seq): the first per_host distinct URLs of each host, kept in state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            if row.url not in seen and len(seen) < per_host:
                seen.add(row.url)
                out.append((key[0], row.url, row.seq))
        state.update((sorted(seen),))
        yield pd.DataFrame(out, columns=["host", "url", "seq"])

    return items.groupBy("host").applyInPandasWithState(step, "host string, url string, seq long", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def resumed(done: DataFrame, found: DataFrame, most: int = -1) -> DataFrame:
    """URLs still to fetch: found but not done; a budget counts what is done already."""
    left = found.select("url").distinct().join(done.select("url"), "url", "left_anti")
    return left if most < 0 else left.orderBy("url").limit(max(0, most - done.count()))
