"""Streams of new crawls and events: file sources read until nothing is left, keyed state, and windows with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chainloom.operators.requests import METHODS, ParentResolver


def follow_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New lines of a folder of TSV manifests."""
    return spark.readStream.options(sep="\t", quote="").schema(schema).csv(path)


def follow_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of an events folder."""
    return spark.readStream.schema(schema).parquet(folder)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream until all that is there is read; its rows as a table in memory (for tests and small results)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def unique_samples(rows: DataFrame, ts: str, key: str, delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark: a crawl that is listed twice counts once."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, ts: str, width: str, delay: str, *keys: str) -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, delay: str, key: str) -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


class PageLoad(StatefulProcessor):
    """Keeps what the parent resolution knows of one sample between batches, so a log may arrive in pieces.

    State: the events seen so far, in order. Each batch resolves the sample anew and gives the requests that are new or changed;
    a page load is small, and reading it again is exact where patching (downloads, navigations) looks back."""

    FIELDS = ("seq", "ts", "method", "frame_id", "parent_frame_id", "loader_id", "resource_type", "url", "url_fragment", "initiator_type", "redirect_url", "reason")
    STATE = "seq long, ts long, method string, frame_id string, parent_frame_id string, loader_id string, resource_type string, url string, url_fragment string, initiator_type string, redirect_url string, reason string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", self.STATE)

    @staticmethod
    def resolve(rows: list[tuple]) -> list[list]:
        resolver = ParentResolver(False)
        frame = pd.DataFrame(rows, columns=PageLoad.FIELDS).astype(object)
        resolver.run(frame.where(frame.notna(), None).itertuples(index=False))
        return resolver.requests

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = [tuple(x) for x in self.events.get()] if self.events.exists() else []
        fresh = [tuple(None if pd.isna(v) else v for v in r) for pdf in rows for r in pdf[list(self.FIELDS)].itertuples(index=False)]
        everything = sorted([*before, *fresh], key=lambda r: r[0])
        self.events.put(everything)
        known = {tuple(x) for x in self.resolve(before)} if before else set()
        out = [[key[0], *x] for x in self.resolve(everything) if tuple(x) not in known]
        yield pd.DataFrame(out, columns=["sample_id", "seq", "request_url", "resource_type", "parent_url", "parent_source", "ts", "frame_id"])

    def close(self) -> None:
        pass


def stream_parents(events: DataFrame) -> DataFrame:
    """Requests with parents of a stream of log events, as they become known. Needs the RocksDB state store."""
    from chainloom.sources.schemas import REQUESTS

    kept = events.where(F.col("method").isin(*METHODS)).select("sample_id", *PageLoad.FIELDS)
    return kept.groupBy("sample_id").transformWithStateInPandas(PageLoad(), REQUESTS, "Update", "None")
