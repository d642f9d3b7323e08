"""Log events to requests with their parents.

Filters are windows and grouped higher-order functions. Parent resolution depends on conditional state, so the exact
form folds each sample's events in file order (a grouped map: a sample is one page load); ``frame_parents`` states the
common case by windows alone.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.sources.schemas import REQUESTS

# Log methods in their index order.
METHODS = (
    "Network.requestWillBeSent", "Network.responseReceived", "Page.frameAttached", "Page.frameDetached",
    "Network.loadingFailed", "Page.navigatedWithinDocument", "Page.frameRequestedNavigation", "Page.downloadWillBegin",
)
SENT, RECEIVED, ATTACHED, DETACHED, FAILED, ANCHOR, NAVIGATION, DOWNLOAD = METHODS
CRASH_PAGE = "chrome-error://chromewebdata/"
KNOWN_INITIATORS = ("script", "parser", "other")
#: A navigation and its request are less than this apart.
NAVIGATION_GAP = 20


def from_start(events: DataFrame) -> DataFrame:
    """Events from the first request of the start url on; samples without one are empty."""
    w = Window.partitionBy("sample_id")
    first = F.min(F.when((F.col("method") == SENT) & (F.col("url") == F.col("start_url")), F.col("seq"))).over(w)
    return events.withColumn("first seq", first).where(F.col("seq") >= F.col("first seq")).drop("first seq")


def of_methods(events: DataFrame, indexes: list[int] | None = None) -> DataFrame:
    """Events of the methods chosen by index (all eight by default); responses only if they ask for a refresh."""
    wanted = [METHODS[i] for i in indexes] if indexes else list(METHODS)
    refresh = F.coalesce(F.map_contains_key("response_headers", F.lit("Refresh")), F.lit(False))
    return events.where(F.col("method").isin(wanted) & ((F.col("method") != RECEIVED) | refresh))


def without_crashes(events: DataFrame) -> DataFrame:
    """No event of a sample in which the browser's error page asks for something."""
    crash = F.max(((F.col("method") == SENT) & (F.col("document_url") == CRASH_PAGE)).cast("int")).over(Window.partitionBy("sample_id"))
    return events.withColumn("crash", F.coalesce(crash, F.lit(0))).where("crash = 0").drop("crash")


def failed_requests(rows: DataFrame, group: list[str], seq: str, sent: str, failed: str) -> DataFrame:
    """(group, request_seq, failure_seq): each failure takes the latest request of its group that no failure took.

    rows: boolean columns ``sent`` and ``failed``. A group is one request id of one sample, so its array is short."""
    start = F.struct(F.array().cast("array<long>").alias("open"), F.array().cast("array<struct<request_seq:long,failure_seq:long>>").alias("pairs"))

    def step(state, e):
        some = F.size(state["open"]) > 0
        pair = F.struct(F.try_element_at(state["open"], F.lit(-1)).alias("request_seq"), e["seq"].alias("failure_seq"))
        return F.when(
            e["failed"], F.struct(F.slice(state["open"], 1, F.greatest(F.size(state["open"]) - 1, F.lit(0))).alias("open"), F.when(some, F.array_append(state["pairs"], pair)).otherwise(state["pairs"]).alias("pairs"))
        ).otherwise(F.struct(F.array_append(state["open"], e["seq"]).alias("open"), state["pairs"].alias("pairs")))

    ordered = rows.where(F.col(sent) | F.col(failed)).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).cast("long").alias("seq"), F.col(failed).alias("failed")))).alias("es"))
    return ordered.select(*group, F.explode(F.aggregate("es", start, step, lambda s: s["pairs"])).alias("p")).select(*group, "p.*")


def without_failures(events: DataFrame) -> DataFrame:
    """Requests that failed go; the failures stay."""
    marked = events.withColumn("sent", F.col("method") == SENT).withColumn("failed", F.col("method") == FAILED)
    gone = failed_requests(marked, ["sample_id", "request_id"], "seq", "sent", "failed").select("sample_id", F.col("request_seq").alias("seq"))
    return events.join(gone, ["sample_id", "seq"], "left_anti")


def target_events(events: DataFrame, indexes: list[int] | None = None) -> DataFrame:
    """All filters of the extraction in their order."""
    return without_failures(without_crashes(of_methods(from_start(events), indexes)))


class ParentResolver:
    """Parents of one sample's requests. Each handler takes an event and may add to ``requests`` or ``rejects``."""

    def __init__(self, strict: bool) -> None:
        self.strict = strict
        self.requests: list[list] = []
        self.rejects: list[tuple[int, str]] = []
        self.navigations: list[tuple[str, str, str, int]] = []
        self.full_url: dict[str, str] = {}
        self.frame_parent: dict[str, str] = {}
        self.frame_url: dict[str, str] = {}
        self.frame_loader: dict[str, str] = {}
        self.loader_url: dict[str, str] = {}
        self.last_with_url: dict[str, int] = {}
        self.count = 0

    def add(self, e, url: str, kind: str, parent: str, source: str) -> None:
        self.last_with_url[url] = len(self.requests)
        self.requests.append([e.seq, url, kind, parent, source, e.ts, e.frame_id])

    def reject(self, e, why: str) -> None:
        self.rejects.append((e.seq, why))

    def document_parent(self, e) -> tuple[str, str] | None:
        """Parent url and source by the first rule that fits: first event, redirect, attached frame, known frame."""
        if self.count == 0:
            return "", "root"
        if e.redirect_url is not None:
            found = self.full_url.get(e.redirect_url)
            if found is None:
                self.reject(e, "unknown redirect source")
                return None
            return found, "redirectResponse"
        frame = e.frame_id
        if frame in self.frame_parent:
            frame = self.frame_parent[frame]
            if frame not in self.frame_url:  # a frame without a source stands for its own parent
                frame = self.frame_parent.get(frame)
        if frame not in self.frame_url:
            self.reject(e, "unknown frame")
            return None
        return self.frame_url[frame], e.initiator_type

    def on_sent(self, e) -> bool:
        url = e.url
        if e.resource_type == "Document":
            plain = url
            url += e.url_fragment or ""
            self.full_url[plain] = url
            found = self.document_parent(e)
            if found is None:
                return True
            self.add(e, url, "Document", *found)
            self.frame_url[e.frame_id], self.loader_url[e.loader_id], self.frame_loader[e.frame_id] = url, url, e.loader_id
            return True
        parent = self.loader_url.get(e.loader_id, self.frame_url.get(e.frame_id))
        if parent is None:
            return True
        if e.initiator_type not in KNOWN_INITIATORS:
            self.reject(e, "unknown initiator")
            return not self.strict  # the strict form stops reading here
        self.add(e, url + (e.url_fragment or ""), e.resource_type, parent, e.initiator_type)
        return True

    def on_anchor(self, e) -> bool:
        parent = self.frame_url.get(e.frame_id)
        if parent is not None:
            self.full_url[e.url.split("#", 1)[0]] = e.url
            self.frame_url[e.frame_id] = e.url
            if e.frame_id in self.frame_loader:
                self.loader_url[self.frame_loader[e.frame_id]] = e.url
            self.add(e, e.url, "Document", parent, "navigatedWithinDocument")
        return True

    def on_attached(self, e) -> bool:
        self.frame_parent[e.frame_id] = e.parent_frame_id
        return True

    def on_detached(self, e) -> bool:
        self.frame_parent.pop(e.frame_id, None)
        self.frame_url.pop(e.frame_id, None)
        return True

    def on_navigation(self, e) -> bool:
        self.navigations.append((e.frame_id, e.url, e.reason, e.ts))
        return True

    def on_download(self, e) -> bool:
        at = self.last_with_url.get(e.url)
        if at is not None:
            self.requests[at][2] = "Download"
        return True

    def match_navigations(self) -> None:
        """Sources of documents that a navigation asked for. The strict form reads requests once for all navigations, so one
        without a request uses up the rest; the other form looks on from the last match for each."""
        at = 1
        for frame, url, reason, ts in self.navigations:
            for k in range(at, len(self.requests)):
                _, u, kind, _, _, t, f = self.requests[k]
                if kind == "Document" and f == frame and u == url and abs(t - ts) < NAVIGATION_GAP:
                    self.requests[k][4] = reason
                    at = k + 1
                    break
            else:
                if self.strict:
                    return

    def run(self, events) -> None:
        handlers = {SENT: self.on_sent, ANCHOR: self.on_anchor, ATTACHED: self.on_attached, DETACHED: self.on_detached, NAVIGATION: self.on_navigation, DOWNLOAD: self.on_download}
        for e in events:
            handler = handlers.get(e.method)
            if handler and not handler(e):
                break
            self.count += 1
        self.match_navigations()


_FIELDS = ["sample_id", "seq", "ts", "method", "frame_id", "parent_frame_id", "loader_id", "resource_type", "url", "url_fragment", "initiator_type", "redirect_url", "reason"]


def resolve_parents(events: DataFrame, strict: bool = False) -> DataFrame:
    """Requests (schemas.REQUESTS) of target events. strict: quirks that lose data are kept."""

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r = ParentResolver(strict)
        pdf = pdf.sort_values("seq").astype(object)
        r.run(pdf.where(pdf.notna(), None).itertuples(index=False))
        return pd.DataFrame([[key[0], *x] for x in r.requests], columns=["sample_id", "seq", "request_url", "resource_type", "parent_url", "parent_source", "ts", "frame_id"])

    return events.select(*_FIELDS).groupBy("sample_id").applyInPandas(fold, REQUESTS)


def rejects(events: DataFrame, strict: bool = False) -> DataFrame:
    """(sample_id, seq, why) of requests whose parent can't be told."""

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r = ParentResolver(strict)
        pdf = pdf.sort_values("seq").astype(object)
        r.run(pdf.where(pdf.notna(), None).itertuples(index=False))
        return pd.DataFrame([[key[0], *x] for x in r.rejects], columns=["sample_id", "seq", "why"])

    return events.select(*_FIELDS).groupBy("sample_id").applyInPandas(fold, "sample_id string, seq long, why string")


def before(order: str, *keys: str) -> Window:
    """All earlier rows of a key."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def frame_parents(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows (sample_id, frame_id, url, is_root_frame) with ``parent_url``: the latest earlier url of the frame, else of the root frame."""
    own = F.last("url", ignorenulls=True).over(before(seq, "sample_id", "frame_id"))
    root = F.last(F.when(F.col("is_root_frame"), F.col("url")), ignorenulls=True).over(before(seq, "sample_id"))
    return rows.withColumn("parent_url", F.coalesce(own, root))


def backward_matches(rows: DataFrame, key: list[str], seq: str, build, probe) -> DataFrame:
    """Probe rows with ``match_seq``: the latest earlier build row of the key. One window over both sides instead of a range join."""
    w = before(seq, *key)
    return rows.withColumn("match_seq", F.last(F.when(build, F.col(seq)), ignorenulls=True).over(w)).where(probe & F.col("match_seq").isNotNull())


def band_matches(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, gap: int) -> DataFrame:
    """Pairs of a key whose times are less than ``gap`` apart: equal buckets of that width and their neighbours, then the exact test."""
    bucket = F.floor(F.col(left_time) / gap)
    near = left.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    return near.join(right.withColumn("bucket", F.floor(F.col(right_time) / gap)), [*key, "bucket"]).where(F.abs(F.col(left_time) - F.col(right_time)) < gap).drop("bucket")

