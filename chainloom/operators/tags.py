"""Tags of pages: links, image-map areas, click handlers and frames, from stored HTML, and large iframes from stored geometry."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.functions.geometry import area_rect, covers_view
from chainloom.functions.urls import strip_newlines

# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TAG_COLUMNS = "tag_type string, at int, name string, attributes map<string,string>, outer_html string, parent_map string, inner int"


class TagReader(HTMLParser):
    """Collects the elements that can lead elsewhere, in page order, with their outer HTML."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.found, self.open = page, [], []
        self.held: Counter = Counter()
        self.started = 0
        self.line_at = [0]
        for line in page.split("\n"):
            self.line_at.append(self.line_at[-1] + len(line) + 1)
        self.in_body = False
        self.maps: list[str] = []

    def place(self) -> int:
        line, column = self.getpos()
        return self.line_at[line - 1] + column

    def handle_starttag(self, name, attributes) -> None:
        a = {k: v or "" for k, v in attributes}
        if name == "body":
            self.in_body = True
        if name == "map":
            self.maps.append(a.get("name") or a.get("id") or "")
        start = self.place()
        end = start + len(self.get_starttag_text())
        kinds = []
        if self.in_body and name == "a":
            kinds.append("a")
        if name == "area" and self.maps:
            kinds.append("area")
        if self.in_body and "onclick" in a:
            kinds.append("onclick")
        if name in ("iframe", "frame"):
            kinds.append("iframe")
        if name == "img" and "usemap" in a:
            kinds.append("img")
        self.started += 1
        rows = [{"kind": k, "name": name, "attributes": a, "start": start, "end": end, "map": self.maps[-1] if self.maps else None, "inner": 0} for k in kinds]
        self.found += rows
        if name not in VOID:
            self.open.append((name, rows, self.started))
            self.held[name] += 1

    def shut(self, k: int) -> None:
        """The elements from the k-th open one on end; what began since then is inside of them."""
        for name, rows, started in self.open[k:]:
            self.held[name] -= 1
            for r in rows:
                r["inner"] = self.started - started
        del self.open[k:]

    def close(self) -> None:
        super().close()
        self.shut(0)

    def handle_endtag(self, name) -> None:
        if name == "map" and self.maps:
            self.maps.pop()
        if not self.held[name]:
            return
        k = next(k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == name)
        end = self.page.find(">", self.place()) + 1 or len(self.page)
        for r in self.open[k][1]:
            r["end"] = end
        self.shut(k)


def page_tags(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows of ``pages`` with the columns of each of their tags: one pass over batches of pages; other columns are taken along as they are."""
    kept = [c for c in pages.columns if c != html]
    schema = T.StructType([*(pages.schema[c] for c in kept), *T._parse_datatype_string(TAG_COLUMNS).fields])
    own = pa.schema([("tag_type", pa.string()), ("at", pa.int32()), ("name", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("outer_html", pa.string()), ("parent_map", pa.string()), ("inner", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, rows = [], []
            for k, page in enumerate(b.column(len(kept)).to_pylist()):
                if page is None:
                    continue
                reader = TagReader(page)
                reader.feed(page)
                reader.close()
                for at, r in enumerate(reader.found):
                    source.append(k)
                    rows.append((r["kind"], at, r["name"], list(r["attributes"].items()), page[r["start"] : r["end"]], r["map"], r["inner"]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(own)
            taken = [b.column(i).take(pa.array(source, pa.int64())) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(list(c), t) for c, t in zip(columns, own.types, strict=True))], names=[f.name for f in schema])

    return pages.select(*kept, html).mapInArrow(run, schema).withColumn("outer_html", strip_newlines(F.col("outer_html")))


def of_type(tags: DataFrame, tag_type: str) -> DataFrame:
    """Tags of a type; iframes come before frames."""
    return tags.where(F.col("tag_type") == tag_type).withColumn("order", F.struct((F.col("name") == "frame").cast("int"), F.col("at")))


def link_rects(links: DataFrame) -> DataFrame:
    """Clickable rectangles of links (visible, rect, inner array of visible and rect): none if invisible, its own if nothing is inside,
    else the distinct ones of what is visible inside."""
    inside = F.array_distinct(F.transform(F.filter("inner", lambda x: x["visible"]), lambda x: x["rect"]))
    none = F.filter(F.array("rect"), lambda _: F.lit(False))
    return links.withColumn("rects", F.when(~F.col("visible"), none).when(F.size("inner") == 0, F.array("rect")).otherwise(inside))


def area_rects(areas: DataFrame, images: DataFrame) -> DataFrame:
    """Areas (page, map_name, map_id, shape, coords) with the rectangle they cover on the visible image that uses their map, by name, else by id."""
    seen = images.where("visible").select("page", F.ltrim(F.col("usemap"), F.lit("#")).alias("uses"), F.col("rect").alias("image"))
    joined = areas.join(seen.withColumnRenamed("uses", "map_name").withColumnRenamed("image", "named"), ["page", "map_name"], "left").join(seen.withColumnRenamed("uses", "map_id").withColumnRenamed("image", "by_id"), ["page", "map_id"], "left")
    placed = joined.where(F.coalesce("named", "by_id").isNotNull()).withColumn("rect", area_rect(F.col("shape"), F.col("coords"), F.coalesce("named", "by_id")))
    return placed.where(F.col("rect").isNotNull()).drop("named", "by_id")


def large_iframes(tags: DataFrame, ratio: float = 0.4) -> DataFrame:
    """(sample_id, src): the first visible top-level iframe with a source whose first rectangle covers this share of the viewport."""
    first = F.try_element_at("rects", F.lit(1))
    src = F.regexp_extract("outer_html", r"""(?is)<i?frame\b[^>]*?\ssrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", 0)
    value = F.regexp_extract(src, r"""(?is)\ssrc\s*=\s*["']?(.*?)["']?$""", 1)
    wide = tags.where((F.col("tag_type") == "iframe") & F.col("visible") & (F.coalesce("frame_path", F.lit("")) == "") & first.isNotNull()).where(covers_view(first, ratio))
    found = wide.withColumn("src", F.replace(F.trim(value), F.lit("&amp;"), F.lit("&"))).where(F.col("src") != "")
    return found.groupBy("sample_id").agg(F.min_by("src", F.split_part("tag_id", F.lit("_"), F.lit(-1)).try_cast("int")).alias("src"))
