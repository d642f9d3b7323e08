"""Exact removal of repeated byte strings by suffix arrays built in two stages.

Two-stage sorting: a suffix smaller than its successor is sorted directly; every other suffix is induced from its
successor's place by scanning the buckets of first bytes in ascending order; common prefixes of neighbours in the array then
show which strings repeat.

Strings are of bytes, or of words: then a document is the sequence of its words' 64-bit hashes, and a passage repeats if all of its words
do. A symbol is one byte or one word; ``width`` symbols make a window.

Distribution: equal strings must meet in one task. Every window names an anchor, the least-hashed
string of ``gram`` symbols in it, so equal windows name equal anchors at equal places. Neighbouring windows with one anchor
are one context: its bytes cover all of them. Contexts go by their anchor's fingerprint, those alone with it are dropped, and equal
contexts are counted before they move and represented once; the suffixes that begin the windows of different contexts of a fingerprint
are then sorted. A fingerprint with more than ``GROUP`` different contexts is split by longer strings: parts of ``PART``
neighbouring windows by the string they all hold, and where these are still crowded, single windows.

Cases: null and empty texts have no bytes; texts shorter than the string lose nothing; equal rows repeat each other; runs
of one byte and periodic texts have one context that is counted; very long texts are read in overlapping segments; rows
without a doc_id take part; an empty table gives no rows; extra columns are ignored.

Hashes stand for equality in three places: contexts are equal if 128 bits (anchor and content) agree, a row is known by 128 bits of its
id and text, and a word by 64 bits (only where words are the symbols).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import arrow_map, batch, discard, materialize, mix64, read

MIN_BYTES = 400
#: A passage of over 50 words.
PASSAGE_WORDS = 51
#: Different contexts of one fingerprint that are sorted together, and bytes that one array is built over.
GROUP, ARRAY_BYTES = 96, 1 << 19
#: Windows of a part, where a fingerprint has more contexts (half a window at most, so that the windows of a part share a string).
PART = 16
#: Windows of a document that are looked at together.
SEGMENT = 1 << 22
POSITION = np.uint64((1 << 23) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Kind(NamedTuple):
    """What windows are made of: ``width`` symbols of ``unit`` bytes each."""

    width: int
    unit: int

    def windows(self, data: bytes) -> int:
        return len(data) // self.unit - self.width + 1

    def cut(self, data: bytes, first: int, windows: int) -> bytes:
        """The symbols of so many windows from the ``first`` on."""
        return data[first * self.unit : (first + windows + self.width - 1) * self.unit]

    def array(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.uint8 if self.unit == 1 else np.uint64)


def in_bytes(width: int) -> Kind:
    return Kind(width, 1)


def in_words(width: int) -> Kind:
    return Kind(width, 8)


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    spaces = SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], spaces, [True]])))
    return edges[::2], edges[1::2]


def symbols(text: str, kind: Kind) -> bytes:
    """A text as symbols."""
    data = text.encode("utf-8", "surrogatepass")
    if kind.unit == 1:
        return data
    start, end = word_bounds(data)
    out = [np.zeros(0, np.uint64)]
    whole, first = np.frombuffer(data, np.uint8), 0
    while first < len(start):  # words of about a segment at a time
        last = max(first + 1, int(np.searchsorted(end, start[first] + SEGMENT, "right")))
        a, b, base = start[first:last], end[first:last], start[first]
        up, down = _POWERS.to(int(b[-1] - base) + 1)
        total = np.zeros(int(b[-1] - base) + 1, np.uint64)
        np.cumsum((whole[base : b[-1]].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        out.append(mix64((total[b - base] - total[a - base]) * down[a - base]))
        first = last
    return np.concatenate(out).tobytes()


# ---- anchors ------------------------------------------------------------------------------------------------------------------------


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            room = max(n, 2 * len(self.up))
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("up", BASE), ("down", inverse)):
                a = np.full(room, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of ``gram`` symbols of ``x``."""
    up, down = _POWERS.to(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix64((total[gram:] - total[:-gram]) * down[: len(x) - gram + 1])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` neighbours: blocks of that length, minima from both of their ends."""
    n = len(v) - width + 1
    if width == 1:
        return v
    padded = np.full(-(-len(v) // width) * width, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def gram_of(width: int) -> int:
    return max(1, width // 4)


def contexts(data: bytes, kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(fingerprint, hash, first window, number of windows) of the contexts of ``data``, segment by segment; the hash is of all symbols."""
    gram, width = gram_of(kind.width), kind.width
    whole = kind.array(data)
    for at in range(0, kind.windows(data), SEGMENT):
        x = whole[at : at + SEGMENT + width - 1]
        h = gram_hashes(x, gram)
        least = sliding_min((h & ~POSITION) | np.arange(len(h), dtype=np.uint64), width - gram + 1)
        place = (least & POSITION).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        n = np.diff(np.concatenate([first, [len(place)]]))
        if kind.unit == 1:
            ctx = np.array([xxhash.xxh3_64_intdigest(kind.cut(data, i, k)) for i, k in zip((first + at).tolist(), n.tolist(), strict=True)], np.uint64)
        else:  # hashes of words are summed up as they are
            up, down = _POWERS.to(len(x) + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[:-1])])
            ctx = mix64((total[first + n + width - 1] - total[first]) * down[first] + n.astype(np.uint64))
        yield h[place[first]], ctx, first + at, n


def anchor_of(data: bytes, kind: Kind) -> int:
    """The place of the anchor in a context's symbols."""
    gram = gram_of(kind.width)
    return int(np.argmin(gram_hashes(kind.array(data), gram)[: kind.width - gram + 1] >> np.uint64(23)))


# ---- two-stage suffix sorting ---------------------------------------------------------------------------------------------------------


def rises(t: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than its successor. ``t`` holds 0 at the end of each string."""
    d = np.zeros(len(t), np.int8)
    d[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    d[t == 0] = 1  # an end is smaller than whatever follows
    at = np.where(d != 0, np.arange(len(t)), len(t) - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return d[at] > 0


def two_stage(t: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Places with ``wanted`` set (and those needed to induce them), by the first ``depth`` symbols of their suffixes.

    ``t``: bytes plus 1, with 0 at the end of each string. A suffix ends with its string."""
    rise = rises(t)
    # a place that isn't sorted directly is induced from its successor, so the chain up to the next direct one is needed
    nearest = np.where(rise, np.arange(len(t)), len(t))
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    reach = np.zeros(len(t) + 1, np.int32)
    at = np.flatnonzero(wanted)
    np.add.at(reach, at, 1)
    np.add.at(reach, np.minimum(nearest[at], len(t) - 1) + 1, -1)
    needed = np.cumsum(reach[:-1]) > 0

    direct = np.flatnonzero(needed & rise & (t > 0))
    ends = np.flatnonzero(t == 0)
    stop = ends[np.searchsorted(ends, direct)]
    raw = (np.maximum(t, 1) - 1).astype(np.uint8).tobytes()
    keys = [raw[i:j] for i, j in zip(direct.tolist(), np.minimum(direct + depth, stop).tolist(), strict=True)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    direct = direct[order]
    del keys
    letters = np.unique(t[needed])
    lower, upper = np.searchsorted(t[direct], letters, "left").tolist(), np.searchsorted(t[direct], letters, "right").tolist()

    induced: dict[int, list[np.ndarray]] = {}
    out = []

    def before(places: np.ndarray) -> np.ndarray:
        q = places - 1
        q = q[q >= 0]
        return q[needed[q] & ~rise[q]]

    for c, lo, hi in zip(letters.tolist(), lower, upper, strict=True):
        fallen = induced.pop(c, [])
        front = np.concatenate(fallen) if fallen else np.zeros(0, np.int64)
        while len(front):  # runs of one symbol
            q = before(front)
            front = q[t[q] == c]
            if len(front):
                fallen.append(front)
        bucket = np.concatenate([*fallen, direct[lo:hi] if c else ends[needed[ends]]])
        if not len(bucket):
            continue
        if c:
            out.append(bucket)
        q = before(bucket)
        q = q[t[q] > c]
        if len(q):
            by = np.argsort(t[q], kind="stable")
            q = q[by]
            cut = np.flatnonzero(np.diff(t[q])) + 1
            for part in np.split(q, cut):
                induced.setdefault(int(t[part[0]]), []).append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(t: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to ``depth``, of the common prefix of each place's suffix and that of the one before; 0 for the first."""
    out = np.zeros(len(places), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([t, np.zeros(depth, t.dtype)]), depth)
    for i in range(1, len(places), 8192):
        a, b = view[places[i - 1 : i + 8191]][: len(places[i : i + 8192])], view[places[i : i + 8192]]
        same = (a == b) & (a > 0)
        full = same.all(1)
        out[i : i + 8192] = np.where(full, depth, np.argmin(same, 1))
    return out


def suffix_array(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The whole suffix array of ``data`` and the common prefixes of its neighbours."""
    t = np.concatenate([np.frombuffer(data, np.uint8).astype(np.uint16) + 1, np.zeros(1, np.uint16)])
    places = two_stage(t, t > 0, len(data) + 1)
    return places, common_prefixes(t, places, max(1, len(data)))


def as_bytes(texts: list[bytes], kind: Kind) -> tuple[list[bytes], int]:
    """Words as their ranks among the words of ``texts``, in as few bytes each as hold these; the number of bytes."""
    if kind.unit == 1:
        return texts, 1
    found, rank = np.unique(kind.array(b"".join(texts)), return_inverse=True)
    size = max(1, (int(len(found) - 1).bit_length() + 7) // 8)
    flat = rank.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - size :].tobytes()
    stops = np.cumsum([len(x) // kind.unit * size for x in texts]).tolist()
    return [flat[i:j] for i, j in zip([0, *stops], stops, strict=False)], size


def repeated(texts: list[bytes], counts: list[int], kind: Kind) -> list[np.ndarray]:
    """For each text whether each of its windows occurs more than once. counts: how often the text itself occurs."""
    texts, step = as_bytes(texts, kind)
    width = step * kind.width
    sizes = np.array([len(x) + 1 for x in texts])
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    t = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
    t[start + sizes - 1] = 0
    window = np.zeros(len(t) + 1, np.int32)
    window[start] += 1
    np.add.at(window, start + sizes - width, -1)
    window = np.cumsum(window[:-1]) > 0
    if step > 1:
        window &= (np.arange(len(t)) - np.repeat(start, sizes)) % step == 0
    places = two_stage(t, window, width)
    places = places[window[places]]
    same = common_prefixes(t, places, width) >= width
    twice = same.copy()
    twice[:-1] |= same[1:]
    found = np.zeros(len(t), bool)
    found[places[twice]] = True
    return [found[a : a + n - width : step] | (k > 1) for a, n, k in zip(start.tolist(), sizes.tolist(), counts, strict=True)]


# ---- the operator -----------------------------------------------------------------------------------------------------------------------


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the set stretches."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


KEYS = ["key", "key2"]


def row_keys(docs: DataFrame) -> list[Column]:
    """128 bits, equal only for rows with one doc_id and one text, which lose the same strings."""
    row = (F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("text"), F.lit("")))
    return [F.xxhash64(*row).alias("key"), F.xxhash64(F.lit(1), *row).alias("key2")]


MARKS = "fp long, ctx long, marks array<struct<a:int,b:int>>"
MARKS_ARROW = pa.schema([("fp", pa.int64()), ("ctx", pa.int64()), ("marks", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def occurrences(docs: DataFrame, kind: Kind) -> DataFrame:
    """(fp, ctx, key, key2, at, n): every context of every document (key, key2, text); ctx is a hash of all its symbols."""
    arrow = pa.schema([("fp", pa.int64()), ("ctx", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for key, key2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = symbols(text, kind)
                for fp, ctx, first, n in contexts(data, kind):
                    for part, x in zip(parts, (fp.view(np.int64), ctx.view(np.int64), np.full(len(fp), key, np.int64), np.full(len(fp), key2, np.int64), first.astype(np.int32), n.astype(np.int32)), strict=True):
                        part.append(x)
            if parts[0]:
                yield batch(arrow, [pa.array(np.concatenate(p)) for p in parts])

    return arrow_map(docs, run, "fp long, ctx long, key long, key2 long, at int, n int")


def context_bytes(asked: DataFrame, kind: Kind) -> DataFrame:
    """(fp, ctx, count, kinds, bytes) of (text, parts): the symbols of each part."""
    names = ("fp", "ctx", "count", "kinds")
    arrow = pa.schema([*((c, pa.int64()) for c in names), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = symbols(text, kind)
                yield batch(arrow, [*([p[c] for p in parts] for c in names), [kind.cut(data, p["at"], p["n"]) for p in parts]])

    return arrow_map(asked, run, "fp long, ctx long, count long, kinds long, bytes binary")


def sort_groups(rows: DataFrame, kind: Kind) -> DataFrame:
    """Marks of the contexts (fp, ctx, count, bytes) of each fingerprint, whose rows must be few. One array for as many
    fingerprints as fit in ``ARRAY_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, last, met = 0, None, set()

        def marked() -> pa.RecordBatch:
            flags = repeated([x[3] for x in held], [x[2] for x in held], kind)
            out = [(x[0], x[1], [{"a": a, "b": b} for a, b in runs(f)]) for x, f in zip(held, flags, strict=True) if f.any()]
            return batch(MARKS_ARROW, list(zip(*out, strict=True)) if out else [[], [], []])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if size > ARRAY_BYTES and row[0] != last:
                    yield marked()
                    held, size = [], 0
                if row[0] != last:
                    met = set()
                if row[1] not in met:  # equal rows ask for one context more than once
                    met.add(row[1])
                    held.append(row)
                    size += len(row[3])
                last = row[0]
        if held:
            yield marked()

    return arrow_map(rows.repartition("fp").sortWithinPartitions("fp"), run, MARKS)


def split_contexts(rows: DataFrame, width: int, kind: Kind) -> DataFrame:
    """Contexts (fp, ctx, count, bytes) in parts of ``width`` windows, counted from the anchor: (fp, ctx, count, i, core, sub, n,
    bytes). All windows that a part may have hold its core, so equal windows are in parts of equal cores."""
    names = ("fp", "ctx", "count", "i", "core", "sub", "n", "bytes")
    arrow = pa.schema([(c, pa.binary() if c == "bytes" else pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for fp, ctx, count, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                windows, anchor = kind.windows(data), anchor_of(data, kind)
                for first in range(anchor % width - (width if anchor % width else 0), windows, width):
                    i, end = max(first, 0), min(first + width, windows)
                    core = xxhash.xxh3_64_intdigest(data[(first + width - 1) * kind.unit : (first + kind.width) * kind.unit])
                    part = kind.cut(data, i, end - i)
                    out.append((fp, ctx, count, i, core - (1 << 63), xxhash.xxh3_64_intdigest(part) - (1 << 63), end - i, part))
            if out:
                yield batch(arrow, list(zip(*out, strict=True)))

    return arrow_map(rows, run, ", ".join(f"{c} {'binary' if c == 'bytes' else 'long'}" for c in names))


def crowded_marks(rows: DataFrame, width: int, kind: Kind) -> DataFrame:
    """Marks of contexts (fp, ctx, count, bytes) whose fingerprints have too many for one array: parts of ``width`` windows are
    grouped by the longer string that all of their windows hold; what is still crowded is split into single windows."""
    parts = materialize(split_contexts(rows, width, kind), "context-parts")
    distinct = materialize(parts.groupBy("core", "sub").agg(F.sum("count").alias("count"), F.max("n").alias("n"), F.min("bytes").alias("bytes")), "distinct-parts")
    kinds = materialize(distinct.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("count").alias("all")).where("all > 1").drop("all"), "part-kinds")
    many = materialize(distinct.join(kinds, "core").select(F.col("core").alias("fp"), F.col("sub").alias("ctx"), "count", "n", "kinds", "bytes"), "counted-parts")
    discard(distinct, kinds)
    marks = whole_marks(many.where("kinds = 1")).unionByName(sort_groups(many.where((F.col("kinds") > 1) & (F.col("kinds") <= GROUP)).select("fp", "ctx", "count", "bytes"), kind))
    rest = many.where(F.col("kinds") > GROUP).select("fp", "ctx", "count", "bytes")
    deeper = crowded_marks(rest, 1, kind) if width > 1 and rest.limit(1).count() else None
    if deeper is not None:
        marks = marks.unionByName(deeper)
    marks = materialize(marks.select(F.col("fp").alias("core"), F.col("ctx").alias("sub"), "marks"), "part-marks")
    i = F.col("i").cast("int")
    moved = parts.select("fp", "ctx", "i", "core", "sub").join(marks, ["core", "sub"]).select("fp", "ctx", F.transform("marks", lambda m: F.struct((m["a"] + i).alias("a"), (m["b"] + i).alias("b"))).alias("marks"))
    out = materialize(moved.groupBy("fp", "ctx").agg(F.flatten(F.collect_list("marks")).alias("marks")), "crowded-marks")
    discard(parts, many, marks, *([deeper] if deeper is not None else []))
    return out


def whole_marks(rows: DataFrame) -> DataFrame:
    """Equal contexts only (fp, ctx, count, n): each of their windows occurs as often as they do."""
    return rows.where(F.col("count") > 1).select("fp", "ctx", F.array(F.struct(F.lit(0).alias("a"), F.col("n").cast("int").alias("b"))).alias("marks"))


def repeated_windows(docs: DataFrame, kind: Kind) -> DataFrame:
    """(key, key2, spans array<struct<a,b>>): window starts [a, b) of a document that occur elsewhere too. ``docs``: (key, key2, text)."""
    found = materialize(occurrences(docs, kind), "contexts")
    shared = found.groupBy("fp").agg(F.count("*").alias("all")).where("all > 1").select("fp")
    shared = materialize(shared, "shared-fingerprints")
    placed = materialize(found.join(shared, "fp"), "shared-contexts")
    discard(found, shared)
    distinct = materialize(
        placed.groupBy("fp", "ctx").agg(F.count("*").alias("count"), F.min("key").alias("key"), F.min_by("key2", "key").alias("key2"), F.min_by("at", "key").alias("at"), F.max("n").alias("n")), "distinct-contexts"
    )
    kinds = materialize(distinct.groupBy("fp").agg(F.count("*").alias("kinds")), "fingerprint-kinds")
    many = materialize(distinct.join(kinds, "fp"), "counted-contexts")
    discard(distinct, kinds)
    alone = whole_marks(many.where(F.col("kinds") == 1))
    asked = many.where(F.col("kinds") > 1).groupBy(*KEYS).agg(F.collect_list(F.struct("fp", "ctx", "count", "kinds", "at", "n")).alias("parts"))
    texts = materialize(context_bytes(docs.join(asked, KEYS).select("text", "parts"), kind), "context-bytes")
    few = sort_groups(texts.where(F.col("kinds") <= GROUP).select("fp", "ctx", "count", "bytes"), kind)
    marks = alone.unionByName(few)
    crowded = texts.where(F.col("kinds") > GROUP).select("fp", "ctx", "count", "bytes").dropDuplicates(["fp", "ctx"])
    deeper = crowded_marks(crowded, min(PART, max(1, kind.width // 2)), kind) if crowded.limit(1).count() else None
    if deeper is not None:
        marks = marks.unionByName(deeper)
    marks = materialize(marks, "marks")
    discard(many, texts, *([deeper] if deeper is not None else []))
    where = placed.join(marks, ["fp", "ctx"]).select(*KEYS, F.transform("marks", lambda m: F.struct((m["a"] + F.col("at")).alias("a"), (m["b"] + F.col("at")).alias("b"))).alias("spans"))
    out = materialize(where.groupBy(*KEYS).agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")
    discard(placed, marks)
    return out


def covered(spans: list | None, width: int, least: int = 0) -> list[tuple[int, int]]:
    """Stretches [from, to) of symbols that window starts [a, b) cover; those that share less than ``least`` symbols stay apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"] + width - 1) for s in spans or ()):
        if out and a + least <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(data: bytes, stretches: list[tuple[int, int]]) -> bytes:
    """What stays of ``data`` outside of ordered stretches."""
    out, at = [], 0
    for a, b in stretches:
        out.append(data[at : max(a, at)])
        at = max(at, b)
    return b"".join([*out, data[at:]])


def word_stretches(data: bytes, spans: list | None, width: int) -> list[tuple[int, int]]:
    """Stretches of bytes, each from the first to the last of its words, that window starts in words cover."""
    if not spans:
        return []
    start, end = word_bounds(data)
    return [(int(start[a]), int(end[b - 1])) for a, b in covered(spans, width, 1)]


def with_spans(docs: DataFrame, width: int, words: int) -> DataFrame:
    """The columns of ``docs`` and, last, each row's repeated windows of ``width`` bytes and of ``words`` words (0: none are looked for).
    In between, all columns of a row are one struct, so their names can't clash."""
    keyed = docs.select(*row_keys(docs), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spans = repeated_windows(keyed, in_bytes(width))
    if words:
        spans = spans.join(repeated_windows(keyed, in_words(words)).withColumnRenamed("spans", "word_spans"), KEYS, "full")
    else:
        spans = spans.withColumn("word_spans", F.lit(None).cast("array<struct<a:int,b:int>>"))
    taken, names = {c.lower() for c in docs.columns}, ["spans", "word_spans"]
    while taken.intersection(names):
        names = [n + "_" for n in names]
    return docs.select(*row_keys(docs), F.struct(*docs.columns).alias("row")).join(spans, KEYS, "left").select("row.*", F.col("spans").alias(names[0]), F.col("word_spans").alias(names[1]))


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (also as text) of every row, by strings of ``min_bytes``. clean: the text without these
    strings and, where ``words`` is given, without passages of so many words that occur elsewhere too (from their first to their last
    word); bytes of characters that a cut divides go from it as well."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_text", pa.string()), ("clean", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans, word_spans in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                if not spans and not word_spans:
                    out.append((len(data), 0, 0, data, text or "", text or ""))
                    continue
                gone = covered(spans, min_bytes)
                clean = without(data, sorted([*gone, *word_stretches(data, word_spans, words)]))
                kept = without(data, gone)
                out.append((len(data), sum(y - x for x, y in gone), len(gone), kept, kept.decode("utf-8", "ignore"), clean.decode("utf-8", "ignore")))
            yield batch(arrow, [b.column(0), *(list(zip(*out, strict=True)) if out else [[]] * 6)])

    table = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_bytes, words)
    return arrow_map(table, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, clean string")


def cut_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, words: int = 0, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with ``clean`` (see ``remove_repeats``) as text. n_chars follows where it is there. drop_emptied: rows that a cut leaves
    without anything but white space go."""
    table = with_spans(docs, min_bytes, words)
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cut = [], []
            for text, spans, word_spans in zip(*(b.column(i).to_pylist() for i in (at, len(names), len(names) + 1)), strict=True):
                cut.append(bool(spans or word_spans))
                if cut[-1]:
                    data = text.encode("utf-8", "surrogatepass")
                    text = without(data, sorted([*covered(spans, min_bytes), *word_stretches(data, word_spans, words)])).decode("utf-8", "ignore")
                texts.append(text)
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            if count is not None:
                columns[count] = pa.array([len(t) if c else n for t, c, n in zip(texts, cut, columns[count].to_pylist(), strict=True)], columns[count].type)
            out = pa.RecordBatch.from_arrays(columns, names=names)
            emptied = [c and not t.strip() for c, t in zip(cut, texts, strict=True)] if drop_emptied else []
            yield out.filter(pa.array([not e for e in emptied])) if any(emptied) else out

    return arrow_map(table, run, docs.schema)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the contract, by strings of 400 bytes, and two texts: ``kept_text``, what stays by the contract, and ``text``, from
    which passages of over 50 words that occur elsewhere have gone too: most of these are shorter than 400 bytes."""
    out = remove_repeats(read(spark, sf_dir, "documents"), MIN_BYTES, PASSAGE_WORDS)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "kept_text", F.col("clean").alias("text"))
