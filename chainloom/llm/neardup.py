"""Near-duplicates by bottom-k sketches of one hash function.

A document's set of word shingles is hashed by one function; its ``SKETCH`` smallest values are retained. Sets that are equal
are one class from then on. Inverted lists of retained values generate overlaps: of a sketch, the values that the most
documents share are left out as far as two linked sketches still share a listed one (``listed_length``), so frequent passages
don't fill lists. In each list all others meet one centre (a star, not all pairs), the document with the most frequent values.
Only what stays in different components meets again: in short lists directly; documents of crowded lists where their whole sets share one
of their rarest shingles (prefix filtering), in short lists directly, in longer ones by families (one for each centre), block against
block but for the family's largest component with itself. There the counts of both sets in ``BUCKETS`` hash buckets bound their overlap from
above, so that only pairs that may be linked leave a task. The union sketch of a pair estimates its similarity and filters; the rest is verified on full
sets. Components come from alternating star contractions, whose rounds grow with the logarithm of a chain.

Cases: null and empty texts have an empty set and are linked with nothing; fewer words than a shingle are one shingle;
equal rows and copies share a class; a doc_id with different texts is one document, linked through each of them; texts of any length are
shingled whole; rows without a doc_id can't carry a link and come back alone; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import arrow_map, batch, discard, doc_table, materialize, mix64, most_frequent, read, words

#: Words of a shingle; the similarity of a link in per cent, where a caller names no other.
SHINGLE, SIMILAR = 5, 85
#: Retained values of a document, and those that the most frequent values known to all workers are chosen from.
SKETCH, MAX_FREQUENT, FREQUENT_FROM = 64, 65_536, 8
#: Standard deviations that the bounds on sketches stay under their means: shared values (where one set holds the other; over 7
#: where both are equally large), and the union sketch's estimate.
SHARED_UNDER, ESTIMATE_UNDER = 4.3, 5.6
#: Members of a star that one task verifies.
SPREAD = 128
#: Longest list whose members meet directly; documents in one block of a family; hash buckets of the overlap bound.
SHORT, BLOCK, BUCKETS = 32, 512, 512
REMEMBER = 500_000

SCHEMA = "doc_id long, n_shingles long, component_id long, kept boolean"

_WORDS: dict[bytes, int] = {}


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    tokens = words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    known = _WORDS
    ids = []
    for w in tokens:
        h = known.get(w)
        if h is None:
            if len(known) >= REMEMBER:
                known.clear()
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    x = np.array(ids, np.uint64)
    span = min(width, len(x))
    n = len(x) - span + 1
    h = np.full(n, span, np.uint64)
    for i in range(span):
        h = mix64(h + x[i : i + n])
    return np.unique(h)


def bucket_counts(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each bucket, in bytes where all are below 256, else in four bytes each."""
    n = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    return n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32).tobytes()


def counts_of(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, np.uint8 if len(stored) == BUCKETS else np.uint32)


def shared_at_least(similar: int) -> int:
    """How many values two sketches share at least if their sets are linked."""
    s = similar / 100
    return int(SKETCH * s - SHARED_UNDER * math.sqrt(SKETCH * s * (1 - s)))


def estimate_at_least(similar: int) -> float:
    """Pairs whose union sketch estimates less are not verified."""
    s = similar / 100
    return round(s - ESTIMATE_UNDER * math.sqrt(s * (1 - s) / SKETCH), 2)


def listed_length(n: int, similar: int = SIMILAR) -> int:
    """How many values of a sketch, in one order for all, must be listed so that linked sketches meet in a list."""
    held = min(n, SKETCH)
    return held - min(math.ceil(similar * n / 100), shared_at_least(similar)) + 1


def class_key(values: np.ndarray) -> bytes:
    """A 128-bit digest of a set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class_key, sketch, buckets): class_key is a 128-bit digest of the set."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class_key", pa.binary()), ("sketch", pa.list_(pa.int64())), ("buckets", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            keys = [class_key(s) for s in sets]
            yield batch(arrow, [b.column(0), [len(s) for s in sets], keys, pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64())), [bucket_counts(s) for s in sets]])

    return arrow_map(docs, run, "doc_id long, n_shingles long, class_key binary, sketch array<long>, buckets binary")


def postings(classes: DataFrame, similar: int) -> DataFrame:
    """(value, id, n, common): the listed values of each class, the most frequent values last; common: its number of frequent values."""
    counted = classes.select(F.explode("sketch").alias("value")).groupBy("value").count()
    frequent = most_frequent(materialize(counted.where(F.col("count") >= FREQUENT_FROM), "frequent-values"), "count", MAX_FREQUENT)
    rank = {r["value"]: k for k, r in enumerate(sorted(frequent, key=lambda r: (r["count"], r["value"])), 1)}
    arrow = pa.schema([("value", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("common", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, ids, ns, common = [], [], [], []
            for i, n, sketch in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                chosen = sorted(sketch, key=lambda v: (rank.get(v, 0), v))[: listed_length(n, similar)]
                value += chosen
                ids += [i] * len(chosen)
                ns += [n] * len(chosen)
                common += [sum(v in rank for v in sketch)] * len(chosen)
            yield batch(arrow, [value, ids, ns, common])

    return arrow_map(classes.select("id", "n", "sketch"), run, "value long, id long, n long, common int")


def estimated(pairs: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) whose union sketch doesn't speak against a link."""
    a = classes.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    shared = F.size(F.array_intersect("sa", "sb"))
    in_union = F.size(F.array_intersect(F.array_intersect(F.col("sa"), F.col("sb")), union))
    return pairs.join(a, "a").join(b, "b").where((in_union >= estimate_at_least(similar) * F.size(union)) & (shared > 0)).select("a", "b")


def prefix_length(n: int, similar: int) -> int:
    """How many values of a whole set, in one order for all, must be listed so that linked sets meet in a list."""
    return n + similar * -n // 100 + 1


def prefixes(members: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """(value, id, n, component, common): the rarest shingles of each member (id, component), as many as linked sets must share one of.

    Any order serves that is the same for all members; here the most frequent shingles among them come last."""
    body = materialize(texts.join(members.withColumnRenamed("id", "node"), "node").select(F.col("node").alias("id"), "component", "text"), "members")
    counts = pa.schema([("value", pa.int64()), ("count", pa.int64())])
    arrow = pa.schema([("value", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("component", pa.int64()), ("common", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            values, many = np.unique(np.concatenate(sets), return_counts=True)
            yield batch(counts, [values.view(np.int64), many])

    counted = arrow_map(body.select("text"), count, "value long, count long").groupBy("value").agg(F.sum("count").alias("count"))
    often = materialize(counted.where(F.col("count") >= FREQUENT_FROM), "frequent-shingles")
    frequent = sorted(most_frequent(often, "count", MAX_FREQUENT), key=lambda r: r["value"])
    discard(often)
    known = np.array([r["value"] for r in frequent], np.int64)
    weight = np.array([r["count"] for r in frequent], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, c, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                own = shingles(text).view(np.int64)
                rank = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, weight[at], 0)
                chosen = own[np.lexsort((own, rank))][: prefix_length(len(own), similar)]
                for column, x in zip(out, (chosen, i, len(own), c, int((rank > 0).sum())), strict=True):
                    column.append(x if column is out[0] else np.full(len(chosen), x, np.int64))
            yield batch(arrow, [np.concatenate(x) for x in out])

    return arrow_map(body, run, "value long, id long, n long, component long, common long")


def crowd_pairs(crowd: DataFrame, texts: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of the crowd (id, component) in different components that may be linked: those whose whole sets share one of
    their rarest shingles. Short lists meet directly, long ones by families (one for each centre), block against block."""
    lists = materialize(prefixes(crowd, texts, similar).distinct(), "prefixes")
    rank = F.struct(F.col("common"), F.xxhash64("id"))
    best = lists.groupBy("value").agg(F.max_by("id", rank).alias("family"), F.count("*").alias("many"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = materialize(best.where("low <> high").select("value", "family", "many"), "mixed-prefixes")
    rest = materialize(lists.join(mixed, "value").select("value", "family", "many", "id", "n", "component"), "apart-prefixes")
    discard(lists, mixed)
    near = estimated(list_pairs(rest, similar), classes, similar)
    pairs = near.unionByName(family_pairs(rest.where(F.col("many") > SHORT).select("family", "id", "component").distinct(), classes, similar))
    out = materialize(pairs.distinct(), "crowd-pairs")
    discard(rest)
    return out


def list_pairs(lists: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) in different components that meet in a short list and whose sizes allow a link."""
    short = lists.where(F.col("many") <= SHORT)
    x = short.select("value", F.col("id").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    y = short.select("value", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    alike = 100 * F.least("na", "nb") >= similar * F.greatest("na", "nb")
    return x.join(y, "value").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike).select("a", "b").distinct()


def family_pairs(members: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of one family (family, id, component) in different components whose bucket counts allow a link.

    A family's largest component is never compared with itself: its blocks meet those of the other members only, so a family that is
    one group of near copies but for a few costs a few blocks. A task holds two blocks at most."""
    parts = members.groupBy("family", "component").count()
    most = F.max(F.struct(F.col("count"), F.col("component"))).alias("most")
    sizes = parts.groupBy("family").agg(most, F.sum("count").alias("all"))
    sizes = sizes.select("family", F.col("most.component").alias("main"), F.ceil(F.col("most.count") / BLOCK).cast("int").alias("inner"), F.ceil((F.col("all") - F.col("most.count")) / BLOCK).cast("int").alias("outer"))
    sizes = materialize(sizes.where("outer > 0"), "family-sizes")
    main = F.col("component") == F.col("main")
    # blocks of the others come first, those of the largest component after them
    own = F.when(main, F.col("outer") + F.pmod(F.xxhash64("id"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("id"), F.col("outer"))).cast("int")
    dealt = members.join(sizes, "family").withColumn("own", own).withColumn("last", F.when(main, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
    data = dealt.join(classes.select("id", "n", "buckets"), "id")
    met = data.select("family", "id", "component", "n", "buckets", "own", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    met = met.select("family", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "component", "n", "buckets")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(rows: list[tuple], low: int, high: int) -> list[tuple[int, int]]:
        x = [r for r in rows if r[0] == low]
        y = [r for r in rows if r[0] == high]
        cy, ny, iy = np.array([r[2] for r in y]), np.array([r[3] for r in y]), np.array([r[1] for r in y])
        if not x or not y or len(set(cy.tolist()) | {r[2] for r in x}) == 1:
            return []
        held = np.stack([counts_of(r[4]).astype(np.uint32) for r in y]) if any(len(r[4]) != BUCKETS for r in rows) else np.stack([counts_of(r[4]) for r in y])
        found = []
        for _, i, c, n, stored in x:
            at = np.flatnonzero((cy != c) & (100 * np.minimum(ny, n) >= similar * np.maximum(ny, n)) & ((iy > i) | (low != high)))
            if len(at):
                bound = np.minimum(held[at], counts_of(stored).astype(held.dtype)).sum(1, dtype=np.int64)
                for k in at[(100 + similar) * bound >= similar * (ny[at] + n)].tolist():
                    found.append((min(i, int(iy[k])), max(i, int(iy[k]))))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for b in batches:
            found: list[tuple[int, int]] = []
            for family, low, high, *row in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if group != (family, low, high):
                    found += compare(rows, *group[1:]) if rows else []
                    group, rows = (family, low, high), []
                rows.append(tuple(row))
            if found:
                yield batch(arrow, list(zip(*found, strict=True)))
        if rows and (found := compare(rows, *group[1:])):
            yield batch(arrow, list(zip(*found, strict=True)))

    return arrow_map(met.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high"), run, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of nodes of ``docs`` (node, text) whose full sets are similar. A star's members are dealt over tasks, each with its centre's text."""
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / SPREAD))
    dealt = pairs.join(materialize(pairs.groupBy("a").agg(F.count("*").alias("many")), "star-sizes"), "a").select("a", "b", salt.alias("salt"))
    centres = dealt.select("a", "salt").distinct()
    asks = dealt.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("role")).unionByName(centres.select(F.col("a").alias("doc_id"), "a", "salt", F.lit(0).alias("role")))
    texts = asks.join(docs.select(F.col("node").alias("doc_id"), "text"), "doc_id").select("a", "salt", "role", F.col("doc_id").alias("b"), "text")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, group = np.zeros(0, np.uint64), None
        for bt in batches:
            found: list[tuple[int, int]] = []
            for a, s, role, b, text in zip(*(bt.column(i).to_pylist() for i in range(5)), strict=True):
                if role == 0:
                    if group != (a, s):
                        centre, group = shingles(text), (a, s)
                elif group == (a, s):
                    own = shingles(text)
                    both = len(np.intersect1d(centre, own, assume_unique=True))
                    if 100 * both >= similar * (len(centre) + len(own) - both):
                        found.append((a, b))
            if found:
                yield batch(arrow, list(zip(*found, strict=True)))

    return arrow_map(texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "role"), run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges`` (a, b). Large and small stars in turn."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        discard(now, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(small, "edges")
        discard(large, least)
        after = mark(now)
        if after == before:
            break
        before = after
    low = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = materialize(low.unionByName(low.select(F.col("component").alias("id"), "component").distinct()), "components")
    discard(now)
    return out


def named(sets: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``sets`` and ``texts`` with a node id for each set of a document, and links (a, b) of nodes of one document.

    The node of a document is its doc_id; where a doc_id has different sets, each of them has a node of its own above 2**62, linked to
    the doc_id. Most tables have no such ids, and nothing is done for them."""
    many = materialize(sets.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("class_key").alias("low"), F.max("class_key").alias("high")).where("low <> high").select("doc_id"), "repeated-ids")
    if not many.limit(1).count():
        discard(many)
        return sets.withColumn("node", F.col("doc_id")), texts.withColumn("node", F.col("doc_id")), None
    of_set = F.shiftrightunsigned(F.xxhash64("doc_id", "class_key"), 2).bitwiseOR(F.lit(1 << 62))
    marked = many.withColumn("many", F.lit(True))
    node = F.when(F.col("many") & F.col("class_key").isNotNull(), of_set).otherwise(F.col("doc_id"))
    sets = sets.join(marked, "doc_id", "left").withColumn("node", node).drop("many")
    odd = texts.join(many, "doc_id", "left_semi")
    apart = materialize(sketches(odd).select("doc_id", "class_key").distinct().withColumn("node", of_set), "repeated-nodes")
    keyed = arrow_map(odd, _with_key, "doc_id long, text string, class_key binary").select("doc_id", "text", of_set.alias("node"))
    whole = texts.join(many, "doc_id", "left_anti").select("doc_id", "text", F.col("doc_id").alias("node")).unionByName(keyed)
    return sets, whole, apart.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("class_key", pa.binary())])
    for b in batches:
        yield batch(arrow, [b.column(0), b.column(1), [class_key(shingles(t)) for t in b.column(1).to_pylist()]])


def near_duplicates(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row. Sets whose similarity is ``similar`` per cent or more are linked."""
    table = doc_table(docs)
    sets, texts, same = named(materialize(sketches(table), "sketches"), table)
    linked = sets.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    keys = materialize(linked.groupBy("class_key").agg(F.min("node").alias("id")), "classes")
    classes = materialize(
        linked.join(keys.withColumnRenamed("id", "node"), ["class_key", "node"], "left_semi").dropDuplicates(["node"]).select(F.col("node").alias("id"), F.col("n_shingles").alias("n"), "sketch", "buckets"), "class-sketches"
    )
    lists = materialize(postings(classes, similar), "lists")
    # the most frequent values first, then a hash: one number, so that the aggregation needs no sort
    rank = F.shiftleft(F.col("common").cast("long"), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64("id"), 8))
    best = lists.groupBy("value").agg(F.max_by("id", rank).alias("a"), F.max_by("n", rank).alias("na"), F.count("*").alias("many"))
    centres = materialize(best.where("many > 1"), "centres")
    alike = lambda x, y: 100 * F.least(x, y) >= similar * F.greatest(x, y)
    met = materialize(lists.select("value", "id", "n").join(centres, "value"), "met")
    discard(lists, centres)
    stars = materialize(estimated(met.where((F.col("id") != F.col("a")) & alike(F.col("n"), F.col("na"))).select("a", F.col("id").alias("b")).distinct(), classes, similar), "stars")
    links = materialize(verified(stars, texts, similar), "links")
    first = components(links)
    # what a star left apart: members of one list in different components, and not compared yet
    placed = materialize(met.join(first, "id", "left").select("value", "id", "n", "many", "a", F.coalesce("component", "id").alias("component")), "placed")
    discard(met)
    mixed = materialize(placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("value"), "mixed")
    rest = materialize(placed.join(mixed, "value"), "apart")
    discard(placed, mixed)
    near = list_pairs(rest, similar)
    crowd = materialize(rest.where(F.col("many") > SHORT).select("id", "component").distinct(), "crowd")
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = estimated(near, classes, similar)
    if crowd.limit(1).count():
        crossing = crossing.unionByName(crowd_pairs(crowd, texts, classes, similar))
    crossing = crossing.distinct().join(known, ["a", "b"], "left_anti")
    more = materialize(crossing, "crossing")
    discard(rest, crowd, stars)
    if same is not None:  # documents join the classes of all of their sets
        of_class = linked.where(F.col("node") != F.col("doc_id")).join(keys, "class_key").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
        links = links.unionByName(same).unionByName(of_class)
    if same is not None or more.limit(1).count():
        found = components(links.unionByName(verified(more, texts, similar)))
    else:
        found = first
    root = materialize(keys.join(found, "id", "left").select("class_key", F.coalesce("component", "id").alias("component_id")), "roots")
    discard(classes, first, found, more)
    joined = sets.join(root, "class_key", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
