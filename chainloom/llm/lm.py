"""Language-model scores: Brown class-based bigrams.

Every word that occurs ``LEAST`` times in training at least, however large the input, is put into a class by exchange: it
moves to the class that raises the likelihood of the class bigrams most. The most frequent words (``CORE``) and the rare ones by
their endings move one after the other; then all words move in rounds, each by the counts of the classes around it, which workers take
over all training texts, and each word's best class is found in a worker. Rarer words have too few neighbours to be placed by them:
those with one ending (``BUCKETS`` hashes of three letters) share a class, found by exchange as well, and divide its mass by their counts.
A text's probability is the product of class transitions and word emissions, both smoothed.

Workers hold the ``HELD`` most frequent words and no others: what a chunk of texts has besides them is looked up by a join with the counts,
each word once in a chunk, and texts are kept as the numbers of their words. Of a clustered word the driver and the workers hold its class
(a byte) and, once, the place of its ending (two bytes), so a larger vocabulary costs them hardly more. How many words are held changes
no result.

Cases: null and empty texts are one end token; unseen words count 0; without training texts N and V are 0 and all words
are equally likely; repeated rows are scored one by one; texts of any length are scored whole; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import arrow_map, batch, discard, doc_table, fold, materialize, read, words
from chainloom.sources.scratch import large

#: A clustered word occurs so often in training.
LEAST = 5
#: Words that are exchanged one after the other, hashes of the endings of rare ones, classes.
CORE, BUCKETS, CLASSES = 600, 256, 48
#: Rounds of the exchange over the core and over all clustered words; share of the unigram in transitions; words a worker holds before it hands counts on.
ROUNDS, SWEEPS, MIX, HOLD = 6, 3, 0.05, 200_000
#: Words that driver and workers hold by their text; neighbouring numbers whose classes a worker sends together.
HELD, BLOCK = 100_000, 1024
#: In a byte, instead of a class: this word isn't moved.
STAYS = 255

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def bucket_of(word: str) -> int:
    """Rare words that end alike share a bucket."""
    return zlib.crc32(word[-3:].encode("utf-8", "surrogatepass")) % BUCKETS


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) of all words of ``docs`` (doc_id, text)."""
    arrow = pa.schema([("token", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for text in b.column(1).to_pylist():
                held.update(words(text))
            if len(held) > HOLD:
                yield batch(arrow, [[w.decode("utf-8", "surrogatepass") for w in held], list(held.values())])
                held = Counter()
        if held:
            yield batch(arrow, [[w.decode("utf-8", "surrogatepass") for w in held], list(held.values())])

    return arrow_map(docs, run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Symbols:
    """Numbers of words: a clustered word has its own (frequent ones first), others that of their bucket; the last one is the end."""

    def __init__(self, known: list[tuple[str, int]]) -> None:
        """known: the words that are held, and how often they occur."""
        self.words = [w for w, _ in known]
        self.n = np.array([n for _, n in known], np.int64)
        self.number(len(known))

    def number(self, clustered: int) -> None:
        """Make room for all clustered words, of which the first ones are held."""
        self.first_bucket = clustered
        self.end = self.first_bucket + BUCKETS
        self.size = self.end + 1
        self.ids: dict[bytes, int] | None = None

    def of(self, tokens: list[bytes], slots: dict[bytes, int]) -> np.ndarray:
        """The number of each held word; -1 - its place in ``slots`` for others, which get one there."""
        if self.ids is None:
            self.ids = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(self.words)}
        at = np.array([*map(self.ids.get, tokens, [-1] * len(tokens))], np.int32)
        for i in np.flatnonzero(at < 0).tolist():
            at[i] = -1 - slots.setdefault(tokens[i], len(slots))
        return at

    def core(self, core: int, others: np.ndarray | None = None) -> np.ndarray:
        """For each number its place among ``core`` words, buckets and the end. others: buckets of the clustered words that aren't held."""
        core = min(core, len(self.words))
        own = [i if i < core else core + bucket_of(w) for i, w in enumerate(self.words)]
        rest = np.zeros(0, np.uint16) if others is None else others.astype(np.uint16) + np.uint16(core)
        return np.concatenate([np.array(own, np.uint16), rest, np.arange(core, core + BUCKETS + 1, dtype=np.uint16)])


class Unigrams:
    """What counts alone give of a text's probability."""

    def __init__(self, n: int, v: int, n_train: int, rare: dict[int, tuple[int, int]]) -> None:
        """n, v: tokens of training, distinct ones; n_train: its texts; rare: count and number of a bucket's words."""
        self.n, self.n_train = n, n_train
        whole = [rare.get(b, (0, 0)) for b in range(BUCKETS)]
        self.mass = np.array([a for a, _ in whole], float)
        # what a rare word's count is divided by, and its bucket's mass
        self.of_bucket = np.log10(self.mass + 0.5) - np.log10([a + 0.5 * (m + 1) for a, m in whole])
        self.below = math.log10(n + 0.5 * (v + 1))

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10(n + 0.5) - self.below

    def own(self, n: np.ndarray, number: np.ndarray, first_bucket: int) -> np.ndarray:
        """log10 of words' masses, which those of their classes divide."""
        b = number - first_bucket
        rare = (b >= 0) & (b < BUCKETS)
        return np.log10(n + 0.5) + np.where(rare, self.of_bucket[np.where(rare, b, 0)], 0.0)


def chunks(rows: DataFrame, symbols: Symbols) -> DataFrame:
    """Texts of ``rows`` (doc_id, text, learns, asked) in chunks, those that are learnt from first: the numbers of their words, an end after each
    text, and the words that ``symbols`` doesn't hold."""
    arrow = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("asked", pa.list_(pa.bool_())), ("length", pa.list_(pa.int32())), ("learnt", pa.int32()), ("size", pa.int32()), ("ids", pa.binary()), ("tokens", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([symbols.end], np.int32)
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            learns = np.array(b.column(2).to_pylist(), bool)
            order = np.argsort(~learns, kind="stable")
            texts, doc_id, asked = (b.column(i).to_pylist() for i in (1, 0, 3))
            slots: dict[bytes, int] = {}
            of = [symbols.of(words(texts[i]), slots) for i in order.tolist()]
            ids = np.concatenate([x for one in of for x in (one, end)]).astype("<i4") if of else end[:0]
            packed = pa.compress(ids.tobytes(), codec="zstd", asbytes=True)
            yield batch(arrow, [[chunk], [[doc_id[i] for i in order]], [[asked[i] for i in order]], [[len(x) + 1 for x in of]], [int(learns.sum())], [len(ids)], [packed], [[t.decode("utf-8", "surrogatepass") for t in slots]]])
            chunk += 1

    return arrow_map(rows.select("doc_id", "text", "learns", "asked"), run, "chunk long, doc_id array<long>, asked array<boolean>, length array<int>, learnt int, size int, ids binary, tokens array<string>")


def bucket_column():
    """``bucket_of`` the column token."""
    return F.crc32(F.substring("token", -3, 3).cast("binary")) % BUCKETS


def look_up(texts: DataFrame, table: DataFrame, symbols: Symbols) -> DataFrame:
    """(chunk, found): number and count of the words of a chunk that aren't held. table: (token, number, n), number null for rare words."""
    slots = texts.select("chunk", F.posexplode("tokens").alias("slot", "token"))
    number = F.coalesce("number", (bucket_column() + symbols.first_bucket).cast("int"))
    met = slots.join(large(table), "token", "left").select("chunk", F.struct("slot", number.alias("number"), F.coalesce("n", F.lit(0)).alias("n")).alias("one"))
    return met.groupBy("chunk").agg(F.collect_list("one").alias("found"))


def numbered(texts: DataFrame, table: DataFrame, symbols: Symbols, unigrams: Unigrams) -> DataFrame:
    """Chunks with the numbers of all their words as 32-bit integers: ``ids`` of the texts that are learnt from, with an end before each and after the
    last, and ``rest`` of the others; for each text what counts give."""
    kept = ["doc_id", "asked", "length", "learnt", "size", "ids", "found"]
    met = texts.drop("tokens").join(large(look_up(texts, table, symbols)), "chunk", "left").select(*kept)
    arrow = pa.schema([("ids", pa.binary()), ("rest", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("asked", pa.list_(pa.bool_())), ("length", pa.list_(pa.int32())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("own", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, end = len(symbols.words), symbols.end
        for b in batches:
            doc_id, asked, length, learnt, size, packed, found = (b.column(i) for i in range(7))
            for i in range(b.num_rows):
                x = np.frombuffer(pa.decompress(packed[i].as_py(), size[i].as_py() * 4, codec="zstd"), "<i4")
                # held words, the end, then the words that were looked up
                number, n = [np.append(np.arange(held), end)], [np.append(symbols.n, unigrams.n_train)]
                if found[i].is_valid:
                    one = found[i].values
                    slot = np.argsort(one.field("slot").to_numpy())
                    number.append(one.field("number").to_numpy()[slot])
                    n.append(one.field("n").to_numpy()[slot])
                numbers, counts = np.concatenate(number), np.concatenate(n)
                at = np.where(x < 0, held - x, np.where(x == end, held, x))
                each = length[i].values.to_numpy()
                first = np.cumsum(each) - each
                ids = np.concatenate([[end], numbers[at]]).astype("<i4")
                cut = 1 + int(each[: learnt[i].as_py()].sum())
                sums = [np.add.reduceat(v[at], first) for v in ((counts > 0).astype(np.int64), unigrams.base(counts), unigrams.own(counts, numbers, symbols.first_bucket))]
                yield batch(arrow, [[ids[:cut].tobytes()], [ids[cut:].tobytes()], doc_id.slice(i, 1), asked.slice(i, 1), length.slice(i, 1), *([v] for v in sums)])

    return arrow_map(met, run, "ids binary, rest binary, doc_id array<long>, asked array<boolean>, length array<int>, n_known array<long>, base array<double>, own array<double>")


def code_counts(ids: DataFrame, codes, dense: int) -> DataFrame:
    """(code, n) of ``codes(numbers)`` over all rows of ``ids``. dense: codes below it are counted in an array, others one by one."""
    arrow = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.zeros(dense, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if not held:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            code, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(at, np.concatenate([n for _, n in held]), len(code)).astype(np.int64)

        for b in batches:
            for stored in b.column(0):
                code = codes(np.frombuffer(stored.as_py(), "<i4"))
                low += np.bincount(code[code < dense], minlength=dense)
                high = code[code >= dense]
                if len(high):
                    held.append(np.unique(high, return_counts=True))
                    size += len(held[-1][0])
                if size > 1_500_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 750_000:
                        yield batch(arrow, [pa.array(held[0][0]), pa.array(held[0][1])])
                        held, size = [], 0
        at = np.flatnonzero(low)
        code, n = merged()
        yield batch(arrow, [pa.array(np.concatenate([at, code])), pa.array(np.concatenate([low[at], n]))])

    return arrow_map(ids, run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def square(counts: DataFrame, size: int) -> np.ndarray:
    """Counts of pairs (code = first * size + second), of which there are ``size`` squared at most."""
    got = counts.toArrow()
    out = np.zeros(size * size)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(size, size)


def class_pairs(ids: DataFrame, cls: np.ndarray) -> np.ndarray:
    """Counts of neighbouring classes; cls: the class of each number. Ends follow each other at the bounds of rows only, and are no pair."""
    k = int(cls.max()) + 1

    def codes(x: np.ndarray) -> np.ndarray:
        c = cls[x].astype(np.int64)
        return c[:-1] * k + c[1:]

    return square(code_counts(ids, codes, k * k), k)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(g: np.ndarray, gl: np.ndarray, gr: np.ndarray, r: np.ndarray, c: np.ndarray, own: float, left: float, right: float) -> np.ndarray:
    """What the log-likelihood of class bigrams ``g`` (with sums ``gl`` of rows and ``gr`` of columns), all without one word, gains if
    each class takes the word. r, c: counts of the classes after and before it; own: of itself after itself."""
    f = xlogx(g)
    rows = xlogx(g + r) - f
    cols = (xlogx(g + c[:, None]) - f).T
    gain = rows.sum(1) - rows.diagonal() + cols.sum(1) - cols.diagonal()
    d = g.diagonal()
    gain += xlogx(d + r + c + own) - xlogx(d)
    return gain - (xlogx(gl + left) - xlogx(gl) + xlogx(gr + right) - xlogx(gr))


def exchange(pairs: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each symbol; the last symbol keeps a class of its own. Words move one after the other, frequent ones first."""
    size = len(pairs)
    left, right = pairs.sum(1), pairs.sum(0)
    order = np.argsort(-(left + right), kind="stable")
    order = order[order != size - 1]
    k = max(1, min(classes - 1, size - 1))
    cls = np.full(size, k)
    cls[order] = np.arange(len(order)) % k
    member = np.eye(k + 1)[cls]
    g = member.T @ pairs @ member
    gl, gr = g.sum(1), g.sum(0)
    for _ in range(rounds):
        moved = 0
        for w in order:
            if left[w] + right[w] == 0:
                continue
            a, own = cls[w], pairs[w, w]
            r = np.bincount(cls, pairs[w], k + 1)
            c = np.bincount(cls, pairs[:, w], k + 1)
            r[a] -= own
            c[a] -= own
            g[a] -= r
            g[:, a] -= c
            g[a, a] -= own
            gl[a] -= left[w]
            gr[a] -= right[w]
            gain = gains(g, gl, gr, r, c, own, left[w], right[w])
            b = int(np.argmax(gain[:k]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            g[b] += r
            g[:, b] += c
            g[b, b] += own
            gl[b] += left[w]
            gr[b] += right[w]
            moved += b != a
            cls[w] = b
        if not moved:
            break
    return cls


def best_class(g: np.ndarray, a: int, r: np.ndarray, c: np.ndarray, own: float) -> int:
    """The class that a word of class ``a`` had best, all others staying where they are. r, c, own: see ``gains``; here r and c count
    the word among the words of its class."""
    r, c = r.copy(), c.copy()
    left, right = r.sum(), c.sum()
    r[a] -= own
    c[a] -= own
    gl, gr, g = g.sum(1), g.sum(0), g.copy()
    gl[a] -= left
    gr[a] -= right
    g[a] -= r
    g[:, a] -= c
    g[a, a] -= own
    gain = gains(g, gl, gr, r, c, own, left, right)[:-1]
    b = int(np.argmax(gain))
    return b if gain[b] > gain[a] + 1e-9 else a


def log_likelihood(g: np.ndarray) -> float:
    """What classes explain of the order of words: the part of the log-likelihood that depends on them."""
    return float(xlogx(g).sum() - xlogx(g.sum(0)).sum() - xlogx(g.sum(1)).sum())


def sweep(ids: DataFrame, cls: np.ndarray, n_words: int, g: np.ndarray, turn: int) -> np.ndarray:
    """Classes after every second clustered word (those that ``turn`` names) has moved to its best class. Workers count the classes around each
    word; the counts of a word meet in a worker, which finds the class."""
    k = len(g)
    width = 2 * k + 1  # of a word: classes after it, classes before it, itself after itself
    cls = cls.astype(np.uint8)

    def codes(x: np.ndarray) -> np.ndarray:
        c, x = cls[x].astype(np.int64), x.astype(np.int64)
        a, b = x[:-1], x[1:]
        first, second = (a < n_words) & (a % 2 == turn), (b < n_words) & (b % 2 == turn)
        same = first & (a == b)
        return np.concatenate([a[first] * width + c[1:][first], b[second] * width + k + c[:-1][second], a[same] * width + 2 * k])

    arrow = pa.schema([("block", pa.int32()), ("cls", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, row = -1, np.zeros(width)
        block, found = -1, np.zeros(0, np.uint8)

        def placed() -> None:
            found[word % BLOCK] = best_class(g, int(cls[word]), row[:k], row[k : 2 * k], row[2 * k])

        for b in batches:
            code, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(code // width)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(code)], strict=True):
                if lo == hi:
                    continue
                w = int(code[lo] // width)
                if w != word:
                    if word >= 0:
                        placed()
                    if w // BLOCK != block:
                        if block >= 0:
                            yield batch(arrow, [[block], [found.tobytes()]])
                        block, found = w // BLOCK, np.full(BLOCK, STAYS, np.uint8)
                    word, row = w, np.zeros(width)
                row[code[lo:hi] % width] += n[lo:hi]
        if word >= 0:
            placed()
            yield batch(arrow, [[block], [found.tobytes()]])

    counts = code_counts(ids, codes, 0)
    by_word = counts.repartition((F.col("code") / (width * BLOCK)).cast("long")).sortWithinPartitions("code").select("code", "n")
    fresh = cls.copy()
    got = arrow_map(by_word, run, "block int, cls binary").toArrow()  # a byte for each clustered word
    for block, found in zip(got.column(0).to_pylist(), got.column(1), strict=True):
        here = fresh[block * BLOCK : (block + 1) * BLOCK]
        there = np.frombuffer(found.as_buffer(), np.uint8)[: len(here)]
        here[there != STAYS] = there[there != STAYS]
    return fresh


def classes(ids: DataFrame, place: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each number and the counts of neighbouring classes. ids: texts as numbers; place: see ``Symbols.core``; n_words: clustered words."""
    of_core = exchange(class_pairs(ids, place), CLASSES).astype(np.uint8)
    cls = of_core[place]
    g = class_pairs(ids, cls)
    for turn in range(SWEEPS):
        moved = sweep(ids, cls, n_words, g, turn % 2)
        after = class_pairs(ids, moved)
        if log_likelihood(after) > log_likelihood(g):  # words move at once, so a round may overshoot
            cls, g = moved, after
    return cls, g


def cluster(training: DataFrame, symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """``classes`` of texts (doc_id, text) whose clustered words ``symbols`` all holds."""
    texts = materialize(chunks(training.select("doc_id", "text", F.lit(True).alias("learns"), F.lit(False).alias("asked")), symbols), "texts")
    nothing = training.sparkSession.createDataFrame([], "token string, number int, n long")
    ids = materialize(numbered(texts, nothing, symbols, Unigrams(0, 0, 0, {})), "numbered-texts")
    out = classes(ids.select("ids"), symbols.core(CORE), symbols.first_bucket)
    discard(texts, ids)
    return out


def ranked(counts: DataFrame) -> DataFrame:
    """Clustered words (token, number, n) by falling counts, those of one count by their texts; to be discarded."""
    rows = materialize(counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "token").select("token", "n", F.monotonically_increasing_id().alias("at")), "clustered-words")
    part, sizes = F.shiftright("at", 33), {}
    for r in rows.groupBy(part.alias("part")).count().collect():
        sizes[r["part"]] = r["count"]
    before = [0]
    for i in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(i, 0))
    of_part = F.element_at(F.lit(before), (part + 1).cast("int"))
    out = rows.select("token", (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + of_part).cast("int").alias("number"), "n")
    out.scratch_path = rows.scratch_path
    return out


def buckets_of(words_: DataFrame, first: int, size: int) -> np.ndarray:
    """Buckets of the ``size`` words (token, number, n) with numbers from ``first`` on."""
    arrow = pa.schema([("start", pa.int64()), ("buckets", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, bucket = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.uint8)
            cuts = [0, *(np.flatnonzero(np.diff(number) != 1) + 1).tolist(), len(number)]
            runs = [(int(number[lo]), bucket[lo:hi].tobytes()) for lo, hi in zip(cuts, cuts[1:], strict=False) if lo < hi]
            yield batch(arrow, [[r[0] for r in runs], [r[1] for r in runs]])

    out = np.zeros(size, np.uint8)
    got = arrow_map(words_.where(F.col("number") >= first).select("number", bucket_column().cast("int")), run, "start long, buckets binary").toArrow()
    for start, run_ in zip(got.column(0).to_pylist(), got.column(1), strict=True):
        part = np.frombuffer(run_.as_buffer(), np.uint8)
        out[start - first : start - first + len(part)] = part
    return out


def class_masses(words_: DataFrame, first: int, cls: np.ndarray, k: int) -> np.ndarray:
    """For each class the mass of its words (token, number, n) with numbers from ``first`` on."""
    arrow = pa.schema([("cls", pa.int32()), ("mass", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(k)
        for b in batches:
            mass += np.bincount(cls[b.column(0).to_numpy()], b.column(1).to_numpy() + 0.5, k)
        yield batch(arrow, [list(range(k)), mass])

    out = np.zeros(k)
    for r in arrow_map(words_.where(F.col("number") >= first).select("number", "n"), run, "cls int, mass double").groupBy("cls").agg(F.sum("mass").alias("mass")).collect():
        out[r["cls"]] = r["mass"]
    return out


class ClassModel:
    """log10 tables: transition[class, class] and emission[number]."""

    def __init__(self, g: np.ndarray, cls: np.ndarray, n: np.ndarray, more: np.ndarray | float = 0.0) -> None:
        """g: counts of neighbouring classes; n: of each number; more: masses that classes have besides."""
        g = g + 0.01
        unigram = g.sum(0) / g.sum()
        self.transition = np.log10((1 - MIX) * g / g.sum(1, keepdims=True) + MIX * unigram)
        n = n + 0.5
        self.mass = np.bincount(cls, n, len(g)) + more
        self.emission = np.log10(n / self.mass[cls])
        self.cls = cls


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: its digest columns without held_out. ``training``: (doc_id, text)."""
    flags = [("doc_id", "text", F.lit(learns).alias("learns"), F.lit(not learns).alias("asked")) for learns in (True, False)]
    return score_rows(training.select(*flags[0]).unionByName(docs.select(*flags[1])))


def score_rows(rows: DataFrame) -> DataFrame:
    """Digest columns of the rows that are asked, learnt from those that learn: (doc_id, text, learns, asked)."""
    training = rows.where("learns").select("doc_id", "text")
    counts = materialize(token_counts(training), "word-counts")
    n_train = training.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") >= LEAST).alias("clustered")).first()
    # what a bucket's words have together: at most BUCKETS rows
    is_rare = F.col("n") < LEAST
    rare = {r["b"]: (r["n"], r["v"]) for r in counts.where(is_rare).groupBy(bucket_column().alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    unigrams = Unigrams(total["n"] + n_train, total["v"] + (n_train > 0), n_train, rare)
    by_rank = ranked(counts)
    known = by_rank.where(F.col("number") < max(HELD, CORE)).toArrow().sort_by("number")
    symbols = Symbols([*zip(known.column(0).to_pylist(), known.column(2).to_pylist(), strict=True)])
    symbols.number(total["clustered"])
    held = len(symbols.words)

    texts = materialize(chunks(rows, symbols), "texts")
    table = by_rank.where(F.col("number") >= held).unionByName(counts.where(is_rare).select("token", F.lit(None).cast("int").alias("number"), "n"))
    ids = materialize(numbered(texts, table, symbols, unigrams), "numbered-texts")
    discard(texts, counts)
    place = symbols.core(CORE, buckets_of(by_rank, held, symbols.first_bucket - held))
    cls, g = classes(ids.select("ids"), place, symbols.first_bucket)
    more = class_masses(by_rank, held, cls, len(g))
    discard(by_rank)
    model = ClassModel(g, np.concatenate([cls[:held], cls[symbols.first_bucket :]]), np.concatenate([symbols.n, unigrams.mass, [n_train]]), more)
    step, first_class = model.transition - np.log10(model.mass), cls[symbols.end]

    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc_id, asked, length, n_known, base, own = (b.column(j)[i].values for j in range(2, 8))
                # the end before the first text isn't a token; each text's own end is what comes before the next one
                c = cls[np.concatenate([np.frombuffer(b.column(j)[i].as_buffer(), "<i4") for j in (0, 1)])[1:]]
                each = length.to_numpy()
                steps = np.add.reduceat(step[np.concatenate([[first_class], c[:-1]]), c], np.cumsum(each) - each)
                out = pa.RecordBatch.from_arrays([doc_id, pa.array(each.astype(np.int64)), n_known, base, pa.array(own.to_numpy() + steps)], schema=arrow)
                yield out.filter(asked)

    scored = arrow_map(ids, run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(unigrams.n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_table(read(spark, sf_dir, "documents"))
    held_out = fold("doc_id", 5) == 1
    scored = score_rows(docs.select("doc_id", "text", (~held_out).alias("learns"), F.lit(True).alias("asked")))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
