"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A suspicious unit (digits or symbols among letters, a letter twice in a row, single characters set apart by white space) becomes a
lattice: each observed character may stand for itself or for a letter it looks like, repeat the one before, or be filling; white space
may be filling or the bound of two words. Viterbi finds the
cheapest restored words under a character trigram model. The restored words are scored by a logistic model over the weights of
words and word beginnings that mark toxic documents. Labels are learnt from at most ``SAMPLE_PER_CLASS`` labelled documents a
class, chosen by a hash of the id among rows whose crc32(doc_id) mod 5 is not 0; of those with near-equal texts the one with the smallest
id is learnt from. Everything else, the trigrams too, covers all rows. All marks that the sample shows are used; there are no more of
them than the sample's words and beginnings, and beyond ``MAX_MARKS`` training fails instead of leaving any out.

Cases: null and empty texts get the score of a text without marks; units of any length are decoded in linear time;
repeated rows score alike; without labels of both classes every score is the prior (0 where there are no labels);
labels that are null or contradict each other for one doc_id are left out; an empty ``documents`` gives no rows; extra columns, of
whatever names, are ignored (and kept as they are by ``reject``).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import arrow_map, batch, discard, doc_table, fold, materialize, mix64, read, words

#: Bound of the labelled sample, for each class.
SAMPLE_PER_CLASS = 4000
#: More marks than this are an error; the trigrams sent with them are bounded by the letters that texts use.
MAX_MARKS = 2_000_000
#: Hashes of a sample document's shingles by which near-equal texts are found, and the share of them that near-equal texts have in common.
SKETCH, NEAR = 64, 0.8
#: A mark needs this log odds, this G2 statistic and this many toxic documents.
LEAST_ODDS, LEAST_G2, LEAST_DOCS = 2.0, 18.0, 3
PREFIXES = (4, 5, 6)
REMEMBER = 300_000

# Letters that a character is written for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "*": "",
}
FILL = set(".-_*~'`^/\\,:;=#·•")
#: Costs of the channel, in nats.
SAME_DIGIT, SWAP, DROP_FILL, DROP_REPEAT, DROP_OTHER, DROP_SPACE, BOUND = 6.0, 0.7, 0.3, 0.5, 7.0, 0.3, 0.3

SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
TWICE, TWICE_ON = re.compile(r"(.)\1"), re.compile(r"(.)\1+")
RUN = re.compile(r"(.)\1\1")
EDGES = " \t\r\n.,;:!?\"'()[]{}<>«»“”‘’…-_"
ODD = re.compile(r"[0-9@$!|+€£(<¡*.\-_~'`^/\\,:;=#·•]")

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


class CharModel:
    """Interpolated character trigrams over words with their ends: cost(c | a b) in nats."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.tri = counts
        self.bi: Counter = Counter()
        self.uni: Counter = Counter()
        for g, n in counts.items():
            self.bi[g[1:]] += n
            self.uni[g[2]] += n
        self.before3: Counter = Counter()
        self.before2: Counter = Counter()
        for g, n in counts.items():
            self.before3[g[:2]] += n
            self.before2[g[1]] += n
        self.total = sum(self.uni.values())
        self.known: dict[tuple[str, str], float] = {}

    def cost(self, history: str, c: str) -> float:
        got = self.known.get((history, c))
        if got is None:
            p1 = (self.uni.get(c, 0) + 0.1) / (self.total + 20)
            p2 = (self.bi.get(history[1] + c, 0) + 5 * p1) / (self.before2.get(history[1], 0) + 5)
            p3 = (self.tri.get(history + c, 0) + 2 * p2) / (self.before3.get(history, 0) + 2)
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[history, c] = -math.log(p3)
        return got


def lattice(unit: str) -> list[list[tuple[str, float]]]:
    """For each observed character the letters it may stand for, with channel costs; '' means that it is dropped, a space that a
    word ends."""
    out = []
    for i, c in enumerate(unit):
        if c == " ":
            out.append([("", DROP_SPACE), (" ", BOUND)])
            continue
        ways = [(c, 0.0)] if c.isalpha() else [(c, SAME_DIGIT)] if c not in FILL else []
        ways += [(x, SWAP) for x in LOOKS.get(c, "")]
        if c in FILL:
            ways.append(("", DROP_FILL))
        elif i and unit[i - 1] == c:
            ways.append(("", DROP_REPEAT))
        elif not c.isalpha():
            ways.append(("", DROP_OTHER))
        out.append(ways)
    return out


def viterbi(unit: str, model: CharModel) -> str:
    """The cheapest words for ``unit``, with spaces between them. A state is the last two letters; back-pointers are kept by position."""
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for ways in lattice(unit):
        fresh: dict[str, tuple[float, tuple | None]] = {}
        for h, (cost, path) in states.items():
            for c, channel in ways:
                if c == " ":
                    to, total, way = "^^", cost + channel + model.cost(h, "$"), (c, path)
                elif c:
                    to, total, way = h[1] + c, cost + channel + model.cost(h, c), (c, path)
                else:
                    to, total, way = h, cost + channel, path
                if to not in fresh or total < fresh[to][0]:
                    fresh[to] = (total, way)
        states = fresh
    end = min(((cost + model.cost(h, "$"), h, path) for h, (cost, path) in states.items()), key=lambda x: x[:2])[2]
    letters = []
    while end:
        letters.append(end[0])
        end = end[1]
    return "".join(reversed(letters))


def suspicious(core: str) -> bool:
    if core.isalpha():
        return TWICE.search(core) is not None
    if " " in core:
        return any(map(str.isalpha, core))
    return any(map(str.isalpha, core)) and ODD.search(core) is not None


def restore(token: str, model: CharModel | None) -> tuple[str, ...]:
    """Words of a lower-case token: as it stands where nothing is suspicious, else also the decoded word."""
    core = token.strip(EDGES)
    if not core:
        return ()
    plain = (core,) if core.isalpha() else tuple(w for w in re.split(r"[\W\d_]+", core) if w)
    if model is None or not suspicious(token.rstrip(EDGES) if token[-1:] in EDGES else token):
        return plain
    decoded = viterbi(core, model)
    leading = viterbi(token.strip(" \t\r\n\"'()[]{}<>«»“”‘’"), model) if core != token else decoded
    return (*plain, *{w for x in (decoded, leading) for w in x.split() if w not in plain})


def tokens_of(text: str) -> set[str]:
    """Distinct lower-case units; single characters in a row, with any white space between them, are one unit too."""
    text = text.lower()
    found = set(text.split())
    for m in SPACED.finditer(text):
        found.add(" ".join(m[0].split()))
    return found


def names_of(word: str) -> list[str]:
    """Names of a word's features: itself and its beginnings."""
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def odds(t: float, c: float, nt: int, nc: int) -> float:
    """Log odds of a mark seen in t of nt toxic and c of nc other documents, or 0 where it says too little."""
    if t < LEAST_DOCS or nt <= 0 or nc <= 0:
        return 0.0
    lo = math.log((t + 0.5) / (nt + 1)) - math.log((c + 0.5) / (nc + 1))
    if lo < LEAST_ODDS:
        return 0.0
    et, ec = (t + c) * nt / (nt + nc), (t + c) * nc / (nt + nc)
    g2 = 2 * (t * math.log(t / et) + (c * math.log(c / ec) if c else 0))
    return lo if g2 >= LEAST_G2 else 0.0


def odds_column(t: Column, c: Column, nt: int, nc: int) -> Column:
    """The log odds alone of ``odds``, by which the many names that mark nothing go before any are collected."""
    return F.log((t + 0.5) / (nt + 1.0)) - F.log((c + 0.5) / (nc + 1.0)) + 1e-9


def summary(weights: list[float], n_words: int) -> list[float]:
    """What the logistic model sees of a document: the strongest mark, all marks, and their share."""
    total = sum(weights)
    return [max(weights, default=0.0) / 4, math.log1p(total), min(4.0, 10 * total / (10 + n_words))]


def squeezed(word: str) -> str:
    """A word with each run of one letter as a single one."""
    return TWICE_ON.sub(r"\1", word)


class Scorer:
    """The model that workers hold; its size is bounded by MAX_MARKS and the trigrams of letters that occur."""

    def __init__(self, marks: dict[str, float], trigrams: dict[str, int], beta: list[float]) -> None:
        self.marks, self.trigrams, self.beta = marks, trigrams, beta
        self.chars: CharModel | None = None
        self.known: dict[str, float] = {}
        self.heads: set[str] = set()
        self.wholes: set[str] = set()
        self.starts: set[str] = set()

    def prepare(self) -> None:
        self.chars = CharModel(self.trigrams)
        self.heads = {n[1 : 1 + PREFIXES[0]] for n in self.marks}
        self.wholes = {squeezed(n[1:]) for n in self.marks if n[0] == "="}
        self.starts = {squeezed(n[1:]) for n in self.marks if n[0] == "^"}

    def may_mark(self, token: str) -> bool:
        """Whether a lattice of ``token`` can hold a marked word. Where letters only repeat and all else is filling, each of its words has
        the token's letters without their repeats, so it isn't decoded if no mark has these."""
        letters = "".join(c for c in token if c not in FILL)
        if not letters.isalpha():
            return True
        s = squeezed(letters)
        return s in self.wholes or any(s[:k] in self.starts for k in range(1, max(PREFIXES) + 1))

    def weight(self, token: str) -> float:
        if self.chars is None:
            self.prepare()
        core = token.rstrip(EDGES)
        if core.isalpha() and not TWICE.search(core):  # nothing to restore
            words = (core,)
        else:
            words = restore(token, self.chars if self.may_mark(token) else None)
        marks, heads = self.marks, self.heads
        return max((marks.get(n, 0.0) for w in words if w[: PREFIXES[0]] in heads for n in names_of(w)), default=0.0)

    def score(self, text: str) -> float:
        known = self.known
        units = tokens_of(text)
        hits = []
        for u in units:
            w = known.get(u)
            if w is None:
                if len(known) >= REMEMBER:
                    known.clear()
                w = self.weight(u)
                if len(u) <= 64:
                    known[u] = w
            if w:
                hits.append(w)
        z = self.beta[0] + sum(b * x for b, x in zip(self.beta[1:], summary(sorted(hits), len(units)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps of an L2-penalised logistic regression; the intercept is free."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sketch(text: str) -> np.ndarray:
    """The smallest distinct hashes of five words."""
    w = words(text)
    ids = np.array([zlib.crc32(x) for x in w] or [0], dtype=np.uint64)
    h = mix64(ids)
    if len(h) >= 5:
        n = len(h) - 4
        h = mix64(h[:n] + mix64(h[1 : n + 1] + mix64(h[2 : n + 2] + mix64(h[3 : n + 3] + mix64(h[4 : n + 4])))))
    return np.unique(h)[:SKETCH]


def near_equal(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the union of two sketches, as far as a sketch reaches, is mostly in both."""
    union = np.union1d(x, y)[:SKETCH]
    return len(np.intersect1d(np.intersect1d(x, y, True), union, True)) >= NEAR * len(union)


def without_copies(rows: list[tuple[int, int, np.ndarray]]) -> list[int]:
    """The ids of (doc_id, toxic, sketch) that are near-equal to no row of their class with a smaller id that stays. Near-equal texts
    share one of their few smallest hashes, by which they meet."""
    kept: list[int] = []
    met: dict[tuple[int, int], list[np.ndarray]] = {}
    for doc_id, toxic, x in sorted(rows, key=lambda r: (r[0], r[2].tolist())):
        first = [(toxic, int(h)) for h in x[:8]]
        held = {id(y): y for k in first for y in met.get(k, ())}
        if any(near_equal(x, y) for y in held.values()):
            continue
        kept.append(doc_id)
        for k in first:
            met.setdefault(k, []).append(x)
    return kept


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of at most ``per_class`` documents a class and the labelled rows of each class."""
    usable = labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id", 5) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 24)  # 40 bits
    chosen = None
    for k in (0, 1):
        # rows far behind the bound never leave their task; the share kept is half as much again as needed
        share = min(1.0, (1.5 * per_class + 100) / max(1, counts.get(k, 0)))
        part = usable.where((F.col("toxic") == k) & (place <= int(share * (1 << 40)))).orderBy(place, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class rows of two numbers
    rows = [(r["doc_id"], r["toxic"]) for r in chosen.collect()]
    small = docs.sparkSession.createDataFrame(rows, "doc_id long, toxic int")
    return doc_table(docs).join(F.broadcast(small), "doc_id"), counts


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(g, n): trigrams of the words of letters, with their ends, over all of ``docs`` (doc_id, text); a document counts a word once."""
    arrow = pa.schema([("g", pa.string()), ("n", pa.int64())])

    def grams(held: Counter) -> pa.RecordBatch:
        out: Counter = Counter()
        for w, n in held.items():
            if w.isalpha() and not RUN.search(w):
                padded = f"^^{w}$"
                for i in range(len(w) + 1):
                    out[padded[i : i + 3]] += n
        return batch(arrow, [list(out), list(out.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for text in b.column(1).to_pylist():
                held.update(set(text.lower().split()))
            if len(held) > REMEMBER:
                yield grams(held)
                held = Counter()
        if held:
            yield grams(held)

    return arrow_map(docs, run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Scorer:
    spark = docs.sparkSession
    chosen, counts = sample(docs, labels, per_class)
    if not counts.get(1) or not counts.get(0):
        prior = 30.0 if counts.get(1) else -30.0
        return Scorer({}, {}, [prior, 0.0, 0.0, 0.0])
    # what a document is learnt from: its distinct units; copies and near copies count once
    arrow = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("sketch", pa.binary()), ("units", pa.list_(pa.string()))])

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield batch(arrow, [b.column(0), b.column(2), [sketch(t).tobytes() for t in texts], [sorted(tokens_of(t)) for t in texts]])

    prepared = materialize(arrow_map(chosen.select("doc_id", "text", "toxic"), prepare, "doc_id long, toxic int, sketch binary, units array<string>").dropDuplicates(["doc_id", "sketch"]), "toxic-sample")
    # SKETCH numbers of each of the sample's documents
    sketches = [(r["doc_id"], r["toxic"], np.frombuffer(r["sketch"], np.uint64)) for r in prepared.select("doc_id", "toxic", "sketch").collect()]
    stay = spark.createDataFrame([(i,) for i in sorted(set(without_copies(sketches)))], "doc_id long")
    units = materialize(prepared.join(F.broadcast(stay), "doc_id").select("toxic", "units"), "toxic-units")
    discard(prepared)
    by_class = {r["toxic"]: r["count"] for r in units.groupBy("toxic").count().collect()}
    nt, nc = by_class.get(1, 0), by_class.get(0, 0)
    if not nt or not nc:  # labels whose documents aren't there
        return Scorer({}, {}, [30.0 if nt else -30.0, 0.0, 0.0, 0.0])

    trigrams = {r["g"]: r["n"] for r in trigram_counts(doc_table(docs)).collect()}

    held: dict[str, CharModel] = {}

    def model() -> CharModel:
        if "m" not in held:
            held["m"] = CharModel(trigrams)
        return held["m"]

    marked = pa.schema([("name", pa.string()), ("t", pa.int64()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, t, c, known = model(), Counter(), Counter(), {}
        for b in batches:
            for toxic, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names = set()
                for u in found:
                    if u not in known:
                        known[u] = [n for w in restore(u, chars) for n in names_of(w)]
                    names.update(known[u])
                (t if toxic else c).update(names)
        names = sorted({*t, *c})
        yield batch(marked, [names, [t[n] for n in names], [c[n] for n in names]])

    tally = arrow_map(units.select("toxic", "units"), count, "name string, t long, c long").groupBy("name").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    weight = odds_column(F.col("t"), F.col("c"), nt, nc)
    found = tally.where((F.col("t") >= LEAST_DOCS) & (weight >= LEAST_ODDS)).limit(MAX_MARKS + 1).collect()
    if len(found) > MAX_MARKS:
        raise ValueError(f"the labelled sample shows more than {MAX_MARKS} marks; take a smaller per_class")
    seen = {r["name"]: (r["t"], r["c"]) for r in found}
    marks = {n: w for n, (t, c) in sorted(seen.items()) if (w := odds(t, c, nt, nc))}

    # each sample document is described by what the others say of its marks
    told = pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])
    strong = {n: seen[n] for n in marks}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars = model()
        for b in batches:
            out = []
            for toxic, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                dt, dc = (1, 0) if toxic else (0, 1)
                weights = []
                for u in found:
                    w = max((odds(strong[n][0] - dt, strong[n][1] - dc, nt - dt, nc - dc) for w in restore(u, chars) for n in names_of(w) if n in strong), default=0.0)
                    if w:
                        weights.append(w)
                out.append(summary(sorted(weights), len(found)))
            yield batch(told, [b.column(0), out])

    rows = arrow_map(units.select("toxic", "units"), describe, "toxic int, x array<double>").collect()  # at most 2 * per_class
    y = np.array([r["toxic"] for r in rows], float)
    beta = logistic(np.array([r["x"] for r in rows]), y)
    discard(units)
    beta[0] += math.log(counts[1] / counts[0]) - math.log(max(nt, 1) / max(nc, 1))  # from the sample's prior to the table's
    return Scorer(marks, trigrams, [float(b) for b in beta])


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) of every row."""
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(arrow, [b.column(0), [scorer.score(t or "") for t in b.column(1).to_pylist()]])

    return arrow_map(table, run, "doc_id long, score double")


def reject(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score stays under ``threshold``, with all their columns."""
    schema = docs.schema
    arrow_names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = arrow_names.index("text")
        for b in batches:
            yield b.filter(pa.array([scorer.score(t or "") < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return arrow_map(docs, run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
