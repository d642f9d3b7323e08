"""BPE with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged across, so every such pair in a
pre-token is a certain cut. The fragments between cuts are encoded independently by the ranked merges and
their ids concatenated; fragments repeat, so each worker remembers those it has met.

Letters, numbers and capitals are classed by the Unicode version that the file's own normalizer and splitter know. They agree with ours on all
characters that Unicode 15.1 assigns but three marks; texts with any other character are normalized and split by the file's own.

Cases: null and empty texts have no ids and decode to the empty text; a very long run without cuts is
merged with a heap in n log n; equal texts give equal rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from chainloom.llm.common import arrow_map, batch, doc_table, read

#: Pre-tokens and words remembered by a worker before it starts anew.
REMEMBER = 400_000
#: Above every rank.
NEVER = 1 << 60
WHITE = r"[\t-\r \x85\xa0  -     　]"



# Marks whose order among others differs between Unicode versions.
REORDERED = frozenset("\u1df6\U0001e4ec\U0001e4ed")


def unassigned() -> re.Pattern:
    """Characters of the basic plane that this Python's Unicode doesn't assign, and all of the other planes."""
    found, start = [], None
    for c in range(0x10001):
        odd = c < 0x10000 and (unicodedata.category(chr(c)) == "Cn" or chr(c) in REORDERED)
        if odd and start is None:
            start = c
        elif not odd and start is not None:
            found.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return re.compile(f"[{''.join(found)}\U00010000-\U0010ffff]")


UNASSIGNED = unassigned()


def is_odd(text: str) -> bool:
    """Whether a text has a character that Unicode versions class differently."""
    if text.isascii() or not UNASSIGNED.search(text):
        return False
    return any(unicodedata.category(c) == "Cn" or c in REORDERED for c in set(text) if not c.isascii())


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, others follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 0
    for b in range(256):
        if b in own:
            letters.append(chr(b))
        else:
            letters.append(chr(256 + extra))
            extra += 1
    return letters


class ForcedBpe:
    """Encoder and decoder for a word vocabulary file: lower case, white space dropped, word ends marked."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.ranks: dict[tuple[str, str], int] = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pre = regex.compile(split.replace(r"[^\s", "[^" + WHITE[1:-1]))
        self.white = regex.compile(WHITE + "+")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        inside = set()
        for token in self.vocab:
            units = self.units(token.removesuffix(self.suffix), token.endswith(self.suffix))
            inside.update(zip(units, units[1:], strict=False))
        self.inside = inside
        self.path = path
        self.library = None
        self.word_ids: dict[str, tuple[int, ...]] = {}
        self.fragment_ids: dict[tuple[str, ...], tuple[int, ...]] = {}

    def units(self, letters: str, ends: bool) -> list[str]:
        """Single letters; the last one of a word carries the end mark."""
        units = list(letters)
        if ends and units:
            units[-1] += self.suffix
        return units

    def merged(self, units: tuple[str, ...]) -> tuple[int, ...]:
        """Ids of a fragment: the lowest-ranked pair is merged first, leftmost among equals."""
        n, parts = len(units), list(units)
        if 1 < n <= 32:
            ranks = self.ranks
            known = [ranks.get(pair, NEVER) for pair in zip(parts, parts[1:], strict=False)]
            while known and (low := min(known)) < NEVER:
                i = known.index(low)
                parts[i] += parts.pop(i + 1)
                del known[i]
                if i:
                    known[i - 1] = ranks.get((parts[i - 1], parts[i]), NEVER)
                if i < len(known):
                    known[i] = ranks.get((parts[i], parts[i + 1]), NEVER)
        elif n > 1:
            after, before = [*range(1, n), -1], list(range(-1, n - 1))
            heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
            heapq.heapify(heap)
            while heap:
                _, i, a, b = heapq.heappop(heap)
                k = after[i]
                if parts[i] != a or k < 0 or parts[k] != b:
                    continue
                parts[i], parts[k] = a + b, None
                after[i] = after[k]
                if after[k] >= 0:
                    before[after[k]] = i
                for left, right in ((before[i], i), (i, after[i])):
                    if left >= 0 and right >= 0 and (r := self.ranks.get((parts[left], parts[right]))) is not None:
                        heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return tuple(self.vocab[p] for p in parts if p is not None and p in self.vocab)

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a pre-token."""
        return self.of_letters(word.encode().decode("latin-1").translate(self.letters))

    def of_letters(self, letters: str) -> tuple[int, ...]:
        """Ids of the letters of a pre-token's bytes: cut where no token holds the pair, encode fragments, concatenate."""
        units = self.units(letters, True)
        ids: tuple[int, ...] = ()
        start = 0
        for i in range(1, len(units) + 1):
            if i == len(units) or (units[i - 1], units[i]) not in self.inside:
                piece = tuple(units[start:i])
                if (got := self.fragment_ids.get(piece)) is None:
                    if len(self.fragment_ids) >= REMEMBER:
                        self.fragment_ids.clear()
                    got = self.merged(piece)
                    if len(piece) <= 64:
                        self.fragment_ids[piece] = got
                ids += got
                start = i
        return ids

    def encode_odd(self, text: str) -> list[int]:
        """As ``encode_plain``, with the normalizer and splitter of the file."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        text = self.library.normalizer.normalize_str(text)
        return [i for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text) for i in self.of_letters(w)]

    def encode_plain(self, text: str) -> list[int]:
        if is_odd(text):
            return self.encode_odd(text)
        text = unicodedata.normalize("NFC", text)
        text = self.white.sub(" ", text).replace("Σ", "σ").lower()
        ids: list[int] = []
        known = self.word_ids
        for w in self.pre.findall(text):
            got = known.get(w)
            if got is None:
                if len(known) >= REMEMBER:
                    known.clear()
                got = self.word(w)
                if len(w) <= 64:
                    known[w] = got
            ids += got
        return ids

    def encode(self, text: str) -> list[int]:
        if not self.marks:
            return self.encode_plain(text)
        ids, at = [], 0
        for m in self.marks.finditer(text):
            ids += self.encode_plain(text[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + self.encode_plain(text[at:]) if at else self.encode_plain(text)

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the file names no decoder."""
        names = self.names
        return " ".join([names[i] for i in ids])


_CODERS: dict[str, ForcedBpe] = {}


def coder(path: str) -> ForcedBpe:
    if path not in _CODERS:
        _CODERS[path] = ForcedBpe(path)
    return _CODERS[path]


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every document."""
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield batch(arrow, [b.column(0), ids, [bpe.decode(x) for x in ids]])

    return arrow_map(doc_table(docs), run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As ``encode_documents``, with digests in place of ids and texts, so that only these leave the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield batch(ARROW, [b.column(0), n, ids_sha, text_sha])

    return arrow_map(doc_table(docs), run, SCHEMA)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
