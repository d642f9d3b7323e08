"""Packing: harmonic classes of piece lengths, filled with a fixed count of pieces by each worker on its own.

A document's ids are cut into full sequences; what remains goes to the reciprocal class j with
capacity/(j+1) < length <= capacity/j, whose bins take exactly j pieces. A remainder that would leave
more than ``SLACK`` of its slot empty gives up a head of exactly capacity/(j+1) ids and the rest is classed again.
Bins of a class that a worker can't fill are laid end to end and cut at the capacity; the last of these is
cut at powers of two, where sequences need no padding.

Cases: null and empty texts are one piece with the end id alone; documents of any length stream through;
equal documents are packed one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from chainloom.llm.common import arrow_map, batch, doc_table, read

CAPACITY, END_ID, SLACK = 2048, 1, 0.03
MARK = "<|endoftext|>"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

_ENCODERS: dict[str, object] = {}


def gave_up(e: Exception) -> bool:
    """Whether the fast encoder's regex engine ran out of steps or stack."""
    return isinstance(e, ValueError) or "regex" in str(e).lower() or "stack" in str(e).lower()


def encoder(vocabulary: str, ranks_file: str | None):
    """text -> ids as ``tokenizers`` gives them for ``vocabulary``; the same vocabulary as ranks is faster where it is given."""
    key = f"{vocabulary}|{ranks_file}"
    if key not in _ENCODERS:
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(vocabulary)
        plain.no_truncation()
        plain.no_padding()
        if ranks_file:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

            def encode(text: str) -> list[int]:
                if MARK not in text:
                    try:
                        return fast.encode_ordinary(text)
                    except Exception as e:  # its regex engine gives up on some very long runs
                        if not gave_up(e):
                            raise
                    except BaseException as e:  # which it may also tell by a panic, which is no Exception
                        if type(e).__name__ != "PanicException":
                            raise
                return plain.encode(text, add_special_tokens=False).ids

            _ENCODERS[key] = encode
        else:
            _ENCODERS[key] = lambda text: plain.encode(text, add_special_tokens=False).ids
    return _ENCODERS[key]


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document of ``n`` ids; class 1 fills a sequence alone."""
    out, at = [], 0
    while n - at >= capacity:
        out.append((at, capacity, 1))
        at += capacity
    while at < n:
        rest = n - at
        j = capacity // rest
        slot = capacity / j
        head = capacity // (j + 1)
        if rest >= (1 - slack) * slot or head >= rest or j >= capacity // 16:
            out.append((at, rest, j))
            break
        out.append((at, head, capacity // head))
        at += head
    return out


class Packer:
    """Fills bins with pieces (doc_id, start, ids, doc_tokens); keeps at most j - 1 pieces of each class j."""

    def __init__(self, first_id: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        for start, length, j in cuts(len(ids), self.capacity):
            held = self.open.setdefault(j, [])
            held.append((doc_id, start, ids[start : start + length], len(ids)))
            if len(held) == j:
                self.close(held)
                self.open[j] = []

    def finish(self) -> None:
        """Lay what is left end to end; cut at the capacity, at the end at powers of two."""
        left = [p for j in sorted(self.open) for p in self.open[j]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        at, used = 0, 0
        for size in sizes:
            taken, room = [], size
            while room:
                doc_id, start, ids, n = left[at]
                part = ids[used : used + room]
                taken.append((doc_id, start + used, part, n))
                room -= len(part)
                used += len(part)
                if used == len(ids):
                    at, used = at + 1, 0
            self.close(taken)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, vocabulary: str, ranks_file: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document. sequence_id is the worker's partition times 2**40 plus a counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks_file)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "")
                packer.add(doc_id, np.array([*ids, end_id], dtype=np.uint32))
            if rows := packer.take():
                yield batch(ARROW, list(zip(*rows, strict=True)))
        packer.finish()
        if rows := packer.take():
            yield batch(ARROW, list(zip(*rows, strict=True)))

    return arrow_map(doc_table(docs), run, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
