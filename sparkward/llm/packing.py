"""Best-fit packing by bin completion.

Texts are tokenized once, in Arrow batches, and cut into pieces. What is left
to pack then depends on the piece lengths alone, and lengths are integers of at
most the capacity: a histogram of at most 2048 counters is the whole instance,
at any corpus size. ``bins.solve`` packs it by branch and bound.
Pieces of one length are interchangeable, so the solution is a short table of
(length, range of ranks) -> (sequence, offset); it is broadcast, and its size is bounded
by the number of lengths. Ranks come from a range partitioning, so
a length that a third of all pieces share is spread over many tasks.

Defined cases: a null text is empty and packs its closing id alone; rows with
a null doc_id are packed like others; repeated rows are packed each; other
columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import numbered, written
from .bins import NODES, Plan, solve

CAPACITY = 2048
#: Entries of each of the two generations of a worker's known chunks (together about 80 MB), and the longest chunk kept.
KNOWN, LONGEST = 1 << 17, 48
#: Marks that end a word, and the first letter whose lower case is left to the tokenizer (U+0250).
MARKS, PLAIN = ".,;:!?", "\u0250"
#: Byte-level models spell bytes that print as themselves, and the others, in order, from U+0100 on.
SPELT = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class ChunkIds(dict):
    """Chunk of text without spaces -> its ids as little-endian bytes, found by the tokenizer once.

    The tokenizer cuts at white space before it merges, so a text's ids are
    those of its chunks in a row. It also lowers letters and cuts between a
    letter or digit and a mark, so that "Word," needs only "word" and ",", and a
    lower-case word of plain letters goes to the tokenizer's model as it is, its bytes spelt as the model's letters.
    The table is two generations of bounded size, the older of which is dropped when the younger is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self._older: dict[str, bytes] = {}
        self._tokenizer = Tokenizer.from_file(path)
        self._encode, self._model = self._tokenizer.encode, self._tokenizer.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        ids = self._older.get(chunk)
        if ids is not None:
            pass
        elif len(chunk) > 1 and chunk[-1] in MARKS and chunk[-2].lower().isalnum() and chunk[-2] < PLAIN:  # a dotted capital I ends in a mark when lowered
            ids = self[chunk[:-1]] + self[chunk[-1]]
        elif chunk.isalpha() and max(chunk) < PLAIN:
            low = chunk.lower()
            ids = self[low] if low != chunk else array("I", [t.id for t in self._model(chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(SPELT))]).tobytes()
        else:
            ids = np.asarray(self._encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= LONGEST:
            if len(self) >= KNOWN:  # what is in use comes back from the older generation
                self._older = dict(self)
                self.clear()
                self[""] = b""
            self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def known_ids(path: str) -> ChunkIds:
    """One table for each Python worker; it serves all of the worker's tasks."""
    return ChunkIds(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and the closing id, cut at the capacity."""
    end = int(closing).to_bytes(4, "little")
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = known_ids(tokenizer)
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blob = ids.text(text or "") + end
                for k, at in enumerate(range(0, len(blob), step)):
                    part = blob[at : at + step]
                    for column, value in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _places(plan: Plan) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, pieces in each sequence, offset of the first), by rank."""
    next_rank: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for times, fill in plan:
        offset = 0
        for s, k in fill:
            rank = next_rank.get(s, 0)
            rows.setdefault(s, []).append((rank, sequence, k, offset))
            next_rank[s] = rank + times * k
            offset += s * k
        sequence += times
    return {s: np.array(r, np.int64) for s, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int = 0, nodes: int = NODES) -> DataFrame:
    """The pieces of all texts with their sequence_id and offset."""
    spark = docs.sparkSession
    ranked, totals = numbered(written(pieces(docs, tokenizer, capacity, closing)), ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    places = spark.sparkContext.broadcast(_places(solve(dict(totals), capacity, nodes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                rows = table[int(s)]
                hit = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                turn = rank[at] - hit[:, 0]
                sequence[at] = hit[:, 1] + turn // hit[:, 2]
                offset[at] = hit[:, 3] + turn % hit[:, 2] * s
            kept = b.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


