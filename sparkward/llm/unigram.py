"""Unigram tokens over a double-array trie: SentencePiece encoding and decoding, and token counts.

A model file gives pieces with log scores. A text becomes one marker and its
spaces markers (U+2581); no piece has a marker after another character, so the
best path over a text is the best paths of its chunks, each a run of markers
with what follows. A worker builds the trie once and keeps the chunks that it has
solved, in a table of bounded size.

``encode``: Viterbi over the trie, character by character where no piece
fits, such a character then being spelled in byte pieces. Of two paths with
equal scores the one whose last piece starts earlier is taken. ``decode``
joins pieces and bytes, turns markers into spaces and drops the first one.

``count_tokens`` needs lengths only. The distinct new chunks of a batch are
sorted, which walks the trie of all of them depth first: each depth keeps the
best forward score, its token count and the trie states of pieces still open
there, so a prefix that chunks share is scored once, and the count at a chunk's
end is stored.

Defined cases: a null text is empty and has no tokens; a text that holds the
marker itself decodes to a space there (``round_trip`` false); a null doc_id is
kept; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")
#: Entries of a worker's table of solved chunks, and the longest chunk (in characters) that it keeps.
KNOWN, LONGEST = 1 << 19, 48
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
NONE = float("-inf")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            value: object = varint()
        elif tag & 7 == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        elif tag & 7 == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield tag >> 3, value


def read_pieces(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id, from a SentencePiece model file's bytes."""
    out = []
    for field, value in _fields(data):
        if field == 1:
            piece = dict(_fields(value))
            out.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
    return out


def double_array(keys: list[tuple[bytes, int]]) -> tuple[list[int], list[int], list[int]]:
    """base, check and value of a double-array trie; state 0 is the root, and a byte c leads from s to base[s] + c if check says s."""
    keys = sorted(keys)
    base, check, value = [0], [0], [-1]

    def grow(to: int) -> None:
        if to > len(base):
            more = to - len(base)
            base.extend([0] * more)
            check.extend([-1] * more)
            value.extend([-1] * more)

    # a state with one child fills the first hole; the others go up from where the last of them found room
    hole, roomy = 257, 257  # any byte can reach them
    todo = [(0, 0, len(keys), 0)]
    while todo:
        state, low, high, depth = todo.pop()
        groups = []
        at = low
        if len(keys[at][0]) == depth:
            value[state] = keys[at][1]
            at += 1
        while at < high:
            byte, start = keys[at][0][depth], at
            while at < high and keys[at][0][depth] == byte:
                at += 1
            groups.append((byte, start, at))
        if not groups:
            continue
        while hole < len(check) and check[hole] != -1:
            hole += 1
        first = groups[0][0]
        slot = (hole if len(groups) == 1 else max(hole, roomy)) - first
        tries = 0
        while True:
            grow(slot + 256)
            if all(check[slot + b] == -1 for b, _, _ in groups):
                break
            slot += 1
            tries += 1
        if len(groups) > 1 and tries > 16:
            roomy = slot + first
        base[state] = slot
        for byte, start, end in groups:
            check[slot + byte] = state
            todo.append((slot + byte, start, end, depth + 1))
    return base, check, value


class Unigram:
    """A model ready to encode; built once for each worker."""

    def __init__(self, data: bytes):
        pieces = read_pieces(data)
        usable = [(p.encode(), i) for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)]
        self.base, self.check, self.value = double_array(usable)
        self.scores = [s for _, s, _ in pieces]
        self.unknown = min(s for _, s, kind in pieces if kind == NORMAL) - 10
        self.byte_ids = [0] * 256
        self.surface = [p.encode() if kind in (NORMAL, USER) else b"" for p, _, kind in pieces]
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
                self.surface[i] = bytes([int(p[3:5], 16)])
        self.ids_of: dict[str, bytes] = {}
        self.count_of: dict[str, int] = {}

    def path(self, chunk: bytes) -> list[int]:
        """Ids of the best path over one chunk."""
        base, check, value, scores, size = self.base, self.check, self.value, self.scores, len(self.check)
        n = len(chunk)
        best, came = [NONE] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == NONE:
                continue
            lead = chunk[i]
            end = i + (1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            state, single = 0, False
            for j in range(i, n):
                to = base[state] + chunk[j]
                if to >= size or check[to] != state:
                    break
                state = to
                v = value[state]
                if v >= 0:
                    single = single or j + 1 == end
                    if here + scores[v] > best[j + 1]:
                        best[j + 1], came[j + 1] = here + scores[v], (i, v)
            if not single and here + self.unknown > best[end]:
                best[end], came[end] = here + self.unknown, (i, -1)
        out: list[int] = []
        at = n
        while at:
            start, v = came[at]
            if v >= 0:
                out.append(v)
            else:
                out.extend(self.byte_ids[c] for c in reversed(chunk[start:at]))
            at = start
        return out[::-1]

    def chunks(self, text: str) -> list[str]:
        """A text's chunks, each without its first marker."""
        if not text:
            return []
        marked = MARKER + text.replace(" ", MARKER)
        if MARKER + MARKER not in marked:
            return marked.split(MARKER)[1:]
        return [c[1:] for c in CHUNK.findall(marked)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit bytes."""
        known = self.ids_of
        chunks = self.chunks(text)
        for c in set(chunks).difference(known):
            if len(known) >= KNOWN:
                known.clear()
            known[c] = np.asarray(self.path((MARKER + c).encode()), "<u4").tobytes()
        try:
            out = b"".join(map(known.__getitem__, chunks))
        except KeyError:  # the table was emptied on the way
            out = b"".join(known[c] if c in known else np.asarray(self.path((MARKER + c).encode()), "<u4").tobytes() for c in chunks)
        for c in [c for c in set(chunks) if len(c) > LONGEST]:
            known.pop(c, None)
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").replace(MARKER, " ")
        return text[1:] if text.startswith(" ") else text

    def count_sorted(self, chunks: list[bytes]) -> list[int]:
        """Token counts of sorted distinct chunks; a prefix shared with the chunk before is not scored again."""
        base, check, value, scores, size, unknown = self.base, self.check, self.value, self.scores, len(self.check), self.unknown
        best, count, opened, starts = [0.0], [0], [[]], [0]  # by depth; starts: where the character at this depth began
        out: list[int] = []
        last = b""
        for chunk in chunks:
            shared, most = 0, min(len(last), len(chunk))
            while shared < most and last[shared] == chunk[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :], opened[shared + 1 :], starts[shared + 1 :]
            for d in range(shared, len(chunk)):
                byte = chunk[d]
                begins = byte < 0x80 or byte >= 0xC0  # a character begins here
                char = d if begins else starts[d]
                ends = d + 1 == char + (1 if chunk[char] < 0xC0 else 2 if chunk[char] < 0xE0 else 3 if chunk[char] < 0xF0 else 4)
                top, tokens, single = NONE, 0, False
                still = []
                for start, state in opened[d] + [(d, 0)] if begins else opened[d]:
                    to = base[state] + byte
                    if to < size and check[to] == state:
                        still.append((start, to))
                        v = value[to]
                        if v >= 0:
                            single = single or (start == char and ends)
                            if best[start] + scores[v] > top:
                                top, tokens = best[start] + scores[v], count[start] + 1
                if ends and not single and best[char] + unknown > top:
                    top, tokens = best[char] + unknown, count[char] + d + 1 - char
                best.append(top)
                count.append(tokens)
                opened.append(still)
                starts.append(char)
            out.append(count[-1])
            last = chunk
        return out

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, chunks) of each text."""
        known = self.count_of
        cut = [self.chunks(t) for t in texts]
        new = sorted(((MARKER + c).encode(), c) for c in set().union(*cut).difference(known))
        if len(known) + len(new) > 2 * KNOWN:
            known.clear()
            new = sorted(((MARKER + c).encode(), c) for c in set().union(*cut))
        known.update(zip([c for _, c in new], self.count_sorted([b for b, _ in new]), strict=True))
        out = [(sum(map(known.__getitem__, cs)), len(cs)) for cs in cut]
        for _, c in new:
            if len(c) > LONGEST:
                del known[c]
        return out


@cache
def _loaded(path: str) -> Unigram:
    """One model for each Python worker; it serves all of the worker's tasks."""
    with open(path, "rb") as f:
        return Unigram(f.read())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids): every text's piece ids. ``model`` is a file that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(model)
        for b in batches:
            ids = [np.frombuffer(m.encode(t), "<u4").astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoding_report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32, and whether decoding the ids gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(model)
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for text in b.column(1).to_pylist():
                blob = m.encode(text)
                ids = np.frombuffer(blob, "<u4")
                for column, x in zip(rows, (len(ids), int(m.is_byte[ids].sum()), zlib.crc32(blob), m.decode(ids.tolist()) == text), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]], names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and n_pretokens of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(model)
        for b in batches:
            tokens, chunks = zip(*m.count(b.column(1).to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), pa.array(chunks, pa.int64())], names=["doc_id", "n_tokens", "n_pretokens"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long")
