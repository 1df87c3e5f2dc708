"""Token ids of texts by a public byte-level BPE vocabulary.

Merges are taken in order of rank from a queue of buckets, one per rank, under a three-level bitmap:
find-first-set gives the next rank, the bucket its positions in a linked list of symbols, and entries that
an earlier merge made stale are skipped. The work is linear in the merges made, so a pre-token of a million
bytes costs as much a byte as a short one.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split of this vocabulary before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RankQueue:
    """Positions by rank; ``pop`` gives the lowest rank that has any and empties its bucket."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(at)
            return
        self.buckets[rank] = [at]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        if not self.top:
            return None
        i = (self.top & -self.top).bit_length() - 1
        j = i << 6 | (self.mid[i] & -self.mid[i]).bit_length() - 1
        rank = j << 6 | (self.low[j] & -self.low[j]).bit_length() - 1
        self.low[j] &= self.low[j] - 1
        if not self.low[j]:
            self.mid[i] &= self.mid[i] - 1
            if not self.mid[i]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class ByteBpe:
    """Encoder of one vocabulary file (``byte_bpe_50k.json``), with a bounded memory of pieces seen."""

    def __init__(self, path: str, remember: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = [vocab[c] for c in _byte_letters()]
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.split = regex.compile(SPLIT)
        self.uneven = regex.compile(r"^\s|\s$|\s\s|[^\S ]")
        self.seen: dict[str, array] = {}
        self.remember = remember

    def merge(self, data: bytes) -> array:
        """The ids of one pre-token."""
        ids = [self.byte_ids[b] for b in data]
        n = len(ids)
        if n == 1:
            return array("i", ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\x01") * n
        merges, made, queue = self.merges, self.made, RankQueue(len(self.made))
        for i in range(n - 1):
            rank = merges.get(ids[i] << 20 | ids[i + 1])
            if rank is not None:
                queue.push(rank, i)
        while (got := queue.pop()) is not None:
            rank, positions = got
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                j = after[i]
                if not alive[i] or j >= n or merges.get(ids[i] << 20 | ids[j]) != rank:
                    continue  # stale: one of the two symbols has been merged since
                ids[i] = made[rank]
                alive[j] = 0
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = merges.get(ids[i] << 20 | ids[k])
                    if r is not None:
                        queue.push(r, i)
                h = before[i]
                if h >= 0:
                    r = merges.get(ids[h] << 20 | ids[i])
                    if r is not None:
                        queue.push(r, h)
        return array("i", [x for x, on in zip(ids, alive) if on])

    def _pretoken(self, piece: str) -> array:
        ids = self.seen.get(piece)
        if ids is None:
            ids = self.merge(piece.encode("utf-8"))
            self._keep(piece, ids)
        return ids

    def _keep(self, piece: str, ids: array) -> None:
        if len(piece) <= 64:
            if len(self.seen) >= self.remember:
                self.seen.clear()
            self.seen[piece] = ids

    def encode(self, text: str) -> array:
        """The ids of a text; strings that look like special tokens are ordinary text."""
        out = array("i")
        if not text:
            return out
        if self.uneven.search(text):
            for piece in self.split.findall(text):
                out.extend(self._pretoken(piece))
            return out
        seen = self.seen  # single blanks only: each blank begins a pre-token, so words can be looked up whole
        first, *words = text.split(" ")
        for word in (first, *[" " + w for w in words]):
            ids = seen.get(word)
            if ids is None:
                ids = array("i")
                for piece in self.split.findall(word):
                    ids.extend(self._pretoken(piece))
                self._keep(word, ids)
            out.extend(ids)
        return out


_encoders: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """The encoder of this Python worker for the vocabulary at ``path``."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def token_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): every text as token ids, whatever its length; null and empty texts give an empty list.

    No shuffle and no row leaves its partition; repeated rows and ids stay; other columns are not read.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in batch.column(1):
                flat.extend(bpe.encode(text.as_py() or ""))
                ends.append(len(flat))
            values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
            offsets = pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=[id_col, "ids"])

    picked = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string"))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")
