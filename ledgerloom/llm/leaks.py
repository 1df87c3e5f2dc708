"""Test items that leaked into a corpus, whole or in part.

Pigeonhole: a passage of n words may have n/8 wrong ones. Each item is split into consecutive pieces so short that any
passage of it holds its error budget and one more whole pieces, one of which is then unharmed: an exact hit of it in the
document, read without blanks and punctuation, is where to look. Windows of the item with as many hit pieces as their
budget leaves are verified by Myers' bit-parallel distance over words; the passage itself is then decided by its edit
distance between two right words, over all beginnings. Where blanks are lost or put in, the stream without blanks is
segmented into the item's words first.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.chars import folded

LEAST = 15  #: words of a passage
ONE_IN = 8  #: a word in so many may be wrong
#: Words in a piece: n words hold n/8 + 1 whole pieces of an item, wherever they begin.
PIECE = min((n + 1) // (n // ONE_IN + 2) for n in range(LEAST, 40 * ONE_IN))
BLOCK_CHARS = 4_000_000  #: characters of the items searched in one pass: what an automaton takes grows with them

_NOT_ALNUM = re.compile(r"[\W_]+")


def words_of(text: str) -> list[str]:
    """Words of letters and digits, without case, accents, punctuation and look-alikes."""
    return [w for x in folded(text).split() if (w := x if x.isalnum() else _NOT_ALNUM.sub("", x))]


class Item:
    """A test item, its words and, for each word, the bits of the positions that hold it."""

    def __init__(self, item_id: int, text: str):
        self.item_id = item_id
        self.words = words_of(text)
        self.vocabulary = set(self.words)
        self.chars = sum(map(len, self.words))
        self.sizes = sorted({len(w) for w in self.vocabulary})
        n = len(self.words)
        self.piece = PIECE if n >= LEAST else max(1, n // (n // ONE_IN + 1))
        self.starts = range(0, n - self.piece + 1, self.piece)  #: of the pieces
        self._needs: list[tuple[int, int, int, int, int, int]] | None = None

    @property
    def needs(self) -> list[tuple[int, int, int, int, int, int]]:
        """(start, end, errors allowed, first piece, piece after the last, pieces to be hit) of each window."""
        if self._needs is None:
            self._needs, size = [], self.piece
            for a, b, errors in self.windows():
                first, after = -(-a // size), max(-(-a // size), min(len(self.starts), b // size))
                self._needs.append((a, b, errors, first, after, max(1, after - first - errors)))
            self.alone: dict[int, list[tuple[int, int, int]]] = {}  # windows for which one hit piece is enough
            for a, b, errors, first, after, need in self._needs:
                if need == 1:
                    for k in range(first, after):
                        self.alone.setdefault(k, []).append((a, b, errors))
        return self._needs

    def windows(self) -> Iterator[tuple[int, int, int]]:
        """(start, end, errors allowed) of windows one of which lies in any passage within the budget."""
        n = len(self.words)
        sizes = [(LEAST, LEAST // ONE_IN)] + [(ONE_IN * k, k) for k in (2, 3)]
        if n < LEAST:
            sizes = [(n, n // ONE_IN)]
        for size, errors in sizes:
            for start in range(n - size + 1):
                yield start, start + size, errors


def myers(pattern: list[str], text: list[str]) -> int:
    """Least edit distance of the pattern to any stretch of the text, over words, by bit-parallel columns."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for w in text:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best = score
    return best


def aligned(item: list[str], text: list[str]) -> tuple[list[int], list[int]]:
    """For each item word the text position it equals in a best alignment (or -1), and the words put in before it."""
    m, n = len(item), len(text)
    rows = [[0] * (n + 1)]
    for i in range(1, m + 1):
        last, row, w = rows[-1], [i] + [0] * n, item[i - 1]
        for j in range(1, n + 1):
            cost = last[j - 1] + (w != text[j - 1])
            if last[j] + 1 < cost:
                cost = last[j] + 1
            if row[j - 1] + 1 < cost:
                cost = row[j - 1] + 1
            row[j] = cost
        rows.append(row)
    i, j = m, min(range(n + 1), key=lambda j: rows[m][j])
    at, added = [-1] * m, [0] * (m + 1)
    while i:
        here = rows[i][j]
        if j and here == rows[i - 1][j - 1] + (item[i - 1] != text[j - 1]):
            i, j = i - 1, j - 1
            if item[i] == text[j]:
                at[i] = j
        elif here == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
            added[i] += 1
    return at, added


def has_passage(item: list[str], text: list[str]) -> bool:
    """Whether the text has LEAST words of the item in sequence (or all of a shorter one), right at both ends,
    with at most a word in ONE_IN wrong."""
    at, added = aligned(item, text)
    need = min(LEAST, len(item))
    wrong = [0]
    for i, x in enumerate(at):
        wrong.append(wrong[-1] + (x < 0) + added[i])
    right = [i for i, x in enumerate(at) if x >= 0]
    for i in right:
        for j in reversed(right):
            if j - i + 1 < need:
                break
            if (wrong[j + 1] - wrong[i] - added[i]) * ONE_IN <= j - i + 1:
                return True
    return False


def begins_passage(item: list[str], i: int, text: list[str], j: int, need: int) -> bool:
    """Whether a passage begins with item word ``i`` at text word ``j``: edit distances of all stretches from there,
    within the band that the budget leaves, up to one between right words that is long enough and within its budget."""
    most = (len(item) - i) // ONE_IN
    row = {d: d for d in range(most + 1)}  # text words beyond item words -> errors, after the first right word
    for size in range(2, len(item) - i + 1):
        word, new = item[i + size - 1], {}
        for d in range(-most, most + 1):
            at = j + size - 1 + d
            best = row.get(d + 1, most + 1) + 1  # the item word is missing
            if j < at < len(text):
                same = text[at] == word
                best = min(best, row.get(d, most + 1) + (not same), new.get(d - 1, most + 1) + 1)
                if same and size >= need and row.get(d, most + 1) * ONE_IN <= size:
                    return True
            if best <= most:
                new[d] = best
        if not new:
            return False
        row = new
    return need <= 1


def holds_passage(item: list[str], text: list[str]) -> bool:
    """``has_passage`` over all alignments, not a cheapest one: true if any stretch of either is a passage."""
    if has_passage(item, text):
        return True
    need, at = min(LEAST, len(item)), {}
    for j, w in enumerate(text):
        at.setdefault(w, []).append(j)
    return any(begins_passage(item, i, text, j, need) for i in range(len(item) - need + 1) for j in at.get(item[i], ()))


class Finder:
    """Search of a bounded block of items in documents, one automaton for all pieces."""

    def __init__(self, items: Iterable[tuple[int, str]]):
        import ahocorasick

        self.items = [Item(i, t) for i, t in items if t]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for start in item.starts:
                pieces.setdefault("".join(item.words[start : start + item.piece]), []).append((n, start))
        self.pieces = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.pieces.add_word(piece, (len(piece), places))
        if pieces:
            self.pieces.make_automaton()
        self.any = bool(pieces)

    def _words(self, words: list[str], item: Item) -> list[str]:
        """The words with those put together again that blanks or line ends broke, and glued ones taken apart."""
        known, out, i = item.vocabulary, [], 0
        while i < len(words):
            w = words[i]
            if w not in known:
                for more in (2, 3):
                    if i + more <= len(words) and (whole := "".join(words[i : i + more])) in known:
                        out.append(whole)
                        i += more
                        break
                else:
                    cut = next((k for k in range(1, len(w)) if w[:k] in known and w[k:] in known), 0)
                    out.extend((w[:cut], w[cut:]) if cut else (w,))
                    i += 1
            else:
                out.append(w)
                i += 1
        return out

    def _segmented(self, stream: str, edges: set[int], sure: set[tuple[int, int]], lo: int, hi: int, item: Item) -> list[str]:
        """The words of a stretch of the stream, whatever blanks it had: cheapest cover by words of the item, those
        under pieces first, and by strange runs, which blanks (``edges``) cut."""
        best: list[tuple[float, int, bool]] = [(0.0, lo, True)] + [(1e9, lo, True)] * (hi - lo)  # cost, begin of the last word, whether the item has it
        for a in range(lo, hi):
            cost, _, known = best[a - lo]
            strange = cost + 0.3 + (1.0 if known or a in edges else 0.0)
            if strange < best[a + 1 - lo][0]:
                best[a + 1 - lo] = (strange, a, False)
            for size in item.sizes:
                b = a + size
                if b > hi:
                    break
                if stream[a:b] in item.vocabulary:
                    more = 0.0 if (a, b) in sure else 0.02 + ((a not in edges) + (b not in edges)) * (1.0 if size < 4 else 0.1)
                    if cost + more < best[b - lo][0]:
                        best[b - lo] = (cost + more, a, True)
        out: list[str] = []
        run: list[int] = []  # bounds of a strange run, from its end
        mean = max(1.0, item.chars / len(item.words))

        def close() -> None:
            if run:
                cuts = [run[0], *(x for x in range(run[0] - 1, run[-1], -1) if x in edges), run[-1]]
                size = run[0] - run[-1]
                if len(cuts) > 2 and size < 2 * (len(cuts) - 1) or len(cuts) == 2 and size > 4 * mean:  # letters apart, or words without blanks
                    n = max(1, round(size / mean))
                    out.extend([""] * n)
                else:
                    out.extend(stream[x:y] for y, x in zip(cuts, cuts[1:]))
                run.clear()

        b = hi
        while b > lo:
            _, a, known = best[b - lo]
            if known:
                close()
                out.append(stream[a:b])
            else:
                run[:] = [run[0] if run else b, a]
            b = a
        close()
        return out[::-1]

    def find(self, text: str) -> list[int]:
        if not self.any or not text:
            return []
        words = words_of(text)
        stream = "".join(words)
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.pieces.iter(stream):
            for n, start in places:
                hits.setdefault(n, []).append((end - size + 1, start))
        if not hits:
            return []
        ends, total = [], 0
        for w in words:
            total += len(w)
            ends.append(total)
        return sorted(self.items[n].item_id for n, places in hits.items() if self._verified(self.items[n], places, words, ends, stream))

    def _verified(self, item: Item, places: list[tuple[int, int]], words: list[str], ends: list[int], stream: str) -> bool:
        places.sort()
        reach = item.chars + 40
        k = 0
        while k < len(places):
            j = k + 1
            while j < len(places) and places[j][0] - places[j - 1][0] <= reach:
                j += 1
            if self._near(item, places[k:j], words, ends, reach, stream):
                return True
            k = j
        return False

    def _near(self, item: Item, places: list[tuple[int, int]], words: list[str], ends: list[int], reach: int, stream: str) -> bool:
        likely = self._likely(item, places, reach, stream)
        if not likely:
            return False
        lo = bisect_right(ends, max(0, places[0][0] - reach))
        hi = bisect_right(ends, places[-1][0] + reach) + 1
        for start in range(lo, hi, max(1, 6 * len(item.words))):  # long stretches in overlapping parts
            if self._holds(item, self._words(words[start : start + 8 * len(item.words)], item), likely):
                return True
        edges, sure = {0, *ends}, set()
        for at, first in places:
            for w in item.words[first : first + item.piece]:
                sure.add((at, at + len(w)))
                at += len(w)
        first, last = max(0, places[0][0] - reach), min(len(stream), places[-1][0] + 2 * reach)
        for start in range(first, last, 6 * item.chars):
            part = self._segmented(stream, edges, sure, start, min(last, start + 8 * item.chars), item)
            if self._holds(item, part, likely):
                return True
        return False

    @staticmethod
    def _likely(item: Item, places: list[tuple[int, int]], reach: int, stream: str) -> list[tuple[int, int, int]]:
        """The windows of which as many pieces are hit as their budget leaves, and as many words stand near a hit."""
        needs, found = item.needs, {start // item.piece for _, start in places}
        if len(found) == 1:
            windows = item.alone.get(next(iter(found)), [])
        else:
            hit = [0]
            for k in range(len(item.starts)):
                hit.append(hit[-1] + (k in found))
            windows = [(a, b, errors) for a, b, errors, first, after, need in needs if hit[after] - hit[first] >= need]
        if not windows:
            return []
        out = set()
        upto = -1  # where the stretch last looked at ends
        for at, _ in places:
            if at + reach <= upto or len(out) == len(windows):
                continue
            upto = at + 2 * reach
            near, there = stream[max(0, at - reach) : upto], [0]
            for w in item.words:
                there.append(there[-1] + (w in near))
            out.update((a, b, errors) for a, b, errors in windows if there[b] - there[a] >= b - a - errors)
        return sorted(out)

    @staticmethod
    def _holds(item: Item, part: list[str], likely: list[tuple[int, int, int]]) -> bool:
        for a, b, errors in likely:
            if myers(item.words[a:b], part) <= errors:
                return holds_passage(item.words, part)
        return False


_finders: dict[str, Finder] = {}  #: the automaton of a worker, built once for all its tasks


def finder_of(key: str, items: list[tuple[int, str]]) -> Finder:
    if key not in _finders:
        _finders.clear()
        _finders[key] = Finder(items)
    return _finders[key]


def leaked(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id): each document and each item of which it holds a passage, once.

    The test items are read by the driver in blocks of ``BLOCK_CHARS`` characters, one pass over the corpus each, so
    what is sent to the workers and what their automata take is bounded whatever their number. Null and blank texts hold nothing; repeated documents are
    reported for each of their ids; whole texts are searched.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct()
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    out = None
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    for k in range(blocks):
        block = [(r.i, r.t) for r in (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)).collect()]
        held, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterable[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            finder = finder_of(key, held.value)
            for batch in batches:
                found = [(d, i) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in finder.find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["doc_id", "item_id"])

        part = picked.mapInArrow(search, "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.distinct()
