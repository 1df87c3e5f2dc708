"""Operators on word boxes: reading order, rows, cells, labels, windows of words and values found in them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.amounts import normalized
from ledgerloom.session import cut


def dense_tags(words: DataFrame, doc: Sequence[str], order: str, text: str = "text", out: str = "tag") -> DataFrame:
    """Words with text, numbered densely from 0 in reading order of each document."""
    kept = words.where(F.trim(text) != "")
    return kept.withColumn(out, F.row_number().over(W.partitionBy(*doc).orderBy(order)) - 1)


def tagged_text(tagged: DataFrame, doc: Sequence[str], tag: str = "tag", text: str = "text", out: str = "tagged") -> DataFrame:
    """``[T0] word [T1] word`` of each document."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(tag).alias("t"), F.trim(text).alias("w"))))
    return tagged.groupBy(*doc).agg(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("[T"), p["t"].cast("string"), F.lit("] "), p["w"])), " ").alias(out))


def without_tags(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, "\\[T\\d+\\] ?", ""))


def gap_rows(words: DataFrame, page: Sequence[str], *, top: str = "top", bottom: str = "bottom", order: str = "x0", gap: float = 3.0, out: str = "row_no") -> DataFrame:
    """Rows of a page by gaps: a word whose middle is ``gap`` or more below the one before begins a row."""
    mid = (F.col(top) + F.col(bottom)) / 2
    w = W.partitionBy(*page).orderBy("_mid", order)
    marked = words.withColumn("_mid", mid).withColumn("_new", F.coalesce((F.col("_mid") - F.lag("_mid").over(w) >= gap).cast("int"), F.lit(1)))
    return marked.withColumn(out, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_mid", "_new")


def nearest_rows(words: DataFrame, page: Sequence[str], *, key: str, top: str = "top", bottom: str = "bottom", gap: float = 3.0, overlap: float = 0.6, out: str = "row_no") -> DataFrame:
    """Rows of a page by running means: a word joins the nearest row whose mean middle is closer than ``gap``, or
    with which it shares ``overlap`` of the lower height, each middle inside the other's box; else it begins one.

    The means move with every word, so words are taken in order of ``top`` one page after the other; a row above all
    words to come is not looked at again, so the work grows with the words of a page and not with their square.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([top, key], kind="stable")
        rows: list[list[float]] = []  # mean top, mean bottom, mean middle, words
        numbers, open_rows = [], []
        for a, b in zip(pdf[top].tolist(), pdf[bottom].tolist()):
            mid, best, near = (a + b) / 2, -1, float("inf")
            open_rows = [i for i in open_rows if rows[i][1] >= a or rows[i][2] > a - gap]
            for i in open_rows:
                ra, rb, rm, _ = rows[i]
                shared = min(b, rb) - max(a, ra)
                inside = shared >= overlap * min(b - a, rb - ra) and ra <= mid <= rb and a <= rm <= b
                if (abs(mid - rm) < gap or inside) and abs(mid - rm) < near:
                    best, near = i, abs(mid - rm)
            if best < 0:
                rows.append([a, b, mid, 1])
                open_rows.append(len(rows) - 1)
                numbers.append(len(rows) - 1)
                continue
            row = rows[best]
            n = row[3]
            row[:] = [(row[0] * n + a) / (n + 1), (row[1] * n + b) / (n + 1), (row[2] * n + mid) / (n + 1), n + 1]
            numbers.append(best)
        rank = {i: r + 1 for r, i in enumerate(sorted(range(len(rows)), key=lambda i: rows[i][2]))}
        return pdf.assign(**{out: [rank[i] for i in numbers]})

    return words.groupBy(*page).applyInPandas(assign, f"{schema}, `{out}` int")


def cells(rows: DataFrame, row: Sequence[str], *, x0: str = "x0", x1: str = "x1", text: str = "text", key: str = "word_id", gap: float = 12.0) -> DataFrame:
    """One line a cell: words of a row belong together where the blank between them is at most ``gap`` wide."""
    w = W.partitionBy(*row).orderBy(x0, key)
    opened = rows.withColumn("_new", F.coalesce((F.col(x0) - F.lag(x1).over(w) > gap).cast("int"), F.lit(1)))
    numbered = opened.withColumn("cell_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    parts = F.sort_array(F.collect_list(F.struct(F.col(x0).alias("x"), F.col(key).alias("k"), F.col(text).alias("t"))))
    return numbered.groupBy(*row, "cell_no").agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("cell"), F.min(x0).alias("cell_x0"), F.max(x1).alias("cell_x1")
    )


def row_texts(cell_rows: DataFrame, row: Sequence[str]) -> DataFrame:
    """The cells of each row, joined by bars."""
    parts = F.sort_array(F.collect_list(F.struct("cell_no", "cell")))
    return cell_rows.groupBy(*row).agg(F.array_join(F.transform(parts, lambda p: p["cell"]), " | ").alias("row_text"), F.count("*").alias("cells"))


def without_margin(rows: DataFrame, row: Sequence[str], *, width: float, share: float = 0.06, letters: int = 3, x0: str = "x0", text: str = "text") -> DataFrame:
    """Without rows that hold nothing but short words in the left margin."""
    margin = (F.length(F.trim(text)) <= letters) & (F.col(x0) < width * share)
    return rows.withColumn("_only", F.min(margin.cast("int")).over(W.partitionBy(*row))).where("_only = 0").drop("_only")


def windows(words: DataFrame, doc: Sequence[str], order: str, *, most: int, text: str = "text") -> DataFrame:
    """(doc, start, size, window): every run of up to ``most`` consecutive words of a document.

    Built with window functions over (doc, order), so a document is never collected into one value.
    """
    w = W.partitionBy(*doc).orderBy(order)
    wide = words.select(*doc, F.col(order).alias("start"), F.col(text).alias("_w0"), *[F.lead(text, i).over(w).alias(f"_w{i}") for i in range(1, most)])
    names = [f"_w{i}" for i in range(most)]
    runs = F.array(*[F.struct(F.lit(n).alias("size"), F.when(F.col(names[n - 1]).isNotNull(), F.concat_ws(" ", *names[:n])).alias("window")) for n in range(1, most + 1)])
    return wide.select(*doc, "start", F.inline(runs)).where("window is not null")


def located(values: DataFrame, words: DataFrame, doc: str, order: str, *, value: str, text: str = "text", most: int = 3) -> DataFrame:
    """The first smallest window of words equal to each value after normalisation.

    An equi-join on (document, normalised text): no window meets a value it does not equal, and windows no value asks
    for are dropped before they are grouped.
    """
    spans = windows(words, [doc], order, most=most, text=text).withColumn("_key", normalized(F.col("window"))).where("_key <> ''")
    asked = values.withColumn("_key", normalized(F.col(value))).where("_key <> ''")
    best = spans.join(asked.select(doc, "_key").distinct(), [doc, "_key"], "left_semi").groupBy(doc, "_key").agg(F.min(F.struct("size", "start", "window")).alias("hit"))
    return asked.join(best, [doc, "_key"], "left").select(*values.columns, F.col("hit.start").alias("at"), F.col("hit.size").alias("size"), F.col("hit.window").alias("window"))


WINDOW_BLOCK = 4096  #: words of a reading that are searched at once
FEW_VALUES = 64  #: up to so many values of a document are looked for one by one


class _Document:
    """The values asked of one document and the best places found so far, while its words pass by."""

    def __init__(self, most: int):
        self.most = most
        self.begins: dict[str, list[str]] = {}  # values by their first six characters, shorter ones by three at most
        self.values: dict[str, None] = {}
        self.grams: dict[str, list[str]] | None = None  # values by any three characters of theirs
        self.words: list[str] = []
        self.starts: list = []
        self.forward: dict[str, tuple] = {}  # size, start: the least counts, no start last
        self.backward: dict[str, tuple] = {}  # letters, start negated: the greatest counts, no start last

    def ask(self, values: list[str]) -> None:
        for v in values:
            if v and v not in self.values:
                self.values[v] = None
                self.begins.setdefault(v[:6] if len(v) >= 6 else v[:3], []).append(v)

    def read(self, words: list[str], starts: list) -> None:
        if self.values:
            self.words += words
            self.starts += starts
            if len(self.words) >= WINDOW_BLOCK + self.most - 1:
                self._search(len(self.words) - self.most + 1)

    def end_reading(self) -> None:
        if self.words:
            self._search(len(self.words))

    def place(self, value: str) -> tuple:
        """found, start, size"""
        hit, back = self.forward.get(value), self.backward.get(value)
        behind = -back[2] if back and not back[1] else None
        if hit:
            return "forward", behind if hit[1] else hit[2], hit[0]
        return ("backward", behind, 1) if back else ("none", None, None)

    def _search(self, n: int) -> None:
        """Windows that begin in the first ``n`` words held; those words are dropped."""
        words, starts = self.words, self.starts
        text, ends = "".join(words), list(accumulate(map(len, words)))
        asked = self.values
        if len(asked) > FEW_VALUES:  # those that share their beginning with the text
            here = {text[i : i + k] for k in (1, 2, 3, 6) for i in range(len(text) - k + 1)}
            asked = [v for g in self.begins.keys() & here for v in self.begins[g]]
        for v in asked:
            at = text.find(v)
            while at >= 0 and (i := bisect_right(ends, at)) < n:
                size = bisect_left(ends, at + len(v), i) - i + 1
                if size <= self.most:
                    place = (size, starts[i] is None, starts[i])
                    if v not in self.forward or place < self.forward[v]:
                        self.forward[v] = place
                    if size == 1:
                        break
                at = text.find(v, ends[i])  # only the first place in a word counts
        if self.grams is None:
            self.grams = {}
            for v in self.values:
                for g in {v[i : i + 3] for i in range(len(v) - 2)}:
                    self.grams.setdefault(g, []).append(v)
        first: dict[str, tuple] = {}
        for w, s in zip(words[:n], starts[:n]):
            if w[:3] in self.grams and (w not in first or s is None):
                first[w] = (len(w), s is None, None if s is None else -s)
        for w, place in first.items():
            for v in self.grams[w[:3]]:
                if len(w) * 2 >= len(v) and (v not in self.backward or place > self.backward[v]) and w in v:
                    self.backward[v] = place
        del words[:n], starts[:n]


_ASKED, _READ, _ANSWERED = 0, 1, 2  #: rows of a document in this order: its values, its words, its rows of values


def _places(most: int):
    """Of rows sorted by document, kind, reading and order the rows of values with found, start and size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, before = _Document(most), None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, kinds, readings, starts, texts, rows = batch.columns
            kinds = kinds.to_numpy(zero_copy_only=False)
            new_name, new_reading = (np.append(True, np.diff(pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)) != 0) for c in (names, readings))
            if before is not None:
                new_name[0], new_reading[0] = not names[0].equals(before[0]), not readings[0].equals(before[1])
            new_kind = np.append(True, np.diff(kinds) != 0)
            cuts = [*np.flatnonzero(new_name | new_reading | new_kind | (np.arange(len(kinds)) == 0)).tolist(), len(kinds)]
            orders, words, out = starts.to_pylist(), texts.to_pylist(), []
            for a, b in zip(cuts, cuts[1:]):
                if new_name[a]:
                    seen = _Document(most)
                elif new_reading[a] or kinds[a] != _READ:
                    seen.end_reading()
                if kinds[a] == _ASKED:
                    seen.ask(words[a:b])
                elif kinds[a] == _READ:
                    seen.read(words[a:b], orders[a:b])
                else:
                    out += map(seen.place, words[a:b])
            before = names[-1], readings[-1]
            if out:
                found, at, size = zip(*out)
                answered = rows.filter(pa.array(kinds == _ANSWERED))
                yield pa.RecordBatch.from_arrays([answered, pa.array(found, pa.string()), pa.array(at, starts.type), pa.array(size, pa.int32())], names=["_row", "found", "start", "size"])

    return run


def value_windows(values: DataFrame, words: DataFrame, doc: str, reading: str, order: str, *, value: str, text: str = "text", most: int = 12) -> DataFrame:
    """Each value with the smallest window of up to ``most`` words of its document that contains it after
    normalisation, else the longest word of three letters and more, at least half as long, that stands in it; found is
    forward, backward or none.

    Words and values travel once, to the task of their document, which reads them in order: first the values, then the
    words of each reading in blocks of ``WINDOW_BLOCK``, then the rows to answer. A window meets a value if the value
    begins in its first word and ends in its last: the window that cannot lose a word at either side. Of words with the
    same ``order`` in a reading the smaller text comes first. Memory is that of the distinct values of one document.
    """
    row, kind = F.struct(*values.columns), lambda k: F.lit(k).cast("byte")
    reading_type, order_type = words.schema[reading].dataType, words.schema[order].dataType
    row_type = values.select(row.alias("r")).schema["r"].dataType
    named = values.where(F.col(doc).isNotNull()).select(F.col(doc).alias("_doc"), normalized(F.col(value)).alias("_text"), row.alias("_row"))
    asked = named.withColumn("_kind", F.explode(F.when(F.col("_text") == "", F.array(kind(_ANSWERED))).otherwise(F.array(kind(_ASKED), kind(_ANSWERED)))))
    asked = asked.select("_doc", "_kind", F.lit(None).cast(reading_type).alias("_reading"), F.lit(None).cast(order_type).alias("_order"), "_text", F.when(F.col("_kind") == _ANSWERED, F.col("_row")).alias("_row"))
    read = words.where(F.col(doc).isNotNull()).select(F.col(doc).alias("_doc"), kind(_READ).alias("_kind"), F.col(reading).alias("_reading"), F.col(order).alias("_order"), normalized(F.col(text)).alias("_text"), F.lit(None).cast(row_type).alias("_row"))
    rows = asked.unionByName(read.where("_text <> ''")).repartition("_doc").sortWithinPartitions("_doc", "_kind", "_reading", F.asc_nulls_last("_order"), "_text")
    schema = T.StructType([T.StructField("_row", row_type), T.StructField("found", T.StringType()), T.StructField("start", order_type), T.StructField("size", T.IntegerType())])
    answered = rows.mapInArrow(_places(most), schema).select("_row.*", "found", "start", "size")
    nowhere = values.where(F.col(doc).isNull())
    return answered.unionByName(nowhere.select("*", F.lit("none").alias("found"), F.lit(None).cast(order_type).alias("start"), F.lit(None).cast("int").alias("size")))


def holds(snippet: Column, value: Column) -> Column:
    """forward where the value stands in the snippet, backward where a long enough snippet stands in the value."""
    s, v = normalized(snippet), normalized(value)
    long_enough = F.length(s) >= F.greatest(F.lit(3), (F.length(v) / 2).cast("int"))
    return F.when((s == "") | (v == ""), "none").when(s.contains(v), "forward").when(v.contains(s) & long_enough, "backward").otherwise("none")


def thousands_joined(words: DataFrame, doc: Sequence[str], order: str, *, rise: float = 3.0, most_gap: float = 30.0, kerning: float = 5.0) -> DataFrame:
    """Pairs of words of a row that are one amount printed with a blank: ``24`` + ``652.55``."""
    w = W.partitionBy(*doc).orderBy(order)
    pairs = words.select(
        *doc,
        F.col(order).alias("at"),
        F.lag("text").over(w).alias("head"),
        F.col("text").alias("tail"),
        (F.col("x0") - F.lag("x1").over(w)).alias("gap"),
        F.abs(F.col("top") - F.lag("top").over(w)).alias("lift"),
    )
    full = F.col("tail").rlike("^\\d{3}(\\.\\d{2})?$")
    broken = F.col("tail").rlike("^\\d{1,2}\\.\\d{1,2}$")
    near = (F.col("lift") <= rise) & F.col("gap").between(0, most_gap) & (full | (broken & (F.col("gap") <= kerning)))
    return pairs.where(F.col("head").rlike("^(0|[1-9]\\d{0,2})$") & near).select(*doc, "at", F.concat("head", "tail").alias("joined"))


def neighbours(labels: DataFrame, values: DataFrame, page: Sequence[str], *, row: float = 5.0, below: float = 30.0, overlap: float = 0.3) -> DataFrame:
    """Values that stand to the right of a label in its row, or below it under at least ``overlap`` of the narrower one.

    Boxes are joined by page and by bands of height ``below``, so only boxes close to each other meet.
    """
    band = lambda c: F.floor(F.col(c) / below).cast("int")
    a = labels.select(*page, F.col("label"), *[F.col(c).alias(f"l_{c}") for c in ("x0", "x1", "top")]).withColumn("band", F.explode(F.array(band("l_top") - 1, band("l_top"), band("l_top") + 1)))
    b = values.select(*page, F.col("value"), *[F.col(c).alias(f"v_{c}") for c in ("x0", "x1", "top")]).withColumn("band", band("v_top"))
    j = a.join(b, [*page, "band"])
    shared = F.least("l_x1", "v_x1") - F.greatest("l_x0", "v_x0")
    narrow = F.least(F.col("l_x1") - F.col("l_x0"), F.col("v_x1") - F.col("v_x0"))
    beside = (F.abs(F.col("l_top") - F.col("v_top")) <= row) & (F.col("l_x1") <= F.col("v_x0") + 5)
    under = ((F.col("v_top") - F.col("l_top")) > 0) & ((F.col("v_top") - F.col("l_top")) <= below) & (shared >= narrow * overlap)
    where = F.when(beside, "beside").when(under, "below")
    return j.withColumn("where", where).where("where is not null").drop("band")


def nearest_value(pairs: DataFrame, key: Sequence[str], prior: Column | None = None) -> DataFrame:
    """Of the neighbours of each label the one with the least (prior, vertical distance, horizontal distance)."""
    rank = F.struct((prior if prior is not None else F.lit(0)).alias("p"), F.abs(F.col("v_top") - F.col("l_top")).alias("dy"), F.abs(F.col("v_x0") - F.col("l_x0")).alias("dx"), F.col("value").alias("v"))
    return pairs.groupBy(*key).agg(F.min(rank).alias("best")).select(*key, F.col("best.v").alias("value"), F.col("best.dy").alias("dy"), F.col("best.dx").alias("dx"))


def label_left(words: DataFrame, row: Sequence[str], is_amount: Column, *, order: str = "x0", text: str = "text", key: str = "word_id") -> DataFrame:
    """Each amount of a row with the words to its left, back to the amount before."""
    w = W.partitionBy(*row).orderBy(order, key)
    grouped = words.withColumn("_amount", is_amount).withColumn("_group", F.coalesce(F.sum(F.col("_amount").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    parts = F.sort_array(F.collect_list(F.when(~F.col("_amount"), F.struct(F.col(order).alias("x"), F.col(key).alias("k"), F.col(text).alias("t")))))
    out = grouped.groupBy(*row, "_group").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("label"), F.max(F.when(F.col("_amount"), F.col(text))).alias("amount"))
    return out.where("amount is not null").drop("_group")


def ranked_amounts(amounts: DataFrame, doc: Sequence[str], *, value: str, top: str, most: int = 2) -> DataFrame:
    """The largest amounts of each document, of equal ones the lowest on the page."""
    distinct = amounts.groupBy(*doc, value).agg(F.max(top).alias(top))
    rank = F.dense_rank().over(W.partitionBy(*doc).orderBy(F.desc(value)))
    return distinct.withColumn("rank", rank).where(F.col("rank") <= most)


def sections(rows: DataFrame, doc: Sequence[str], order: Sequence[str], is_header: Column, out: str = "section") -> DataFrame:
    """Rows numbered by section: every header begins one, rows before the first belong to section 0."""
    w = W.partitionBy(*doc).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(is_header.cast("int")).over(w).cast("int"))


def single_value(rows: DataFrame, key: Sequence[str], value: str, as_of: str) -> DataFrame:
    """One value a key: the only one; else the newest if every distinct value has its own date; else a contradiction."""
    pairs = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.max(as_of).alias("d"))
    agg = pairs.groupBy(*key).agg(
        F.count("*").alias("n"), F.countDistinct("d").alias("dates"), F.max_by(value, "d").alias("newest"), F.min(value).alias("one"), F.array_join(F.array_sort(F.collect_list(value)), " / ").alias("all")
    )
    out = F.when(F.col("n") == 1, F.col("one")).when(F.col("dates") == F.col("n"), F.col("newest")).otherwise(F.col("all"))
    state = F.when(F.col("n") == 1, "single").when(F.col("dates") == F.col("n"), "newest").otherwise("contradiction")
    return agg.select(*key, out.alias("value"), state.alias("state"), "n")


def merged_objects(rows: DataFrame, key: Sequence[str], attribute: str, value: str, source: str) -> DataFrame:
    """One line an observed value of an attribute of a key: in how many sources it is, the first of them, and how many
    values the attribute has. Long, not nested: an object that most documents speak of is many rows."""
    seen = rows.groupBy(*key, attribute, value, source).agg(F.count("*").alias("_c"))
    values = seen.groupBy(*key, attribute, value).agg(F.count("*").alias("sources"), F.min(source).alias("first_source"))
    n = values.groupBy(*key, attribute).agg(F.count("*").alias("values"))
    return values.join(n, [*key, attribute])


def better_lines(left: DataFrame, right: DataFrame, page: Sequence[str], *, score: Column, close: float = 5.0) -> DataFrame:
    """Two readings of a page merged: of two lines closer than ``close`` the one with the higher score, and every
    line that only one reading has."""
    band = F.floor(F.col("y") / close).cast("int")
    a = left.withColumn("s", score).select(*page, F.col("y").alias("ya"), F.col("line").alias("la"), F.col("s").alias("sa")).withColumn("band", F.explode(F.array(F.floor(F.col("ya") / close).cast("int") - 1, F.floor(F.col("ya") / close).cast("int"), F.floor(F.col("ya") / close).cast("int") + 1)))
    b = right.withColumn("s", score).withColumn("band", band).select(*page, "band", F.col("y").alias("yb"), F.col("line").alias("lb"), F.col("s").alias("sb"))
    pairs = a.join(b, [*page, "band"]).where(F.abs(F.col("ya") - F.col("yb")) < close)
    nearest = pairs.groupBy(*page, "ya", "la", "sa").agg(F.min(F.struct(F.abs(F.col("ya") - F.col("yb")).alias("d"), "yb", "lb", "sb")).alias("m"))
    both = nearest.select(*page, F.col("ya").alias("y"), F.when(F.col("sa") >= F.col("m.sb"), F.col("la")).otherwise(F.col("m.lb")).alias("line"), F.col("m.yb").alias("used"))
    only_a = left.join(nearest.select(*page, F.col("ya").alias("y"), F.col("la").alias("line")), [*page, "y", "line"], "left_anti").select(*page, "y", "line")
    only_b = right.join(both.select(*page, F.col("used").alias("y")), [*page, "y"], "left_anti").select(*page, "y", "line")
    return both.drop("used").unionByName(only_a).unionByName(only_b)


def merged_readings(lines: DataFrame, page: Sequence[str], reading: str, *, score: Column, close: float = 5.0) -> DataFrame:
    """All readings of each page merged one after the other, in the order of ``reading``."""
    rank = F.dense_rank().over(W.partitionBy(*page).orderBy(reading))
    each = lines.select(*page, reading).distinct().withColumn("_n", rank)
    ranked = lines.join(each, [*page, reading]).select(*page, "y", "line", "_n")
    merged = ranked.where("_n = 1").drop("_n")
    for n in range(2, (each.agg(F.max("_n")).first()[0] or 1) + 1):
        merged = cut(better_lines(merged, ranked.where(F.col("_n") == n).drop("_n"), page, score=score, close=close))
    return merged


def readability(line: Column) -> Column:
    """The share of letters and digits in a line, weighed by the number of words of three letters and more."""
    letters = F.length(F.regexp_replace(line, "[^\\p{L}\\p{N}]", ""))
    words = F.size(F.filter(F.split(line, " "), lambda w: w.rlike("^\\p{L}{3,}$")))
    return letters / F.greatest(F.length(line), F.lit(1)) + words * 0.1




def label_spans(words: DataFrame, doc: Sequence[str], order: str, labels: DataFrame, label: str, most: int = 4, rise: float = 5.0) -> DataFrame:
    """Where labels stand: in one word, or in up to ``most`` consecutive words whose tops differ by ``rise`` at most."""
    w = W.partitionBy(*doc).orderBy(order)
    tops = words.select(*doc, F.col(order).alias("start"), *[F.lead("top", i).over(w).alias(f"_t{i}") if i else F.col("top").alias("_t0") for i in range(most)])
    level = F.array(*[F.col(f"_t{i}") for i in range(most)])
    runs = windows(words, doc, order, most=most).join(tops.select(*doc, "start", level.alias("_tops")), [*doc, "start"])
    near = F.slice("_tops", F.lit(1), F.col("size"))
    flat = runs.where(F.array_max(near) - F.array_min(near) <= rise).withColumn("_key", normalized(F.col("window")))
    asked = labels.select(label, normalized(F.col(label)).alias("_key")).distinct()
    return flat.join(asked, "_key").select(*doc, "start", "size", label)


def below_header(cell_rows: DataFrame, page: Sequence[str], header: Column, total: Column, value: Column, *, rows_below: int = 7, slack: float = 25.0) -> DataFrame:
    """Values in a total row up to ``rows_below`` rows under a header cell, in the cell that spans the header's middle.

    Header cells are listed under each row number they may serve, so the join is an equi-join on (page, row).
    """
    mid = (F.col("cell_x0") + F.col("cell_x1")) / 2
    heads = cell_rows.where(header).select(*page, F.explode(F.sequence(F.col("row_no") + 1, F.col("row_no") + rows_below)).alias("row_no"), F.col("row_no").alias("_h"), F.col("cell").alias("header"), mid.alias("_m"))
    totals = cell_rows.where(total).select(*page, "row_no").distinct()
    cells_of = cell_rows.join(totals, [*page, "row_no"], "left_semi").where(value)
    hit = cells_of.join(heads, [*page, "row_no"]).where(F.col("_m").between(F.col("cell_x0") - slack, F.col("cell_x1") + slack))
    first = hit.groupBy(*page, "_h", "header").agg(F.min(F.struct("row_no", F.abs(mid - F.col("_m")).alias("d"), F.col("cell").alias("v"))).alias("b"))
    return first.select(*page, F.col("_h").alias("header_row"), "header", F.col("b.row_no").alias("row_no"), F.col("b.v").alias("value"))


def sums_up_to(amounts: DataFrame, doc: Sequence[str], order: Sequence[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """Amounts that are the sum of all amounts before them in their document."""
    before = F.sum(value).over(W.partitionBy(*doc).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return amounts.withColumn("before", before).where(F.abs(F.col("before") - F.col(value)) <= tolerance)


def span_minimum(tokens: DataFrame, spans: DataFrame, doc: str, order: str, text: str, score: str, width: int = 64) -> DataFrame:
    """The least score of the tokens under each span of characters.

    Token offsets are running sums of lengths; tokens and spans meet by bands of ``width`` characters.
    """
    w = W.partitionBy(doc).orderBy(order)
    ends = F.sum(F.length(text)).over(w.rowsBetween(W.unboundedPreceding, 0))
    placed = tokens.select(doc, F.col(score).alias("_s"), (ends - F.length(text)).alias("_a"), ends.alias("_e")).where("_e > _a")
    t = placed.withColumn("_band", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor((F.col("_e") - 1) / width))))
    s = spans.withColumn("_band", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    hit = s.join(t, [doc, "_band"]).where("_a < end and _e > start")
    keys = [c for c in spans.columns]
    return hit.groupBy(*keys).agg(F.min("_s").alias("least"), F.countDistinct("_a").alias("tokens"))
