"""One consistent form for text that looks the same but is written with different characters.

Invisible characters, exotic blanks, apostrophes, hyphens, full-width and mathematical forms, ligatures and
decomposed letters have one plain form each. Letters of another script are script-aware: the dominant script of a
token is that of its letters that look like no letter of another one; where it has none, that of the text decides. In
a token that mixes scripts the others' look-alikes are substituted, if the corpus has the resulting word in its clean
texts. A token in one script is left alone, unless it is made of look-alikes only and stands with digits or in a text
of the other script; one without any such context is left alone if a text of its own script has the word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.chars import APOSTROPHES, BLANKS, INVISIBLE, LOOKALIKES, appended, free_name
from ledgerloom.session import cut

#: A character that may have to change; ordinary letters and signs with a look of their own are outside.
SUSPICIOUS = (
    "[^\\x20-\\x7E\\u00A1-\\u00AC\\u00AE-\\u017F\\u0180-\\u024F\\u2012-\\u2015\\u201A\\u201C-\\u201F\\u2020-\\u2026"
    "\\u2030\\u2039\\u203A\\u2044\\u2070-\\u209C\\u20A0-\\u20BF\\u2116\\u2122\\u2150-\\u215F\\u2190-\\u22FF\\u2460-\\u27BF]"
)

_BACK: dict[tuple[str, str], str] = {}  #: (script, Latin letter) -> its look-alike
for _other, _plain_letter in LOOKALIKES.items():
    _BACK.setdefault((unicodedata.name(_other).split(" ")[0], _plain_letter), _other)
_LATIN_LOOKS = {letter for _, letter in _BACK}
SALTS = 32  #: parts into which rows of one text are spread

_QUOTED = re.compile("(?:(?<=^)|(?<=[\\s(«]))‘[^‘’]*’(?=$|[\\s).,;:!?»])")
_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(None)
def _plain(c: str) -> str:
    """The plain form of one character."""
    n = ord(c)
    if c in INVISIBLE_SET:
        return ""
    if c in BLANK_SET or c in "\t\r\n\v\f":
        return " "
    if c in APOSTROPHE_SET:
        return "'"
    if c in "‐‑﹣－˗":
        return "-"
    if 0xFF01 <= n <= 0xFFEE or 0x1D400 <= n <= 0x1D7FF or 0xFB00 <= n <= 0xFB06 or 0x2160 <= n <= 0x217F:
        return "".join(_plain(x) if x != c else x for x in unicodedata.normalize("NFKC", c))
    if 0x2100 <= n <= 0x214F and len(k := unicodedata.normalize("NFKC", c)) == 1 and k.isalpha():
        return k
    return c


def _expand(chars: str) -> set[str]:
    """The characters of a class with ranges."""
    out, i = set(), 0
    while i < len(chars):
        if i + 2 < len(chars) and chars[i + 1] == "-":
            out |= {chr(n) for n in range(ord(chars[i]), ord(chars[i + 2]) + 1)}
            i += 3
        else:
            out.add(chars[i])
            i += 1
    return out


INVISIBLE_SET, BLANK_SET, APOSTROPHE_SET = _expand(INVISIBLE), _expand(BLANKS) - {" "}, _expand(APOSTROPHES)


def plain_form(text: str) -> str:
    """The text with every character but look-alike letters in its plain form, letters composed."""
    kept = {i for m in _QUOTED.finditer(text) for i in (m.start(), m.end() - 1)}
    t = "".join(c if i in kept else _plain(c) for i, c in enumerate(text))
    return unicodedata.normalize("NFC", t)


@lru_cache(None)
def script(c: str) -> str:
    """Latin, Greek, Cyrillic ... of a letter."""
    return unicodedata.name(c, "?").split(" ")[0]


def _latin(run: str) -> str | None:
    """The run with look-alikes of Latin letters made Latin; None if other letters are left."""
    out = "".join(LOOKALIKES.get(c, c) for c in run)
    return out if all(script(c) == "LATIN" for c in out) else None


def _foreign(run: str, to: str) -> str | None:
    """The run with Latin letters made their look-alikes of script ``to``; None if others are left."""
    out = "".join(_BACK.get((to, c), c) for c in run)
    return out if all(script(c) == to for c in out) else None


def scripts(text: str) -> dict[str, int]:
    """How many letters of each script a text has that look like no letter of another script."""
    out: dict[str, int] = {}
    for c in text:
        if c.isalpha() and c not in LOOKALIKES and c not in _LATIN_LOOKS:
            s = script(c)
            out[s] = out.get(s, 0) + 1
    return out


def _most(counts: dict[str, int]) -> str | None:
    """The dominant script; Latin before others of as many letters."""
    return max(counts, key=lambda s: (counts[s], s == "LATIN", s), default=None)


def consistent_run(run: str, around: str | None = None) -> str | None:
    """The form in its dominant script of a run of letters that mixes scripts; None for one that does not.

    ``around`` is the dominant script of what stands around it, for a run all of whose letters are look-alikes.
    """
    found = {script(c) for c in run}
    if len(found) < 2:
        return None
    main = _most(scripts(run)) or around or "LATIN"
    return _latin(run) if main == "LATIN" else _foreign(run, main)


ALONE = "\x00"  #: marks a word that is asked for among the words of texts in its own script


def doubtful_runs(plain: str) -> list[tuple[str, str, bool]]:
    """(run, consistent form, without context) of the runs of letters that could be repaired.

    Without context: neither the token nor the text tells the script.
    """
    if plain.isascii():
        return []
    out, whole = {}, None
    for token in plain.split():
        if token.isascii():
            continue
        here = None
        for run in _LETTERS.findall(token):
            if run.isascii() or (found := {script(c) for c in run}) == {"LATIN"}:
                continue
            if here is None:
                here = _most(scripts(token))
            if whole is None:
                whole = _most(scripts(plain)) or ""
            around = here or whole or None
            if len(found) > 1:
                form, alone = consistent_run(run, around), False
            elif all(c in LOOKALIKES for c in run):
                mixed = around == "LATIN" or any(script(c) == "LATIN" for c in plain if c.isalpha()) or any(c.isdigit() for c in token)
                form, alone = (None if around not in (None, "LATIN") else _latin(run)), around is None and not mixed
            else:
                continue
            if form and form != run:
                out[run] = (form, alone)
    return [(run, form, alone) for run, (form, alone) in out.items()]


def own_words(text: str, plain: str) -> list[str]:
    """Words a text with letters of other scripts adds to the vocabulary: all of one without doubt, and the look-alike
    words of one in another script, marked."""
    if plain.isascii() or _most(scripts(plain)) in (None, "LATIN"):
        return []
    runs = [r for r in _LETTERS.findall(plain) if not r.isascii()]
    marked = [ALONE + r.lower() for r in runs if all(c in LOOKALIKES for c in r)]
    return marked + ([r.lower() for r in runs] if plain == text and not doubtful_runs(plain) else [])


_CAPITAL = re.compile(r"(?<=[^\W\d_])(?=[A-ZÄÖÜÉÈÀ][^\W\d_A-ZÄÖÜÉÈÀ])")


def readings(consistent: str) -> list[list[str]]:
    """Words of which all of one list must be known for a run to be repaired: the run itself, the parts of words glued
    together, or an initial and the name it is glued to."""
    word = consistent.lower()
    parts = [p.lower() for p in _CAPITAL.split(consistent)]
    return [[word]] + ([parts] if len(parts) > 1 else []) + ([[word[0], word[1:]]] if len(word) > 5 else [])


def _is_known(run: str, consistent: str, alone: bool, known: set[str]) -> bool:
    return not (alone and ALONE + run.lower() in known) and any(known.issuperset(r) for r in readings(consistent))


def repairs(plain: str, known: set[str]) -> dict[str, str]:
    """What to substitute in a text, by what is known of the words asked for; of those without context all or none."""
    runs = doubtful_runs(plain)
    sure = all(_is_known(*x, known) for x in runs if x[2])
    return {r: c for r, c, alone in runs if (sure if alone else _is_known(r, c, alone, known))}


def words(text: Column) -> Column:
    """The runs of letters of a text, without case."""
    return F.split(F.lower(text), "[^\\p{L}]+")


def repaired(rows: DataFrame, text_col: str = "text", out: str = "konsistent") -> DataFrame:
    """The rows of which the text differs from its consistent form, with that form in column ``out``.

    The corpus vocabulary is that of ``rows`` themselves: every run of letters in texts free of suspicious
    characters. Null and empty texts have nothing to repair; repeated rows are each returned; a text that only
    has more ordinary blanks is no difference; very long texts are handled whole. Columns pass through
    untouched, but one called like ``out`` is replaced.
    """
    rows = rows.drop(out) if out in rows.columns and out != text_col else rows
    c_text, c_plain, c_runs, c_own, c_fixed, c_word, c_salt = (free_name(n, [*rows.columns, out]) for n in ("_text", "_plain", "_runs", "_own", "_fixed", "_word", "_salt"))
    text = F.col(text_col).cast("string")

    def first_pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(c_text)).to_pylist()
            plain = [plain_form(t) for t in texts]
            runs = [[w for r, c, alone in doubtful_runs(p) for w in [*(w for ws in readings(c) for w in ws), *([ALONE + r.lower()] if alone else [])]] for p in plain]
            own = [own_words(t, p) for t, p in zip(texts, plain)]
            for name, values, kind in ((c_plain, plain, pa.string()), (c_runs, runs, pa.list_(pa.string())), (c_own, own, pa.list_(pa.string()))):
                batch = appended(batch, name, pa.array(values, kind))
            yield batch

    def second_pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = []
            for plain, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ok = set(known)
                swap = repairs(plain, ok)
                fixed.append(_LETTERS.sub(lambda m, swap=swap: swap.get(m[0], m[0]), plain))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fixed, pa.string())], names=[c_plain, c_fixed])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    suspicious = rows.withColumn(c_text, text).where(F.col(c_text).rlike(SUSPICIOUS))
    first = cut(suspicious.mapInArrow(first_pass, f"{schema}, {c_text} string, {c_plain} string, {c_runs} array<string>, {c_own} array<string>"))
    clean = rows.select(text.alias("t")).where(~F.col("t").rlike(SUSPICIOUS))
    vocabulary = clean.select(F.explode(words(F.col("t"))).alias(c_word)).unionByName(first.select(F.explode(c_own).alias(c_word))).distinct()
    doubtful = first.where(F.size(c_runs) > 0)
    asked = doubtful.select(c_plain, F.explode(c_runs).alias(c_word)).distinct()
    known = asked.join(vocabulary, c_word, "left_semi").groupBy(c_plain).agg(F.collect_set(c_word).alias("known"))
    fixed = known.select(c_plain, "known").mapInArrow(second_pass, f"{c_plain} string, {c_fixed} string")
    # a text that many rows have is spread over SALTS parts, each with its own copy of the repaired form
    salted = doubtful.withColumn(c_salt, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    spread = fixed.withColumn(c_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mended = salted.join(spread, [c_plain, c_salt], "left").withColumn(out, F.coalesce(c_fixed, c_plain))
    plain = first.where(F.size(c_runs) == 0).withColumn(out, F.col(c_plain))
    both = plain.select(*rows.columns, c_text, out).unionByName(mended.select(*rows.columns, c_text, out))
    return both.where(F.col(out) != F.col(c_text)).drop(c_text)
