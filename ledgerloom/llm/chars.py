"""Character classes and look-alike tables shared by the text operators."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d",
    "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ї": "ï", "ё": "ë", "Ё": "Ë", "Ї": "Ï", "ү": "y",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "α": "a", "ι": "i", "κ": "k", "ρ": "p",
    "υ": "u", "χ": "x", "Ϲ": "C", "ί": "í", "ό": "ó",
}
ARMENIAN = {"օ": "o", "ս": "u", "հ": "h", "Տ": "S", "Օ": "O", "Ս": "U", "ո": "n", "ց": "g", "յ": "j"}
LOOKALIKES = {**CYRILLIC, **GREEK, **ARMENIAN}

#: Characters that show nothing: zero width, soft hyphen, joiners, direction marks, variation selectors.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e007f"
BLANKS = "   -   　"
APOSTROPHES = "‘’‛ʹʻʼˈ′‵＇ꞌʹ׳"
HYPHENS = "‐‑­－﹣"

_DROP = re.compile(f"[{INVISIBLE}]")
_BLANK = re.compile(f"[{BLANKS}]")
_APOSTROPHE = re.compile(f"[{APOSTROPHES}]")
_HYPHEN = re.compile("[‐‑‒˗﹣]")
_SPACES = re.compile(r"\s+")

_FOLD_LOOKS = {ord(a): b for a, b in LOOKALIKES.items()}


def bare(text: str) -> str:
    """Compatibility forms resolved, invisible characters dropped, blanks and apostrophes ordinary."""
    if text.isascii():
        return text
    t = unicodedata.normalize("NFKC", text)
    t = _DROP.sub("", t)
    t = _BLANK.sub(" ", t)
    t = _APOSTROPHE.sub("'", t)
    return _HYPHEN.sub("-", t)


def _slow_fold(text: str) -> str:
    t = bare(text).casefold().translate(_FOLD_LOOKS)
    t = unicodedata.normalize("NFKD", t)
    return "".join(c for c in t if not unicodedata.combining(c))


class _Folds(dict):
    """What ``_slow_fold`` makes of each character met so far: it looks at no neighbours, as marks are dropped."""

    def __missing__(self, c: str) -> str:
        self[c] = out = _slow_fold(c)
        return out


_FOLDS = _Folds()
_OTHER = re.compile(r"[^\x00-\x7f]")


def folded(text: str) -> str:
    """``bare`` without case, accents and look-alike letters: a form for matching, not for reading."""
    if text.isascii():
        return text.lower()
    return _OTHER.sub(lambda m: _FOLDS[m[0]], text.casefold())


def free_name(base: str, taken: list[str]) -> str:
    """``base``, with underscores before it until no column of ``taken`` is called so, whatever its case."""
    used = {t.lower() for t in taken}
    while base.lower() in used:
        base = "_" + base
    return base


def appended(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with one more column; the others stay as they are, whatever their types and nulls."""
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])
