"""Unicode folding as column expressions (compatibility decomposition, marks dropped).

Spark SQL has no ``normalize``. The decomposition tables are derived from the
Unicode data of the Python standard library once, on the driver, and travel as
literals, so folding stays inside the JVM:

* pure ASCII text takes no table at all,
* one-to-one decompositions go through ``translate``,
* one-to-many decompositions and Hangul go through a per-character lookup, only
  on rows that contain such a character.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = "[̀-ͯ]"
# White space as text sources use it, no-break and typographic blanks included.
BLANKS = (
    r"[\s\x{b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
)
_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3
_HANGUL = f"[{chr(_HANGUL_FIRST)}-{chr(_HANGUL_LAST)}]"


def _stripped(char: str) -> str:
    return "".join(
        c for c in unicodedata.normalize("NFKD", char) if not 0x300 <= ord(c) <= 0x36F
    )


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, str, str, int]:
    """(translate from, translate to, wide characters, their spellings padded to one
    width, that width).

    Plain string literals keep the plans small; a map literal of this size would
    slow down every optimizer rule.
    """
    source, target, wide = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or _HANGUL_FIRST <= code <= _HANGUL_LAST:
            continue
        char = chr(code)
        if not unicodedata.decomposition(char):
            continue
        plain = _stripped(char)
        if len(plain) == 1 and plain != char:
            source.append(char)
            target.append(plain)
        elif len(plain) != 1:
            wide[char] = plain
    width = max(len(plain) for plain in wide.values())
    spelled = "".join(plain.ljust(width, "\x01") for plain in wide.values())
    return "".join(source), "".join(target), "".join(wide), spelled, width


def _jamo(char: Column) -> Column:
    """Decompose one Hangul syllable by its index arithmetic."""
    point = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("int") - _HANGUL_FIRST
    lead = F.array(*[F.lit(chr(0x1100 + i)) for i in range(19)])
    vowel = F.array(*[F.lit(chr(0x1161 + i)) for i in range(21)])
    tail = F.array(*[F.lit("" if i == 0 else chr(0x11A7 + i)) for i in range(28)])
    return F.concat(
        F.get(lead, F.floor(point / 588).cast("int")),
        F.get(vowel, F.floor((point % 588) / 28).cast("int")),
        F.get(tail, point % 28),
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_accents(text: Column) -> Column:
    """Compatibility-decomposed text without combining accents; case untouched."""
    return let(text, _folded)


def _folded(text: Column) -> Column:
    source, target, wide, spellings, width = _tables()

    def one(char: Column) -> Column:
        hangul = (char >= chr(_HANGUL_FIRST)) & (char <= chr(_HANGUL_LAST))
        at = F.instr(F.lit(wide), char)
        padded = F.substring(F.lit(spellings), (at - 1) * width + 1, F.lit(width))
        known = F.when(at > 0, F.rtrim(padded, F.lit("\x01"))).otherwise(char)
        return F.when(hangul, _jamo(char)).otherwise(known)

    spelled = F.array_join(F.transform(F.split(text, ""), one), "")
    # A character is looked up in a table here: a class of that many ranges tests them one by one.
    holds_wide = (F.translate(text, wide, "") != text) | text.rlike(_HANGUL)
    widened = F.when(holds_wide, spelled).otherwise(text)
    folded = F.regexp_replace(F.translate(widened, source, target), MARKS, "")
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(folded)


def normalize_title(text: Column) -> Column:
    """Title key: lower case, accents folded, everything but a-z0-9 a single space."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(text)), "[^a-z0-9]+", " "))


def normalize_name(text: Column) -> Column:
    """Place-name key: as titles, but letters and digits of any script are kept."""

    def key(name: Column) -> Column:
        ascii_ = F.regexp_replace(F.translate(F.lower(name), "'`", ""), "[^a-z0-9]+", " ")
        bare = F.regexp_replace(fold_accents(F.lower(name)), "['’‘`´]", "")
        any_ = F.regexp_replace(bare, "[^\\p{L}\\p{N}]+", " ")
        return F.trim(F.when(F.octet_length(name) == F.char_length(name), ascii_).otherwise(any_))

    return let(text, key)


def directory_sort_key(title_norm: Column) -> Column:
    """Sort form of a normalized title: the leading article is dropped."""
    return F.regexp_replace(F.lower(F.trim(title_norm)), "^(the|an|a) ", "")


def letter_bucket(title_norm: Column) -> Column:
    """First letter of the sort key, ``#`` for everything outside a-z."""
    first = F.substring(directory_sort_key(title_norm), 1, 1)
    return F.when(first.between("a", "z"), first).otherwise(F.lit("#"))


def squash(text: Column) -> Column:
    """Runs of white space become one blank."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "))


def slug(text: Column) -> Column:
    """URL part of a title or name."""
    return F.regexp_replace(normalize_title(text), " +", "-")


def names_match(left: Column, right: Column, words: tuple[Column, Column] | None = None) -> Column:
    """Two *normalized* names are equal, or one is the other plus at most one word
    at its start or end (compared as text). ``words`` may give their numbers of words."""
    left_words, right_words = words or (F.size(F.split(left, " ")), F.size(F.split(right, " ")))
    left_shorter = left_words <= right_words
    short = F.when(left_shorter, left).otherwise(right)
    long = F.when(left_shorter, right).otherwise(left)
    close = F.abs(left_words - right_words) <= 1
    return (
        (left != "")
        & (right != "")
        & ((left == right) | (close & (long.endswith(short) | long.startswith(short))))
    )
