"""Text normalisation: case folding, slugs, tag components and key words."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from docwarden import vocab

ASCII_ONLY = r"^[\x00-\x7F]*$"
# White space as Unicode text matching sees it: Java's \s plus the wider set and the separators
# 0x1C to 0x1F.
SPACE = r"\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# No letter, digit or underscore just before this position.
WORD_START = r"(?<![\p{L}\p{N}_])"


@lru_cache(maxsize=None)
def _fold_tables(kind: str) -> tuple[str, str, dict[str, str]]:
    """Characters that a folding changes: single replacements as two aligned strings, longer ones and
    those of characters beyond U+FFFF as a dictionary. Both are derived from the Unicode database, not written out."""
    singles, targets, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if kind in ("casefold", "letters"):
            folded = char.casefold()
            if char.lower() != char or folded == char:
                continue
            if kind == "letters" and not any(c.isascii() for c in folded):
                continue
        else:
            folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
            if not folded:
                continue
        if len(folded) == 1 and code < 0x10000:
            singles.append(char)
            targets.append(folded)
        else:
            longer[char] = folded
    return "".join(singles), "".join(targets), longer


def _fold(text: Column, kind: str) -> Column:
    singles, targets, longer = _fold_tables(kind)
    # One literal that constant folding turns into a map.
    listed = "\x1e".join(f"{char}\x1f{folded}" for char, folded in longer.items())
    table = F.str_to_map(F.lit(listed), F.lit("\x1e"), F.lit("\x1f"))
    short = F.translate(text, singles, targets)
    spread = F.array_join(
        F.transform(F.split(short, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
    )
    return F.when(short.rlike("[" + "".join(longer) + "]"), spread).otherwise(short)


def casefold(text: Column) -> Column:
    """Full Unicode case folding (``ß`` becomes ``ss``), cheap for ASCII text."""
    low = F.lower(text)
    return F.when(low.rlike(ASCII_ONLY), low).otherwise(_fold(low, "casefold"))


def fold_letters(text: Column) -> Column:
    """Case folding as far as it yields ASCII letters; enough where other characters are dropped
    or never compared."""
    low = F.lower(text)
    return F.when(low.rlike(ASCII_ONLY), low).otherwise(_fold(low, "letters"))


def _squeeze(text: Column) -> Column:
    dashed = F.regexp_replace(text, "[^a-z0-9]+", "-")
    return F.nullif(F.regexp_replace(dashed, "^-|-$", ""), F.lit(""))


def slug(text: Column) -> Column:
    """Case-folded words joined by dashes; null when nothing is left."""
    return _squeeze(fold_letters(text))


def ascii_slug(text: Column) -> Column:
    """Like :func:`slug`, but accents are decomposed and other non-ASCII characters dropped."""
    plain = F.when(text.rlike(ASCII_ONLY), text).otherwise(
        F.regexp_replace(_fold(text, "ascii"), r"[^\x00-\x7F]", "")
    )
    return _squeeze(F.lower(plain))


def subject_slug(subject: Column) -> Column:
    """At most 72 slug characters and ten hex digits of the subject's hash."""
    base = F.coalesce(slug(subject), F.lit("relation"))
    short = F.regexp_replace(F.substring(base, 1, 72), "-+$", "")
    return F.concat(short, F.lit("-"), F.substring(F.sha2(subject, 256), 1, 10))


def is_tag_component(text: Column) -> Column:
    return F.coalesce(text.rlike(vocab.TAG_COMPONENT), F.lit(False))


def key_phrase(key: Column) -> Column:
    """A key's words in lower case, separated by one space: ``apiKey_v2`` becomes ``api key v2``."""
    spaced = F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(spaced, "[^A-Za-z0-9]+", " ")))


def squeezed_key(key: Column) -> Column:
    """A key without separators and case: ``Private-Key`` becomes ``privatekey``."""
    return F.regexp_replace(fold_letters(key), "[^a-z0-9]+", "")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)
