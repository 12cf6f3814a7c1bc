"""Texts in one consistent form, so that those which look the same are the same.

Quick-check properties tell which segments of a text may change; the rest is never touched. A segment starts at a
character that nothing before it can combine with (a starter that is stable by itself), and ends before the next such
one, so that canonical segments can be spliced in between.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.session import cut

# Letters of other scripts that look like Latin ones, by their base letters.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "h", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "һ": "h", "ү": "y", "ѵ": "v", "ӏ": "l",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
}
OTHERS = {"Օ": "O", "օ": "o", "Տ": "S", "ս": "u", "հ": "h", "ո": "n", "ɑ": "a", "ɡ": "g"}
# Signs that look the same: hyphens, dot leaders, apostrophes, slashes.
SIGNS = {"‐": "-", "‑": "-", "․": ".", "‥": "..", "…": "...", "ʼ": "’", "∕": "/", "⁄": "/"}
# Line ends of any kind.
LINES = ["\r\n", "\r", "\u0085", " ", " "]
# Fillers and joiners that aren't format characters but can't be seen.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍᠏"

LOOK = CYRILLIC | GREEK | OTHERS
#: Kinds of compatibility forms that differ in width or joining only; others (superscripts, fractions, circles) look different.
JOINED = [("ﬀ", "ﬆ"), ("Ĳ", "ĳ"), ("Ǆ", "ǌ"), ("Ⅰ", "ⅿ")]  # fixed values: ligatures, letter pairs, numerals
WIDTHS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")


def _invisible(c: str) -> bool:
    # format characters and what only picks a glyph; tags are seen, as they tell flags apart
    return (unicodedata.category(c) == "Cf" and not "\U000e0020" <= c <= "\U000e007f") or "︀" <= c <= "️" or c in UNSEEN


@lru_cache(maxsize=65536)
def _plain(c: str) -> str:
    """One character in canonical decomposition, without differences of width, joining or script."""
    if _invisible(c):
        return ""
    if c in SIGNS:
        return SIGNS[c]
    if unicodedata.category(c) == "Zs":
        return " "
    form = unicodedata.decomposition(c)
    kind = form.partition(" ")[0]
    if kind in WIDTHS or (kind == "<compat>" and any(low <= c <= high for low, high in JOINED)):
        if unicodedata.normalize("NFKC", c) != c and not "ﷰ" <= c <= "﷿":
            return "".join(map(_plain, unicodedata.normalize("NFKD", c)))
    d = unicodedata.normalize("NFD", c)
    return "".join(LOOK.get(x, x) for x in d) if d != c else LOOK.get(c, c)


def _steady(c: str) -> bool:
    """Quick check of a character: it is a starter, stays as it is, and nothing before it combines with it."""
    return (
        c not in LINES
        and unicodedata.combining(c) == 0
        and unicodedata.category(c) not in ("Mn", "Mc", "Me")
        and not "ᅠ" <= c <= "ᇿ"  # vowels and finals of Hangul
        and unicodedata.is_normalized("NFC", c)
        and _plain(c) == unicodedata.normalize("NFD", c)
    )


#: Blocks of which every character is steady: ideographs, Hangul syllables, private use, planes without characters.
STEADY_BLOCKS = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xF8FF), (0x17000, 0x18CFF), (0x20000, 0x2F7FF), (0x2FA20, 0xDFFFF), (0xE0200, sys.maxunicode)]


def _pattern(skipped: list[tuple[int, int]] = STEADY_BLOCKS) -> re.Pattern:
    """Matches a run of characters that aren't steady."""
    ranges: list[list[int]] = []
    i = 0x0D
    for low, high in [*skipped, (sys.maxunicode + 1, 0)]:
        for c in range(i, low):
            if not 0xD800 <= c <= 0xDFFF and not _steady(chr(c)):
                if ranges and ranges[-1][1] == c - 1:
                    ranges[-1][1] = c
                else:
                    ranges.append([c, c])
        i = high + 1
    cls = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return re.compile(f"(?:\r\n|[{cls}])+")


@lru_cache(maxsize=1)
def unstable_runs() -> re.Pattern:
    return _pattern()


def _canonical_segment(s: str) -> str:
    for end in LINES:
        s = s.replace(end, "\n")
    return unicodedata.normalize("NFC", "".join(map(_plain, s)))


def same_look(text: str) -> str:
    """The canonical form. Applying it again changes nothing."""
    if text.isascii() and "\r" not in text:
        return text
    parts, at = [], 0
    for m in unstable_runs().finditer(text):
        start = max(at, m.start() - 1)  # with the steady character that the run may combine with
        parts += (text[at:start], _canonical_segment(text[start : m.end()]))
        at = m.end()
    parts.append(text[at:])
    return "".join(parts)


def canonical(text: Column) -> Column:
    """The canonical form of each text: null stays null, empty stays empty. Only texts that may change go to Python.

    Made alike: full and half width, ligatures and letter pairs of compatibility, composed and decomposed accents, invisible
    characters (zero width, joiners, soft hyphens, marks of direction), spaces of any width, hyphens that break or not,
    line ends, and look-alike letters of Cyrillic, Greek and Armenian. Letter case, other accents, digits, tabs, dashes,
    quotes, superscripts and the number of spaces stay different. The form is for comparison: Cyrillic and Greek
    words come out with Latin letters where those look the same.
    """

    @F.pandas_udf("string")
    def change(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(same_look, na_action="ignore")

    may_change = text.rlike(r"[^\x00-\x0c\x0e-\x7f]")
    return F.when(may_change, change(F.when(may_change, text))).otherwise(text)


#: Parts that the rows of a form or text are spread over where they are joined with what is known of it.
SALTS = 16
#: Spellings of a form that one task pairs with all others.
SPELLINGS = 1024


def _keyed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """`id`, digests of the form (`f1`, `f2`) and of the text (`t1`): 32 bytes a row, cut, as it is read several times and canonical forms are costly."""
    known = df.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).alias("t"), canonical(F.col(text_column)).alias("f"))
    return cut(known.select("id", F.xxhash64("f").alias("f1"), F.xxhash64(F.lit(1), "f").alias("f2"), F.xxhash64("t", F.lit(2)).alias("t1")))


def _spread(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def look_alikes(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Pairs (`a` < `b`) of rows whose texts differ but have one canonical form; null texts and ids take no part, no rows give no pairs.

    Exact copies of a text are a class, named by its smallest id. Of two classes that look alike each row of either is paired with the smallest id of the other: for n and m copies n + m - 1
    pairs, whatever n and m are, and no link between different texts is lost. Only classes that share their form with another are joined; those of a form with very many spellings are
    spread over tasks, as are the rows of a class.
    """
    keyed = _keyed(df, id_column, text_column)
    classes = keyed.groupBy("f1", "f2", "t1").agg(F.min("id").alias("rep"))
    shared = classes.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").withColumn("parts", F.ceil(F.col("k") / SPELLINGS).cast("int")).drop("k")
    classes = classes.join(shared, ["f1", "f2"])
    x = classes.withColumn("part", F.pmod("t1", F.col("parts")).cast("int"))
    y = classes.select("f1", "f2", F.col("t1").alias("u1"), F.col("rep").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    links = x.join(y, ["f1", "f2", "part"]).where("t1 <> u1").select("f1", "f2", "t1", "other")
    rows = keyed.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    pairs = rows.join(_spread(links), ["f1", "f2", "t1", "_salt"]).select("id", "other")
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).where("a <> b").distinct()


def look_classes(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per row with an id and a text: `id_column`, `look` (the smallest id of those that look the same), `n_rows` and `n_texts` (rows and different texts of that look). As many rows
    come out as go in, however many look alike."""
    keyed = _keyed(df, id_column, text_column)
    texts = keyed.groupBy("f1", "f2", "t1").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    looks = texts.groupBy("f1", "f2").agg(F.min("rep").alias("look"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_texts"))
    rows = keyed.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return rows.join(_spread(looks), ["f1", "f2", "_salt"]).select(F.col("id").alias(id_column), "look", "n_rows", "n_texts")
