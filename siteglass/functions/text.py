"""Text functions: space, widths, syllables, sentences, readability."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TITLE_PX, DESCRIPTION_PX = 20.0, 13.9

# Advance widths of Helvetica in thousandths of an em, for the characters from space to ~.
ADVANCE = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556, 1015,
    667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611,
    278, 278, 278, 469, 556, 333,
    556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500,
    334, 260, 334, 584,
)
OTHER, WIDE, WIDE_FROM = 556, 1000, 0x2E80


def collapse_space(text: Column) -> Column:
    """Single blanks for runs of Unicode white space, none at the ends, no zero-width characters."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[​‌‍﻿]", ""), r"(?U)\s+", " "))


def pixel_width(text: Column, size: float) -> Column:
    """Width in pixels, rounded half away from zero once."""
    by_width: dict[int, str] = {}
    for i, w in enumerate(ADVANCE):
        by_width[w] = by_width.get(w, "") + chr(32 + i)
    total = F.lit(0)
    for w, chars in sorted(by_width.items()):
        total = total + F.length(text) * 0 + w * (F.length(text) - F.length(F.translate(text, chars, "")))
    ascii_n = F.length(text) - F.length(F.regexp_replace(text, "[ -~]", ""))
    wide = F.length(text) - F.length(F.regexp_replace(text, r"[\x{2E80}-\x{10FFFF}]", ""))
    total = total + WIDE * wide + OTHER * (F.length(text) - ascii_n - wide)
    return F.floor(total * size / 1000 + 0.5).cast("int")


def words(text: Column) -> Column:
    return F.filter(F.split(collapse_space(text), " "), lambda w: w != "")


#: Syllables: groups of vowels, one more for each ia, one less for a last tial and for a silent last e or ed (but not le)
#: of a word that has two or more.
VOWELS, TIAL = "[aeiouy]+", r"tial(?!\S)"
SILENT = r"(?<!\S)(?=\S*(?:ia|[aeiouy][^aeiouy\s]+[aeiouy]))\S*(?:(?<!l)e|ed)(?!\S)"


def syllables(text: Column) -> Column:
    """Syllables of all words of a text whose words are parted by single blanks (or of one word)."""
    w = F.lower(text)
    count = lambda p: F.regexp_count(w, F.lit(p))
    return count(VOWELS) + count("ia") - count(TIAL) - count(SILENT)


def flesch(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    score = 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))


LINE = 80
INNER_STOPS = re.compile(r"[.!?]+(?=[^\s.!?])")
VOWEL_GROUPS, LAST_TIAL, SILENT_ENDS = re.compile(VOWELS), re.compile(TIAL), re.compile(SILENT)


def line_ends(sizes: np.ndarray) -> np.ndarray:
    """Places of the last words of lines of up to ``LINE`` characters, filled in turn with words of these sizes and blanks."""
    reach, out, done = np.cumsum(sizes + 1), [], 0
    while done < len(sizes):
        used = reach[done - 1] if done else 0
        done = max(int(np.searchsorted(reach, used + LINE + 1, "right")), done + 1)
        out.append(done - 1)
    return np.array(out)


def sentences(block: str) -> int:
    """Each line ends one, each stop inside a word one, and each word with a last stop that doesn't end its line one."""
    ws = block.split()
    if not ws:
        return 0
    ends = line_ends(np.fromiter(map(len, ws), np.int64, len(ws)))
    stops = np.fromiter((w.endswith((".", "!", "?")) for w in ws), bool, len(ws))
    return len(ends) + len(INNER_STOPS.findall(" ".join(ws))) + int(stops.sum() - stops[ends].sum())


def block_stats(blocks: list[str]) -> tuple[int, int, float, float]:
    """Words, sentences, words a sentence and Flesch score of a text's blocks."""
    whole = " ".join(" ".join(blocks).split())
    if not whole:
        return 0, 0, 0.0, 0.0
    n, s, low = whole.count(" ") + 1, max(1, sum(map(sentences, blocks))), whole.lower()
    spoken = len(VOWEL_GROUPS.findall(low)) + low.count("ia") - len(LAST_TIAL.findall(low)) - len(SILENT_ENDS.findall(low))
    return n, s, n / s, float(np.clip(206.835 - 1.015 * (n / s) - 84.6 * (spoken / n), 0, 100))


STATS = T.StructType().add("words", "integer").add("sentences", "integer").add("words_per_sentence", "double").add("flesch", "double")


@F.pandas_udf(STATS)
def readability(blocks: pd.Series) -> pd.DataFrame:
    """Statistics of an array of text blocks; a null array counts as none."""
    rows = [block_stats([] if b is None else [x for x in b if x]) for b in blocks]
    return pd.DataFrame(rows, columns=["words", "sentences", "words_per_sentence", "flesch"])
