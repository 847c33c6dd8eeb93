"""Text primitives as column expressions: trimming, words, punctuation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters of a word and the signs of a punctuation run.
LETTER = "[a-zA-ZÀ-ÿœŒæÆ]"
SIGNS = "[!?.,;:…\\-—–\"'«»()\\[\\]]"

# a word border that means the same in every Java version: one side is a letter, digit or underscore, the other is not
_W = r"[\p{L}\p{N}_]"
_BORDER = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
WORD = f"{_BORDER}{LETTER}+(?:['-]{LETTER}+)*{_BORDER}"
#: The same where a text has no sign that is in the class of letters but is no letter: then no run need be given up in part.
_SIGNS_IN_CLASS = ("×", "÷")
_PLAIN_WORD = f"(?<!{_W}){LETTER}++(?:['-]{LETTER}++)*(?!{_W})"


def trim_all(text: Column) -> Column:
    """Strip all Unicode white space, where trim() knows only the blank."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def is_blank(text: Column) -> Column:
    """Whether trim_all leaves nothing; a text is read up to its first sign."""
    return ~F.coalesce(F.rlike(text, F.lit(r"(?U)[^\s\x1C-\x1F]")), F.lit(False))


def words(text: Column) -> Column:
    """Lower-case words in order, repeats kept; null has none."""
    text = F.coalesce(text, F.lit(""))
    odd = F.contains(text, F.lit(_SIGNS_IN_CLASS[0])) | F.contains(text, F.lit(_SIGNS_IN_CLASS[1]))
    find = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(F.when(odd, find(WORD)).otherwise(find(_PLAIN_WORD)), F.lower)


def punctuation(text: Column) -> Column:
    """Signs in order. In each run, ellipses come first: one for any number of U+2026, one per three dots that are left."""
    text = F.coalesce(text, F.lit(""))
    find = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def signs(run: Column) -> Column:
        dots = F.regexp_replace(run, "…", "")
        rest = F.regexp_replace(dots, r"\.{3}", "")
        folded = F.contains(run, F.lit("…")).cast("int") + ((F.length(dots) - F.length(rest)) / 3).cast("int")
        return F.concat(F.array_repeat(F.lit("…"), folded), F.filter(F.split(rest, ""), lambda c: c != ""))

    # runs matter only where there is something to fold
    folds = F.contains(text, F.lit("…")) | F.contains(text, F.lit("..."))
    return F.when(folds, F.flatten(F.transform(find(SIGNS + "+"), lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(signs(run))))).otherwise(find(SIGNS))
