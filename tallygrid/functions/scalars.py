"""Text, number and predicate columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def floor_div(a: Column, b: Column) -> Column:
    """Integer quotient rounded towards minus infinity; NULL for a zero divisor."""
    return F.floor(a / F.nullif(b, F.lit(0)))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; NULL for a zero divisor."""
    d = F.nullif(b, F.lit(0))
    return a - d * F.floor(a / d)


def ratio(num: Column, den: Column) -> Column:
    """num/den with NULL for a zero denominator."""
    return num / F.nullif(den.cast("double"), F.lit(0.0))


def round_half_up(c: Column, scale: int = 2) -> Column:
    """Exact decimal rounding, halves away from zero."""
    return F.round(c.cast("decimal(38,10)"), scale)


def round_half_even(c: Column, scale: int = 2) -> Column:
    return F.bround(c, scale)


def parse_decimal(c: Column, to: str = "decimal(38,6)") -> Column:
    """Number written with a comma or a dot as decimal mark; anything else is NULL."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast(to)


def to_number(c: Column) -> Column:
    """Double, with unreadable text and NaN as NULL."""
    d = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(d), d)


def slug(c: Column) -> Column:
    """Lower case; runs outside [a-z0-9_] become one underscore; outer underscores go."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", "_"), F.lit("_"))


_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


class _Letters(dict):
    """What each character folds to, found when first met: its case-folded compatibility letters without marks."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(code).casefold())
        self[code] = letters = parts.translate(self.marks(parts))
        return letters

    @staticmethod
    def marks(parts: str) -> dict[int, None]:
        return {ord(p): None for p in parts if unicodedata.combining(p)}


_LETTERS = _Letters()
#: Marks, Latin, Greek and Cyrillic letters are folded in the JVM; text with others goes to Python.
_NEAR = range(0x80, 0x530)


def fold_text(text: str) -> str:
    """``fold_key`` of one value."""
    return text.strip().translate(_LETTERS)


@F.pandas_udf(T.StringType())
def _fold_far(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


def fold_key(c: Column) -> Column:
    """Accent- and case-insensitive key: trimmed, case-folded, compatibility letters, no marks.

    A character table made from the Unicode data folds Latin, Greek and Cyrillic text inside the JVM.
    """
    folded = {chr(code): _LETTERS[code] for code in _NEAR}
    one = {a: b for a, b in folded.items() if len(b) == 1 and a != b}
    gone = [a for a, b in folded.items() if not b]
    key = F.translate(F.lower(F.btrim(c, F.lit(_SPACE))), "".join([*one, *gone]), "".join(one.values()))
    for a, b in folded.items():
        if len(b) > 1:
            key = F.replace(key, F.lit(a), F.lit(b))
    far = c.rlike(r"[^\x{0}-\x{52F}]")
    return F.when(far, _fold_far(F.when(far, c))).otherwise(key)


def folded_equal(a: Column, b: Column) -> Column:
    """Accent- and case-insensitive equality inside the JVM, by collation."""
    return F.collate(F.trim(a), "UNICODE_CI_AI") == F.collate(F.trim(b), "UNICODE_CI_AI")


def palindrome_text(c: Column) -> Column:
    """The letters and digits a palindrome test compares."""
    return F.regexp_replace(fold_key(c), r"[^\p{L}\p{N}]", "")


def is_palindrome(c: Column) -> Column:
    """True when the folded letters and digits read the same both ways; true for none."""
    t = palindrome_text(c)
    return t == F.reverse(t)


def short_label(code: Column, name: Column) -> Column:
    """Upper-cased code, or the name cut to 12 characters and an ellipsis when longer than 13."""
    shown = F.coalesce(name, F.lit(""))
    cut = F.when(F.length(shown) > 13, F.concat(F.substring(shown, 1, 12), F.lit("…"))).otherwise(shown)
    return F.when(F.length(F.trim(code)) > 0, F.upper(code)).otherwise(cut)


def in_last_years(year: Column, last: int, n: int = 30) -> Column:
    """Years last-n+1 … last."""
    return year.between(last - n + 1, last)


def grade(c: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower bound the value reaches: an if/elif/else chain."""
    out = None
    for bound, label in steps:
        out = F.when(c >= bound, label) if out is None else out.when(c >= bound, label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)
