"""Text folding and normalisation as native columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Turkish letters and the ASCII letters they fold to.
TURKISH = "İIıiŞşĞğÇçÖöÜü"
TURKISH_ASCII = "iiiissggccoouu"
# Letters folded before a text is lower-cased, for citation and footnote comparisons.
TURKISH_LOWER = "ıİğĞüÜşŞöÖçÇ"
TURKISH_LOWER_ASCII = "iigguussoocc"
# Words without weight in titles, English then Turkish, already folded.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "with", "by", "from", "as", "is", "are", "be", "this", "that", "study", "analysis", "research", "approach", "using", "based", "new", "case",
    "ve", "ile", "bir", "bu", "de", "da", "icin", "olarak", "uzerine", "uzerinde", "calisma", "analiz", "arastirma", "inceleme", "yeni", "ornek",
)

#: ASCII word boundary; \b of Java knows other letters.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: White space as JavaScript has it.
SPACE = r"[\s   -     　﻿]"


#: The characters of ``SPACE`` one by one.
BLANKS = "".join(c for c in map(chr, range(0x10000)) if re.fullmatch(r"[\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]", c))
#: What ``B`` is before an ASCII letter or digit, after one, and after another sign.
START, END, NEXT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])", "(?=[A-Za-z0-9_])"
#: Stands where a text is parted; a text that holds it is parted more slowly.
_CUT = "\uffff"


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """Precomposed letters of the basic plane, and their base letters: generated from Unicode's decompositions."""
    composed, base = [], []
    for code in range(0xC0, 0xFFFF):
        plain = unicodedata.normalize("NFD", chr(code))
        if len(plain) > 1 and all(0x300 <= ord(c) <= 0x36F for c in plain[1:]):
            composed.append(chr(code))
            base.append(plain[0])
    return "".join(composed), "".join(base)


def without_accents(c: Column) -> Column:
    """Canonical decomposition without combining marks U+0300 to U+036F."""
    return F.regexp_replace(F.translate(c, *accents()), "[̀-ͯ]", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def split_at(c: Column, pattern: str) -> Column:
    """``split`` at matches that aren't empty; the pattern is compiled once a task, not once a row."""
    return bound(c, lambda x: F.when(F.contains(x, F.lit(_CUT)), F.split(x, pattern)).otherwise(F.split(F.regexp_replace(x, pattern, _CUT), _CUT)))


def visible(c: Column) -> Column:
    """Runs of blanks, tabs and line ends as one blank, none at the ends."""
    return trimmed(F.regexp_replace(c, "[ \t\r\n]+", " "))


def fold_turkish(c: Column) -> Column:
    """Turkish letters as ASCII ones; others keep their case."""
    return F.translate(F.coalesce(c, F.lit("")), TURKISH, TURKISH_ASCII)


def fold_lower(c: Column) -> Column:
    return F.lower(F.translate(c, TURKISH_LOWER, TURKISH_LOWER_ASCII))


def normalized(c: Column) -> Column:
    """For comparisons: folded, without accents, lower case, other signs as single blanks."""
    plain = F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), without_accents(fold_turkish(c))).otherwise(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def tokens(normal: Column) -> Column:
    """Words of a normalised text of two letters or more that carry weight."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(normal, " "), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def spaced(c: Column) -> Column:
    """Folded lower-case letters and digits of any script, other signs as single blanks."""
    return F.trim(F.regexp_replace(fold_lower(c), r"[^\p{L}\p{N}]+", " "))


def key_part(c: Column) -> Column:
    """Of a citation key: lower case, no diacritics, letters and digits only. A dotless i stays what it is."""
    modifiers = r"[ʰ-ˮʹͺՙـᴬ-ᵪꙿꜗ-ꜟꞈｰﾞﾟ]"
    full = F.regexp_replace(F.regexp_replace(without_accents(F.lower(c)), modifiers, ""), r"[^\p{L}0-9]", "")
    return F.when(F.length(c) == F.octet_length(c), F.regexp_replace(F.lower(c), "[^a-z0-9]", "")).otherwise(full)


def key_year(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", ""), r"\.+$", "")
    return F.when(c.rlike(r"^[0-9][0-9a-z]*\z"), c).when(plain.isin("n.d", "t.y", "ts", "t.s", "nodate"), "nodate").otherwise(plain)


def key(author: Column, year: Column) -> Column:
    return F.concat(key_part(author), F.lit(":"), key_year(year))
