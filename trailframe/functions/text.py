"""Folding and word rules of names and queries as Column expressions (STR-01, STR-04, STR-06)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and the plain letter that the index stores for them.
FOLDS = (
    ("àáâãäåāăąǎȧ", "a"), ("çćĉċč", "c"), ("ďđ", "d"), ("èéêëēĕėęěȩ", "e"), ("ĝğġģ", "g"), ("ĥħ", "h"), ("ìíîïĩīĭįıǐ", "i"),
    ("ĵ", "j"), ("ķ", "k"), ("ĺļľłŀ", "l"), ("ñńņňŉ", "n"), ("òóôõöøōŏőǒ", "o"), ("ŕŗř", "r"), ("śŝşșš", "s"),
    ("ţțťŧ", "t"), ("ùúûüũūŭůűųǔ", "u"), ("ŵ", "w"), ("ýÿŷ", "y"), ("źżž", "z"),
)
FROM = "".join(accented for accented, _ in FOLDS)
TO = "".join(plain * len(accented) for accented, plain in FOLDS)
WORD = r"[\p{L}\p{M}\p{N}]+"


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), FROM, TO)


def words(text: Column) -> Column:
    """Runs of letters, marks and digits."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def allowed_edits(word: Column) -> Column:
    """Edits that a typed word may be away: none below four letters, one up to five, else two."""
    n = F.length(word)
    return F.when(n < 4, 0).when(n <= 5, 1).otherwise(2)
