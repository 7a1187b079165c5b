"""Typed queries read as words and a house number, as a fold of higher-order functions (STR-09)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD

#: What parts a query, and what counts as a number with a word glued to it, an ordinal, a house number, its suffix and a postcode.
APART = r"[\s,;]+"
GLUED = r"^(\d{1,4})([nsewNSEW]|\p{L}{2,})$"
ORDINAL = r"(?i)^\d+(?:st|nd|rd|th|e|er|re|eme|ème|º|ª|°|\.|a\.|o\.)$"
HOUSE = r"^(\d{1,4})(\p{L}|bis|ter|quater)?(?:[/\-](\d{1,4}\p{L}?|\p{L}))?$"
SUFFIX = r"^(?:[a-dA-Dа-гА-Г]|bis|ter|quater)$"
PLAIN = r"^\d{1,4}$"
POSTCODE = r"^\d{5,}$"
FOUR, TWO = r"^\d{4}$", r"^[A-Za-z]{2}$"
MOST_WORDS = 8


def tokens(text: Column) -> Column:
    """What lies between blanks, commas and semicolons, a number parted from a word or a letter of the compass that is glued to it."""
    apart = F.filter(F.split(F.coalesce(text, F.lit("")), APART), lambda t: t != "")
    part = lambda t, i: F.regexp_extract(t, GLUED, i)
    return F.flatten(F.transform(apart, lambda t: F.when(t.rlike(GLUED) & ~t.rlike(ORDINAL), F.array(part(t, 1), part(t, 2))).otherwise(F.array(t))))


def parsed(listed: Column, number_as_name: bool = False) -> Column:
    """``(words, house_number, number)`` of an array of ``tokens``, which should be a column, as it is used many times.

    A house number is the first number, with or without a letter, wherever there is a word for it; an ordinal is a word; a
    postcode beside words is left out. With ``number_as_name`` the first plain number is a word. Eight words at most.
    """
    word = lambda t: t.rlike(ORDINAL) | (t.rlike(r"\p{L}") & ~t.rlike(HOUSE) & ~t.rlike(SUFFIX))
    named = F.exists(listed, word)
    at = lambda i: F.coalesce(F.get(listed, i), F.lit(""))
    dutch = lambda i: (at(i).rlike(FOUR) & at(i + 1).rlike(TWO)) | ((i > 0) & at(F.greatest(i - 1, F.lit(0))).rlike(FOUR) & at(i).rlike(TWO))
    none = F.lit(None).cast("string")

    def step(s: Column, i: Column) -> Column:
        t = at(i)
        state = lambda words=s["words"], house=s["house"], number=s["number"], skip=F.lit(False), naming=s["naming"]: F.struct(
            words.alias("words"), house.alias("house"), number.alias("number"), skip.alias("skip"), naming.alias("naming")
        )
        plain = t.rlike(PLAIN)
        suffixed = plain & at(i + 1).rlike(SUFFIX)
        house = F.when(suffixed, F.concat(t, F.lit(" "), at(i + 1))).otherwise(t)
        return (
            F.when(s["skip"] | (named & dutch(i)), state())
            .when(s["naming"] & plain, state(words=F.concat(s["words"], F.array(t)), naming=F.lit(False)))
            .when(named & s["house"].isNull() & ~t.rlike(ORDINAL) & t.rlike(HOUSE), state(house=house, number=F.regexp_extract(t, HOUSE, 1).cast("int"), skip=suffixed))
            .when(named & t.rlike(POSTCODE), state())
            .otherwise(state(words=F.concat(s["words"], F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))))
        )

    places = F.when(F.size(listed) > 0, F.sequence(F.lit(0), F.size(listed) - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.array().cast("array<string>").alias("words"), none.alias("house"), F.lit(None).cast("int").alias("number"), F.lit(False).alias("skip"), F.lit(number_as_name).alias("naming"))
    return F.aggregate(places, start, step, lambda s: F.struct(F.slice(s["words"], 1, MOST_WORDS).alias("words"), s["house"].alias("house_number"), s["number"].alias("number")))
