"""Cyrillic and Greek names in the Latin letters that a rider types for them (STR-03), and the score of a found place (SRT-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD

#: What is written for a group of letters at the start of a word, for a group anywhere, and for a letter.
STARTS = {"μπ": "b", "ντ": "d", "γκ": "g"}
DIGRAPHS = {"ου": "ou", "ού": "ou", "αυ": "av", "αύ": "av", "ευ": "ev", "εύ": "ev", "ηυ": "iv", "ηύ": "iv"}
LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ъ": "a", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "є": "ye", "і": "i", "ї": "yi", "ґ": "g", "ў": "u", "ђ": "dj", "ј": "j",
    "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz", "ѓ": "gj", "ќ": "kj", "ѕ": "dz",
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "µ": "m", "ϐ": "v", "ϑ": "th", "ϕ": "f", "ϖ": "p", "ϰ": "k", "ϱ": "r", "ϵ": "e", "ι": "i",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o", "ά": "a", "έ": "e", "ή": "i", "ί": "i", "ό": "o", "ύ": "y", "ώ": "o", "ϊ": "i",
    "ϋ": "y", "ΐ": "i", "ΰ": "y",
}
#: Fixed values of the second spelling, for names with a letter that only Ukrainian writes.
STARTS_UK = {"є": "ye", "ї": "yi", "й": "y", "ю": "yu", "я": "ya"}
LETTERS_UK = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ie", "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ь": "", "ъ": "", "ы": "y", "э": "e", "ё": "yo", "ў": "u", "ђ": "dj", "ј": "j", "љ": "lj",
    "њ": "nj", "ћ": "c", "џ": "dz", "ѓ": "gj", "ќ": "kj", "ѕ": "dz",
}
ONLY_UKRAINIAN = "[іїєґІЇЄҐ]"

#: Fixed values of the score: steps of groups, distance, kinds, population, fame and a house number.
TIE_STEP, DISTANCE_WEIGHT, ADDRESS_BONUS = 0.001, 0.06, 0.25
PLACE_WEIGHTS = {"city": 0.10, "town": 0.07, "village": 0.04, "suburb": 0.03, "island": 0.03, "neighbourhood": 0.02, "hamlet": 0.01}
POPULATION_WEIGHT, POPULATION_CAP = 0.015, 0.1
FAME_FLOOR, FAME_WEIGHT, FAME_CAP = 5, 0.04, 0.25


def _starts(text: Column, table: dict[str, str]) -> Column:
    for letters, latin in table.items():
        text = F.regexp_replace(text, rf"(?<!\p{{L}}){letters}", latin)
    return text


def _letters(text: Column, table: dict[str, str]) -> Column:
    """Letter by letter: those of one Latin letter, or none, at once."""
    for letter, latin in table.items():
        if len(latin) > 1:
            text = F.replace(text, F.lit(letter), F.lit(latin))
    short = sorted(((k, v) for k, v in table.items() if len(v) < 2), key=lambda x: -len(x[1]))
    return F.translate(text, "".join(k for k, _ in short), "".join(v for _, v in short))


def translit(name: Column) -> Column:
    """A name in small Latin letters: word starts, then groups of letters, then letters; what is Latin stays."""
    text = _starts(F.lower(name), STARTS)
    for letters, latin in DIGRAPHS.items():
        text = F.replace(text, F.lit(letters), F.lit(latin))
    return _letters(text, LETTERS)


def translit_alt(name: Column) -> Column:
    """A name in the second Cyrillic spelling."""
    return translit(_letters(_starts(F.lower(name), STARTS_UK), LETTERS_UK))


def index_text(name: Column) -> Column:
    """What an index holds for a name: its Latin form, and after a Ukrainian one the words of the second spelling that it lacks."""
    words = lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    more = F.array_except(words(translit_alt(name)), words(translit(name)))
    return F.when(name.rlike(ONLY_UKRAINIAN), F.concat_ws(" ", translit(name), F.when(F.size(more) > 0, F.array_join(more, " ")))).otherwise(translit(name))


def place_score(quality: Column, rank: Column, km: Column, kind: Column, population: Column, importance: Column, address: Column, step: float = TIE_STEP) -> Column:
    """The score of a found row: how well its name answers, less its group's rank and its distance, and more for its kind, people, fame and house number.

    ``km`` is null without a place to search from, ``kind`` and ``population`` for rows that are no settlements.
    """
    weight = F.lit(0.0)
    for name, w in PLACE_WEIGHTS.items():
        weight = F.when(kind == name, w).otherwise(weight)
    people = F.when(kind.isNotNull(), F.least(F.lit(POPULATION_CAP), POPULATION_WEIGHT * F.log10(1 + F.coalesce(population, F.lit(0)))))
    fame = F.coalesce(importance, F.lit(0)) - FAME_FLOOR
    famous = F.when(fame > 0, F.least(F.lit(FAME_CAP), FAME_WEIGHT * F.log2(1 + fame))).otherwise(0.0)
    away = F.coalesce(DISTANCE_WEIGHT * F.log2(1 + km), F.lit(0.0))
    return quality - rank * step - away + F.when(kind.isNotNull(), weight).otherwise(0.0) + F.coalesce(people, F.lit(0.0)) + famous + F.when(address, ADDRESS_BONUS).otherwise(0.0)
