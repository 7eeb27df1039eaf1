"""Text normalisation, number words, aliases and token sets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# English number words.
SMALL_NUMBERS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
    "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")

# Contractions written out before punctuation is dropped.
CONTRACTIONS = (("don't", "do not"), ("that's", "that is"), ("it's", "it is"), ("can't", "cannot"))

# Word forms treated as one token.
WORD_FORMS = {
    "untwisting": "untwist",
    "untwisted": "untwist",
    "cables": "cable",
    "icing": "ice",
    "lubricating": "lubrication",
    "generators": "generator",
    "alarms": "alarm",
    "temperatures": "temperature",
}


def _fold_udf():
    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    return fold


def casefolded(text: Column) -> Column:
    """Compatibility-normalised, case-folded text.

    For ASCII both steps equal ``lower``, which stays in the JVM; only other text takes the
    Arrow-batched Python path.
    """
    ascii_only = text.rlike(r"^\p{ASCII}*$")
    other = F.when(~ascii_only, text)
    return F.when(text.isNull() | ascii_only, F.lower(text)).otherwise(_fold_udf()(other))


def normalize(text: Column, folded: bool = False) -> Column:
    """Lower-case words of letters and digits, one space apart, contractions written out."""
    out = F.replace(text if folded else casefolded(text), F.lit("’"), F.lit("'"))
    for short, long in CONTRACTIONS:
        out = F.replace(out, F.lit(short), F.lit(long))
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def strip(text: Column | str) -> Column:
    """Text without any Unicode white space at its ends."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whole-word containment of a normalised phrase."""
    space = F.lit(" ")
    return F.contains(F.concat(space, text, space), F.concat(space, phrase, space))


def token_set(normalized: Column) -> Column:
    """Distinct tokens of normalised text with word forms unified."""
    text = F.replace(F.replace(normalized, F.lit("windspeed"), F.lit("wind speed")), F.lit("cutin"), F.lit("cut in"))
    forms = F.create_map(*[F.lit(x) for pair in WORD_FORMS.items() for x in pair])
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(forms, w), w)))


def number_words(number: Column) -> Column:
    """English words of 0..99, else null."""
    small = F.array(*[F.lit(w) for w in SMALL_NUMBERS])
    tens = F.array(*[F.lit(w) for w in TENS])
    ten = F.try_element_at(tens, F.floor(number / 10).cast("int") - 1)
    unit = F.try_element_at(small, (number % 10).cast("int") + 1)
    return (
        F.when((number >= 0) & (number < 20), F.try_element_at(small, number.cast("int") + 1))
        .when((number >= 20) & (number < 100), F.when(number % 10 == 0, ten).otherwise(F.concat_ws(" ", ten, unit)))
    )


def label_aliases(label: Column) -> Column:
    """Spoken and written forms of a station label; numbered labels get all number forms.

    Fixed values: the written and spoken forms.
    """
    digits = F.regexp_extract(label, r"^[Tt](\d+)$", 1)
    number = digits.try_cast("bigint")
    n = number.cast("string")
    words = number_words(number)
    forms = F.array(
        F.lower(label),
        F.concat(F.lit("t"), n),
        F.concat(F.lit("t "), n),
        F.concat(F.lit("turbine"), n),
        F.concat(F.lit("turbine "), n),
        F.when(number.isNotNull(), F.concat(F.lit("turbine "), digits)),
        F.concat(F.lit("number "), n),
        F.when(number.isNotNull(), F.concat(F.lit("number "), digits)),
        F.concat(F.lit("turbine "), words),
        F.concat(F.lit("number "), words),
    )
    return F.array_sort(F.array_distinct(F.array_compact(forms)))


def table_prefix(file_name: Column) -> Column:
    """Table name of a monthly file ``{table}_{year}_{month}.csv``."""
    return F.nullif(F.regexp_extract(file_name, r"^(.+)_\d{4}_\d{2}\.csv$", 1), F.lit(""))


def file_year(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"_(\d{4})_\d{2}\.csv$", 1).try_cast("int")


def file_month(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"_\d{4}_(\d{2})\.csv$", 1).try_cast("int")
