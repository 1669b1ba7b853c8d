"""Identifiers of legal acts as Column expressions. The year of reference is an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the kinds of acts, and the year from which every kind puts the year first.
LETTERS = {"regulation": "R", "directive": "L", "decision": "D"}
YEAR_FIRST_FROM = 2015
PAGE = "https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:"


def is_legislation(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^3[0-9]{4}[RLD][0-9]{4}\z"), F.lit(False))


def full_year(x: Column) -> Column:
    """Years of two digits are of the twentieth century."""
    return F.when(F.length(x) == 2, F.concat(F.lit("19"), x)).otherwise(x)


def as_year(x: Column, this_year: int) -> Column:
    """The year that a part of a citation means; null if it can only be an act's number."""
    year = full_year(x)
    number = F.when(year.rlike(r"^(19|20)[0-9]{2}\z"), year.cast("int"))
    return F.when(number <= this_year, number)


def number_and_year(kind: Column, first: Column, second: Column, this_year: int) -> Column:
    """struct<number, year> of a pair such as 765/2008.

    A half that can't be a year is the number. Where both could be, directives and decisions have the year first, and
    regulations from 2015 on; where neither could, the second is taken for the number.
    """
    one, two = as_year(first, this_year), as_year(second, this_year)
    first_is_year = F.when(one.isNotNull() & two.isNotNull(), F.lower(kind).isin("directive", "decision") | (one >= YEAR_FIRST_FROM)).otherwise(two.isNull())
    return F.struct(F.when(first_is_year, second).otherwise(first).alias("number"), F.when(first_is_year, first).otherwise(second).alias("year"))


def build(kind: Column, year: Column, number: Column, this_year: int) -> Column:
    """The identifier, or null where the parts make none."""
    letter = F.lower(kind)
    letter = F.coalesce(*(F.when(letter == k, v) for k, v in LETTERS.items()))
    # lpad would cut longer numbers short
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    made = F.concat(F.lit("3"), full_year(year), letter, padded)
    return F.when(as_year(year, this_year).isNotNull() & is_legislation(made), made)


def act_name(x: Column, title: Column) -> Column:
    """An act as it is cited; acts from before the year-first scheme as their title says, or else by identifier."""
    kind = F.coalesce(*(F.when(F.substring(x, 6, 1) == v, k.capitalize()) for k, v in LETTERS.items()))
    year = F.substring(x, 2, 4)
    cited = F.regexp_extract(F.coalesce(title, F.lit("")), r"^(?:(?:Commission|Council) )?(?:(?:Implementing|Delegated) )?((?:Regulation|Directive|Decision) (?:\([^)]+\) )?(?:No )?\d+/\d+(?:/[A-Za-z]+)?)\b", 1)
    new = F.concat(kind, F.lit(" (EU) "), year, F.lit("/"), F.substring(x, 7, 4).try_cast("int").cast("string"))
    return F.when(~is_legislation(x), x).when(year.try_cast("int") >= YEAR_FIRST_FROM, new).when(cited != "", cited).otherwise(x)


def page_url(x: Column) -> Column:
    return F.concat(F.lit(PAGE), x)


def consolidated_stem(x: Column) -> Column:
    """What the identifiers of an act's consolidated versions begin with."""
    return F.concat(F.lit("0"), F.substring(x, 2, 1 << 20), F.lit("-"))


def citation(article: Column, paragraph: Column, point: Column, annex: Column) -> Column:
    """'Article 6(2)', 'Article 3, point (e)', 'Annex I', 'Annex' for an unnumbered one, or an empty text."""
    base = F.when(article.isNotNull(), F.concat(F.lit("Article "), article, F.coalesce(F.concat(F.lit("("), paragraph, F.lit(")")), F.lit(""))))
    base = base.when(annex.isNotNull(), F.rtrim(F.concat(F.lit("Annex "), annex))).otherwise("")
    return F.concat(base, F.when(base != "", F.coalesce(F.concat(F.lit(", point ("), point, F.lit(")")), F.lit(""))).otherwise(""))
