"""Text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.bind import bound

#: Endings of registered company names, without the breaks that punctuation leaves.
CORPORATE_ENDINGS = ("as", "sa", "ltd", "limited", "coltd", "inc", "corp", "co", "gmbh", "spa", "srl", "llc", "plc", "bv", "nv", "ag", "sas", "ab", "oy", "pteltd", "sl", "ltda", "ae")
MOST_ENDING_WORDS = 3


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def name_words(x: Column | str) -> Column:
    """All runs of letters a-z and digits of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit("[a-z0-9]+"), F.lit(0))


def name_key(x: Column | str) -> Column:
    """The words of a name, joined by blanks."""
    return F.array_join(name_words(x), " ")


def company_key(x: Column | str) -> Column:
    """The words of a name without one corporate ending, the longest that fits; never without all of them."""
    words = name_words(x)
    size = F.size(words)
    dropped = F.lit(0)
    for n in range(1, MOST_ENDING_WORDS + 1):  # later conditions win, so longer endings do
        ending = F.array_join(F.slice(words, F.greatest(size - n + 1, F.lit(1)), F.lit(n)), "")
        dropped = F.when((size > n) & ending.isin(*CORPORATE_ENDINGS), n).otherwise(dropped)
    return F.array_join(F.slice(words, F.lit(1), size - dropped), " ")


def word_runs(x: Column | str, most: int = 5) -> Column:
    """All runs of one to `most` neighbouring words of a name, each once."""
    none = F.array().cast("array<int>")

    def runs(words: Column) -> Column:
        size = F.size(words)

        def of(n: int) -> Column:
            starts = F.when(size >= n, F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))).otherwise(none)
            return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

        return F.array_distinct(F.flatten(F.array(*map(of, range(1, most + 1)))))

    return bound(name_words(x), runs)


def ship_numbers(x: Column | str) -> Column:
    """Seven-digit identification numbers."""
    return F.regexp_extract_all(_c(x), F.lit(r"\b\d{7}\b"), F.lit(0))


def capitalised_words(x: Column | str) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(r"\b[A-Z][A-Za-z0-9]+"), F.lit(0))


def holds_whole_words(key: Column | str, wanted: Column | str) -> Column:
    """Whether `wanted` stands in `key` as whole words; an empty one stands nowhere."""
    inside = F.concat(F.lit(" "), _c(key), F.lit(" ")).contains(F.concat(F.lit(" "), _c(wanted), F.lit(" ")))
    return (_c(wanted) != "") & inside


def mentions(x: Column | str, terms: list[str]) -> Column:
    """Whether the words of a text hold one of the terms as whole words."""
    text = F.concat(F.lit(" "), name_key(x), F.lit(" "))
    found = F.lit(False)
    for t in terms:
        found = found | text.contains(f" {t} ")
    return found


def figure(x: Column | str) -> Column:
    """A number, or null for blanks and words."""
    return F.expr("try_cast(NULLIF(TRIM(v), '') AS DOUBLE)".replace("v", x)) if isinstance(x, str) else x.try_cast("double")


def listed_points(x: Column | str) -> Column:
    """Labels of the points that lines open with, such as (e) or (15)."""
    return F.regexp_extract_all(_c(x), F.lit(r"(?m)^\(([0-9a-z]+)\) "), F.lit(1))


def clean_text(x: Column | str) -> Column:
    """Without amendment marks and empty brackets, runs of any white space as one blank."""
    text = F.regexp_replace(_c(x), r"(?U)[▼►]\s*[A-Z]+\d*|◄", " ")
    text = F.regexp_replace(text, r"(?U)\s*\(\s*\)", "")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_scripts(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?is)<script\b[^>]*>.*?</script\s*>", "")


def holds_drawn_formulas(x: Column | str) -> Column:
    """Whether a page shows formulas as inline images, so that their markup is needed."""
    return _c(x).contains('src="data:image')


def plain_blanks(x: Column | str) -> Column:
    """Non-breaking spaces as blanks."""
    return F.translate(_c(x), "\u00a0", " ")


def markdown_table(x: Column | str) -> Column:
    """Lines of cells parted by ` | ` as a markdown table whose first line is the header."""
    lines = F.transform(F.split(_c(x), "\n"), lambda line: F.concat(F.lit("| "), line, F.lit(" |")))
    cells = F.size(F.split(F.element_at(F.split(_c(x), "\n"), 1), r" \| ", -1))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), cells))
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.array_join(F.concat(F.array(F.element_at(lines, 1), rule), rest), "\n")


def normalised_question(x: Column | str) -> Column:
    """A question as answers are kept by: one case, one blank between words, no closing marks.

    The JVM has no compatibility normalisation; functions.normal.question_key has, for texts beyond ASCII.
    """
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(_c(x)), r"(?U)\s+", " ")), r"[\s?!.]+$", "")


def marker_numbers(x: Column | str) -> Column:
    """The numbers of citation markers [n], each once, in order of first use."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(x), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.try_cast("int")))


def without_markers(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"\s*\[\d+\]", "")


def described_arguments(x: Column | str) -> Column:
    """The values of a map that aren't empty, joined by dots."""
    return F.array_join(F.filter(F.map_values(_c(x)), lambda v: v.isNotNull() & (v != "")), " · ")


def failure_reason(kind: Column | str, message: Column | str, most: int = 500) -> Column:
    return F.substring(F.concat(_c(kind), F.lit(": "), F.coalesce(_c(message), F.lit(""))), 1, most)


def short_hashes(x: Column | str, size: int = 12) -> Column:
    return F.transform(_c(x), lambda h: F.left(h, F.lit(size)))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns' canonical JSON: names in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
