"""Text, phone, email and date expressions (Column -> Column, all JVM-side)."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import hints

_SPACE = r"[\s\x1c-\x1f]"

# Shape of the text (its first group is the date) -> parser pattern. The shape test runs first so
# that at most one parser sees a value and a text that is no date never reaches one.
_TIME = r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?)?$"
_MONTH = (
    r"(?:[Jj]an(?:uary)?|[Ff]eb(?:ruary)?|[Mm]ar(?:ch)?|[Aa]pr(?:il)?|[Mm]ay|[Jj]une?|[Jj]uly?|[Aa]ug(?:ust)?|"
    r"[Ss]ept?(?:ember)?|[Oo]ct(?:ober)?|[Nn]ov(?:ember)?|[Dd]ec(?:ember)?)\.?"
)
DATE_SHAPES = [
    (r"^(\d{4}-\d{1,2}-\d{1,2})" + _TIME, "yyyy-M-d"),
    (r"^(\d{4}/\d{1,2}/\d{1,2})" + _TIME, "yyyy/M/d"),
    (r"^(\d{1,2}/\d{1,2}/\d{4})" + _TIME, "M/d/yyyy"),
    (r"^(\d{8})(?:[ T]\d{2}:?\d{2}(?::?\d{2})?Z?)?$", "yyyyMMdd"),
    (rf"^({_MONTH} \d{{1,2}},? \d{{4}})" + _TIME, "MMM d yyyy"),
    (rf"^(\d{{1,2}} {_MONTH},? \d{{4}})" + _TIME, "d MMM yyyy"),
]


def trim_spaces(c: Column) -> Column:
    """Cut Unicode white space at both ends (plain ``trim`` only cuts blanks)."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """True for text made of white space only; null stays null."""
    return trim_spaces(c) == ""


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"\P{Nd}", "")


def text_key(c: Column) -> Column:
    """Comparison key: lower case, no punctuation, single blanks, common words abbreviated."""
    key = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]+", "")
    key = F.trim(F.regexp_replace(key, r"[\s\x0b\x1c-\x1f\x85\p{Z}]+", " "))
    # few texts hold any of the words: plain searches decide whether the rewrites run
    has_word = reduce(lambda a, b: a | b, [key.contains(w) for w in hints.ABBREVIATIONS])
    short = reduce(
        lambda k, w: F.regexp_replace(k, rf"(?U)\b{w[0]}\b", w[1]), hints.ABBREVIATIONS.items(), key
    )
    return F.when(has_word, short).otherwise(key)


def phone_digits(c: Column) -> Column:
    """Eleven digits from 1 when the text holds exactly those, else the text as it is."""
    digits = digits_of(c)
    return F.when(digits.rlike(r"^1\p{Nd}{10}\z"), digits).otherwise(c)


def email_text(c: Column) -> Column:
    return F.lower(trim_spaces(c))


def parse_date(c: Column) -> Column:
    """Date of a text in one of DATE_SHAPES (month first where ambiguous), else null."""
    parsed = F.lit(None).cast("date")
    for shape, pattern in reversed(DATE_SHAPES):
        date = F.regexp_extract(c, shape, 1)
        if "MMM" in pattern:  # month names by their first three letters, no comma or dot
            date = F.initcap(F.regexp_replace(F.regexp_replace(date, "[.,]", ""), "([A-Za-z]{3})[a-z]*", "$1"))
        value = F.try_to_date(date, pattern)
        parsed = F.when(c.rlike(shape), value).otherwise(parsed)
    return parsed


def date_text(c: Column) -> Column:
    """``yyyy-MM-dd`` where the text is a date, else the text as it is."""
    return F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), c)


def matches(c: Column, pattern: str) -> Column:
    r"""``rlike`` with Unicode-aware ``\w`` and ``\b`` but ASCII digits."""
    return c.rlike("(?U)" + pattern.replace(r"\d", "[0-9]"))


def value_class(c: Column) -> Column:
    """'integer', 'float', 'boolean' or 'string' for a text value; null for null."""
    return (
        F.when(c.isNull(), F.lit(None))
        .when(c.rlike(r"^\s*[+-]?\d+\s*$"), "integer")
        .when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), "float")
        .when(F.lower(c).isin("true", "false"), "boolean")
        .otherwise("string")
    )


def variant_sql_type(found: str) -> str:
    """A type of the merged variants as the JSON reader would have it."""
    parts = re.split(r"(`(?:[^`]|``)*`)", found)

    def as_read(part: str) -> str:
        part = re.sub(r"DECIMAL\((\d+),(\d+)\)", lambda m: "DOUBLE" if m[2] != "0" else ("BIGINT" if int(m[1]) < 19 else m[0]), part)
        return re.sub(r"\b(VOID|VARIANT)\b", "STRING", part.replace("OBJECT<", "STRUCT<"))

    return "".join(p if i % 2 else as_read(p) for i, p in enumerate(parts))
