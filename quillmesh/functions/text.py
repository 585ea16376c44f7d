"""Scalar text functions as Column builders: cleaning, keys, parsing and formatting."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value in raw tables.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _fold_table() -> tuple[str, str]:
    """Upper-case Latin letters with marks, and their base letters."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and "A" <= base[0] <= "Z" and all(unicodedata.category(m) == "Mn" for m in base[1:]):
            pairs[chr(code)] = base[0]
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_table()


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def squeeze_space(c: Column) -> Column:
    """Trim and collapse white space, non-breaking space included."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def fold_accents(c: Column) -> Column:
    """Upper-case Latin letters without their marks; combining marks are dropped."""
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"\p{Mn}", "")


def name_key(c: Column, sort_tokens: bool = True) -> Column:
    """Upper-case A-Z tokens of a name, sorted; null gives ''. A question mark stands for a lost letter N."""
    upper = fold_accents(F.replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit("?"), F.lit("N")))
    tokens = F.filter(F.split(F.regexp_replace(upper, "[^A-Z ]", ""), " "), lambda t: t != "")
    return F.array_join(F.array_sort(tokens) if sort_tokens else tokens, " ")


def clean_name(c: Column, brackets: bool = False) -> Column:
    """Names without . | / (and bracketed remarks), single spaces; null stays null."""
    c = F.replace(c, F.lit("\u00a0"), F.lit(" "))
    if brackets:
        c = F.regexp_replace(c, r"\(.*?\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[.|/]", ""), r"\s{2,}", " "))


def join_names(*parts: Column) -> Column:
    """Parts with single spaces between, a null part as ''; only the ends are trimmed."""
    filled = [x for p in parts for x in (F.lit(" "), F.coalesce(p, F.lit("")))][1:]
    return F.trim(F.concat(*filled))


def to_number(c: Column) -> Column:
    """A double, or null where the text is no plain decimal number."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def to_key(c: Column, missing: str = "S/E") -> Column:
    """A whole-number key from text; the sentinel and anything not a whole number is null."""
    number = to_number(F.nullif(c, F.lit(missing)))
    return F.when(number == F.floor(number), number.cast("long"))


def age_years(c: Column) -> Column:
    """Years from '12 años ...' or from plain digits, else null."""
    years = F.regexp_extract(c, r"(?iu)^(\d+)\s*año", 1)
    return F.when(years != "", years).when(c.rlike(r"^\d+$"), c).try_cast("long")


def parse_date(c: Column, formats: tuple[str, ...] = ("dd/MM/yyyy", "yyyy-MM-dd")) -> Column:
    """The first format that fits, day first; else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


def format_value(c: Column) -> Column:
    """Text of a value: null '', numbers rounded to two places without needless zeros, else trimmed text."""
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(NUMBER), text.try_cast("decimal(38,10)"))
    rounded = F.round(number, 2).cast("decimal(38,2)").cast("string")
    short = F.regexp_replace(F.regexp_replace(rounded, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(c.isNull(), "").when(number.isNotNull(), F.when(short == "-0", "0").otherwise(short)).otherwise(text)


def snake_case(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]", "_"), "_+", "_"), F.lit("_"))


#: Forms of a disease code, a history id and a numeric id.
CODE, HISTORY_ID, NUMERIC_ID = r"(?i)^[A-Z]\d{2}(\.\d{1,2})?$", r"^[A-Z]{3}\d{6}$", r"^\d+\.?0?$"


def plain_key(c: Column) -> Column:
    """Upper-case text without accents in its own word order, other signs kept; null gives ''."""
    return F.regexp_replace(fold_accents(F.upper(F.trim(F.coalesce(c, F.lit(""))))), r"\s+", " ")


def name_flags(c: Column) -> Column:
    """A struct: words of a name, whether they are two or five and more, and whether it has two spaces in a row."""
    n = token_count(c)
    return F.struct(n.cast("long").alias("n_tokens"), (n == 2).alias("two_tokens"), (n >= 5).alias("many_tokens"), F.coalesce(c.rlike("  +"), F.lit(False)).alias("multi_space"))


def to_flag(c: Column) -> Column:
    """0 or 1 as a whole number, from numbers, texts and booleans; anything else is null."""
    number = c.cast("string").try_cast("double")
    flag = F.coalesce(number, F.when(F.lower(c.cast("string")) == "true", 1.0).when(F.lower(c.cast("string")) == "false", 0.0))
    return F.when(flag.isin(0.0, 1.0), flag.cast("long"))


def visible_spaces(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"\s{2,}", "--"), F.lit(" "), F.lit("␣"))


def token_count(c: Column) -> Column:
    """Words between white space; 0 for empty or null."""
    return F.coalesce(F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")), F.lit(0))
