"""Text cleaning, list parsing and document assembly."""

from __future__ import annotations

import ast
from html.entities import html5, name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.vectors import bound

# White space of Unicode plus the four separator controls.
SPACE = r"(?U)[\s\x1c-\x1f]"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
TAG = r"<[^>]+>"
LINK = rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
SEPARATOR = " [SEP] "
LIST_SEPARATORS = (",", ";", "|")
MARK = "\u0001"
# Quoted text with the escapes that list writers use, and constants that are spelled as they are shown.
ESCAPED = r"(?:\\[\\'\"nrt]"
QUOTED = "|".join(rf"{q}[^{q}\\\n\r]*+{ESCAPED}[^{q}\\\n\r]*+)*+{q}" for q in ("'", '"'))
CONSTANT = "-?[1-9][0-9]*|0|True|False|None"


# What a character reference may look like.
REFERENCE = r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
REPLACED = 0xFFFD


def _names(table: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\u0002".join(f"{k}\u0001{v}" for k, v in table.items())), F.lit("\u0002"), F.lit("\u0001"))


def _character(code: Column) -> Column:
    """The character of a code point; the mark in front keeps U+FEFF itself."""
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code.cast("long")), 8, "0"))), "UTF-32")


def _numeric_reference(ref: Column) -> Column:
    """Text of ``#…`` as browsers read it: codes 128 to 159 are those of Windows-1252, controls and non-characters vanish."""
    digits = F.regexp_extract(ref, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    base16 = ref.rlike("^#[xX]")
    number = F.when(base16, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
    code = F.when(digits == "", F.lit(0)).when(F.length(digits) > 7, F.lit(0x110000)).otherwise(number)
    windows = [ord(bytes([i]).decode("cp1252", "ignore") or chr(i)) for i in range(0x80, 0xA0)]

    def read(n: Column) -> Column:
        absent = n.between(1, 8) | (n == 0x0B) | n.between(0x0E, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF)
        absent = absent | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        moved = F.get(F.array(*[F.lit(w) for w in windows]), (n - 0x80).cast("int"))
        known = F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit(REPLACED)).when(n.between(0x80, 0x9F), moved).otherwise(n)
        return F.when((n <= 0x10FFFF) & absent, F.lit("")).otherwise(_character(known))

    return bound(code, read)


def _named_reference(ref: Column) -> Column:
    """Text of a named reference, or of the longest old name in front that needs no semicolon; null if there is none."""
    old = {k: v for k, v in html5.items() if not k.endswith(";")}
    common = {f"{k};": html5[f"{k};"] for k in name2codepoint}
    front = F.regexp_extract(ref, "^(" + "|".join(sorted(old, key=len, reverse=True)) + ")", 1)
    whole = F.when(ref.endswith(";"), F.coalesce(F.try_element_at(_names(common), ref), F.try_element_at(_names(html5), ref)))
    rest = F.struct(front.alias("name"), ref.alias("ref"))
    part = bound(rest, lambda r: F.when(r["name"] != "", F.concat(F.try_element_at(_names(old), r["name"]), F.substr(r["ref"], F.length(r["name"]) + 1))))
    return F.coalesce(whole, part)


def unescape_html(c: Column) -> Column:
    """Replace character references, numeric and named, as browsers do; text without ``&`` stays as it is."""

    # What a lambda needs travels in its argument: arguments of a user's UDF may not hold lambdas that look outside.
    def replaced(p: Column) -> Column:
        text = F.when(p["ref"].startswith("#"), _numeric_reference(p["ref"])).otherwise(_named_reference(p["ref"]))
        whole = F.concat(text, F.substr(p["piece"], F.length(p["ref"]) + 2))
        return F.when(p["ref"] == "", p["piece"]).otherwise(F.coalesce(whole, p["piece"]))

    def decoded(piece: Column) -> Column:
        return bound(F.struct(piece.alias("piece"), F.regexp_extract(piece, REFERENCE, 1).alias("ref")), replaced)

    pieces = F.transform(F.split(c, "(?=&)"), decoded)
    return F.when(c.contains("&"), F.array_join(pieces, "")).otherwise(c)


def missing(c: Column, data_type: T.DataType | None = None) -> Column:
    """Null test that also covers NaN for floating columns."""
    if isinstance(data_type, T.FloatType | T.DoubleType):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^(?:{SPACE})+|(?:{SPACE})+$", "")


def clean_text(c: Column) -> Column:
    """Plain lower-case text: entities, tags and links removed, spaces collapsed."""
    text = F.lower(unescape_html(F.coalesce(c.cast("string"), F.lit(""))))
    text = F.regexp_replace(text, TAG, " ")
    text = F.regexp_replace(text, LINK, " ")
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def text_document(columns: list[str], max_tokens: int | None = None) -> Column:
    """One document per row from several text columns, each led by its name.

    Whole texts by default; ``max_tokens`` keeps the first words only, for an
    encoder with a bounded input.
    """
    parts = []
    for name in columns:
        cleaned = clean_text(F.col(name))
        parts.append(F.when(cleaned != "", F.concat(F.lit(f"{name}: "), cleaned)))
    document = F.array_join(F.array_compact(F.array(*parts)), SEPARATOR)
    if max_tokens is None:
        return document
    return F.array_join(F.slice(F.split(document, " "), 1, max_tokens), " ")


def category(c: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal_items(text: pd.Series) -> pd.Series:
    return text.map(_parse_literal, na_action="ignore")


def _parse_literal(text: str) -> list[str] | None:
    try:
        parsed = ast.literal_eval(text)
    except (SyntaxError, ValueError):
        return None
    return [str(item) for item in parsed] if isinstance(parsed, list | tuple | set) else None


def _shown(item: Column) -> Column:
    inner = F.substring(item, 2, F.length(item) - 2)
    plain = F.replace(inner, F.lit("\\\\"), F.lit(MARK))
    for sign, meant in (("'", "'"), ('"', '"'), ("n", "\n"), ("r", "\r"), ("t", "\t")):
        plain = F.replace(plain, F.lit(f"\\{sign}"), F.lit(meant))
    plain = F.replace(plain, F.lit(MARK), F.lit("\\"))
    return F.when(~item.rlike("^['\"]"), item).when(inner.contains("\\"), plain).otherwise(inner)


def literal_list(c: Column) -> Column:
    """Items of a list written as text, or null if the text is no list literal.

    Flat lists of quoted strings, whole numbers and constants are read by expressions; any other text
    in brackets (nested lists, fractions, rare escapes) goes to Python's literal parser.
    """
    text = strip(c)
    bracketed = text.startswith("[") & text.endswith("]")
    skeleton = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, QUOTED, MARK), CONSTANT, MARK), SPACE, "")
    plain = (
        ~text.contains(MARK)
        & skeleton.rlike(rf"^\[[,{MARK}]*\]$")
        & ~skeleton.contains(MARK + MARK)
        & ~skeleton.contains(",,")
        & ~skeleton.contains("[,")
    )
    written = F.regexp_extract_all(text, F.lit(f"({QUOTED}|{CONSTANT})"), 1)
    by_rule = F.transform(written, _shown)
    by_parser = _literal_items(F.when(bracketed & ~plain, text))
    return F.when(bracketed, F.when(plain, by_rule).otherwise(by_parser))


def _nonblank(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda t: t != "")


def list_tokens(c: Column, data_type: T.DataType | None = None) -> Column:
    """Tokens of a list-like value: list literal, else split by the first separator found."""
    if isinstance(data_type, T.ArrayType):
        return F.coalesce(_nonblank(F.transform(c, lambda x: x.cast("string"))), F.array().cast("array<string>"))
    if data_type is not None and not isinstance(data_type, T.StringType):
        return F.when(missing(c, data_type), F.array().cast("array<string>")).otherwise(F.array(strip(c.cast("string"))))
    text = strip(c)
    tokens = F.array(text)
    for sign in reversed(LIST_SEPARATORS):
        pieces = F.split(text, f"[{sign}]")
        tokens = F.when(text.contains(sign), _nonblank(pieces)).otherwise(tokens)
    tokens = F.coalesce(_nonblank(literal_list(c)), tokens)
    return F.when(c.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(tokens)


def flatten_list_text(c: Column) -> Column:
    """Text of a list literal joined by spaces; any other value unchanged."""
    return F.coalesce(F.array_join(_nonblank(literal_list(c)), " "), c)


def tokens_of(df: DataFrame, column: str) -> Column:
    return list_tokens(F.col(column), df.schema[column].dataType)
