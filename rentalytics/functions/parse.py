"""Column builders for parsing raw text columns.

All of these are native Spark expressions (whole-stage codegen, no Python
per row).  NaN never leaves this module: anything pandas would coerce to a
missing value becomes SQL NULL here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TRUTHY_TEXT

# Text accepted as a number between white space: optional sign, decimal or
# exponent form.  Rejects '1d', '1,000', 'nan' and ''.  Infinity literals are
# accepted only without surrounding white space, and a finite-looking number
# that overflows is missing - the coercing parse of the reference behaves the
# same way.  (``\z``: Java's ``$`` would also match before a trailing newline.)
# Casts skip white space themselves, so the text is matched once and never copied.
NUMERIC_TEXT = r"(?i)^\s*+[+-]?+(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:e[+-]?+[0-9]++)?+\s*+\z"
INFINITY_TEXT = r"(?i)^[+-]?(?:inf|infinity)\z"
# Dates that need no pattern of their own: the cast reads them like the formatter.
PLAIN_DATE = r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}\z"
TRUTHY = r"(?i)^\s*+(?:" + "|".join(TRUTHY_TEXT) + r")\s*+\z"

# Largest magnitude that safely converts to BIGINT.
_BIGINT_SAFE = 9 * 10 ** 18


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric_text(c) -> Column:
    """Text -> DOUBLE the way a coercing numeric parse does; junk -> NULL."""
    raw = _col(c).cast("string")
    value = raw.try_cast("double")
    return (F.when(F.abs(value) != F.lit(float("inf")), F.when(raw.rlike(NUMERIC_TEXT), value))
            .when(raw.rlike(INFINITY_TEXT), value))


def integral_text(c) -> Column:
    """Text -> BIGINT: the exact integer text, else a whole-valued number."""
    raw = _col(c).cast("string")
    value = raw.try_cast("double")
    whole = value.try_cast("bigint")
    return F.coalesce(raw.try_cast("bigint"), F.when(
        (whole == value) & whole.between(-_BIGINT_SAFE + 1, _BIGINT_SAFE - 1) & raw.rlike(NUMERIC_TEXT), whole))


def price_text(c) -> Column:
    """'$1,250.00' -> 1250.0: keep digits and dots, then parse; no digit -> NULL."""
    return F.regexp_replace(_col(c), r"[^0-9.]", "").try_cast("double")


def tf_flag(c) -> Column:
    """'t' -> true, 'f', NULL and anything else -> false."""
    return F.coalesce(_col(c) == F.lit("t"), F.lit(False))


def truthy_int(c) -> Column:
    """Any value -> 1 if its text is one of TRUTHY_TEXT, else 0 (NULL -> 0)."""
    return F.when(_col(c).cast("string").rlike(TRUTHY), F.lit(1)).otherwise(F.lit(0))


def amenity_count(c) -> Column:
    """Separator count + 1 on the raw list text; NULL and '[]' both give 1."""
    text = F.coalesce(_col(c), F.lit("[]"))
    return (F.regexp_count(text, F.lit(",")) + F.lit(1)).cast("bigint")


# A Python list literal of strings, by its tokens.  Every quantifier is possessive, so the matcher neither
# goes back nor recurses, however long the text is.
_BODY = r"[^{q}\\\n]*+(?:\\(?s:.)[^{q}\\\n]*+)*+"
_LONG_BODY = r"(?:[^{q}\\]++|\\(?s:.)|{q}(?!{q}{q}))*+"
_STRING = "[rRuU]?+(?:" + "|".join(
    [f"{q * 3}{_LONG_BODY.format(q=q)}{q * 3}" for q in "'\""] + [f"{q}(?!{q}{q}){_BODY.format(q=q)}{q}" for q in "'\""]) + ")"
_TOKEN = rf"{_STRING}|[ \t\n\r\f]++|#[^\n]*+|(?s:.)"
_LIST_SHAPE = r"^\[(?:s++(?:,s++)*+,?+)?+\]$"  # s: a string; strings side by side are one
_UNIT = (r"[^\\]++|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}"
         r"|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\(?s:.)")
# The escapes of one letter.
_LETTER_ESCAPES = {"\n": "", "\\": "\\", "'": "'", '"': '"', "a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r",
                   "t": "\t", "v": "\v"}
# Between two items of the decoded list, and what stands for its first letter inside an item.
_ITEM_END, _MARK, _MARK_INSIDE = "\x01;", "\x01", "\x01."


def _letter(code: Column) -> Column:
    """Code point -> text; half a surrogate pair is U+FFFD, no code point NULL."""
    code = F.when(code.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(code)
    return F.when(code <= 0x10FFFF, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _unescaped(unit: Column) -> Column:
    """One unit of a string's body: plain text as it is, an escape decoded, a wrong one NULL."""
    kind, rest = F.substring(unit, 2, 1), F.substring(unit, 3, 10)
    out = F.when(~F.startswith(unit, F.lit("\\")), unit)
    out = out.when(F.char_length(unit) == 12, F.decode(F.unhex(F.concat(F.substring(unit, 3, 4), F.substring(unit, 9, 4))), "UTF-16BE"))
    out = out.when(kind.isin("x", "u", "U"), F.when(rest != "", _letter(F.conv(rest, 16, 10).cast("bigint"))))
    out = out.when(kind.rlike("[0-7]"), _letter(F.conv(F.substring(unit, 2, 3), 8, 10).cast("bigint")))
    out = out.when(kind == "N", F.lit(None).cast("string"))
    for escape, text in _LETTER_ESCAPES.items():
        out = out.when(kind == escape, F.lit(text))
    return out.otherwise(unit)


def _string_value(token: Column) -> Column:
    """A string token's text: prefix and quotes off, escapes decoded unless raw."""
    quoted = F.regexp_replace(token, "^[rRuU]", "")
    ends = F.when(quoted.rlike("^(?:\'\'\'|\"\"\")"), 3).otherwise(1)
    body = F.substring(quoted, ends + 1, F.char_length(quoted) - 2 * ends)
    units = F.transform(F.regexp_extract_all(body, F.lit(_UNIT), F.lit(0)), _unescaped)
    decoded = F.when(~F.exists(units, lambda u: u.isNull()), F.array_join(units, ""))
    return F.when(F.lower(F.substring(token, 1, 1)) == "r", body).when(~body.contains("\\"), body).otherwise(decoded)


def _string_list(text: Column) -> Column:
    """Text of a Python list literal of strings -> ARRAY<STRING>; anything else NULL."""
    tokens = F.filter(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: ~t.rlike("^[ \t\n\r\f#]"))
    shape = F.array_join(F.transform(tokens, lambda t: F.when(F.char_length(t) > 1, "s").otherwise(t)), "")
    values = F.transform(F.filter(tokens, lambda t: ~t.isin("[", "]")), lambda t: F.when(t == ",", F.lit(_ITEM_END)).otherwise(
        F.replace(_string_value(t), F.lit(_MARK), F.lit(_MARK_INSIDE))))
    joined = F.regexp_replace(F.array_join(values, ""), f"{_ITEM_END}$", "")  # a trailing comma
    trailing = shape.endswith(",]")
    joined = F.when(trailing, joined).otherwise(F.array_join(values, ""))
    items = F.transform(F.split(joined, _ITEM_END), lambda i: F.replace(i, F.lit(_MARK_INSIDE), F.lit(_MARK)))
    items = F.when(shape == "[]", F.array().cast("array<string>")).otherwise(items)
    return F.when(shape.rlike(_LIST_SHAPE) & ~F.exists(values, lambda v: v.isNull()), items)


def amenity_list(c) -> Column:
    """Raw list text -> ARRAY<STRING>; NULL or malformed -> empty array.

    A list literal of strings as Python reads it: either quote, three of them,
    prefixes r and u, strings side by side, every escape but names (a half
    surrogate pair is U+FFFD, a whole one its letter), comments, a trailing
    comma.  Plain lists, without backslash or inner bracket, go through the JSON reader; so do
    lists with numbers, which come out as text.
    """
    text = _col(c)
    plain = F.regexp_replace(text, r",\s*\]\s*\z", "]")
    parsed = F.when(~text.contains("\\") & plain.rlike(r"^\s*\[[^\[\]]*+\]\s*\z"),
                    F.from_json(plain, "array<string>", {"allowSingleQuotes": "true"}))
    return F.coalesce(parsed, _string_list(text), F.array().cast("array<string>"))


def amenity_flag(c, name: str) -> Column:
    """Case-insensitive literal substring test on the raw list text."""
    text = F.coalesce(_col(c), F.lit("[]"))
    return F.upper(text).contains(F.lit(name.upper()))


def amenity_column_name(name: str) -> str:
    """Column name of one amenity flag."""
    return "amenity_" + name.replace(" ", "_").lower()


def date_text(c) -> Column:
    """'yyyy-MM-dd' text -> TIMESTAMP_NTZ at midnight; bad or impossible dates -> NULL."""
    text = _col(c)
    plain = F.when(text.rlike(PLAIN_DATE), text.try_cast("date")).otherwise(F.try_to_date(text, "yyyy-MM-dd"))
    return plain.cast("timestamp_ntz")


def nan_to_null(c) -> Column:
    """NaN -> NULL for a DOUBLE column (other values unchanged)."""
    col = _col(c)
    return F.when(~F.isnan(col), col)
