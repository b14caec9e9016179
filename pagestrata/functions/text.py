"""Text expressions: trimming, byte cuts, phones, JSON and SQL literals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagestrata.rules import MAIL_PATTERN, PHONE_PATTERNS

# Characters with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\x0b\f\r \u0085  "
    "               　"
)


def quoted(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_trim(expression: str) -> str:
    return f"btrim({expression}, {quoted(WHITESPACE)})"


def trimmed(column: Column) -> Column:
    return F.btrim(column, F.lit(WHITESPACE))


def byte_cut(column: Column, limit: int) -> Column:
    """First ``limit`` bytes; a character cut in half at the end is dropped whole."""
    raw = column.cast("binary")
    cut = F.decode(F.substring(raw, F.lit(1), _whole(raw, limit)), "UTF-8")
    return F.when(F.octet_length(column) > limit, cut).otherwise(column)


def _whole(raw: Column, limit: int) -> Column:
    """Largest length up to ``limit`` after which a new character starts."""
    return (
        F.when(~_is_continuation(raw, limit + 1), limit)
        .when(~_is_continuation(raw, limit), limit - 1)
        .when(~_is_continuation(raw, limit - 1), limit - 2)
        .otherwise(limit - 3)
    )


def _is_continuation(raw: Column, position: int) -> Column:
    return F.hex(F.substring(raw, position, 1)).rlike("^[89AB]")


def likely_phone(column: Column) -> Column:
    """At least seven digits and a plus sign or an opening bracket."""
    digits = F.length(F.regexp_replace(column, "[^0-9]", ""))
    return (digits >= 7) & (column.contains("+") | column.contains("("))


def sql_likely_phone(t: str) -> str:
    return f"(length(regexp_replace({t}, '[^0-9]', '')) >= 7 AND (contains({t}, '+') OR contains({t}, '(')))"


def valid_phone(column: Column) -> Column:
    """A run of five digits once everything but digits and plus signs is dropped."""
    return F.regexp_replace(column, "[^0-9+]", "").rlike("[0-9]{5,}")


def sql_valid_phone(t: str) -> str:
    return f"(regexp_replace({t}, '[^0-9+]', '') RLIKE '[0-9]{{5,}}')"


# One character before the at sign tells as much as a run of them, and is found in linear time.
_MAIL = MAIL_PATTERN.replace("]+@", "]@")


def sql_has_contact(t: str) -> str:
    return "(" + " OR ".join(f"{t} RLIKE {quoted(p)}" for p in (*PHONE_PATTERNS, _MAIL)) + ")"


def has_contact(column: Column) -> Column:
    """Text holds a phone number or a mail address."""
    found = column.rlike(_MAIL)
    for pattern in PHONE_PATTERNS:
        found = column.rlike(pattern) | found
    return found


def html_safe_json(column: Column) -> Column:
    """JSON text with the characters that are special in HTML written as escapes."""
    for char, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        column = F.replace(column, F.lit(char), F.lit(code))
    return column


def json_string(column: Column) -> Column:
    """Quoted JSON form of one string; null stays null."""
    packed = F.to_json(F.array(column))
    return F.when(column.isNotNull(), F.substring(packed, F.lit(2), F.length(packed) - 2))
