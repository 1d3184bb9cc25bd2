"""Field extraction from JSON bodies with one parse per body."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidelog.functions.binding import bound

# The keys read from a body, in table order.
BODY_KEYS = ("timestamp", "level", "message", "resourceID")

# Column that holds the text of each key. The raw time needs a name of its own: column
# names ignore case, and ``Timestamp`` is the parsed one.
TIME_TEXT = "time_text"
FIELD_COLUMNS = dict(zip(BODY_KEYS, (TIME_TEXT, "Level", "Message", "ResourceID")))

_OPTIONS = {
    "allowUnquotedControlChars": "true",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}


def parse_body(body: Column) -> Column:
    """The top-level keys of a body with the text of their values; NULL when the body is
    no JSON object. A map keeps every occurrence of a repeated key, and looking it up
    finds the first, which is the one that counts; a struct would keep the last."""
    return F.from_json(body, "map<string,string>", _OPTIONS)


def body_field(parsed: Column, key: str) -> Column:
    """Text of a key; absent and null give ''."""
    return F.coalesce(parsed[key], F.lit(""))


def looks_fractional(value: Column) -> Column:
    """Whether a text might come from a number with a fraction or an exponent."""
    first = F.ascii(value).between(ord("-"), ord("9"))
    return first & value.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?\z") & value.rlike("[.eE]")


def parse_tokens(body: Column) -> Column:
    """The top-level keys of a body with their values as JSON tokens, which tell a number
    from a text that looks like one. Control characters inside texts do not matter here."""
    return F.from_json(F.regexp_replace(body, r"[\x00-\x1f]", " "), "map<string,variant>", _OPTIONS)


def plain_number(value: Column, token: Column) -> Column:
    """Numbers with a fraction or an exponent as plain digits of the nearest double: 1.0
    is 1, 1e2 is 100, 1e-3 is 0.001. Texts stay as they are."""
    number = F.schema_of_variant(token).rlike("^(DOUBLE|FLOAT|DECIMAL)")
    return F.when(looks_fractional(value) & number, plain_digits(value.try_cast("double"))).otherwise(value)


def plain_digits(value: Column) -> Column:
    """Shortest decimal digits of a double, without an exponent."""
    # the plain text of a double may have a digit too many; fewer that give the same
    # double are nearer to what was written
    short, long = F.format_string("%.14e", value), F.format_string("%.15e", value)
    shown = (
        F.when(short.try_cast("double") == value, short)
        .when(long.try_cast("double") == value, long)
        .otherwise(value.cast("string"))
    )
    return bound(shown, _without_exponent)


def _without_exponent(shown: Column) -> Column:
    form = r"^(-?)(\d+)\.(\d+?)0*(?:[eE]([+-]?\d+))?$"
    sign, whole, fraction, exponent = (F.regexp_extract(shown, form, k) for k in range(1, 5))
    parts = F.struct(
        sign.alias("sign"),
        F.concat(whole, F.regexp_replace(fraction, "^0$", "")).alias("digits"),
        (F.length(whole) + F.coalesce(exponent.try_cast("int"), F.lit(0))).alias("point"),
    )
    return F.when(shown.rlike(form), bound(parts, _placed)).otherwise(shown)


def _placed(parts: Column) -> Column:
    """Digits with the point where it belongs."""
    digits, point = parts["digits"], parts["point"]
    size = F.length(digits)
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)))
    )
    return F.concat(parts["sign"], plain)
