"""How rules and aggregates see a value: whether it is a number, its number, its text."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER_KINDS = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"


def is_number_type(kind: T.DataType) -> bool:
    """Booleans and strings of digits are not numbers."""
    return isinstance(kind, T.NumericType)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number_text(x: Column) -> Column:
    """A double in the shortest form that reads back as it: 80, 80.5, 0.0001, 1e+21, 1e-05, -0, NaN, +Inf.

    The digits are the fewest of 15, 16 or 17 that give the same double, without zeros at their end; then the point
    is put where the exponent says. From 1e21 on and below 0.0001 the exponent is shown. Each step is bound, since an
    expression that stands in several branches is computed in each.
    """

    def placed(shown: Column) -> Column:
        head, power = F.substring_index(shown, "e", 1), F.substring_index(shown, "e", -1).try_cast("int")
        digits = F.rtrim(F.translate(head, "-.", ""), F.lit("0"))
        parts = F.struct(F.when(digits == "", F.lit("0")).otherwise(digits).alias("digits"), power.alias("power"), F.startswith(shown, F.lit("-")).alias("minus"))
        return bound(parts, lambda p: pointed(p["digits"], p["power"], p["minus"]))

    def pointed(digits: Column, power: Column, minus: Column) -> Column:
        n = F.length(digits)
        whole = F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0"))
        text = (
            F.when((power >= 21) | (power < -4), F.concat(
                F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, 2, 20))).otherwise(""),
                F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0"))))
            .when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
            .when(n > power + 1, F.concat(whole, F.lit("."), F.substring(digits, power + 2, F.lit(20))))
            .otherwise(whole)
        )
        return F.concat(F.when(minus, F.lit("-")).otherwise(F.lit("")), text)

    def tried(v: Column, digits: int, rest: Column) -> Column:
        return bound(F.format_string(f"%.{digits - 1}e", v), lambda t: F.when(t.cast("double") == v, t).otherwise(rest))

    def shown(v: Column) -> Column:
        shortest = tried(v, 15, tried(v, 16, F.format_string("%.16e", v)))
        return (
            F.when(F.isnan(v), F.lit("NaN")).when(v == float("inf"), F.lit("+Inf")).when(v == float("-inf"), F.lit("-Inf"))
            .when(v.isNotNull(), bound(shortest, placed))
        )

    return bound(x.cast("double"), shown)


def python_text(value: object) -> str:
    """The same for a literal."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if not isinstance(value, (int, float)):
        return str(value)
    x = float(value)
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "+Inf" if x > 0 else "-Inf"
    sign, shown, exponent = Decimal(repr(x)).as_tuple()
    digits = "".join(map(str, shown)).rstrip("0") or "0"
    power = len(shown) + exponent - 1 if x else 0
    digits = digits.lstrip("0") or "0"
    minus = "-" if sign else ""
    if power >= 21 or power < -4:
        rest = f".{digits[1:]}" if len(digits) > 1 else ""
        return f"{minus}{digits[0]}{rest}e{'-' if power < 0 else '+'}{abs(power):02d}"
    if power < 0:
        return f"{minus}0.{'0' * (-power - 1)}{digits}"
    whole, rest = digits[: power + 1].ljust(power + 1, "0"), digits[power + 1 :]
    return f"{minus}{whole}.{rest}" if rest else f"{minus}{whole}"


def json_valid(text: Column) -> Column:
    """Whether the whole text is one JSON document; false for null.

    Spark's parsers stop after the first value and pass over what follows. So the text is read as an array's first
    element before a mark: only where it is one value and nothing else, the mark comes second. The mark is the text's
    digest, which a text cannot hold. Keys that repeat and long numbers are valid; NaN is not.
    """
    mark = F.md5(text)
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "maxNumLen": str(2**31 - 1), "maxStringLen": str(2**31 - 1)}
    read = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), "array<string>", strict)
    return F.coalesce((F.size(read) == 2) & (F.get(read, 1) == mark), F.lit(False))


class Value:
    """A field of a record: whether it is present and a number, its number, and its text.

    The text of a number is a costly expression, so it is made only when asked for; `other` is the text of what is
    present and no number.
    """

    def __init__(self, present: Column, is_number: Column, number: Column, other: Column):
        self.present, self.is_number, self.number, self.other = present, is_number, number, other

    def text(self) -> Column:
        return F.when(self.is_number, number_text(self.number)).otherwise(self.other)


def missing_value() -> Value:
    return Value(F.lit(False), F.lit(False), F.lit(None).cast("double"), F.lit(None).cast("string"))


def typed_value(column: Column, kind: T.DataType) -> Value:
    """Of a typed column; null stands for a missing field."""
    if is_number_type(kind):
        return Value(column.isNotNull(), F.lit(True), column.cast("double"), F.lit(None).cast("string"))
    return Value(column.isNotNull(), F.lit(False), F.lit(None).cast("double"), column.cast("string"))


def variant_field(record: Column, name: str) -> Column:
    """A field of a VARIANT record as VARIANT, null if it is absent."""
    return F.try_variant_get(record, "$['" + name.replace("'", "\\'") + "']", "variant")


def variant_value(field: Column) -> Value:
    """Of a VARIANT field; an explicit null is present and reads '<nil>'."""
    kind = F.schema_of_variant(field)
    other = F.coalesce(F.try_variant_get(field, "$", "string"), F.lit("<nil>"))
    return Value(kind.isNotNull(), kind.rlike(NUMBER_KINDS), F.try_variant_get(field, "$", "double"), other)
