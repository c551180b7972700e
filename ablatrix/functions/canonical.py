"""Canonical JSON as Columns: sorted keys, compact, non-ASCII kept, and floats and escapes as Python's json writes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

#: The letters that a control character's escape can hold.
HEX = "ABCDEF"
#: What encloses a double on its way through to_json.
MARK = "\ue000\uf8ff"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def number(x: Column) -> Column:
    """The shortest decimal that reads back as the double x, laid out as Python does. Where 17 digits end in a 5 that isn't the end of
    the exact value (some 1 of 20,000 doubles of random bits), the last of the 16 digits can be its neighbour."""
    def shortest(v: Column) -> Column:
        texts = F.array(*[F.format_string(f"%.{n}e", v) for n in range(17)])
        return F.try_element_at(F.filter(texts, lambda t: t.try_cast("double") == v), F.lit(1))

    def laid_out(t: Column) -> Column:
        sign = F.when(t.startswith("-"), "-").otherwise("")
        digits = F.regexp_replace(F.substring_index(t, "e", 1), "[-.]", "")
        power, n = F.substring_index(t, "e", -1).cast("int"), F.length(digits)
        zeros = lambda k: F.repeat(F.lit("0"), k)
        whole = F.concat(digits, zeros(power + 1 - n), F.lit(".0"))
        mixed = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n))
        small = F.concat(F.lit("0."), zeros(-power - 1), digits)
        short = F.when(n == 1, digits).otherwise(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), n)))
        far = F.concat(short, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
        return F.concat(sign, F.when((power < -4) | (power >= 16), far).when(power < 0, small).when(n <= power + 1, whole).otherwise(mixed))

    def text(v: Column) -> Column:
        odd = F.when(F.isnan(v), "NaN").when(v == float("inf"), "Infinity").when(v == float("-inf"), "-Infinity")
        return F.coalesce(odd, _let(shortest(v), laid_out))

    return _let(x.cast("double"), text)


def _sorted(value: Column, type_: T.DataType) -> Column:
    """value with the keys of its structs and maps sorted, and doubles as marked text."""
    if isinstance(type_, T.StructType):
        fields = sorted(type_.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(type_, T.MapType):
        entry = lambda k: F.struct(k, _sorted(F.element_at(value, k), type_.valueType))
        return F.map_from_entries(F.transform(F.array_sort(F.map_keys(value)), entry))
    if isinstance(type_, T.ArrayType) and isinstance(type_.elementType, (T.StructType, T.MapType, T.ArrayType, T.DoubleType, T.FloatType)):
        return F.transform(value, lambda x: _sorted(x, type_.elementType))
    if isinstance(type_, (T.DoubleType, T.FloatType)):
        return F.concat(F.lit(MARK), number(value), F.lit(MARK))
    return value


def _lowered(text: Column) -> Column:
    """With the letters of control characters' escapes small, where an odd backslash leads."""
    for letter in HEX:
        text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\u00([01]){letter}", rf"$1\\u00$2{letter.lower()}")
    return text


def canonical(value: Column, type_: T.DataType) -> Column:
    """The JSON of a value of that type; a null is `null`. Maps have strings as keys.

    to_json writes all but the doubles, which it doesn't lay out like Python: they pass it as text between marks, a pair of private
    characters, and shed marks and quotes afterwards."""
    text = F.to_json(F.array(_sorted(value, type_)), {"ignoreNullFields": "false"})
    bare = F.regexp_replace(F.substring(text, F.lit(2), F.length(text) - 2), f'"{MARK}([-+.0-9a-zA-Z]+){MARK}"', "$1")
    return _let(bare, lambda t: F.when(t.contains("\\u00"), _lowered(t)).otherwise(t))
