"""Values of JSON whose types count: VARIANT -> Column. Text, numbers, truth values, lists and objects stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.markup import CELL_LIMIT, cell_text, strip
from postloom.functions.scalars import to_int, whole

#: A name with the colon after it, in compact JSON: whatever stands before it, strings included, is stepped over.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NAMES = rf"\G([^\"]*+(?:{_STRING}(?!:)[^\"]*+)*+)({_STRING}):"


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, FLOAT, BOOLEAN or VOID (JSON's null); null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(v), r"\A[A-Z]+", 0)


def is_nothing(v: Column) -> Column:
    return v.isNull() | (kind(v) == "VOID")


def member(v: Column, name: str) -> Column:
    """An object's value of that name, as a VARIANT; null where v is none or has none."""
    return F.try_variant_get(v, f"$['{name}']", "variant")


def elements(v: Column) -> Column:
    """An array's values; null where v is none."""
    return F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def members(v: Column) -> Column:
    """An object's values by name; null where v is none."""
    return F.when(kind(v) == "OBJECT", F.try_variant_get(v, "$", "map<string,variant>"))


def as_text(v: Column) -> Column:
    """A string's text; nothing else is text."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def as_number(v: Column) -> Column:
    return F.when(kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double"))


def as_int(v: Column) -> Column:
    """Whole numbers, 12.0 among them, and text that is nothing but one; truth values and "12.0" are none."""
    return F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "long")).when(kind(v) == "STRING", to_int(as_text(v))).otherwise(whole(as_number(v)))


def as_float(v: Column, default: float | None = None) -> Column:
    """Numbers, and text that is nothing but one; truth values are none."""
    return F.coalesce(as_number(v), strip(as_text(v)).try_cast("double"), F.lit(default).cast("double"))


def as_ints(v: Column) -> Column:
    """The whole numbers of a list, or one that stands alone, each once and in order."""
    listed = F.coalesce(elements(v), F.when(~is_nothing(v), F.array(v)), F.array().cast("array<variant>"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(listed, as_int), lambda x: x.isNotNull())))


def as_texts(v: Column) -> Column:
    """The texts of a list, or the one that stands alone; other values are left out."""
    listed = F.coalesce(elements(v), F.when(~is_nothing(v), F.array(v)), F.array().cast("array<variant>"))
    return F.filter(F.transform(listed, as_text), lambda x: x.isNotNull())


def holds(v: Column) -> Column:
    """Whether a value counts as given: not null, false, zero, or an empty text, list or object."""
    body = F.to_json(v)
    return F.when(is_nothing(v), False).when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(as_number(v).isNotNull(), as_number(v) != 0).otherwise(~body.isin('""', "[]", "{}"))


def first_held(*values: Column) -> Column:
    return F.coalesce(*[F.when(holds(v), v) for v in values])


def plain(v: Column) -> Column:
    """As it reads: text without quotes, anything else as JSON; null where there is nothing."""
    return F.when(is_nothing(v), F.lit(None).cast("string")).otherwise(F.coalesce(as_text(v), F.to_json(v)))


def compact_json(v: Column, limit: int = CELL_LIMIT) -> Column:
    """JSON with a space after the colons and none elsewhere, cut at a cell's limit."""
    return cell_text(F.regexp_replace(F.to_json(v), _NAMES, "$1$2: "), limit)


def cell(v: Column, limit: int = CELL_LIMIT) -> Column:
    """What a spreadsheet's cell shows: nothing for null, a line for each value of a flat list, compact JSON for nested values."""
    flat = F.coalesce(~F.exists(elements(v), lambda x: F.coalesce(kind(x).isin("OBJECT", "ARRAY"), F.lit(False))), F.lit(False))
    lines = F.filter(F.transform(elements(v), plain), lambda x: x.isNotNull() & (x != ""))
    return F.when(is_nothing(v), "").when(flat, cell_text(F.array_join(lines, "\n"), limit)).when(kind(v).isin("OBJECT", "ARRAY"), compact_json(v, limit)).otherwise(cell_text(plain(v), limit))


def field_texts(fields: Column) -> Column:
    """All texts of a map of JSON texts, lists taken apart; what is no JSON is text itself."""
    one = lambda s: F.when(F.try_parse_json(s).isNull(), F.array(s)).otherwise(as_texts(F.try_parse_json(s)))
    return F.filter(F.flatten(F.transform(F.coalesce(F.map_values(fields), F.array().cast("array<string>")), one)), lambda x: x.isNotNull())


def field_cell(s: Column) -> Column:
    """The cell of one value of such a map."""
    return F.when(F.try_parse_json(s).isNull(), cell_text(F.coalesce(s, F.lit("")))).otherwise(cell(F.try_parse_json(s)))
