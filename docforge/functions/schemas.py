"""All errors of a JSON value against a schema, and rewrites of nested columns, compiled to one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .arrays import compress_ids

#: Kinds of plain values, and what the engine calls the types that a value of that kind has.
KINDS = {
    "string": ("STRING",),
    "integer": ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL(%,0)"),
    "number": ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "boolean": ("BOOLEAN",),
}
_ERRORS = "array<struct<path:string,kind:string,message:string>>"


def _one(path: Column, kind: str, message: Column | str) -> Column:
    m = F.lit(message) if isinstance(message, str) else message
    return F.array(F.struct(path.alias("path"), F.lit(kind).alias("kind"), m.alias("message"))).cast(_ERRORS)


def _none() -> Column:
    return F.array().cast(_ERRORS)


def _is(v: Column, kind: str) -> Column:
    t = F.schema_of_variant(v)
    if kind == "integer":
        return t.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$")
    return F.coalesce(t.rlike("^(" + "|".join(KINDS[kind]) + r")\b"), F.lit(False))


def schema_errors(value: Column, schema: dict, path: Column | str = "") -> Column:
    """array<struct<path, kind, message>>: each error of a variant value, in the order of the schema, items of lists by number.

    schema: {"type": "object", "fields": {name: schema}}, {"type": "array", "items": schema}, or a plain type (string, integer, number, boolean), with
    "required": False where a field may be absent or null, "enum": [...], "pattern": a regular expression, "least" and "most": bounds of a number.
    kind: missing, type, enum, pattern, range. A value of a wrong type has no further errors; fields that the schema hasn't are allowed.
    A null value (SQL) is one error: it is no JSON. A field's name may have either kind of quote, not both.
    """
    p = F.lit(path) if isinstance(path, str) else path
    return F.when(value.isNull(), _one(p, "type", "not a JSON value")).otherwise(_errors(value, schema, p))


def _errors(v: Column, schema: dict, path: Column) -> Column:
    kind = schema["type"]
    if kind == "object":
        right = F.schema_of_variant(v).startswith("OBJECT<")
        parts = [_field(v, name, s, path) for name, s in schema.get("fields", {}).items()]
        inner = F.concat(*parts) if parts else _none()
    elif kind == "array":
        right = F.schema_of_variant(v).startswith("ARRAY<")
        items = F.try_variant_get(v, "$", "array<variant>")
        each = lambda x, i: _present(x, schema["items"], F.concat(path, F.lit("."), i.cast("string")))
        inner = F.flatten(F.transform(items, each))
    else:
        right = _is(v, kind)
        inner = _plain(v, schema, path)
    wrong = _one(path, "type", f"should be {'an' if kind[0] in 'aio' else 'a'} {kind}")
    return F.when(~right, wrong).otherwise(F.coalesce(inner, _none()))


def _present(v: Column, schema: dict, path: Column) -> Column:
    absent = v.isNull() | F.is_variant_null(v)
    missing = _none() if schema.get("required") is False else _one(path, "missing", "is required")
    return F.when(absent, missing).otherwise(_errors(v, schema, path))


def _field(v: Column, name: str, schema: dict, path: Column) -> Column:
    at = F.concat(path, F.when(path != "", ".").otherwise(""), F.lit(name))
    quote = '"' if "'" in name else "'"
    return _present(F.try_variant_get(v, f"$[{quote}{name}{quote}]", "variant"), schema, at)


def _plain(v: Column, schema: dict, path: Column) -> Column:
    checks: list[Column] = []
    text = F.try_variant_get(v, "$", "string")
    if "enum" in schema:
        checks.append(F.when(~text.isin([str(x) for x in schema["enum"]]), _one(path, "enum", "should be one of " + ", ".join(map(str, schema["enum"])))))
    if "pattern" in schema:
        checks.append(F.when(~text.rlike(schema["pattern"]), _one(path, "pattern", f"should match {schema['pattern']}")))
    number = F.try_variant_get(v, "$", "double")
    if "least" in schema:
        checks.append(F.when(number < schema["least"], _one(path, "range", f"should be {schema['least']} or more")))
    if "most" in schema:
        checks.append(F.when(number > schema["most"], _one(path, "range", f"should be {schema['most']} or less")))
    return F.concat(*(F.coalesce(c, _none()) for c in checks)) if checks else _none()


def rewritten(value: Column, kind: DataType, field: str, change: Callable[[Column], Column], wanted: Callable[[DataType], bool] = lambda t: True) -> Column:
    """value (of type kind) with each field of that name changed, at every depth of structs, lists and map values; nulls stay null.

    A field whose type isn't `wanted` is looked into like any other. What has no such field below is left as it is.
    """

    def has(t: DataType) -> bool:
        if isinstance(t, StructType):
            return any(f.name == field and wanted(f.dataType) or has(f.dataType) for f in t.fields)
        return has(t.elementType) if isinstance(t, ArrayType) else has(t.valueType) if isinstance(t, MapType) else False

    def walk(v: Column, t: DataType) -> Column:
        if not has(t):
            return v
        if isinstance(t, StructType):
            parts = [(change(v[f.name]) if f.name == field and wanted(f.dataType) else walk(v[f.name], f.dataType)).alias(f.name) for f in t.fields]
            return F.when(v.isNotNull(), F.struct(*parts))
        if isinstance(t, ArrayType):
            return F.transform(v, lambda x: walk(x, t.elementType))
        return F.transform_values(v, lambda k, x: walk(x, t.valueType))

    return walk(value, kind)


def compress_nested(value: Column, kind: DataType, field: str = "observation_ids") -> Column:
    """value with each list of numbers called `field`, however deep, as ranges (`functions.arrays.compress_ids`)."""
    numbers = lambda t: isinstance(t, ArrayType) and t.elementType.typeName() in ("byte", "short", "integer", "long")
    return rewritten(value, kind, field, compress_ids, numbers)
