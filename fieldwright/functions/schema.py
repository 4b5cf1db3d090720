"""The record's JSON schema, and the check of JSON texts against a schema, as Columns over variant values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldwright.functions import normalize as N
from fieldwright.operators.fields import HEADER, LINE, Field

#: What a schema type is called by schema_of_variant: the first word of it.
_KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")}
_ERRORS = "array<struct<path:string,problem:string>>"


def _property(f: Field) -> dict:
    kind = {"bool": "boolean", "money": "number", "quantity": "number", "percent": "number"}.get(f.ftype, "string")
    out: dict = {"type": [kind, "null"] if f.nullable else kind}
    return out | ({"format": "date"} if f.ftype == "date" else {})


def record_schema(title: str = "record") -> dict:
    """The schema of a record: every field is required, none else allowed; nullable ones may be null."""
    line = {"type": "object", "additionalProperties": False, "required": [f.name for f in LINE], "properties": {f.name: _property(f) for f in LINE}}
    properties = {f.name: _property(f) for f in HEADER} | {"line_items": {"type": "array", "items": line}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title, "type": "object", "additionalProperties": False, "required": list(properties), "properties": properties}


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _none() -> Column:
    return F.array().cast(_ERRORS)


def _error(path: Column, problem: Column | str) -> Column:
    return F.struct(path.alias("path"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem"))


def _check(schema: dict, v: Column, path: Column) -> Column:
    """Errors of one variant value; a value of a wrong type has that error alone."""
    wanted = schema.get("type", list(_KINDS))
    wanted = [wanted] if isinstance(wanted, str) else list(wanted)
    words = [w for t in wanted for w in _KINDS[t]]
    kind = _kind(v)
    inside = _none()
    if "object" in wanted:
        inside = F.when(kind == "OBJECT", N.let(F.variant_get(v, "$", "map<string,variant>"), lambda m: _check_object(schema, m, path))).otherwise(inside)
    if "array" in wanted and "items" in schema:
        each = lambda a: F.flatten(F.transform(a, lambda x, i: _check(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        inside = F.when(kind == "ARRAY", each(F.variant_get(v, "$", "array<variant>"))).otherwise(inside)
    wrong = F.array(_error(path, F.concat(F.lower(kind), F.lit(" is not of type " + " or ".join(wanted))))).cast(_ERRORS)
    return F.when(kind.isin(*words), inside).otherwise(wrong)


def _check_object(schema: dict, m: Column, path: Column) -> Column:
    properties = schema.get("properties", {})
    keys = F.map_keys(m)
    named = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    parts = [F.transform(F.array_except(named(schema.get("required", [])), keys), lambda k: _error(path, F.concat(F.lit("lacks "), k))).cast(_ERRORS)]
    if schema.get("additionalProperties") is False:
        parts.append(F.transform(F.array_except(keys, named(properties)), lambda k: _error(path, F.concat(F.lit("has an unknown "), k))).cast(_ERRORS))

    def property_check(s: dict):
        return lambda k: _check(s, F.element_at(m, k), F.concat(path, F.lit("."), k))

    # properties of one and the same schema are checked by one expression
    alike: dict[str, tuple[dict, list[str]]] = {}
    for n, s in properties.items():
        alike.setdefault(repr(s), (s, []))[1].append(n)
    for s, names in alike.values():
        present = F.filter(named(names), lambda k: F.array_contains(keys, k))
        parts.append(F.flatten(F.transform(present, property_check(s))))
    return F.concat(*parts)


def schema_errors(text: Column, schema: dict) -> Column:
    """array of (path, problem) of a JSON text, by path and problem; `$` is the whole.

    The schema may use type, properties, required, additionalProperties (false) and items; other words say nothing. A null
    text, and one that is no JSON, has one error.
    """
    unread = F.array(_error(F.lit("$"), "is not JSON")).cast(_ERRORS)
    found = N.let(F.try_parse_json(text), lambda v: F.when(v.isNull(), unread).otherwise(_check(schema, v, F.lit("$"))))
    return F.array_sort(found)


def typed_record(text: Column) -> Column:
    """struct of the record's fields as texts, with line_items an array of structs; null where the text is no JSON object.

    Lines that aren't objects are dropped, and line_items that is no array is empty; unknown keys are ignored; JSON nulls
    and absent fields are null; nested values come as their JSON text.
    """

    def fields(of: tuple[Field, ...], m: Column) -> list[Column]:
        def one(n: str) -> Column:
            v = F.try_element_at(m, F.lit(n))
            nested = F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")
            return F.when(nested, F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string")).alias(n)

        return [one(f.name) for f in of]

    def lines(m: Column) -> Column:
        v = F.try_element_at(m, F.lit("line_items"))
        every = F.when(_kind(v) == "ARRAY", F.variant_get(v, "$", "array<variant>"))
        objects = F.filter(F.coalesce(every, F.array().cast("array<variant>")), lambda x: _kind(x) == "OBJECT")
        return F.transform(objects, lambda x: N.let(F.variant_get(x, "$", "map<string,variant>"), lambda o: F.struct(*fields(LINE, o))))

    whole = F.try_parse_json(text)
    return F.when(_kind(whole) == "OBJECT", N.let(F.variant_get(whole, "$", "map<string,variant>"), lambda m: F.struct(*fields(HEADER, m), lines(m).alias("line_items"))))
