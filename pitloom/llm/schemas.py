"""Values against JSON schemas: the keywords that state types, values, sizes, patterns, members and combinations."""

from __future__ import annotations

import math
import re

_TYPES = {"string": str, "integer": (int, float), "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
_NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format"}
_COUNTS = {"minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties"}
_NUMBERS = {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"}
_LISTS = {"anyOf", "allOf", "oneOf"}
_KNOWN = {"type", "enum", "const", "pattern", "required", "properties", "additionalProperties", "items", "not", "uniqueItems"} | _NOTES | _COUNTS | _NUMBERS | _LISTS


def checked(schema: object, at: str = "$") -> None:
    """ValueError for a schema whose keywords aren't known or have values that can't be meant; to be called before a job."""

    def must(good: bool, what: str) -> None:
        if not good:
            raise ValueError(f"{at}: {what}")

    if isinstance(schema, bool):
        return
    must(isinstance(schema, dict), "a schema is an object or a boolean")
    unknown = sorted(set(schema) - _KNOWN)
    must(not unknown, f"unknown keywords {unknown}")
    kinds = schema.get("type", [])
    must(isinstance(kinds, (str, list)) and all(isinstance(k, str) and k in _TYPES for k in ([kinds] if isinstance(kinds, str) else kinds)), "unknown type")
    for k in _COUNTS & set(schema):
        must(isinstance(schema[k], int) and not isinstance(schema[k], bool) and schema[k] >= 0, f"{k} is no count")
    for k in _NUMBERS & set(schema):
        must(isinstance(schema[k], (int, float)) and not isinstance(schema[k], bool) and (k != "multipleOf" or schema[k] > 0), f"{k} is no number")
    must(isinstance(schema.get("enum", []), list), "enum is no list")
    must(isinstance(schema.get("required", []), list) and all(isinstance(k, str) for k in schema.get("required", [])), "required is no list of names")
    must(isinstance(schema.get("properties", {}), dict), "properties is no object")
    must(isinstance(schema.get("uniqueItems", False), bool), "uniqueItems is no boolean")
    if "pattern" in schema:
        try:
            re.compile(schema["pattern"])
        except (re.error, TypeError) as e:
            raise ValueError(f"{at}: pattern: {e}") from e
    for k, s in schema.get("properties", {}).items():
        checked(s, f"{at}.{k}")
    for k in ("additionalProperties", "items", "not"):
        if k in schema:
            checked(schema[k], f"{at}.{k}")
    for k in _LISTS & set(schema):
        must(isinstance(schema[k], list) and len(schema[k]) > 0, f"{k} is no list of schemas")
        for i, s in enumerate(schema[k]):
            checked(s, f"{at}.{k}[{i}]")


def same(a: object, b: object) -> bool:
    """Equality of JSON values: 1 and 1.0 are one number, true is no number."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == b


def _is(value: object, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _TYPES[kind]) and (kind != "integer" or isinstance(value, int) or value.is_integer())


def _multiple(value: float, of: float) -> bool:
    if isinstance(value, int) and isinstance(of, int):
        return value % of == 0
    ratio = value / of
    return math.isfinite(ratio) and abs(ratio - round(ratio)) < 1e-9 * max(1.0, abs(ratio))


def _number(value: float, schema: dict) -> list[str]:
    rules = (("minimum", lambda x: value >= x, "too small"), ("maximum", lambda x: value <= x, "too large"), ("exclusiveMinimum", lambda x: value > x, "too small"), ("exclusiveMaximum", lambda x: value < x, "too large"), ("multipleOf", lambda x: _multiple(value, x), "not a multiple"))
    return [say for k, good, say in rules if k in schema and not good(schema[k])]


def _size(value: object, schema: dict, unit: str, few: str, many: str) -> list[str]:
    n = len(value)
    return [few] * (n < schema.get(f"min{unit}", 0)) + [many] * (n > schema.get(f"max{unit}", n))


def problems(value: object, schema: dict | bool, at: str = "$") -> list[str]:
    """What a JSON value breaks of a schema that `checked` accepts, each with its place."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not expected"]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    say, found = [], []
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        say.append("not one of the values")
    if "const" in schema and not same(value, schema["const"]):
        say.append("not the value")
    if isinstance(value, str):
        say += _size(value, schema, "Length", "too short", "too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            say.append("not of the pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        say += _number(value, schema)
    elif isinstance(value, dict):
        say += _size(value, schema, "Properties", "too few members", "too many members")
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            found += problems(value[k], known[k] if k in known else others, f"{at}.{k}")
    elif isinstance(value, list):
        say += _size(value, schema, "Items", "too few items", "too many items")
        if schema.get("uniqueItems") and any(same(x, y) for i, x in enumerate(value) for y in value[:i]):
            say.append("repeated items")
        for i, x in enumerate(value):
            found += problems(x, schema.get("items", True), f"{at}[{i}]")
    for s in schema.get("allOf", []):
        found += problems(value, s, at)
    if "anyOf" in schema and all(problems(value, s, at) for s in schema["anyOf"]):
        say.append("fits none of the schemas")
    if "oneOf" in schema and sum(not problems(value, s, at) for s in schema["oneOf"]) != 1:
        say.append("doesn't fit just one of the schemas")
    if "not" in schema and not problems(value, schema["not"], at):
        say.append("fits what it must not")
    return [f"{at}: {x}" for x in say] + found
