"""JSON, literals and schema checks."""

from __future__ import annotations

import ast
import functools
import json
import operator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import col


def json_object(x: Column | str, repair: bool = True) -> Column:
    """The text as a JSON object (VARIANT): whole, from its first brace to its last, or (``repair``) that ``repaired``; else null."""
    text = F.trim(col(x))
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tries = [F.try_parse_json(t) for t in (text, F.nullif(inner, F.lit("")), *([repaired(text)] if repair else []))]
    return F.coalesce(*[F.when(F.schema_of_variant(t).startswith("OBJECT"), t) for t in tries])


def repaired(text: Column) -> Column:
    """What models often get wrong in an object: typographic quotes, Python's constants, commas before a closing bracket, a missing last brace."""
    out = F.regexp_extract(F.translate(text, "\u201c\u201d", '""'), r"(?s)(\{.*)", 1)
    out = F.when(F.contains(out, F.lit("}")) & ~F.rtrim(out).endswith('"'), F.regexp_extract(out, r"(?s)(.*\})", 1)).otherwise(F.concat(out, F.lit("}")))
    for name, value in (("None", "null"), ("True", "true"), ("False", "false")):
        out = F.regexp_replace(out, rf"(?<=[:\[,])(\s*){name}(?=\s*[,}}\]])", f"$1{value}")
    return F.nullif(F.regexp_replace(out, r",(\s*[}\]])", "$1"), F.lit("}"))


def json_object_or(x: Column | str, fallback: Column, repair: bool = True) -> Column:
    return F.coalesce(json_object(x, repair), F.parse_json(F.to_json(fallback)))


@F.pandas_udf(T.StringType())
def literal_json(values: pd.Series) -> pd.Series:
    """Python literals (single quotes, None, True) as JSON; what does not parse is null."""

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        try:
            return json.dumps(ast.literal_eval(value), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return values.map(one)


def data_turns(annotations: Column, kind: str) -> Column:
    """The list under ``data`` of a JSON object, or an empty list."""
    return F.coalesce(F.from_json(F.get_json_object(annotations, "$.data"), kind), F.array().cast(kind))


KINDS = {"string": "STRING", "object": "OBJECT", "array": "ARRAY", "null": "VOID", "boolean": "BOOLEAN"}


def _is_kind(kind: str, name: str, value: Column) -> Column:
    if name == "number":
        return kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    if name == "integer":  # 2021.0 is an integer, as a decimal or as a double without fraction
        integral = value.cast("double") == F.floor(value.cast("double"))
        return kind.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))") | (kind.rlike("^(DOUBLE|DECIMAL)") & integral)
    return kind.startswith(KINDS[name])


def schema_errors(x: Column | str, schema: dict[str, Any]) -> Column:
    """Messages of a JSON text against a JSON schema: required, additionalProperties, type, enum, minLength, nested properties, and type, enum and minLength of items."""
    text = col(x)

    def rules(at: str, rule: dict[str, Any]) -> list[Column]:
        name = f"${at}"
        value = F.get_json_object(text, f"${at}")
        doc = F.try_parse_json(text)
        node = F.try_variant_get(doc, f"${at}", "variant")
        kind = F.schema_of_variant(node)
        present = node.isNotNull()
        found: list[Column] = []
        if kinds := rule.get("type"):
            kinds = [kinds] if isinstance(kinds, str) else kinds
            fits = F.lit(False)
            for k in kinds:
                fits = fits | _is_kind(kind, k, value.try_cast("double"))
            found.append(F.when(present & ~fits, F.lit(f"{name}: type")))
        if "enum" in rule:
            found.append(F.when(present & ~F.coalesce(value.isin([v for v in rule["enum"] if v is not None]), F.lit(None in rule["enum"])), F.lit(f"{name}: enum")))
        if "minLength" in rule:
            found.append(F.when(present & kind.startswith("STRING") & (F.char_length(value) < rule["minLength"]), F.lit(f"{name}: minLength")))
        is_object = present & kind.startswith("OBJECT")
        keys = F.json_object_keys(value if at else text)
        for key in rule.get("required", ()):
            found.append(F.when(is_object & ~F.array_contains(keys, key), F.lit(f"{name}: {key} is required")))
        if rule.get("additionalProperties") is False:
            extra = F.array_except(keys, F.array(*[F.lit(k) for k in rule.get("properties", {})]))
            found.append(F.when(is_object & (F.size(extra) > 0), F.concat(F.lit(f"{name}: unknown "), F.array_join(F.array_sort(extra), ", "))))
        if items := rule.get("items"):
            each = F.try_variant_get(doc, f"${at}", "array<variant>")
            kinds = items.get("type", [])
            bad_kind, told = F.lit(False), lambda v: F.try_variant_get(v, "$", "string")
            if kinds := [kinds] if isinstance(kinds, str) else kinds:
                fits = lambda v: [_is_kind(F.schema_of_variant(v), k, told(v).try_cast("double")) for k in kinds]
                bad_kind = F.exists(each, lambda v: ~functools.reduce(operator.or_, fits(v)))
            found.append(F.when(present & bad_kind, F.lit(f"{name}[]: type")))
            if "enum" in items:
                found.append(F.when(present & F.exists(each, lambda v: ~F.coalesce(told(v).isin([e for e in items["enum"] if e is not None]), F.lit(None in items["enum"]))), F.lit(f"{name}[]: enum")))
            if "minLength" in items:
                found.append(F.when(present & F.exists(each, lambda v: F.schema_of_variant(v).startswith("STRING") & (F.char_length(told(v)) < items["minLength"])), F.lit(f"{name}[]: minLength")))
        for key, inner in rule.get("properties", {}).items():
            found += rules(f"{at}.{key}", inner)
        return found

    bad = F.try_parse_json(text).isNull()
    return F.when(bad, F.array(F.lit("$: not JSON"))).otherwise(F.array_compact(F.array(*rules("", schema))))
