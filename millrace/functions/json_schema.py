"""JSON Schema as Column expressions: a schema becomes one expression over a VARIANT that lists what is broken and where.

Known are type, const, enum, minLength, maxLength, pattern, format uuid, minimum, maximum, minItems, maxItems, uniqueItems,
prefixItems, items, minProperties, maxProperties, required, properties, additionalProperties, allOf, anyOf, oneOf and $ref to
#/$defs or to a schema given by name. Other keywords are passed over. A schema that refers to itself is unrolled to
`depth` levels; what lies deeper is a violation of rule `depth`.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FAULTS = "array<struct<path:string,rule:string>>"
#: Whole numbers that a double holds exactly.
SAFE = 2**53 - 1
#: Fixed value: how a UUID is written.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL", "FLOAT", "DOUBLE")


class Compiler:
    """Compiles rules of one root schema; `others` are schemas that $ref may name."""

    def __init__(self, others: Mapping[str, dict]):
        self.others = others
        self.none = F.array().cast(FAULTS)

    def fault(self, broken: Column, path: Column, rule: str) -> Column:
        return F.when(broken, F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(self.none)

    def check(self, item: Column, rule: dict, root: dict, path: Column, left: int) -> Column:
        """What of `rule` a variant that is there breaks, in the order of the groups of keywords above."""
        if not isinstance(rule, dict):
            raise ValueError(f"not a schema: {rule!r}")
        if left < 0:
            return self.fault(F.lit(True), path, "depth")
        if isinstance(rule.get("$ref"), str):
            named, home = self.resolve(rule["$ref"], root)
            return self.check(item, named, home, path, left - 1)
        kind = F.regexp_extract(F.schema_of_variant(item), "^[A-Z]+", 0)
        parts = [*self.combined(item, rule, root, path, left), *self.values(item, kind, rule, path)]
        for of, checks in (("STRING", self.strings), ("ARRAY", self.arrays), ("OBJECT", self.objects)):
            found = checks(item, rule, root, path, left)
            if found:
                parts.append(F.when(kind == of, F.concat(*found)).otherwise(self.none))
        return F.concat(*parts) if parts else self.none

    def resolve(self, ref: str, root: dict) -> tuple[dict, dict]:
        if ref.startswith("#/"):
            named = root.get("$defs", {}).get(ref.removeprefix("#/$defs/")) if ref.startswith("#/$defs/") else None
            home = root
        else:
            named = home = self.others.get(ref)
        if named is None:
            raise ValueError(f"unknown schema reference {ref}")
        return named, home

    def combined(self, item: Column, rule: dict, root: dict, path: Column, left: int) -> list[Column]:
        checks = lambda name: [self.check(item, r, root, path, left - 1) for r in rule.get(name) or []]
        fits = lambda name: reduce(Column.__add__, [(F.size(c) == 0).cast("int") for c in checks(name)])
        out = checks("allOf")
        if rule.get("anyOf"):
            out.append(self.fault(fits("anyOf") == 0, path, "anyOf"))
        if rule.get("oneOf"):
            out.append(self.fault(fits("oneOf") != 1, path, "oneOf"))
        return out

    def same(self, item: Column, kind: Column, value) -> Column:
        """Numbers are equal by value, all else by canonical text: members in order of name, no blanks."""
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return kind.isin(*NUMBERS) & (number(item) == float(value))
        return F.to_json(item) == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def values(self, item: Column, kind: Column, rule: dict, path: Column) -> list[Column]:
        out = []
        if "const" in rule:
            out.append(self.fault(~self.same(item, kind, rule["const"]), path, "const"))
        if isinstance(rule.get("enum"), list):
            out.append(self.fault(~reduce(Column.__or__, [self.same(item, kind, v) for v in rule["enum"]], F.lit(False)), path, "enum"))
        if "type" in rule:
            types = rule["type"] if isinstance(rule["type"], list) else [rule["type"]]
            out.append(self.fault(~reduce(Column.__or__, [is_type(item, kind, t) for t in types]), path, "type"))
        for name, breaks in (("minimum", lambda x, m: x < m), ("maximum", lambda x, m: x > m)):
            if name in rule:
                out.append(self.fault(kind.isin(*NUMBERS) & F.coalesce(breaks(number(item), F.lit(float(rule[name]))), F.lit(False)), path, name))
        return out

    def strings(self, item: Column, rule: dict, root: dict, path: Column, left: int) -> list[Column]:
        s, out = F.try_variant_get(item, "$", "string"), []
        if "minLength" in rule:
            out.append(self.fault(F.length(s) < rule["minLength"], path, "minLength"))
        if "maxLength" in rule:
            out.append(self.fault(F.length(s) > rule["maxLength"], path, "maxLength"))
        if isinstance(rule.get("pattern"), str):
            out.append(self.fault(~s.rlike(rule["pattern"]), path, "pattern"))
        if rule.get("format") == "uuid":
            out.append(self.fault(~s.rlike(UUID), path, "format"))
        return out

    def arrays(self, item: Column, rule: dict, root: dict, path: Column, left: int) -> list[Column]:
        held, out = F.try_variant_get(item, "$", "array<variant>"), []
        n, first = F.size(held), rule.get("prefixItems") or []
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        if "minItems" in rule:
            out.append(self.fault(n < rule["minItems"], path, "minItems"))
        if "maxItems" in rule:
            out.append(self.fault(n > rule["maxItems"], path, "maxItems"))
        if rule.get("uniqueItems") is True:
            out.append(self.fault(F.size(F.array_distinct(F.transform(held, lambda x: F.to_json(x)))) < n, path, "uniqueItems"))
        for i, r in enumerate(first):
            out.append(F.when(n > i, self.check(F.get(held, F.lit(i)), r, root, at(F.lit(i)), left - 1)).otherwise(self.none))
        if rule.get("items") is False:
            out.append(self.fault(n > len(first), path, "items"))
        if isinstance(rule.get("items"), dict):
            out.append(F.flatten(F.transform(held, lambda x, i: self.check(x, rule["items"], root, at(i), left - 1))))
        return out

    def objects(self, item: Column, rule: dict, root: dict, path: Column, left: int) -> list[Column]:
        held, out = F.try_variant_get(item, "$", "map<string,variant>"), []
        known = rule.get("properties") or {}
        under = lambda k: F.concat(path, F.lit("."), k)
        if "minProperties" in rule:
            out.append(self.fault(F.size(held) < rule["minProperties"], path, "minProperties"))
        if "maxProperties" in rule:
            out.append(self.fault(F.size(held) > rule["maxProperties"], path, "maxProperties"))
        out += [self.fault(~F.map_contains_key(held, k), under(F.lit(k)), "required") for k in rule.get("required") or []]
        for k, r in known.items():
            out.append(F.when(F.map_contains_key(held, k), self.check(F.element_at(held, k), r, root, under(F.lit(k)), left - 1)).otherwise(self.none))
        more = rule.get("additionalProperties")
        other = F.map_filter(held, lambda k, v: ~k.isin(*known)) if known else held
        if more is False:
            out.append(F.transform(F.map_keys(other), lambda k: F.struct(under(k).alias("path"), F.lit("additionalProperties").alias("rule"))))
        elif isinstance(more, dict):
            out.append(F.flatten(F.transform(F.map_entries(other), lambda e: self.check(e["value"], more, root, under(e["key"]), left - 1))))
        return out


def number(item: Column) -> Column:
    return F.try_variant_get(item, "$", "double")


def is_type(item: Column, kind: Column, name: str) -> Column:
    if name in ("number", "integer"):
        whole = (number(item) == F.floor(number(item))) & (F.abs(number(item)) <= SAFE)
        return kind.isin(*NUMBERS) & F.coalesce(whole if name == "integer" else F.lit(True), F.lit(False))
    return kind == {"null": "VOID", "array": "ARRAY", "object": "OBJECT", "string": "STRING", "boolean": "BOOLEAN"}.get(name, "-")


def violations(document: Column, schema: dict, others: Mapping[str, dict] | None = None, depth: int = 12) -> Column:
    """array of (path, rule): all that a JSON text breaks, empty if it is sound. A text that isn't JSON, and null, break rule `json` at $.

    Paths read $.member[0].member. Raises ValueError for a schema that refers to what isn't there.
    """
    item = F.try_parse_json(document)
    made = Compiler(others or {})
    return F.when(item.isNull(), made.fault(F.lit(True), F.lit("$"), "json")).otherwise(made.check(item, schema, schema, F.lit("$"), depth))
