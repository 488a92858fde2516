"""JSON Schema documents compiled to Column expressions.

A schema is read once on the driver: local $refs are put in place, unknown keywords and types are
refused, and each keyword becomes a test on a VARIANT column. Named properties are columns of
their document's row; the members of an array, and fields without a name in the schema, become rows
of their own, level by level. There are no lambdas but one, as Spark generates no code for them,
and documents are read and parsed once. As at the boundaries themselves, a node of the wrong type is not looked
into, a $ref is checked along with the keywords beside it, and all failures are collected."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords that are checked, and those that only describe (fixed values).
CHECKED = {
    "$ref", "type", "const", "enum", "minLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
    "required", "properties", "additionalProperties", "minItems", "maxItems", "uniqueItems", "items",
}
DESCRIBING = {"$schema", "$id", "$defs", "title", "description", "$comment", "default", "examples"}
#: What a node gives: something broken (path, rule), or members to look at by a schema of the next level.
_FOUND = "struct<path:string,rule:string,node:int,items:array<variant>,names:array<string>>"


class SchemaError(ValueError):
    """A schema that can't be compiled."""


def load(name: str, folder: Path = Path(__file__).resolve().parents[1] / "sources" / "schemas") -> dict:
    """The schema document of a name, checked."""
    try:
        schema = json.loads((folder / f"{name}.json").read_text(encoding="utf-8"))
    except (OSError, ValueError) as error:
        raise SchemaError(f"schema {name}: {error}") from error
    if not isinstance(schema, dict):
        raise SchemaError(f"schema {name} is not an object")
    check(schema, name)
    return schema


def names(folder: Path = Path(__file__).resolve().parents[1] / "sources" / "schemas") -> list[str]:
    return sorted(p.stem for p in folder.glob("*.json"))


def check(schema: object, where: str) -> None:
    """Raises at the first keyword that is not known, also in parts that nothing refers to."""
    if not isinstance(schema, dict):
        if isinstance(schema, bool):
            return
        raise SchemaError(f"{where}: not a schema")
    unknown = sorted(set(schema) - CHECKED - DESCRIBING)
    if unknown:
        raise SchemaError(f"{where}: unknown keywords {unknown}")
    for key in ("properties", "$defs"):
        for name, part in schema.get(key, {}).items():
            check(part, f"{where}/{key}/{name}")
    if "items" in schema and not isinstance(schema["items"], dict):
        raise SchemaError(f"{where}: items must be a schema")
    for key in ("items", "additionalProperties"):
        if key in schema:
            check(schema[key], f"{where}/{key}")


def resolve(ref: str, root: dict) -> dict:
    """What a local reference (#/...) points at."""
    at: object = root
    if not ref.startswith("#/"):
        raise SchemaError(f"{ref}: only references inside the document are known")
    for name in ref[2:].split("/"):
        at = at.get(name.replace("~1", "/").replace("~0", "~")) if isinstance(at, dict) else None
    if not isinstance(at, dict):
        raise SchemaError(f"{ref} points at no schema")
    return at


def _kind(told: Column) -> Column:
    """The JSON type of a variant whose schema is told."""
    decimal = told.startswith("DECIMAL")
    number = decimal | told.isin("BIGINT", "DOUBLE", "FLOAT")
    whole = (told == "BIGINT") | (decimal & told.endswith(",0)"))
    kind = F.when(told == "VOID", "null").when(told == "STRING", "string").when(told == "BOOLEAN", "boolean")
    return kind.when(whole, "integer").when(number, "number").when(told.startswith("ARRAY"), "array").otherwise("object")


def _is(kind: Column, wanted: str) -> Column:
    if wanted not in ("object", "array", "string", "integer", "number", "boolean", "null"):
        raise SchemaError(f"unknown type {wanted!r}")
    return kind.isin("integer", "number") if wanted == "number" else kind == wanted


def _equals(v: Column, kind: Column, value: object) -> Column:
    if value is None:
        return kind == "null"
    if isinstance(value, bool):
        return (kind == "boolean") & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, int | float):
        return kind.isin("integer", "number") & (F.try_variant_get(v, "$", "double") == float(value))
    if isinstance(value, str):
        return (kind == "string") & (F.try_variant_get(v, "$", "string") == value)
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


def _rules(v: Column, kind: Column, items: Column, texts: Column, schema: dict) -> list[tuple[str, Column]]:
    """The tests of one node that don't look into its members: (rule, whether it holds)."""
    number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    out: list[tuple[str, Column]] = []
    if "const" in schema:
        out.append(("const", _equals(v, kind, schema["const"])))
    if "enum" in schema:
        out.append(("enum", reduce(lambda a, b: a | b, (_equals(v, kind, x) for x in schema["enum"]), F.lit(False))))
    on_text = {"minLength": lambda n: F.length(text) >= n, "pattern": lambda p: text.rlike(p)}
    on_number = {
        "minimum": lambda n: number >= n, "maximum": lambda n: number <= n, "exclusiveMinimum": lambda n: number > n, "exclusiveMaximum": lambda n: number < n,
        "multipleOf": lambda n: number % F.lit(float(n)) == 0,
    }
    on_array = {
        "minItems": lambda n: F.size(items) >= n, "maxItems": lambda n: F.size(items) <= n,
        "uniqueItems": lambda on: F.size(F.array_distinct(texts)) == F.size(items) if on else F.lit(True),
    }
    for tests, applies in ((on_text, kind == "string"), (on_number, kind.isin("integer", "number")), (on_array, kind == "array")):
        out += [(name, ~applies | F.coalesce(test(schema[name]), F.lit(False))) for name, test in tests.items() if name in schema]
    return out


def _found(path: Column | str, rule: Column | None = None, node: int | None = None, items: Column | None = None, names: Column | None = None) -> Column:
    return F.struct(path, *(F.lit(None) if x is None else x for x in (rule, None if node is None else F.lit(node), items, names))).cast(_FOUND)


#: Members of a node, their type, and the keywords that look at them.
_MEMBERS = (
    ("items", "array<variant>", {"items", "minItems", "maxItems", "uniqueItems"}),
    ("fields", "map<string,variant>", {"properties", "required", "additionalProperties"}),
)


def _level(rows: DataFrame, keys: tuple[str, ...], level: list[tuple], root: dict) -> tuple[DataFrame, list[tuple]]:
    """The nodes of one level checked: keys and what they give, and the schemas of the next level. A schema of a
    level goes with the fields that it doesn't speak of, and the references that led to it."""
    given, following, n = [F.when(F.col("_rule").isNotNull(), _found("_path", F.col("_rule")))], [], 0
    pending = []
    for k, (schema, _, seen) in enumerate(level):
        mine = F.col("_node") == k
        if schema is False:
            given.append(F.when(mine, _found("_up", F.concat(F.lit("additional:"), "_name"))))
        else:
            pending.append((F.when(mine, F.col("_v")), F.col("_path"), schema, seen))
    while pending:
        # values, then members, types and whether these are right: each is a column, so it is worked out once
        values, members, kinds, right, more = {}, {}, {}, {}, []
        for i, (value, _, schema, _) in enumerate(pending, n):
            unknown = sorted(set(schema) - CHECKED - DESCRIBING)
            if unknown:
                raise SchemaError(f"unknown keywords {unknown}")
            v, kind = F.col(f"_v{i}"), F.col(f"_kind{i}")
            values[f"_v{i}"] = value
            held = [(name, F.try_variant_get(v, "$", of)) for name, of, words in _MEMBERS if words & set(schema)]
            members |= {f"_{name}{i}": x for name, x in held}
            # schema_of_variant walks all that is below; what has members is told by them
            told = _kind(F.schema_of_variant(v))
            for name, _ in held:
                told = F.when(F.col(f"_{name}{i}").isNotNull(), "array" if name == "items" else "object").otherwise(told)
            kinds[f"_kind{i}"] = told
            if "uniqueItems" in schema:
                kinds[f"_texts{i}"] = F.transform(f"_items{i}", lambda x: F.to_json(x))
            wanted = schema.get("type", [])
            wanted = wanted if isinstance(wanted, list) else [wanted]
            right[f"_right{i}"] = v.isNotNull() & (reduce(lambda a, b: a | b, (_is(kind, t) for t in wanted)) if wanted else F.lit(True))
        for columns in (values, members, kinds, right):
            rows = rows.withColumns(columns) if columns else rows
        for i, (_, path, schema, seen) in enumerate(pending, n):
            v, kind, ok, items, fields, texts = (F.col(f"_{x}{i}") for x in ("v", "kind", "right", "items", "fields", "texts"))
            is_object, named = ok & (kind == "object"), schema.get("properties", {})
            if "$ref" in schema:
                if schema["$ref"] in seen:
                    raise SchemaError(f"{schema['$ref']} refers to itself")
                more.append((v, path, resolve(schema["$ref"], root), (*seen, schema["$ref"])))
            if "type" in schema:
                given.append(F.when(v.isNotNull() & ~ok, _found(path, F.lit("type"))))
            given += [F.when(ok & ~holds, _found(path, F.lit(rule))) for rule, holds in _rules(v, kind, items, texts, schema)]
            for name in schema.get("required", []):
                given.append(F.when(is_object & F.try_element_at(fields, F.lit(name)).isNull(), _found(path, F.lit(f"required:{name}"))))
            for name, part in named.items():
                more.append((F.when(is_object, F.try_element_at(fields, F.lit(name))), F.concat(path, F.lit(f".{name}")), part, seen))
            extra = schema.get("additionalProperties", True)
            if extra is not True:
                given.append(F.when(is_object, _found(path, node=len(following), items=F.map_values(fields), names=F.map_keys(fields))))
                following.append((extra, tuple(named), seen))
            if "items" in schema:
                given.append(F.when(ok & (kind == "array"), _found(path, node=len(following), items=items)))
                following.append((schema["items"], (), seen))
        n, pending = n + len(pending), more
    return rows.select(*keys, F.explode(F.array(*given)).alias("_b")).where("_b is not null").select(*keys, "_b.*"), following


def violations(docs: DataFrame, doc: str, schema: dict, *keys: str) -> DataFrame:
    """keys, path, rule of all that is broken in the JSON texts of a column. A text that is no JSON
    breaks the rule json at $; a null text is no document. Schemas that refer to themselves are refused."""
    check(schema, "$")
    none, top = F.lit(None).cast("string"), F.lit("$")
    read = docs.select(*keys, doc, F.try_parse_json(doc).alias("_v"))
    no_json = F.when(F.col(doc).isNotNull() & F.col("_v").isNull(), "json")
    rows = read.select(*keys, top.alias("_path"), top.alias("_up"), none.alias("_name"), no_json.alias("_rule"), F.lit(0).alias("_node"), "_v")
    level = [(schema, (), ())]
    while True:
        found, level = _level(rows, keys, level, schema)
        if not level:
            return found.select(*keys, "path", "rule")
        each = found.select(*keys, "path", "rule", "node", "names", F.posexplode_outer("items").alias("_pos", "_v")).where("rule is not null or _pos is not null")
        name = F.get("names", F.col("_pos"))
        below = F.when(F.col("rule").isNotNull(), F.col("path")).when(name.isNull(), F.concat("path", F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.lit("."), name))
        rows = each.select(*keys, below.alias("_path"), F.col("path").alias("_up"), name.alias("_name"), F.col("rule").alias("_rule"), F.coalesce("node", F.lit(-1)).alias("_node"), "_v")
        for k, (_, named, _) in enumerate(level):
            if named:
                rows = rows.where((F.col("_node") != k) | ~F.col("_name").isin(*named))
