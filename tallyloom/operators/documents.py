"""Nested values: the strings of JSON documents, and the faults of nested records by rules that their schema declares."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from tallyloom.sources.staging import staged


def strings(df: DataFrame, by: str, document: str) -> DataFrame:
    """(by, path, value) of every string in a column of JSON texts, at any depth: `a.b[0]`, and '' for a bare string.

    Documents are parsed once, as variants; each round opens the objects and arrays of one level more, so there are as many
    rounds as the deepest document has levels, and rows are split on the way, not held by document. What does not parse, or
    names a key of an object twice, has none.
    """
    level = df.select(by, F.lit("").alias("path"), F.try_parse_json(document).alias("v")).where("v is not null")
    out = None
    while True:
        level = staged(level.withColumn("kind", F.schema_of_variant("v")))
        here = level.where("kind = 'STRING'").select(by, "path", F.try_variant_get("v", "$", "string").alias("value"))
        out = here if out is None else out.unionByName(here)
        open_ = level.where("kind like 'OBJECT%' or kind like 'ARRAY%'").select(by, "path", "v")
        if open_.isEmpty():
            return out
        each = open_.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
        inner = F.concat("path", F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat(F.lit("."), F.col("key"))))
        level = each.select(by, inner.alias("path"), F.col("value").alias("v"))


#: What a field may declare. Each makes, of a value and what was declared, the condition that it must fulfil.
RULES = {
    "least": lambda v, x: v >= F.lit(x),
    "most": lambda v, x: v <= F.lit(x),
    "one_of": lambda v, x: v.isin(list(x)),
    "pattern": lambda v, x: v.rlike(x),
    "min_length": lambda v, x: F.char_length(F.trim(v)) >= x,
    "max_length": lambda v, x: F.char_length(v) <= x,
    "min_items": lambda v, x: F.size(v) >= x,
    "max_items": lambda v, x: F.size(v) <= x,
    "unique": lambda v, x: F.size(F.array_distinct(v)) == F.size(v),
}
_FAULT = "array<struct<path:string,rule:string,value:string>>"


def declared(name: str, kind: DataType, required: bool = False, **rules: Any) -> StructField:
    """A field with the rules that its values must keep; they lie in the field's metadata, and so stay with the schema."""
    if unknown := set(rules) - set(RULES):
        raise ValueError(f"no such rules: {sorted(unknown)}")
    return StructField(name, kind, True, {"rules": {"required": required} | rules})


def _shown(value: Column, kind: DataType) -> Column:
    return F.to_json(value) if isinstance(kind, (StructType, ArrayType, MapType)) else value.cast("string")


def _walk(value: Column, kind: DataType, rules: dict[str, Any], path: Column) -> Iterator[Column]:
    """Arrays of faults of one value and of what lies in it."""
    own = [F.when(value.isNull(), F.lit("required"))] if rules.get("required") else []
    own += [F.when(~RULES[name](value, x), F.lit(name)) for name, x in rules.items() if name != "required"]
    if own:
        broken = F.filter(F.array(*own), lambda r: r.isNotNull())
        yield F.transform(broken, lambda r: F.struct(path.alias("path"), r.alias("rule"), _shown(value, kind).alias("value")))
    if isinstance(kind, StructType):
        for f in kind.fields:
            within = [*_walk(value[f.name], f.dataType, dict(f.metadata.get("rules", {})), F.concat(path, F.lit(f".{f.name}")))]
            for faults in within:
                yield F.when(value.isNotNull(), faults)
    if isinstance(kind, ArrayType) and [*_walk(F.lit(None).cast(kind.elementType), kind.elementType, {}, path)]:
        yield F.flatten(F.transform(value, lambda x, i: _all(_walk(x, kind.elementType, {}, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    if isinstance(kind, MapType) and [*_walk(F.lit(None).cast(kind.valueType), kind.valueType, {}, path)]:
        each = lambda e: _all(_walk(e["value"], kind.valueType, {}, F.concat(path, F.lit("."), e["key"].cast("string"))))
        yield F.flatten(F.transform(F.map_entries(value), each))


def _all(faults: Iterator[Column]) -> Column:
    none = F.array().cast(_FAULT)
    return F.concat(none, *(F.coalesce(f.cast(_FAULT), none) for f in faults))


def faults(schema: StructType, prefix: str = "") -> Column:
    """array of struct(path, rule, value) over a row's columns: every rule of the schema that a value breaks, with the value's
    place, `lines[2].quantity`. Rules of a null say nothing but `required`; a null struct or list has no faults within.
    Conditions are compiled from the schema to one expression; the rows' data is walked in the engine."""
    parts = [w for f in schema.fields for w in _walk(F.col(f.name), f.dataType, dict(f.metadata.get("rules", {})), F.lit(f"{prefix}{f.name}"))]
    return _all(iter(parts))


def violations(df: DataFrame, by: str, schema: StructType) -> DataFrame:
    """(by, path, rule, value): a row for each rule broken, of the columns that the schema names."""
    return df.select(by, F.inline(faults(schema)))
