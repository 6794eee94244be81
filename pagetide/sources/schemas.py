"""Declared record schemas (S03, G02): a field list in YAML, or a registered StructType."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values: declared type name to Spark type and to the default of an optional field
DECLARED_TYPES: dict[str, T.DataType] = {
    "str": T.StringType(), "string": T.StringType(), "int": T.LongType(), "integer": T.LongType(),
    "float": T.DoubleType(), "number": T.DoubleType(), "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "list[str]": T.ArrayType(T.StringType()), "list[int]": T.ArrayType(T.LongType()),
    "list[float]": T.ArrayType(T.DoubleType()), "dict": T.MapType(T.StringType(), T.StringType()),
    "dict[str,str]": T.MapType(T.StringType(), T.StringType()),
}
# ---- end of fixed values


def _fields(*names: str, kind: T.DataType | None = None) -> list[T.StructField]:
    return [T.StructField(n, kind or T.StringType()) for n in names]


_LIST, _MAP = T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())
BUILT_IN: dict[str, T.StructType] = {
    "news": T.StructType(
        _fields("title", "author", "publish_date", "source", "content", "summary", "category")
        + _fields("tags", kind=_LIST) + _fields("url")
    ),
    "product": T.StructType(
        _fields("name", "price", "original_price", "description", "brand", "category")
        + _fields("rating", kind=T.DoubleType()) + _fields("review_count", kind=T.IntegerType())
        + _fields("availability", "seller") + _fields("specifications", kind=_MAP)
        + _fields("images", kind=_LIST) + _fields("url")
    ),
    "job": T.StructType(
        _fields("title", "company", "location", "salary_range", "job_type", "experience_required",
                "education_required", "description")
        + _fields("requirements", "benefits", "skills", kind=_LIST) + _fields("posted_date", "url")
    ),
}


class SchemaRegistry:
    """Schemas by case-insensitive name."""

    def __init__(self):
        self._schemas = {name: (schema, {}) for name, schema in BUILT_IN.items()}

    def register(self, name: str, schema: T.StructType, defaults: dict | None = None) -> None:
        self._schemas[name.lower()] = (schema, defaults or {})

    def get(self, name: str) -> T.StructType | None:
        found = self._schemas.get(name.lower())
        return found[0] if found else None

    def defaults(self, name: str) -> dict:
        return self._schemas[name.lower()][1]

    def names(self) -> list[str]:
        return list(self._schemas)


def default_of(kind: T.DataType) -> Column:
    """Value of an optional field that a record does not have."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, (T.LongType, T.IntegerType, T.DoubleType)):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    return F.lit(None).cast(kind)


def parse_declared(document: dict) -> tuple[T.StructType, dict]:
    """StructType and explicit defaults of a declared schema; a required field is not nullable."""
    if not document or "fields" not in document:
        raise ValueError("a declared schema needs 'fields'")
    fields, defaults = [], {}
    for name, spec in document["fields"].items():
        kind = DECLARED_TYPES.get(str(spec.get("type", "str")).strip().lower(), T.StringType())
        required = bool(spec.get("required", False))
        fields.append(T.StructField(name, kind, not required, {"description": spec.get("description", "")}))
        if not required and spec.get("default") is not None:
            defaults[name] = spec["default"]
    return T.StructType(fields), defaults


def load_declared(path: str | Path) -> tuple[T.StructType, dict]:
    """Read a declared schema from a YAML file."""
    import yaml

    return parse_declared(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast(kind)
    if isinstance(value, dict):
        return F.create_map(*[F.lit(x) for pair in value.items() for x in pair]).cast(kind)
    return F.lit(value).cast(kind)


def apply_schema(
    df: DataFrame, schema: T.StructType, defaults: dict | None = None, payload: str = "payload"
) -> DataFrame:
    """JSON text to typed columns; optional fields get defaults, extras are ignored.

    Adds `missing_required`, the required fields a record lacks; the caller decides what to do
    with such rows.
    """
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    parsed = df.withColumn("_doc", F.from_json(payload, loose))
    columns = []
    for field in schema:
        value = F.col(f"_doc.`{field.name}`")
        if field.nullable:
            given = (defaults or {}).get(field.name)
            value = F.coalesce(value, default_of(field.dataType) if given is None else _literal(given, field.dataType))
        columns.append(value.alias(field.name))
    lacking = [F.when(F.col(f"_doc.`{f.name}`").isNull(), F.lit(f.name)) for f in schema if not f.nullable]
    missing = F.array_compact(F.array(*lacking)) if lacking else F.array().cast("array<string>")
    keep = [c for c in df.columns if c != payload]
    return parsed.select(*keep, *columns, missing.alias("missing_required"))
