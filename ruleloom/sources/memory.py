"""Working memory: typed tables of facts, templates, initial facts and globals."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindError, CatalogError

TYPES = {"String": T.StringType(), "Integer": T.LongType(), "Float": T.DoubleType(), "Boolean": T.BooleanType(), "Any": T.StringType()}


@dataclass
class Template:
    """Declared fields of a fact type: name -> (type, required, default); Array(T) for arrays."""

    name: str
    fields: dict = field(default_factory=dict)

    def type(self, name: str) -> T.DataType:
        kind = self.fields[name][0]
        return T.ArrayType(TYPES[kind[6:-1]]) if kind.startswith("Array(") else TYPES[kind]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, self.type(n), not required) for n, (_, required, _) in self.fields.items()])

    def with_defaults(self, df: DataFrame) -> DataFrame:
        out = {}
        for n, (_, _, default) in self.fields.items():
            have = F.col(n) if n in df.columns else F.lit(None).cast(self.type(n))
            out[n] = have if default is None else F.coalesce(have, F.lit(default).cast(self.type(n)))
        return df.withColumns(out)

    def valid(self, df: DataFrame) -> DataFrame:
        """The rows without violations."""
        return self._judged(df).filter(F.size("reasons") == 0).drop("reasons")

    def violations(self, df: DataFrame) -> DataFrame:
        """The rows that lack required fields or whose field is of another type, with the reasons. Types are a table's, so a
        field of another type is wrong in every row that has a value there (an integer is no float)."""
        return self._judged(df).filter(F.size("reasons") > 0)

    def _judged(self, df: DataFrame) -> DataFrame:
        why = []
        for n, (kind, required, _) in self.fields.items():
            if n not in df.columns:
                why.append(F.lit(f"{n} is missing") if required else F.lit(None).cast("string"))
                continue
            if required:
                why.append(F.when(F.col(n).isNull(), f"{n} is missing"))
            if kind != "Any" and df.schema[n].dataType != self.type(n):
                why.append(F.when(F.col(n).isNotNull(), f"{n} is no {kind}"))
        return df.withColumn("reasons", F.array_compact(F.array(*why)))


class WorkingMemory:
    """Fact type -> table with fact_id; changes give new tables, retracted rows are kept with a mark."""

    META = ("fact_id", "update_count", "is_retracted", "stream_source")

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.templates, self.deffacts = spark, {}, {}, {}

    def _with_meta(self, df: DataFrame, key: Column | None, source: str | None) -> DataFrame:
        id_ = key if key is not None else F.xxhash64(*[F.col(c) for c in df.columns])
        return df.withColumns({"fact_id": id_, "update_count": F.lit(0), "is_retracted": F.lit(False), "stream_source": F.lit(source).cast("string")})

    def insert(self, kind: str, df: DataFrame, key: Column | None = None, source: str | None = None) -> DataFrame:
        """Adds facts; with a template, rows that violate it are an error. key gives fact_id, else a hash of the row."""
        if kind in self.templates:
            df = self.templates[kind].with_defaults(df)
            if not self.templates[kind].violations(df).isEmpty():
                raise BindError(f"facts do not fit template {kind!r}")
        new = self._with_meta(df, key, source)
        self.tables[kind] = self.tables[kind].unionByName(new, allowMissingColumns=True) if kind in self.tables else new
        return new

    def update(self, kind: str, rows: DataFrame) -> None:
        """Whole-row replacement by fact_id."""
        old = self.tables[kind]
        touched = old.join(rows.select("fact_id"), "fact_id", "left_semi").select("fact_id", (F.col("update_count") + 1).alias("update_count"), "is_retracted", "stream_source")
        self.tables[kind] = old.join(rows.select("fact_id"), "fact_id", "left_anti").unionByName(rows.join(touched, "fact_id"), allowMissingColumns=True)

    def retract(self, kind: str, ids: DataFrame) -> None:
        """Marks facts; a second retraction of the same is an error."""
        old, mark = self.tables[kind], ids.select(F.col("fact_id").alias("_r")).distinct()
        if not old.join(mark, F.col("fact_id") == F.col("_r")).filter("is_retracted").isEmpty():
            raise CatalogError("facts are retracted already")
        self.tables[kind] = old.join(mark, F.col("fact_id") == F.col("_r"), "left").withColumn("is_retracted", F.col("is_retracted") | F.col("_r").isNotNull()).drop("_r")

    def get(self, kind: str) -> DataFrame:
        return self.tables[kind].filter(~F.col("is_retracted"))

    def get_all(self) -> DataFrame:
        """fact_id, type, fact (JSON) of all facts that are not retracted, of every type."""
        out = None
        for kind in self.tables:
            live = self.get(kind)
            body = F.to_json(F.struct(*[c for c in live.columns if c not in self.META]))
            one = live.select(F.col("fact_id").cast("string").alias("fact_id"), F.lit(kind).alias("type"), body.alias("fact"))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "fact_id string, type string, fact string")

    def flattened(self) -> DataFrame:
        """path, value (text): a row for each field of each fact that is not retracted, as `Type.fact_id.field`."""
        fields = F.from_json("fact", "map<string,string>")
        rows = self.get_all().select("type", "fact_id", F.explode(fields).alias("field", "value"))
        return rows.select(F.concat_ws(".", "type", "fact_id", "field").alias("path"), "value")

    def insert_stream(self, kind: str, events: DataFrame, source: str, event_type: str | None = None, key: Column | None = None) -> DataFrame:
        """Adds a stream's events (of one type) as facts that name the stream they came from."""
        rows = events if event_type is None else events.filter(F.col("event_type") == event_type)
        return self.insert(kind, rows, key, source)

    def define(self, template: Template) -> None:
        self.templates[template.name] = template

    def register_deffacts(self, name: str, facts: list[tuple[str, DataFrame]]) -> None:
        if name in self.deffacts:
            raise CatalogError(f"facts {name!r} exist")
        self.deffacts[name] = facts

    def load_deffacts(self, name: str | None = None, skip_invalid: bool = False) -> None:
        """Inserts initial facts; skip_invalid leaves out those that violate their template, else they are an error."""
        for n in [name] if name else list(self.deffacts):
            for kind, df in self.deffacts[n]:
                if skip_invalid and kind in self.templates:
                    df = self.templates[kind].valid(df)
                self.insert(kind, df)

    def reset_with_deffacts(self) -> None:
        self.tables = {}
        self.load_deffacts()


def inferred(df: DataFrame) -> DataFrame:
    """Text columns as the first of long, double and boolean that fits all of a column's values, else text."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    tests = {(c, k): F.bool_and(F.col(c).isNull() | F.col(c).try_cast(k).isNotNull()).alias(f"{c}|{k}") for c in texts for k in ("long", "double", "boolean")}
    if not tests:
        return df
    row = df.agg(*tests.values()).first()
    kind = {c: next((k for k in ("long", "double", "boolean") if row[f"{c}|{k}"]), None) for c in texts}
    return df.withColumns({c: F.col(c).cast(k) for c, k in kind.items() if k})


def facts_from_json(spark: SparkSession, documents: list[str] | DataFrame, ddl: str) -> DataFrame:
    """Facts of JSON documents (texts, or a table with column json); a field that is absent or of another type is null."""
    df = documents if isinstance(documents, DataFrame) else spark.createDataFrame([(d,) for d in documents], "json string")
    return df.select(F.from_json("json", ddl).alias("f")).select("f.*")


def facts_to_json(df: DataFrame) -> DataFrame:
    """json: each fact as a document, null fields left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def to_context(df: DataFrame) -> list[dict]:
    """Facts as plain dictionaries, for callers that hold a few."""
    return [r.asDict(recursive=True) for r in df.collect()]


def from_context(spark: SparkSession, context: list[dict], ddl: str) -> DataFrame:
    names = [f.name for f in T.StructType.fromDDL(ddl)]
    return spark.createDataFrame([tuple(c.get(n) for n in names) for c in context], ddl)


def with_fields(df: DataFrame, **values) -> DataFrame:
    """Sets fields of all facts; None clears one."""
    return df.withColumns({n: v if isinstance(v, Column) else F.lit(v) if v is not None else F.lit(None).cast(df.schema[n].dataType if n in df.columns else "string") for n, v in values.items()})


def without_fields(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


# The fields by which rules know facts of these shapes.
SHAPES = {
    "User": "Name string, Age long, Email string, Country string, IsVIP boolean", "Product": "Name string, Price double, Category string, InStock boolean, StockCount long",
    "Order": "ID string, UserID string, Total double, ItemCount long, Status string", "Transaction": "ID string, Amount double, Location string, Timestamp long, UserID string",
    "TestCar": "speedUp boolean, Speed double, maxSpeed double, SpeedIncrement double", "DistanceRecord": "TotalDistance double",
}


def build(spark: SparkSession, shape: str, **fields) -> DataFrame:
    """One fact of a known shape; fields that are not given are null."""
    unknown = set(fields) - {f.name for f in T.StructType.fromDDL(SHAPES[shape])}
    if unknown:
        raise BindError(f"{shape} has no fields {sorted(unknown)}")
    return from_context(spark, [fields], SHAPES[shape])


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Records of both, of equal keys the right one's fields where it has them."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    both = left.join(r, left[key] == F.col(f"_r_{key}"), "full_outer")
    names = list(dict.fromkeys([*left.columns, *right.columns]))
    pick = [F.coalesce(*([F.col(f"_r_{c}")] if c in right.columns else []), *([left[c]] if c in left.columns else [])).alias(c) for c in names]
    return both.select(*pick)


class Globals:
    """Named scalars, some read-only; as literals in expressions."""

    def __init__(self):
        self.values, self.constants = {}, set()

    def define(self, name: str, value, read_only: bool = False) -> None:
        if name in self.values:
            raise CatalogError(f"global {name!r} exists")
        self.values[name] = value
        if read_only:
            self.constants.add(name)

    def set(self, name: str, value) -> None:
        if name not in self.values or name in self.constants:
            raise CatalogError(f"global {name!r} cannot be set")
        self.values[name] = value

    def increment(self, name: str, by: float = 1) -> None:
        self.set(name, self.values[name] + by)

    def column(self, name: str) -> Column:
        return F.lit(self.values[name])


def template_from_json(text: str) -> Template:
    d = json.loads(text)
    return Template(d["name"], {k: tuple(v) for k, v in d["fields"].items()})


def template_to_json(t: Template) -> str:
    return json.dumps({"name": t.name, "fields": t.fields})
