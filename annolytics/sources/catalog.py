"""The dataset catalog and the seeding of users."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS_TYPE = "array<struct<name:string,type:string>>"

# The catalog's names of simple column types.
TYPE_NAMES = {
    "string": "string", "boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32",
    "bigint": "int64", "float": "float32", "double": "float64", "date": "date32",
    "timestamp": "timestamp[us, tz=UTC]", "timestamp_ntz": "timestamp[us]", "binary": "binary",
}

SEED_SCHEMA = (
    "users array<struct<id:string,name:string,global_role:string,project_roles:map<string,string>>>"
)


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"list<{type_name(kind.elementType)}>"
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join(f"{f.name}: {type_name(f.dataType)}" for f in kind.fields) + ">"
    if isinstance(kind, T.DecimalType):
        return f"decimal128({kind.precision}, {kind.scale})"
    return TYPE_NAMES.get(kind.simpleString(), kind.simpleString())


def dataset_profile(dataset_id: str, df: DataFrame) -> DataFrame:
    """``(dataset_id, num_rows, columns)``; for Parquet the count reads footers only."""
    columns = F.array(
        *[F.struct(F.lit(f.name).alias("name"), F.lit(type_name(f.dataType)).alias("type")) for f in df.schema.fields]
    )
    return df.agg(F.count("*").alias("num_rows")).select(F.lit(dataset_id).alias("dataset_id"), "num_rows", columns.alias("columns"))


def profile_all(datasets: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [dataset_profile(name, df) for name, df in datasets.items()])


def catalog_list(catalog: DataFrame) -> DataFrame:
    """The catalog, newest first, with its columns decoded from JSON text."""
    return catalog.withColumn("columns", F.from_json("columns", COLUMNS_TYPE)).orderBy(F.desc("created_at"), "dataset_id")


def seed_users(spark, path: str, existing: DataFrame | None = None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Users and permissions from seed files ``{"users": [...]}``; nothing when users exist.

    The first entry of a user id wins, and the first role of a (user, project).
    """
    seeds = spark.read.schema(SEED_SCHEMA).option("multiLine", not lines).json(path)
    if existing is not None and not existing.isEmpty():
        seeds = seeds.where(F.lit(False))
    entries = seeds.select(F.monotonically_increasing_id().alias("_doc"), F.posexplode("users").alias("_no", "u")).select(
        F.struct("_doc", "_no").alias("_seq"), "u.*"
    )
    users = entries.groupBy(F.col("id").alias("user_id")).agg(F.min_by(F.struct("name", "global_role"), "_seq").alias("_u"))
    roles = entries.select("_seq", F.col("id").alias("user_id"), F.explode("project_roles").alias("project_id", "role"))
    permissions = roles.groupBy("user_id", "project_id").agg(F.min_by("role", "_seq").alias("role"))
    return users.select("user_id", "_u.name", "_u.global_role"), permissions
