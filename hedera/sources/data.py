"""Where data come from, which columns are read, and what is checked before a model is fitted."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import DataTypeError, InputError, MissingDataError
from ..functions.spec import IDENTIFIERS, Requirement, data_requirements, merge_requirements
from .scratch import written


class DataSource:
    """A projected source: label, preview(columns, n), scan(columns)."""

    def __init__(self, label: str):
        self.label = label

    def frame(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def scan(self, spark: SparkSession, columns: Sequence[str] | None = None) -> DataFrame:
        df = self.frame(spark)
        return df if columns is None else ordered_projection(df, columns)

    def preview(self, spark: SparkSession, columns: Sequence[str] | None = None, n: int = 2048) -> DataFrame:
        return self.scan(spark, columns).limit(n)

    def materialize(self, spark: SparkSession, columns: Sequence[str] | None = None) -> DataFrame:
        return written(self.scan(spark, columns))


class DataFrameSource(DataSource):
    """A Spark or pandas DataFrame."""

    def __init__(self, data, label: str = "dataframe"):
        super().__init__(label)
        self.data = data

    def frame(self, spark: SparkSession) -> DataFrame:
        return self.data if isinstance(self.data, DataFrame) else spark.createDataFrame(self.data)


class FileSource(DataSource):
    """A file or folder in a format of Spark's readers."""

    format = "parquet"
    defaults: dict = {}

    def __init__(self, path: str, schema=None, **options):
        super().__init__(str(path))
        self.path, self.schema, self.options = str(path), schema, options

    def frame(self, spark: SparkSession) -> DataFrame:
        r = spark.read.format(self.format).options(**(self.defaults | self.options))
        return (r.schema(self.schema) if self.schema else r).load(self.path)


class ParquetSource(FileSource):
    pass


class CSVSource(FileSource):
    format, defaults = "csv", {"header": True, "inferSchema": True}


class StataSource(DataSource):
    """A .dta file, which pandas reads on the driver in pieces; it must be on a path that the driver can open."""

    def __init__(self, path: str, rows: int = 500_000, **options):
        super().__init__(str(path))
        self.path, self.rows, self.options = str(path), rows, options

    def frame(self, spark: SparkSession) -> DataFrame:
        import pandas as pd

        parts = [spark.createDataFrame(p) for p in pd.read_stata(self.path, chunksize=self.rows, **self.options)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def as_data_source(data) -> DataSource:
    """A source for a DataFrame or a path ending in .csv, .txt, .dta, .parquet or .pq."""
    if isinstance(data, DataSource):
        return data
    if isinstance(data, (str, os.PathLike)):
        end = os.path.splitext(str(data))[1].lower()
        made = {".csv": CSVSource, ".txt": CSVSource, ".dta": StataSource, ".parquet": ParquetSource, ".pq": ParquetSource}.get(end)
        if made is None:
            raise InputError(f"no reader for {data}", code="data.format")
        return made(str(data))
    return DataFrameSource(data)


def ordered_projection(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InputError(f"no column {missing[0]!r}", code="data.missing_column", details={"missing": missing})
    return df.select(*(F.col(f"`{c}`") for c in dict.fromkeys(columns)))


def materialize_model_data(spark: SparkSession, data, **roles) -> DataFrame:
    """Only the columns that a specification reads."""
    return as_data_source(data).scan(spark, [r.column for r in data_requirements(**roles)])


def prepare_repeated_dataset(spark: SparkSession, data, specifications: Sequence[dict], common: dict | None = None) -> DataFrame:
    """The union of the columns of many specifications, written once."""
    needs = merge_requirements(*(data_requirements(**(common or {}), **s) for s in specifications))
    return as_data_source(data).materialize(spark, [r.column for r in needs])


def encoded(df: DataFrame, column: str, code: str | None = None) -> tuple[DataFrame, DataFrame]:
    """df with an integer code for an identifier, and the dictionary (level, code, n). Codes count levels in order; a null has none."""
    from pyspark.sql import Window

    levels = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    # One row a level; the order is global, so this one step is not split.
    levels = levels.withColumn("code", (F.row_number().over(Window.orderBy("level")) - 1).cast("long"))
    out = df.join(levels.select(F.col("level").alias("_level"), F.col("code").alias(code or f"{column}_code")), F.col(column) == F.col("_level"), "left").drop("_level")
    return out, levels


def content_fingerprint(df: DataFrame) -> str:
    """A hash of all rows, whatever their order or partitions."""
    row = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    a = df.agg(F.sum(row.cast("decimal(38,0)")), F.bit_xor(row), F.count(F.lit(1))).first()
    return hashlib.blake2b(json.dumps([df.dtypes, str(a[0]), a[1], a[2]]).encode(), digest_size=16).hexdigest()


def file_fingerprint(df: DataFrame) -> str:
    """A hash of the paths, sizes and times of the files behind df, without reading rows' contents."""
    rows = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    return hashlib.blake2b(repr(sorted(map(str, rows))).encode(), digest_size=16).hexdigest()


# ------------------------------------------------------------------------------------------------------------- checks


def numeric(df: DataFrame, column: str, role: str = "regressor") -> Column:
    """The column as double; text, times and nested types are refused."""
    t = df.schema[column].dataType
    if not isinstance(t, (T.NumericType, T.BooleanType)):
        raise DataTypeError(f"{column!r} ({role}) is {t.simpleString()}, not numeric", code="data.non_numeric", details={"column": column, "role": role})
    return F.col(f"`{column}`").cast("double")


def bad_number(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def require(df: DataFrame, numbers: dict[str, str], identifiers: dict[str, str], nonnegative: Sequence[str] = (), positive: Sequence[str] = ()) -> int:
    """The number of rows, after one pass that refuses missing or non-finite numbers, missing identifiers and wrong signs."""
    checks = [F.count(F.lit(1)).alias("n")]
    checks += [F.count_if(bad_number(F.col(c))).alias(f"bad_{c}") for c in numbers]
    for c in identifiers:
        x = F.col(c)
        nan = F.isnan(x) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.lit(False)
        checks.append(F.count_if(x.isNull() | nan).alias(f"null_{c}"))
    checks += [F.count_if(F.col(c) < 0).alias(f"neg_{c}") for c in nonnegative] + [F.count_if(F.col(c) <= 0).alias(f"pos_{c}") for c in positive]
    got = df.agg(*checks).first().asDict()
    for what, names, text in (("bad", numbers, "missing or non-finite values"), ("null", identifiers, "missing identifiers")):
        for c, label in names.items():
            if got[f"{what}_{c}"]:
                raise MissingDataError(f"{label!r} has {got[f'{what}_{c}']} {text}", details={"column": label, "rows": got[f"{what}_{c}"]}, suggestion="filter these rows first; none are dropped silently")
    for what, names, text in (("neg", nonnegative, "negative values"), ("pos", positive, "values that are not positive")):
        for c in names:
            if got[f"{what}_{c}"]:
                raise InputError(f"{c!r} has {got[f'{what}_{c}']} {text}", code="data.sign")
    return got["n"]


@dataclass(frozen=True)
class Issue:
    code: str
    column: str | None
    severity: str
    rows: int


def preflight(df: DataFrame, requirements: Sequence[Requirement], model: str | None = None, level: str = "basic") -> list[Issue]:
    """What would make a fit fail or doubtful: missing columns, wrong types, missing or non-finite values, signs; with level
    'strict' also few clusters (under 30), nearly constant columns, weights over a ratio of 1e6 and shares of zeros over 99%."""
    issues, exprs = [], []
    for r in requirements:
        if r.column not in df.columns:
            issues.append(Issue("missing_column", r.column, "error", 0))
            continue
        c, t = F.col(f"`{r.column}`"), df.schema[r.column].dataType
        is_number = isinstance(t, (T.NumericType, T.BooleanType))
        if set(r.roles) - IDENTIFIERS - {"time", "panel"}:
            if not is_number:
                issues.append(Issue("non_numeric", r.column, "error", 0))
                continue
            x = c.cast("double")
            exprs += [F.count_if(x.isNull() | F.isnan(x)).alias(f"missing|{r.column}"), F.count_if(F.abs(x) == float("inf")).alias(f"non_finite|{r.column}")]
            if "outcome" in r.roles and model in ("ppml", "ivppml"):
                exprs.append(F.count_if(x < 0).alias(f"negative_outcome|{r.column}"))
                if level == "strict":
                    exprs.append((F.count_if(x == 0) / F.count(F.lit(1)) > 0.99).cast("int").alias(f"extreme_zero_share|{r.column}"))
            if "exposure" in r.roles:
                exprs.append(F.count_if(x <= 0).alias(f"non_positive_exposure|{r.column}"))
            if level == "strict" and "weight" in r.roles:
                exprs.append((F.max(x) > 1e6 * F.min(x)).cast("int").alias(f"extreme_weights|{r.column}"))
            if level == "strict" and "regressor" in r.roles:
                exprs.append((F.stddev_samp(x) <= 1e-12 * F.greatest(F.lit(1.0), F.max(F.abs(x)))).cast("int").alias(f"near_constant|{r.column}"))
        else:
            exprs.append(F.count_if(c.isNull()).alias(f"missing|{r.column}"))
        if level == "strict" and "cluster" in r.roles:
            exprs.append((F.count_distinct(c) < 30).cast("int").alias(f"few_clusters|{r.column}"))
    if exprs:
        for name, n in df.agg(*exprs).first().asDict().items():
            code, _, column = name.partition("|")
            if n:
                soft = code in ("few_clusters", "near_constant", "extreme_weights", "extreme_zero_share")
                issues.append(Issue(code, column, "warning" if soft else "error", int(n)))
    return issues


@dataclass
class SampleHistory:
    """Which stages removed how many rows; stages only remove."""

    stages: list[tuple[str, int]] = field(default_factory=list)

    def note(self, stage: str, rows: int) -> None:
        if rows:
            self.stages.append((stage, rows))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.stages, "stage string, rows long")
