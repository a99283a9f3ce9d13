"""File sources and sinks: CSV and parquet, with explicit schemas."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.schema import CLEAN_SCHEMA

# clean flights as stored: the row id first, then the 26 typed columns
CLEAN_FILE_SCHEMA = T.StructType([T.StructField("flight_id", T.LongType())] + CLEAN_SCHEMA.fields)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = CLEAN_FILE_SCHEMA,
             infer: bool = False, sep: str = ",") -> DataFrame:
    """CSV folder or file with a header row.

    An explicit schema (the default) avoids the extra inference pass over the data
    and keeps types stable between writes and reads; ``infer=True`` asks Spark to
    infer them instead.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    if infer or schema is None:
        reader = reader.option("inferSchema", True)
    else:
        reader = reader.schema(schema)
    return reader.csv(path)


def csv_headers(spark: SparkSession, path: str, sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """The files of a CSV folder by their header: names without blanks around them, in file order.

    Files are listed without their content; of each one the first line is read, in a small job that ends
    after it. A repeated name gets a number; a name that is blank stays empty.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path")
    paths = sorted(r["path"] for r in files.collect())  # one row a file

    def header(file: str) -> tuple[str, ...]:
        names, seen = [], {}
        for name in next(csv.reader([spark.read.text(file).first()["value"].lstrip("\ufeff")], delimiter=sep), []):
            name = name.strip()
            seen[name] = seen.get(name, 0) + 1
            names.append(name if not name or seen[name] == 1 else f"{name}_{seen[name]}")
        return tuple(names)

    found: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(8) as pool:
        for file, names in zip(paths, pool.map(header, paths)):
            found.setdefault(names, []).append(file)
    return found


def scan_csv_folder(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                    broken: str = "broken_row") -> DataFrame:
    """CSV files whose headers drifted, as one table: united by name, not by place.

    Files with the same header are one scan, typed by ``schema`` where it has the name and string elsewhere;
    unnamed columns (a header that ends in a separator) go, columns that a file lacks are NULL.
    A row with too few or too many fields, or a value that is not of its column's type, has its text
    in ``broken`` and NULL in all other columns, so no row is lost. Columns come in the order of ``schema``,
    then others by name. Empty files give no rows; an empty folder gives an empty table.
    """
    typed = {f.name: f.dataType for f in schema.fields}
    parts = []
    for names, files in sorted(csv_headers(spark, path, sep).items()):
        at = [n or f"_unnamed{i}" for i, n in enumerate(names)]
        fields = [T.StructField(n, typed.get(n, T.StringType())) for n in at]
        rows = (spark.read.schema(T.StructType([*fields, T.StructField("_text", T.StringType())]))
                .option("header", True).option("sep", sep).option("columnNameOfCorruptRecord", "_text")
                .option("columnPruning", False).csv(files))  # a pruned scan would not count the fields
        good = F.col("_text").isNull()
        # a scan may not be asked for the text alone: an empty piece of the first field goes with it
        text = F.concat("_text", F.substring(F.coalesce(F.col(f"`{at[0]}`").cast("string"), F.lit("")), 1, 0))
        parts.append(rows.select(*[F.when(good, F.col(f"`{n}`")).alias(n) for n in names if n], text.alias(broken)))
    empty = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(broken, T.StringType())]))
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, empty)
    others = sorted(set(table.columns) - set(typed) - {broken})
    return table.select(*[F.col(f"`{c}`") for c in [*typed, *others, broken]])


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists",
              rows_per_file: int = 0) -> str:
    """CSV with a header, written in parallel, in files of at most ``rows_per_file`` rows (0: one per
    partition). ``single_file`` funnels all rows through one task: use it only for small results."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] = ()) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
