"""Reading and writing record sets: strict JSON Lines, personas in four formats, canonical JSON, manifests."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Folders that a recursive scan leaves out.
SKIPPED = ("images", ".cache")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON Lines with a stated schema. Blank lines are skipped, a bad line is an error when it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON value each, an object or an array of objects."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_any(spark: SparkSession, root: str, schema: StructType, formats: Sequence[str] = ("parquet", "jsonl", "json", "csv")) -> DataFrame:
    """All files below ``root`` of the four formats as one table; columns that a format lacks are null.

    No file of any format is an error, and so is a bad record or an unreadable file.
    """
    left_out = "/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path").filter(~F.col("path").rlike(left_out))
    there = {r[0] for r in listed.select(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).distinct().collect()}  # a few formats
    found = []
    for kind in (k for k in formats if k in there):
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}").option("mode", "FAILFAST").schema(schema)
        df = {"parquet": lambda r: r.parquet(root), "jsonl": lambda r: r.json(root), "json": lambda r: r.option("multiLine", True).json(root), "csv": lambda r: r.option("header", True).csv(root)}[kind](reader)
        found.append(df.filter(~F.col("_metadata.file_path").rlike(left_out)))
    if not found:
        raise FileNotFoundError(f"no records below {root}")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def age_between(df: DataFrame, age: str, low: int = 18, high: int | None = None) -> DataFrame:
    """Rows whose age is in range; an age that is not a number drops the row."""
    n = F.expr(f"try_cast({age} as int)")
    return df.filter((n >= low) & (n <= high) if high is not None else n >= low)


def sampled_personas(df: DataFrame, age: str, key: str, n: int | None = None, seed: str | None = None, low: int = 18, high: int | None = None) -> DataFrame:
    """Rows of the age range, then the first ``n`` by key, or ``n`` in seeded order: the range is applied before the limit."""
    from tidemark.operators.sets import hash_sample

    out = age_between(df, age, low, high)
    return out if n is None else out.orderBy(key).limit(n) if seed is None else hash_sample(out, n, seed, key)


def pushed_keys(spark: SparkSession, path: str, key: str, wanted: Sequence, columns: Sequence[str]) -> DataFrame:
    """Rows of a short stated list of keys from Parquet: the keys reach the scan as a filter, and only ``columns`` are read. A missing key raises."""
    out = spark.read.parquet(path).filter(F.col(key).isin(*wanted)).select(*dict.fromkeys([key, *columns]))
    have = {r[0] for r in out.select(key).distinct().collect()}  # at most as many as were asked for
    if lost := [k for k in wanted if k not in have]:
        raise KeyError(f"no rows for {lost}")
    return out


def rows_for(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in the table ``keys``; a key without a row raises, with an example.

    The keys stay a table: Spark joins them, behind a Bloom filter of its own
    where they are few beside ``rows``, and none comes to the driver.
    """
    wanted = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    if lost := wanted.join(rows.select(key), key, "left_anti").limit(1).collect():
        raise KeyError(f"no rows for {lost[0][0]!r}")
    return rows.join(wanted, key, "left_semi")


def checked_bank(df: DataFrame, fine: Column, what: str) -> DataFrame:
    """``df`` if every row is ``fine``; else an error with an example."""
    from tidemark.operators.audit import assert_none

    assert_none(df.filter(~F.coalesce(fine, F.lit(False))), what)
    return df


def schema_json(df: DataFrame) -> str:
    """The schema of a table as JSON, fields in their order."""
    return json.dumps(json.loads(df.schema.json()), ensure_ascii=False, indent=2)


def unique_by_key(df: DataFrame, keys: Sequence[str], wanted: DataFrame | None = None) -> DataFrame:
    """``df`` if its keys are unique and hold all ``wanted`` ones; else an error with an example."""
    from tidemark.operators.audit import assert_none
    from tidemark.operators.joins import duplicates

    assert_none(duplicates(df, keys), "a key is repeated")
    if wanted is not None:
        assert_none(wanted.join(df, list(keys), "left_anti"), "a key is missing")
    return df


def registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small registry file (one JSON array of objects) as a table. What is no array, or lacks or repeats a column's name, raises."""
    rows = json.loads(spark.read.text(path, wholetext=True).first()[0])
    names = [c.split()[0] for c in schema.split(",")]
    if not isinstance(rows, list) or any(not isinstance(r, dict) or set(r) - set(names) for r in rows):
        raise ValueError(f"not a registry of {names}: {path}")
    return spark.createDataFrame([[r.get(n) for n in names] for r in rows], schema)


def _in_order(c: Column, kind: DataType) -> Column:
    """A value with its struct fields and map keys in name order, at all depths."""
    match kind:
        case StructType():
            made = F.struct(*[_in_order(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
            return F.when(c.isNotNull(), made)
        case ArrayType():
            return F.transform(c, lambda x: _in_order(x, kind.elementType))
        case MapType():
            return F.map_from_entries(F.transform(F.array_sort(F.map_keys(c)), lambda k: F.struct(k, _in_order(F.element_at(c, k), kind.valueType))))
    return c


def canonical_json(df: DataFrame) -> Column:
    """JSON of all columns in name order at all depths, nulls kept: equal rows have equal text, so it can be hashed."""
    return F.to_json(F.struct(*[_in_order(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write a new table beside the old one and put it in its place when it is complete; a crash before leaves the old one."""
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    write(new)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop(path), True)
    if not fs.rename(hadoop(new), hadoop(path)):
        raise OSError(f"{new} is complete but could not be put in place as {path}")


def write_jsonl(df: DataFrame, path: str) -> int:
    """JSON Lines, keys in name order, nulls kept; the number of rows is returned."""
    spark = df.sparkSession
    replaced(spark, path, lambda new: df.select(canonical_json(df).alias("value")).write.text(new))
    return spark.read.text(path).count()


def write_csv(df: DataFrame, path: str) -> None:
    replaced(df.sparkSession, path, lambda new: df.write.option("header", True).csv(new))


def write_by_key(df: DataFrame, path: str, keys: Sequence[str], compression: str = "gzip") -> None:
    """Compressed JSON in one folder for each key."""
    replaced(df.sparkSession, path, lambda new: df.write.partitionBy(*keys).option("compression", compression).json(new))


def write_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """One CSV table for each part of a report."""
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}")


def table_digest(df: DataFrame) -> DataFrame:
    """One row: row count and a digest that does not depend on the order of rows: sums of two parts of 60 bits of each row's SHA-256."""
    sha = F.sha2(canonical_json(df), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", part(1), part(16)).alias("digest"))


def tree_digest(spark: SparkSession, root: str) -> DataFrame:
    """Name below ``root``, size and sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.col("path").cast("string")
    name = F.regexp_replace(at, "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_with_manifest(df: DataFrame, path: str, facts: Mapping[str, str]) -> DataFrame:
    """Write ``df`` as Parquet, then a manifest: facts, status, row count, digest. The manifest is last, so COMPLETE means a complete table.

    If writing fails the manifest says FAILED, and the error goes on.
    """
    spark = df.sparkSession

    def put(manifest: DataFrame) -> None:
        manifest.withColumns({k: F.lit(v) for k, v in facts.items()}).coalesce(1).write.mode("overwrite").json(f"{path}.manifest")

    try:
        replaced(spark, path, lambda new: df.write.parquet(new))
    except Exception as error:
        put(spark.createDataFrame([("FAILED", type(error).__name__)], "status string, reason string"))
        raise
    put(table_digest(spark.read.schema(df.schema).parquet(path)).withColumn("status", F.lit("COMPLETE")))
    return spark.read.json(f"{path}.manifest")


def export(df: DataFrame, allowed: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """The allowed columns that ``df`` has; a column that is neither allowed nor known raises."""
    from tidemark.operators.audit import assert_columns

    assert_columns(df, allowed, forbidden)
    return df.select(*[c for c in allowed if c in df.columns])
