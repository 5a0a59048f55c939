"""Stages named by their content, and folders of files that are read once.

A stage's folder carries a digest of everything its rows depend on: the files it reads, its parameters and the source of
the function that builds it.  Asking for it again reads what is stored; a changed file, parameter or function names another
folder, which is built.  A folder of delivered files is taken in through a manifest of content hashes, so a file is parsed
once however often the folder is listed, and files whose columns differ are reconciled against one declared schema.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridgeline.functions.numeric import quoted
from ridgeline.functions.sizing import written
from ridgeline.sources.readers import path_exists

MANIFEST = "path string, length long, digest string"


def files_under(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of every data file at or below a path, in order; names only, nothing is read."""
    start = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = start.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(start, True)
    out = []
    while found.hasNext():
        status = found.next()
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            out.append((str(status.getPath()), int(status.getLen()), int(status.getModificationTime())))
    return sorted(out)


def stage_digest(spark: SparkSession, build: Callable, inputs: Iterable[str] = (), params: dict | None = None) -> str:
    """A digest of the input files (path, length, time), the parameters and the builder's source."""
    told = {
        "files": [files_under(spark, p) for p in inputs],
        "params": params or {},
        "code": inspect.getsource(build),
    }
    return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()


def stage(
    spark: SparkSession,
    root: str,
    name: str,
    build: Callable[..., DataFrame],
    inputs: Iterable[str] = (),
    params: dict | None = None,
) -> DataFrame:
    """The rows of ``build(**params)``, stored under ``root`` by their digest, or read from there.

    A folder counts only when its write came to an end; one left half written is built anew.
    """
    path = f"{root}/{name}-{stage_digest(spark, build, inputs, params)[:24]}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build(**(params or {})).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def manifest_of(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, length, digest, header) of the folder's files; the contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    first = F.regexp_extract(F.decode("content", "UTF-8"), r"^\x{FEFF}?([^\r\n]*)", 1)
    return files.select("path", F.col("length"), F.sha2("content", 256).alias("digest"), first.alias("header"))


def read_reconciled(spark: SparkSession, files: DataFrame, schema: str) -> DataFrame:
    """CSV files (path, header) of any column order as the declared columns, plus ``source_file``.

    Files are read in one scan per distinct header.  Columns that a file lacks are NULL, ones that are not declared
    are left out, and nothing is inferred; a file without any declared column gives no rows.
    """
    wanted = StructType.fromDDL(schema)
    kinds = {f.name: f.dataType.simpleString() for f in wanted}
    frames = [spark.createDataFrame([], wanted.add("source_file", "string"))]
    paths = files.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    for row in paths.orderBy("header").collect():  # one entry per file: names, no contents
        names = [c.strip().strip('"') for c in row.header.split(",")]
        if not any(c in kinds for c in names):
            continue
        ddl = ", ".join(f"{quoted(c)} {kinds.get(c, 'string')}" for c in names)
        rows = spark.read.schema(ddl).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(list(row.paths))
        cols = [F.col(quoted(n)) if n in names else F.lit(None).cast(k).alias(n) for n, k in kinds.items()]
        frames.append(rows.select(*cols, F.col("_metadata.file_path").alias("source_file")))
    return reduce(DataFrame.unionByName, frames)


def take_in(spark: SparkSession, folder: str, store: str, schema: str, pattern: str = "*.csv") -> DataFrame:
    """Everything taken in so far from a folder that files are delivered to.

    Files whose content the store's manifest does not know are parsed and appended; of files of equal content in
    one delivery the first path counts.  The rows of a delivery and its manifest carry the delivery's number, and the
    manifest is written last: rows of a delivery that it does not list, left by a lost run, are not read.
    """
    rows_at, list_at = f"{store}/rows", f"{store}/manifest"
    listed = manifest_of(spark, folder, pattern)
    known = spark.read.schema(f"{MANIFEST}, delivery int").parquet(list_at) if path_exists(spark, list_at) else None
    fresh = listed if known is None else listed.join(known.select("digest").distinct(), "digest", "left_anti")
    first = fresh.groupBy("digest").agg(F.min_by(F.struct("path", "length", "header"), "path").alias("f")).select("digest", "f.*")
    first = written(first, "manifest")
    last = None if known is None else known.agg(F.max("delivery")).first()[0]
    number = 0 if last is None else last + 1
    if first.limit(1).count():
        delivered = read_reconciled(spark, first, schema)
        delivered.write.mode("overwrite").parquet(f"{rows_at}/delivery={number}")
        first.select("path", "length", "digest", F.lit(number).alias("delivery")).write.mode("append").parquet(list_at)
    if not path_exists(spark, list_at):
        return read_reconciled(spark, first, schema)
    listed_numbers = [r.delivery for r in spark.read.parquet(list_at).select("delivery").distinct().collect()]  # one per delivery
    fields = StructType.fromDDL(schema).add("source_file", "string")
    return spark.read.schema(fields).parquet(*[f"{rows_at}/delivery={n}" for n in sorted(listed_numbers)])


def load_and_merge(
    spark: SparkSession,
    paths: dict[str, str],
    schemas: dict[str, str],
    merge: Callable[[dict[str, DataFrame]], DataFrame],
    target: str | None = None,
) -> DataFrame:
    """Read those of the named sources that exist, each under its declared schema, merge them and store the result."""
    from ridgeline.sources.readers import read_available

    merged = merge(read_available(spark, paths, schemas))
    if target is None:
        return merged
    merged.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
