"""What the operators share: scratch tables, text normalisation, skew-safe lookups."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space of the word and line contracts: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of the bounded broadcast of `attach`: the largest groups.
HEAVY_ROWS = 1000
#: Texts that one Arrow batch carries to Python at most; Spark also bounds its bytes.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one of ours if unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not (own := getattr(shared_dir, "own", None)):
        own = shared_dir.own = tempfile.mkdtemp(prefix="quillseek-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return "file://" + os.path.abspath(own)


def scratch_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/quillseek/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application's operators have stored: once their results are written, nothing reads them."""
    remove_path(spark, scratch_dir(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that `stored` wrote and nothing reads any more."""
    for frame in frames:
        if path := getattr(frame, "scratch", None):
            remove_path(spark, path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quillseek_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    if package.parent.is_dir():  # else we run from a shipped archive ourselves
        folder = tempfile.mkdtemp(prefix="quillseek-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/quillseek_package.zip", "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.writestr(f"{package.name}/{f.relative_to(package)}", f.read_text(encoding="utf-8"))
        context.addPyFile(f"{folder}/quillseek_package.zip")
    context._quillseek_shipped = True


def small_batches(spark: SparkSession) -> None:
    """For operators that run Python: ship the package, and make Arrow batches at most BATCH_ROWS rows, unless the session asks for still smaller ones."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast path of lower(), where both agree."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "left") -> DataFrame:
    """rows left-joined with groups (one row a key), safe where few keys hold most rows.

    The HEAVY_ROWS largest groups by `size` are broadcast: that is a fixed number of rows
    of hashes and ids. What remains joins by a shuffle in which a heavy row travels under
    a random key of its own, so no task gathers a hot group; any remaining group holds at
    most 1/HEAVY_ROWS of the rows.
    """
    values = [c for c in groups.columns if c not in keys]
    name = {c: free_name(rows, f"__{c}") for c in ("heavy", "spread", "light", "zero", *[f"h_{k}" for k in keys], *[f"l_{k}" for k in keys])}
    heavy = groups.orderBy(F.desc(size), *keys).limit(HEAVY_ROWS)
    heavy = heavy.select(*[F.col(k).alias(name[f"h_{k}"]) for k in keys], F.struct(*values).alias(name["heavy"]))
    found = rows.join(F.broadcast(heavy), [F.col(k) == F.col(name[f"h_{k}"]) for k in keys], "left").drop(*[name[f"h_{k}"] for k in keys])
    is_heavy = F.col(name["heavy"]).isNotNull()
    found = found.withColumn(name["spread"], F.when(is_heavy, row_hash(rows)).otherwise(F.lit(0).cast("long")))
    # always 0, but no literal: as one, the optimizer would take it out of the join's keys
    zero = F.pmod(F.xxhash64(*keys), F.lit(1))
    light = groups.select(*[F.col(k).alias(name[f"l_{k}"]) for k in keys], F.struct(*values).alias(name["light"]), zero.alias(name["zero"]))
    on = [F.col(k) == F.col(name[f"l_{k}"]) for k in keys] + [F.col(name["spread"]) == F.col(name["zero"])]
    out = found.join(light, on, "left")
    both = F.coalesce(name["heavy"], name["light"])
    if how == "inner":
        out = out.where(both.isNotNull())
    return out.select(*every(rows), *[both[v].alias(v) for v in values])


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def every(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row of df, but for columns of kinds that can't be hashed."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])


def with_field(schema: T.StructType, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in more]])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: clashing extra columns stay as they are."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def replacing(df: DataFrame, made: tuple[str, ...], read: tuple[str, ...]) -> DataFrame:
    """df without the columns (in any case) that an operator is about to make; it must not read one of them."""
    taken = {m.lower() for m in made}
    if bad := [r for r in read if r.lower() in taken]:
        raise ValueError(f"{bad} can't be both read and made")
    return df.select(*[c for c, name in zip(every(df), df.columns, strict=True) if name.lower() not in taken])
