"""Lines of text files in their true order, and names of files and graphs (S7, P12)."""

from __future__ import annotations

import io
import os
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.tables import cut

#: Blocks of files whose places are broadcast (some 100 bytes each); beyond, they are joined.
BLOCKS = 200_000
_TAR = (".tar.gz", ".tgz", ".tar")


def lines(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """pos, file_name, value: all lines (gzip too) in order: by path, then by place in the file, pos without gaps from 0.

    Spark packs blocks of files into tasks by size, so neither a task nor its number tells the order; a block's path and start do.
    The rows of each block are counted, and a row's place is that of its block plus its own within it; no row is shuffled.
    Of tar archives (the path ends so) the first member whose name ends with ``suffix`` is read, an archive by one task.
    """
    if path.endswith(_TAR):
        return _tar_lines(spark, path, suffix)
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("m"))
    blocks = t.groupBy("p", "s").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy().orderBy("p", "s").rowsBetween(W.unboundedPreceding, -1)  # one row a block
    blocks = cut(blocks.select("p", "s", "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")), "blocks")
    b = F.broadcast(blocks) if blocks.count() <= BLOCKS else blocks
    return t.join(b, ["p", "s"]).select((F.col("before") + F.col("m") - F.col("first")).alias("pos"), F.regexp_extract("p", r"[^/]+$", 0).alias("file_name"), "value")


def _tar_lines(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    member = next((m for m in tar if m.isfile() and m.name.endswith(suffix)), None)
                    at, part = 0, []
                    for line in io.TextIOWrapper(tar.extractfile(member), "utf-8", "replace", newline="\n") if member else ():
                        part.append(line.rstrip("\r\n"))
                        if len(part) == 10_000:
                            yield _rows(at, name, part)
                            at, part = at + len(part), []
                    yield _rows(at, name, part)

    f = spark.read.format("binaryFile").load(path).select("path", "content")
    sizes = cut(f.mapInArrow(run, "at bigint, p string, value string"), "members")
    w = W.partitionBy().orderBy("p").rowsBetween(W.unboundedPreceding, -1)  # one row an archive
    before = sizes.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return sizes.join(before, "p").select((F.col("before") + F.col("at")).alias("pos"), F.regexp_extract("p", r"[^/]+$", 0).alias("file_name"), "value")


def _rows(at: int, name: str, part: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(at, at + len(part)), pa.int64()), pa.array([name] * len(part), pa.string()), pa.array(part, pa.string())], names=["at", "p", "value"])


def parse_spec(spec: str) -> tuple[str, int | None]:
    """'name@500' -> (name, 500); without a number all records."""
    name, _, most = spec.strip().partition("@")
    return name.strip(), int(most) or None if most else None


def resolve_name(names: list[str], short: str) -> str:
    """The one file meant by a short name: itself, itself with .gz, or the only one that ends so."""
    for n in (short, f"{short}.gz"):
        if n in names:
            return n
    end = short if short.endswith(".gz") else f".{short}.gz"
    found = [n for n in names if n.endswith(end)]
    if len(found) != 1:
        raise FileNotFoundError(f"{short}: {len(found)} files")
    return found[0]


def files_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files of a folder, on any file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(os.path.basename(s.getPath().toString()) for s in fs.listStatus(p) if s.isFile())


def parse_gids(spec: str) -> list[int]:
    """'0-2,7' -> [0, 1, 2, 7]"""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        a, _, b = part.partition("-")
        out |= set(range(int(a), int(b or a) + 1))
    return sorted(out)
