"""File listings and image headers."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import base_name, extension, trailing_number
from pagequarry.session import settle

#: The eight bytes that a PNG file starts with, and how many say its size.
PNG = "89504E470D0A1A0A"
HEADER_BYTES = 24


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with its place in a global order, from 1, without bringing all rows to one task.

    The rows are range-partitioned by the order and written; a place is that inside its
    part, and what the parts before hold.
    """
    dealt = settle(df.orderBy(*order).withColumn("part", F.spark_partition_id()), "numbered")
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("rows")).withColumn("before", before)
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn(name, inside).join(
        F.broadcast(sizes.select("part", "before")), "part"
    ).withColumn(name, F.col(name) + F.col("before")).drop("part", "before")


def scanned(spark: SparkSession, folders: list[str], ext: str = ".pdf", recursive: bool = False) -> DataFrame:
    """(path, rank, modified, length) of the files in ``folders`` with an extension, in any case; ``rank`` is the folder's place, from 1.

    Spark lists the folders, on executors if they are many; no file is opened, and names with
    other extensions are dropped while listing. Hidden files (``_`` or ``.`` in front) are not listed.
    """
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
    # the folder as a literal to its rank, as a path may lie in several of them
    found = None
    for rank, folder in enumerate(folders, 1):
        reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
        one = reader.load(folder).select("path", F.lit(rank).alias("rank"), F.col("modificationTime").alias("modified"), "length")
        found = one if found is None else found.unionByName(one)
    return found


def first_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The header of each file, nothing for one that is gone."""
    systems: dict = {}
    for batch in batches:
        heads = []
        for path in batch.column(0).to_pylist():
            if path is None:
                heads.append(None)
                continue
            # only the root is parsed, as the rest may hold blanks and any other letters
            scheme, _, rest = path.partition(":") if "://" in path or path.startswith("file:") else ("file", "", path)
            host = urlsplit(f"{scheme}:{rest}").netloc if rest.startswith("//") else ""
            if (scheme, host) not in systems:
                systems[scheme, host] = (pafs.LocalFileSystem(), "") if scheme == "file" else pafs.FileSystem.from_uri(f"{scheme}://{host}/")
            system, root = systems[scheme, host]
            name = root.rstrip("/") + (rest[2 + len(host) :] if rest.startswith("//") else rest)
            try:
                with system.open_input_file(name) as f:
                    heads.append(f.read_at(HEADER_BYTES, 0))
            except FileNotFoundError:
                heads.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], ["path", "content"])


def image_sizes(files: DataFrame) -> DataFrame:
    """(path, width, height) of PNG files (path), of which 24 bytes each are read where the rows lie; nulls for what is none or is gone.

    The paths are local ones or those of a store that Arrow opens (hdfs, s3, gs).
    """
    heads = files.select("path").mapInArrow(first_bytes, "path string, content binary")
    return heads.withColumn("size", png_size("content")).select("path", "size.width", "size.height")


def listing(files: DataFrame, ext: str = ".pdf") -> DataFrame:
    """Files (path, rank) with an extension, one of each name without regard to case, the lowest rank first found; ``place`` orders them by trailing number, then name."""
    named = files.withColumn("name", base_name("path")).where(F.lower(extension("path")) == ext)
    first = named.withColumn("rn", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("rank", "path"))).where("rn = 1").drop("rn")
    return numbered(first, "place", trailing_number("name"), F.lower("name"))


def first_existing(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The path of the lowest rank for each wanted name, without regard to case."""
    found = files.select("path", "rank", F.lower(base_name("path")).alias("k"))
    return wanted.withColumn("k", F.lower("name")).join(found, "k").groupBy("name").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def png_size(content: str = "content") -> Column:
    """Struct (width, height) from the first 24 bytes of a PNG; null if they are none."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(
        (F.hex(F.substring(content, 1, 8)) == PNG) & (F.length(content) >= HEADER_BYTES),
        F.struct(number(17).alias("width"), number(21).alias("height"))
    )


def page_image_name(n: Column) -> Column:
    return F.format_string("page-%04d.png", n)
