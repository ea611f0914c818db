"""Text files, project folders, JSON-lines pairs, program pairs; text, JSON and numpy sinks. All through Spark's readers, on any store."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lattica.tables import materialize, ready, shuffles_dropped

SKIPPED = ("build", "target", "node_modules")


def read_texts(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, text: whole files."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=glob)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_project(spark: SparkSession, path: str, glob: str = "*.kt") -> DataFrame:
    """path, text of a project's sources; nothing below folders that start with a dot or hold built files."""
    root = path.rstrip("/").rpartition("/")[2]
    inner = F.regexp_extract("path", rf"/{root}/(.*)$", 1)
    skipped = "|".join(SKIPPED)
    return read_texts(spark, path, glob).withColumn("name", inner).where(~F.col("name").rlike(rf"(^|/)(\.[^/]*|{skipped})/")).orderBy("name")


def read_pairs(spark: SparkSession, path: str, source: str = "source", target: str = "target") -> DataFrame:
    """path, line_no (from 0, in its file), source, target of JSON lines; blank lines, # lines, broken ones and those without both sides are skipped.

    Files are read line by line and split like any other. A line's number is its place in its split after the lines of the splits
    before; what was read is written first, since a second read may cut the splits elsewhere.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__at"), "value")
    parsed = F.when(~F.col("value").rlike(r"^\s*(#|$)"), F.from_json("value", f"`{source}` string, `{target}` string"))
    rows = lines.withColumn("p", parsed)
    rows = materialize(rows.select("path", "__split", "__at", F.col("p")[source].alias(source), F.col("p")[target].alias(target)), "lines")
    splits = rows.groupBy("path", "__split").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("path").orderBy("__split")) - F.col("__n")
    splits = materialize(splits.select("path", "__split", (before - F.col("__first")).alias("__shift")), "splits")
    own = rows.where((F.trim(source) != "") & (F.trim(target) != "")).join(splits, ["path", "__split"])
    return own.select("path", (F.col("__at") + F.col("__shift")).alias("line_no"), source, target)


def read_program_pairs(spark: SparkSession, path: str, cut: Callable[[str], list[str]], source: str = "source", target: str = "target") -> DataFrame:
    """stem, chunk, source, target: chunks of x.<source> and x.<target> side by side; programs whose chunk counts differ are dropped."""
    ready(spark)

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return pd.Series([cut(t) for t in texts])

    def side(suffix: str) -> DataFrame:
        return read_texts(spark, path, f"*.{suffix}").select(F.regexp_extract("path", rf"([^/]+)\.{suffix}$", 1).alias("stem"), chunks("text").alias(suffix))

    both = side(source).join(side(target), "stem").where(F.size(source) == F.size(target))
    return both.select("stem", F.posexplode(F.arrays_zip(source, target)).alias("chunk", "__p")).select("stem", "chunk", f"__p.{source}", f"__p.{target}")


def replace_atomically(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """What write(folder) writes takes the place of path by renames: readers find the old state or the new one whole.

    A run that fails leaves the old state; one that dies between the two renames leaves it under path.old.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, own = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in (".new", ".old", ""))
    fs = own.getFileSystem(conf)
    fs.delete(new, True)
    write(new.toString())
    fs.delete(old, True)
    if fs.exists(own) and not fs.rename(own, old) or not fs.rename(new, own):
        raise OSError(f"could not replace {path}")
    fs.delete(old, True)


def write_text(df: DataFrame, column: str, path: str) -> None:
    replace_atomically(df.sparkSession, path, df.select(F.col(column).cast("string")).write.text)


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    with shuffles_dropped(df.sparkSession):
        replace_atomically(df.sparkSession, path, df.write.option("compression", compression).json)


def for_each(df: DataFrame, ordinal: str, act: Callable[[int, list], None], rows: int = 10_000) -> int:
    """Calls act(number, rows) on the driver with bounded batches of rows in order, and gives their number: a sink for side effects.

    Rows come a partition at a time, sorted; the driver holds one partition.
    """
    batch, n = [], 0
    for row in df.orderBy(ordinal).toLocalIterator():
        batch.append(row)
        if len(batch) == rows:
            act(n, batch)
            batch, n = [], n + 1
    if batch:
        act(n, batch)
        n += 1
    return n


def npz_table(df: DataFrame, id_col: str, vector: str, rows: int = 4096) -> DataFrame:
    """part, content: numpy archives with arrays id and vector, of at most so many rows each, as a table that any sink takes."""
    ready(df.sparkSession)

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), rows):
                own, out = part.iloc[at : at + rows], io.BytesIO()
                np.savez_compressed(out, id=own["id"].to_numpy(), vector=np.stack([np.asarray(v, dtype=np.float32) for v in own["v"]]))
                yield pd.DataFrame({"part": [int(own["id"].iloc[0])], "content": [out.getvalue()]})

    return df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).mapInPandas(pack, "part long, content binary")


def read_npz(df: DataFrame) -> DataFrame:
    """id, vector from npz_table()'s rows, or from Spark's binaryFile reader."""
    ready(df.sparkSession)

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                with np.load(io.BytesIO(content)) as z:
                    yield pd.DataFrame({"id": z["id"], "vector": list(z["vector"])})

    return df.select("content").mapInPandas(unpack, "id long, vector array<float>")
