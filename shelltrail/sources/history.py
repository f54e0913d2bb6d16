"""History files in, guides out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelltrail.operators.numbering import (
    check_range,
    number_range,
    parse_lines,
    with_offsets,
)
from shelltrail.session import staged


class HistoryNotFound(FileNotFoundError):
    """There is no history at the given path."""


class EmptyRange(LookupError):
    """No command has a number in the given range."""


class UnreadableHistory(OSError):
    """The history is there but cannot be read."""


def read_commands(
    spark: SparkSession, path: str | list[str], history_id: Column | None = None
) -> DataFrame:
    """Numbered commands of text files, one history per file.

    ``history_id`` may name the history from ``_metadata``; default is the file
    path. Files with the same name follow one another in the order of their paths.
    Lines end at a line feed only. A file is read in splits; a command's number is
    the number of commands in earlier splits of its history plus its place in its
    own, which is known from the running row id, so nothing is sorted. The parsed
    rows are staged first, because ids must not change between the counting and the
    numbering pass.
    """
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
        lines = lines.select(
            "value",
            (F.col("_metadata.file_path") if history_id is None else history_id).alias(
                "history_id"
            ),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
        )
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise HistoryNotFound(str(path)) from e
        raise UnreadableHistory(str(path)) from e
    try:
        parsed = staged(
            parse_lines(lines).withColumn("seq", F.monotonically_increasing_id()), "parsed-lines"
        )
    except (PySparkException, Py4JJavaError) as e:
        if "FAILED_READ_FILE" in str(e):
            raise UnreadableHistory(str(path)) from e
        raise
    place = ["history_id", "file", "split"]
    splits = parsed.groupBy(*place).agg(
        F.count("*").alias("rows"), F.min("seq").alias("first_seq")
    )
    splits = splits.withColumn("at", F.struct("file", "split"))
    offsets = with_offsets(splits, ["history_id"], "at").drop("rows", "at")
    number = F.col("rows_before") + F.col("seq") - F.col("first_seq") + 1
    return parsed.join(offsets, place).select(
        "history_id", number.cast("bigint").alias("number"), "epoch_s", "has_time", "command"
    )


def extract(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Commands ``first`` to ``last`` of one history file; an empty selection is an error."""
    check_range(first, last)
    selected = number_range(read_commands(spark, path), first, last)
    if selected.isEmpty():
        raise EmptyRange(f"no commands from {first} to {last}")
    return selected


def write_parquet(documents: DataFrame, path: str) -> None:
    documents.write.parquet(path)


MANIFEST = "history_id string, path string, parts bigint, bytes bigint"


def write_guides(documents: DataFrame, folder: str) -> DataFrame:
    """Write one file for each guide below ``folder``, and return the manifest that names them.

    The parts of a guide stream into its file in their order, whatever their number; a task holds one
    batch of them. The manifest (history_id, path, parts, bytes) is a table in ``folder/_manifest``,
    written with the tasks that succeed: files of lost or repeated attempts are never named in it.
    ``folder`` must be reachable from every executor by a scheme that pyarrow can open (local and
    shared paths, hdfs, s3, gs, abfs) and hold no manifest yet.
    """
    rows = documents.select("history_id", "part_no", "markdown")
    rows = rows.repartition("history_id").sortWithinPartitions("history_id", "part_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        done: list[dict] = []
        out = None
        for batch in batches:
            names, texts = batch.column("history_id").to_pylist(), batch.column("markdown")
            for name, text in zip(names, texts, strict=True):
                if out is None or done[-1]["history_id"] != name:
                    if out is not None:
                        out.close()
                    else:
                        system.create_dir(root, recursive=True)
                    # the id tells the file to people; the rest makes it unique to this attempt
                    file = f"{quote(name or '', safe='')[:100]}-{uuid.uuid4().hex}.md"
                    out = system.open_output_stream(f"{root}/{file}")
                    path = f"{folder.rstrip('/')}/{file}"
                    done.append({"history_id": name, "path": path, "parts": 0, "bytes": 0})
                body = (text.as_py() or "").encode()
                out.write(body)
                done[-1]["parts"] += 1
                done[-1]["bytes"] += len(body)
        if out is not None:
            out.close()
        kinds = {"history_id": pa.string(), "path": pa.string(), "parts": pa.int64(), "bytes": pa.int64()}
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema(kinds))

    place = f"{folder.rstrip('/')}/_manifest"
    rows.mapInArrow(run, MANIFEST).write.parquet(place)
    return documents.sparkSession.read.schema(MANIFEST).parquet(place)


def write_markdown(documents: DataFrame, path: str) -> None:
    """Write guides as text files, in one folder per history; files and lines are in order.

    The parts of a long guide stay spread over tasks.
    """
    # the writer ends every row with a line feed itself
    text = F.regexp_replace("markdown", r"\n\z", "")
    (
        documents.repartitionByRange("history_id", "part_no")
        .sortWithinPartitions("history_id", "part_no")
        .select("history_id", text.alias("value"))
        .write.partitionBy("history_id")
        .text(path)
    )
