"""Files in and out: PDF folders, extraction documents, Markdown, and a manifest of what was ingested."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTRACTION = (
    "file_path string, total_pages int, statistics struct<total_blocks:bigint,total_characters:bigint,avg_blocks_per_page:double>, "
    "pages array<struct<page_num:int,width:double,height:double,rotation:int,block_count:int,char_count:bigint,full_text:string,"
    "blocks:array<struct<text:string,bbox:array<double>,page_num:int,block_num:int,font_size:double,font_name:string,structure_type:string>>>>"
)


def read_folder(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder with their content: ``path``, ``modificationTime``, ``length``, ``content``; other names are not read, files of no bytes have no row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def extract_pages(files: DataFrame, reader: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that ``reader`` makes of the content of each file, with ``path`` and ``error``.

    The reader is the adapter of a PDF library, if one is installed; a file it
    fails on gives one row with the error, not a failed job.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows += [{**dict.fromkeys(names), **row, "path": path, "error": None} for row in reader(content)]
                except Exception as e:  # noqa: BLE001
                    rows.append({**dict.fromkeys(names), "path": path, "error": str(e)})
            yield pd.DataFrame(rows, columns=[*names, "path", "error"])

    return files.select("path", "content").mapInPandas(run, f"{schema}, path string, error string")


def write_extractions(documents: DataFrame, path: str) -> None:
    """Write extraction documents as JSON, one object a line."""
    documents.write.mode("overwrite").json(path)


def read_extractions(spark: SparkSession, path: str, skip: str = "pilot_test", multiline: bool = False) -> DataFrame:
    """Read extraction documents from JSON; files whose name contains ``skip`` are left out."""
    rows = spark.read.schema(EXTRACTION).option("multiLine", multiline).json(path)
    return rows.withColumn("_file", F.input_file_name()).filter(~F.contains(F.element_at(F.split("_file", "/"), -1), F.lit(skip))).drop("_file")


def write_markdown(documents: DataFrame, path: str, buckets: int = 256) -> None:
    """Write the ``markdown`` of each ``doc_id`` as a file of its own, and the rest of the row as JSON beside them where there is any.

    The files are dealt out over ``buckets`` folders by a hash of their id; ``path``
    must be one that all executors reach.  A file written twice, by a repeated task
    or a repeated row, has the same name.  ``path/files`` lists what was written;
    documents without Markdown have no file.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        for batch in batches:
            names = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = str(item)
                digest = hashlib.md5(own.encode(), usedforsecurity=False).hexdigest()
                plain = re.sub(r"[^\w.-]", "_", own)[:100]
                folder = f"markdown/bucket={int(digest[:8], 16) % buckets:04}"
                system.create_dir(f"{root}/{folder}")
                names.append(f"{folder}/{plain if plain == own else f'{plain}-{digest[:8]}'}.md")
                with system.open_output_stream(f"{root}/{names[-1]}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string())], names=["doc_id", "file"])

    written = documents.select("doc_id", "markdown").filter("markdown is not null").mapInArrow(run, f"doc_id {kind}, file string")
    written.write.mode("overwrite").parquet(f"{path}/files")
    rest = [c for c in documents.columns if c not in ("doc_id", "markdown")]
    if rest:
        documents.select("doc_id", *rest).write.mode("overwrite").json(f"{path}/structure")


def file_checksum(files: DataFrame) -> DataFrame:
    """Files with the SHA-256 sum of their content as ``checksum``."""
    return files.withColumn("checksum", F.sha2("content", 256)).drop("content")


def changed_files(files: DataFrame, manifest: DataFrame, key: str = "doc_id", checksum: str = "checksum") -> DataFrame:
    """Files whose key and checksum aren't both in the manifest; a null checksum is always new."""
    known = manifest.select(F.col(key).alias("_k"), F.col(checksum).alias("_c")).distinct()
    return files.join(known, (F.col(key) == F.col("_k")) & (F.col(checksum) == F.col("_c")), "left_anti")
