"""Token counts from flat token files without an index.

A flat file is one token identifier after another, each document ended by a separator.
Files are read in blocks of a fixed size, each by whatever task it falls to; a block is
searched for separators in one vectorised comparison. Where the documents of a block
begin depends on the blocks before it: a prefix scan over one small row per block gives
every block the number of documents ended and the place of the last separator so far.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estate.llm.common import ship
from estate.session import materialize, scratch_path

BLOCK_TOKENS = 1 << 20
_TYPES = {2: "<u2", 4: "<u4"}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_token_files(encoded: DataFrame, separator: int, width: int = 2, ids: str = "ids") -> DataFrame:
    """Write the ids of every row, each followed by ``separator``, to flat files.

    The separator must be an id that no row holds; a row with it is refused, as it would
    be read as two.
    One file per partition, in the shared scratch folder. Returns where each row went:
    ``doc_id``, ``path``, ``document`` (its number in the file). A task that is run
    again writes a file of its own; only files named in the result count.
    """
    spark = encoded.sparkSession
    ship(spark)
    folder = scratch_path(spark, "tokens")
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}.bin"
        files, place = _open(path)
        files.create_dir(place.rpartition("/")[0], recursive=True)
        written = 0
        with files.open_output_stream(place) as out:
            for batch in batches:
                lists = batch[ids]
                for value in lists:
                    data = np.asarray(value.values if value.is_valid else [], dtype=np.int64)
                    if len(data) and (data.min() < 0 or data.max() >= 1 << (8 * width)):
                        raise ValueError(f"a token does not fit {width} bytes")
                    if (data == separator).any():
                        raise ValueError(f"the separator {separator} stands inside a row")
                    out.write(np.append(data, separator).astype(_TYPES[width]).tobytes())
                numbers = pa.array(np.arange(written, written + len(batch)))
                written += len(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array([path] * len(batch)), numbers], ["doc_id", "path", "document"]
                )

    return materialize(encoded.mapInArrow(run, f"doc_id {kind}, path string, document bigint"), "token-index")


def scan_token_files(
    paths: DataFrame, separator: int, width: int = 2, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row per document of the files in ``paths`` (a column ``path``): ``path``,
    ``document`` (number in the file), ``start`` (in tokens), ``n_tokens``, ``ended``.

    A document is what lies between two separators; an empty one has no tokens. Tokens
    after the last separator are a document with ``ended`` false. An empty file has no
    documents; a file that ends inside a token is refused. A path given twice counts
    once, a null path is passed over. Other columns are not read.
    """
    ship(paths.sparkSession)

    def list_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                files, place = _open(path)
                size = files.get_file_info(place).size
                if size % width:
                    raise ValueError(f"{path} ends inside a token")
                first = np.arange(0, size // width, block_tokens)
                many = [path] * len(first)
                yield pa.RecordBatch.from_arrays([pa.array(many, pa.string()), pa.array(first, pa.int64())], ["path", "first"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, sizes = [], []
            for path, first in zip(batch["path"].to_pylist(), batch["first"].to_pylist()):
                files, place = _open(path)
                with files.open_input_file(place) as file:
                    data = np.frombuffer(file.read_at(block_tokens * width, first * width), _TYPES[width])
                ends.append(np.flatnonzero(data == separator) + first)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [batch["path"], batch["first"], pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                ["path", "first", "size", "ends"],
            )

    names = paths.where("path is not null").select("path").distinct()
    blocks = names.mapInArrow(list_blocks, "path string, first bigint").repartition("path", "first")
    found = materialize(
        blocks.mapInArrow(search, "path string, first bigint, size bigint, ends array<bigint>"), "separators"
    )
    # The prefix scan: one row per block, without the separators themselves.
    small = found.select(
        "path", "first", "size", F.size("ends").alias("_n"), F.expr("get(ends, size(ends) - 1)").alias("_last")
    )
    before = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    scanned = small.select(
        "path", "first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_done"),
        F.coalesce(F.max("_last").over(before), F.lit(-1)).alias("_open"),
    )
    stitched = found.join(scanned, ["path", "first"])
    ended = stitched.select(
        "path", "_done", "_open", "ends", F.posexplode("ends").alias("_i", "_end")
    ).select(
        "path", (F.col("_done") + F.col("_i")).alias("document"),
        (F.coalesce(F.expr("get(ends, _i - 1)"), F.col("_open")) + 1).alias("start"), "_end",
    ).select("path", "document", "start", (F.col("_end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = small.groupBy("path").agg(
        F.sum("_n").alias("document"), (F.coalesce(F.max("_last"), F.lit(-1)) + 1).alias("start"),
        F.max(F.col("first") + F.col("size")).alias("_size"),
    )
    rest = whole.where("_size > start").select(
        "path", "document", "start", (F.col("_size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")
    )
    return ended.unionByName(rest)


def token_counts(docs_index: DataFrame, separator: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every row that ``write_token_files`` put down."""
    found = scan_token_files(docs_index.select("path"), separator, width, block_tokens)
    return docs_index.join(found, ["path", "document"]).select("doc_id", "n_tokens")

