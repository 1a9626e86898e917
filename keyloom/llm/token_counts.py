"""Token counts of documents in flat, unindexed token files, by a separator scan.

A token file is a run of little-endian uint32 ids, every document closed by the end-of-document
id, cut into blocks of ``BLOCK_IDS`` ids wherever they fall; nothing says where documents begin.
:func:`write_files` makes such files from a table where its rows are, without a shuffle: each split
of the table becomes files of about ``FILE_BYTES``, which hold whole documents.

:func:`scan` looks for the end id in each block and joins neighbouring blocks of a task to runs of
about ``RUN_IDS``; blocks are small because Spark and Parquet hold rows by number. What a run
cannot know, how many ids and documents came before it and where the document began that is open
at its start, comes from a prefix scan over the runs of the file (one small row each). A document
may span any number of blocks.

Defined results: a null or empty text is a document of one id; ids without a closing end id at the
end of a file are a last document with ``closed`` false; null ids stay; rows that repeat an id are
documents of their own; documents have the order of the table's splits; an empty table gives no
rows; other columns are ignored. Texts that spell the end token are encoded as ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.encoder import SMALL_TABLE
from keyloom.llm.token_store import encoded
from keyloom.staging import Stage

END_ID = 49407
BLOCK_IDS = 1_024  # 4 KB: the batches that readers and Python get have thousands of rows
RUN_IDS = 65_536
PIECE_BYTES = 1_000_000  # of text that are encoded at a time
FILE_BYTES = 16_000_000  # of ids; the file ends with the texts that are being encoded
FILES = "file bigint, block bigint, ids binary, doc_id array<bigint>"


def write_files(
    docs: DataFrame,
    stage: Stage,
    path: str,
    end: int = END_ID,
    file_bytes: int = FILE_BYTES,
    block_ids: int = BLOCK_IDS,
) -> tuple[DataFrame, DataFrame]:
    """(files, names): file, block, ids; and file, doc_id (the list of its documents)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, names = TaskContext.get().partitionId() << 24, 0, []
        rest = np.zeros(0, "<u4")

        def rows(ids, blocks, listed):
            return pa.record_batch(
                [
                    pa.array([file] * len(ids), pa.int64()),
                    pa.array(blocks, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(listed, pa.list_(pa.int64())),
                ],
                names=["file", "block", "ids", "doc_id"],
            )

        def close(rest):
            if len(rest):
                yield rows([rest.tobytes()], [block], [None])
            yield rows([None], [-1], [names])

        for known, more, _ in encoded(batches, path, end, True, PIECE_BYTES, SMALL_TABLE):
            names += known
            rest = np.concatenate([rest, more.astype("<u4")])
            full = len(rest) // block_ids
            cut = [rest[k * block_ids : (k + 1) * block_ids].tobytes() for k in range(full)]
            if cut:
                yield rows(cut, range(block, block + full), [None] * full)
            block, rest = block + full, rest[full * block_ids :]
            if 4 * (block * block_ids + len(rest)) >= file_bytes:
                yield from close(rest)
                file, block, names, rest = file + 1, 0, [], rest[:0]
        if names:
            yield from close(rest)

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    written = stage.put(texts.mapInArrow(pack, FILES), "token-files")
    files = written.where("block >= 0").select("file", "block", "ids")
    return files, written.where("block < 0").select("file", "doc_id")


def scan(files: DataFrame, end: int = END_ID) -> DataFrame:
    """file, number (of the document in the file), start, n_tokens, closed."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, following, n, ends = None, None, 0, []  # of the run that is open

        def found(rows):
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            columns.append(pa.array([r[3] for r in rows], pa.list_(pa.int64())))
            return pa.record_batch(columns, names=["file", "block", "n_ids", "ends"])

        for batch in batches:
            rows = []
            for file, block, body in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.column(2)):
                if (file, block) != following or n >= RUN_IDS:
                    if at:
                        rows.append((*at, n, ends))
                    at, n, ends = (file, block), 0, []
                ids = np.frombuffer(body.as_buffer(), "<u4")
                ends += (np.flatnonzero(ids == end) + n).tolist()
                n, following = n + len(ids), (file, block + 1)
            yield found(rows)
        if at:
            yield found([(*at, n, ends)])

    cut = files.mapInArrow(search, "file bigint, block bigint, n_ids bigint, ends array<bigint>")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    cut = cut.withColumn("base", F.coalesce(F.sum("n_ids").over(before), zero))
    last = F.col("base") + F.element_at("ends", -1)
    stitched = cut.select(
        "file",
        "base",
        "n_ids",
        "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), zero).alias("number"),
        F.coalesce(
            F.last(F.when(F.size("ends") > 0, last), ignorenulls=True).over(before) + 1, zero
        ).alias("open"),
        (F.lead("block").over(order)).isNull().alias("final"),
    )
    zeroed = stitched.withColumn("ends", F.transform("ends", lambda x: x + F.col("base")))
    tail = F.col("base") + F.col("n_ids") - 1
    rest = F.col("final") & (F.coalesce(F.array_max("ends"), F.col("open") - 1) < tail)
    marks = F.when(rest, F.concat("ends", F.array(tail))).otherwise(F.col("ends"))
    flat = zeroed.select(
        "file", "number", "open", "ends", F.posexplode(marks).alias("k", "end")
    )
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.get("ends", F.col("k") - 1) + 1)
    return flat.select(
        "file",
        (F.col("number") + F.col("k")).alias("number"),
        start.alias("start"),
        (F.col("end") - start + 1).alias("n_tokens"),
        (F.col("k") < F.size("ends")).alias("closed"),
    )


def counts(docs: DataFrame, path: str, **options) -> DataFrame:
    """doc_id, file, start, n_tokens (with the end id), from the files of ``docs``."""
    files, names = write_files(docs, Stage(docs.sparkSession), path, **options)
    found = scan(files, options.get("end", END_ID))
    listed = names.select("file", F.posexplode("doc_id").alias("number", "doc_id"))
    return found.join(listed, ["file", "number"]).select("doc_id", "file", "start", "n_tokens")
