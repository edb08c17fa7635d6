"""Token counts of flat, unindexed token files by a separator scan.

A file is nothing but ids of a fixed width, little-endian, with an end-of-document id after each document. Blocks of a
file are read on their own, and a vector comparison finds the separators of each; a prefix scan over the blocks of a file
(running number of separators, last separator so far) then stitches documents that lie across blocks.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixmine.llm import text as X
from fixmine.llm.store import columns_for, fresh_path, keep
from fixmine.llm.tokens import Encoder, default_path

END_ID, WIDTH = 50256, 2
#: Bytes of a block; a multiple of every width.
BLOCK = 1 << 22


def _write(folder: str, tokenizer: str, end_id: int, width: int):
    @X.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = Encoder.of(tokenizer), f"<u{width}"
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.bin"  # a task that is run again writes another file; the manifest names the one that counts
        nth = written = 0
        with store.open_output_stream(posixpath.join(root, name)) as out:
            for batch in batches:
                count = 0
                for ids, at in encoder.encode(batch["text"]):
                    n = len(at) - 1
                    flat = np.full(len(ids) + n, end_id, kind)
                    flat[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
                    out.write(flat.tobytes())
                    written += flat.nbytes
                    count += n
                yield pa.record_batch([pa.array([name] * count, pa.string()), pa.array(np.arange(nth, nth + count)), batch["doc_id"], pa.nulls(count, pa.int64())], names=["file", "nth", "doc_id", "bytes"])
                nth += count
        yield pa.record_batch([pa.array([name]), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.array([written], pa.int64())], names=["file", "nth", "doc_id", "bytes"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """Write one flat file per task below ``folder``; (file, nth, doc_id, bytes): a row per document, and one with nth -1 per file.

    The file itself has neither lengths nor ids of documents. A null text is a document of no ids.
    """
    if width == 2 and end_id >= 1 << 16:
        raise ValueError("ids need four bytes")
    rows = columns_for(docs, doc_id="long", text="string")
    return keep(rows.mapInArrow(_write(folder, tokenizer or default_path(), end_id, width), "file string, nth long, doc_id long, bytes long"), "manifest")


def _separators(folder: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, block, size in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
                with store.open_input_file(posixpath.join(root, file)) as f:
                    ids = np.frombuffer(f.read_at(min(BLOCK, size - block * BLOCK), block * BLOCK), f"<u{width}")
                at = np.flatnonzero(ids == end_id) + block * (BLOCK // width)
                final = size // width if size <= (block + 1) * BLOCK else None
                yield pa.record_batch([pa.array([file]), pa.array([block], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([at[-1] if len(at) else None], pa.int64()), pa.array([final], pa.int64()), pa.array([at.astype("<i8").tobytes()], pa.binary())], names=["file", "block", "n", "last", "final", "at"])

    return run


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            at = np.frombuffer(r["at"], "<i8")
            before = r["before"] if r["before"] is not None else -1
            if r["final"] is not None and r["final"] - 1 > (at[-1] if len(at) else before):
                at = np.append(at, r["final"])  # the file ends without a separator
            prior = np.concatenate(([before], at[:-1])) if len(at) else at
            n = len(at)
            yield pa.record_batch([pa.array([r["file"]] * n, pa.string()), pa.array(np.arange(n) + r["lead"]), pa.array(prior + 1, pa.int64()), pa.array(at - prior - 1, pa.int64())], names=["file", "nth", "start", "n_tokens"])


def scan_token_files(files: DataFrame, folder: str, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """(file, nth, start, n_tokens) of every document in ``files`` (file, bytes), separators not counted.

    Ids after the last separator are a document too. Repeated separators are documents of no ids. Empty files
    and an empty table give no rows.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("bytes") - 1) / BLOCK).cast("long"))).alias("block"))
    found = keep(blocks.repartition(n, "file", "block").mapInArrow(_separators(folder, end_id, width), "file string, block long, n long, last long, final long, at binary"), "separators")
    # one short row per block
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = found.select("file", "block", "n", "last").withColumn("lead", F.coalesce(F.sum("n").over(so_far), F.lit(0))).withColumn("before", F.max("last").over(so_far))
    return found.join(carry.select("file", "block", "lead", "before"), ["file", "block"]).mapInArrow(_stitch, "file string, nth long, start long, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``, from flat files written for it.

    Null and empty texts have 0 ids. Repeated rows and null ids keep a row each. An empty table gives an empty table.
    """
    folder = fresh_path(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, folder, tokenizer)
    counts = scan_token_files(manifest.where("nth = -1").select("file", "bytes"), folder)
    return manifest.where("nth >= 0").select("file", "nth", "doc_id").join(counts, ["file", "nth"]).select("doc_id", "n_tokens")
