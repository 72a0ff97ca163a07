"""Incremental candidate import with Structured Streaming.

New CSV files landing in a folder are read as a stream of lines; every
micro-batch goes through the reader, cleaning, resolution and merge of the
batch import (``operators.ingest``), so a file's own header names its
columns. Re-running a micro-batch (after an executor or driver failure)
gives the same table:

* the merge is idempotent (coalesce(new, old) with the same batch), and
* quarantine rows are written to the partition (stream_id, batch_id), which
  a retried batch replaces. The stream's id is kept in its checkpoint
  folder, so streams never replace each other's rows.

Progress (which files were consumed) lives in the checkpoint folder, which
every stream must name. A file is always whole in a micro-batch, so quoted
values may break lines as in the batch import.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest, upsert
from ..sources import csv_records

STREAM_ID = "import_stream_id"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream with this checkpoint folder, made at its first start."""
    path = f"{checkpoint.rstrip('/')}/{STREAM_ID}"
    known = upsert._read_text(spark, path)
    if known is None:
        known = uuid.uuid4().hex
        upsert._write_text(spark, path, known)
    return known.strip()


def merge_batch(spark: SparkSession, lines: DataFrame, batch_id: int, target_path: str, errors_path: str,
                opts: ingest.ImportOptions, stream: str = "batch", refs: ingest.References | None = None,
                historical_path: str | None = None) -> None:
    """One micro-batch of lines (_line, _path, _block): parse, clean,
    quarantine, upsert. A file without the REGNUMBER column fails the batch."""
    sources = [m.source for m in ingest.DEFAULT_CANDIDATE_MAPPING]
    scratch: list[str] = []
    try:
        rows = ingest.parse_lines(lines, sources, ingest.REQUIRED, scratch)
        checked = ingest.clean_candidates(ingest.map_columns(rows), opts, state_names=refs is not None and refs.state is not None)
        partition = {"stream_id": stream, "batch_id": str(batch_id)}
        if opts.validate_only:
            ingest.write_quarantine(ingest.split_valid(checked)[1], errors_path, **partition)
            return
        ingest.load_checked(spark, checked, target_path, errors_path, opts, partition, refs, historical_path)
    finally:
        for path in scratch:
            upsert._delete_path(spark, path)


def start_import(spark: SparkSession, in_dir: str, target_path: str, errors_path: str,
                 opts: ingest.ImportOptions, checkpoint: str | None = None,
                 available_now: bool = True, max_files_per_trigger: int | None = None,
                 refs: ingest.References | None = None, historical_path: str | None = None) -> StreamingQuery:
    """Start the stream; with ``available_now`` it consumes the files present
    and stops (a scheduled incremental load). ``checkpoint``: this stream's
    own folder, on storage that outlives the driver."""
    if opts.year is None:
        raise ValueError("a candidate import needs ImportOptions.year (year is NOT NULL)")
    if not checkpoint:
        raise ValueError("a streaming import needs a checkpoint folder of its own")
    me = stream_id(spark, checkpoint)
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # The file of a line is attached on the stream (a micro-batch handed to
    # foreachBatch no longer carries file metadata).
    lines = csv_records.text_lines(reader, in_dir)
    writer = (lines.writeStream
              .foreachBatch(lambda df, bid: merge_batch(spark, df, bid, target_path, errors_path, opts, me, refs, historical_path))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
