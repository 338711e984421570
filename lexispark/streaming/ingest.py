"""Adding documents to a saved index as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexispark.operators import index as indexing


def append_to(path: str, stop: list[str] | None = None):
    """A ``foreachBatch`` function that adds each micro-batch (doc_idx, doc_id, text) to a saved index.

    Each batch goes to folders of its own beside those of ``Index.save``, named by the batch's number, and is written
    over if it is repeated; nothing that is there already is read or changed. ``doc_idx`` must go on from the index's.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        indexing.write_batch(indexing.build(batch, stop), path, str(batch_id), "overwrite")

    return write


def ingest(documents: DataFrame, path: str, checkpoint: str):
    """Start a stream that indexes ``documents``; ``Index.load`` reads what it has written."""
    return documents.writeStream.foreachBatch(append_to(path)).option("checkpointLocation", checkpoint).start()
