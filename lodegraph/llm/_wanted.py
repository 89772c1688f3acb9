"""Texts of chosen documents, fetched without shuffling the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter that keeps texts which nobody needs from being shuffled; where it fills up, more texts are sent.
FILTER_BITS = 1 << 23


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit array with the bit of every id set; at most FILTER_BITS / 64 rows reach the driver."""
    at = F.pmod(F.xxhash64(ids.columns[0]), F.lit(FILTER_BITS))
    words = ids.select((at / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[np.array(words.column("w"))] = np.array(words.column("b")).astype(np.int64).view(np.uint64)
    return bits


def texts_of(docs: DataFrame, ids: DataFrame, nodes_of: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """(doc_id, node, text) of the documents in ids, and of few others; nodes_of names texts, so that rows with one id stay apart.

    Ids may be null. Join the rows by doc_id and node.
    """
    bits = _filter_of(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array(batch.column("at"), dtype=np.int64)
            keep = (bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            kept = batch.filter(pa.array(keep.astype(bool)))
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays([kept.column("doc_id"), pa.array(nodes_of(kept.column("text"))), kept.column("text")], names=["doc_id", "node", "text"])

    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("at")).mapInArrow(run, "doc_id long, node long, text string")
