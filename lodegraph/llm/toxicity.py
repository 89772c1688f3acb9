"""Toxicity by a linear classifier over character n-grams, its features scaled by naive Bayes log-count ratios.

A document's features are the distinct hashed n-grams of its lower-cased text. Every n-gram that occurs in two training
documents or more gets the log ratio of its smoothed shares among toxic and other ones, and a logistic regression is
fitted on features that carry their ratio in place of 1; the ridge does the selecting, none is cut away. Scoring reads
a text once and looks each n-gram up in one table of weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm._linear import fit_sparse, sigmoid
from lodegraph.sources.tables import written

#: Lengths of the n-grams, in characters of the lower-cased text.
LENGTHS = (4, 5)
#: Bits of an n-gram's hash.
BITS = 22
#: Labelled documents to fit on at most, drawn by a hash of their id.
SAMPLE = 4_000
#: Training documents that an n-gram must occur in, and how many documents at the base rate smooth its ratio.
LEAST_DOCUMENTS, PRIOR = 2, 4.0
#: Weight of the ridge.
RIDGE = 30.0
#: Characters that are hashed at once.
SLICE_CHARS = 1 << 20

_STEPS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], dtype=np.uint32)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    low = size = 0
    for at, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE_CHARS or at == len(texts) - 1:
            yield low, [(x or "").lower() for x in texts[low : at + 1]]
            low, size = at + 1, 0


def ngrams(texts: list[str | None], last: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct n-grams of each text. last: an int32 array of 1 << BITS, scratch space that needs no clearing."""
    for _, part in _slices(texts):
        chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        keys: dict[int, np.ndarray] = {}
        h = np.zeros(len(chars), dtype=np.uint32)
        for j in range(max(LENGTHS)):
            h = h[: max(0, len(chars) - j)] + (chars[j:] + np.uint32(1)) * _STEPS[j]
            if j + 1 in LENGTHS:
                key = h ^ (h >> np.uint32(15))
                keys[j] = (key * np.uint32(0x2C1B3C6D + 2 * j)) >> np.uint32(32 - BITS)
        start = 0
        for text in part:
            own = np.concatenate([key[start : max(start, start + len(text) - j)] for j, key in keys.items()])
            start += len(text)
            order = np.arange(len(own), dtype=np.int32)
            last[own] = order  # of equal n-grams, the last one stays
            yield own[last[own] == order]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents of this task hold each n-gram."""
    seen, last = np.zeros((2, 1 << BITS), dtype=np.int32), np.zeros(1 << BITS, dtype=np.int32)
    for batch in batches:
        for label, own in zip(batch.column("label").to_pylist(), ngrams(batch.column("text").to_pylist(), last), strict=True):
            seen[label, own] += 1
    at = np.flatnonzero(seen.any(axis=0))
    for low in range(0, len(at), 1 << 18):
        part = at[low : low + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[1, part].astype(np.int64)), pa.array(seen[0, part].astype(np.int64))], names=["feature", "toxic", "other"])


def fit(labelled: DataFrame) -> dict:
    """The model from labelled (text, label 0 or 1), of which SAMPLE rows at most are given.

    n-grams, at most 1 << BITS of them, and the sample's lists of them come to the driver.
    """
    sizes = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    base = float(np.log((pos + 0.5) / (neg + 0.5)))
    share = (pos + 0.5) / (pos + neg + 1)
    counts = labelled.select("text", "label").mapInArrow(_counts, "feature int, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("p"), F.sum("other").alias("q"))
    ratio = F.log((F.col("p") + PRIOR * share) / (F.col("q") + PRIOR * (1 - share))) - base
    known = counts.where(F.col("p") + F.col("q") >= LEAST_DOCUMENTS).select("feature", ratio.cast("float").alias("ratio")).toArrow()
    features, ratios = np.array(known.column("feature"), dtype=np.int32), np.array(known.column("ratio"), dtype=np.float32)
    order = np.argsort(features)
    features, ratios = features[order], ratios[order]
    if not len(features) or not pos or not neg:
        return {"features": features[:0], "weights": ratios[:0], "bias": base}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = np.full(1 << BITS, -1, dtype=np.int32), np.zeros(1 << BITS, dtype=np.int32)
        number[features] = np.arange(len(features), dtype=np.int32)
        for whole in batches:
            for low in range(0, whole.num_rows, 64):
                batch = whole.slice(low, 64)
                lists = [at[at >= 0] for at in (number[own] for own in ngrams(batch.column("text").to_pylist(), last))]
                cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(np.concatenate(lists)))], names=["label", "features"])

    rows = labelled.select("text", F.col("label").cast("int").alias("label")).mapInArrow(present, "label int, features array<int>").toArrow()
    lists = rows.column("features").combine_chunks()
    weights, bias = fit_sparse(np.array(lists.values), np.array(lists.offsets), ratios, np.array(rows.column("label"), dtype=float), RIDGE)
    return {"features": features, "weights": (weights * ratios).astype(np.float32), "bias": bias}


def score(docs: DataFrame, text: str, model: dict, name: str = "score") -> DataFrame:
    """docs with the probability of label 1 for each whole text; null and empty texts get the model's base rate."""
    schema = docs.drop(text).schema.add(name, "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, last = np.zeros(1 << BITS, dtype=np.float32), np.zeros(1 << BITS, dtype=np.int32)
        weights[model["features"]] = model["weights"]
        for batch in batches:
            out = np.array([model["bias"] + weights[own].sum(dtype=np.float64) for own in ngrams(batch.column(text).to_pylist(), last)], dtype=np.float64)
            kept = [i for i, n in enumerate(batch.schema.names) if n != text]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(sigmoid(out))], names=[*[batch.schema.names[i] for i in kept], name])

    return docs.mapInArrow(scored, schema)


def sampled_labels(labels: DataFrame, docs: DataFrame, column: str, most: int, held_out: int | None = 2, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, label, more) of most labelled documents at most, by a hash of the id, without those held out.

    Null labels and ids are left out; an id with several labels counts as 1 if half of them do, one with several rows is
    represented by the least of them. The chosen ids are few, most bounds them, so they are broadcast, only their texts
    are shuffled, and most bounds the rows too.
    """
    key = F.col("doc_id").cast("string")
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    if held_out is not None:
        chosen = chosen.where(F.crc32(key.cast("binary")) % 4 != held_out)
    chosen = chosen.groupBy("doc_id").agg((F.avg(F.col(column)) >= 0.5).cast("int").alias("label"))
    chosen = written(chosen.orderBy(F.xxhash64(F.lit(41), "doc_id"), "doc_id").limit(most), 1)
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("text", *more)).alias("row"))
    return found.select("doc_id", "label", "row.*")


def op1_toxicity(spark, sf_dir: str, docs: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Scores of all documents by a model fitted on labels outside the held-out quarter.

    Null texts count as empty; a null id counts as the empty text in held_out and is never trained on; repeated rows
    are scored one by one. Without labels every score is 0.5.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet") if labels is None else labels
    model = fit(written(sampled_labels(labels, docs, "toxic", SAMPLE).select("text", "label")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(key.cast("binary")) % 4 == 2).alias("held_out"), F.col("text").cast("string").alias("text")), "text", model)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
