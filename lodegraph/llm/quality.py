"""Quality by co-training: a classifier of the text and a classifier of the page's metadata teach each other.

The text view sees what the text is like: letter case, symbols, digits, repetition, word lengths, lines. The metadata
view sees what is recorded beside it: language, source and length; nothing in it is read from the text. Both start from the labelled sample; in each round each scores
a sample without labels and hands the rows it is surest of, as far as its calibration supports them, to the other's
training set. Platt scaling on a fold kept aside calibrates both, and a logistic regression on their calibrated log
odds, fitted on that fold, gives the score of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm._linear import fit_logistic, sigmoid
from lodegraph.llm._rows import hidden
from lodegraph.llm._text import mixed, text_slices, words
from lodegraph.llm.toxicity import sampled_labels
from lodegraph.sources.tables import written

#: Labelled and unlabelled documents to fit on at most, drawn by a hash of their id.
LABELLED, UNLABELLED = 12_000, 12_000
#: Rounds of exchange, rows handed over by a view in a round at most, as a share of the unlabelled, and their weight.
ROUNDS, SHARE, WEIGHT = 4, 0.05, 0.5
#: A view is sure of a row if its calibrated probability is as far from one half as this.
SURE = 0.45
#: Bins of a numeric feature, cut at quantiles of the sample; hash buckets of a category.
BINS, BUCKETS = 10, 64
#: A document is rejected below this score.
THRESHOLD = 0.3

TEXT = ("upper", "exclaim", "symbol", "digit", "bar", "distinct", "repeated", "mean_length", "short", "all_upper", "ends_odd", "log_words", "lines", "mean_line", "bytes_a_char")
META = ("n_chars", "recorded")
CATEGORIES = ("lang", "source")

_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, dtype=np.int32)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[128:] = 1
_DIGIT = np.zeros(256, dtype=np.int32)
_DIGIT[48:58] = 1
_SYMBOL = np.zeros(256, dtype=np.int32)
_SYMBOL[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]] = 1
_HEAD = np.zeros(256, dtype=np.int32)
_HEAD[:128] = 1
_HEAD[192:] = 1


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return (total[starts[1:]] - total[starts[:-1]]).astype(np.float64)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numeric text features, numeric metadata and category buckets of each row."""
    n = batch.num_rows
    text, meta = np.zeros((n, len(TEXT))), np.zeros((n, len(META)))
    recorded = np.array(batch.column("n_chars").fill_null(-1), dtype=np.float64)
    for low, high, data, starts in text_slices(batch.column("text")):
        hashes, first, last, rows = words(data, starts)
        size, count = np.diff(starts).astype(np.float64), np.diff(rows).astype(np.float64)
        some, letters = np.maximum(count, 1), np.maximum(_sums(_LETTER[data], starts), 1)
        upper = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(_UPPER[data], out=upper[1:])
        length = last - first
        row = np.repeat(np.arange(high - low), np.diff(rows))
        per_row = lambda x: np.bincount(row, weights=x, minlength=high - low)  # noqa: B023, E731
        again = np.zeros(len(hashes))
        if len(hashes) > 1:
            again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        order = np.lexsort((hashes, row))
        fresh = np.ones(len(hashes))
        if len(hashes) > 1:
            fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order], weights=fresh, minlength=high - low)
        ends = data[last - 1] if len(last) else np.zeros(0, dtype=np.uint8)
        view = text[low:high]
        view[:, 0] = (upper[starts[1:]] - upper[starts[:-1]]) / letters
        view[:, 1] = _sums(data == 33, starts) / some
        view[:, 2] = _sums(_SYMBOL[data], starts) / np.maximum(size, 1)
        view[:, 3] = _sums(_DIGIT[data], starts) / np.maximum(size, 1)
        view[:, 4] = _sums(data == 124, starts) / some
        view[:, 5] = distinct / np.maximum(some, 1) ** 0.85
        view[:, 6] = per_row(again) / some
        view[:, 7] = per_row(length) / some
        view[:, 8] = per_row(length <= 3) / some
        view[:, 9] = per_row((upper[last] - upper[first] == length) & (length > 1)) / some if len(length) else 0.0
        view[:, 10] = per_row((_LETTER[ends] == 0) & (ends != 46) & (ends != 44)) / some
        view[:, 11] = np.log1p(count)
        chars, lines = _sums(_HEAD[data], starts), _sums(data == 10, starts) + 1
        view[:, 12] = np.log1p(lines)
        view[:, 13] = np.log1p(chars / lines)
        view[:, 14] = size / np.maximum(chars, 1)
    meta[:, 0] = np.log1p(np.maximum(recorded, 0))
    meta[:, 1] = recorded >= 0
    buckets = np.zeros((n, len(CATEGORIES)), dtype=np.int64)
    for j, name in enumerate(CATEGORIES):
        codes = batch.column(name).dictionary_encode()
        table = np.array([sum(b * 31**i for i, b in enumerate(str(x).encode())) % BUCKETS for x in codes.dictionary.to_pylist()] + [0], dtype=np.int64)
        buckets[:, j] = table[np.array(codes.indices.fill_null(len(table) - 1), dtype=np.int64)]
    return text, meta, buckets


def _one_hot(numbers: np.ndarray, edges: list[np.ndarray], buckets: np.ndarray | None) -> np.ndarray:
    """Row numbers of set columns: one for each feature."""
    width = BINS + 1
    at = [np.searchsorted(e, numbers[:, j], "right") + j * width for j, e in enumerate(edges)]
    if buckets is not None:
        at += [buckets[:, j] + len(edges) * width + j * BUCKETS for j in range(buckets.shape[1])]
    return np.stack(at, axis=1)


def _dense(at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(at), width))
    out[np.arange(len(at))[:, None], at] = 1.0
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def co_train(views: list[np.ndarray], label: np.ndarray, fold: np.ndarray) -> dict:
    """Two views as one-hot matrices; label 0, 1 or -1 (none); fold true for the rows that only calibrate."""
    held = (label >= 0) & fold
    pool = label < 0
    pseudo = [np.full(len(label), -1) for _ in views]
    for round_ in range(ROUNDS + 1):
        models, scales = [], []
        for x, extra in zip(views, pseudo, strict=True):
            own = (label >= 0) & ~fold
            use = own | (extra >= 0)
            coef, bias = fit_logistic(x[use], np.where(own, label, extra)[use].astype(float), ridge=1.0, weight=np.where(own, 1.0, WEIGHT)[use])
            z = x @ coef + bias
            slope, shift = fit_logistic(z[held][:, None], label[held].astype(float), ridge=1e-3)
            models.append((coef, bias))
            scales.append((float(slope[0]), shift))
        odds = [s * (x @ c + b) + t for x, (c, b), (s, t) in zip(views, models, scales, strict=True)]
        if round_ == ROUNDS:
            break
        for me, other in ((0, 1), (1, 0)):
            p = sigmoid(odds[me])
            open_ = pool & (pseudo[other] < 0) & (np.abs(p - 0.5) >= SURE)
            best = np.flatnonzero(open_)[np.argsort(-np.abs(p[open_] - 0.5), kind="stable")][: int(SHARE * pool.sum())]
            pseudo[other][best] = p[best] >= 0.5
    both = np.stack(odds, axis=1)
    mix, bias = fit_logistic(both[held], label[held].astype(float), ridge=1e-2)
    return {"models": models, "scales": scales, "mix": mix, "bias": bias}


def _gathered(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The views of a bounded sample, in the order of its ids."""

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta, buckets = _views(batch)
            lists = [pa.array(list(x), type=pa.list_(pa.float64())) for x in (text, meta, buckets.astype(float))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], names=["doc_id", "label", "text", "meta", "buckets"])

    got = docs.select("doc_id", "label", "text", *CATEGORIES, "n_chars").mapInArrow(views, "doc_id long, label int, text array<double>, meta array<double>, buckets array<double>").toArrow()
    got = got.sort_by([("doc_id", "ascending")])
    shaped = lambda name, width: np.array(got.column(name).combine_chunks().flatten(), dtype=float).reshape(-1, width)
    return (np.array(got.column("doc_id")), np.array(got.column("label")), shaped("text", len(TEXT)), shaped("meta", len(META)), shaped("buckets", len(CATEGORIES)).astype(np.int64))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from bounded samples of documents with and without labels; without labels all scores are one half."""
    known = sampled_labels(labels, docs, "quality", LABELLED, more=(*CATEGORIES, "n_chars"))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().join(labels.select(F.col("doc_id").cast("long")), "doc_id", "left_anti")
    ids = written(ids.orderBy(F.xxhash64(F.lit(43), "doc_id"), "doc_id").limit(UNLABELLED), 1)
    columns = (F.coalesce("text", F.lit("")).alias("text"), *CATEGORIES, "n_chars")
    others = docs.select("doc_id", *columns).join(F.broadcast(ids), "doc_id")  # UNLABELLED bounds it, and of rows that repeat an id the least counts
    others = others.groupBy("doc_id").agg(F.min(F.struct("text", *CATEGORIES, "n_chars")).alias("row")).select("doc_id", "row.*")
    ids, label, text, meta, buckets = _gathered(known.unionByName(others.withColumn("label", F.lit(-1))))
    edges = [[np.unique(np.quantile(x[:, j], np.arange(1, BINS + 1) / (BINS + 1))) if len(x) else np.zeros(0) for j in range(x.shape[1])] for x in (text, meta)]
    ats = [_one_hot(text, edges[0], None), _one_hot(meta, edges[1], buckets)]
    widths = [len(TEXT) * (BINS + 1), len(META) * (BINS + 1) + len(CATEGORIES) * BUCKETS]
    fold = mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(3) == 0  # by hash: labels may follow a pattern of ids
    return co_train([_dense(a, w) for a, w in zip(ats, widths, strict=True)], label, fold) | {"edges": edges}


def score(docs: DataFrame, model: dict, prefix: str = "") -> DataFrame:
    """docs (text, lang, source, n_chars among their columns) with text_score, meta_score and score, their names after prefix, one pass."""
    names = [f"{prefix}{c}" for c in ("text_score", "meta_score", "score")]
    schema = docs.withColumns({c: F.lit(0.0) for c in names}).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta, buckets = _views(batch)
            odds = []
            for at, (coef, bias), (slope, shift) in zip((_one_hot(text, model["edges"][0], None), _one_hot(meta, model["edges"][1], buckets)), model["models"], model["scales"], strict=True):
                odds.append(slope * (coef[at].sum(axis=1) + bias) + shift)
            total = odds[0] * model["mix"][0] + odds[1] * model["mix"][1] + model["bias"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(sigmoid(x)) for x in (*odds, total)]], names=[*batch.schema.names, *names])

    return docs.mapInArrow(scored, schema)


def _typed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"text": F.col("text").cast("string"), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"), "n_chars": F.col("n_chars").cast("long")})


def op8_quality(spark, sf_dir: str, docs: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Scores of all documents: text_score, meta_score, score (label 1 likelier) and keep (score at least THRESHOLD).

    Null texts count as empty, null languages and sources share a bucket, a null n_chars counts as not recorded, repeated
    rows are scored one by one, ties in the order of drawing don't arise (it ends with the id). Further columns are
    ignored. An empty table gives no rows; without labels every score is 0.5 and all are kept.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet") if labels is None else labels
    docs = _typed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars"))
    scored = score(docs, fit(docs, labels)).select("doc_id", "text_score", "meta_score", "score")
    return scored.withColumn("keep", F.col("score") >= THRESHOLD)


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject, in the columns of docs.

    Rows are scored one by one, as by op8_quality, so nulls, empty texts and repeated rows count as there; an empty table
    gives no rows; further columns may have any name.
    """
    plain, name = hidden(docs)
    used = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    columns = [F.col(name[c]).cast(kind).alias(c) for c, kind in used.items()]
    model = fit(plain.select(*columns), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # the other columns travel beside those that are scored, which have the stage's types
    rest = [name[c] for c in docs.columns if c not in used]
    good = score(plain.select(*columns, *rest), model, "_").where(F.col("_score") >= THRESHOLD)
    return good.select(*[c if c in used else name[c] for c in docs.columns]).toDF(*docs.columns)
