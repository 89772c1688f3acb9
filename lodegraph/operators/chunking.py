"""Cutting texts into sentences, windows of words and stretches of one topic."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: abbreviations after which a full stop ends no sentence
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "vs", "etc", "inc", "ltd", "corp", "st", "ave", "blvd", "rd", "dept", "fig", "no", "e\\.g", "i\\.e")
_ABBR = "|".join(ABBREVIATIONS)
_BREAK = f"(?<=[.!?])(?<!(?<![A-Za-z0-9_])(?i:{_ABBR})\\.)\\s+(?=[A-Z])(?!(?i:{_ABBR})\\.)"


def sentences(text: Column) -> Column:
    """Sentences in order: cut after . ! ? before a capital, but not after an abbreviation; null has none."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", " "))
    return F.filter(F.transform(F.split(flat, _BREAK), lambda s: F.trim(s)), lambda s: s != F.lit(""))


def windows(words: Column, size: int = 500, overlap: int = 50) -> Column:
    """struct(index, start, text) of windows of size words that overlap; the last ends with the text, without repeats of it."""
    step = size - overlap
    n = F.size(words)
    count = F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil((n - overlap) / step).cast("int")))
    made = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.struct(i.alias("index"), (i * step).alias("start"), F.array_join(F.slice(words, i * step + 1, F.lit(size)), " ").alias("text")))
    return F.when(n > 0, made).otherwise(F.array().cast("array<struct<index:int,start:int,text:string>>"))


def hashed_embedding(texts: list[str], size: int = 64) -> np.ndarray:
    """A vector for each text from its hashed words: what stands in for a model offline."""
    out = np.zeros((len(texts), size))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            out[i, h % size] += 1.0 if h >> 16 & 1 else -1.0
    return out


def distances(vectors: np.ndarray) -> np.ndarray:
    """1 - cosine of neighbours; a zero vector has cosine 0 with any."""
    norm = np.linalg.norm(vectors, axis=1)
    both = norm[:-1] * norm[1:]
    return 1.0 - np.where(both > 0, (vectors[:-1] * vectors[1:]).sum(axis=1) / np.where(both > 0, both, 1.0), 0.0)


def breaks(gaps: np.ndarray, percentile: float = 95.0) -> np.ndarray:
    """Places of gaps above the value at floor(percentile / 100 (n - 1)) of their order."""
    if not len(gaps):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(gaps > np.sort(gaps)[int(np.floor(percentile / 100 * (len(gaps) - 1)))])


def assembled(counts: list[int], ends: list[int], least: int = 50, most: int = 800) -> list[tuple[int, int, str]]:
    """(first sentence, last sentence, method) of chunks: stretches that end at ends, those of fewer than least words joined with the next.

    counts: words of each sentence. A stretch of more than most words is marked large, to be cut into windows.
    """
    out, start, held = [], 0, None
    for end in [*ends, len(counts) - 1]:
        if end < start:
            continue
        chunk, start = (start, end), end + 1
        size = sum(counts[chunk[0] : chunk[1] + 1])
        if held is not None:
            if sum(counts[held[0] : held[1] + 1]) < least:
                held = (held[0], chunk[1], "semantic_merged")
                continue
            out.append(held)
            held = None
        if size < least:
            held = (*chunk, "semantic")
        else:
            out.append((*chunk, "large" if size > most else "semantic"))
    return [*out, held] if held is not None else out


def semantic_chunks(docs: DataFrame, ident: str, text: str, embed: Callable[[list[str]], np.ndarray] = hashed_embedding, buffer: int = 1, percentile: float = 95.0, least: int = 50, most: int = 800, overlap: int = 30) -> DataFrame:
    """(ident, index, content, words, first_sentence, last_sentence, method): texts cut where neighbouring sentences differ most.

    A sentence is embedded with buffer sentences on either side; embed takes and gives a batch of them, and is what a
    model is plugged in by. Texts of fewer than three sentences are one chunk; stretches of few words are joined with the
    next; long ones are cut into windows of most words that overlap. A text is one row, so nothing is shuffled.
    """
    kind = dict(docs.dtypes)[ident]
    schema = f"{ident} {kind}, index int, content string, words int, first_sentence int, last_sentence int, method string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, parts in enumerate(batch.column("_s").to_pylist()):
                if not parts:
                    continue
                if len(parts) < 3:
                    found = [(" ".join(parts), 0, len(parts) - 1, "single")]
                else:
                    near = [" ".join(parts[max(0, k - buffer) : k + buffer + 1]) for k in range(len(parts))]
                    ends = breaks(distances(embed(near)), percentile).tolist()
                    found = []
                    for a, b, method in assembled([len(p.split()) for p in parts], ends, least, most):
                        content = " ".join(parts[a : b + 1])
                        if method == "large":
                            words = content.split()
                            found += [(" ".join(words[k : k + most]), a, b, "semantic_split") for k in range(0, max(1, len(words) - overlap), most - overlap)]
                        else:
                            found.append((content, a, b, method))
                at += [i] * len(found)
                out += [(n, c, len(c.split()), a, b, m) for n, (c, a, b, m) in enumerate(found)]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(ident).take(pa.array(at, type=pa.int64())), *[pa.array(list(c), type=t) for c, t in zip(columns, kinds, strict=True)]], names=[ident, "index", "content", "words", "first_sentence", "last_sentence", "method"])

    return docs.select(ident, sentences(F.col(text)).alias("_s")).mapInArrow(run, schema)


def chunks(docs: DataFrame, ident: str, text: str, most_chars: int = 200_000) -> DataFrame:
    """(ident, index, content, strategy): semantic chunks, or windows of words for texts of over most_chars characters."""
    small = semantic_chunks(docs.where(F.length(text) <= most_chars), ident, text).select(ident, "index", "content", F.lit("semantic").alias("strategy"))
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\\s+"), lambda w: w != F.lit(""))
    large = docs.where(F.length(text) > most_chars).select(ident, words.alias("_w")).select(ident, F.explode(windows(F.col("_w"))).alias("c"))
    return small.unionByName(large.select(ident, "c.index", F.col("c.text").alias("content"), F.lit("fixed").alias("strategy")))


def sampled(items: Column, k: int) -> Column:
    """k items of an array taken evenly, all if there are no more."""
    n = F.size(items)
    return F.when(n <= k, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(items, F.floor(i * n / k).cast("int"))))


def key_coverage(text: Column, keys: Column) -> Column:
    """The share of key names that a text contains, case aside; 1 of none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(keys) > 0, F.size(F.filter(keys, lambda k: low.contains(F.lower(k)))) / F.size(keys)).otherwise(1.0)
