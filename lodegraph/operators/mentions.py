"""Mentions of names of any number of words in texts, by Aho-Corasick automata over shards of the names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the names in one shard at most; a node of an automaton takes some 60 bytes.
SHARD_CHARS = 1_000_000

_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_built: dict[tuple, object] = {}


def _automaton(names: list[str]):
    """The automaton over names in lower case, kept by the worker for the next task of the same shard."""
    import ahocorasick

    key = (len(names), hash(tuple(names)))
    if key not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for at, name in enumerate(names):
            made.add_word(name, at)
        made.make_automaton()
        _built[key] = made
    return _built[key]


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether a word (letters of ASCII, digits, underscore) begins or ends at start, and at end."""
    first = (start > 0 and text[start - 1] in _WORD) != (text[start] in _WORD)
    return first and (end < len(text) and text[end] in _WORD) != (text[end - 1] in _WORD)


def _counted(names: list[str], bounds: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(names)
        for batch in batches:
            ids, found, counts = [], [], []
            for ident, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = (text or "").lower()
                own: dict[int, list[int]] = {}  # of a name: end of its last match, matches
                for last, at in automaton.iter(text):
                    start, end = last + 1 - len(names[at]), last + 1
                    seen = own.get(at)
                    if (seen is None or start >= seen[0]) and (not bounds or _bounded(text, start, end)):
                        own[at] = [end, 1 + (seen[1] if seen else 0)]
                for at, (_, n) in own.items():
                    ids.append(ident)
                    found.append(names[at])
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], type=batch.schema.field(0).type), pa.array(found, pa.string()), pa.array(counts, pa.int64())], names=["id", "key", "mentions"])

    return run


def mentions(docs: DataFrame, names: DataFrame, ident: str, text: str, bounds: bool = True, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(ident, name, mentions): how often each text holds each name, case aside, matches of one name not overlapping.

    With bounds, a match has to begin and end where a word does. Names that differ in case alone each get the count.
    Names are dealt into shards of a bounded size, each of which is a pass over the texts; null and empty names match
    nothing, null texts hold nothing.
    """
    wanted = names.select("name").where("name IS NOT NULL AND length(trim(name)) > 0").distinct()
    keyed = wanted.withColumn("key", F.lower("name"))
    total = keyed.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_chars))
    kind = docs.schema[ident].dataType.simpleString()
    texts, found = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")), []
    for shard in range(shards):
        own = keyed.select("key").distinct().where(F.pmod(F.xxhash64("key"), F.lit(shards)) == shard)
        held = sorted({r.key.lower() for r in own.toLocalIterator()})  # about shard_chars
        if held:
            found.append(texts.mapInArrow(_counted(held, bounds), f"id {kind}, key string, mentions long"))
    if not found:
        return docs.select(ident).limit(0).withColumns({"name": F.lit("").cast("string"), "mentions": F.lit(0).cast("long")})
    counted = reduce(DataFrame.unionByName, found).groupBy("id", "key").agg(F.sum("mentions").alias("mentions"))  # rows of one document, such as its chunks
    return counted.join(keyed, "key").select(F.col("id").alias(ident), "name", "mentions")


def entities_of_chunks(chunks: DataFrame, names: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, entities): the names that each chunk contains anywhere, case aside, in order; chunks without any are left out."""
    return mentions(chunks, names, ident, text, bounds=False).groupBy(ident).agg(F.sort_array(F.collect_set("name")).alias("entities"))


def updated_counts(known: DataFrame, found: DataFrame, ident: str) -> DataFrame:
    """known (name, mention_count) with the mentions of found (ident, name, mentions) added, document_count, and outcome.

    outcome is updated where found has the name, kept where it hasn't, and not_found (with the count of found) for names
    that are not known. A null count is 0.
    """
    more = found.groupBy("name").agg(F.sum("mentions").alias("_more"), F.count_distinct(ident).alias("document_count"))
    both = known.select("name", F.coalesce("mention_count", F.lit(0)).cast("long").alias("_old")).join(more, "name", "full")
    outcome = F.when(F.col("_old").isNull(), "not_found").when(F.col("_more").isNull(), "kept").otherwise("updated")
    return both.select("name", (F.coalesce("_old", F.lit(0)) + F.coalesce("_more", F.lit(0))).cast("long").alias("mention_count"), F.coalesce("document_count", F.lit(0)).cast("long").alias("document_count"), outcome.alias("outcome"))


def top_mentioned(counts: DataFrame, limit: int = 50) -> DataFrame:
    """The names with most mentions, ties by name."""
    return counts.orderBy(F.desc("mention_count"), "name").limit(limit)
