"""Secrets: fixed patterns, and a password guess-cost dynamic programme over credential-context values.

A value in a credential context (after words such as password or token, in an Authorization header, in a URL's user
info) is segmented at minimum cost into dictionary words, dates, repeats, keyboard walks and brute-force spans, the
cost being log10 of the guesses that an attacker needs. Values that would take too many guesses to be a placeholder or
a plain word are reported as kind "guess" beside the spans of the fixed patterns, which always stay. The dictionary is
a short list of what attackers try first, and then the words of the documents by how often they occur.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm._spans import Span, found, joined, sha256
from lodegraph.llm._text import text_slices
from lodegraph.sources.tables import written

KINDS = ("assign", "access", "hex", "guess")
#: Guesses, as log10, from which a value counts as a secret.
LEAST_LOG10_GUESSES = 8.0

# fixed values: the base patterns
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # the runs [0-9a-f]+ of 32 characters or more

#: Wider credential contexts whose value the guess cost decides on; the value is the last group that took part.
CONTEXTS = re.compile(
    r"""(?:(?i:pass(?:word|wd|phrase|code)?|pwd|secret(?:_?key)?|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|auth)["']?\x20*(?::=|=>|[:=])\x20*(?:"([^"\n]{4,})"|'([^'\n]{4,})'|([^\s"',;]{4,}))"""
    r"""|(?i:bearer|basic)\x20([A-Za-z0-9+/_.=~-]{8,})"""
    r"""|(?<=[a-z0-9+])://[^\s:/@]+:([^\s/@]{4,})@)""",
    re.ASCII,
)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "basic", "://")

#: Words that are read off the documents, most frequent first, after those of WORDS; of so few letters at least.
DICTIONARY, LEAST_LETTERS = 20_000, 3
#: Words that attackers try first, most usual first.
WORDS = (
    "password", "secret", "admin", "token", "example", "changeme", "test", "qwerty", "letmein", "welcome", "default", "user", "root", "login",
    "master", "dragon", "monkey", "shadow", "sunshine", "princess", "football", "baseball", "superman", "batman", "iloveyou", "trustno", "hello",
    "freedom", "whatever", "computer", "internet", "summer", "winter", "spring", "autumn", "secure", "public", "private", "value", "your", "here",
    "none", "null", "true", "false", "string", "placeholder", "redacted", "dummy", "sample", "foo", "bar", "baz", "the", "and", "key", "pass", "word",
    "my", "api", "xxx", "abc", "guest", "system", "server", "database", "demo", "temp", "new", "old", "love", "money", "jesus", "michael", "charlie",
)
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "!@#$%^&*()", "abcdefghijklmnopqrstuvwxyz")
_LEET = str.maketrans("@4310$57!", "aaeiosstl")
_DATE = re.compile(r"(?:19|20)\d{2}[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d{2}|(?:19|20)\d{2}")


def _alphabet(c: str) -> float:
    if c.isdigit():
        return 10.0
    if c.isalpha() and c.isascii():
        return 26.0
    return 33.0 if c.isascii() else 100.0


class Ranks:
    """Words by rank, the first at 2."""

    def __init__(self, words: Iterable[str]):
        self.ranks = {w: r for r, w in enumerate(dict.fromkeys(words), 2)}
        self.longest = max(map(len, self.ranks), default=0)


_USUAL = Ranks(WORDS)


@lru_cache(maxsize=4096)
def guess_cost(value: str, words: Ranks = _USUAL) -> float:
    """log10 of the guesses of the cheapest segmentation of the whole value; empty values cost 0.

    best[i] is the least cost of the first i characters. A segment is a dictionary word (its rank, doubled for case and
    for look-alike characters), a date, a repeat of one character or block, a walk along a keyboard row or the alphabet,
    or a brute-force span at its characters' alphabets. Each further segment doubles the guesses for the arrangement.
    """
    head, n = value, len(value)
    lower = "".join(low if len(low := c.lower()) == 1 else c for c in head)
    plain, ranks, split = lower.translate(_LEET), words.ranks, math.log10(2)
    longest = words.longest
    brute = [0.0]
    for c in head:
        brute.append(brute[-1] + math.log10(_alphabet(c)))
    by_end: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        if head[i].isdigit() and (m := _DATE.match(head, i)):
            by_end.setdefault(m.end(), []).append((i, math.log10(365 * 120 if m.end() - i > 4 else 120)))
    steps = len(_ROWS) * 2 * 26
    walks: dict[int, list[int]] = {}  # by end: where the longest walks start that reach it
    for step in (1, -1):
        start = 0
        for i in range(1, n + 1):
            if i == n or not any(0 <= row.find(lower[i - 1]) + step < len(row) and row.find(lower[i - 1]) >= 0 and row[row.find(lower[i - 1]) + step] == lower[i] for row in _ROWS):
                for j in range(start + 3, i + 1):
                    walks.setdefault(j, []).append(start)
                start = i
    repeats: dict[int, list[tuple[int, int]]] = {}  # by end: width of the block, where its repeats start
    for width, start, end in _repeats(head, longest):
        for j in range(start + 2 * width, end + 1):
            repeats.setdefault(j, []).append((width, start))
    lengths = np.log10(np.arange(1, n + 2))
    best, least = np.zeros(n + 1), 0.0  # least: of best[i] + split - brute[i], what a brute-force span from i on starts with
    begins = np.full(n + 1, split)  # best[i] and what a further segment costs
    begins[0] = 0.0
    for j in range(1, n + 1):
        low = least + brute[j]
        for i, cost in by_end.get(j, ()):
            low = min(low, begins[i] + cost)
        for i in walks.get(j, ()):
            low = min(low, (begins[i : j - 2] + lengths[2 : j - i][::-1]).min() + math.log10(steps))
        for i in range(max(0, j - longest), j):
            rank = ranks.get(lower[i:j])
            extra = 0.0
            if rank is None:
                rank, extra = ranks.get(plain[i:j]), split
            if rank is not None:
                extra += split if head[i:j] != lower[i:j] else 0.0
                low = min(low, begins[i] + math.log10(rank) + extra)
        for width, start in repeats.get(j, ()):
            times = (j - start) // width
            rank = ranks.get(lower[j - width : j]) if width <= longest else None
            block = math.log10(rank) if rank is not None else brute[j] - brute[j - width]
            low = min(low, (begins[j - times * width : j - width : width] + lengths[1:times][::-1]).min() + block)
        best[j] = low
        begins[j] = low + split
        least = min(least, low + split - brute[j])
    return float(best[n])


def _repeats(text: str, longest: int) -> list[tuple[int, int, int]]:
    """(width, start, end) of maximal stretches in which blocks of a width stand twice or more.

    A block over longest that itself repeats a shorter one is left out: the shorter one has the same stretch, and costs less.
    """
    at, found = np.array([ord(c) for c in text], dtype=np.uint32), []
    known: dict[tuple[int, int], list[int]] = {}
    for width in range(1, len(at) // 2 + 1):
        if not (at[width::width] == at[:-width:width]).any():  # a block and its copy span a multiple of the width
            continue
        same = np.concatenate([[False], at[width:] == at[:-width], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if last - first < width:
                continue
            shorter = known.setdefault((first, last + width), [])
            if width <= longest or not any(width % w == 0 for w in shorter):
                found.append((width, first, last + width))
                shorter.append(width)
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns."""
    lower = text.lower()
    spans = found(text, "assign", ASSIGN, lambda m: len(m.group(2)) >= 8) if any(h in lower for h in _ASSIGN_HINTS) else []
    if "AKIA" in text:
        spans += found(text, "access", ACCESS, lambda m: m.end() - m.start() >= 16)
    return spans + found(text, "hex", HEX, lambda m: True)


def added_spans(text: str, base: list[Span], words: Ranks = _USUAL) -> list[tuple[int, int, str, float]]:
    """Credential-context values that the guess cost calls secrets, unless a base span already overlaps them."""
    lower, spans = text.lower(), []
    if not any(h in lower for h in _HINTS):
        return []
    for m in CONTEXTS.finditer(text):
        group = m.lastindex
        start, end = m.span(group)
        value = m.group(group).rstrip(").,;")
        end = start + len(value)
        if any(s < end and start < e for s, e, _ in base):
            continue
        if (cost := guess_cost(value, words)) >= LEAST_LOG10_GUESSES:
            spans.append((start, end, "guess", cost))
    return spans


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words of letters a to z of a batch, case aside, counted."""
    for batch in batches:
        for low, high, _, _ in text_slices(batch.column(0), 4 << 20):
            lower = pc.ascii_lower(pc.fill_null(batch.column(0).slice(low, high - low).cast(pa.large_string()), ""))
            words = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, "[^a-z]+", " ")).flatten()
            words = words.filter(pc.greater_equal(pc.binary_length(words), LEAST_LETTERS)).cast(pa.string())
            counts = words.value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["word", "n"])


def words_of(docs: DataFrame, text: str, most: int = DICTIONARY) -> list[str]:
    """The most frequent words of all texts, most frequent first, ties by the word: as many as `most` at most.

    Words are taken by bands of their counts, a sixteenth of a doubling each, as long as whole bands fit, so that only
    the sizes of bands and the words taken come to the driver.
    """
    band = F.floor(F.log2("n") * 16).cast("int")
    counts = written(docs.select(text).mapInArrow(_tallied, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("band", band))
    taken, least = 0, None
    for r in sorted(counts.groupBy("band").count().collect(), key=lambda r: -r.band):  # some 1,000 bands
        if taken + r["count"] > most:
            break
        taken, least = taken + r["count"], r.band
    found = [] if least is None else counts.where(F.col("band") >= least).collect()
    return [r.word for r in sorted(found, key=lambda r: (-r.n, r.word))]


def scan(docs: DataFrame, ident: str, text: str, words: Iterable[str] = WORDS) -> DataFrame:
    """(ident, secrets: array of start, end, kind, value, log10 guesses), one row a document; null texts have none.

    words are what a value may be made of cheaply, most usual first.
    """
    listed = tuple(words)
    schema = docs.select(ident).schema.simpleString()[7:-1] + ", secrets array<struct<start:int,end:int,kind:string,value:string,cost:double>>"

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(listed)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("cost", pa.float64())]))
        for batch in batches:
            rows = []
            for value in batch.column(text):
                whole = value.as_py() or ""
                base = base_spans(whole)
                every = [(*s, guess_cost(ASSIGN.match(whole, s[0]).group(2) if s[2] == "assign" else whole[s[0] : s[1]], ranks)) for s in base] + added_spans(whole, base, ranks)
                rows.append([{"start": a, "end": b, "kind": k, "value": whole[a:b], "cost": c} for a, b, k, c in sorted(every)])
            yield pa.RecordBatch.from_arrays([batch.column(ident), pa.array(rows, type=kind)], names=[ident, "secrets"])

    return docs.select(ident, text).mapInArrow(scanned, schema)


def op10_secrets(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Counts and digests of the secrets in all documents.

    Null texts count as empty and give zero counts, the digest of the empty text and empty spans; repeated rows are rows
    of their own; of matches that begin at one place, the pattern decides, so there are no ties; an empty table gives no
    rows; further columns are ignored. log10_guesses has the cost of each of spans, joined likewise.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return digests(scan(docs, "doc_id", "text", [*WORDS, *words_of(docs, "text")]), "secrets", KINDS[:3], KINDS, ("cost", "log10_guesses"))


def digests(found_spans: DataFrame, column: str, base: tuple[str, ...], kinds: tuple[str, ...], value: tuple[str, str], flag: str | None = None) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256, spans and a number of each, from an array of spans.

    flag: the field that marks base ones; value: the field that has the number, and the name of its column.
    """
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in base) + f", base_sha256 string, spans string, {value[1]} string"

    def derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(column).to_pylist()
            spans = [[(s["start"], s["end"], s["kind"]) for s in row] for row in rows]
            numbers = [",".join(f"{s[value[0]]:.3f}" for s in sorted(row, key=lambda s: (s["start"], kinds.index(s["kind"]), s["end"]))) for row in rows]
            own = [[(s["start"], s["end"], s["kind"]) for s in row if (s[flag] if flag else s["kind"] in base)] for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([sum(s[2] == k for s in row) for row in own], type=pa.int64()) for k in base], pa.array([sha256(joined(row, kinds)) for row in own]), pa.array([joined(row, kinds) for row in spans]), pa.array(numbers, type=pa.string())],
                names=["doc_id", *[f"n_{k}" for k in base], "base_sha256", "spans", value[1]],
            )

    return found_spans.mapInArrow(derived, schema)
