"""Token ids of documents in Parquet files that allow selective reads.

Documents are sorted by id into ranges of files; a task encodes its rows in order and Spark's writer commits the files,
so a lost executor only repeats its own range. A row holds the ids as a list column (dictionary encoding: two bytes an
id), and beside it delta-encoded numbers (id, count of ids, ids before it in its file) and metadata. Row groups and
pages are small and have page indexes, so a reader of a few documents, or of metadata alone, reads little else. A second
table has a row for each file: its number, its first and last id, and the ids of all files before it.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.llm._text import text_slices
from lodegraph.sources.tables import scratch_path, table

#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 32 << 20, 128 << 10
#: Parts that a worker remembers, of at most so many characters; a cache only.
REMEMBERED, REMEMBERED_CHARS = 600_000, 32
#: Parts that are encoded in one text.
TOGETHER = 128
#: Bytes of text that are encoded at once; a longer document is alone.
SLICE = 4 << 20
#: The id that ends a document.
END_ID = 2

_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_known: dict[int, Encoder] = {}


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library, given by the content of its file.

    Where the tokenizer drops white space (parts_apart), a text has the ids of its parts between spaces one after
    another, so that each distinct part is encoded once by the library and looked up from then on; a space is also put
    between a letter of ASCII and a mark of punctuation, which no token spans. Other tokenizers get whole texts.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(content)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        self.parts_apart = parts_apart(content)
        self.as_bytes = {ord(c): ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in map(chr, range(192, 256))}
        self.cache: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, tokenizer, parts: list[str]) -> list[bytes]:
        """Ids of parts, many in a text; those of a text whose number of words isn't that of its parts are encoded alone."""
        out: list[bytes] = []
        groups = [parts[i : i + TOGETHER] for i in range(0, len(parts), TOGETHER)]
        for group, e in zip(groups, tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            words = np.array(e.word_ids, dtype=np.int64)
            if words[-1] + 1 == len(group):  # a part is a word at least, so each is one
                raw, ends = np.array(e.ids, dtype="<i4").tobytes(), (np.flatnonzero(np.diff(words)) + 1) * 4
                out += [raw[a:b] for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(raw)])]
            else:
                out += [np.array(ids, dtype="<i4").tobytes() for ids in self._ids(group)]
        return out

    def _new(self, parts: list[str]) -> list[bytes]:
        """Ids of parts as bytes: words of Latin letters, which no normal form changes, go to the model at once, others through the whole tokenizer."""
        out: list[bytes] = [b""] * len(parts)
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i, part in enumerate(parts):
            kinds[2 if len(part) > 1_000 else 0 if _LATIN.fullmatch(part) else 1 if part.isalpha() else 2].append(i)
        for at, made in (
            (kinds[0], self._together(self.plain, [parts[i].lower().translate(self.as_bytes) for i in kinds[0]])), (kinds[1], self._together(self.tokenizer, [parts[i] for i in kinds[1]])),
            (kinds[2], [np.array(ids, dtype="<i4").tobytes() for ids in self._ids([parts[i] for i in kinds[2]])]),
        ):
            for i, ids in zip(at, made, strict=True):
                out[i] = ids
        return out

    def _of_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([A-Za-z])([,.;:!?])", r"\1 \2"))
        coded = lists.flatten().dictionary_encode()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [self.cache.get(p) for p in parts]
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self._new([parts[i] for i in missing]), strict=True):
            found[i] = ids
            if len(self.cache) < REMEMBERED and len(parts[i]) <= REMEMBERED_CHARS:
                self.cache[parts[i]] = ids
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts, values = np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(found), dtype="<i4")
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[at]
        ends = np.cumsum(n)
        ids = values[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - starts[at], n)]
        rows = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        return ids, np.diff(np.concatenate([[0], ends])[rows])

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each text followed by end; how many ids each has). Null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.parts_apart:
            ids, counts = self._of_parts(texts)
        else:
            each = self._ids(texts.to_pylist())
            counts = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
            ids = np.concatenate([np.zeros(0, dtype=np.int32), *[np.array(e, dtype=np.int32) for e in each]])
        if end is not None:
            ids, counts = np.insert(ids, np.cumsum(counts), end), counts + 1
        return ids.astype(np.int32), counts


def parts_apart(content: str) -> bool:
    """Whether a tokenizer drops white space and nothing that it merges, replaces or adds reaches over it.

    True for files whose steps are known to work so: normal forms, white space replaced, lower case; a pattern without
    white space whose matches alone are kept; bytes as letters without a space in front; BPE; added tokens without space.
    """
    told = json.loads(content)
    listed = lambda step, key: [] if step is None else step[key] if step["type"] == "Sequence" else [step]
    normal, before = listed(told["normalizer"], "normalizers"), listed(told["pre_tokenizer"], "pretokenizers")
    plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in normal)
    split = bool(before) and before[0]["type"] == "Split" and before[0]["behavior"] == "Removed" and before[0]["invert"] and before[0]["pattern"].get("Regex") == _WORDS
    rest = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in before[1:])
    return plain and split and rest and told["model"]["type"] == "BPE" and not told["model"].get("ignore_merges") and not any(re.search(r"\s|[A-Za-z][,.;:!?]", t["content"]) for t in told["added_tokens"])


#: Fixed value: the pattern by which tokenizers of this kind cut words.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _encoder(content: str) -> Encoder:
    if (key := hash(content)) not in _known:
        _known.clear()
        _known[key] = Encoder(content)
    return _known[key]


def write_token_ids(docs: DataFrame, path: str, content: str, end: int | None = END_ID, metadata: tuple[str, ...] = (), files: int | None = None, row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """Write docs (doc_id, text, metadata) as token ids under path: path/ids and path/files.

    content is what the tokenizer's file holds; it travels to the tasks. Rows ascend by doc_id, nulls first, rows of one
    id by a hash of their text; rows equal in both are interchangeable, and cut between files like others. files: how many
    (the session's shuffle partitions if None). metadata columns are kept, under their own names with meta_ before them.
    """
    spark = docs.sparkSession
    kept = [F.col(c).cast("string").alias(f"meta_{c}") for c in metadata]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *kept, F.xxhash64("text").alias("_text"), F.xxhash64(F.monotonically_increasing_id()).alias("_tie"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_text"), F.col("_tie")]
    dealt = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions(*keys).select("doc_id", "text", *[f"meta_{c}" for c in metadata], F.spark_partition_id().alias("file"))
    sent = spark.sparkContext.broadcast(content)
    names = [f"meta_{c}" for c in metadata]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(sent.value), 0
        for batch in batches:
            for low, high, _, _ in text_slices(batch.column("text"), SLICE):
                own = batch.slice(low, high - low)
                ids, counts = encoder.encode(own.column("text"), end)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                columns = [own.column("doc_id"), own.column("file"), pa.array(before + ends - counts), pa.array(counts), *[own.column(c) for c in names], lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "at", "n_tokens", *names, "ids"])
                before += int(ends[-1])

    schema = f"doc_id long, file int, at long, n_tokens long, {''.join(f'{c} string, ' for c in names)}ids array<int>"
    writer = dealt.mapInArrow(run, schema).write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", row_group).option("parquet.page.size", page)
    for column in ("doc_id", "at", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")  # deltas
    writer.option("compression", "zstd").parquet(f"{path}/ids")
    files_ = read_rows(spark, path, "doc_id", "file", "n_tokens").groupBy("file").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    files_.withColumn("start", F.sum("n_tokens").over(Window.orderBy("file")) - F.col("n_tokens")).write.parquet(f"{path}/files")  # a row for each file


def read_rows(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Rows of the files under path, of which only the named columns are read."""
    rows = spark.read.parquet(f"{path}/ids")
    return rows.select(*columns) if columns else rows


def read_documents(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Rows with start of the documents from id low to id high; page indexes and footers spare the others."""
    return with_start(read_rows(spark, path).where(F.col("doc_id").between(low, high)), path)


def with_start(rows: DataFrame, path: str) -> DataFrame:
    """rows with start, the ids of all documents before each one, in place of file and at."""
    files = rows.sparkSession.read.parquet(f"{path}/files").select("file", F.col("start").alias("_start"))
    return rows.join(files, "file").withColumn("start", F.col("_start") + F.col("at")).drop("file", "at", "_start")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the CRC-32 of their ids, as little-endian unsigned 32-bit integers, in place of them."""
    for batch in batches:
        lists = batch.column("ids")
        raw = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) * 4
        sums, low = [], 0
        for high in ends.tolist():
            sums.append(zlib.crc32(raw[low:high]))
            low = high
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("at"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "file", "at", "n_tokens", "ids_crc32"])


def op12_token_ids(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files that hold them.

    Null texts are empty and have the end id alone. Null ids come first; rows of one id stand by a hash of their text,
    equal ones in any order, so their starts are those of the group in some order. Further columns are left out. No
    documents give no rows.
    """
    import public_tokenizers

    docs = table(spark, sf_dir, "documents") if docs is None else docs
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        content = f.read()
    path = scratch_path(spark)
    write_token_ids(docs, path, content, metadata=("lang", "source"))
    rows = read_rows(spark, path, "doc_id", "file", "at", "n_tokens", "ids").mapInArrow(_checked, "doc_id long, file int, at long, n_tokens long, ids_crc32 long")
    return with_start(rows, path).select("doc_id", "start", "n_tokens", "ids_crc32")
