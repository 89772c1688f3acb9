"""Vector codes, token ids and Merkle manifests against brute force and exact round trips, and on awkward rows."""

import collections
import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import codes, merkle, token_ids
from lodegraph.sources.tables import scratch_path

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, at string, g string, node string, ids string, file int"


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("aeioustrnlé"), size=rng.integers(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    made = [(i, sentence(rng, int(rng.integers(0, 60))), ("en", "de", None)[min(i % 7, 2)], f"s{i % 3}", 9) for i in range(700)]
    made += [(None, None, None, None, None), (None, "", "", None, None), (5, "Another text", "en", "s", 1), (5, made[5][1], made[5][2], made[5][3], 9), (-4, "don't STOP, it's\t\x01 <|endoftext|> 12.5 naïvé  x", "fr", "s", 0), (900, "x" * 30_000, "en", None, 2), (901, sentence(rng, 20_000), "it", "s", 3), (902, "Ünder.score!? 'll\n\n're", "e n", "s", 4)]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w", 1) for r in rows], DOCS).repartition(5)


def nearest(points, book):
    far = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    return far.argmin(axis=1), far.min(axis=1)


def test_dual_tree_assigns_like_all_pairs():
    rng = np.random.default_rng(1)
    whole = 0
    for trial in range(120):
        m, w, k, scale = int(rng.integers(1, 300)), int(rng.integers(1, 9)), int(rng.integers(1, 17)), int(rng.choice([3, 60, 5000]))
        points = rng.integers(-scale, scale, (m, w)) if trial % 3 else rng.integers(-scale, scale, (4, w))[rng.integers(0, 4, m)] + rng.integers(-1, 2, (m, w))
        book = points[rng.integers(0, m, k)] if trial % 2 else rng.integers(-scale, scale, (k, w))
        tree = codes.Tree(points, int(rng.choice([1, 4, 16])))
        got, sums, counts, n = codes.assigned(tree, book)
        whole += n
        want = nearest(points, book)[0]
        back = np.zeros(m, dtype=np.int64)
        back[tree.places] = got
        assert (back == want).all()  # ties as well: entries repeat
        total = np.zeros_like(book)
        np.add.at(total, want, points)
        assert (total == sums).all() and (np.bincount(want, minlength=k) == counts).all()
    assert whole > 5_000  # nodes are assigned by their sums


def lloyd(rows, parts=8, entries=16, rounds=6):
    """The contract in plain numpy: {(vec_id, code): error} of kept rows and the codebooks."""
    kept = sorted((r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(r[1]) for r in kept) // parts) * parts
    x = np.zeros((len(kept), width), dtype=np.int64)
    for i, r in enumerate(kept):
        x[i, : len(r[1])] = [int(np.floor(4096 * float(np.float32(v)))) for v in r[1]]
    out, books = np.zeros((len(kept), parts), dtype=np.int64), []
    error = np.zeros(len(kept), dtype=np.int64)
    for p, part in enumerate(np.split(x, parts, axis=1)):
        book = part[:entries].copy()
        for _ in range(rounds):
            own = nearest(part, book)[0]
            for e in set(own.tolist()):
                book[e] = [int(part[own == e][:, j].sum()) // int((own == e).sum()) for j in range(part.shape[1])]
        out[:, p], far = nearest(part, book)
        error += far
        books.append(book)
    return kept, ["".join(f"{c:02x}" for c in r) for r in out], error, books


@pytest.mark.parametrize("dims, n", [(16, 300), (13, 9), (64, 40)])
def test_codes_against_plain_rounds(spark, dims, n):
    rng = np.random.default_rng(dims)
    data = [(int(i), [float(v) for v in np.float32(rng.normal(size=dims) * 0.2)], int(rng.integers(0, 4)) if i % 5 else None) for i in rng.permutation(n)]
    data += [(1, data[0][1], 2), (None, data[1][1], None), (7, None, 1), (8, [float("nan")] + [0.0] * (dims - 1), 1), (9, [None] * dims, 3), (10, [float("inf")] * dims, 3), (n + 1, data[0][1][: dims - 3], 1), data[3]]
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in data], "vec_id long, embedding array<float>, label int, code string, error double").repartition(3)
    got = codes.op11_codes(spark, "", frame).collect()
    kept, want, error, books = lloyd(data)
    assert collections.Counter((r.vec_id, r.code, r.error) for r in got) == collections.Counter((k[0], c, int(e)) for k, c, e in zip(kept, want, error, strict=True))
    by = collections.Counter()
    for k, e in zip(kept, error, strict=True):
        by[k[2]] += int(e)
    label = {(k[0], c): k[2] for k, c in zip(kept, want, strict=True)}
    assert all(r.label_error == by[label[r.vec_id, r.code]] for r in got if r.vec_id not in (1,))
    told = ",".join(str(v) for b in books for e in b for v in e)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(told.encode()).hexdigest()}


def test_codes_of_no_and_of_too_large_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codes.op11_codes(spark, "", spark.createDataFrame([(1, None, 2)], schema)).count() == 0
    assert codes.op11_codes(spark, "", spark.createDataFrame([(1, [], 2), (2, [], None)], schema)).count() == 2
    with pytest.raises(ValueError, match="below"):
        codes.op11_codes(spark, "", spark.createDataFrame([(1, [1e9], 2)], schema))


def content(name="word_bpe_49k.json"):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_agrees_with_the_library_on_whole_texts(rows, name):
    import pyarrow as pa
    from tokenizers import Tokenizer

    encoder, plain = token_ids.Encoder(content(name)), Tokenizer.from_str(content(name))
    assert encoder.parts_apart == name.startswith("word")
    odd = ["á.b", "́x", "x ́", "A.B.c", "İstanbul ΑΣ ς.", "it's 's 't'll", "é,é", "Ω Å", "a​.b c\x1cd", "\x01", "a\x01 b", "<|endoftext|>a.<|startoftext|>", "\U0001f600!\U0001f600", "a?≠", "\r\n\v\f", "ﬁ.ﬂ", "한국어。中文,x", "ẛ̣."]
    texts = [r[1] for r in rows] + odd
    for _ in range(2):  # new, and from the cache
        ids, counts = encoder.encode(pa.array(texts), 2)
        for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 2], repr(text)[:80]


def test_token_ids_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(content())
    got = token_ids.op12_token_ids(spark, "", docs).collect()
    sums = lambda text: zlib.crc32(np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes())
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == collections.Counter((r[0], sums(r[1])) for r in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens >= 1
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i or 0))
    assert token_ids.op12_token_ids(spark, "", docs.limit(0)).count() == 0


def test_token_files_allow_selective_reads(spark, docs):
    path = scratch_path(spark)
    token_ids.write_token_ids(docs, path, content(), metadata=("lang", "source", "at"), files=3, row_group=4_000, page=1_000)
    names = sorted(f.removeprefix("file:").replace("file://", "") for f in spark.read.parquet(f"{path}/ids").inputFiles())
    assert len(names) == 3
    for f in names:
        told = pq.ParquetFile(f.replace("//", "/")).metadata
        own = {told.row_group(0).column(i).path_in_schema: told.row_group(0).column(i) for i in range(told.num_columns)}
        assert told.num_row_groups > 1 and all(c.has_offset_index for c in own.values()) and own["doc_id"].has_column_index
        assert "RLE_DICTIONARY" in own["ids.list.element"].encodings and {own[c].encodings for c in ("doc_id", "at", "n_tokens")} == {("DELTA_BINARY_PACKED",)}
    some = token_ids.read_documents(spark, path, 100, 104)
    assert sorted(r.doc_id for r in some.collect()) == [100, 101, 102, 103, 104] and "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100)" in some._sc._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    light = token_ids.read_rows(spark, path, "doc_id", "meta_lang")
    assert light.count() == docs.count() and "ids" not in light._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    files = spark.read.parquet(f"{path}/files").orderBy("file").collect()
    assert [f.start for f in files] == [0, *np.cumsum([f.n_tokens for f in files])[:-1].tolist()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    """Levels of nodes from the leaves to the one at the top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_leaf(row, text):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(told(row[0]) + told(row[3]) + told(row[2]) + told(row[4]) + told(text))


def plain_manifest(rows):
    """Counter of op13's rows by the contract alone."""
    groups = collections.defaultdict(list)
    for r in rows:
        change = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if change else r[1]
        groups[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r, r[1]), plain_leaf(r, lower), r[0]))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in langs}
    top = plain_tree([trees[g][-1][0] for g in langs])
    out = collections.Counter()
    for which, g in enumerate(langs):
        for i, x in enumerate(sorted(groups[g])):
            h, proof = x[3], ""
            for levels, at in ((trees[g], i), (top, which)):
                for level in levels[:-1]:
                    run = at // 8 * 8
                    left, right = "".join(level[run:at]), "".join(level[at + 1 : run + 8])
                    proof, h, at = proof + left + right, sha(left + h + right), at // 8
            out[x[4], x[2], trees[g][-1][0], top[-1][0], sha(proof), h, h == top[-1][0]] += 1
    return out


def test_manifest_against_plain_trees(spark, docs, rows):
    got = merkle.op13_merkle(spark, "", docs)
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_manifest(rows)
    assert merkle.op13_merkle(spark, "", docs.limit(0)).count() == 0
    for some in (rows[:1], rows[:9], [r for r in rows if r[2] == "en"][:65], [(i, str(i), f"l{i:03}", "s", 1) for i in range(70)]):
        frame = spark.createDataFrame(some, DOCS.split(", at")[0])
        assert collections.Counter(tuple(r) for r in merkle.op13_merkle(spark, "", frame).collect()) == plain_manifest(some)


def test_proofs_of_some_leaves(spark, docs):
    made = merkle.manifest(docs, merkle.digest("doc_id", "text"), "lang", ["doc_id"], ("doc_id",))
    every = {(r.g, r["at"]): r for r in made.proofs().collect()}
    some = made.proofs(spark.createDataFrame([(5,), (5,), (130,), (-4,), (10**9,)], "doc_id long"), "doc_id").withColumn("root", merkle.folded(F.col("node"), F.col("pieces"))).collect()
    assert sorted(r.doc_id for r in some) == [-4, 5, 5, 5, 130]
    assert all(r.pieces == every[r.g, r["at"]].pieces and r.root == made.root for r in some)
    changed = made.proofs().withColumn("root", merkle.folded(F.sha2(F.lit("other"), 256), F.col("pieces")))
    assert changed.where(F.col("root") == made.root).count() == 0
    assert len(made.levels) == 2 and made.levels[1].count() < 10  # levels 0 and 3 alone are stored


def test_manifest_of_many_leaves(spark):
    rows = [(i, f"Text {i}", "en" if i % 10 else "de", "s", i) for i in range(4_700)]
    frame = spark.createDataFrame(rows, DOCS.split(", at")[0]).repartition(7)
    assert collections.Counter(tuple(r) for r in merkle.op13_merkle(spark, "", frame).collect()) == plain_manifest(rows)
