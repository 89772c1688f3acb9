"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole spans.

Text around digits and @ signs is cut into islands of tokens. A segmentation of an island gives every token to an
entity of at most MAX_TOKENS tokens or to none, and a segment's score is a weighted sum of features of the whole span:
its shape, its length, its separators, and the words beside it. The weights are fitted by the exact conditional
likelihood (forward and backward sums over segmentations) on the islands of a bounded sample, labelled by the fixed
patterns and by re-written copies of their matches that those patterns can't see. Decoding is a Viterbi search over
boundaries and types together. The spans of the fixed patterns always stay; the field adds those that overlap none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm._spans import Span, found
from lodegraph.llm.secrets import digests
from lodegraph.sources.tables import written

KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity at most; tokens an island takes in beside those with a digit or @.
MAX_TOKENS, MARGIN = 7, 1
#: Documents to fit on at most, drawn by a hash of id and text, islands among them, and tokens of one; longer ones are cut.
SAMPLE, ISLANDS, PIECE = 4_000, 3_000, 40
#: Weight in training of an island in which the patterns see nothing.
UNMARKED = 0.2
#: How much a segmentation with an added span must score above the best one without it.
MARGIN_SCORE = 0.5

# fixed values: the base patterns
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TOKEN = re.compile(r"[^\s|]+")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _card(m: re.Match) -> bool:
    digits = m.group().replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and luhn(digits)


def _ip(m: re.Match) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns."""
    spans = found(text, "email", EMAIL, lambda m: True) if "@" in text else []
    if not _TRIGGER.search(text):
        return spans
    spans += found(text, "ip", IP, _ip) if "." in text else []
    spans += found(text, "card", CARD, _card)
    return spans + (found(text, "phone", PHONE, lambda m: 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15) if "+" in text else [])


def islands(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens with a digit or @, with MARGIN tokens around, as (start, end) of the tokens without end punctuation."""
    if not _TRIGGER.search(text):
        return []
    runs: list[list[tuple[int, int]]] = []
    before: list[tuple[int, int]] = []
    quiet = MARGIN + 1
    for m in _TOKEN.finditer(text):
        word = m.group()
        start, end = m.start(), m.start() + len(word.rstrip(".,;:!?*$%#&\"'"))
        token = (start, max(end, start + 1))
        if _TRIGGER.search(word):
            if quiet > MARGIN:
                runs.append(before[-MARGIN:] if MARGIN else [])
            runs[-1].append(token)
            quiet = 0
        else:
            quiet += 1
            if quiet <= MARGIN:
                runs[-1].append(token)
        before.append(token)
        if len(before) > MARGIN:
            del before[0]
    return runs


def _bare(span: str) -> str:
    """The shape of a span: digit runs with their length, letter runs, other characters as they are."""
    return re.sub(r"\d+", lambda m: f"<{min(len(m.group()), 20)}>", re.sub(r"[^\W\d_]+", "a", span))


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the whole span of tokens i to j - 1."""
    start, end = tokens[i][0], tokens[j - 1][1]
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    left = text[max(0, start - 24) : start].split()[-1:] or [""]
    word = left[0].strip(".,;:!?").lower()
    return [
        "bias", f"tokens={j - i}", f"digits={min(digits, 20)}", f"shape={_bare(span)[:40]}", f"at={span.count('@')}", f"dots={min(span.count('.'), 4)}", f"edge={span[:1] if not span[:1].isalnum() else 'w'}",
        f"letters={any(c.isalpha() for c in span)}", f"joins={''.join(sorted(set(re.sub(r'[A-Za-z0-9]', '', span))))[:8]}", f"luhn={12 <= digits <= 19 and digits == len(re.sub(r'[ .-]', '', span)) and luhn(re.sub(r'[^0-9]', '', span))}",
        f"left={word if len(word) <= 8 and word.isalpha() and not digits == 0 else ''}",
    ]


def _segments(text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int], list[str]]:
    """Candidate spans: up to MAX_TOKENS tokens, the first and last of which hold a digit, @ or are short brackets' content."""
    fit = [bool(_TRIGGER.search(text[a:b])) for a, b in tokens]
    out = {}
    for i in range(len(tokens)):
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            if (fit[i] or fit[j - 1]) and "\n" not in text[tokens[i][0] : tokens[j - 1][1]]:
                out[i, j] = features(text, tokens, i, j)
    return out


def _scores(segments: dict, weights: dict[str, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Score of each kind for each candidate; tokens outside any entity score 0."""
    zero = np.zeros(len(KINDS))
    return {at: sum((weights.get(f, zero) for f in names), zero) for at, names in segments.items()}


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(sum(np.exp(v - top) for v in values)))


def _marginals(n: int, scores: dict) -> tuple[dict, float]:
    """Posterior of each candidate and kind, and the log partition, by forward and backward sums."""
    ends: dict[int, list] = {}
    starts: dict[int, list] = {}
    for (i, j), s in scores.items():
        ends.setdefault(j, []).append((i, s))
        starts.setdefault(i, []).append((j, s))
    ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = _log_sum([ahead[j - 1], *[ahead[i] + float(v) for i, s in ends.get(j, ()) for v in s]])
    for i in range(n - 1, -1, -1):
        back[i] = _log_sum([back[i + 1], *[back[j] + float(v) for j, s in starts.get(i, ()) for v in s]])
    return {(i, j): np.exp(ahead[i] + s + back[j] - ahead[n]) for (i, j), s in scores.items()}, ahead[n]


def decode(n: int, scores: dict) -> list[tuple[int, int, int]]:
    """The best segmentation's entities (first token, token after, kind), boundaries and types chosen together."""
    best, came = [0.0] * (n + 1), [None] * (n + 1)
    ends: dict[int, list] = {}
    for (i, j), s in scores.items():
        ends.setdefault(j, []).append((i, s))
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, s in ends.get(j, ()):
            k = int(np.argmax(s))
            if best[i] + s[k] - MARGIN_SCORE > best[j]:
                best[j], came[j] = best[i] + float(s[k]) - MARGIN_SCORE, (i, j, k)
    out, j = [], n
    while j:
        if came[j] is None:
            j -= 1
        else:
            out.append(came[j])
            j = came[j][0]
    return out[::-1]


def rewritten(kind: str, span: str, seed: int) -> str:
    """The same datum in a spelling that the fixed patterns can't see; what people do with spaces, dots and brackets."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "email":
        name, _, host = span.partition("@")
        return [f"{name}@{host.rpartition('.')[0].replace('.', '-')}", f"{name} @ {host}", f"{name}(@){host}"][seed % 3]
    if kind == "ip":
        return [span.replace(".", "-"), span.replace(".", " . "), span.replace(".", "[.]")][seed % 3]
    if kind == "card":
        return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "/".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "_".join(digits[i : i + 4] for i in range(0, len(digits), 4))][seed % 3]
    return [f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"00{digits[:-10]} {digits[-10:-7]} {digits[-7:-4]} {digits[-4:]}"][seed % 3]


def _examples(text: str, rewrite: bool) -> Iterator[tuple[str, list[tuple[int, int]], dict]]:
    """(text, tokens, gold: kind of each candidate that is an entity) of each island."""
    spans = sorted(base_spans(text))
    if rewrite and not spans:
        return
    if rewrite:
        pieces, at, moved = [], 0, []
        for n, (start, end, kind) in enumerate(spans):
            if start < at:
                continue
            pieces.append(text[at:start])
            new = rewritten(kind, text[start:end], n + len(text))
            here = sum(map(len, pieces))
            pieces.append(new)
            moved.append((here, here + len(new), kind))
            at = end
        text, spans = "".join([*pieces, text[at:]]), moved
    for tokens in (island[i : i + PIECE] for island in islands(text) for i in range(0, len(island), PIECE)):
        gold = {}
        for start, end, kind in spans:
            inside = [t for t, (a, b) in enumerate(tokens) if a < end and start < b]
            if inside and tokens[inside[0]][0] <= start and len(inside) <= MAX_TOKENS:
                gold[inside[0], inside[-1] + 1] = KINDS.index(kind)
        yield text, tokens, gold


def fit(docs: DataFrame, ident: str, text: str) -> dict[str, np.ndarray]:
    """Feature weights from SAMPLE documents with a digit or @ at most; without any there are none and nothing is added."""
    key = F.xxhash64(F.lit(47), F.col(ident).cast("string"), F.col(text))  # null ids too differ by their text
    sample = docs.where(F.col(text).rlike("[0-9@]")).select(key.alias("k"), text)
    chosen = written(sample.select("k").distinct().orderBy("k").limit(SAMPLE), 1)
    sample = sample.join(F.broadcast(chosen), "k").dropDuplicates(["k"])  # SAMPLE bounds both

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, whole in zip(batch.column("k").to_pylist(), batch.column(text).to_pylist(), strict=True):
                for rewrite in (False, True):
                    for n, (changed, tokens, gold) in enumerate(_examples(whole or "", rewrite)):
                        segments = _segments(changed, tokens)
                        if segments:
                            rows.append({"k": k ^ (n << 1 | rewrite), "n": len(tokens), "i": [a for a, _ in segments], "j": [b for _, b in segments], "gold": [gold.get(at, -1) for at in segments], "names": list(segments.values())})
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    shape = pa.schema([("k", pa.int64()), ("n", pa.int32()), ("i", pa.list_(pa.int32())), ("j", pa.list_(pa.int32())), ("gold", pa.list_(pa.int32())), ("names", pa.list_(pa.list_(pa.string())))])
    made = sample.mapInArrow(examples, "k long, n int, i array<int>, j array<int>, gold array<int>, names array<array<string>>")
    rows = made.orderBy("k").limit(ISLANDS).toArrow().to_pylist()
    return train([(r["n"], {(i, j): names for i, j, names in zip(r["i"], r["j"], r["names"], strict=True)}, {(i, j): g for i, j, g in zip(r["i"], r["j"], r["gold"], strict=True) if g >= 0}) for r in rows])


def train(examples: list[tuple[int, dict, dict]], rounds: int = 12, rate: float = 0.1, ridge: float = 1e-3, least: int = 2) -> dict[str, np.ndarray]:
    """Weights that maximise the conditional likelihood of the gold segmentations, by AdaGrad over the islands.

    An island without an entity may hold one that the patterns don't see, so it counts UNMARKED of one with.
    """
    counts = Counter(f for _, segments, _ in examples for names in segments.values() for f in names)
    weights = {f: np.zeros(len(KINDS)) for f, c in counts.items() if c >= least}
    square = {f: np.full(len(KINDS), 1e-6) for f in weights}
    for _ in range(rounds if weights else 0):
        for n, segments, gold in examples:
            posterior, _ = _marginals(n, _scores(segments, weights))
            share = 1.0 if gold else UNMARKED
            slope: dict[str, np.ndarray] = {}
            for at, names in segments.items():
                step = -posterior[at]
                if at in gold:
                    step = step.copy()
                    step[gold[at]] += 1.0
                if np.abs(step).max() < 1e-4:
                    continue
                for f in names:
                    if f in weights:
                        slope[f] = slope.get(f, 0.0) + share * step
            for f, g in slope.items():
                g = g - ridge * weights[f]
                square[f] += g * g
                weights[f] = weights[f] + rate * g / np.sqrt(square[f])
    return {f: w for f, w in weights.items() if np.abs(w).max() > 1e-3}


def added_spans(text: str, base: list[Span], weights: dict[str, np.ndarray]) -> list[tuple[int, int, str, float]]:
    """Entities of the field's best segmentations that overlap no base span, with the posterior of each."""
    spans = []
    for tokens in islands(text) if weights else ():
        if all(any(s <= a and b <= e for s, e, _ in base) for a, b in tokens if _TRIGGER.search(text[a:b])):
            continue  # every token that could start an entity lies in a base span
        segments = {(i, j): names for (i, j), names in _segments(text, tokens).items() if not any(s < tokens[j - 1][1] and tokens[i][0] < e for s, e, _ in base)}
        scores = _scores(segments, weights)
        if best := decode(len(tokens), scores):
            posterior, _ = _marginals(len(tokens), scores)
            spans += [(tokens[i][0], tokens[j - 1][1], KINDS[k], float(posterior[i, j][k])) for i, j, k in best]
    return spans


def find(docs: DataFrame, ident: str, text: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """(ident, spans: array of start, end, kind, value, base), one row a document; null texts have none."""
    schema = docs.select(ident).schema.simpleString()[7:-1] + ", spans array<struct<start:int,end:int,kind:string,value:string,base:boolean,posterior:double>>"

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("base", pa.bool_()), ("posterior", pa.float64())]))
        for batch in batches:
            rows = []
            for value in batch.column(text):
                whole = value.as_py() or ""
                base = base_spans(whole)
                every = [(*s, True, 1.0) for s in base] + [(*s[:3], False, s[3]) for s in added_spans(whole, base, weights)]
                rows.append([{"start": a, "end": b, "kind": k, "value": whole[a:b], "base": own, "posterior": p} for a, b, k, own, p in sorted(every)])
            yield pa.RecordBatch.from_arrays([batch.column(ident), pa.array(rows, type=kind)], names=[ident, "spans"])

    return docs.select(ident, text).mapInArrow(scanned, schema)


def op6_pii(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Counts and digests of the personal data in all documents.

    Null texts count as empty and give zero counts, the digest of the empty text and empty spans; repeated rows are rows
    of their own; an empty table gives no rows; of segmentations that tie, the one that ends sooner stays; further columns
    are ignored. n_* and base_sha256 are of the fixed patterns; spans also has what the field adds, and posteriors the
    field's certainty of each of spans (1 for those of the patterns), joined likewise.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    spans = find(docs, "doc_id", "text", fit(docs, "doc_id", "text")).withColumnRenamed("spans", "found")
    return digests(spans, "found", KINDS, KINDS, ("posterior", "posteriors"), flag="base")
