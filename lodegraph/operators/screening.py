"""Screening texts: personal data with claimed spans, attempts to steer a model, and CSV fields."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WAYS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Way|Place|Pl"
# fixed values: classes of personal data in the order in which they claim text: name, pattern, whether case counts,
# replacement, category, severity, and a pattern that the text must have somewhere
PERSONAL = (
    ("creditCard", r"\b(?:\d{4}[-.\s]?){3}\d{4}\b", True, "[CREDIT CARD REDACTED]", "financial", "critical", None),
    ("ssn", r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b", True, "[SSN REDACTED]", "government_id", "critical", None),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", False, "[EMAIL REDACTED]", "contact", "medium", None),
    ("phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", True, "[PHONE REDACTED]", "contact", "medium", None),
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", True, "[IP ADDRESS REDACTED]", "technical", "low", None),
    ("dateOfBirth", r"\b(?:DOB|Date of Birth|Born|Birthday)[\s:]*\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b", False, "[DOB REDACTED]", "personal", "high", None),
    ("passport", r"\b(?:passport[\s#:]*)?[A-Z]{1,2}\d{6,9}\b", False, "[PASSPORT REDACTED]", "government_id", "critical", None),
    ("driversLicense", r"\b(?:DL|Driver'?s?\s*License)[\s#:]*[A-Z0-9]{5,15}\b", False, "[DRIVERS LICENSE REDACTED]", "government_id", "high", None),
    ("bankAccount", r"\b(?:account|acct)[\s#:]*\d{8,17}\b", False, "[BANK ACCOUNT REDACTED]", "financial", "critical", None),
    ("medicareId", r"\b\d{3}-?\d{2}-?\d{4}-?[A-Z]\b", True, "[MEDICARE ID REDACTED]", "healthcare", "high", None),
    ("streetAddress", rf"\b\d+\s+[A-Za-z]+(?:\s+[A-Za-z]+)*\s+(?:{_WAYS})\b\.?", False, "[ADDRESS REDACTED]", "contact", "medium", None),
    ("zipCode", r"\b\d{5}(?:-\d{4})?\b", True, "[ZIP REDACTED]", "contact", "low", r"zip|postal|code|address"),
)
LEVELS = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def _compiled(pattern: str, case: bool) -> re.Pattern:
    """pattern with \\s for all white space, in and out of brackets, while letters, digits and word ends are those of ASCII."""
    inner = re.sub(r"(\[[^\]]*)\\s([^\]]*\])", lambda m: m.group(1) + _SPACES + m.group(2), pattern)
    return re.compile(re.sub(r"\\s(?=[+*])", lambda m: f"[{_SPACES}]", inner), re.ASCII | (0 if case else re.IGNORECASE))


_CLASSES = tuple((name, _compiled(p, case), *rest[:-1], re.compile(rest[-1], re.IGNORECASE) if rest[-1] else None) for name, p, case, *rest in PERSONAL)


def claimed(text: str | None, least: str = "low", categories: tuple[str, ...] | None = None, custom: tuple[tuple, ...] = ()) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, class, category, severity, replacement): spans of personal data, each claimed by the first class that matches.

    A match that overlaps a span that is claimed already counts for nothing. custom classes (name, pattern, replacement,
    category, severity) come last. Places are code points.
    """
    spans: list[tuple[int, int, str, str, str, str]] = []
    own = tuple((name, re.compile(p), replacement, category, severity, None) for name, p, replacement, category, severity in custom)
    for name, pattern, replacement, category, severity, context in _CLASSES + own:
        if not text or LEVELS[severity] < LEVELS[least] or (categories and category not in categories) or (context and not context.search(text)):
            continue
        for m in pattern.finditer(text):
            if not any(m.start() < end and m.end() > start for start, end, *_ in spans):
                spans.append((m.start(), m.end(), name, category, severity, replacement))
    return sorted(spans)


def cleaned(text: str | None, spans: list[tuple], keep_length: bool = False) -> str | None:
    """text with its spans replaced; keep_length fills with * or cuts the replacement to the length of the span."""
    out, at = [], 0
    for start, end, *_, replacement in spans:
        mark = replacement[: end - start].ljust(end - start, "*") if keep_length else replacement
        out += [text[at:start], mark]
        at = end
    return text if text is None else "".join([*out, text[at:]])


def redacted(rows: DataFrame, ident: str, text: str, least: str = "low", categories: tuple[str, ...] | None = None, custom: tuple[tuple, ...] = (), keep_length: bool = False, audit: bool = False) -> DataFrame:
    """(ident, clean, spans): every text without its personal data, and what was found; audit leaves texts as they are."""
    schema = f"{ident} {dict(rows.dtypes)[ident]}, clean string, spans array<struct<class:string,category:string,severity:string,position:int,length:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("class", pa.string()), ("category", pa.string()), ("severity", pa.string()), ("position", pa.int32()), ("length", pa.int32())]))
        for batch in batches:
            texts = batch.column(text).to_pylist()
            spans = [claimed(t, least, categories, custom) for t in texts]
            clean = [t if audit else cleaned(t, s, keep_length) for t, s in zip(texts, spans, strict=True)]
            found = [[{"class": n, "category": c, "severity": v, "position": a, "length": b - a} for a, b, n, c, v, _ in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(ident), pa.array(clean, type=pa.string()), pa.array(found, type=kind)], names=[ident, "clean", "spans"])

    return rows.select(ident, text).mapInArrow(run, schema)


def redacted_fields(rows: DataFrame, column: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """rows with the texts inside a nested column redacted, at any depth, in the named fields only if any are named."""
    kind = rows.schema[column].dataType

    def walk(value, inside: bool):
        if isinstance(value, str):
            return cleaned(value, claimed(value)) if inside else value
        if isinstance(value, list):
            return [walk(x, inside) for x in value]
        if isinstance(value, dict):
            return {k: walk(x, fields is None or k in fields) for k, x in value.items()}
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            changed = pa.array([walk(v, fields is None) for v in batch.column(at).to_pylist()], type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([changed if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema) if kind is not None else rows


# fixed values: families of phrases by which a text tries to steer a model, and how severe they are
ATTACKS = {
    "instructionOverride": ("high", (
        r"ignore\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|rules?|guidelines?)",
        r"disregard\s+(?:all\s+)?(?:your\s+)?(?:previous|prior|above|earlier)?\s*(?:instructions?|prompts?|rules?|guidelines?)",
        r"forget\s+(?:all\s+)?(?:everything\s+)?(?:you\s+were\s+told|previous|prior|above|earlier|your)\s*(?:instructions?|prompts?|context|before)?",
        r"override\s+(?:all\s+)?(?:your\s+)?(?:previous|prior|system)?\s*(?:instructions?|prompts?|rules?)",
        r"do\s+not\s+follow\s+(?:your\s+)?(?:the\s+)?(?:previous\s+)?(?:instructions?|rules?|guidelines?)",
        r"stop\s+being\s+(?:an?\s+)?(?:assistant|AI|helpful)",
    )),
    "systemPromptExtraction": ("high", (
        r"what\s+(?:are|is)\s+(?:your|the)\s+system\s+(?:prompt|instructions?|rules?)", r"show\s+me\s+(?:your|the)\s+system\s+(?:prompt|instructions?|message)",
        r"reveal\s+(?:your|the)\s+(?:system|hidden|secret)\s+(?:prompt|instructions?)", r"repeat\s+(?:your|the)\s+(?:system|initial|original)\s+(?:prompt|instructions?|message)",
        r"print\s+(?:your|the)\s+system\s+(?:prompt|instructions?|message)", r"output\s+(?:your|the)\s+(?:system|initial)\s+(?:prompt|instructions?)",
        r"tell\s+me\s+your\s+(?:system\s+)?(?:prompt|instructions?|rules?)", r"what\s+were\s+you\s+(?:told|instructed|programmed)\s+to\s+do",
    )),
    "rolePlayManipulation": ("medium", (
        r"you\s+are\s+now\s+(?:a|an)\s+\w+", r"pretend\s+(?:you\s+are|to\s+be)\s+(?:a|an)\s+", r"act\s+as\s+(?:if\s+you\s+(?:are|were)\s+)?(?:a|an)\s+", r"roleplay\s+as\s+(?:a|an)\s+",
        r"assume\s+the\s+(?:role|identity|persona)\s+of", r"from\s+now\s+on\s+you\s+(?:are|will\s+be)", r"switch\s+(?:to|into)\s+(?:a|an)\s+(?:different|new)\s+(?:mode|persona|role)",
    )),
    "delimiterInjection": ("medium", (r"```\s*system", r"\[\s*system\s*\]", r"</?system>", r"###\s*SYSTEM", r"---\s*system\s*---", r"\|\|\s*system\s*\|\|", r"={3,}\s*system\s*={3,}")),
    "codeExecution": ("critical", (
        r"execute\s+(?:the\s+following\s+)?(?:code|script|command)", r"run\s+(?:this|the\s+following)\s+(?:code|script|command)", r"\beval\s*\(", r"\bexec\s*\(", r"\bsystem\s*\([^)]*\)",
        r"\bsubprocess\b", r"\bos\.system\b", r"\bchild_process\b", r"__import__",
    )),
    "dataExfiltration": ("high", (
        r"send\s+(?:this|the)\s+(?:data|information|content)\s+to", r"upload\s+(?:this|the)\s+(?:data|content)\s+to", r"fetch\s+from\s+https?://", r"make\s+(?:a|an)\s+(?:http|api)\s+(?:request|call)\s+to",
        r"\bcurl\s+https?://", r"\bwget\s+https?://", r"\bexfiltrate\b",
    )),
    "jailbreakPhrases": ("high", (
        r"\bDAN\s+mode\b", r"\bDeveloper\s+Mode\b", r"\bjailbreak\b", r"bypass\s+(?:the\s+)?(?:safety|security|content|ethical)\s+(?:filters?|measures?|restrictions?)",
        r"disable\s+(?:your|the)\s+(?:safety|security|content)\s+(?:filters?|measures?)", r"remove\s+(?:your|the)\s+(?:restrictions?|limitations?|guardrails?)",
        r"without\s+(?:any\s+)?(?:restrictions?|limitations?|filters?)", r"\bunrestricted\s+mode\b",
    )),
    "promptLeaking": ("medium", (r"complete\s+(?:this|the)\s+(?:sentence|prompt|instruction)", r"""continue\s+(?:from|with)\s+["'][^"']*system""", r"finish\s+(?:this|the)\s+(?:sentence|thought|prompt)", r"""what\s+comes\s+(?:after|before)\s+["']""", r"system\s+prompt\s+says")),
    "indirectInjection": ("medium", (r"\[AI:\s*ignore", r"<!--\s*instruction", r"IMPORTANT:\s*ignore\s+(?:the\s+)?(?:above|previous)", r"\[hidden\s+instruction\]", r"BEGIN\s+INJECTION", r"START\s+OVERRIDE")),
}
# fixed values: words that raise suspicion, by how much; and characters that do so when there are many: least count
HINTS = (
    (r"\bsystem\s+prompt\b", 0.3), (r"\bprevious\s+instructions?\b", 0.2), (r"\bignore\b", 0.15), (r"\boverride\b", 0.2), (r"\bdisregard\b", 0.2), (r"\bforget\b", 0.1), (r"\bpretend\b", 0.15), (r"\broleplay\b", 0.1),
    (r"\bjailbreak\b", 0.5), (r"\bbypass\b", 0.2), (r"\bunrestricted\b", 0.2), (r"\bhack\b", 0.1), (r"\bexploit\b", 0.15), (r"you\s+are\s+now\b", 0.25), (r"act\s+as\s+(if|a|an)\b", 0.15), (r"from\s+now\s+on\b", 0.2),
    (r"new\s+(rules?|mode|persona)\b", 0.2),
)
COUNTED = ((r"```", 0.05, 3), (r"[<>{}\[\]]", 0.02, 10))
SEVERITIES = ("none", "low", "medium", "high", "critical")
ACTIONS = ("allow", "warn", "warn", "block", "block")
_HIDDEN = "[\u200b-\u200d\ufeff\u2060-\u2064]"


def _needed(pattern: str) -> str:
    """The longest run of letters, in lower case, that every match of pattern holds outside of its groups."""
    runs = [""]
    for kind, value in re._parser.parse(pattern):
        runs = [*runs[:-1], runs[-1] + chr(value)] if kind is re._constants.LITERAL else [*runs, ""]
    return max(runs, key=len).lower()


def _matches(text: Column, low: Column, pattern: str) -> Column:
    """Whether pattern is in text in either case: texts whose lower case doesn't hold what it needs aren't searched for it."""
    return low.contains(F.lit(_needed(pattern))) & text.rlike(f"(?i){pattern}")


def families(text: Column, low: Column | None = None) -> Column:
    """Names of the families that a text shows, in their order; none for null. low is the text in lower case, if there is a column of it."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text) if low is None else low
    return F.filter(F.array(*[F.when(reduce(Column.__or__, [_matches(text, low, p) for p in patterns]), F.lit(n)) for n, (_, patterns) in ATTACKS.items()]), lambda x: x.isNotNull())


def suspicion(text: Column, low: Column | None = None) -> Column:
    """The sum of the hints' weights, 1 at most; many brackets or code fences count up to twice. low as in families."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text) if low is None else low
    score = sum((F.when(_matches(text, low, p), w).otherwise(0.0) for p, w in HINTS), F.lit(0.0))
    for p, w, least in COUNTED:
        n = F.regexp_count(text, F.lit(p))
        score = score + F.when(n >= least, F.lit(w) * F.least(n / least, F.lit(2.0))).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(score, 9))


def structure(text: Column) -> Column:
    """What is odd about a text's shape: array of long, repetitive, hidden, encoded."""
    text = F.coalesce(text, F.lit(""))
    def repeats(words: Column) -> Column:
        """Whether a word stands more than 50 times and is over a fifth of all: in sorted words it then holds one of five places."""
        n = F.size(words)
        least = F.greatest(F.lit(51), (F.floor(n * 0.2) + 1).cast("int"))
        run = lambda s, w: F.get(s, (F.array_position(s, w) - 2).cast("int") + least) == w
        # arrays of one array bind what is sorted, so that it is sorted once
        held = lambda s: F.exists(F.array(*[F.get(s, i * least - 1) for i in range(1, 6)]), lambda w: F.coalesce(run(s, w), F.lit(False)))
        return F.when(n > 50, F.exists(F.array(F.sort_array(words)), held)).otherwise(False)

    often = F.exists(F.array(F.split(text, "\\s+")), repeats)
    tests = {"long": F.length(text) > 10_000, "repetitive": often, "hidden": text.rlike(_HIDDEN), "encoded": text.rlike("[A-Za-z0-9+/]{50,}={0,2}")}
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def severity(found: Column, score: Column, odd: Column, threshold: float = 0.5) -> Column:
    """The highest severity of the families, of a suspicion from the threshold on, and of the structure: 0 (none) to 4."""
    of = [F.when(F.array_contains(found, n), SEVERITIES.index(s)) for n, (s, _) in ATTACKS.items()]
    of.append(F.when(score >= threshold, F.when(score >= 0.8, 3).when(score >= 0.6, 2).otherwise(1)))
    of += [F.when(F.array_contains(odd, n), s) for n, s in (("long", 1), ("repetitive", 1), ("hidden", 2), ("encoded", 1))]
    return F.coalesce(F.greatest(*of), F.lit(0))


def level_name(level: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), level)


def action(level: Column) -> Column:
    """allow, warn or block."""
    return F.get(F.array(*[F.lit(a) for a in ACTIONS]), level)


def analysed(rows: DataFrame, text: str) -> DataFrame:
    """rows with families, suspicion, odd and level of each text."""
    rows = rows.withColumn("_low", F.lower(F.coalesce(text, F.lit(""))))
    seen = rows.withColumns({"families": families(F.col(text), F.col("_low")), "suspicion": suspicion(F.col(text), F.col("_low")), "odd": structure(F.col(text))}).drop("_low")
    return seen.withColumn("level", F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(severity(F.col("families"), F.col("suspicion"), F.col("odd"))))


def conversations(messages: DataFrame, conversation: str, turn: str, role: str, text: str, least: int = 3) -> DataFrame:
    """(conversation, level, crossed): the highest severity of its messages, and whether least or more user messages are worse together.

    The user messages of one conversation come together in one row.
    """
    single = analysed(messages, text).groupBy(conversation).agg(F.max("level").alias("single"), F.max(F.when(F.col(role) == "user", F.col("level"))).alias("user"))
    said = F.array_sort(F.collect_list(F.when(F.col(role) == "user", F.struct(turn, F.coalesce(text, F.lit("")).alias("said")))))
    joined = messages.groupBy(conversation).agg(said.alias("all")).where(F.size("all") >= least).select(conversation, F.array_join(F.transform("all", lambda m: m["said"]), " ").alias("joined"))
    both = analysed(joined, "joined").select(conversation, F.col("level").alias("together"))
    found = single.join(both, conversation, "left")
    crossed = F.coalesce((F.col("together") >= 3) & (F.col("together") > F.coalesce("user", F.lit(0))), F.lit(False))
    return found.select(conversation, F.when(crossed, F.greatest("single", F.lit(2))).otherwise(F.col("single")).alias("level"), crossed.alias("crossed"))


def sanitised(text: Column) -> Column:
    """text without fake delimiters (the first of each kind) and with phrases against earlier instructions filtered."""
    for p in ATTACKS["delimiterInjection"][1]:
        text = F.regexp_replace(text, f"(?is)^(.*?)(?:{p})", "$1[REMOVED]")
    for verb in ("ignore", "disregard", "forget"):
        text = F.regexp_replace(text, f"(?i){verb}\\s+(all\\s+)?(previous|prior)", "[instruction filtered]")
    text = F.regexp_replace(F.regexp_replace(text, "(?i)```system", "```[system]"), "(?i)\\[system\\]", "[[system]]")
    return F.regexp_replace(text, "(?i)<system>", "<[system]>")


def csv_field(value: Column) -> Column:
    """A CSV field: quoted, quotes doubled, where it has a comma, quote or line break; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_row(columns: list[Column]) -> Column:
    """Fields in order, joined by commas; structs and maps as JSON."""
    return F.concat_ws(",", *[csv_field(c) for c in columns])


