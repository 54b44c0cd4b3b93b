"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Three base kinds are found by pattern. The method adds a fourth, `entropy`:
candidate strings are runs of token characters; a window slides along each
run and keeps, per character class, the counts from which its Shannon
entropy follows; moving the window changes two counts, so the sum of
c*log2(c) is updated and not computed again. The classes are hexadecimal
digits, letters-and-digits, and the URL-safe alphabet, each with its own
window and threshold. Windows at or over a threshold that also mix digits
with letters, or whose neighbouring characters change kind often enough,
are joined into spans. An allow-list suppresses spans whose run is a known
harmless form (UUIDs, dotted versions, paths of plain words, data of one
repeated unit). Base spans are never removed; an entropy span that lies
inside a base span adds nothing and is left out.

Defined results: a null or empty text has no spans; repeated rows are
scanned row by row; columns besides the id and the text are ignored; an
empty table gives an empty result. Positions are code points, end
exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import annotate, free_name, slices, texts

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
# a run is matched whole, so a least length in the pattern drops the same matches as a later test
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6

#: Per class: characters, window, least entropy in bits per character over the whole window.
CLASSES = {"hex": (frozenset("0123456789abcdefABCDEF"), 24, 3.0), "base64": (frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/"), 20, 3.7)}
#: Both base64 alphabets; a window mixes by its changes of kind, whatever its number of digits.
URL_SAFE = (CLASSES["base64"][0] | frozenset("-_"), 20, 3.7)
#: Least changes of kind between neighbours in a window of URL_SAFE. A word's capital (Name) and closing number (name2-) are no changes.
MIN_CHANGES = 3
_CHANGE = re.compile(r"(?<=l)u(?!l)|(?<=[lu])d(?!d*(?:-|$))|(?<=d)[lu]")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Least digits and letters in a window that counts as mixed.
MIN_DIGITS, MIN_LETTERS = 3, 3
#: Harmless forms of a whole run (fixed values).
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[-_/=](?:[A-Za-z]+|[0-9]+))*"),
    re.compile(r"(.{1,8}?)\1{2,}"),
)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the three fixed kinds, leftmost non-overlapping per kind; a failing match is used up and dropped."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _changes(run: str) -> list[int]:
    """1 at each letter or digit that differs in kind (small, capital, digit) from the one before it, other than by a word's capital or closing number."""
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "-" for c in run)
    out = [0] * len(run)
    for m in _CHANGE.finditer(kinds):
        out[m.start()] = 1
    return out


def entropy_windows(run: str, members: frozenset[str], width: int, least: float, min_changes: int | None = None) -> list[tuple[int, int]]:
    """Joined windows of a run whose entropy over the class reaches the threshold; counts move by one character.

    A window mixes by its digits and letters, or with min_changes by its changes of kind.
    """
    if len(run) < width:
        return []
    changes = _changes(run) if min_changes is not None else []
    changed = 0
    counts: dict[str, int] = {}
    digits = letters = inside = 0
    weighted = 0.0  # the sum of c * log2(c) over the window
    xlog = [0.0, *(c * math.log2(c) for c in range(1, width + 1))]
    found: list[tuple[int, int]] = []
    for i, char in enumerate(run):
        for c, step in ((char, 1), (run[i - width] if i >= width else "", -1)):
            if c and c in members:
                before = counts.get(c, 0)
                counts[c] = before + step
                weighted += xlog[before + step] - xlog[before]
                inside += step
                digits += step * c.isdigit()
                letters += step * c.isalpha()
        if min_changes is None:
            mixed = digits >= MIN_DIGITS and letters >= MIN_LETTERS
        else:
            # the change into the window's first character is not inside it
            changed += changes[i] - (changes[i - width + 1] if i >= width - 1 else 0)
            mixed = changed >= min_changes
        if i >= width - 1 and inside == width and mixed:
            if math.log2(width) - weighted / width >= least - 1e-9:
                start = i - width + 1
                if found and start <= found[-1][1]:
                    found[-1] = (found[-1][0], i + 1)
                else:
                    found.append((start, i + 1))
    return found


def entropy_spans(text: str, known: list[Span]) -> list[Span]:
    out: list[Span] = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if not any(c.isdigit() for c in run) or any(p.fullmatch(run) for p in ALLOWED):
            continue
        windows = sorted([w for spec in CLASSES.values() for w in entropy_windows(run, *spec)] + entropy_windows(run, *URL_SAFE, MIN_CHANGES))
        joined: list[list[int]] = []
        for start, end in windows:
            if joined and start <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], end)
            else:
                joined.append([start, end])
        for start, end in joined:
            start, end = start + m.start(), end + m.start()
            if not any(s <= start and end <= e for _, s, e in known):
                out.append(("entropy", start, end))
    return out


def joined_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text."""
    base = base_spans(text)
    return base, base + entropy_spans(text, base)


def redacted(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones joined, replaced by the mask."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda x: x[1:]):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy; with redact also the masked text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            whole = texts(batch)
            found = [scan(t) for t in whole]
            counts = [[sum(k == kind_ for k, _, _ in spans) for _, spans in found] for kind_ in KINDS]
            arrays = [
                batch.column(0),
                *(pa.array(c, pa.int64()) for c in counts[:3]),
                pa.array([hashlib.sha256(joined_spans(base).encode()).hexdigest() for base, _ in found]),
                pa.array([joined_spans(spans) for _, spans in found]),
                pa.array(counts[3], pa.int64()),
            ]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]
            if redact:
                arrays.append(pa.array([redacted(t, spans) for t, (_, spans) in zip(whole, found)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long" + ", redacted string" * redact
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def without_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows and columns of docs with every found secret masked in the text."""
    name = free_name(docs, "_masked")
    masked = annotate(docs, lambda: lambda whole: [pa.array([redacted(t, scan(t)[1]) for t in whole], pa.string())], [T.StructField(name, T.StringType())], text_col)
    return masked.select(*(F.col(name).alias(c) if c == text_col else c for c in docs.columns))
