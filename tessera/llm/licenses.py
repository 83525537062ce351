"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

A text's words (A-Z lowered) are joined by single spaces. One automaton looks for all keywords of all rules in a block of
texts; a rule's pattern is only matched on texts that hold all of its keywords. Every match of a pattern is a detection
over a stretch of words. A detection is suppressed if its stretch lies inside that of one of higher priority, or of the
same priority if that one is longer or, over the same stretch, of an earlier rule; partly overlapping ones both stay. The
base phrases take part with the least priority, but their labels and places are reported whatever suppresses them.

The score is the chance that some label is right, 1 - product(1 - confidence) over the labels that stay, each with the
confidence of its best kind.

Documents are independent, so the job is one pass without a shuffle; texts of any length are read whole, in slices.

Defined cases: null, empty and blank texts have no words, no labels and a score of 0; rows without doc_id are treated like others; repeated
rows each get their row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrowtext as at
from tessera.llm.license_rules import BASE, FRAGMENTS, KINDS, RULES

SLICE = 1 << 22
SPACE, BREAK = 0x20, 0x0A
#: Words hold digits, lower-case letters and bytes from 0x80 on; A-Z become a-z, all else a space.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else SPACE for b in range(256))
FOUND = "array<struct<label: string, kind: string, first: bigint, last: bigint>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, found {FOUND}"


class Rule:
    """One signature: label, kind, the keywords that any match holds, and the compiled pattern."""

    def __init__(self, label: str, kind: str, keywords: list[str], pattern: str):
        self.label, self.kind = label, kind
        self.priority, self.confidence = KINDS[kind]
        self.keywords = [k.encode() for k in keywords]
        if "<under>" in pattern:
            self.keywords.append(b"under ")
        for _ in range(2):  # fragments may hold others
            for name, part in FRAGMENTS.items():
                pattern = pattern.replace(name, part)
        self.source = pattern
        self.pattern = re.compile(rb"(?<![^ \n])(?:" + pattern.encode() + rb")(?![^ \n])")


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """All rules, in order; the base phrases come last."""
    out = []
    for line in RULES.strip().splitlines():
        label, kind, keywords, pattern = (x.strip() for x in line.split(" | ", 3))
        out.append(Rule(label, kind, [k.strip() for k in keywords.split(",")], pattern))
    return out + [Rule(label, "phrase", [phrase], phrase) for phrase, label in BASE.items()]


@lru_cache(maxsize=1)
def _prefilter() -> tuple[ahocorasick.Automaton, list[bytes], list[set[int]]]:
    """The automaton, its keywords, and for each rule the keywords that it needs."""
    keywords = sorted({k for r in rules() for k in r.keywords})
    number = {k: i for i, k in enumerate(keywords)}
    machine = ahocorasick.Automaton()
    for k, i in number.items():
        machine.add_word(k.decode("latin-1"), i)
    machine.make_automaton()
    return machine, keywords, [{number[k] for k in r.keywords} for r in rules()]


def normalised(buf: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' words, one space between words and a line break after each text; where each text begins (one more at
    the end), and where each word begins."""
    table, pieces, starts, bounds, size = np.frombuffer(TABLE, np.uint8), [], [], [0], 0
    for begin, end in zip(off[:-1], off[1:], strict=True):
        last = BREAK
        for a in range(begin, end, SLICE):
            part = table[buf[a : min(a + SLICE, end)]]
            before = np.append(np.uint8(last), part[:-1])
            parted = (before == SPACE) | (before == BREAK)
            blank = part == SPACE
            keep = ~(blank & parted)
            place = np.cumsum(keep) - 1
            starts.append(size + place[~blank & parted])
            last = part[-1]
            pieces.append(part[keep].tobytes())
            size += len(pieces[-1])
        pieces.append(b"\n")
        size += 1
        bounds.append(size)
    return b"".join(pieces), np.array(bounds), np.concatenate(starts) if starts else np.zeros(0, np.int64)


def gated(text: bytes, bounds: np.ndarray) -> dict[int, list[int]]:
    """For each text that holds all keywords of some rule, those rules."""
    machine, keywords, needs = _prefilter()
    reach = max(map(len, keywords)) - 1
    held: dict[int, set[int]] = defaultdict(set)
    for a in range(0, len(text), SLICE):
        begin = max(0, a - reach)
        hits = list(machine.iter(text[begin : a + SLICE].decode("latin-1")))
        if hits:
            ends, which = np.array(hits).T
            owner = np.searchsorted(bounds, ends + begin, side="right") - 1
            for doc, k in set(zip(owner.tolist(), which.tolist(), strict=True)):
                held[doc].add(k)
    return {doc: found for doc, got in held.items() if (found := [r for r, need in enumerate(needs) if need <= got])}


def unsuppressed(first: np.ndarray, last: np.ndarray, priority: np.ndarray, rule: np.ndarray) -> np.ndarray:
    """Indices of the detections that stay, in the order of their stretches."""
    kept = np.zeros(0, np.int64)
    for level in np.unique(priority)[::-1]:
        mine = np.flatnonzero(priority == level)
        mine = mine[np.lexsort((rule[mine], -last[mine], first[mine]))]
        before = np.concatenate([[-1], np.maximum.accumulate(last[mine])[:-1]])
        mine = mine[before < last[mine]]
        if len(kept):
            upto = np.maximum.accumulate(last[kept])
            at_ = np.searchsorted(first[kept], first[mine], side="right") - 1
            mine = mine[(at_ < 0) | (upto[np.maximum(at_, 0)] < last[mine])]
        kept = np.concatenate([kept, mine])
        kept = kept[np.argsort(first[kept], kind="stable")]
    return kept


def _scanned(text: bytes, begin: int, end: int, allowed: list[int], starts: np.ndarray) -> tuple:
    """n_base, first_word, last_word, base labels, labels, score and detections of one text that may hold some."""
    book = rules()
    hits = [(m.start(), m.end(), r) for r in allowed for m in book[r].pattern.finditer(text, begin, end)]
    if not hits:
        return 0, None, None, [], [], 0.0, []
    spans = np.array(hits)
    base_word = np.searchsorted(starts, begin)
    first = np.searchsorted(starts, spans[:, 0]) - base_word
    last = np.searchsorted(starts, spans[:, 1]) - 1 - base_word
    rule = spans[:, 2]
    base = rule >= len(book) - len(BASE)
    stays = unsuppressed(first, last, np.array([book[r].priority for r in rule]), rule)
    found = [(book[rule[k]].label, book[rule[k]].kind, int(first[k]), int(last[k])) for k in stays]
    sure: dict[str, float] = {}
    for label, kind, _, _ in found:
        sure[label] = max(sure.get(label, 0.0), KINDS[kind][1])
    score = 1 - float(np.prod([1 - sure[label] for label in sorted(sure)]))
    base_labels = {book[r].label for r in rule[base]}
    places = first[base]
    ends = (int(places.min()), int(places.max())) if len(places) else (None, None)
    return len(places), *ends, sorted(base_labels), sorted(base_labels | set(sure)), score, found


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word (of the base phrases' places), base_labels,
    labels, score, found (the detections that stay: label, kind, first and last word)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in at.blocks(batches):
            text, bounds, starts = normalised(buf, off)
            words = np.diff(np.searchsorted(starts, bounds))
            allowed = gated(text, bounds)
            out = [_scanned(text, int(bounds[k]), int(bounds[k + 1]), allowed[k], starts) if k in allowed else (0, None, None, [], [], 0.0, []) for k in range(len(off) - 1)]
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 3 + [pa.list_(pa.string())] * 2 + [pa.float64()]
            struct = pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
            found = pa.array([[dict(zip(("label", "kind", "first", "last"), d, strict=True)) for d in f] for f in columns[6]], pa.list_(struct))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words.astype(np.int64)), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], found], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)
