"""License scans with ordered signature rules.

A text becomes its lower-cased words; ``license_rules`` holds hundreds of expressions over them.  A
keyword prefilter looks up which rules can match at all: a rule is run only on texts that hold
all its required words.  All matches of those rules are detections with a span of words.  Overlaps are
resolved by priority and containment: a detection goes if its span lies within that of one of
higher priority, or within a longer one (or an earlier rule's equal one) of its own priority.  So
"GNU Lesser General Public License, version 2.1" is one detection, though six rules see a part of it.

The base phrases are rules too.  Their matches always count as places and their labels always stay;
``kept`` says whether the resolution keeps the span.

Every text is read whole, in the task that holds its row; there is no shuffle.

Defined cases: a null text is empty; a text without words has no detection, no labels and score 0; a null id
or a repeated row is scanned like any other; non-ASCII characters are parts of words; very long texts are scanned whole (a gap in a rule is
at most six words, so time grows with the length); an empty table gives no rows; of columns whose names clash with the result's,
``detect`` replaces ``n_words`` and ``detections`` and keeps all others.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tessera.llm.license_rules import Rule, rules
from tessera.session import ship_package

#: ASCII characters that are no letter or digit part words; A-Z are lower-cased.  Bytes of other characters stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

DETECTION = "struct<label:string,kind:string,priority:int,weight:double,first:long,last:long,kept:boolean>"


class Scanner:
    """Rules indexed by the words they need."""

    def __init__(self, table: tuple[Rule, ...] | None = None):
        self.rules = table or rules()
        self.by_word: dict[bytes, list[int]] = {}
        for i, rule in enumerate(self.rules):
            for word in min(rule.needs, key=len):
                self.by_word.setdefault(word, []).append(i)
        self.keywords = frozenset(self.by_word)

    def candidates(self, words: frozenset[bytes] | set[bytes]) -> list[int]:
        """The rules, in order, whose required words are all there."""
        found = {i for word in words & self.keywords for i in self.by_word[word]}
        return sorted(i for i in found if all(not words.isdisjoint(need) for need in self.rules[i].needs))

    def detections(self, raw: bytes) -> tuple[int, list[tuple[int, int, int, str]]]:
        """The number of words, and all matches: (rule, first word, last word, label)."""
        words = raw.translate(_WORDS).split()
        some = self.candidates(set(words))
        if not some:
            return len(words), []
        text = b" " + b" ".join(words) + b" "
        blanks = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
        found = []
        for i in some:
            rule = self.rules[i]
            for m in rule.pattern.finditer(text):
                first, after = np.searchsorted(blanks, (m.start(), m.end()))
                found.append((i, int(first), int(after) - 1, _label(rule, m)))
        return len(words), found

    def resolve(self, found: list[tuple[int, int, int, str]]) -> list[bool]:
        """Which detections stay: priority by priority, each against the spans kept above it, longer spans first."""
        keep = [False] * len(found)
        by_priority: dict[int, list[int]] = {}
        for at, (i, *_) in enumerate(found):
            by_priority.setdefault(self.rules[i].priority, []).append(at)
        spans: list[tuple[int, int]] = []  # kept spans of higher priority, by their start
        for priority in sorted(by_priority, reverse=True):
            starts = [s for s, _ in spans]
            reach = np.maximum.accumulate([e for _, e in spans]).tolist() if spans else []
            inner = -1
            for at in sorted(by_priority[priority], key=lambda at: (found[at][1], -found[at][2], found[at][0])):
                _, first, last, _ = found[at]
                above = bisect_right(starts, first)
                if last <= inner or above and reach[above - 1] >= last:
                    continue
                keep[at], inner = True, last
            spans = sorted(spans + [found[at][1:3] for at in by_priority[priority] if keep[at]])
        return keep

    def scan(self, raw: bytes) -> tuple[int, list[dict]]:
        n, found = self.detections(raw)
        out = []
        for (i, first, last, label), kept in zip(found, self.resolve(found)):
            rule = self.rules[i]
            out.append({"label": label, "kind": rule.kind, "priority": rule.priority, "weight": rule.weight, "first": first, "last": last, "kept": kept})
        return n, out


def _label(rule: Rule, m) -> str:
    if "{v}" not in rule.label:
        return rule.label
    version = m.groupdict().get("v")
    if version is None:
        return rule.label.replace("{v}", "")
    digits = version.decode().lstrip("v").replace(" ", ".")
    return rule.label.replace("{v}", "-" + (digits if "." in digits else digits + ".0"))


_SCANNER: Scanner | None = None


def _scanner() -> Scanner:
    global _SCANNER
    if _SCANNER is None:
        _SCANNER = Scanner()
    return _SCANNER


def _scan_column(text):
    kind = T._parse_datatype_string(f"struct<n_words:long,detections:array<{DETECTION}>>")

    @arrow_udf(kind)
    def scan(texts: pa.Array) -> pa.Array:
        scanner = _scanner()
        rows = [dict(zip(("n_words", "detections"), scanner.scan(raw or b""))) for raw in texts.cast(pa.binary()).to_pylist()]
        item = pa.struct([("label", pa.string()), ("kind", pa.string()), ("priority", pa.int32()), ("weight", pa.float64()), ("first", pa.int64()),
                          ("last", pa.int64()), ("kept", pa.bool_())])
        return pa.array(rows, type=pa.struct([("n_words", pa.int64()), ("detections", pa.list_(item))]))

    return scan(text)


def detect(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``n_words`` and ``detections``: every match with its span of words (``first`` to ``last``, from 0), in the order of the rules."""
    ship_package(documents.sparkSession)
    kept = [c for c in documents.columns if c.lower() not in ("n_words", "detections")]
    scanned = documents.select(*[F.col(f"`{c}`") for c in kept], _scan_column(F.col(f"`{text}`").cast("string")).alias("__scan"))
    return scanned.select(*[F.col(f"`{c}`") for c in kept], "__scan.n_words", "__scan.detections")


def labels_of(detections, base_only: bool = False):
    """The distinct labels, sorted: of the base phrases, and of the other detections that were kept."""
    which = F.filter(detections, lambda d: (d["kind"] == "base") if base_only else (d["kind"] == "base") | d["kept"])
    return F.array_sort(F.array_distinct(F.transform(which, lambda d: d["label"])))


def score_of(detections):
    """The probability that any license statement holds: one minus the product, over the labels, of one minus the best weight of each."""
    kept = F.filter(detections, lambda d: (d["kind"] == "base") | d["kept"])
    best = F.transform(F.array_distinct(F.transform(kept, lambda d: d["label"])), lambda name: F.array_max(
        F.transform(F.filter(kept, lambda d: d["label"] == name), lambda d: d["weight"])))
    return F.lit(1.0) - F.aggregate(best, F.lit(1.0), lambda p, w: p * (F.lit(1.0) - w))


def op13_license_rules(documents: DataFrame) -> DataFrame:
    base = F.filter("detections", lambda d: d["kind"] == "base")
    found = detect(documents.select("doc_id", "text")).withColumn("__base", base)
    starts = F.transform("__base", lambda d: d["first"])
    return found.select("doc_id", "n_words", F.size("__base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), F.array_join(labels_of(F.col("detections"), True), ",").alias("base_labels"),
                        F.array_join(labels_of(F.col("detections")), ",").alias("labels"), score_of(F.col("detections")).alias("score"))
