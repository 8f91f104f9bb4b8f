"""Licence scans with ordered signature rules.

Texts pass two filters. One Aho-Corasick pass looks for a few stems, one of
which every rule's keywords hold; most texts end there. In the others a second
pass finds the keywords, whatever white space or comment marks part their words,
and only their rules' regexes are tried. Overlapping matches are then resolved: a
match is dropped if a match of a higher priority, or a longer one of the same,
contains it; and if it contains one of a higher priority. Among equal intervals
of one priority the earlier rule stays.

Defined results. NULL and empty texts have no detections. Repeated rows give
their detections each time, a NULL doc_id stays NULL. Offsets are in characters
of the whole text. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import arrow_safe, read
from .license_rules import PRIORITY, RULES


@dataclass(frozen=True)
class Rule:
    number: int
    license: str
    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern

    @property
    def priority(self) -> int:
        return PRIORITY[self.kind]


_GAP = r"[\s*#/]+"
_GAPS = re.compile(_GAP)


def _compiled(text: str) -> re.Pattern:
    text = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(" ", r"\s"), text)
    return re.compile(text.replace(" ?", f"(?:{_GAP})?").replace(" ", _GAP), re.IGNORECASE | re.DOTALL)


@functools.cache
def rules() -> tuple[Rule, ...]:
    out = []
    for line in filter(None, map(str.strip, RULES.splitlines())):
        license, kind, keywords, pattern = (x.strip() for x in line.split(" | ", 3))
        out.append(Rule(len(out), license, kind, tuple(k.strip() for k in keywords.split(",")), _compiled(pattern)))
    return tuple(out)


@functools.cache
def stems() -> tuple[str, ...]:
    """A few single words of which every keyword holds one, chosen greedily; words, as a line break may part a keyword's words."""
    keywords = {k for r in rules() for k in r.keywords}
    long = {k: [w for w in k.split() if len(w) > 2] for k in keywords}
    words = sorted({w for k, ws in long.items() for w in ws or k.split()})
    left, chosen = set(keywords), []
    while left:
        covers = {w: {k for k in left if any(w in part for part in k.split())} for w in words}
        best = max(words, key=lambda w: (len(covers[w]), len(w), w))
        chosen.append(best)
        left -= covers[best]
    return tuple(chosen)


@functools.cache
def _stem_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for s in stems():
        automaton.add_word(s)
    automaton.make_automaton()
    return automaton


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    by: dict[str, list[int]] = {}
    for r in rules():
        for k in r.keywords:
            by.setdefault(_GAPS.sub(" ", k), []).append(r.number)
    automaton = ahocorasick.Automaton()
    for k, numbers in by.items():
        automaton.add_word(k, tuple(numbers))
    automaton.make_automaton()
    return automaton


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """What is left of overlapping (start, end, rule) matches, by start."""
    # none of the kept contains another, so by start they're also in the order of their ends
    starts: list[int] = []
    kept: list[tuple[int, int, Rule]] = []
    for start, end, rule in sorted(found, key=lambda m: (-m[2].priority, m[0] - m[1], m[0], m[2].number)):
        at = bisect_right(starts, start)
        if at and kept[at - 1][1] >= end:
            continue
        at = bisect_left(starts, start)
        if at < len(kept) and kept[at][1] <= end:
            continue
        starts.insert(at, start)
        kept.insert(at, (start, end, rule))
    return kept


def _matches(text: str, rule: Rule) -> list[tuple[int, int, Rule]]:
    return [(m.start(), m.end(), rule) for m in rule.pattern.finditer(text) if m.end() > m.start()]


def tried(text: str) -> list[int]:
    """The numbers of the rules that both filters leave to be tried."""
    low = text.lower()
    if next(_stem_automaton().iter(low), None) is None:
        return []
    return sorted({n for _, group in _automaton().iter(_GAPS.sub(" ", low)) for n in group})


def detect(text: str) -> list[tuple[int, int, Rule]]:
    """Resolved matches in one text."""
    return resolve([m for n in tried(text) for m in _matches(text, rules()[n])])


_TAG = re.compile(r"(?i)spdx-license-identifier\s*:\s*(.*)", re.DOTALL)


def _name(rule: Rule, matched: str) -> str:
    """The rule's licence; for a machine-readable tag the expression itself."""
    tag = _TAG.match(matched) if rule.kind == "tag" and rule.license == "any" else None
    return re.sub(r"\s+", " ", tag[1]).strip("() ") if tag else rule.license


_SCHEMA = [T.StructField("license", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("rule", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("matched", T.StringType())]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, kind, rule, start, end, matched): the resolved detections of every text."""
    arrow_safe(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for start, end, rule in detect(text):
                    rows.append(i)
                    out.append((_name(rule, text[start:end]), rule.kind, rule.number, start, end, text[start:end]))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *(f.name for f in _SCHEMA)])

    return docs.select("doc_id", "text").filter("text != ''").mapInArrow(run, T.StructType([docs.schema["doc_id"], *_SCHEMA]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
