"""Any number of patterns over texts: an automaton of their literals finds which can match, and only those run."""

from __future__ import annotations

import re
import sys
from re import _constants as kinds
from re import _parser as parser

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Patterns that are sent to workers at once; more go in as many passes.
BLOCK = 50_000


def literal_of(pattern: str) -> str:
    """The longest run of characters, in lower case, that every match of a pattern holds; empty if there is none."""
    best = now = ""

    def walk(tree) -> None:
        nonlocal best, now
        for kind, value in tree:
            if kind is kinds.LITERAL:
                now += chr(value).lower()
            elif kind is kinds.SUBPATTERN:
                walk(value[3])
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] >= 1:
                walk(value[2])  # at least once, and then anything
                best, now = max(best, now, key=len), ""
            elif kind is not kinds.AT:
                best, now = max(best, now, key=len), ""
        best = max(best, now, key=len)

    walk(parser.parse(pattern))
    return best


class Patterns:
    """A block of patterns (pattern, any_case, ...) on a worker; expressions are compiled when a text first asks for them."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.compiled, self.always, found = rows, {}, [], {}
        for k, row in enumerate(rows):
            literal = literal_of(row[0])
            found.setdefault(literal, []).append(k) if literal else self.always.append(k)
        self.automaton = ahocorasick.Automaton()
        for literal, which in found.items():
            self.automaton.add_word(literal, which)
        if found:
            self.automaton.make_automaton()
        self.some = bool(found)

    def counts(self, text: str) -> list[tuple[int, int]]:
        """(pattern, matches) of the patterns that a text matches."""
        which = set(self.always)
        if self.some:
            for _, found in self.automaton.iter(text.lower()):
                which.update(found)
        out = []
        for k in sorted(which):
            if k not in self.compiled:
                self.compiled[k] = re.compile(self.rows[k][0], re.ASCII | (re.IGNORECASE if self.rows[k][1] else 0))
            n = sum(1 for _ in self.compiled[k].finditer(text))
            if n:
                out.append((k, n))
        return out


def _matching(sent: Broadcast, key: str):
    known: dict[str, Patterns] = {}

    def run(batches):
        if not known:
            known["patterns"] = Patterns(sent.value)
        found = known["patterns"]
        for batch in batches:
            rows = [(i, k, n) for i, text in enumerate(batch.column(1).to_pylist()) if text for k, n in found.counts(text)]
            told = lambda j: pa.array([found.rows[k][j] for _, k, _ in rows], pa.string())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _, _ in rows], pa.int64())), told(2), told(3), told(0), pa.array([n for _, _, n in rows], pa.int32())], [key, "category", "criticality", "pattern", "matches"])

    return run


def matching(texts: DataFrame, patterns: DataFrame, *, source: str = "source", key: str = "id", block: int = BLOCK) -> DataFrame:
    """(key, category, criticality, pattern, matches) of the patterns(category, criticality, pattern, any_case) that occur in each text, by Python's regular expressions on ASCII classes.

    Texts are read once for each `block` patterns. One pass over a text finds the literals that it holds; the patterns without a literal of their own run on every text.
    Null and empty texts match nothing; an empty table of patterns gives no rows.
    """
    spark = texts.sparkSession
    kind = f"{key} {texts.schema[key].dataType.simpleString()}, category string, criticality string, pattern string, matches int"
    rows, out = [], spark.createDataFrame([], kind)

    def meet(rows: list[tuple]) -> DataFrame:
        return texts.select(key, source).mapInArrow(_matching(spark.sparkContext.broadcast(rows), key), kind)

    for r in patterns.select("pattern", "any_case", "category", "criticality").toLocalIterator():
        rows.append(tuple(r))
        if len(rows) == block:
            out, rows = out.unionByName(meet(rows)), []
    return out.unionByName(meet(rows)) if rows else out
