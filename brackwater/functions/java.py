"""A reader of a subset of Java: package, imports, classes, fields, methods with their calls and complexity. Runs in Arrow batches."""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from ..session import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODIFIERS = ("public", "protected", "private", "abstract", "static", "final", "synchronized", "native", "default", "transient", "volatile", "strictfp")
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "new", "throw", "super", "this", "try", "synchronized", "assert", "do", "else"}
CLASS = re.compile(r"((?:@\w+(?:\([^)]*\))?\s*|\b(?:" + "|".join(MODIFIERS) + r")\s+)*)\b(?:class|interface|enum)\s+(\w+)(?:\s*<[^{]*?>)?(?:\s+extends\s+([\w.<>, ]+?))?(?:\s+implements\s+([\w.<>, ]+?))?\s*\{")
METHOD = re.compile(r"^((?:@\w+(?:\([^)]*\))?\s*|(?:" + "|".join(MODIFIERS) + r")\s+)*)(?:<[^>]+>\s*)?(?:([\w.<>\[\], ?]+?)\s+)?(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w., ]+)?$", re.S)
FIELD = re.compile(r"^((?:@\w+(?:\([^)]*\))?\s*|(?:" + "|".join(MODIFIERS) + r")\s+)*)([\w.<>\[\], ?]+?)\s+(\w+)\s*(?:=\s*(.*))?$", re.S)
PARAMETER = pa.struct([("name", pa.string()), ("type", pa.string())])
FIELD_TYPE = pa.struct([("name", pa.string()), ("type", pa.string()), ("modifiers", pa.list_(pa.string())), ("initial_value", pa.string())])
METHOD_TYPE = pa.struct([("name", pa.string()), ("return_type", pa.string()), ("parameters", pa.list_(PARAMETER)), ("modifiers", pa.list_(pa.string())), ("annotations", pa.list_(pa.string())), ("complexity", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("loc", pa.int32()), ("calls", pa.list_(pa.string())), ("source_code", pa.string())])
FIELDS = "array<struct<name:string,type:string,modifiers:array<string>,initial_value:string>>"
METHODS = "array<struct<name:string,return_type:string,parameters:array<struct<name:string,type:string>>,modifiers:array<string>,annotations:array<string>,complexity:int,start_line:int,end_line:int,loc:int,calls:array<string>,source_code:string>>"


def masked(source: str) -> str:
    """The source with comments, strings and characters blanked, line ends kept, so that braces and words in them don't count."""
    out, k, n = list(source), 0, len(source)
    while k < n:
        if source.startswith("//", k):
            end = source.find("\n", k)
        elif source.startswith("/*", k):
            end = source.find("*/", k + 2)
            end = end + 2 if end >= 0 else n
        elif source[k] in "\"'":
            quote, end = source[k], k + 1
            while end < n and source[end] != quote and source[end] != "\n":
                end += 2 if source[end] == "\\" else 1
            end += 1
        else:
            k += 1
            continue
        end = n if end < 0 else min(end, n)
        for j in range(k, end):
            if out[j] != "\n":
                out[j] = " "
        k = end
    return "".join(out)


def body_end(text: str, start: int) -> int:
    """Just behind the brace that closes the one at start; -1 if none does."""
    depth = 0
    for m in re.compile("[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return -1


def words_of(head: str) -> tuple[list[str], list[str]]:
    return [w for w in re.findall(r"(?<!@)\b\w+", re.sub(r"@\w+(?:\([^)]*\))?", " ", head)) if w in MODIFIERS], re.findall(r"@(\w+)", head)


def parameters_of(text: str) -> list[dict]:
    parts, depth, now = [], 0, ""
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += c
    out = []
    for p in [*parts, now]:
        p = re.sub(r"@\w+(?:\([^)]*\))?|\bfinal\b", " ", p).strip()
        if p:
            kind, _, name = p.rpartition(" ")
            out.append({"name": name.strip(), "type": kind.strip()})
    return out


def complexity(body: str) -> int:
    """1 and a point for each if, while, counted for, do, switch, catch, || and &&. A for over a collection and ? : give none; a do's while is the do's point."""
    points = len(re.findall(r"\b(?:if|while|switch|catch)\b|\|\||&&", body))
    for m in re.finditer(r"\bfor\s*\(", body):
        depth, at = 1, m.end()
        while at < len(body) and depth and not (depth == 1 and body[at] == ";"):
            depth += (body[at] == "(") - (body[at] == ")")
            at += 1
        points += at < len(body) and depth > 0
    return 1 + points


def classes(source: str | None, first_only: bool = True) -> list[dict]:
    """The outermost classes of a source; unbalanced ones are left out."""
    if not source:
        return []
    clean, out, at = masked(source), [], 0
    package = re.search(r"\bpackage\s+([\w.]+)\s*;", clean)
    imports = re.findall(r"\bimport\s+((?:static\s+)?[\w.*]+)\s*;", clean)
    while m := CLASS.search(clean, at):
        end = body_end(clean, m.end() - 1)
        if end < 0:
            break
        modifiers, annotations = words_of(m[1])
        fields, methods = members(source, clean, m.end(), end - 1, m[2])
        out.append({"name": m[2], "package": package[1] if package else "", "imports": imports, "modifiers": modifiers, "annotations": annotations, "extends": m[3].strip() if m[3] else None, "implements": [x.strip() for x in (m[4] or "").split(",") if x.strip()], "fields": fields, "methods": methods, "text": source[m.start() : end]})
        at = end
        if first_only:
            break
    return out


def members(source: str, clean: str, start: int, end: int, name: str) -> tuple[list[dict], list[dict]]:
    fields, methods, k = [], [], start
    while k < end:
        m = re.compile("[;{]").search(clean, k, end)
        if not m:
            break
        stop = m.end() if m[0] == ";" else body_end(clean, m.start())
        equals = clean.find("=", k, m.start())
        if m[0] == "{" and equals >= 0 and "(" not in clean[k:equals]:  # an initial value in braces
            semi = clean.find(";", stop, end)
            stop = semi + 1 if semi >= 0 else end
        if stop < 0:
            break
        head = clean[k : m.start()].strip()
        body = clean[m.start() : stop] if m[0] == "{" else ""
        found = METHOD.match(head) if "=" not in head.split("(")[0] else None
        if found and found[3] not in KEYWORDS and (found[2] or found[3] == name) and not re.search(r"\b(?:class|interface|enum)\b", head):
            modifiers, annotations = words_of(found[1])
            first = k + len(clean[k : m.start()]) - len(clean[k : m.start()].lstrip())
            text = source[first:stop]
            calls = [c for c in re.findall(r"(?:\w+\.)*(\w+)\s*\(", body) if c not in KEYWORDS]
            methods.append({"name": found[3], "return_type": (found[2] or "").strip(), "parameters": parameters_of(found[4]), "modifiers": modifiers, "annotations": annotations, "complexity": complexity(body) if body else 0, "start_line": source.count("\n", 0, first) + 1, "end_line": source.count("\n", 0, stop) + 1, "loc": text.count("\n") + 1, "calls": calls, "source_code": text})
        elif not re.search(r"\b(?:class|interface|enum)\b", head) and (f := FIELD.match(source[k : m.start() if m[0] == ";" else stop - 1].strip())) and f[2].strip() not in KEYWORDS:
            fields.append({"name": f[3], "type": f[2].strip(), "modifiers": words_of(f[1])[0], "initial_value": f[4].strip() if f[4] else None})
        k = stop
    return fields, methods


#: Characters of source, or files if they are small, that are taken apart at a time. What they give as Python objects is some ten times as large.
PIECE_CHARS, PIECE_FILES = 1 << 20, 100


def _pieces(batch: pa.RecordBatch):
    """(paths, sources) of a batch, a bounded piece at a time; a longer file is a piece of its own."""
    paths, sources, size = [], [], 0
    for p, s in zip(batch.column(0), batch.column(1)):
        source = s.as_py()
        if paths and (len(paths) >= PIECE_FILES or size + len(source or "") > PIECE_CHARS):
            yield paths, sources
            paths, sources, size = [], [], 0
        paths.append(p.as_py())
        sources.append(source)
        size += len(source or "")
    if paths:
        yield paths, sources


def parsed(files: DataFrame, first_only: bool = True) -> DataFrame:
    """files(path, source) to a row for each class: path, name, package, imports, modifiers, annotations, extends, implements, fields, methods.

    Files go to Python in batches of at most 64 MB (the session's setting is lowered, never raised) and are taken apart in pieces, so that a worker's memory doesn't follow their number.
    """
    spark = files.sparkSession
    small_batches(spark)
    # Small files are much work: left to the size of what is read, they would come to a few tasks.
    files = files.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")

    def run(batches):
        for batch in batches:
            for paths, sources in _pieces(batch):
                rows = [(p, c) for p, s in zip(paths, sources) for c in classes(s, first_only)]
                text = lambda k: pa.array([c[k] for _, c in rows], pa.string())  # noqa: E731, B023
                many = lambda k: pa.array([c[k] for _, c in rows], pa.list_(pa.string()))  # noqa: E731, B023
                columns = [pa.array([p for p, _ in rows], pa.string()), text("name"), text("package"), many("imports"), many("modifiers"), many("annotations"), text("extends"), many("implements"), pa.array([c["fields"] for _, c in rows], pa.list_(FIELD_TYPE)), pa.array([c["methods"] for _, c in rows], pa.list_(METHOD_TYPE)), text("text")]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "name", "package", "imports", "modifiers", "annotations", "extends", "implements", "fields", "methods", "text"])

    strings = "array<string>"
    return files.mapInArrow(run, f"path string, name string, package string, imports {strings}, modifiers {strings}, annotations {strings}, extends string, implements {strings}, fields {FIELDS}, methods {METHODS}, text string")
