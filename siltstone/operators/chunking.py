"""Cutting source files into chunks: sliding windows of lines, and functions of Go with the gaps between them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X

#: Lines of a window, lines that consecutive windows share, lines above which a block is cut.
WINDOW, OVERLAP, LARGE = 40, 5, 80


def lines(content: Column) -> Column:
    """Lines of a text; a line feed at the end leaves a last empty line, carriage returns stay."""
    return F.split(content, "\n", -1)


def window_starts(count: Column, size: int, overlap: int) -> Column:
    """First lines (from 0) of the windows over `count` lines; the last window reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and smaller than the window")
    return F.sequence(F.lit(0), F.greatest(count - overlap - 1, F.lit(0)), F.lit(size - overlap))


def windows(files: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of files(repo, file_path, language, content): windows of lines, blank ones left out.

    Chunks are named after the first definition in them, where the language has a pattern; ids hold the first
    line even then. Null contents have no chunk. Lines count from 1, both ends included.
    """
    cut = files.where("content IS NOT NULL").select("*", lines(F.col("content")).alias("_lines"))
    cut = cut.select("*", F.explode(window_starts(F.size("_lines"), size, overlap)).alias("_at")).drop("content")
    cut = cut.select("*", F.array_join(F.slice("_lines", F.col("_at") + 1, size), "\n").alias("content"), (F.col("_at") + 1).alias("start_line"), F.least(F.col("_at") + size, F.size("_lines")).alias("end_line")).drop("_lines", "_at")
    return _finish(cut.where(F.regexp_like("content", F.lit(r"\S"))).withColumn("name", X.extract_name(F.col("content"), F.col("language"))), F.col("start_line"))


def _finish(cut: DataFrame, index: Column) -> DataFrame:
    kind = F.when(F.col("name") != "", "function").otherwise("block")
    return cut.withColumn("chunk_type", kind).withColumn("chunk_id", X.chunk_id(F.col("repo"), F.col("file_path"), F.col("name"), index))


SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]+?)'", re.S)
FUNC = re.compile(r"^func\s*(?:\(([^()]*)\)\s*)?(\w+)", re.M)
PAIRS = {")": "(", "]": "[", "}": "{"}


SIGNATURE = re.compile(r"[ \t\r]+|\n|\w+|[(\[{]|.")


def _body_end(code: str, at: int, closing: dict[int, int]) -> int:
    """The place where a function ends whose name ends at `at`: the brace that closes its body, or, without one, its signature.

    The signature is read token by token; a brace after `interface` or `struct` belongs to a type of the result.
    """
    word, end = "", at
    while m := SIGNATURE.match(code, at):
        at = m.end()
        if m[0] == "\n":
            return end
        if m[0].isspace():
            continue
        if m[0] == "{" and word not in ("interface", "struct"):
            return closing[m.start()]
        if m.start() in closing:
            at = closing[m.start()] + 1
        word, end = m[0], at - 1
    return end


def go_functions(source: str) -> list[tuple[str, int, int]] | None:
    """(name, first line, last line) of each top-level function, its doc comment included; None if brackets don't match.

    Comments and literals are blanked first, so only brackets of code count.
    """
    code = SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    stack, closing = [], {}
    for m in re.finditer(r"[()\[\]{}]", code):
        if m[0] in "([{":
            stack.append((m[0], m.start()))
        else:
            if not stack or stack[-1][0] != PAIRS[m[0]]:
                return None
            closing[stack.pop()[1]] = m.start()
    if stack or "package" not in code:
        return None
    rows = source.split("\n")
    found = []
    for m in FUNC.finditer(code):
        first = code.count("\n", 0, m.start())
        last = code.count("\n", 0, _body_end(code, m.end(), closing))
        begin = first
        while begin and rows[begin - 1].lstrip().startswith("//"):
            begin -= 1
        if begin == first and first and rows[first - 1].rstrip().endswith("*/"):
            k = first - 1
            while k and "/*" not in rows[k]:
                k -= 1
            begin = k if rows[k].lstrip().startswith("/*") else first
        found.append((m[2], begin, last))
    return found


def go_chunks(files: DataFrame, size: int = WINDOW, overlap: int = OVERLAP, large: int = LARGE) -> DataFrame:
    """Chunks of Go files: one per function or method with its doc comment, and the runs of lines between them.

    Functions and gaps of more than `large` lines are cut into windows, of which only a function's first keeps
    its name. A file that doesn't hold together is cut into windows. Files are independent rows, so any file
    takes one call and no shuffle. Null contents have no chunk.
    """
    columns = [c for c in files.columns if c != "content"]
    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes if c != "content") + ", content string, start_line int, end_line int, name string, chunk_type string, id_index int, id_name string"

    def parts(first: int, last: int, name: str, kind: str, rows: list[str]) -> Iterator[tuple]:
        block = rows[first : last + 1]
        if len(block) <= large:
            spans = [(0, len(block))]
        else:
            spans = [(a, min(a + size, len(block))) for a in range(0, max(len(block) - overlap, 1), size - overlap)]
        for n, (a, b) in enumerate(spans):
            content = "\n".join(block[a:b])
            if not content.strip():
                continue
            whole = len(spans) == 1
            label = name if n == 0 else ""
            if kind == "block" and whole:
                m = re.search(X.NAME_PATTERNS["go"], content, re.A)
                label = m[1] if m else ""
            index = 0 if kind == "function" and whole else (first + 1 if whole else a)
            yield content, first + a + 1, first + b, label, kind, index, name if kind == "function" else label

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for record in b.to_dict("records"):
                source = record.pop("content")
                if source is None:
                    continue
                rows = source.split("\n")
                found = go_functions(source)
                if found is None:
                    spans = [(a, min(a + size, len(rows)) - 1) for a in range(0, max(len(rows) - overlap, 1), size - overlap)]
                    for a, z in spans:
                        content = "\n".join(rows[a : z + 1])
                        if content.strip():
                            m = re.search(X.NAME_PATTERNS["go"], content, re.A)
                            out.append((*[record[c] for c in columns], content, a + 1, z + 1, m[1] if m else "", "function" if m else "block", a + 1, m[1] if m else ""))
                    continue
                at = 0
                for name, first, last in found:
                    if first > at:
                        out += [(*[record[c] for c in columns], *p) for p in parts(at, first - 1, "", "block", rows)]
                    out += [(*[record[c] for c in columns], *p) for p in parts(max(first, at), last, name, "function", rows)]
                    at = max(at, last + 1)
                if at < len(rows):
                    out += [(*[record[c] for c in columns], *p) for p in parts(at, len(rows) - 1, "", "block", rows)]
            yield pd.DataFrame(out, columns=[*columns, "content", "start_line", "end_line", "name", "chunk_type", "id_index", "id_name"])

    cut = files.mapInPandas(run, schema)
    return cut.withColumn("chunk_id", X.chunk_id(F.col("repo"), F.col("file_path"), F.col("id_name"), F.col("id_index"))).drop("id_index", "id_name")


def chunks(files: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Go files by functions, all others by windows."""
    go = go_chunks(files.where("language = 'go'"), size, overlap)
    return windows(files.where("language IS NULL OR language <> 'go'"), size, overlap).unionByName(go)


def ordered(cut: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with their position in their file, from 1: by first line, then last line, then name."""
    return cut.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("start_line", "end_line", "name")))
