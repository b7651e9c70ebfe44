"""Source files that do not parse: the least repair of each file, where it starts, and what it tells.

Files are cut into tokens, brackets (and the indentation of Python and YAML) make nested groups, and each
group is parsed by the error-correcting charts of `chart`. A repair that costs anything flags the file. The kind of the fault comes from
where the edits are: conflict marks, an open end, the whole file from its beginning (another language), or a slip.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import lexers
from siltstone.llm.chart import matched, nest, unclosed
from siltstone.llm.grammars import BRACKETS, EXTENSIONS, grammar

#: Repairs are worked out up to this cost; dearer files count as this and one.
MOST = 3
MARKS = re.compile(r"^(?:<{7} |>{7} |={7}\s*$)", re.M)


def lexed(text: str, language: str) -> tuple[list[str], list[int], dict[str, str]]:
    """(kinds, starts, brackets) of a file."""
    if language == "json":
        return *lexers.json_tokens(text), BRACKETS
    if language == "yaml":
        return *lexers.yaml_tokens(text), BRACKETS | {"INDENT": "DEDENT"}
    if language == "shell":
        return *lexers.shell_tokens(text), {"(": ")", "{": "}"}
    if language == "python":
        return *lexers.python_tokens(text), BRACKETS | {"INDENT": "DEDENT", "${": "$}"}
    if language in ("javascript", "typescript"):
        return *lexers.tokens(text, language), BRACKETS | {"${": "$}"}
    return *lexers.tokens(text, language), BRACKETS


def _order(seq: tuple, places: Sequence, language: str) -> list[tuple[str, int]]:
    """Edits of a Go file's order: the package comes first, and imports before all else."""
    if language != "go":
        return []
    tops = [(t, p) for t, p in zip(seq, places) if t in ("package", "import", "func", "var", "const", "type")]
    out = [("missing", 0)] if tops and tops[0][0] != "package" or not tops and seq else []
    other = next((n for n, (t, _) in enumerate(tops) if t not in ("package", "import")), len(tops))
    return out + [("other", p) for t, p in tops[other:] if t == "import"] + [("other", p) for n, (t, p) in enumerate(tops) if t == "package" and n]


def inspect(text: str, language: str, most: int = MOST) -> tuple[int, str | None, int | None]:
    """(cost of the least repair, kind of fault, line of the first edit). An empty file is valid except in JSON.

    With `most` = 0, all that is told is whether the least repair costs anything. Whether open brackets are closed or left out is decided by what the chart then costs. The fault comes from where the edits are:
    on conflict marks; on the last line only, with an end missing; from the beginning on, and more than `most`; or in a few places.
    """
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    if language == "json" and not text.strip():
        return 1, "truncation", 1
    kinds, starts, brackets = lexed(text, language)
    if "INDENT" in brackets:
        kinds, brackets = ["I" if k == "INDENT" else k for k in kinds], {("I" if a == "INDENT" else a): b for a, b in brackets.items()}
    g, n = grammar(language), len(kinds)
    # Most files are valid, and need no places.
    if (whole := matched(kinds, brackets)) is not None and not _order(whole, range(len(whole)), language) and not g.cost("file", whole, 0):
        return 0, None, None
    tries = [nest(kinds, brackets)]
    if tries[0][2] and (left := unclosed(kinds, brackets)):
        tries.append(nest(kinds, brackets, left))
    best = None
    for seq, places, edits in tries:
        edits = edits + _order(seq, places, language)
        cost = g.cost("file", seq, 0)
        if not cost and not edits:
            return 0, None, None
        if not most:
            return 1, None, None
        if cost:  # no further than what would be better than the other way
            limit = most if best is None else min(most, best[0] - len(edits) - 1)
            cost = g.cost("file", seq, limit) if limit > 0 else limit + 1
            if cost > limit and limit < most:
                continue
        if best is None or len(edits) + cost < best[0]:
            best = (len(edits) + cost, cost, seq, places, edits)
    total, cost, seq, places, edits = best
    if cost <= most:
        found = edits + g.edits("file", seq, places, n, most)
    else:  # every repair has edits where no language has a token, and where the file can't go on
        found = edits + [("other", i) for i, k in enumerate(kinds) if k == "BAD"] + [("other", g.stops("file", seq, places, n))]
    at = [min(i, n) for _, i in found]
    offsets = [starts[i] if i < n else len(text) for i in at]
    line = text.count("\n", 0, min(offsets)) + 1 if offsets else 1
    if any(MARKS.match(text, o) for o in offsets):
        return total, "conflict", line
    # A file cut off: an end is missing, of a bracket or of the last line, and nothing is wrong before that line.
    tail = text.rfind("\n", 0, len(text.rstrip())) + 1
    last = max((i for i, k in enumerate(kinds) if k not in ("NL", "DEDENT", "BR", ";")), default=-1)
    cut = not text.endswith("\n") or any(kind == "missing" and i > last for kind, i in found)
    if cut and min(offsets, default=len(text)) >= tail:
        return total, "truncation", line
    return total, "mismatch" if cost > most and g.stops("file", seq, places, n) <= n / 10 else "slip", line


def language_of(path: Column) -> Column:
    """The language of a path's last extension, in any case; null if it has no grammar here."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(known, extension)


def check(df: DataFrame, id_col: str, path_col: str, text_col: str, keep: tuple[str, ...] = (), most: int = MOST) -> DataFrame:
    """(id, kept columns, language, cost, fault, line of the first edit) of each file with a language that has a grammar and content.

    With `most` = 0, costs above 0 are given as 1, and no faults and lines. Null contents and paths, Markdown and languages without a grammar have no row; empty files cost 0.
    """
    kinds = dict(df.dtypes)
    rows = df.select(F.col(id_col).alias("id"), *keep, language_of(F.col(path_col)).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sys

        sys.setrecursionlimit(20_000)
        for b in batches:
            found = []
            for text, language in zip(b["text"], b["lang"]):
                try:
                    found.append(inspect(text, language, most))
                except RecursionError:  # nested deeper than any sane file
                    found.append((MOST + 1, "mismatch", 1))
            out = b.drop(columns=["text"])
            out["cost"] = pd.Series([c for c, _, _ in found], index=b.index, dtype="int32")
            out["fault"] = pd.Series([k for _, k, _ in found], index=b.index, dtype=object)
            out["line"] = pd.Series([n for _, _, n in found], index=b.index, dtype="Int32")
            yield out

    kept = "".join(f", `{k}` {kinds[k]}" for k in keep)
    return rows.mapInPandas(run, f"id {kinds[id_col]}{kept}, lang string, cost int, fault string, line int").withColumnRenamed("id", id_col)


def rates(checked: DataFrame, repo_col: str) -> DataFrame:
    """(repo, language, files, invalid, rate) by repository and language; files without a repository count under null."""
    by = checked.groupBy(F.col(repo_col).alias("repo"), F.col("lang").alias("language")).agg(F.count("*").alias("files"), F.count_if(F.col("cost") > 0).alias("invalid"))
    return by.select("repo", "language", "files", "invalid", F.round(F.col("invalid") / F.col("files"), 6).alias("rate"))
