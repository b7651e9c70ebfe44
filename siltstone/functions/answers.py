"""Citations, refusals and prompts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: phrases of a refusal, and the prompt's wording. ----
REFUSALS = [
    "not enough information",
    "insufficient information",
    "do not contain enough",
    "don't contain enough",
    "does not contain enough",
    "doesn't contain enough",
    "do not contain",
    "don't contain",
    "does not contain",
    "doesn't contain",
    "no relevant information",
    "no information",
    "cannot answer",
    "can't answer",
    "unable to answer",
    "not provided",
    "not enough context",
    "cannot determine",
    "can't determine",
    "not implemented in",
    "not found in the",
    "no mention of",
    "does not exist in",
    "do not include",
    "does not include",
]
SYSTEM = (
    "You are answering questions about a code repository. Use only the provided\n"
    "code chunks to answer. If the chunks do not contain enough information,\n"
    "say so explicitly and do not invent details. Cite the chunk numbers that\n"
    "support your answer using brackets like [1]. Do not cite chunks that were\n"
    "not provided."
)
CLOSING = "\nAnswer the question based on the chunks above.\n"
NO_CHUNKS = "(no chunks retrieved)\n"


def citations(text: Column) -> Column:
    """Distinct numbers in brackets, ascending; numbers beyond a bigint are skipped; empty for null."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def valid_citations(cited: Column, chunks: Column) -> Column:
    """How many lie within 1 and the number of chunks."""
    return F.size(F.filter(cited, lambda n: (n >= 1) & (n <= chunks)))


def well_formed(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"(?U)\S")), F.lit(False))


def refuses(text: Column) -> Column:
    """Whether the lower-case text holds any phrase of a refusal."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(p) for p in REFUSALS]), lambda p: F.contains(low, p))


def rendered(index: Column, repo: Column, path: Column, lines: Column, chunk_type: Column, symbol: Column, content: Column) -> Column:
    """One chunk of a prompt: a header line and the content with one line feed at its end at least."""
    repo, path, chunk_type, symbol, content = (F.coalesce(c, F.lit("")) for c in (repo, path, chunk_type, symbol, content))
    where = F.when(repo != "", F.concat(repo, F.lit("/"), path)).otherwise(path)
    what = F.when(symbol != "", F.concat(F.lit(", "), F.when(chunk_type == "", "symbol").otherwise(chunk_type), F.lit(": "), symbol)).otherwise("")
    body = F.when(F.endswith(content, F.lit("\n")), content).otherwise(F.concat(content, F.lit("\n")))
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), where, F.lit(":"), lines, what, F.lit("\n"), body)


def prompt(question: Column, blocks: Column) -> Column:
    """The user message around rendered blocks in order; a null or empty list says that nothing was found."""
    body = F.when(F.coalesce(F.size(blocks), F.lit(0)) > 0, F.array_join(blocks, "\n")).otherwise(NO_CHUNKS)
    return F.concat(F.lit("Question: "), F.coalesce(question, F.lit("")), F.lit("\n\nContext:\n"), body, F.lit(CLOSING))
