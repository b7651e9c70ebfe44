"""Code-aware words, chunk ids and names, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: words that carry no meaning in English and Go. ----
STOP_WORDS = (
    "a an the and or not is are was were be been in on at to for of with it this that from by as if else do does did has have had no so but up "
    "func package import return var const type struct interface map chan go defer select case switch default break continue fallthrough range nil"
).split()
#: Namespace of version 5 ids (the published DNS namespace).
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
#: The pattern of a definition's name in each language.
NAME_PATTERNS = {
    "go": r"func\s+(?:\([^)]+\)\s+)?(\w+)",
    "rust": r"fn\s+(\w+)",
    "python": r"def\s+(\w+)",
    "javascript": r"function\s+(\w+)",
    "typescript": r"function\s+(\w+)",
    "java": r"(?:public|private|protected)?\s*(?:static)?\s*\w+\s+(\w+)\s*\(",
    "c": r"\w+\s+(\w+)\s*\(",
    "cpp": r"\w+\s+(\w+)\s*\(",
    "ruby": r"def\s+(\w+)",
    "swift": r"func\s+(\w+)",
    "kotlin": r"fun\s+(\w+)",
    "scala": r"def\s+(\w+)",
    "php": r"function\s+(\w+)",
}
#: The label of each kind of chunk in enriched text.
LABELS = {"function": "Function", "block": "Block"}


def words(text: Column) -> Column:
    """Lower-case parts of identifiers in order, without stop words; an empty list for null.

    Text is cut at everything but letters, digits and underscores, then at underscores, at a change from
    lower case or digit to upper case, before the last capital of a run, and from digit to letter.
    """
    joined = F.coalesce(text, F.lit(""))
    for pattern in (r"(\p{Lu})(\p{Lu}\p{Ll})", r"([\p{Ll}\p{Nd}])(\p{Lu})", r"(\p{Nd})(\p{L})"):
        joined = F.regexp_replace(joined, pattern, "$1_$2")
    parts = F.split(F.lower(joined), r"[^\p{L}\p{Nd}]+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(parts, lambda w: (w != "") & ~F.array_contains(stop, w))


def token_hash(token: Column) -> Column:
    """CRC-32 of the UTF-8 bytes."""
    return F.crc32(F.encode(token, "UTF-8"))


def chunk_id(repo: Column, path: Column, name: Column, index: Column) -> Column:
    """Version 5 UUID of `repo:path:name:index`; nulls count as empty."""
    key = F.concat_ws(":", *[F.coalesce(c, F.lit("")) for c in (repo, path, name)], index.cast("string"))
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(key, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def extract_name(content: Column, language: Column) -> Column:
    """The name of the first definition; empty if there is none or the language has no pattern."""
    out = F.lit("")
    for lang, pattern in NAME_PATTERNS.items():
        out = F.when(language == lang, F.regexp_extract(content, pattern, 1)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def enriched(path: Column, language: Column, chunk_type: Column, name: Column, content: Column) -> Column:
    """Text that is indexed: a header that names file, language and kind, a blank line, the content. Nulls count as empty."""
    path, language, name, content = (F.coalesce(c, F.lit("")) for c in (path, language, name, content))
    label = F.when(chunk_type == "function", LABELS["function"]).when(chunk_type == "block", LABELS["block"]).otherwise("Chunk")
    kind = F.when(name != "", F.concat(label, F.lit(": "), name)).otherwise(F.concat(F.lit("Type: "), label))
    return F.concat(F.lit("File: "), path, F.lit("\nLanguage: "), language, F.lit("\n"), kind, F.lit("\n\n"), content)
