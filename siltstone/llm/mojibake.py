"""Text that was decoded with a wrong encoding: found, explained and restored.

Words with characters outside ASCII are the records that are compared, over the whole corpus. Words
that are equal once the characters outside ASCII are left out ("r.sum.") are near-twins; where
one of two is much more frequent, it is the clean one. The runs of the two are aligned, and each
aligned pair votes for the transformations (text written in one encoding, read in another) that
turn the clean run into the garbled one. Transformations with enough votes are learned and then undone
on every word of the corpus, also on those without a twin.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize

#: The encodings that text is written in, and those it is read in by mistake.
WRITTEN = ["utf-8", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "shift_jis", "euc_jp", "mac_roman", "cp437", "cp850"]
READ = ["cp1252", "latin-1", "cp1250", "iso8859-2", "iso8859-15", "cp1251", "cp1253", "cp1254", "koi8-r", "cp866", "cp437", "cp850", "cp852", "mac_roman", "gbk", "big5", "cp949", "shift_jis", "euc_jp"]
#: A word this many times as frequent as its near-twin is the clean one of the two.
RATIO = 8
#: Different aligned pairs and different near-twins that a transformation needs to be learned.
VOTES = 2
#: Words of one skeleton that meet its frequent words in one task; more are split.
BLOCK = 1000
REPLACEMENT = "�"
#: The replacement character, and the control characters from U+0080 but for the line end U+0085.
LOST = r"[\x{fffd}\x{80}-\x{84}\x{86}-\x{9f}]"


@lru_cache(maxsize=None)
def _table(name: str) -> tuple[str, dict[int, int]] | None:
    """Byte to character and back of an encoding of single bytes; bytes without a character stand for themselves."""
    if len(codecs.encode("é" if name not in ("cp1251", "koi8-r", "cp866", "cp1253") else "я" if name != "cp1253" else "α", name, "replace")) != 1 or name in ("gbk", "big5", "cp949", "shift_jis", "euc_jp", "utf-8"):
        return None
    there = {b: bytes([b]).decode(name, "replace") for b in range(256)}
    there = {b: chr(b) if c == REPLACEMENT else c for b, c in there.items()}
    return "".join(there.values()), {ord(c): b for b, c in there.items()}


def _to_bytes(text: str, name: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", t[1])[0] if (t := _table(name)) else text.encode(name)
    except UnicodeError:
        return None


def _to_text(data: bytes, name: str) -> str | None:
    try:
        return codecs.charmap_decode(data, "strict", t[0])[0] if (t := _table(name)) else data.decode(name)
    except UnicodeError:
        return None


def garble(text: str, written: str, read: str) -> str | None:
    return None if (data := _to_bytes(text, written)) is None else _to_text(data, read)


def restore(text: str, written: str, read: str) -> str | None:
    """The text before it was garbled; None if it can't have been garbled this way."""
    back = None if (data := _to_bytes(text, read)) is None else _to_text(data, written)
    return back if back is not None and back != text and garble(back, written, read) == text else None


RUN = re.compile(r"[^\x00-\x7f]+")
#: Fixed rule: letters, digits and everything outside ASCII make words.
#: They are tried where they begin only, and left at their end if they hold ASCII alone.
JAVA_WORD = r"((?<![A-Za-z0-9])[A-Za-z0-9]*+[\x{80}-\x{10ffff}][A-Za-z0-9\x{80}-\x{10ffff}]*+)"
#: Code spans quote characters as examples: what stands between single back quotes within a line.
JAVA_SPAN = r"`(?<!``)[^`\r\n]*+`(?!`)"


def odd_words(text: Column) -> Column:
    """The distinct words of a text that hold characters outside ASCII, without code spans; digits count alike."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, JAVA_SPAN, " "), F.lit(JAVA_WORD), F.lit(1)))


def skeleton(word: Column) -> Column:
    """A word with each run outside ASCII left out and each digit run made the same: equal for near-twins."""
    return F.regexp_replace(F.regexp_replace(word, r"[\x{80}-\x{10ffff}]+", "."), r"[0-9]+", "0")


def vote(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(written, read, garbled run, clean run, skeleton) of each transformation that explains an aligned pair."""
    for batch in pairs:
        out = []
        for bad, good, bones in zip(batch["bad"], batch["good"], batch["skeleton"]):
            aligned = list(zip(RUN.findall(bad), RUN.findall(good)))
            changed = [(g, c) for g, c in aligned if g != c]
            for written in WRITTEN:
                data = [_to_bytes(c, written) for _, c in changed]
                if None in data:
                    continue
                for read in READ:
                    if written != read and all(_to_text(b, read) == g for b, (g, _) in zip(data, changed)):
                        out += [(written, read, g, c, bones) for g, c in changed]
        yield pd.DataFrame(out, columns=["written", "read", "bad", "good", "skeleton"])


def _spread(df: DataFrame, column: str) -> DataFrame:
    """Rows over all cores, for work that is heavy beside their bytes."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), column)


def learn(words: DataFrame) -> list[tuple[str, str]]:
    """The transformations (written, read) that near-twins of words(word, n, skeleton) show, most votes first.

    One line per transformation: no more than there are pairs of encodings in the lists above.
    Words without any ASCII letter or digit have no skeleton that tells anything and don't vote.
    """
    some = words.where(F.col("skeleton").rlike("[A-Za-z]"))
    # Each skeleton's words meet its frequent ones only, and short skeletons of many words do so in blocks.
    frequent = some.where(F.col("n") >= RATIO).select("skeleton", F.col("word").alias("good"), F.col("n").alias("often"))
    sizes = some.groupBy("skeleton").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max("n").alias("top")).where(F.col("top") >= RATIO).drop("top")
    good = frequent.join(sizes, "skeleton").select("skeleton", "good", "often", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    bad = some.where(~F.col("word").contains(REPLACEMENT)).join(sizes, "skeleton").select("skeleton", F.col("word").alias("bad"), "n", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"))
    pairs = bad.join(good, ["skeleton", "block"]).where(F.col("often") >= RATIO * F.col("n")).select("bad", "good", "skeleton")
    votes = _spread(pairs, "bad").mapInPandas(vote, "written string, read string, bad string, good string, skeleton string")
    counts = votes.groupBy("written", "read").agg(F.countDistinct("bad", "good").alias("pairs"), F.countDistinct("skeleton").alias("twins"))
    found = counts.where((F.col("pairs") >= VOTES) & (F.col("twins") >= VOTES)).orderBy(F.desc("twins"), F.desc("pairs"), "written", "read").collect()
    return [(r["written"], r["read"]) for r in found]


def _undo(word: str, ways: list[tuple[str, str]]) -> Iterator[tuple[str, bool]]:
    """(restored, strong): what the word may have been. strong: its bytes are valid UTF-8, which chance hardly makes."""
    read_as: dict[str, bytes | None] = {}
    for written, read in ways:
        if read not in read_as:
            read_as[read] = _to_bytes(word, read)
        back = None if (data := read_as[read]) is None else _to_text(data, written)
        if back is not None and back != word and (written == "utf-8" or back.isprintable()) and garble(back, written, read) == word:
            yield back, written == "utf-8"


def _peel(word: str, ways: list[tuple[str, str]]) -> str | None:
    """The word with UTF-8 that was misread put right, as often as it was misread; None if nothing was."""
    now = word
    while True:  # each round makes the word shorter
        found = [b for b, strong in _undo(now, ways) if strong] if RUN.search(now) else []
        # Control characters and unassigned ones come out only where another mistake lies beneath.
        nxt = min(found, key=lambda b: sum(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") for c in b), default=None)
        if nxt is None:
            break
        now = nxt
    return now if now != word else None


def candidates(words: DataFrame, ways: list[tuple[str, str]]) -> DataFrame:
    """(word, n, restored, strong) of every way to undo a learned transformation on each word; not strong are only those
    whose characters are all frequent enough for a word that is RATIO times as frequent.

    UTF-8 is put right in the whole word or, where that fails, in each run by itself; parts beside
    a lost character are put right too, but the word stays lost.
    """
    seen = characters(words)
    strong_ways, weak_ways = [w for w in ways if w[0] == "utf-8"], [w for w in ways if w[0] != "utf-8"]

    def likely(word: str, back: str) -> bool:
        """No character of the restored word is far rarer in the corpus than the rarest of the word."""
        rarest = min(seen.get(c, 0) for c in word if c > "\x7f")
        return all(seen.get(c, 1) * RATIO >= rarest for c in back if c > "\x7f")

    def frequent(back: str, least: int) -> bool:
        """Each word counts for all its characters, so none of them is rarer than the word."""
        return all(seen.get(c, 0) >= least for c in back if c > "\x7f")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        peel = lru_cache(1 << 16)(lambda text: _peel(text, strong_ways))
        for batch in batches:
            out = []
            for word, n in zip(batch["word"], batch["n"]):
                back = peel(word) or RUN.sub(lambda m: peel(m[0]) or m[0], word)
                if back != word:
                    if likely(word, back):
                        out.append((word, n, back, True))
                elif len(word) >= 2:
                    out += [(word, n, b, False) for b in dict.fromkeys(b for b, _ in _undo(word, weak_ways)) if frequent(b, RATIO * n)]
            yield pd.DataFrame(out, columns=["word", "n", "restored", "strong"])

    return _spread(words.select("word", "n"), "word").mapInPandas(run, "word string, n long, restored string, strong boolean")


def characters(words: DataFrame) -> dict[str, int]:
    """How many texts hold each character outside ASCII, added up by word; no more entries than Unicode has."""
    each = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"), "n").where(F.col("c").rlike(r"[\x{80}-\x{10ffff}]"))
    return {r["c"]: r["n"] for r in each.groupBy("c").agg(F.sum("n").alias("n")).toLocalIterator()}


def garbled_words(words: DataFrame, ways: list[tuple[str, str]]) -> DataFrame:
    """(word, restored): restored is null where it is lost.

    A word is garbled if it holds the replacement character or a control character that only
    misread bytes give; if undoing a transformation from UTF-8
    gives valid text of characters that the corpus knows; or if undoing another one gives a word
    that is much more frequent.
    """
    tried = materialize(candidates(words, ways), "tried")
    strong = tried.where("strong").select("word", "restored", F.lit(None).cast("long").alias("often"))
    known = words.select(F.col("word").alias("restored"), F.col("n").alias("often"))
    weak = tried.where("NOT strong").join(known, "restored").where(F.col("often") >= RATIO * F.col("n")).select("word", "restored", "often")
    lost = words.where(F.col("word").rlike(LOST)).select("word", F.lit(None).cast("string").alias("restored"), F.lit(None).cast("long").alias("often"))
    both = strong.unionByName(weak).unionByName(lost)
    return both.groupBy("word").agg(F.max_by("restored", F.coalesce("often", F.when(F.col("restored").isNotNull(), F.lit(1 << 40)))).alias("restored"))


def word_counts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, word) of each text's odd words, and (word, n, skeleton) over the corpus; n counts texts."""
    held = materialize(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(odd_words(F.col(text_col))).alias("word")), "words")
    counts = held.groupBy("word").agg(F.count("*").alias("n")).withColumn("skeleton", skeleton(F.col("word")))
    return held, materialize(counts, "counts")


def find(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, word, restored) of each garbled word of each text; null, empty and ASCII texts have none."""
    held, counts = word_counts(df, id_col, text_col)
    bad = garbled_words(counts, learn(counts))
    return held.join(bad, "word").select(F.col("id").alias(id_col), "word", "restored")


def restored_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, whole): texts with garbled words, those words restored; whole: none of them was lost.

    Words of code spans stay as they are.
    """
    marks = find(df, id_col, text_col).groupBy(id_col).agg(F.map_from_entries(F.collect_set(F.struct("word", F.coalesce("restored", "word")))).alias("words"), F.every(F.col("restored").isNotNull()).alias("whole"))

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, words: pd.Series) -> pd.Series:
        part = re.compile(r"(?<!`)`[^`\r\n]*`(?!`)|[A-Za-z0-9\x80-\U0010ffff]*[\x80-\U0010ffff][A-Za-z0-9\x80-\U0010ffff]*")
        return pd.Series([part.sub(lambda m: w.get(m[0], m[0]), t) for t, w in zip(text, (dict(x) for x in words))])

    there = df.select(F.col(id_col), F.col(text_col).alias("text")).join(marks, id_col)
    return there.select(id_col, rewrite("text", "words").alias("text"), "whole")
