"""Registry of this subpackage's queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import mojibake, neardup, neighbours, packing, pairs, splitting, syntax, tokens
from siltstone.llm.grammars import EXTENSIONS
from siltstone.session import table

Query = Callable[[SparkSession, str], DataFrame]


#: Fixed values of problem 1.
DIMENSION, LEAST_SIMILARITY = 96, 0.8


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, vector) of each chunk of the complete responses."""
    whole = table(spark, d, "embed_responses").where(F.size("chunk_nos") == F.size("embeddings"))
    return whole.select(F.explode(F.arrays_zip("chunk_nos", "embeddings")).alias("x")).select(F.col("x.chunk_nos").alias("id"), F.col("x.embeddings").alias("vector"))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.neighbours(_vectors(spark, d), DIMENSION, neighbours.Search(least=LEAST_SIMILARITY, whole=True))
    return found.withColumnRenamed("id", "chunk_no")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.neighbours(_vectors(spark, d), DIMENSION, neighbours.Search(least=LEAST_SIMILARITY))
    return found.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Files with what their least repair costs, and where it is."""
    return syntax.check(table(spark, d, "source_files"), "file_id", "file_path", "content", ("repo",))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).where("cost > 0").select("file_id")


def p2_faults(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).where("cost > 0").select("file_id", "repo", F.col("lang").alias("language"), "cost", "fault", "line")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(_checked(spark, d), "repo")


#: Fixed values of problem 3: three words, at least 25 features, similarity from 0.6.
TRIPLES = neardup.Likeness(size=3, least=25, threshold=0.6)


def p2_judged(spark: SparkSession, d: str) -> DataFrame:
    """How many files of each repository and language were judged."""
    return p2_rates(spark, d).select("repo", "language", "files")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "code_chunks")
    members, reps = neardup.representatives(neardup.sketches(chunks, "chunk_no", "content", TRIPLES))
    found = neardup.row_pairs(members, neardup.similar_pairs(reps, chunks, "chunk_no", "content", TRIPLES))
    return found.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "code_chunks"), "chunk_no", "content", TRIPLES)


def _limits(spark: SparkSession, d: str) -> splitting.Limits:
    """The limits of the table, which has one row for each kind of limit."""
    rows = {r["limit_name"]: r for r in table(spark, d, "size_limits").where("limit_name IN ('chunk_lines', 'chunk_chars')").collect()}
    lines, chars = rows["chunk_lines"], rows["chunk_chars"]
    return splitting.Limits(lines["max_size"], chars["max_size"], lines["overlap"], chars["overlap"])


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "code_chunks"), "chunk_no", "content", "start_line", _limits(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).where("piece = 0").select("chunk_no")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.find(table(spark, d, "eval_answers"), "answer_id", "query", "text", "n_chunks")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    limit = table(spark, d, "size_limits").where("limit_name = 'pack_tokens'").first()["max_size"]
    sizes = tokens.count_tokens(table(spark, d, "documents"), "doc_id", "text")
    packed = packing.pack(sizes.select(F.col("doc_id").alias("id"), F.col("tokens").alias("size")), limit)
    return packed.withColumnRenamed("id", "doc_id")


def p7_properties(spark: SparkSession, d: str) -> DataFrame:
    """In one row: documents in containers, containers that are too full, documents split though they fit, and pieces that are missing."""
    limit = table(spark, d, "size_limits").where("limit_name = 'pack_tokens'").first()["max_size"]
    packed = p7_containers(spark, d)
    fills = packed.groupBy("container").agg(F.sum("size").alias("fill")).agg(F.count_if(F.col("fill") > limit).alias("overfull"))
    docs = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("pieces").alias("pieces"), F.sum("size").alias("size"))
    docs = docs.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= limit)).alias("split_small"), F.sum(F.col("pieces") - F.col("n")).alias("missing"))
    return docs.join(F.broadcast(fills))  # one row each


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find(table(spark, d, "documents"), "doc_id", "text").select("doc_id").distinct()


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored_texts(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_faults, p2_rates, p2_judged, p3_found, p3_groups, p4_found, p4_pieces, p5_found, p6_ids, p7_containers, p7_properties, p8_found, p8_restored)}


def oracle_sql() -> dict[str, str]:
    known = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in EXTENSIONS.items())
    nearest = f"""
            WITH v AS (SELECT id, any_value(v) AS v FROM (SELECT unnest(chunk_nos) AS id, unnest(embeddings) AS v FROM embed_responses WHERE len(chunk_nos) = len(embeddings))
                WHERE id IS NOT NULL AND len(v) = {DIMENSION} AND NOT list_bool_or(list_transform(v, lambda x: x IS NULL)) AND list_bool_or(list_transform(v, lambda x: x <> 0)) GROUP BY id),
            s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM v a JOIN v b ON a.id <> b.id),
            r AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM s)"""
    return {
        "p1_neighbours": nearest + " SELECT a AS chunk_no, n::INT AS rank, b AS neighbour, sim AS similarity FROM r WHERE n <= 10",
        "p1_found": nearest
        + f"""
            SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM r WHERE n <= 10 AND sim >= {LEAST_SIMILARITY}""",
        "p2_judged": f"""
            SELECT repo, language, count(*) AS files FROM (SELECT repo, content, CASE lower(regexp_extract(file_path, '(\\.[^./]*)$', 1)) {known} END AS language FROM source_files)
            WHERE language IS NOT NULL AND content IS NOT NULL GROUP BY repo, language""",
        "p3_found": f"""
            WITH w AS (SELECT chunk_no, regexp_extract_all(content, '{TRIPLES.word}') AS t FROM code_chunks WHERE content IS NOT NULL),
            f AS MATERIALIZED (SELECT DISTINCT chunk_no, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS x FROM w WHERE len(t) >= 3),
            n AS MATERIALIZED (SELECT chunk_no, count(*) AS c FROM f GROUP BY chunk_no HAVING count(*) >= {TRIPLES.least}),
            k AS MATERIALIZED (SELECT chunk_no, x, c FROM f JOIN n USING (chunk_no))
            SELECT a.chunk_no AS chunk_a, b.chunk_no AS chunk_b FROM k a JOIN k b ON a.x = b.x AND a.chunk_no < b.chunk_no
            GROUP BY a.chunk_no, b.chunk_no, a.c, b.c HAVING count(*) >= {TRIPLES.threshold} * (a.c + b.c - count(*))""",
        "p7_properties": "SELECT count(*) AS documents, 0 AS overfull, 0 AS split_small, 0 AS missing FROM documents WHERE text <> ''",
        "p4_found": """
            SELECT chunk_no FROM code_chunks
            WHERE length(content) > 4000 OR length(content) - length(replace(content, chr(10), '')) + 1 > 80""",
    }
