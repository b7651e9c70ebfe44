"""Registry of the core queries and their SQL equivalents. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import answers as A
from siltstone.functions import text as X
from siltstone.operators import changes, chunking, dense, evaluate, sparse
from siltstone.session import kept, table
from siltstone.sources.config import LANGUAGES, SKIP_DIRS, Config
from siltstone.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = Config()
K = 10
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# ---- SQL of shared parts. ----


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _words_sql(text: str) -> str:
    joined = f"coalesce({text}, '')"
    for p in (r"(\p{Lu})(\p{Lu}\p{Ll})", r"([\p{Ll}\p{Nd}])(\p{Lu})", r"(\p{Nd})(\p{L})"):
        joined = f"regexp_replace({joined}, '{p}', '\\1_\\2', 'g')"
    return f"list_filter(string_split_regex(lower({joined}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> '' AND NOT list_contains({_list(X.STOP_WORDS)}, w))"


_LANGUAGE_SQL = "CASE lower(regexp_extract(file_path, '(\\.[^./]*)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{lang}'" for lang, es in LANGUAGES.items() for e in es) + " ELSE 'unknown' END"
_NAME_SQL = "CASE language " + " ".join(f"WHEN '{lang}' THEN regexp_extract(content, '{p}', 1)" for lang, p in X.NAME_PATTERNS.items()) + " ELSE '' END"


def _id_sql(key: str) -> str:
    d = f"sha1(unhex('{X.NAMESPACE}') || encode({key}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST(instr('0123456789abcdef', substr(h, 17, 1)) AS INT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {d} AS h))"


_ENRICHED_SQL = """'File: ' || coalesce(file_path, '') || chr(10) || 'Language: ' || coalesce(language, '') || chr(10)
    || CASE WHEN coalesce(name, '') <> '' THEN CASE chunk_type WHEN 'function' THEN 'Function' WHEN 'block' THEN 'Block' ELSE 'Chunk' END || ': ' || name
            ELSE 'Type: ' || CASE chunk_type WHEN 'function' THEN 'Function' WHEN 'block' THEN 'Block' ELSE 'Chunk' END END
    || chr(10) || chr(10) || coalesce(content, '')"""
#: Words, counts, statistics and weights of chunks, without stems: SQL has no stemmer.
_BM25_SQL = f"""
WITH words AS MATERIALIZED (SELECT chunk_no AS id, {_words_sql(_ENRICHED_SQL)} AS w FROM code_chunks),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
counts AS MATERIALIZED (SELECT id, token, length, count(*) AS tf FROM (SELECT id, len(w) AS length, unnest(w) AS token FROM words) GROUP BY ALL),
idfs AS (SELECT token, count(*) AS df, ln((any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1.0::DOUBLE) AS idf FROM counts, stats GROUP BY token),
weights AS (SELECT id, token, idf * tf * 1.5::DOUBLE / (tf + 0.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl)) AS weight FROM counts JOIN idfs USING (token), stats)
"""
_ASKED_SQL = f"asked AS (SELECT query_id, unnest(list_distinct({_words_sql('query')})) AS token FROM golden_queries)"


def _ranked_sql(source: str, k: int, extra: str = "") -> str:
    return f"SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM ({source}) {extra}) WHERE rank <= {k}"


_SPARSE_SQL = "SELECT query_id, id, sum(weight) AS score FROM weights JOIN asked USING (token) GROUP BY ALL"

# ---- Sources, files and chunks. ----


@query("SELECT file_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT file_id, string_split(content, chr(10)) AS l FROM source_files WHERE content IS NOT NULL)")
def line_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_files").where("content IS NOT NULL").select("file_id", F.posexplode(chunking.lines(F.col("content"))).alias("at", "line"))
    return rows.select("file_id", (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


@query(f"SELECT file_id, {_LANGUAGE_SQL} AS detected FROM source_files")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", CONFIG.language(F.col("file_path")).alias("detected"))


@query(f"""
SELECT file_id, CASE WHEN list_bool_or(list_transform(string_split(file_path, '/')[:-2], lambda x: x LIKE '.%' OR list_contains({_list(SKIP_DIRS)}, x))) THEN 'folder'
    WHEN regexp_extract(file_path, '[^/]*$') LIKE '.%' THEN 'hidden' WHEN {_LANGUAGE_SQL} = 'unknown' THEN 'extension'
    WHEN file_path LIKE '%\\_test.go' ESCAPE '\\' THEN 'pattern' END AS skipped,
    coalesce(content = '' OR position(chr(0) IN left(content, 8000)) > 0, true) AS is_binary
FROM source_files""")
def skip_rules(spark: SparkSession, d: str) -> DataFrame:
    from siltstone.sources.config import binary

    return table(spark, d, "source_files").select("file_id", CONFIG.skipped(F.col("file_path")).alias("skipped"), F.coalesce(binary(F.encode("content", "UTF-8")), F.lit(True)).alias("is_binary"))


@query("SELECT file_id, sha256(content) AS sha, sha256(content) = file_hash AS matches FROM source_files WHERE content IS NOT NULL")
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    sha = F.sha2(F.encode("content", "UTF-8"), 256)
    return table(spark, d, "source_files").where("content IS NOT NULL").select("file_id", sha.alias("sha"), (sha == F.col("file_hash")).alias("matches"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", "repo", "file_path", CONFIG.language(F.col("file_path")).alias("language"), "content")


_WINDOWS_SQL = f"""
WITH files AS (SELECT file_id, repo, file_path, {_LANGUAGE_SQL} AS language, string_split(content, chr(10)) AS l FROM source_files WHERE content IS NOT NULL),
cut AS (SELECT *, unnest(range(0, greatest(len(l) - 5 - 1, 0) + 1, 35)) AS a FROM files),
parts AS (SELECT file_id, repo, file_path, language, array_to_string(l[a + 1 : a + 40], chr(10)) AS content, a + 1 AS start_line, least(a + 40, len(l)) AS end_line FROM cut),
named AS (SELECT *, {_NAME_SQL} AS name FROM parts WHERE regexp_matches(content, '[^\\s\\x0B]'))
"""


@query(_WINDOWS_SQL + f"SELECT file_id, start_line::INT AS start_line, end_line::INT AS end_line, name, CASE WHEN name <> '' THEN 'function' ELSE 'block' END AS chunk_type, {_id_sql('concat_ws(chr(58), coalesce(repo, chr(32)[:0]), file_path, name, start_line)')} AS chunk_id, sha256(content) AS sha FROM named")
def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    cut = chunking.windows(_files(spark, d))
    return cut.select("file_id", "start_line", "end_line", "name", "chunk_type", "chunk_id", F.sha2("content", 256).alias("sha"))


@query(_WINDOWS_SQL + "SELECT repo, language, count(*) AS chunks, count(DISTINCT file_id) AS files FROM named GROUP BY ALL")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return chunking.windows(_files(spark, d)).groupBy("repo", "language").agg(F.count("*").alias("chunks"), F.count_distinct("file_id").alias("files"))


@query()
def go_chunks(spark: SparkSession, d: str) -> DataFrame:
    cut = chunking.go_chunks(_files(spark, d).where("language = 'go'"))
    return cut.select("file_id", "start_line", "end_line", "name", "chunk_type", "chunk_id", F.sha2("content", 256).alias("sha"))


@query()
def all_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(_files(spark, d)).select("file_id", "language", "start_line", "end_line", "name", "chunk_type", "chunk_id")


_LINES_SQL = f"SELECT file_id, {_LANGUAGE_SQL} AS language, unnest(string_split(content, chr(10))) AS line FROM source_files WHERE content IS NOT NULL"


def _cover(files: DataFrame, cut: DataFrame) -> DataFrame:
    """(file_id, non_blank, covered): lines that are not blank, and how many of them lie in a chunk."""
    lines = files.where("content IS NOT NULL").select("file_id", F.posexplode(chunking.lines(F.col("content"))).alias("at", "line")).where(F.regexp_like("line", F.lit(r"\S")))
    lines = lines.select("file_id", (F.col("at") + 1).alias("line_no"))
    inside = cut.select("file_id", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).distinct().withColumn("held", F.lit(1))
    return lines.join(inside, ["file_id", "line_no"], "left").groupBy("file_id").agg(F.count("*").alias("non_blank"), F.count("held").alias("covered"))


@query(f"SELECT file_id, count(*) AS non_blank, count(*) AS covered FROM ({_LINES_SQL}) WHERE language = 'go' AND regexp_matches(line, '[^\\s\\x0B]') GROUP BY file_id")
def go_cover(spark: SparkSession, d: str) -> DataFrame:
    """Functions and the gaps between them leave out no line of a Go file."""
    files = _files(spark, d).where("language = 'go'")
    return _cover(files, chunking.go_chunks(files))


@query(f"SELECT file_id, count(*) AS non_blank, count(*) AS covered FROM ({_LINES_SQL}) WHERE regexp_matches(line, '[^\\s\\x0B]') GROUP BY file_id")
def chunk_cover(spark: SparkSession, d: str) -> DataFrame:
    return _cover(_files(spark, d), chunking.chunks(_files(spark, d)))


@query(_WINDOWS_SQL + "SELECT file_id, start_line::INT AS start_line, (row_number() OVER (PARTITION BY file_id ORDER BY start_line))::INT AS position FROM named")
def chunk_positions(spark: SparkSession, d: str) -> DataFrame:
    return chunking.ordered(chunking.windows(_files(spark, d)), ["file_id"]).select("file_id", "start_line", "position")


@query(f"SELECT chunk_no, {_NAME_SQL} AS extracted FROM code_chunks WHERE content IS NOT NULL")
def extract_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_chunks").where("content IS NOT NULL").select("chunk_no", X.extract_name(F.col("content"), F.col("language")).alias("extracted"))


@query(f"SELECT chunk_no, {_id_sql('concat_ws(chr(58), coalesce(repo, chr(32)[:0]), coalesce(file_path, chr(32)[:0]), coalesce(name, chr(32)[:0]), start_line)')} AS made_id FROM code_chunks")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_chunks").select("chunk_no", X.chunk_id(F.col("repo"), F.col("file_path"), F.col("name"), F.col("start_line")).alias("made_id"))


def _enriched():
    return X.enriched(F.col("file_path"), F.col("language"), F.col("chunk_type"), F.col("name"), F.col("content"))


@query(f"SELECT chunk_no, {_ENRICHED_SQL} AS enriched FROM code_chunks")
def enriched_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_chunks").select("chunk_no", _enriched().alias("enriched"))


# ---- Words, BM25 and sparse search. ----


@query(f"WITH words AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents) SELECT doc_id, len(w)::INT AS words, len(list_distinct(w))::INT AS distinct_words FROM words")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    w = sparse.tokenized(table(spark, d, "documents"), "doc_id", F.col("text"))
    return w.select(F.col("id").alias("doc_id"), F.size("words").alias("words"), F.size(F.array_distinct("words")).alias("distinct_words"))


@query()
def stemmed_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = sparse.tokenized(table(spark, d, "documents"), "doc_id", F.col("text"))
    return sparse.term_counts(w, stems=True).groupBy("token").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("documents"))


@query()
def token_hashes(spark: SparkSession, d: str) -> DataFrame:
    w = sparse.tokenized(table(spark, d, "documents"), "doc_id", F.col("text"))
    return w.select(F.explode("words").alias("token")).distinct().select("token", X.token_hash(F.col("token")).alias("hash"))


def _corpus(spark: SparkSession, d: str, stems: bool) -> tuple[DataFrame, DataFrame]:
    """(term counts, statistics) of the enriched texts of all chunks, which are cut into words once per application."""
    chunks = table(spark, d, "code_chunks")
    base = kept(spark, ("terms", d), lambda: sparse.spread_counts(chunks, "chunk_no", _enriched(), keep=("repo", "language")))
    return sparse.with_stems(base) if stems else base, sparse.stats_of(chunks, "chunk_no", base)


def _idf(spark: SparkSession, d: str, stems: bool) -> DataFrame:
    return sparse.idf(*_corpus(spark, d, stems)).select("token", "df", F.round("idf", 6).alias("idf"))


def _postings(spark: SparkSession, d: str, stems: bool) -> DataFrame:
    """(id, token, repo, language, weight) of all chunks, weighed once per application and then read by every search."""
    return kept(spark, ("postings", d, stems), lambda: sparse.weigh(*_corpus(spark, d, stems)))


def _asked(spark: SparkSession, d: str, stems: bool = False) -> DataFrame:
    q = table(spark, d, "golden_queries").select("query_id", X.words(F.col("query")).alias("words"))
    if not stems:
        return q
    from siltstone.functions.stemmer import stem_column

    flat = q.select("query_id", F.explode_outer("words").alias("w"))
    known = flat.select("w").where("w IS NOT NULL").distinct().withColumn("stem", stem_column("w"))
    both = flat.join(known, "w", "left").select("query_id", F.explode_outer(F.array_compact(F.array_distinct(F.array("w", F.when(~F.col("stem").isin(X.STOP_WORDS), F.col("stem")))))).alias("w"))
    return both.groupBy("query_id").agg(F.collect_set("w").alias("words"))  # one query's words


@query(_BM25_SQL + "SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d, False)[1].select("n", F.round("avgdl", 6).alias("avgdl"))


@query(_BM25_SQL + "SELECT token, df, round(idf, 6) AS idf FROM idfs")
def doc_freq_idf(spark: SparkSession, d: str) -> DataFrame:
    return _idf(spark, d, False)


@query()
def doc_freq_idf_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return _idf(spark, d, True)


@query(_BM25_SQL + "SELECT id AS chunk_no, token, round(weight, 6) AS weight FROM weights")
def bm25_weights(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d, False).select(F.col("id").alias("chunk_no"), "token", F.round("weight", 6).alias("weight"))


@query()
def sparse_vectors(spark: SparkSession, d: str) -> DataFrame:
    return sparse.sparse_vectors(_postings(spark, d, True)).withColumnRenamed("id", "chunk_no")


def _result(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("id").alias("chunk_no"), F.round("score", 6).alias("score"), "rank")


_RESULT_SQL = "SELECT query_id, id AS chunk_no, round(score, 6) AS score, rank::INT AS rank FROM ({})"


@query(_BM25_SQL + ", " + _ASKED_SQL + _RESULT_SQL.format(_ranked_sql(_SPARSE_SQL, K)))
def sparse_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return _result(sparse.search(_asked(spark, d), _postings(spark, d, False), K))


@query()
def sparse_topk_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return _result(sparse.search(_asked(spark, d, True), _postings(spark, d, True), K))


_FILTERED_SQL = """SELECT s.* FROM (SELECT query_id, id, sum(weight) AS score FROM weights JOIN asked USING (token) GROUP BY ALL) s
    JOIN golden_queries g USING (query_id) JOIN code_chunks c ON c.chunk_no = s.id
    WHERE (coalesce(len(filter_languages), 0) = 0 OR list_contains(filter_languages, language)) AND (coalesce(len(filter_repos), 0) = 0 OR list_contains(filter_repos, repo))"""


@query(_BM25_SQL + ", " + _ASKED_SQL + _RESULT_SQL.format(_ranked_sql(_FILTERED_SQL, K)))
def sparse_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The filters of each query hold before the ranking."""
    asked = _asked(spark, d).join(table(spark, d, "golden_queries").select("query_id", "filter_languages", "filter_repos"), "query_id")
    return _result(sparse.search(asked, _postings(spark, d, False), K, filters={"filter_languages": "language", "filter_repos": "repo"}))


# ---- Dense search and fusion. ----


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _probes(v: DataFrame) -> DataFrame:
    """Queries: every vector whose id is divisible by 50, against all vectors."""
    return v.where(F.col("id") % 50 == 0).withColumnRenamed("id", "query_id")


_COSINES_SQL = "SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0"


@query(_RESULT_SQL.format(_ranked_sql(_COSINES_SQL, K)).replace("AS chunk_no", "AS vec_id"))
def dense_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return _result(dense.top_k(_probes(v), v, K)).withColumnRenamed("chunk_no", "vec_id")


@query(_RESULT_SQL.format(_ranked_sql(_COSINES_SQL + " AND q.label = v.label", K)).replace("AS chunk_no", "AS vec_id"))
def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return _result(dense.top_k(_probes(v), v, K, same=["label"])).withColumnRenamed("chunk_no", "vec_id")


@query("""
WITH r AS (SELECT response_id, chunk_nos, embeddings, list_transform(embeddings, lambda v: len(v)) AS s FROM embed_responses)
SELECT response_id, CASE WHEN embeddings IS NULL OR len(embeddings) = 0 THEN 'empty batch' WHEN list_bool_or(list_transform(embeddings, lambda v: v IS NULL OR len(v) = 0)) THEN 'empty vector'
    WHEN list_bool_or(list_transform(s, lambda n: n <> s[1])) THEN 'ragged batch' WHEN s[1] <> 96 THEN 'unexpected dimension' END AS problem,
    coalesce(len(embeddings) = len(chunk_nos), false) AS complete FROM r""")
def vector_validation(spark: SparkSession, d: str) -> DataFrame:
    complete = F.coalesce(F.size("embeddings") == F.size("chunk_nos"), F.lit(False)) & F.col("embeddings").isNotNull()
    return table(spark, d, "embed_responses").select("response_id", dense.validate(F.col("embeddings"), 96).alias("problem"), complete.alias("complete"))


@query("""
SELECT response_id, CASE WHEN chunk_nos IS NULL OR embeddings IS NULL THEN 'missing' WHEN len(chunk_nos) <> len(embeddings) THEN 'different lengths'
    WHEN list_bool_or(list_transform(chunk_nos, lambda x: x IS NULL)) OR list_bool_or(list_transform(embeddings, lambda x: x IS NULL)) THEN 'null entry'
    WHEN len(list_distinct(chunk_nos)) <> len(chunk_nos) THEN 'repeated index' END AS problem FROM embed_responses""")
def parallel_validation(spark: SparkSession, d: str) -> DataFrame:
    """The checks of sparse vectors on the parallel lists of the replies."""
    return table(spark, d, "embed_responses").select("response_id", sparse.validate(F.col("chunk_nos"), F.col("embeddings")).alias("problem"))


@query(_BM25_SQL + "SELECT DISTINCT id AS chunk_no, NULL::VARCHAR AS problem FROM weights")
def sparse_vector_validation(spark: SparkSession, d: str) -> DataFrame:
    return sparse.sparse_vectors(_postings(spark, d, True)).select(F.col("id").alias("chunk_no"), sparse.validate(F.col("indices"), F.col("values")).alias("problem"))


def _chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, vector): one sound vector of each chunk, the smallest if they differ; worked out once per application."""
    return kept(spark, ("vectors", d), lambda: _sound_vectors(spark, d))


def _sound_vectors(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "embed_responses").where("size(chunk_nos) = size(embeddings)")
    v = r.select(F.explode(F.arrays_zip("chunk_nos", "embeddings")).alias("x")).select(F.col("x.chunk_nos").alias("id"), F.col("x.embeddings").alias("vector"))
    v = v.where((F.size("vector") == 96) & F.forall("vector", lambda x: x.isNotNull()) & F.exists("vector", lambda x: x != 0))
    return v.where("id IS NOT NULL").groupBy("id").agg(F.min("vector").alias("vector"))


_CHUNK_VECTORS_SQL = """vectors AS (SELECT id, min(v) AS v FROM (SELECT unnest(chunk_nos) AS id, unnest(embeddings) AS v FROM embed_responses WHERE len(chunk_nos) = len(embeddings))
    WHERE id IS NOT NULL AND len(v) = 96 AND NOT list_bool_or(list_transform(v, lambda x: x IS NULL)) AND list_bool_or(list_transform(v, lambda x: x <> 0)) GROUP BY id)"""
_CHUNK_COSINES_SQL = "SELECT q.id AS query_id, v.id AS id, list_cosine_similarity(q.v, v.v) AS score FROM vectors q JOIN vectors v ON q.id <> v.id WHERE q.id % 50 = 0"


@query("WITH " + _CHUNK_VECTORS_SQL + " " + _RESULT_SQL.format(_ranked_sql(_CHUNK_COSINES_SQL, 2 * K)))
def dense_topk_chunks(spark: SparkSession, d: str) -> DataFrame:
    v = _chunk_vectors(spark, d)
    return _result(dense.top_k(_probes(v), v, 2 * K))


_NAMED_ASKED_SQL = f"asked AS (SELECT chunk_no AS query_id, unnest(list_distinct({_words_sql('name')})) AS token FROM code_chunks WHERE chunk_no % 50 = 0)"


def _branches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rankings of chunks for every chunk whose number is divisible by 50: by its name's words, and by its vector."""
    v = _chunk_vectors(spark, d)
    asked = table(spark, d, "code_chunks").where("chunk_no % 50 = 0").select(F.col("chunk_no").alias("query_id"), X.words(F.col("name")).alias("words"))
    return sparse.search(asked, _postings(spark, d, False), 2 * K), dense.top_k(_probes(v), v, 2 * K)


_RRF_SQL = "SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM e) GROUP BY ALL"


@query(_BM25_SQL + ", " + _NAMED_ASKED_SQL + ", " + _CHUNK_VECTORS_SQL + f", s AS ({_ranked_sql(_SPARSE_SQL, 2 * K)}), e AS ({_ranked_sql(_CHUNK_COSINES_SQL, 2 * K)}) " + _RESULT_SQL.format(_ranked_sql(_RRF_SQL, K)))
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _result(dense.hybrid(*_branches(spark, d), K))


# ---- Change detection and the store's rewrites. ----

_STATES_SQL = """states AS (SELECT repo, file_path, o.h AS file_hash, o.v AS index_version FROM (SELECT repo, file_path, max({'t': coalesce(seen_at::TIMESTAMP, TIMESTAMP '0001-01-01'), 'h': coalesce(file_hash, ''), 'v': coalesce(index_version, '')}) AS o
    FROM file_states WHERE file_path IS NOT NULL AND file_path <> '' GROUP BY repo, file_path))"""


@query("WITH " + _STATES_SQL + " SELECT * FROM states")
def file_states(spark: SparkSession, d: str) -> DataFrame:
    return changes.latest_states(table(spark, d, "file_states"), F.col("seen_at"))


_CLASSES_SQL = f"""WITH {_STATES_SQL}, classes AS (
SELECT coalesce(f.repo, s.repo) AS repo, coalesce(f.file_path, s.file_path) AS file_path, coalesce(f.file_hash, s.file_hash) AS file_hash,
    CASE WHEN s.file_path IS NULL THEN 'new' WHEN f.file_path IS NULL THEN 'stale' WHEN coalesce(f.file_hash <> s.file_hash, true) THEN 'changed'
    WHEN s.index_version <> '{changes.INDEX_VERSION}' THEN 'refresh' ELSE 'unchanged' END AS class
FROM source_files f FULL JOIN states s ON f.repo IS NOT DISTINCT FROM s.repo AND f.file_path = s.file_path)"""


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return changes.classify(table(spark, d, "source_files"), file_states(spark, d))


@query(_CLASSES_SQL + " SELECT * FROM classes")
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d)


@query(_CLASSES_SQL + " SELECT class, count(*) AS files FROM classes GROUP BY class")
def change_counts(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).groupBy("class").agg(F.count("*").alias("files"))


@query(_CLASSES_SQL + " SELECT repo, file_path FROM classes WHERE class = 'stale'")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).where("class = 'stale'").select("repo", "file_path")


#: Files that can be read, against what the stored chunks say of their files: files without chunks are new, others refreshed.
_STORED_CLASSES_SQL = f"""WITH stored AS (SELECT repo, file_path, o.h AS file_hash, o.v AS index_version FROM (SELECT repo, file_path, max({{'t': coalesce(indexed_at::TIMESTAMP, TIMESTAMP '0001-01-01'), 'h': coalesce(file_hash, ''), 'v': coalesce(index_version, '')}}) AS o
    FROM code_chunks WHERE file_path IS NOT NULL AND file_path <> '' GROUP BY repo, file_path)), disk AS (SELECT * FROM source_files WHERE content IS NOT NULL), kinds AS (
SELECT coalesce(f.repo, s.repo) AS repo, coalesce(f.file_path, s.file_path) AS file_path, coalesce(f.file_hash, s.file_hash) AS file_hash,
    CASE WHEN s.file_path IS NULL THEN 'new' WHEN f.file_path IS NULL THEN 'stale' WHEN coalesce(f.file_hash <> s.file_hash, true) THEN 'changed'
    WHEN s.index_version <> '{changes.INDEX_VERSION}' THEN 'refresh' ELSE 'unchanged' END AS class
FROM disk f FULL JOIN stored s ON f.repo IS NOT DISTINCT FROM s.repo AND f.file_path = s.file_path)"""
#: The stored state of each file, against the files that can be read: a file without content is gone.
_READABLE_SQL = f"WITH {_STATES_SQL}, gone AS (SELECT s.repo, s.file_path FROM states s LEFT JOIN (SELECT repo, file_path FROM source_files WHERE content IS NOT NULL) f ON f.repo IS NOT DISTINCT FROM s.repo AND f.file_path = s.file_path WHERE f.file_path IS NULL)"


@query(_STORED_CLASSES_SQL + " SELECT * FROM kinds")
def stored_changes(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "code_chunks")
    return changes.classify(table(spark, d, "source_files").where("content IS NOT NULL"), changes.latest_states(chunks, F.col("indexed_at")))


@query(_STORED_CLASSES_SQL + " SELECT class, count(*) AS files FROM kinds GROUP BY class")
def stored_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return stored_changes(spark, d).groupBy("class").agg(F.count("*").alias("files"))


@query(_READABLE_SQL + " SELECT * FROM gone")
def unreadable_files(spark: SparkSession, d: str) -> DataFrame:
    readable = table(spark, d, "source_files").where("content IS NOT NULL")
    return changes.classify(readable, file_states(spark, d)).where("class = 'stale'").select("repo", "file_path")


_STORED = ["chunk_id", "chunk_no", "repo", "file_path", "file_hash"]


@query("SELECT chunk_id, max(chunk_no) AS chunk_no, arg_max(repo, chunk_no) AS repo, arg_max(file_path, chunk_no) AS file_path, count(*) AS n_rows FROM code_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id")
def upsert_last(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each id in order of arrival, and how many rows it replaces."""
    rows = table(spark, d, "code_chunks").select(*_STORED)
    return changes.last_by_id(rows, "chunk_id", "chunk_no").join(rows.groupBy("chunk_id").agg(F.count("*").alias("n_rows")), "chunk_id").select("chunk_id", "chunk_no", "repo", "file_path", "n_rows")


_LAST_SQL = "last AS (SELECT chunk_id, max(chunk_no) AS chunk_no, arg_max(repo, chunk_no) AS repo, arg_max(file_path, chunk_no) AS file_path, arg_max(file_hash, chunk_no) AS file_hash, arg_max(index_version, chunk_no) AS index_version FROM code_chunks WHERE chunk_id IS NOT NULL {} GROUP BY chunk_id)"


@query(f"""WITH old AS (SELECT * FROM code_chunks WHERE index_version IS DISTINCT FROM '{changes.INDEX_VERSION}'), cur AS (SELECT * FROM code_chunks WHERE index_version = '{changes.INDEX_VERSION}'),
o AS (SELECT chunk_id, max(chunk_no) AS chunk_no FROM old WHERE chunk_id IS NOT NULL GROUP BY chunk_id), c AS (SELECT chunk_id, max(chunk_no) AS chunk_no FROM cur WHERE chunk_id IS NOT NULL GROUP BY chunk_id)
SELECT chunk_id, chunk_no FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM c) UNION ALL SELECT chunk_id, chunk_no FROM c""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of older versions as stored, with those of the current version upserted."""
    rows = table(spark, d, "code_chunks").select(*_STORED, "index_version")
    now = F.coalesce(F.col("index_version") == changes.INDEX_VERSION, F.lit(False))
    stored, arriving = (changes.last_by_id(rows.where(c), "chunk_id", "chunk_no") for c in (~now, now))
    return changes.upsert(stored, arriving, "chunk_id").select("chunk_id", "chunk_no")


@query(_CLASSES_SQL + ", " + _LAST_SQL.format("") + " SELECT chunk_id, chunk_no FROM last l WHERE NOT EXISTS (SELECT 1 FROM classes c WHERE c.class = 'stale' AND c.repo = l.repo AND c.file_path = l.file_path)")
def delete_by_path(spark: SparkSession, d: str) -> DataFrame:
    stored = changes.last_by_id(table(spark, d, "code_chunks").select(*_STORED), "chunk_id", "chunk_no")
    return changes.delete_paths(stored, stale_files(spark, d)).select("chunk_id", "chunk_no")


@query(_READABLE_SQL + ", " + _LAST_SQL.format("") + " SELECT chunk_id, chunk_no FROM last l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo = l.repo AND g.file_path = l.file_path)")
def delete_unreadable(spark: SparkSession, d: str) -> DataFrame:
    stored = changes.last_by_id(table(spark, d, "code_chunks").select(*_STORED), "chunk_id", "chunk_no")
    return changes.delete_paths(stored, unreadable_files(spark, d)).select("chunk_id", "chunk_no")


@query("WITH " + _LAST_SQL.format("") + " SELECT chunk_id, chunk_no FROM last l LEFT JOIN source_files f USING (repo, file_path) WHERE f.file_path IS NULL OR f.file_hash IS NULL OR l.file_hash IS NOT DISTINCT FROM f.file_hash")
def delete_stale_chunks(spark: SparkSession, d: str) -> DataFrame:
    stored = changes.last_by_id(table(spark, d, "code_chunks").select(*_STORED), "chunk_id", "chunk_no")
    return changes.delete_orphans(stored, table(spark, d, "source_files").where("file_hash IS NOT NULL")).select("chunk_id", "chunk_no")


@query("""SELECT query_id, problem FROM (SELECT query_id, CASE WHEN coalesce(query_id, '') = '' THEN 'missing id' WHEN coalesce(query, '') = '' THEN 'empty query'
    WHEN coalesce(query_type, '') <> 'negative' AND coalesce(len(expected_files), 0) = 0 AND coalesce(len(expected_symbols), 0) = 0 THEN 'no expectation' END AS problem FROM golden_queries) WHERE problem IS NOT NULL
UNION ALL SELECT query_id, 'duplicate id' FROM golden_queries WHERE query_id <> '' GROUP BY query_id HAVING count(*) > 1
UNION ALL SELECT NULL, 'no queries' FROM (SELECT count(*) AS n FROM golden_queries) WHERE n = 0""")
def golden_validation(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.invalid_queries(table(spark, d, "golden_queries"))


@query("""WITH asked AS (SELECT a.query_id, a.query, g.query_type, g.expected_files, g.expected_symbols FROM eval_answers a LEFT JOIN golden_queries g USING (query_id))
SELECT query_id, problem FROM (SELECT query_id, CASE WHEN coalesce(query_id, '') = '' THEN 'missing id' WHEN coalesce(query, '') = '' THEN 'empty query'
    WHEN coalesce(query_type, '') <> 'negative' AND coalesce(len(expected_files), 0) = 0 AND coalesce(len(expected_symbols), 0) = 0 THEN 'no expectation' END AS problem FROM asked) WHERE problem IS NOT NULL
UNION ALL SELECT query_id, 'duplicate id' FROM asked WHERE query_id <> '' GROUP BY query_id HAVING count(*) > 1""")
def asked_validation(spark: SparkSession, d: str) -> DataFrame:
    """The questions of all answers, taken for a dataset: ids are missing and repeat."""
    g = table(spark, d, "golden_queries").select("query_id", "query_type", "expected_files", "expected_symbols")
    return evaluate.invalid_queries(table(spark, d, "eval_answers").select("query_id", "query").join(g, "query_id", "left"))


# ---- Evaluation. ----


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    found = sparse.search(_asked(spark, d), _postings(spark, d, False), K)
    own = table(spark, d, "code_chunks").select(F.col("chunk_no").alias("id"), "repo", "file_path", "chunk_type", "name", "content", "start_line", "end_line")
    return found.join(own, "id")


_METRICS_SQL = _BM25_SQL + ", " + _ASKED_SQL + f", found AS ({_ranked_sql(_SPARSE_SQL, K)})" + """,
judged AS (SELECT g.query_id, coalesce(nullif(query_type, ''), 'untyped') AS query_type, expected_files, top1_score_below, f.rank, f.score, c.file_path,
    f.rank IS NOT NULL AND (coalesce(list_contains(expected_files, c.file_path), false) OR coalesce(list_contains(expected_symbols, c.name) AND c.name <> '', false)) AS hit
    FROM golden_queries g LEFT JOIN found f USING (query_id) LEFT JOIN code_chunks c ON c.chunk_no = f.id),
metrics AS (SELECT query_id, any_value(query_type) AS query_type, count(rank) AS results, coalesce(bool_or(hit AND rank <= 1), false) AS hit_1, coalesce(bool_or(hit AND rank <= 3), false) AS hit_3, coalesce(bool_or(hit AND rank <= 5), false) AS hit_5,
    coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE hit AND rank <= 5), 0) AS mrr_5,
    CASE WHEN any_value(len(expected_files)) > 0 THEN count(DISTINCT file_path) FILTER (WHERE rank <= 5 AND list_contains(expected_files, file_path)) / any_value(len(expected_files))::DOUBLE ELSE 0 END AS recall_5,
    CASE WHEN any_value(len(expected_files)) > 0 THEN count(DISTINCT file_path) FILTER (WHERE rank <= 10 AND list_contains(expected_files, file_path)) / any_value(len(expected_files))::DOUBLE ELSE 0 END AS recall_10,
    CASE WHEN any_value(query_type) = 'negative' THEN count(rank) = 0 OR coalesce(any_value(top1_score_below) > 0 AND max(score) FILTER (WHERE rank = 1) < any_value(top1_score_below), false) END AS negative_pass
    FROM judged GROUP BY query_id)
"""
_MEANS_SQL = "count(*) AS queries, count(*) FILTER (WHERE query_type <> 'negative') AS positive, " + ", ".join(f"coalesce(round(avg({c}::DOUBLE) FILTER (WHERE query_type <> 'negative'), 6), 0) AS {c}" for c in ("hit_1", "hit_3", "hit_5", "mrr_5", "recall_5", "recall_10")) + ", round(avg(negative_pass::INT::DOUBLE), 6) AS negative_pass_rate"
_MEANS_SQL = _MEANS_SQL.replace("avg(hit_1::DOUBLE)", "avg(hit_1::INT::DOUBLE)").replace("avg(hit_3::DOUBLE)", "avg(hit_3::INT::DOUBLE)").replace("avg(hit_5::DOUBLE)", "avg(hit_5::INT::DOUBLE)")


@query(_METRICS_SQL + " SELECT query_id, query_type, results, hit_1, hit_3, hit_5, round(mrr_5, 6) AS mrr_5, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, negative_pass FROM metrics")
def eval_per_query(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.per_query(_ranked(spark, d), table(spark, d, "golden_queries"))
    return m.select("query_id", "query_type", "results", "hit_1", "hit_3", "hit_5", *[F.round(c, 6).alias(c) for c in ("mrr_5", "recall_5", "recall_10")], "negative_pass")


@query(_METRICS_SQL + f" SELECT *, round(recall_10 - recall_5, 6) AS recall_gap, round(recall_10 - recall_5, 6) >= 0.1 AS wide_gap FROM (SELECT {_MEANS_SQL} FROM metrics)")
def eval_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.aggregate(evaluate.per_query(_ranked(spark, d), table(spark, d, "golden_queries")))


@query(_METRICS_SQL + f" SELECT query_type, {_MEANS_SQL} FROM metrics GROUP BY query_type")
def eval_by_type(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.by_type(evaluate.per_query(_ranked(spark, d), table(spark, d, "golden_queries")))


_RUN_TIMES_SQL = ", ".join(f"quantile_disc({c}, {p / 100}) FILTER (WHERE error IS NULL) AS {c[:-3]}_p{p}_ms" for c in evaluate.TIMES for p in (50, 95))


@query(_METRICS_SQL + f""", runs AS (SELECT run_id, query_id, max(error) AS error, max(generate_ms) AS total_ms, min(generate_ms) AS embed_ms, max(generate_ms) - min(generate_ms) AS search_ms FROM eval_answers WHERE query_id IS NOT NULL GROUP BY ALL)
SELECT run_id, count(*) AS queries, count(*) FILTER (WHERE error IS NULL AND query_type <> 'negative') AS positive, count(*) FILTER (WHERE error IS NULL AND query_type = 'negative') AS negative, count(*) FILTER (WHERE error IS NOT NULL) AS errors,
    {", ".join(f"coalesce(round(avg({c}::{'INT' if c.startswith('hit') else 'DOUBLE'}::DOUBLE) FILTER (WHERE error IS NULL AND query_type <> 'negative'), 6), 0) AS {c}" for c in ("hit_1", "hit_3", "hit_5", "mrr_5", "recall_5", "recall_10"))},
    coalesce(round(avg(negative_pass::INT::DOUBLE) FILTER (WHERE error IS NULL AND query_type = 'negative'), 6), 0) AS negative_pass_rate, {_RUN_TIMES_SQL}
FROM runs JOIN metrics USING (query_id) GROUP BY run_id""")
def eval_runs(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates of runs with failed queries and times, one per run of the answers: each question counts with its retrieval and its slowest, fastest and spread of times."""
    m = evaluate.per_query(_ranked(spark, d), table(spark, d, "golden_queries"))
    runs = table(spark, d, "eval_answers").where("query_id IS NOT NULL").groupBy("run_id", "query_id")
    runs = runs.agg(F.max("error").alias("error"), F.max("generate_ms").alias("total_ms"), F.min("generate_ms").alias("embed_ms"), (F.max("generate_ms") - F.min("generate_ms")).alias("search_ms"))
    return evaluate.run_aggregate(runs.join(m, "query_id"), ["run_id"])


@query("SELECT run_id, count(generate_ms) AS n, quantile_disc(generate_ms, 0.5) AS p50, quantile_disc(generate_ms, 0.95) AS p95 FROM eval_answers WHERE generate_ms IS NOT NULL GROUP BY run_id")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.percentiles(table(spark, d, "eval_answers"), F.col("generate_ms"), ["run_id"])


# ---- Answers. ----

_CITED_SQL = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '\\[([0-9]+)\\]', 1), lambda x: try_cast(x AS BIGINT)), lambda x: x IS NOT NULL)))"
_FLAGS_SQL = f"""flags AS (SELECT answer_id, len(c)::INT AS n_citations, len(list_filter(c, lambda n: n >= 1 AND n <= k))::INT AS n_valid, (len(c) - len(list_filter(c, lambda n: n >= 1 AND n <= k)))::INT AS n_invalid, w AS is_well_formed, r AS is_refused FROM (
    SELECT answer_id, coalesce(n_chunks, 0) AS k, {_CITED_SQL} AS c, coalesce(regexp_matches(text, '[^\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]'), false) AS w,
    list_bool_or(list_transform({_list(A.REFUSALS)}, lambda m: contains(lower(coalesce(text, '')), m))) AS r FROM eval_answers))"""


@query(f"SELECT answer_id, {_CITED_SQL} AS cited FROM eval_answers")
def answer_citations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_answers").select("answer_id", A.citations(F.col("text")).alias("cited"))


@query(f"WITH {_FLAGS_SQL} SELECT * FROM flags")
def answer_flags(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.answer_flags(table(spark, d, "eval_answers"))


def _rate(yes: str, of: str, name: str) -> str:
    return f"round(count(*) FILTER (WHERE {yes} AND {of}) / nullif(count(*) FILTER (WHERE {of}), 0)::DOUBLE, 6) AS {name}"


_POSITIVE_SQL, _NEGATIVE_SQL = "error IS NULL AND coalesce(query_type, '') <> 'negative'", "error IS NULL AND coalesce(query_type, '') = 'negative'"
_ANSWERS_SQL = f"""WITH {_FLAGS_SQL}, runs AS (SELECT run_id, count(*) FILTER (WHERE error IS NULL) AS generated, count(*) FILTER (WHERE error IS NOT NULL) AS errors,
    {_rate('is_well_formed', 'error IS NULL', 'well_formed_rate')}, {_rate('n_citations > 0', _POSITIVE_SQL, 'cited_rate')}, {_rate('n_invalid = 0', _POSITIVE_SQL + ' AND n_citations > 0', 'all_valid_rate')},
    count(*) FILTER (WHERE error IS NULL AND n_invalid > 0) AS dangling, {_rate('is_refused', _NEGATIVE_SQL, 'refusal_rate')},
    quantile_disc(generate_ms, 0.5) FILTER (WHERE error IS NULL) AS p50_ms, quantile_disc(generate_ms, 0.95) FILTER (WHERE error IS NULL) AS p95_ms
    FROM eval_answers JOIN flags USING (answer_id) LEFT JOIN (SELECT query_id, query_type FROM golden_queries) USING (query_id) GROUP BY run_id)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.answer_aggregate(table(spark, d, "eval_answers"), table(spark, d, "golden_queries"), ["run_id"])


@query(_ANSWERS_SQL + " SELECT * FROM runs")
def answer_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)


_RATES = ["well_formed_rate", "cited_rate", "all_valid_rate", "refusal_rate"]


@query(_ANSWERS_SQL + ", base AS (SELECT " + ", ".join(f"arg_min_null({c}, run_id) AS b_{c}" for c in _RATES) + " FROM runs WHERE run_id IS NOT NULL) SELECT run_id, " + ", ".join(f"{c}, round(({c} - b_{c}) * 100, 4) AS {c}_delta" for c in _RATES) + " FROM runs, base")
def compare_reports(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.compare(_runs(spark, d), "run_id", _RATES)


@query(_BM25_SQL + ", " + _ASKED_SQL + f""", found AS ({_ranked_sql(_SPARSE_SQL, 5)}),
blocks AS (SELECT query_id, string_agg('[' || rank || '] ' || CASE WHEN coalesce(repo, '') <> '' THEN repo || '/' ELSE '' END || coalesce(file_path, '') || ':' || coalesce(start_line, 0) || '-' || coalesce(end_line, 0)
    || CASE WHEN coalesce(name, '') <> '' THEN ', ' || CASE WHEN coalesce(chunk_type, '') = '' THEN 'symbol' ELSE chunk_type END || ': ' || name ELSE '' END || chr(10)
    || CASE WHEN coalesce(content, '') LIKE '%' || chr(10) THEN content ELSE coalesce(content, '') || chr(10) END, chr(10) ORDER BY rank) AS b FROM found JOIN code_chunks ON chunk_no = id GROUP BY query_id)
SELECT query_id, 'Question: ' || coalesce(query, '') || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(b, '(no chunks retrieved)' || chr(10)) || chr(10) || 'Answer the question based on the chunks above.' || chr(10) AS prompt
FROM golden_queries LEFT JOIN blocks USING (query_id)""")
def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d).where("rank <= 5")
    lines = F.format_string("%d-%d", F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(0)))
    block = A.rendered(F.col("rank"), F.col("repo"), F.col("file_path"), lines, F.col("chunk_type"), F.col("name"), F.col("content"))
    blocks = r.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]).alias("blocks"))  # five of each query
    q = table(spark, d, "golden_queries").select("query_id", "query").join(blocks, "query_id", "left")
    return q.select("query_id", A.prompt(F.col("query"), F.col("blocks")).alias("prompt"))


# ---- Watching. ----


@query(f"""
WITH e AS (SELECT repo, seen_at::TIMESTAMP AS t FROM file_states WHERE seen_at IS NOT NULL AND regexp_extract(file_path, '[^/]*$') NOT LIKE '.%' AND {_LANGUAGE_SQL} <> 'unknown' AND file_path NOT LIKE '%\\_test.go' ESCAPE '\\'),
marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY repo ORDER BY t) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY repo ORDER BY t ROWS UNBOUNDED PRECEDING) AS burst FROM marked)
SELECT repo, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS events FROM numbered GROUP BY repo, burst""")
def watch_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of changes of each repository, with a gap that suits the table's times."""
    e = table(spark, d, "file_states").where(watch.relevant(F.col("file_path"), CONFIG))
    b = watch.debounce(e, "seen_at", ["repo"], "6 hours")
    return b.select("repo", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "events")
