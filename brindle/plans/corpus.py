"""Queries of retrieval, windows, incidence, topics and index maintenance, with the SQL they are compared to."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import scalars as S
from brindle.functions.adf import adf_to_text
from brindle.functions.stemming import plain, stem
from brindle.operators import incidence as I
from brindle.operators import index as X
from brindle.operators import retrieval as R
from brindle.operators import topics as T
from brindle.operators import windows as W
from brindle.operators.packed import latest_by
from brindle.sources.tables import checkpoint_dir, table
from brindle.streaming.incremental import activity

QUESTION = "contact sync export drops rows"
K = 10
CUTOFF = "2026-03-01"
STOPWORDS = sorted({*T.FILLER_WORDS, *"the a an and or of to in on for is it we our this that with be as at by from not will was are but than then two one you your they".split()})

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# --- shared inputs -------------------------------------------------------------------------------------------------


def live_records(spark: SparkSession, root: str) -> DataFrame:
    """The latest row of each record id, unless it is deleted."""
    columns = ["deleted_at", "parent_id", "title", "text", "metadata", "source_path", "source_mtime"]
    return latest_by(table(spark, root, "records"), "id", "indexed_at", *columns).where("deleted_at IS NULL").drop("deleted_at")


LIVE = """live AS (SELECT id, parent_id, title, text, metadata, source_path, source_mtime FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, deleted_at DESC NULLS LAST) AS rn FROM records WHERE id IS NOT NULL)
  WHERE rn = 1 AND deleted_at IS NULL)"""


def ticket_rows(spark: SparkSession, root: str) -> DataFrame:
    return latest_by(table(spark, root, "meta"), "TICKET_ID", "LOADED_AT", "TICKET_SUBJECT", "TAG_LIST", "CREATED_AT", "TICKET_STATUS")


TICKETS = """tickets AS (SELECT TICKET_ID, TICKET_SUBJECT, TAG_LIST, CREATED_AT, TICKET_STATUS FROM (
  SELECT *, row_number() OVER (PARTITION BY TICKET_ID ORDER BY LOADED_AT DESC, TICKET_SUBJECT DESC NULLS LAST, TAG_LIST DESC NULLS LAST) AS rn
  FROM meta WHERE TICKET_ID IS NOT NULL) WHERE rn = 1)"""
ASSIGNED = """assigned AS (SELECT record_id, topic_id, probability FROM (SELECT lower(trim(record_id, E' \\t\\n\\r')) AS record_id, topic_id, probability,
  row_number() OVER (PARTITION BY lower(trim(record_id, E' \\t\\n\\r')) ORDER BY loaded_at DESC, topic_id DESC, probability DESC NULLS LAST) AS rn FROM record_topics WHERE record_id IS NOT NULL) WHERE rn = 1)"""
# a JSON array of strings, else no tags
TAGS = """tagged AS (SELECT *, CASE WHEN json_valid(TAG_LIST) AND json_type(CASE WHEN json_valid(TAG_LIST) THEN TAG_LIST ELSE 'null' END) = 'ARRAY'
  THEN list_filter(CAST(TAG_LIST AS JSON)::VARCHAR[], lambda t: t IS NOT NULL AND t <> '') ELSE [] END AS tags FROM tickets)"""


def bm25_sql(phrases: list[list[str]], source: str, id_column: str, fields: list[str], where: str = "", order_limit: str = f"ORDER BY bm25_raw, id LIMIT {K}", prefix: str = "", select: str = "id, round(bm25_raw, 6) AS bm25") -> str:
    """The SQL of a keyword query over ``source``."""
    tokens = ", ".join(f"regexp_extract_all(lower(coalesce({f}, '')), '[\\p{{L}}\\p{{N}}]+') AS f{k}" for k, f in enumerate(fields))

    def occurrences(f: int, phrase: list[str]) -> str:
        test = " AND ".join(f"f{f}[i + {j}] = '{w}'" for j, w in enumerate(phrase))
        return f"len(list_filter(range(1, len(f{f}) + 1), lambda i: {test}))"

    tf = ", ".join(f"{' + '.join(occurrences(k, p) for k in range(len(fields)))} AS t{i}" for i, p in enumerate(phrases))
    df = ", ".join(f"sum((t{i} > 0)::BIGINT) AS n{i}" for i in range(len(phrases)))
    terms = " + ".join(
        f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 0.000001 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
        for i in range(len(phrases))
    )
    found = " OR ".join(f"t{i} > 0" for i in range(len(phrases)))
    length = " + ".join(f"len(f{k})" for k in range(len(fields)))
    return f"""WITH {prefix + "," if prefix else ""} tok AS (SELECT {id_column} AS id, {tokens} FROM {source}),
counted AS (SELECT id, {length} AS dl, {tf} FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM counted),
scored AS (SELECT id, -({terms}) AS bm25_raw FROM counted, st WHERE {found})
SELECT {select} FROM scored {where} {order_limit}"""


_INDEXES: dict[tuple, X.VersionedIndex] = {}


def _index(spark: SparkSession, root: str, name: str) -> X.VersionedIndex:
    """The search index of a table, built in the shared folder the first time a session asks for it, and again when the table's files are others."""
    rows = table(spark, root, name)
    at = rows.select("_metadata.file_path", "_metadata.file_modification_time").groupBy("file_path").agg(F.max("file_modification_time").alias("t"))
    files = at.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("file_path", "t").cast("decimal(38, 0)")), F.lit(0))).first()
    key = (spark.sparkContext.applicationId, name, *map(str, files))
    if key not in _INDEXES:
        index = X.VersionedIndex(spark, f"{checkpoint_dir(spark)}/search-{name}-{uuid4().hex}")
        if name == "records":
            index.publish({"records": live_records(spark, root), **X.search_datasets()})
        else:
            index.publish({"postings": X.postings(rows, "doc_id"), "doc_stats": X.doc_stats(rows, "doc_id")})
        _INDEXES[key] = index
    return _INDEXES[key]


def _keyword(spark: SparkSession, root: str, question: str, stemming: bool = False) -> DataFrame:
    scores = R.index_scores(_index(spark, root, "documents"), question, stemming=stemming)
    return R.top(scores, "bm25", K, ascending=True).select("id", F.round("bm25", 6).alias("bm25"))


def _words(question: str) -> list[list[str]]:
    return R.parse_query(question)


# --- keyword search ------------------------------------------------------------------------------------------------


def _register_keyword(name: str, question: str) -> None:
    @query(name, bm25_sql(_words(question), "documents", "doc_id", ["title", "text"]))
    def run(spark: SparkSession, root: str) -> DataFrame:
        return _keyword(spark, root, question)


_register_keyword("bm25_topk", QUESTION)
_register_keyword("bm25_repeated_token", "webhook webhook relay")
_register_keyword("bm25_common_term_clamp", "the webhook")
_register_keyword("bm25_phrase", "two-step log-in prompt")


@query("bm25_stemmed")
def bm25_stemmed(spark: SparkSession, root: str) -> DataFrame:
    return _keyword(spark, root, "exporting contacts synced", stemming=True)


@query("bm25_topic_filter", bm25_sql(_words(QUESTION), "live", "id", ["title", "text"], where="WHERE id IN (SELECT record_id FROM assigned WHERE topic_id = 1)", prefix=f"{LIVE}, {ASSIGNED}"))
def bm25_topic_filter(spark: SparkSession, root: str) -> DataFrame:
    """The topic restricts the candidates before the top k."""
    allowed = _assigned(spark, root).where("topic_id = 1").select(F.col("record_id").alias("id"))
    scores = R.index_scores(_index(spark, root, "records"), QUESTION, allowed, stemming=False)
    return R.top(scores, "bm25", K, ascending=True).select("id", F.round("bm25", 6).alias("bm25"))


@query("topic_search", bm25_sql(_words("webhook sync contact"), "topics", "topic_id", ["label", "keywords_json", "description"]))
def topic_search(spark: SparkSession, root: str) -> DataFrame:
    scores = R.bm25_scores(table(spark, root, "topics"), "topic_id", "webhook sync contact", fields=("label", "keywords_json", "description"))
    return R.top(scores, "bm25", K, ascending=True).select("id", F.round("bm25", 6).alias("bm25"))


@query(
    "topic_search_rows",
    bm25_sql(_words("webhook sync contact"), "topics", "topic_id", ["label", "keywords_json", "description"], order_limit="ORDER BY bm25, topic_id LIMIT 10", select="topic_id, label, size, keywords_json, round(bm25_raw, 4) AS bm25").replace("FROM scored", "FROM scored JOIN topics ON topics.topic_id = scored.id"),
)
def topic_search_rows(spark: SparkSession, root: str) -> DataFrame:
    """The topics that match a question, with what is known of them."""
    topics = table(spark, root, "topics")
    hits = R.top(R.bm25_scores(topics, "topic_id", "webhook sync contact", fields=("label", "keywords_json", "description")), "bm25", K, ascending=True)
    return topics.join(F.broadcast(hits.withColumnRenamed("id", "topic_id")), "topic_id").select("topic_id", "label", "size", "keywords_json", F.round("bm25", 4).alias("bm25"))  # hits are K rows


@query(
    "query_tokens",
    f"WITH {TICKETS} SELECT TICKET_ID AS ticket_id, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS token FROM (SELECT TICKET_ID, list_filter(list_transform(regexp_extract_all(TICKET_SUBJECT, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*'), lambda x: lower(x)), lambda x: len(x) > 1) AS t FROM tickets WHERE TICKET_SUBJECT IS NOT NULL)",
)
def query_tokens(spark: SparkSession, root: str) -> DataFrame:
    rows = ticket_rows(spark, root).select(F.col("TICKET_ID").alias("ticket_id"), F.posexplode(S.query_tokens(F.col("TICKET_SUBJECT"))).alias("pos", "token"))
    return rows.withColumn("pos", (F.col("pos") + 1).cast("bigint"))


# --- vector and hybrid search --------------------------------------------------------------------------------------

_COS = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _query_vector(spark: SparkSession, root: str, vec_id: int) -> list[float]:
    row = table(spark, root, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row["embedding"]) if row else [0.0] * 64


@query("vector_topk", f"SELECT e.vec_id AS id, round({_COS}, 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, e.vec_id LIMIT {K}")
def vector_topk(spark: SparkSession, root: str) -> DataFrame:
    scores = R.vector_scores(table(spark, root, "embeddings"), "vec_id", "embedding", _query_vector(spark, root, 0))
    return R.top(scores, "cosine", K).select("id", F.round("cosine", 6).alias("cosine"))


@query("vector_topk_topic", f"SELECT e.vec_id AS id, round({_COS}, 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY {_COS} DESC, e.vec_id LIMIT {K}")
def vector_topk_topic(spark: SparkSession, root: str) -> DataFrame:
    scores = R.vector_scores(table(spark, root, "embeddings").where("label = 3"), "vec_id", "embedding", _query_vector(spark, root, 0))
    return R.top(scores, "cosine", K).select("id", F.round("cosine", 6).alias("cosine"))


@query(
    "vector_search",
    f"""SELECT query_id, id, round(c, 6) AS cosine, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COS}, 9) AS c,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= {K}""",
)
def vector_search(spark: SparkSession, root: str) -> DataFrame:
    """Every row whose id is divisible by 20, against all rows."""
    vectors = table(spark, root, "embeddings")
    found = R.vector_search(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", K)
    return found.select("query_id", "id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


def _fused(spark: SparkSession, root: str, stemming: bool = False) -> DataFrame:
    pool = R.pool_size(K)
    v = R.top(R.vector_scores(table(spark, root, "embeddings"), "vec_id", "embedding", _query_vector(spark, root, 7)), "cosine", pool)
    w = R.top(R.index_scores(_index(spark, root, "documents"), QUESTION, stemming=stemming), "bm25", pool, ascending=True)
    return R.fuse(v, w)


_FUSED = (
    bm25_sql(_words(QUESTION), "documents", "doc_id", ["title", "text"], order_limit="ORDER BY bm25_raw, id LIMIT 50", select="id, bm25_raw").replace("WITH  tok", "WITH kw AS (WITH tok")
    + f"""), vec AS (SELECT e.vec_id AS id, {_COS} AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY 2 DESC, 1 LIMIT 50),
v AS (SELECT *, row_number() OVER (ORDER BY cosine DESC, id) - 1 AS vr FROM vec),
w AS (SELECT *, row_number() OVER (ORDER BY bm25_raw, id) - 1 AS wr FROM kw),
fused AS (SELECT coalesce(v.id, w.id) AS id, cosine AS vector_score, bm25_raw AS bm25_score, vr IS NOT NULL AS in_vector, wr IS NOT NULL AS in_keyword,
coalesce(1.0::DOUBLE / (61 + vr), 0) + coalesce(1.0::DOUBLE / (61 + wr), 0) AS rrf, (vr IS NOT NULL AND wr IS NOT NULL) OR coalesce(cosine >= 0.35, FALSE) AS strong FROM v FULL JOIN w ON v.id = w.id)
"""
)


@query("hybrid_rrf", _FUSED + f"SELECT id, round(vector_score, 6) AS vector_score, round(bm25_score, 6) AS bm25_score, in_vector, in_keyword, round(rrf, 6) AS score, strong FROM fused ORDER BY rrf DESC, in_vector DESC, id LIMIT {K}")
def hybrid_rrf(spark: SparkSession, root: str, stemming: bool = False) -> DataFrame:
    page = _fused(spark, root, stemming).orderBy(F.desc("rrf"), F.desc("in_vector"), "id").limit(K)
    return page.select("id", F.round("vector_score", 6).alias("vector_score"), F.round("bm25_score", 6).alias("bm25_score"), "in_vector", "in_keyword", F.round("rrf", 6).alias("score"), "strong")


@query("hybrid_stemmed")
def hybrid_stemmed(spark: SparkSession, root: str) -> DataFrame:
    """As the command line searches: words count by their stems."""
    return hybrid_rrf(spark, root, stemming=True)


@query("strong_weak", _FUSED + f"SELECT sum(strong::BIGINT) AS strong_count, sum((NOT strong)::BIGINT) AS weak_count FROM (SELECT strong FROM fused ORDER BY rrf DESC, in_vector DESC, id LIMIT {K})")
def strong_weak(spark: SparkSession, root: str) -> DataFrame:
    page = _fused(spark, root).orderBy(F.desc("rrf"), F.desc("in_vector"), "id").limit(K)
    return page.agg(F.count_if("strong").alias("strong_count"), F.count_if(~F.col("strong")).alias("weak_count"))


# --- pages of records: date filter, grouping by parent ---------------------------------------------------------------

_DAY = "substr(json_extract_string(metadata, '$.call_date'), 1, 10)"


def _dated_hits(spark: SparkSession, root: str, stemming: bool = False) -> DataFrame:
    """Keyword hits of the calls of a date range; the range is applied before the top k, which then fetches the texts of its few records."""
    index = _index(spark, root, "records")
    records = index.read("records")
    dated = records.where(S.in_date_range(F.get_json_object("metadata", "$.call_date"), "2025-10-01", "2026-04-30")).select("id")
    hits = R.top(R.index_scores(index, QUESTION, dated, stemming), "bm25", 3 * K, ascending=True)
    return records.select("id", "parent_id", "title", "text", "metadata").join(F.broadcast(hits), "id").select(
        "id", "parent_id", "title", "text", "metadata", F.round("bm25", 6).alias("bm25_score"), F.round(-F.col("bm25"), 6).alias("score"), F.lit(False).alias("in_vector"), F.lit(True).alias("in_keyword")
    )  # hits are at most 3 * K rows


_HITS = (
    bm25_sql(_words(QUESTION), "live", "id", ["title", "text"], prefix=LIVE, where=f"WHERE id IN (SELECT id FROM live WHERE TRY_CAST({_DAY} AS DATE) BETWEEN DATE '2025-10-01' AND DATE '2026-04-30')", order_limit=f"ORDER BY bm25_raw, id LIMIT {3 * K}", select="id, bm25_raw")
    .replace("SELECT id, bm25_raw FROM scored WHERE", ", kw AS (SELECT id, bm25_raw FROM scored WHERE")
    + "), hits AS (SELECT kw.id, parent_id, title, text, metadata, round(bm25_raw, 6) AS bm25_score, round(-bm25_raw, 6) AS score FROM kw JOIN live USING (id))\n"
)


@query("search_page", _HITS + f"SELECT id, parent_id, score, substr(text, 1, 500) AS excerpt FROM hits ORDER BY score DESC, id LIMIT {K}")
def search_page(spark: SparkSession, root: str, stemming: bool = False) -> DataFrame:
    return _dated_hits(spark, root, stemming).orderBy(F.desc("score"), "id").limit(K).select("id", "parent_id", "score", F.substring("text", 1, 500).alias("excerpt"))


@query("search_page_stemmed")
def search_page_stemmed(spark: SparkSession, root: str) -> DataFrame:
    return search_page(spark, root, stemming=True)


@query(
    "group_by_parent",
    _HITS
    + f"""SELECT parent_id, max(score) AS score, arg_min(title, (-score, id)) AS title, arg_min(bm25_score, (-score, id)) AS bm25_score, arg_min(metadata, (-score, id)) AS metadata, string_agg(id, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS excerpt_ids
FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, id) AS rn FROM hits) GROUP BY parent_id ORDER BY score DESC, parent_id LIMIT {K}""",
)
def group_by_parent(spark: SparkSession, root: str) -> DataFrame:
    grouped = R.group_by_parent(_dated_hits(spark, root)).orderBy(F.desc("score"), "parent_id").limit(K)
    return grouped.select("parent_id", "score", "title", "bm25_score", "metadata", F.array_join("excerpt_ids", ",").alias("excerpt_ids"))


# --- calls: utterances, windows, voices ------------------------------------------------------------------------------

_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_TEXT = _STRIP.format("text")
_UTTERANCES = f"""u AS (SELECT recordingId, utterance_id, offsetMs, speaker.inMeetingId AS sid, speaker.displayName AS sname, text,
  row_number() OVER (PARTITION BY recordingId ORDER BY offsetMs NULLS LAST, utterance_id) - 1 AS position, count(*) OVER (PARTITION BY recordingId) AS total
  FROM (SELECT DISTINCT recordingId, utterance_id, offsetMs, speaker, text FROM transcript WHERE recordingId IS NOT NULL AND utterance_id IS NOT NULL)),
seats AS (SELECT id, p.inMeetingId AS sid, max(coalesce(nullif(p."type", ''), 'UNKNOWN')) AS role FROM (
  SELECT id, unnest(attributes.participants) AS p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM recording) WHERE rn = 1)
  WHERE p.inMeetingId IS NOT NULL GROUP BY ALL),
lines AS (SELECT u.*, coalesce(role, 'UNKNOWN') AS role, CASE WHEN {_TEXT} <> '' THEN '[' || coalesce(nullif(sname, ''), 'Unknown') || ', ' || coalesce(role, 'UNKNOWN') || ' @ ' ||
  printf('%02d:%02d', greatest(coalesce(offsetMs, 0) // 1000, 0) // 60, greatest(coalesce(offsetMs, 0) // 1000, 0) % 60) || '] ' || {_TEXT} END AS line
  FROM u LEFT JOIN seats ON seats.id = u.recordingId AND seats.sid = u.sid),
w AS (SELECT *, unnest(range(greatest(ceil((position - 19) / 18.0), 0)::BIGINT, least(position // 18, least(ceil(greatest(total - 20, 0) / 18.0), ceil(total / 18.0) - 1)::BIGINT) + 1)) AS chunk_index FROM lines)
"""


@query("utterance_windows", "WITH " + _UTTERANCES + "SELECT recordingId AS recording_id, chunk_index, count(*) AS utterances, min(offsetMs) AS start_ms, max(offsetMs) AS end_ms FROM w GROUP BY ALL")
def utterance_windows(spark: SparkSession, root: str) -> DataFrame:
    rows = W.windows(W.utterances(table(spark, root, "transcript")))
    return rows.groupBy(F.col("recordingId").alias("recording_id"), "chunk_index").agg(F.count("*").alias("utterances"), F.min("offsetMs").alias("start_ms"), F.max("offsetMs").alias("end_ms"))


def _windows(spark: SparkSession, root: str) -> DataFrame:
    return W.window_texts(W.rendered_utterances(table(spark, root, "transcript"), table(spark, root, "recording")))


@query(
    "window_quality",
    "WITH "
    + _UTTERANCES
    + f"""SELECT recording_id, chunk_index, nonspace_chars, unique_tokens, long_utterances, nonspace_chars >= 200 AND unique_tokens >= 30 AND long_utterances >= 1 AS kept FROM (
SELECT recordingId AS recording_id, chunk_index, coalesce(sum(CASE WHEN line IS NOT NULL THEN length(regexp_replace(text, '[\\s\\p{{Z}}]', '', 'g')) END), 0)::BIGINT AS nonspace_chars,
len(list_distinct(flatten(list(CASE WHEN line IS NOT NULL THEN regexp_extract_all(lower(text), '[a-z][a-z''-]+') ELSE [] END)))) AS unique_tokens,
count(*) FILTER (WHERE line IS NOT NULL AND len(list_filter(regexp_split_to_array({_TEXT}, '[\\s\\p{{Z}}]+'), lambda x: x <> '')) >= 5) AS long_utterances FROM w GROUP BY ALL)""",
)
def window_quality(spark: SparkSession, root: str) -> DataFrame:
    return _windows(spark, root).select(F.col("recordingId").alias("recording_id"), "chunk_index", "nonspace_chars", F.col("unique_tokens").cast("bigint").alias("unique_tokens"), "long_utterances", "kept")


@query("render_window", "WITH " + _UTTERANCES + "SELECT 'call:' || recordingId || ':c' || printf('%04d', chunk_index) AS id, coalesce(string_agg(line, chr(10) ORDER BY position), '') AS text FROM w GROUP BY recordingId, chunk_index")
def render_window(spark: SparkSession, root: str) -> DataFrame:
    return _windows(spark, root).select(F.format_string("call:%s:c%04d", "recordingId", "chunk_index").alias("id"), "text")


@query("speaker_roles", "WITH " + _UTTERANCES + "SELECT role, count(*) AS utterances, count(DISTINCT recordingId) AS recordings FROM lines GROUP BY role")
def speaker_roles(spark: SparkSession, root: str) -> DataFrame:
    rows = W.rendered_utterances(table(spark, root, "transcript"), table(spark, root, "recording"))
    return rows.groupBy("role").agg(F.count("*").alias("utterances"), F.countDistinct("recordingId").alias("recordings"))


_LATEST_CALL = "calls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM recording WHERE id IS NOT NULL) WHERE rn = 1)"


@query(
    "call_headers",
    f"""WITH {_LATEST_CALL} SELECT id, CASE WHEN {_STRIP.format('attributes.title')} <> '' THEN attributes.title ELSE 'recording ' || id END || chr(10) || 'account: ' || coalesce(nullif({_STRIP.format('a.name')}, ''), calls.account_id, '') || chr(10) || 'date: ' || CASE WHEN {_STRIP.format('substr(attributes.createdAt, 1, 10)')} <> '' THEN substr(attributes.createdAt, 1, 10) ELSE 'unknown' END || chr(10) || 'participants: ' ||
coalesce(nullif(array_to_string(list_transform(list_filter(attributes.participants, lambda p: p IS NOT NULL), lambda p: coalesce(nullif(p.displayName, ''), nullif(p.firstName, ''), 'Unknown') || ' [' || coalesce(nullif(p."type", ''), 'UNKNOWN') || ']'), ', '), ''), 'unknown') AS header,
nullif(attributes.mediaDurationSeconds, 0) AS duration_seconds FROM calls LEFT JOIN accounts a ON a.account_id = calls.account_id""",
)
def call_headers(spark: SparkSession, root: str) -> DataFrame:
    names = table(spark, root, "accounts").select("account_id", S.strip(F.col("name")).alias("account_name"))
    calls = latest_by(table(spark, root, "recording"), "id", "loaded_at", "account_id", "attributes").join(names, "account_id", "left")
    account = F.coalesce(F.when(F.length("account_name") > 0, F.col("account_name")), F.col("account_id"), F.lit(""))
    header = S.call_header(F.col("id"), F.col("attributes.title"), account, S.date_only(F.col("attributes.createdAt")), S.participants(F.col("attributes.participants")))
    return calls.select("id", header.alias("header"), S.duration_seconds(F.col("attributes.mediaDurationSeconds")).alias("duration_seconds"))


_ROLES = S.ROLE_PATTERN


@query("customer_voice", f"WITH {LIVE} SELECT id, array_to_string(list_sort(r), ',') AS roles, list_has_any(r, ['PROSPECT', 'EXTERNAL']) AS customer_voice FROM (SELECT id, list_distinct(regexp_extract_all(text, '{_ROLES}', 1)) AS r FROM live WHERE text IS NOT NULL)")
def customer_voice(spark: SparkSession, root: str) -> DataFrame:
    return I.voices(live_records(spark, root).where("text IS NOT NULL")).select("id", F.array_join("roles", ",").alias("roles"), "customer_voice")


@query("customer_voice_summary", f"WITH {LIVE} SELECT count(*) AS parents, count(*) FILTER (WHERE v) AS parents_with_customer_voice FROM (SELECT parent_id, bool_or(list_has_any(regexp_extract_all(coalesce(text, ''), '{_ROLES}', 1), ['PROSPECT', 'EXTERNAL'])) AS v FROM live GROUP BY parent_id)")
def customer_voice_summary(spark: SparkSession, root: str) -> DataFrame:
    return I.voice_summary(I.voices(live_records(spark, root)))


@query("speaker_stopwords", """SELECT DISTINCT word FROM (SELECT unnest(list_concat(list_transform(regexp_split_to_array(name, '[\\s\\p{Z}]+'), lambda x: regexp_replace(x, '[^\\p{L}]', '', 'g')), regexp_extract_all(name, '[a-z][a-z]+'))) AS word
FROM (SELECT lower(p.displayName) AS name FROM (SELECT unnest(attributes.participants) AS p FROM recording)) WHERE name IS NOT NULL) WHERE length(word) >= 2""")  # fmt: skip
def speaker_stopwords(spark: SparkSession, root: str) -> DataFrame:
    return T.speaker_words(table(spark, root, "recording").select(F.explode("attributes.participants").alias("p")).select(F.col("p.displayName").alias("name")))


# --- tickets: text, tags, incidence, dates ---------------------------------------------------------------------------


@query("ticket_tags_json", f"WITH {TICKETS}, {TAGS} SELECT TICKET_ID AS ticket_id, array_to_string(tags, '|') AS tags FROM tagged")
def ticket_tags_json(spark: SparkSession, root: str) -> DataFrame:
    return ticket_rows(spark, root).select(F.col("TICKET_ID").alias("ticket_id"), F.array_join(S.json_tags(F.col("TAG_LIST")), "|").alias("tags"))


_SUBJECT = _STRIP.format("TICKET_SUBJECT")


@query(
    "ticket_text",
    f"""WITH {TICKETS}, {TAGS} SELECT TICKET_ID AS ticket_id, coalesce(nullif(concat_ws(chr(10) || chr(10), CASE WHEN len(tags) > 0 THEN '[tags: ' || array_to_string(tags, ', ') || ']' END,
'# ' || nullif({_SUBJECT}, '')), ''), TICKET_ID) AS text FROM tagged""",
)
def ticket_text(spark: SparkSession, root: str) -> DataFrame:
    text = S.ticket_text(F.col("TICKET_ID"), F.col("TICKET_SUBJECT"), S.json_tags(F.col("TAG_LIST")), F.lit(None).cast("string"))
    return ticket_rows(spark, root).select(F.col("TICKET_ID").alias("ticket_id"), text.alias("text"))


def _incidence(spark: SparkSession, root: str) -> DataFrame:
    tags = S.lower_tags(S.json_tags(F.col("TAG_LIST")))
    return ticket_rows(spark, root).select(F.col("TICKET_ID").alias("ticket_id"), "CREATED_AT", I.incidence(tags).alias("incidence"))


def _first(prefix: str) -> str:
    return f"list_filter(t, lambda x: starts_with(x, '{prefix}') AND length(x) > {len(prefix)})[1][{len(prefix) + 1}:]"


def _all(prefix: str) -> str:
    return f"list_transform(list_filter(t, lambda x: starts_with(x, '{prefix}') AND length(x) > {len(prefix)}), lambda x: x[{len(prefix) + 1}:])"


_INCIDENCE = f"""WITH {TICKETS}, {TAGS}, lowered AS (SELECT TICKET_ID AS ticket_id, CREATED_AT, list_transform(tags, lambda x: lower(x)) AS t FROM tagged),
inc AS (SELECT ticket_id, CREATED_AT, t, list_has_any(t, ['icr_internal_note', 'silent_solve', 'forethought_support_triage_skip']) AS is_internal_triage,
CASE WHEN list_contains(t, 'agent_business_impact_p1') THEN 'P1' WHEN list_contains(t, 'agent_business_impact_p2') THEN 'P2' WHEN list_contains(t, 'agent_business_impact_p3') THEN 'P3' WHEN list_contains(t, 'agent_business_impact_p4') THEN 'P4' END AS business_impact,
list_contains(t, 'followup_ticket') AS is_followup, list_contains(t, 'feature_request') AS is_feature_request, {_all("support_topic_")} AS st, {_all("end_user_topic_")} AS et,
{_first("support_resolution_")} AS support_resolution, {_first("crm_topic_")} AS crm_topic, {_first("customer_status_")} AS customer_status FROM lowered)
"""
_DISTINCT = "array_to_string(list_filter({0}, lambda x, i: list_position({0}, x) = i), ',')"


@query("tag_incidence", _INCIDENCE + f"SELECT ticket_id, is_internal_triage, business_impact, is_followup, is_feature_request, {_DISTINCT.format('st')} AS support_topics, {_DISTINCT.format('et')} AS end_user_topics, support_resolution, crm_topic, customer_status FROM inc")
def tag_incidence(spark: SparkSession, root: str) -> DataFrame:
    rows = _incidence(spark, root).select("ticket_id", "incidence.*")
    return rows.withColumn("support_topics", F.array_join("support_topics", ",")).withColumn("end_user_topics", F.array_join("end_user_topics", ","))


_SUMMARY = """SELECT count(*) AS results_returned, count(*) FILTER (WHERE is_internal_triage) AS internal_triage_count, count(*) FILTER (WHERE business_impact = 'P1') AS impact_p1,
count(*) FILTER (WHERE business_impact = 'P2') AS impact_p2, count(*) FILTER (WHERE business_impact = 'P3') AS impact_p3, count(*) FILTER (WHERE business_impact = 'P4') AS impact_p4,
count(*) FILTER (WHERE business_impact IS NULL) AS impact_none, count(*) FILTER (WHERE is_feature_request) AS feature_request_count, count(*) FILTER (WHERE is_followup) AS followup_count,
coalesce(round(count(*) FILTER (WHERE is_internal_triage) / count(*), 4), 0.0) AS internal_triage_pct FROM inc """


@query("incidence_summary", _INCIDENCE + _SUMMARY)
def incidence_summary(spark: SparkSession, root: str) -> DataFrame:
    return I.incidence_summary(_incidence(spark, root))


@query("incidence_without_triage", _INCIDENCE + _SUMMARY + "WHERE NOT is_internal_triage")
def incidence_without_triage(spark: SparkSession, root: str) -> DataFrame:
    return I.incidence_summary(_incidence(spark, root), exclude_triage=True)


@query("date_range_inclusive", f"WITH {TICKETS} SELECT TICKET_ID AS ticket_id, substr(CREATED_AT, 1, 10) AS day FROM tickets WHERE regexp_full_match(substr(CREATED_AT, 1, 10), '\\d{{4}}-\\d\\d-\\d\\d') AND TRY_CAST(substr(CREATED_AT, 1, 10) AS DATE) BETWEEN DATE '2025-12-01' AND DATE '2026-01-31'")
def date_range_inclusive(spark: SparkSession, root: str) -> DataFrame:
    rows = ticket_rows(spark, root).where(S.in_date_range(F.col("CREATED_AT"), "2025-12-01", "2026-01-31"))
    return rows.select(F.col("TICKET_ID").alias("ticket_id"), S.date_only(F.col("CREATED_AT")).alias("day"))


_END = "[\\s\\p{Z}]+$"


@query(
    "rich_text",
    f"""WITH {TICKETS}, {TAGS} SELECT TICKET_ID AS ticket_id, regexp_replace('## ' || regexp_replace(coalesce(TICKET_SUBJECT, ''), '{_END}', '') || chr(10) || chr(10) || coalesce(TICKET_STATUS, '') || chr(10) || chr(10) ||
coalesce(array_to_string(list_transform(list_filter(tags, lambda t: regexp_replace(t, '{_END}', '') <> ''), lambda t: '- ' || regexp_replace(t, '{_END}', '') || chr(10)), ''), ''), '{_END}', '') AS text FROM tagged""",
)
def rich_text(spark: SparkSession, root: str) -> DataFrame:
    """The text of document trees made of the tickets: a heading, a paragraph and a list of the tags."""
    leaf = lambda c: F.to_json(F.struct(F.lit("text").alias("type"), c.alias("text")))
    node = lambda kind, inner, more="": F.concat(F.lit(f'{{"type":"{kind}"{more},"content":['), inner, F.lit("]}"))
    items = F.array_join(F.transform(S.json_tags(F.col("TAG_LIST")), lambda t: node("listItem", node("paragraph", leaf(t)))), ",")
    parts = [node("heading", leaf(F.coalesce("TICKET_SUBJECT", F.lit(""))), ',"attrs":{"level":2}'), node("paragraph", leaf(F.coalesce("TICKET_STATUS", F.lit("")))), node("bulletList", items)]
    return ticket_rows(spark, root).select(F.col("TICKET_ID").alias("ticket_id"), adf_to_text(node("doc", F.concat_ws(",", *parts))).alias("text"))


# --- topics ----------------------------------------------------------------------------------------------------------

_ASSIGNED = f"""WITH {LIVE}, {ASSIGNED},
counts AS (SELECT parent_id, topic_id, count(*) AS n FROM assigned JOIN live ON live.id = assigned.record_id GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY n DESC, topic_id) AS rank, sum(n) OVER (PARTITION BY parent_id) AS total FROM counts),
parents AS (SELECT parent_id, max(topic_id) FILTER (WHERE rank = 1) AS primary_topic_id, max(round(n / total, 4)) FILTER (WHERE rank = 1) AS primary_share, max(total)::BIGINT AS chunk_count,
  coalesce(string_agg(topic_id || ':' || n, ',' ORDER BY rank) FILTER (WHERE rank > 1 AND rank <= 4), '') AS secondary,
  coalesce(string_agg(printf('%.4f', round(n / total, 4)), ',' ORDER BY rank) FILTER (WHERE rank > 1 AND rank <= 4), '') AS secondary_shares FROM ranked WHERE rank <= 4 GROUP BY parent_id)
"""


def _assigned(spark: SparkSession, root: str) -> DataFrame:
    return T.assignments(table(spark, root, "record_topics"))


def _parents(spark: SparkSession, root: str) -> DataFrame:
    return T.parent_topics(_assigned(spark, root), live_records(spark, root))


@query("topic_sizes", _ASSIGNED + "SELECT topic_id, count(*) AS size FROM assigned GROUP BY topic_id")
def topic_sizes(spark: SparkSession, root: str) -> DataFrame:
    return T.topic_sizes(_assigned(spark, root))


@query("topic_label_left_join", _ASSIGNED + "SELECT live.id, a.topic_id, t.label FROM live LEFT JOIN assigned a ON a.record_id = live.id LEFT JOIN topics t ON t.topic_id = a.topic_id")
def topic_label_left_join(spark: SparkSession, root: str) -> DataFrame:
    records = live_records(spark, root).select("id")
    joined = records.join(_assigned(spark, root).withColumnRenamed("record_id", "id"), "id", "left")
    return joined.join(table(spark, root, "topics").select("topic_id", "label"), "topic_id", "left").select("id", "topic_id", "label")


@query("parent_topic_rollup", _ASSIGNED + "SELECT * FROM parents")
def parent_topic_rollup(spark: SparkSession, root: str) -> DataFrame:
    shares = F.array_join(F.transform("secondary_shares", lambda s: F.format_string("%.4f", s)), ",")
    return _parents(spark, root).withColumn("secondary", F.array_join("secondary", ",")).withColumn("secondary_shares", shares)


@query("topic_top_recordings", _ASSIGNED + "SELECT topic_id, rank, parent_id, chunk_count, title FROM (SELECT primary_topic_id AS topic_id, parent_id, chunk_count, row_number() OVER (PARTITION BY primary_topic_id ORDER BY chunk_count DESC, parent_id) AS rank FROM parents) LEFT JOIN (SELECT parent_id, arg_min(title, id) AS title FROM live GROUP BY parent_id) USING (parent_id) WHERE rank <= 10")
def topic_top_recordings(spark: SparkSession, root: str) -> DataFrame:
    return T.top_parents(_parents(spark, root), live_records(spark, root)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "topic_keywords",
    _ASSIGNED
    + f""", toks AS (SELECT topic_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}') AND w NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)})) AS w FROM assigned JOIN live ON live.id = assigned.record_id WHERE text IS NOT NULL),
terms AS (SELECT topic_id, term, count(*) AS tf FROM (SELECT topic_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM toks) GROUP BY ALL),
overall AS (SELECT term, sum(tf) AS f FROM terms GROUP BY term HAVING count(*) >= 2), kept AS (SELECT terms.*, f FROM terms JOIN overall USING (term)),
totals AS (SELECT topic_id, sum(tf) AS total FROM kept GROUP BY topic_id),
scored AS (SELECT topic_id, term, round(sqrt(tf / total) * ln(1 + (SELECT avg(total) FROM totals) / f), 8) AS weight FROM kept JOIN totals USING (topic_id))
SELECT topic_id, rank, term, round(weight, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank FROM scored) WHERE rank <= 15""",
)
def topic_keywords(spark: SparkSession, root: str) -> DataFrame:
    texts = _assigned(spark, root).join(live_records(spark, root).select(F.col("id").alias("record_id"), "text"), "record_id").where("text IS NOT NULL").select("topic_id", "text")
    found = T.class_keywords(texts, STOPWORDS)
    return found.select("topic_id", F.col("rank").cast("bigint").alias("rank"), "term", F.round("weight", 4).alias("weight"))


_KEYWORDS = "CASE WHEN json_valid(keywords_json) THEN CAST(keywords_json AS JSON)::VARCHAR[] ELSE [] END"


@query("topic_labels", f"SELECT topic_id, CASE WHEN topic_id = -1 THEN '(outliers)' WHEN len(k) > 0 THEN array_to_string(k[1:4], ', ') ELSE 'topic ' || topic_id END AS label, array_to_string(k, ',') AS keywords, size FROM (SELECT *, {_KEYWORDS} AS k FROM topics)")
def topic_labels(spark: SparkSession, root: str) -> DataFrame:
    return T.labelled_topics(table(spark, root, "topics"))


_REPS = """, listed AS (SELECT topic_id, CASE WHEN json_valid(representative_ids_json) AND json_type(CASE WHEN json_valid(representative_ids_json) THEN representative_ids_json ELSE 'null' END) = 'ARRAY'
  THEN list_filter(CAST(representative_ids_json AS JSON)::VARCHAR[], lambda x: x IS NOT NULL) ELSE [] END AS ids FROM topics),
firsts AS (SELECT topic_id, list_filter(ids, lambda x, i: list_position(ids, x) = i)[1:3] AS ids FROM listed),
reps AS (SELECT topic_id, unnest(range(1, len(ids) + 1)) AS place, unnest(ids) AS record_id FROM firsts WHERE len(ids) > 0
  UNION ALL SELECT topic_id, rn, record_id FROM (SELECT topic_id, record_id, row_number() OVER (PARTITION BY topic_id ORDER BY record_id) AS rn FROM assigned WHERE topic_id IN (SELECT topic_id FROM firsts WHERE len(ids) = 0)) WHERE rn <= 3)
"""


@query("topic_representatives", _ASSIGNED + _REPS + "SELECT * FROM reps")
def topic_representatives(spark: SparkSession, root: str) -> DataFrame:
    reps = T.representatives(table(spark, root, "topics"), _assigned(spark, root))
    return reps.withColumn("place", F.col("place").cast("bigint"))


@query("largest_topics", "SELECT topic_id, label, size FROM topics WHERE topic_id <> -1 AND size IS NOT NULL ORDER BY size DESC, topic_id LIMIT 5")
def largest_topics(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "topics").where("topic_id <> -1 AND size IS NOT NULL")
    return rows.orderBy(F.desc("size"), "topic_id").limit(5).select("topic_id", "label", "size")


@query(
    "topic_catalog",
    _ASSIGNED
    + _REPS
    + f""", best AS (SELECT topic_id, rank, parent_id, chunk_count, title FROM (SELECT primary_topic_id AS topic_id, parent_id, chunk_count, row_number() OVER (PARTITION BY primary_topic_id ORDER BY chunk_count DESC, parent_id) AS rank FROM parents) LEFT JOIN (SELECT parent_id, arg_min(title, id) AS title FROM live GROUP BY parent_id) USING (parent_id) WHERE rank <= 10),
said AS (SELECT id, {_STRIP.format("replace(text, chr(13), '')")} AS clean FROM live WHERE text IS NOT NULL)
SELECT topic_id, 1 AS part, 0 AS place, '### Topic ' || topic_id || ': ' || coalesce(label, '') || chr(10) || '- **Size**: ' || coalesce(size, 0) || chr(10) || '- **Keywords**: ' || array_to_string(k[1:15], ', ') AS line FROM (SELECT *, {_KEYWORDS} AS k FROM topics)
UNION ALL SELECT topic_id, 2, place, '- `' || record_id || '` - ' || CASE WHEN length(clean) > 600 THEN regexp_replace(substr(clean, 1, 600), '[\\s\\p{{Z}}]+$', '') || '…' ELSE clean END FROM reps JOIN said ON said.id = reps.record_id JOIN topics USING (topic_id)
UNION ALL SELECT topic_id, 3, rank, '- ' || parent_id || ': ' || coalesce(title, '') || ' (' || chunk_count || ' chunks)' FROM best JOIN topics USING (topic_id)""",
)
def topic_catalog(spark: SparkSession, root: str) -> DataFrame:
    topics, records, assigned = table(spark, root, "topics"), live_records(spark, root), _assigned(spark, root)
    return T.catalog_lines(topics, T.representatives(topics, assigned), records, T.top_parents(T.parent_topics(assigned, records), records)).withColumn("place", F.col("place").cast("bigint")).drop("order")


@query("topic_clusters")
def topic_clusters(spark: SparkSession, root: str) -> DataFrame:
    return T.cluster(table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), k=20).select("id", "topic_id")


@query("hash_sample", "SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':42'), vec_id) AS rank FROM embeddings) WHERE rank <= 5")
def hash_sample(spark: SparkSession, root: str) -> DataFrame:
    return T.hash_sample(table(spark, root, "embeddings"), "label", "vec_id", 5).select("label", "vec_id", F.col("rank").cast("bigint").alias("rank"))


# --- index maintenance -----------------------------------------------------------------------------------------------


def _manifests(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    records = table(spark, root, "records").where("source_path IS NOT NULL")
    disk = records.where("deleted_at IS NULL").groupBy("source_path").agg(F.max("source_mtime").alias("mtime"))
    return disk, records.where(F.col("indexed_at") < CUTOFF).groupBy("source_path").agg(F.max("indexed_at").alias("mtime"))


_MANIFESTS = f"""WITH d AS (SELECT source_path, max(source_mtime) AS m FROM records WHERE source_path IS NOT NULL AND deleted_at IS NULL GROUP BY ALL),
i AS (SELECT source_path, max(indexed_at) AS m FROM records WHERE source_path IS NOT NULL AND indexed_at < TIMESTAMP '{CUTOFF}' GROUP BY ALL),
plan AS (SELECT coalesce(d.source_path, i.source_path) AS source_path, CASE WHEN i.m IS NULL THEN 'new' WHEN d.m IS NULL THEN 'deleted' WHEN d.m > i.m THEN 'changed' ELSE 'unchanged' END AS state FROM d FULL JOIN i ON d.source_path = i.source_path)
"""


@query("plan_build", _MANIFESTS + "SELECT * FROM plan")
def plan_build(spark: SparkSession, root: str) -> DataFrame:
    return X.plan_build(*_manifests(spark, root))


@query("stale_delete", _MANIFESTS + "SELECT count(*) AS records, count(DISTINCT id) AS ids FROM records WHERE source_path IS NOT NULL AND source_path NOT IN (SELECT source_path FROM plan WHERE state IN ('deleted', 'changed'))")
def stale_delete(spark: SparkSession, root: str) -> DataFrame:
    gone = X.plan_build(*_manifests(spark, root)).where("state IN ('deleted', 'changed')")
    kept = X.without_sources(table(spark, root, "records").where("source_path IS NOT NULL"), gone)
    return kept.agg(F.count("*").alias("records"), F.countDistinct("id").alias("ids"))


@query("upsert_snapshot", f"WITH {TICKETS} SELECT TICKET_ID AS id, TICKET_STATUS AS status, CREATED_AT AS created_at FROM tickets")
def upsert_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """An older snapshot of tickets takes up the exports since; as if built from all at once."""
    meta = table(spark, root, "meta")
    columns = ("TICKET_SUBJECT", "TAG_LIST", "CREATED_AT", "TICKET_STATUS")
    old, new = (latest_by(meta.where(test), "TICKET_ID", "LOADED_AT", *columns) for test in (F.col("LOADED_AT") < CUTOFF, F.col("LOADED_AT") >= CUTOFF))
    return X.upsert(old, new, "TICKET_ID").select(F.col("TICKET_ID").alias("id"), F.col("TICKET_STATUS").alias("status"), F.col("CREATED_AT").alias("created_at"))


@query("index_counts", f"WITH {LIVE} SELECT count(*) AS record_count, count(DISTINCT parent_id) AS parent_count, count(DISTINCT source_path) AS source_file_count FROM live")
def index_counts(spark: SparkSession, root: str) -> DataFrame:
    return X.index_counts(live_records(spark, root))


@query(
    "posting_stats",
    f"""WITH {LIVE}, toks AS (SELECT id, 'title' AS field, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) AS term FROM live UNION ALL
SELECT id, 'text', unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) FROM live) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM toks GROUP BY term""",
)
def posting_stats(spark: SparkSession, root: str) -> DataFrame:
    return X.term_stats(_index(spark, root, "records").read("postings"), "term")


@query("stem_stats")
def stem_stats(spark: SparkSession, root: str) -> DataFrame:
    return X.term_stats(_index(spark, root, "records").read("postings"))


_PLACED = " UNION ALL ".join(f"SELECT id, '{f}' AS field, unnest(regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}]+')) AS term, unnest(range(len(regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}]+')))) AS position FROM live WHERE {f} IS NOT NULL" for f in ("title", "text"))


@query("term_postings", f"WITH {LIVE}, placed AS ({_PLACED}) SELECT term, id, field, string_agg(position, ',' ORDER BY position) AS positions FROM placed WHERE term IN ('contact', 'sync', 'export', 'drops', 'rows') GROUP BY term, id, field")
def term_postings(spark: SparkSession, root: str) -> DataFrame:
    """The postings of a question's words; the stems are pushed to the scan of the index."""
    words = [w for p in R.parse_query(QUESTION) for w in p]
    rows = _index(spark, root, "records").read("postings").where(F.col("stem").isin([stem(plain(w)) for w in words]) & F.col("term").isin(words))
    return rows.select("term", "id", "field", F.array_join("positions", ",").alias("positions"))


@query("record_lengths", f"WITH {LIVE} SELECT id, coalesce(len(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')), 0) + coalesce(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')), 0) AS words FROM live")
def record_lengths(spark: SparkSession, root: str) -> DataFrame:
    return _index(spark, root, "records").read("doc_stats").select("id", F.col("dl").cast("bigint").alias("words"))


# --- events: JSON columns and streaming ------------------------------------------------------------------------------


@query("json_metadata", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum FROM events GROUP BY event_type")
def json_metadata(spark: SparkSession, root: str) -> DataFrame:
    props = F.from_json("props", "struct<k: bigint>")
    return table(spark, root, "events").select("event_type", props.alias("p")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k_sum"))


_ACTIVITY = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL"


@query("event_activity", _ACTIVITY)
def event_activity(spark: SparkSession, root: str) -> DataFrame:
    return activity(table(spark, root, "events"))


@query("stream_activity", _ACTIVITY)
def stream_activity(spark: SparkSession, root: str) -> DataFrame:
    """The same counts from a stream over the files, finished windows written in update batches and read back."""
    work = f"{checkpoint_dir(spark)}/activity-{uuid4().hex}"
    schema = table(spark, root, "events").schema
    single = _single_file(spark, root)
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if single else "*").parquet(root if single else f"{root}/events.parquet")
    # a watermark needs an instant: the zoneless times are read as UTC
    stream = files.withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{work}/out/{batch_id}")

    run = activity(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{work}/out")
    newest = rows.groupBy("window_start", "event_type").agg(F.max(F.struct("batch_id", "n", "value")).alias("m"))
    return newest.select(F.from_utc_timestamp("window_start", F.current_timezone()).cast("timestamp_ntz").alias("window_start"), "event_type", "m.n", "m.value")


def _single_file(spark: SparkSession, root: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/events.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
