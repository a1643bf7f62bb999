"""Keyword (BM25), vector and hybrid retrieval over a table of records.

The plans follow one shape: score, keep the top k by ``TakeOrderedAndProject``, and only then
join the columns to show. Corpus statistics of a query's few terms are one aggregate without a
shuffle of tokens, or come from an inverted index, of which a question reads only its own terms.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.scalars import QUERY_WORD, dot, index_tokens
from brindle.functions.stemming import plain, stem, vocabulary
from brindle.operators.index import VersionedIndex
from brindle.sources.tables import cut

K1, B = 1.2, 0.75
RRF_K = 60
MIN_SCORE = 0.35
POOL_FACTOR, POOL_LEAST = 5, 50
ROW_BLOCK, QUERY_BLOCK, TILE = 65_536, 8_192, 2_048


def parse_query(question: str) -> list[list[str]]:
    """Phrases of a question: each token of two characters and more, parted at ``'`` and ``-``; repeats kept."""
    tokens = [t.lower() for t in re.findall(QUERY_WORD, question) if len(t) > 1]
    return [re.split(r"['-]", t) for t in tokens]


def pool_size(k: int) -> int:
    """Candidates per source for a page of k."""
    return max(POOL_FACTOR * k, POOL_LEAST)


Phrase = list[list[str]]  # the words allowed at each place


def stem_forms(docs: DataFrame, fields: tuple[str, ...], phrases: list[Phrase]) -> list[Phrase]:
    """The phrases with every word of the index that has the stem of theirs, diacritics aside.

    The vocabulary is made distinct and stemmed in the tasks; only the forms of the question's few stems come back.
    """
    wanted = {w: stem(plain(w)) for p in phrases for forms in p for w in forms}
    tokens = docs.select(F.explode(F.concat(*[index_tokens(F.col(c)) for c in fields])).alias("term"))
    forms: dict[str, list[str]] = {}
    for row in vocabulary(tokens).where(F.col("stem").isin(sorted(set(wanted.values())))).collect():
        forms.setdefault(row["stem"], []).append(row["term"])
    return [[sorted({w, *forms.get(wanted[w], [])}) for places in p for w in places] for p in phrases]


def phrase_count(tokens: Column, phrase: Phrase) -> Column:
    """Occurrences of a phrase in one field."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t.isin(phrase[0])))
    tail = lambda k: F.slice(tokens, F.lit(k + 1), F.greatest(F.size(tokens), F.lit(1)))
    among = lambda array, words: F.transform(array, lambda t: t.isin(words))
    test = among(tokens, phrase[0])
    for k, words in enumerate(phrase[1:], 1):  # the k-th word after each place; null behind the end
        test = F.zip_with(test, among(tail(k), words), lambda a, b: a & F.coalesce(b, F.lit(False)))
    return F.size(F.filter(test, lambda x: x))


def bm25_scores(docs: DataFrame, id_column: str, question: str, fields: tuple[str, ...] = ("title", "text"), allowed: DataFrame | None = None, stemming: bool = False) -> DataFrame:
    """``(id, bm25)`` of the documents with a term of the question; lower is better.

    Statistics cover all documents; ``allowed`` (ids, in a column named like ``id_column``) then restricts the
    hits before the top k. A phrase lies within one field. A term in half of the
    documents or more weighs 1e-6. Null fields hold no words; repeats in the question count again; a
    question without words finds nothing.
    """
    phrases: list[Phrase] = [[[w] for w in p] for p in parse_query(question)]
    if stemming and phrases:
        phrases = stem_forms(docs, fields, phrases)
    n = len(phrases)

    def figures(doc: Column) -> Column:
        tokens = [doc[f"f{k}"] for k in range(len(fields))]
        total = lambda columns: sum(columns[1:], columns[0])
        return F.struct(total([F.size(f) for f in tokens]).alias("dl"), *[total([phrase_count(f, p) for f in tokens]).alias(f"t{i}") for i, p in enumerate(phrases)])

    # as the variable of a lambda, a document's tokens are made once, however many terms read them
    doc = F.struct(*[index_tokens(F.col(c)).alias(f"f{k}") for k, c in enumerate(fields)])
    counted = docs.select(F.col(id_column).alias("id"), F.transform(F.array(doc), figures)[0].alias("d")).select("id", "d.*")
    counted = cut(counted)  # a few numbers a document, read twice: the texts are read once
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"t{i}") > 0).cast("bigint")).alias(f"n{i}") for i in range(n)])
    found = F.lit(False)
    for i in range(n):
        found = found | (F.col(f"t{i}") > 0)
    hits = counted.where(found)
    if allowed is not None:
        hits = hits.join(allowed.select(F.col(id_column).alias("id")), "id", "left_semi")
    score = functools.reduce(lambda a, b: a + b, [_bm25(F.col(f"n{i}"), F.col(f"t{i}"), F.col("dl"), F.col("n"), F.col("avgdl")) for i in range(n)], F.lit(0.0))
    return hits.crossJoin(F.broadcast(stats)).select("id", score.alias("bm25"))  # stats is one row


def _bm25(count: Column, term: Column, length: Column, docs: Column, mean_length: Column) -> Column:
    """What one phrase adds to a score (lower is better), from the documents that hold it, its occurrences and the lengths."""
    idf = F.log((docs - count + 0.5) / (count + 0.5))
    return -F.when(idf <= 0, 1e-6).otherwise(idf) * term * (K1 + 1) / (term + K1 * (1 - B + B * length / mean_length))


def posting_scores(postings: DataFrame, doc_count: int, token_count: int, question: str, allowed: DataFrame | None = None, stemming: bool = True) -> DataFrame:
    """``(id, bm25)`` as ``bm25_scores``, from an inverted index: only the postings of the question's stems are read.

    ``doc_count`` and ``token_count`` are those of the whole index; ``allowed`` holds ids in a column ``id``.
    """
    phrases = parse_query(question)
    words = list(dict.fromkeys(w for p in phrases for w in p))
    if not words or not doc_count:
        return postings.select("id", F.lit(0.0).alias("bm25")).limit(0)
    stems = {w: stem(plain(w)) for w in words}
    is_word = {w: F.col("stem") == stems[w] if stemming else F.col("term") == w for w in words}
    rows = postings.where(F.col("stem").isin(sorted(set(stems.values()))))
    if not stemming:
        rows = rows.where(F.col("term").isin(words))
    at = {w: F.flatten(F.collect_list(F.when(is_word[w], F.col("positions")))) for w in words}  # the places in one field of one record
    fields = rows.select("id", "field", "dl", "stem", "term", "positions").repartition("id").groupBy("id", "field").agg(F.first("dl").alias("dl"), *[c.alias(f"w{j}") for j, c in enumerate(at.values())])
    column = {w: F.col(f"w{j}") for j, w in enumerate(words)}

    def occurrences(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return F.size(column[phrase[0]])
        following = lambda p: [F.array_contains(column[w], p + k) for k, w in enumerate(phrase[1:], 1)]
        return F.size(F.filter(column[phrase[0]], lambda p: functools.reduce(lambda a, b: a & b, following(p))))

    n = len(phrases)
    counted = cut(fields.select("id", "dl", *[occurrences(p).alias(f"t{i}") for i, p in enumerate(phrases)]).groupBy("id").agg(F.first("dl").alias("dl"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(n)]))
    stats = counted.agg(*[F.count_if(F.col(f"t{i}") > 0).alias(f"n{i}") for i in range(n)])
    hits = counted.where(functools.reduce(lambda a, b: a | b, [F.col(f"t{i}") > 0 for i in range(n)]))
    if allowed is not None:
        hits = hits.join(allowed.select("id"), "id", "left_semi")
    parts = [_bm25(F.col(f"n{i}"), F.col(f"t{i}"), F.col("dl"), F.lit(doc_count), F.lit(token_count / doc_count)) for i in range(n)]
    return hits.crossJoin(F.broadcast(stats)).select("id", functools.reduce(lambda a, b: a + b, parts, F.lit(0.0)).alias("bm25"))  # stats is one row


def index_scores(index: VersionedIndex, question: str, allowed: DataFrame | None = None, stemming: bool = True) -> DataFrame:
    """``posting_scores`` of a published index."""
    facts = index.manifest()
    return posting_scores(index.read("postings"), facts["doc_count"], facts["token_count"], question, allowed, stemming)


def top(scores: DataFrame, column: str, k: int, ascending: bool = False) -> DataFrame:
    """The k best rows, ties by id."""
    return scores.orderBy(F.col(column).asc() if ascending else F.col(column).desc(), "id").limit(k)


def vector_scores(vectors: DataFrame, id_column: str, vector_column: str, query: list[float]) -> DataFrame:
    """``(id, cosine)`` against one query vector; both sides of length one. Null vectors are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("id"), dot(F.col(vector_column), q).alias("cosine"))


def vector_search(vectors: DataFrame, queries: DataFrame, id_column: str, vector_column: str, k: int, dim: int = 64, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, id, cosine, rank)``: exact top k of every query against all rows.

    Rows and queries are dealt into blocks by a hash, and each pair of a row block and a query block is one group of bounded size
    that keeps k rows per query; the best k of all blocks remain. Null vectors are left out, ties go to the smaller id.
    """
    side = lambda df: df.where(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<float>").alias("vec"))
    rows, asked = side(vectors), side(queries)
    down, across = max(1, -(-rows.count() // row_block)), max(1, -(-asked.count() // query_block))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.select("id", "vec", F.lit(False).alias("asks"), own(down).alias("low"), every(across).alias("high")).unionByName(asked.select("id", "vec", F.lit(True).alias("asks"), every(down).alias("low"), own(across).alias("high")))

    def nearest(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group.column("asks").to_numpy()
        x = pc.list_flatten(group.column("vec")).to_numpy().astype(np.float64).reshape(-1, dim)
        ids = group.column("id").to_numpy()
        order = np.argsort(ids[~asks], kind="stable")
        who, x, m, query = ids[~asks][order], x[~asks][order], x[asks], ids[asks]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(m) if len(x) else 0, TILE):
            best_score, best_at = np.full((len(m[a : a + TILE]), 0), -np.inf), np.zeros((len(m[a : a + TILE]), 0), np.int64)
            for b in range(0, len(x), TILE):
                s = np.round(m[a : a + TILE] @ x[b : b + TILE].T, 9)
                score, at = np.hstack([best_score, s]), np.hstack([best_at, np.broadcast_to(np.arange(b, b + s.shape[1]), s.shape)])
                if score.shape[1] > k:  # only what reaches the k-th best, with its ties, is sorted; rows are in order of id, so ties go to the smaller one
                    least = np.partition(score, -k, axis=1)[:, -k]
                    first = np.stack([(f := np.flatnonzero(row >= t))[np.argsort(-row[f], kind="stable")[:k]] for row, t in zip(score, least)])
                else:
                    first = np.argsort(-score, axis=1, kind="stable")
                best_score, best_at = np.take_along_axis(score, first, 1), np.take_along_axis(at, first, 1)
            n = best_at.shape[1]
            out.append((np.repeat(query[a : a + TILE], n), who[best_at.ravel()], best_score.ravel()))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "cosine"), columns)))

    found = dealt.groupBy("low", "high").applyInArrow(nearest, "query_id bigint, id bigint, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def ranked(hits: DataFrame, column: str, ascending: bool, name: str) -> DataFrame:
    """Zero-based position of each hit of one source; the hits are a top-k list, so one task ranks them."""
    order = [F.col(column).asc() if ascending else F.col(column).desc(), F.col("id").asc()]
    return hits.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Reciprocal rank fusion of two top-k lists: ``(id, vector_score, bm25_score, in_vector, in_keyword, rrf, strong)``."""
    v = ranked(vector_hits, "cosine", False, "vector_rank")
    w = ranked(keyword_hits, "bm25", True, "keyword_rank")
    part = lambda rank: F.coalesce(1.0 / (F.col(rank) + RRF_K + 1), F.lit(0.0))
    return v.join(w, "id", "full_outer").select(
        "id",
        F.col("cosine").alias("vector_score"),
        F.col("bm25").alias("bm25_score"),
        F.col("vector_rank").isNotNull().alias("in_vector"),
        F.col("keyword_rank").isNotNull().alias("in_keyword"),
        (part("vector_rank") + part("keyword_rank")).alias("rrf"),
        (F.col("vector_rank").isNotNull() & F.col("keyword_rank").isNotNull() | F.coalesce(F.col("cosine") >= min_score, F.lit(False))).alias("strong"),
    )


def group_by_parent(hits: DataFrame, excerpts: int = 3, shown: int = 500) -> DataFrame:
    """One row per parent of scored hits ``(id, parent_id, title, text, score, in_vector, in_keyword)``.

    Best score, membership flags by OR, title of the best hit, and up to three excerpts in order of rank; of ``metadata``,
    ``vector_score`` and ``bm25_score``, where the hits have them, those of the best hit.
    The hits are a top-k list, which bounds the lists collected here.
    """
    more = [c for c in ("metadata", "vector_score", "bm25_score") if c in hits.columns]
    hit = F.struct((-F.col("score")).alias("order"), F.col("id"), F.col("title"), F.substring("text", 1, shown).alias("text"), *more)
    grouped = hits.groupBy("parent_id").agg(
        F.max("score").alias("score"),
        F.bool_or("in_vector").alias("in_vector"),
        F.bool_or("in_keyword").alias("in_keyword"),
        F.array_sort(F.collect_list(hit)).alias("hits"),
    )
    return grouped.select(
        "parent_id", "score", "in_vector", "in_keyword",
        F.col("hits")[0]["title"].alias("title"),
        *[F.col("hits")[0][c].alias(c) for c in more],
        F.transform(F.slice("hits", 1, excerpts), lambda h: h["id"]).alias("excerpt_ids"),
        F.transform(F.slice("hits", 1, excerpts), lambda h: h["text"]).alias("excerpts"),
    )
