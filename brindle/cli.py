"""Command line: build an index of a corpus, search it, build its topics and their catalog, summarise incidence.

Exit codes: 0 done, 2 wrong usage or state, 130 interrupted. Answers are JSON lines.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import scalars as S
from brindle.operators import incidence, retrieval, topics
from brindle.operators.embedding import embedded, provider
from brindle.operators.index import VersionedIndex, plan_build, search_datasets, upsert, without_sources
from brindle.operators.windows import window_texts
from brindle.sources.corpora import CORPORA, stopword_file, unreadable
from brindle.sources.shipping import ship
from brindle.sources.tables import cut
from brindle.streaming.incremental import index_facts

PIPELINE_VERSION = 1


class Usage(Exception):
    pass


def parse_day(value: str | None) -> str | None:
    """``yyyy-mm-dd``, or nothing for a blank one."""
    if value is None or not value.strip():
        return None
    try:
        return date.fromisoformat(value.strip()).isoformat()
    except ValueError as e:
        raise Usage(f"not a date: {value}") from e


def flattened(spark: SparkSession, corpus: str, root: str) -> DataFrame:
    """Records of a corpus: tickets and requests whole, calls in windows of utterances that pass the quality gate."""
    docs = CORPORA[corpus](spark, root)
    if corpus != "call_transcripts":
        return docs.select("id", F.col("id").alias("parent_id"), "title", "text", F.to_json("metadata").alias("metadata"), "source_path", "source_mtime")
    said = docs.select("id", F.col("metadata.participants").alias("people"), F.posexplode("utterances").alias("position", "u"), F.size("utterances").alias("total"))
    role = F.try_element_at(F.transform(F.filter("people", lambda p: p["id"] == F.col("u.speaker.inMeetingId")), lambda p: p["role"]), F.lit(1))
    blank = F.coalesce(F.length(S.strip(F.col("u.text"))) == 0, F.lit(True))
    lines = said.withColumn("role", F.coalesce(role, F.lit("UNKNOWN"))).select(
        F.col("id").alias("recordingId"), "position", "total", F.col("u.offsetMs").alias("offsetMs"), F.col("u.durationMs").alias("durationMs"), F.col("u.text").alias("text"), "role",
        F.when(~blank, S.speaker_line(F.col("u.speaker.displayName"), F.col("role"), F.col("u.offsetMs"), F.col("u.text"))).alias("line"),
    )
    kept = window_texts(lines).where("kept").withColumnRenamed("recordingId", "parent_id")
    heads = docs.select(F.col("id").alias("parent_id"), "title", "metadata", "source_path", "source_mtime")
    chunk = [
        F.col("chunk_index"), F.col("first_ms").alias("chunk_start_ms"), F.col("last_ms").alias("chunk_end_ms"), S.mmss(F.col("first_ms")).alias("chunk_start_mmss"), S.mmss(F.col("last_ms")).alias("chunk_end_mmss"),
        F.col("roles").alias("chunk_speakers"), F.col("utterances").alias("chunk_utterance_count"),
    ]
    return kept.join(heads, "parent_id").select(
        F.format_string("%s:c%04d", "parent_id", "chunk_index").alias("id"), "parent_id", "title", "text", F.to_json(F.struct("metadata.*", *chunk)).alias("metadata"), "source_path", "source_mtime"
    )


def provider_options(a: argparse.Namespace) -> dict[str, object]:
    return {"http": {"url": a.url, "model": a.model}, "model": {"model": a.model}}.get(a.provider, {})


def build(spark: SparkSession, a: argparse.Namespace) -> dict:
    index = VersionedIndex(spark, f"{a.index}/{a.corpus}")
    sources = CORPORA[a.corpus](spark, a.root).select("source_path", F.col("source_mtime").alias("mtime"))
    known = index.current() is not None and not a.fresh
    stored = index.read("sources") if known else sources.limit(0)
    changed = known and index.manifest().get("pipeline_version") != PIPELINE_VERSION
    plan = plan_build(sources, stored, changed)
    counts = {r["state"]: r["count"] for r in plan.groupBy("state").count().collect()}
    bad = unreadable(spark, a.corpus, a.root).count()
    if bad:
        print(f"{bad} files of {a.corpus} cannot be read and are left out", file=sys.stderr)
        counts["unreadable"] = bad
    if a.check or a.dry_run:
        return counts | ({"records": flattened(spark, a.corpus, a.root).count()} if a.dry_run else {})
    todo = plan.where("state IN ('new', 'changed')").select("source_path")
    again = index.read("skipped").select("source_path") if a.retry_skipped and known and index.has("skipped") else todo.limit(0)
    todo = todo.unionByName(again.join(plan.where("state = 'unchanged'"), "source_path", "left_semi")).distinct().orderBy("source_path")
    todo = todo.limit(a.limit) if a.limit else todo
    fresh = flattened(spark, a.corpus, a.root).join(todo, "source_path", "left_semi")
    vectors = embedded(fresh, "id", "text", provider(a.provider, **provider_options(a)))
    fresh = fresh.join(vectors.select("id", "embedding", "error"), "id", "left")
    records = fresh
    if known:
        gone = plan.where("state = 'deleted'").select("source_path").unionByName(todo)
        kept = without_sources(index.read("records"), gone)
        records = upsert(kept, fresh.select(kept.columns))
    unchanged = plan.where("state = 'unchanged'").select("source_path").join(todo, "source_path", "left_anti")
    done = sources.join(todo, "source_path", "left_semi").unionByName(stored.join(unchanged, "source_path", "left_semi"))
    meta = {"corpus": a.corpus, "provider": a.provider, "model": a.model, "pipeline_version": PIPELINE_VERSION}
    version = index.publish({"records": records, **search_datasets(), "sources": done, "skipped": lambda written: written.where("error IS NOT NULL").select("id", "source_path", "error")}, meta, keep=not a.fresh)
    return counts | {"version": version} | {k: v for k, v in index.manifest().items() if k.endswith("_count")}


def allowed_ids(index: VersionedIndex, records: DataFrame, a: argparse.Namespace) -> DataFrame | None:
    """Ids of the records that the filters leave; nothing without a filter."""
    start, end = parse_day(a.date_from), parse_day(a.date_to)
    field = {"call_transcripts": "$.call_date", "support_tickets": "$.created_at"}.get(a.corpus)
    if (start or end) and not field:
        raise Usage(f"{a.corpus} has no dates to filter by")
    allowed = records.where(S.in_date_range(F.get_json_object("metadata", field), start, end)).select("id") if start or end else None
    if a.topic:
        members = index.read("record_topics").where(F.col("topic_id").isin(a.topic)).select(F.col("record_id").alias("id"))
        if not members.limit(1).count():
            raise Usage("no record has these topics")
        allowed = members if allowed is None else allowed.join(members, "id", "left_semi")
    return allowed


def ranked_page(spark: SparkSession, index: VersionedIndex, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """``(hits with their texts, records)`` of a question, best first."""
    records = index.read("records")
    allowed = allowed_ids(index, records, a)
    pool = retrieval.pool_size(a.k)
    keyword = retrieval.top(retrieval.index_scores(index, a.question, allowed), "bm25", pool, ascending=True)
    if a.mode != "keyword":
        query = embedded(spark.createDataFrame([("q", a.question)], "id string, text string"), "id", "text", provider(a.provider, **provider_options(a)), prefix="search_query: ").first()["embedding"]
        vectors = records if allowed is None else records.join(allowed, "id", "left_semi")
        near = retrieval.top(retrieval.vector_scores(vectors, "id", "embedding", query), "cosine", pool)
    else:
        near = spark.createDataFrame([], "id string, cosine double")
    fused = retrieval.fuse(near, keyword if a.mode != "vector" else keyword.limit(0), a.min_score)
    score = {"vector": F.col("vector_score"), "keyword": -F.col("bm25_score")}.get(a.mode, F.col("rrf"))
    page = fused.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), F.desc("in_vector"), "id").limit(3 * a.k)
    return records.select("id", "parent_id", "title", "text", "metadata").join(F.broadcast(page), "id"), records  # a page is 3 * k rows


def rows_of(df: DataFrame) -> list[dict]:
    """The rows of one page."""
    return [json.loads(x) for x in df.toJSON().collect()]


def search(spark: SparkSession, a: argparse.Namespace) -> list[dict] | dict:
    index = VersionedIndex(spark, f"{a.index}/{a.corpus}")
    if a.topic_search:
        return topic_answer(index, a)
    hits, _ = ranked_page(spark, index, a)
    if a.group:
        return rows_of(retrieval.group_by_parent(hits).orderBy(F.desc("score"), "parent_id").limit(a.k))
    chunk = {k: F.get_json_object("metadata", f"$.{k}").alias(k) for k in CHUNK_FIELDS} if a.corpus == "call_transcripts" else {}
    page = hits.orderBy(F.desc("score"), "id").limit(a.k).withColumn("text", F.substring("text", 1, 500))
    return rows_of(page.select(*[c for c in page.columns if c != "metadata"], *chunk.values()))


CHUNK_FIELDS = ("chunk_index", "chunk_start_ms", "chunk_end_ms", "chunk_start_mmss", "chunk_end_mmss", "chunk_speakers", "chunk_utterance_count")


def topic_answer(index: VersionedIndex, a: argparse.Namespace) -> list[dict]:
    """The topics that match a question by their words, each with its representatives and its largest parents."""
    described, records = index.read("topics"), index.read("records")
    scores = retrieval.top(retrieval.bm25_scores(described, "topic_id", a.question, fields=("label", "keywords_json", "description"), stemming=True), "bm25", a.k, ascending=True)
    found = described.join(F.broadcast(scores.withColumnRenamed("id", "topic_id")), "topic_id")  # k rows
    reps = topics.representatives(found, index.read("record_topics")).join(records.select(F.col("id").alias("record_id"), "title"), "record_id", "left")
    best = topics.top_parents(index.read("parent_topics").join(found.select(F.col("topic_id").alias("primary_topic_id")), "primary_topic_id", "left_semi"), records)
    listed = reps.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "record_id", "title"))), lambda x: F.struct(x["record_id"].alias("record_id"), x["title"].alias("title"))).alias("representatives"))
    largest = best.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "parent_id", "title", "chunk_count"))).alias("top_recordings"))
    shown = found.join(listed, "topic_id", "left").join(largest, "topic_id", "left").withColumn("bm25", F.round("bm25", 4))
    return rows_of(shown.orderBy("bm25", "topic_id").select("topic_id", "label", "size", "keywords_json", "bm25", "representatives", "top_recordings"))


def build_topics(spark: SparkSession, a: argparse.Namespace) -> dict:
    from pyspark.ml.feature import StopWordsRemover

    index = VersionedIndex(spark, f"{a.index}/{a.corpus}")
    records = index.read("records")
    assigned = cut(topics.cluster(records.select("id", "embedding"), a.topics, a.least, sample=a.sample).withColumnRenamed("id", "record_id"))
    words = spark.createDataFrame([(w,) for w in {*StopWordsRemover.loadDefaultStopWords("english"), *topics.FILLER_WORDS, *a.stopword}], "word string")
    if a.stopwords_file:
        words = words.unionByName(stopword_file(spark, a.stopwords_file))
    names = F.from_json(F.get_json_object("metadata", "$.participants"), "array<struct<name: string>>")
    words = words.unionByName(topics.speaker_words(records.select(F.explode(names).alias("p")).select("p.name")))
    texts = assigned.join(records.select(F.col("id").alias("record_id"), "text"), "record_id").where("text IS NOT NULL")
    keywords = topics.class_keywords(texts.select("topic_id", "text"), words)
    lists = keywords.groupBy("topic_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])).alias("keywords_json"))
    typical = topics.top_n(assigned.where(F.col("topic_id") != topics.OUTLIERS), "topic_id", 3, [F.desc("probability"), F.col("record_id")])
    ids = typical.groupBy("topic_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "record_id"))), lambda x: x["record_id"])).alias("representative_ids_json"))
    described = topics.topic_sizes(assigned).join(lists, "topic_id", "left").join(ids, "topic_id", "left")
    named = described.join(topics.labelled_topics(described).select("topic_id", "label"), "topic_id").withColumn("description", F.lit(None).cast("string"))
    version = index.publish({"topics": named, "record_topics": assigned, "parent_topics": topics.parent_topics(assigned, records)}, index_facts(index))
    answer = {"version": version, "topics": index.read("topics").count()}
    if a.inspect:  # a few texts of the largest topics, the same in every run
        largest = named.where(F.col("topic_id") != topics.OUTLIERS).orderBy(F.desc("size"), "topic_id").limit(5).select("topic_id")
        drawn = topics.hash_sample(index.read("record_topics").join(largest, "topic_id", "left_semi"), "topic_id", "record_id", a.inspect)
        shown = drawn.join(records.select(F.col("id").alias("record_id"), S.snippet(F.col("text"), 800).alias("text")), "record_id")
        answer["samples"] = rows_of(shown.orderBy("topic_id", "rank").select("topic_id", "record_id", "text"))
    return answer


def catalog(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Writes the Markdown catalog of the topics: a head, a table with links, and a part per topic."""
    index = VersionedIndex(spark, f"{a.index}/{a.corpus}")
    described, records, assigned = index.read("topics"), index.read("records"), index.read("record_topics")
    body = topics.catalog_lines(described, topics.representatives(described, assigned), records, topics.top_parents(index.read("parent_topics"), records))
    lines = topics.catalog_head(described).select(F.lit(0).alias("part"), "n", "line").unionByName(body.select(F.lit(1).alias("part"), F.row_number().over(topics.catalog_order()).alias("n"), "line"))
    lines.orderBy("part", "n").select("line").coalesce(1).write.mode("overwrite").text(a.out)  # a report of topics, not of records
    return {"catalog": a.out, "topics": described.count()}


def summarise(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Incidence of the whole corpus, or of a question's hits, each with what its tags or speakers say."""
    index = VersionedIndex(spark, f"{a.index}/{a.corpus}")
    rows = index.read("records")
    if a.question:
        rows = ranked_page(spark, index, a)[0].orderBy(F.desc("score"), "id").limit(a.k)
    if a.corpus == "support_tickets":
        tags = S.lower_tags(F.coalesce(F.from_json(F.get_json_object("metadata", "$.tags"), "array<string>"), F.array().cast("array<string>")))
        judged = rows.withColumn("incidence", incidence.incidence(tags))
        total = incidence.incidence_summary(judged, a.exclude_triage)
        shown = judged.where("NOT incidence.is_internal_triage") if a.exclude_triage else judged
    else:
        voiced = incidence.voices(rows)
        total, shown = incidence.voice_summary(voiced), rows.join(voiced.drop("parent_id"), "id")
    answer = total.first().asDict()
    if not a.question:
        return answer
    wanted = [c for c in ("id", "parent_id", "title", "score", "incidence", "roles", "customer_voice") if c in shown.columns]
    return {"summary": answer, "hits": rows_of(shown.orderBy(F.desc("score"), "id").select(*wanted))}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="brindle")
    sub = p.add_subparsers(dest="command", required=True)
    for name, run in (("build", build), ("search", search), ("topics", build_topics), ("catalog", catalog), ("incidence", summarise)):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        s.add_argument("--corpus", required=True, choices=sorted(CORPORA))
        s.add_argument("--index", required=True)
        if name == "build":
            s.add_argument("--root", required=True)
            s.add_argument("--limit", type=int)
            for flag in ("check", "dry-run", "fresh", "retry-skipped"):
                s.add_argument(f"--{flag}", action="store_true")
        if name in ("build", "search", "incidence"):
            s.add_argument("--provider", default="hashing")
            s.add_argument("--model", default="")
            s.add_argument("--url", default="http://localhost:11434")
        if name == "search":
            s.add_argument("question")
            s.add_argument("--group", action="store_true")
            s.add_argument("--topic-search", action="store_true")
        if name == "incidence":
            s.add_argument("--question")
        if name in ("search", "incidence"):
            s.add_argument("--topic", type=int, action="append")
            s.add_argument("--k", type=int, default=20)
            s.add_argument("--mode", choices=("hybrid", "vector", "keyword"), default="hybrid")
            s.add_argument("--min-score", type=float, default=retrieval.MIN_SCORE)
            s.add_argument("--date-from")
            s.add_argument("--date-to")
        if name == "topics":
            s.add_argument("--topics", type=int, default=20)
            s.add_argument("--least", type=int, default=10)
            s.add_argument("--sample", type=float)
            s.add_argument("--inspect", type=int, default=0)
            s.add_argument("--stopword", action="append", default=[])
            s.add_argument("--stopwords-file")
        if name == "catalog":
            s.add_argument("--out", required=True)
        if name == "incidence":
            s.add_argument("--exclude-triage", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("brindle").getOrCreate()
    ship(session)
    try:
        print(json.dumps(a.run(session, a), default=str))
        return 0
    except (Usage, FileNotFoundError, ValueError) as e:
        print(json.dumps({"error": str(e)}))
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
