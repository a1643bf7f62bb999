"""Raw folders of the three corpora as DataFrames of logical documents.

Every scan is a lazy file-source plan with an explicit schema; path parts and modification times
come from ``_metadata``. A main file that cannot be read is dropped (``unreadable`` lists those), a missing or broken
sidecar counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.adf import adf_to_text
from brindle.functions.scalars import call_header, change_text, date_only, duration_seconds, json_tags, participants, strip, ticket_text

TICKET = "TICKET_ID string, TICKET_SUBJECT string, TICKET_STATUS string, TICKET_PRIORITY string, TAG_LIST string, JIRA_KEY string, JIRA_STATUS string, JIRA_PRIORITY string, ORGANIZATION_ID string, REQUESTER_EMAIL string, REQUESTER_NAME string, ASSIGNEE_ID string, ASSIGNED_TO string, GROUP_NAME string, VIA_CHANNEL string, CREATED_AT string, UPDATED_AT string, SAT_SCORE int"
RECORDING = "id string, type string, attributes struct<title: string, createdAt: string, mediaDurationSeconds: string, participantCount: bigint, recordingUrl: string, participants: array<struct<inMeetingId: bigint, displayName: string, firstName: string, type: string>>>"
TRANSCRIPT = "recordingId string, utterances array<struct<offsetMs: bigint, durationMs: bigint, speaker: struct<inMeetingId: bigint, displayName: string>, text: string>>"
CHANGE = "key string, id string, summary string, status string, priority string, customer_priority string, issuetype string, assignee string, reporter string, resolution string, account_name string, contact_email string, labels array<string>, components array<string>, created string, updated string, description string, workaround string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files, one record each; broken ones have ``_corrupt_record``."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return spark.read.text(path, wholetext=True).select(
        parsed.alias("r"), F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_modification_time").alias("source_mtime")
    ).select("r.*", "source_path", "source_mtime")


def _text(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1).alias("folder"), F.col("value").alias(name), F.col("_metadata.file_modification_time").alias(f"{name}_mtime")
    )


def _folder(levels_up: int = 1) -> Column:
    return F.regexp_extract("source_path", rf"^(.*)(?:/[^/]*){{{levels_up}}}$", 1)


def _part(n: int) -> Column:
    """The n-th directory name from the end of the path."""
    return F.element_at(F.split("source_path", "/"), -(n + 1))


def _exists(spark: SparkSession, glob: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _sidecar(spark: SparkSession, glob: str, name: str) -> DataFrame:
    if _exists(spark, glob):
        return _text(spark, glob, name)
    return spark.createDataFrame([], f"folder string, {name} string, {name}_mtime timestamp")


def limited(sources: DataFrame, n: int | None) -> DataFrame:
    """The first n sources in order of path; all without a limit."""
    return sources if n is None else sources.orderBy("source_path").limit(n)


def support_tickets(spark: SparkSession, root: str) -> DataFrame:
    """``<yyyymm>/<ticket>/meta.json`` with ``body.md``: one document per ticket."""
    meta = _json(spark, f"{root}/*/*/meta.json", TICKET).where("_corrupt_record IS NULL").withColumn("folder", _folder())
    body = _sidecar(spark, f"{root}/*/*/body.md", "body")
    joined = meta.join(body, "folder", "left")
    ticket, tags = F.coalesce("TICKET_ID", _part(1)), json_tags(F.col("TAG_LIST"))
    return joined.select(
        F.concat(F.lit("support:"), ticket).alias("id"),
        F.col("TICKET_SUBJECT").alias("title"),
        ticket_text(ticket, F.col("TICKET_SUBJECT"), tags, F.col("body")).alias("text"),
        F.struct(
            F.col("TICKET_SUBJECT").alias("subject"), F.col("TICKET_STATUS").alias("status"), F.col("TICKET_PRIORITY").alias("priority"), tags.alias("tags"), F.col("JIRA_KEY").alias("jira_key"), F.col("JIRA_STATUS").alias("jira_status"), F.col("JIRA_PRIORITY").alias("jira_priority"), F.col("ORGANIZATION_ID").alias("organization_id"), F.col("REQUESTER_EMAIL").alias("requester_email"), F.col("REQUESTER_NAME").alias("requester_name"), F.col("ASSIGNEE_ID").alias("assignee_id"), F.col("ASSIGNED_TO").alias("assigned_to"), F.col("GROUP_NAME").alias("group_name"), F.col("VIA_CHANNEL").alias("via_channel"), date_only(F.col("CREATED_AT")).alias("created_at"), date_only(F.col("UPDATED_AT")).alias("updated_at"), _part(2).alias("partition"), F.col("SAT_SCORE").alias("sat_score"),
        ).alias("metadata"),
        "source_path",
        F.greatest("source_mtime", F.coalesce("body_mtime", "source_mtime")).alias("source_mtime"),
    )


def call_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """``<account>/<yyyymm>/<recording>/transcript.json`` with ``recording.json`` and ``name.txt``: one document per call, with its utterances."""
    main = _json(spark, f"{root}/*/*/*/transcript.json", TRANSCRIPT).where("_corrupt_record IS NULL").withColumn("folder", _folder()).withColumn("account_folder", _folder(3))
    if _exists(spark, f"{root}/*/*/*/recording.json"):
        side = _json(spark, f"{root}/*/*/*/recording.json", RECORDING).withColumn("folder", _folder()).select("folder", "attributes", F.col("source_mtime").alias("side_mtime"))
    else:
        side = main.select("folder", F.lit(None).cast(RECORDING.split("attributes ")[1].replace(": ", ":")).alias("attributes"), F.col("source_mtime").alias("side_mtime")).where("false")
    names = _sidecar(spark, f"{root}/*/name.txt", "account_name").withColumnRenamed("folder", "account_folder")
    joined = main.join(side, "folder", "left").join(names, "account_folder", "left")
    recording, account = F.coalesce("recordingId", _part(1)), _part(3)
    people, day = participants(F.col("attributes.participants")), date_only(F.col("attributes.createdAt"))
    name = F.coalesce(strip(F.col("account_name")), F.lit(""))
    title = F.coalesce(F.when(F.length(strip(F.col("attributes.title"))) > 0, F.col("attributes.title")), F.concat(F.lit("recording "), recording))
    return joined.select(
        F.concat(F.lit("call:"), recording).alias("id"),
        title.alias("title"),
        call_header(recording, title, F.coalesce(F.when(name != "", name), account), day, people).alias("text"),
        F.struct(account.alias("account_id"), name.alias("account_name"), recording.alias("recording_id"), day.alias("call_date"), duration_seconds(F.col("attributes.mediaDurationSeconds")).alias("duration_seconds"), F.col("attributes.participantCount").alias("participant_count"), people.alias("participants"), F.col("attributes.title").alias("recording_title"), F.col("attributes.recordingUrl").alias("recording_url")).alias("metadata"),
        F.col("utterances"),
        "source_path",
        F.greatest("source_mtime", "side_mtime", "account_name_mtime").alias("source_mtime"),
    )


def cr_tickets(spark: SparkSession, root: str) -> DataFrame:
    """``CR-*.json`` in one folder: one document per change request."""
    rows = _json(spark, f"{root}/CR-*.json", CHANGE).where("_corrupt_record IS NULL")
    key = F.coalesce("key", F.regexp_extract("source_path", r"([^/]+)\.json$", 1))
    return rows.select(
        F.concat(F.lit("cr:"), key).alias("id"),
        F.col("summary").alias("title"),
        change_text(key, F.col("summary"), adf_to_text(F.col("description")), adf_to_text(F.col("workaround"))).alias("text"),
        F.struct("status", "priority", "customer_priority", "issuetype", "assignee", "reporter", "resolution", "account_name", "contact_email", "labels", "components", date_only(F.col("created")).alias("created"), date_only(F.col("updated")).alias("updated"), F.col("id").alias("jira_id")).alias("metadata"),
        "source_path",
        "source_mtime",
    )


MAIN_FILES = {"support_tickets": ("*/*/meta.json", TICKET), "call_transcripts": ("*/*/*/transcript.json", TRANSCRIPT), "cr_tickets": ("CR-*.json", CHANGE)}


def unreadable(spark: SparkSession, corpus: str, root: str) -> DataFrame:
    """``(source_path)`` of the main files of a corpus that are no JSON of its shape and so give no document."""
    glob, schema = MAIN_FILES[corpus]
    return _json(spark, f"{root}/{glob}", schema).where("_corrupt_record IS NOT NULL").select("source_path")


def stopword_file(spark: SparkSession, path: str) -> DataFrame:
    """One lower-case word per line; blank lines and those behind ``#`` are left out."""
    word = F.lower(strip(F.col("value")))
    return spark.read.text(path).select(word.alias("word")).where("word <> '' AND NOT word LIKE '#%'").distinct()


CORPORA = {"support_tickets": support_tickets, "call_transcripts": call_transcripts, "cr_tickets": cr_tickets}
