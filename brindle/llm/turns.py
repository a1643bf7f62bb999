"""Speech transcripts into clean, ordered speaker turns."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from brindle.llm.speech import label_key, person_keys, read_utterance
from brindle.sources.tables import cut, spread

CHUNK_MS = 600_000
NO_TIME, NO_ID = 1 << 52, 1 << 53
IDS_A_CHUNK = 4096
TIMING, CUE, DIALOGUE = 3, 2, 1

_READ = StructType([StructField("cue_ms", LongType()), StructField("label_key", StringType()), StructField("name_key", StringType()), StructField("spoken", StringType())])


def _reader(words: bool) -> Callable:
    """Reads texts with the names of their speakers; without ``words`` the spoken ones are only marked."""

    @F.pandas_udf(_READ)
    def read(text: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = []
        for t, n in zip(text, name):
            at, label, spoken = read_utterance(t, words)
            rows.append((at, label_key(label), label_key(n), spoken))
        return pd.DataFrame(rows, columns=["cue_ms", "label_key", "name_key", "spoken"]).astype({"cue_ms": "Int64"})

    return read


def _plain_reader(words: bool) -> Callable:
    """Reads texts whose speaker is given by id."""

    @F.pandas_udf("cue_ms long, spoken string")
    def read(text: pd.Series) -> pd.DataFrame:
        rows = [read_utterance(t, words) for t in text]
        return pd.DataFrame([(at, spoken) for at, _, spoken in rows], columns=["cue_ms", "spoken"]).astype({"cue_ms": "Int64"})

    return read


@F.pandas_udf(ArrayType(StringType()))
def _keys(name: pd.Series) -> pd.Series:
    return name.map(person_keys)


def people(transcript: DataFrame, recording: DataFrame) -> DataFrame:
    """``(recordingId, name_key, speaker_id)``: the keys that name exactly one person of a recording.

    People are known from the participant lists of all versions of the recording and from
    utterances that carry both an id and a name.
    """
    listed = recording.select(F.col("id").alias("recordingId"), F.explode("attributes.participants").alias("p")).select(
        "recordingId", F.col("p.inMeetingId").alias("speaker_id"), F.explode(F.array("p.displayName", "p.firstName")).alias("name")
    )
    heard = transcript.select("recordingId", F.col("speaker.inMeetingId").alias("speaker_id"), F.col("speaker.displayName").alias("name"))
    names = listed.unionByName(heard).where("recordingId IS NOT NULL AND speaker_id IS NOT NULL AND length(trim(name)) > 0").distinct()
    return (
        names.select("recordingId", "speaker_id", F.explode(_keys("name")).alias("name_key"))
        .groupBy("recordingId", "name_key")
        .agg(F.min("speaker_id").alias("speaker_id"), F.max("speaker_id").alias("other"))
        .where("speaker_id = other")
        .drop("other")
    )


def clean_utterances(transcript: DataFrame, recording: DataFrame, words: bool = True) -> DataFrame:
    """``(recordingId, utterance_id, at_ms, cue_ms, offsetMs, end_ms, speaker_id, spoken)`` of the utterances that hold spoken words.

    Utterances without a recording are left out. Only those without an
    ``inMeetingId`` look up a person, first by display name, then by the label in the text; the others are not shuffled
    for it. Without ``words`` the spoken ones are ``?`` for a question and ``.`` else.
    """
    said = spread(transcript.where("recordingId IS NOT NULL").select("recordingId", "utterance_id", "offsetMs", "durationMs", "speaker", "text"), "utterance_id")
    given = said.where("speaker.inMeetingId IS NOT NULL").select("recordingId", "utterance_id", "offsetMs", "durationMs", F.col("speaker.inMeetingId").alias("speaker_id"), _plain_reader(words)("text").alias("r"))
    asked = said.where("speaker.inMeetingId IS NULL").select("recordingId", "utterance_id", "offsetMs", "durationMs", _reader(words)("text", F.col("speaker.displayName")).alias("r"))
    # one row per recording, bounded by its people
    known = people(transcript, recording).groupBy("recordingId").agg(F.map_from_entries(F.collect_list(F.struct("name_key", "speaker_id"))).alias("known"))
    named = lambda key: F.try_element_at("known", F.col(f"r.{key}"))
    found = asked.where("r.spoken IS NOT NULL").join(known, "recordingId", "left").withColumn("speaker_id", F.coalesce(named("name_key"), named("label_key")))
    columns = ("recordingId", "utterance_id", "offsetMs", "durationMs", "speaker_id", "r.cue_ms", "r.spoken")
    rows = given.where("r.spoken IS NOT NULL").select(*columns).unionByName(found.select(*columns))
    at = F.coalesce("offsetMs", "cue_ms")
    length = F.when(F.col("durationMs") > 0, F.col("durationMs")).otherwise(0)
    return rows.select("recordingId", "utterance_id", at.alias("at_ms"), "cue_ms", "offsetMs", (at + length).alias("end_ms"), "speaker_id", "spoken")


class Precedence:
    """A graph of constraints "a before b", each with a weight."""

    def __init__(self, n: int) -> None:
        self.after: list[list[int]] = [[] for _ in range(n)]
        self.before: list[list[int]] = [[] for _ in range(n)]
        self.edges: list[tuple[int, int, tuple]] = []

    def node(self) -> int:
        self.after.append([])
        self.before.append([])
        return len(self.after) - 1

    def edge(self, a: int, b: int, weight: tuple) -> None:
        self.after[a].append(len(self.edges))
        self.before[b].append(len(self.edges))
        self.edges.append((a, b, weight))

    def layers(self, groups: list[list[int]], weigh: Callable[[list[int], list[int]], tuple]) -> None:
        """Everything of a group before everything of the next; a gate between two groups keeps the number of edges linear."""
        for early, late in zip(groups, groups[1:]):
            weight = weigh(early, late)
            if len(early) == 1 or len(late) == 1:
                for a in early:
                    for b in late:
                        self.edge(a, b, weight)
                continue
            gate = self.node()
            for a in early:
                self.edge(a, gate, weight)
            for b in late:
                self.edge(gate, b, weight)

    def order(self, rank: Callable[[int], tuple]) -> tuple[list[int], list[tuple[int, int, tuple]]]:
        """``(nodes in topological order, dropped edges)``.

        Of the nodes that wait for nothing the least in rank goes first. Where all that are left wait for
        each other there is a cycle: it is found by walking back, and its weakest edge (the latest of equal ones) is dropped.
        """
        waits = [len(x) for x in self.before]
        done, gone = [False] * len(waits), [False] * len(self.edges)
        free = [(rank(i), i) for i, w in enumerate(waits) if not w]
        heapq.heapify(free)
        order: list[int] = []
        dropped: list[tuple[int, int, tuple]] = []
        stuck = 0
        while len(order) < len(waits):
            if not free:
                while done[stuck]:
                    stuck += 1
                walk, seen, i = [], {}, stuck
                while i not in seen:
                    seen[i] = len(walk)
                    e = next(e for e in self.before[i] if not gone[e] and not done[self.edges[e][0]])
                    walk.append(e)
                    i = self.edges[e][0]
                e = min(walk[seen[i] :], key=lambda e: (self.edges[e][2], -e))
                gone[e] = True
                dropped.append(self.edges[e])
                waits[self.edges[e][1]] -= 1
                if not waits[self.edges[e][1]]:
                    heapq.heappush(free, (rank(self.edges[e][1]), self.edges[e][1]))
                continue
            i = heapq.heappop(free)[1]
            done[i] = True
            order.append(i)
            for e in self.after[i]:
                if not gone[e]:
                    j = self.edges[e][1]
                    waits[j] -= 1
                    if not waits[j]:
                        heapq.heappush(free, (rank(j), j))
        return order, dropped


def _grouped(indexes: Iterable[int], value: Callable[[int], float]) -> list[list[int]]:
    groups: dict[float, list[int]] = {}
    for i in indexes:
        groups.setdefault(value(i), []).append(i)
    return [groups[v] for v in sorted(groups)]


def precedence_order(rows: list[tuple]) -> tuple[list[int], int]:
    """``(order, conflicts)`` of the utterances ``(utterance_id, offset, cue, speaker, asks)`` of one stretch of a call.

    Three kinds of constraints are edges from an earlier to a later utterance. Timing (offset, or the written time where
    there is none) weighs most; then written times, which every utterance that has one must keep to; then the dialogue: a
    question comes before what other speakers say at the same time. Edges that cannot all hold form
    a cycle, and its weakest edge is dropped: a dialogue edge before one of written times before one of timing, and of two
    of written times the one that contradicts the timing more. ``conflicts`` counts the dropped ones. Among utterances free
    to go next the one of the smaller id does. Utterances without any time come last.
    """
    n, last = len(rows), float("inf")
    time = [o if o is not None else c if c is not None else last for _, o, c, _, _ in rows]
    graph = Precedence(n)
    moments = _grouped(range(n), time.__getitem__)
    graph.layers(moments, lambda a, b: (TIMING, 0.0))
    cued = _grouped((i for i in range(n) if rows[i][2] is not None), lambda i: rows[i][2])
    graph.layers(cued, lambda a, b: (CUE, min(0.0, min(time[i] for i in b) - max(time[i] for i in a))))
    for moment in moments:
        speakers: dict[object, list[int]] = {}
        for i in moment:
            speakers.setdefault(rows[i][3], []).append(i)
        if len(speakers) < 2 or time[moment[0]] == last:
            continue
        answers = [i for i in moment if not rows[i][4] and rows[i][3] is not None]
        for speaker, own in speakers.items():
            asking = [i for i in own if rows[i][4] and speaker is not None]
            if asking:
                gate = graph.node()
                for i in asking:
                    graph.edge(i, gate, (DIALOGUE, 0.0))
                for j in answers:
                    if rows[j][3] != speaker:
                        graph.edge(gate, j, (DIALOGUE, 0.0))
    nodes = [(r[0] is None, r[0] or 0) for r in rows]
    order, dropped = graph.order(lambda i: nodes[i] if i < n else (False, -(1 << 62)))
    return [i for i in order if i < n], len(dropped)


_RUN = "recordingId string, chunk bigint, seq bigint, runs bigint, speaker_id bigint, first_utterance_id bigint, utterance_count bigint, start_ms bigint, end_ms bigint, text string"


def _opt(value: object) -> int | None:
    return None if pd.isna(value) else int(value)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one speaker in each chunk of a recording; the partition is sorted by recording, chunk and time."""
    held: list[tuple] = []
    key: tuple | None = None
    out: list[tuple] = []

    def close() -> None:
        seen: set[int] = set()
        rows = [r for r in held if r[0] is None or not (r[0] in seen or seen.add(r[0]))]
        runs: list[list] = []
        for i in precedence_order([(r[0], r[1], r[2], r[3], r[6].endswith("?")) for r in rows])[0]:
            utterance, _, _, speaker, at, end, spoken = rows[i]
            if runs and runs[-1][0] == speaker:
                run = runs[-1]
                run[2] += 1
                run[4] = max((x for x in (run[4], end) if x is not None), default=None)
                run[5].append(spoken)
            else:
                runs.append([speaker, utterance, 1, at, end, [spoken]])
        out.extend((*key, k, len(runs), r[0], r[1], r[2], r[3], r[4], " ".join(r[5])) for k, r in enumerate(runs))
        held.clear()

    names = [x.split()[0] for x in _RUN.split(", ")]

    def frame() -> pd.DataFrame:
        df = pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names if c not in ("recordingId", "text")})
        out.clear()
        return df

    for batch in batches:
        for rec, chunk, utterance, offset, cue, speaker, at, end, spoken in zip(*[batch[c] for c in ("recordingId", "chunk", "utterance_id", "offsetMs", "cue_ms", "speaker_id", "at_ms", "end_ms", "spoken")]):
            if key != (rec, chunk):
                if held:
                    close()
                key = (rec, chunk)
            held.append((_opt(utterance), _opt(offset), _opt(cue), _opt(speaker), _opt(at), _opt(end), spoken))
        if len(out) > 5000:
            yield frame()
    if held:
        close()
    yield frame()


def speaker_turns(transcript: DataFrame, recording: DataFrame, words: bool = True) -> DataFrame:
    """Turns ``(recording_id, turn_no, speaker_id, first_utterance_id, utterance_count, start_ms, end_ms, text)``.

    A recording is cut into chunks of ten minutes, so that one of any length spreads over
    tasks; utterances without a time are cut by their ids, those without both by a hash. Inside a chunk the utterances are ordered by their precedence graph and run-length
    merged; between chunks the timing decides, which no weaker constraint can change. Across chunks only each chunk's first and last run can meet, so a window over the
    chunks (not the utterances) of a recording numbers the turns. Repeated rows of an
    utterance count once, those without an id each. An utterance whose speaker nobody can tell keeps a null
    ``speaker_id``; neighbouring ones of that kind form one turn. Empty tables give no turn. Without ``words`` there is no ``text``.
    """
    untimed = F.when(F.col("utterance_id").isNotNull(), F.floor(F.col("utterance_id") / IDS_A_CHUNK) + NO_TIME).otherwise(F.pmod(F.xxhash64("spoken"), F.lit(1024)) + NO_ID)
    rows = clean_utterances(transcript, recording, words).withColumn("chunk", F.coalesce(F.floor(F.col("at_ms") / CHUNK_MS), untimed))
    sorted_rows = rows.repartition("recordingId", "chunk").sortWithinPartitions("recordingId", "chunk", "at_ms", "utterance_id")
    runs = sorted_rows.mapInPandas(_runs, _RUN)
    runs = cut(runs if words else runs.drop("text"))  # read twice below
    ends = runs.groupBy("recordingId", "chunk").agg(
        F.max("runs").alias("runs"), F.max(F.when(F.col("seq") == 0, F.struct("speaker_id"))).alias("first"), F.max(F.when(F.col("seq") == F.col("runs") - 1, F.struct("speaker_id"))).alias("last")
    )
    chunks = ends.selectExpr(
        "recordingId",
        "chunk",
        "runs",
        "CASE WHEN lag(1) OVER (PARTITION BY recordingId ORDER BY chunk) = 1 AND first <=> lag(last) OVER (PARTITION BY recordingId ORDER BY chunk) THEN 1 ELSE 0 END AS joined",
    )
    numbered = chunks.selectExpr("recordingId", "chunk", "sum(runs - joined) OVER (PARTITION BY recordingId ORDER BY chunk) - runs AS base")
    text = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), " ").alias("text")] if words else []
    return (
        runs.join(numbered, ["recordingId", "chunk"])
        .withColumn("turn_no", F.col("base") + F.col("seq") + 1)
        .groupBy(F.col("recordingId").alias("recording_id"), "turn_no")
        .agg(
            F.first("speaker_id").alias("speaker_id"),
            F.min_by("first_utterance_id", "chunk").alias("first_utterance_id"),
            F.sum("utterance_count").alias("utterance_count"),
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            *text,
        )
    )
