from __future__ import annotations

from datetime import datetime

from hypothesis import given
from hypothesis import strategies as st

from brindle.llm.speech import label_key, person_keys, read_utterance
from brindle.llm.turns import Precedence, precedence_order, speaker_turns

T = datetime(2026, 1, 1)
TRANSCRIPT = "recordingId string, utterance_id bigint, offsetMs bigint, durationMs bigint, speaker struct<inMeetingId:bigint,displayName:string>, text string, loaded_at timestamp, chunk int"
RECORDING = "id string, attributes struct<participants:array<struct<inMeetingId:bigint,displayName:string,firstName:string,type:string>>>, loaded_at timestamp"


def test_times_labels_notes_and_hesitations():
    assert read_utterance("[00:01:02] Ana: hello um, there") == (62_000, "Ana", "hello there")
    assert read_utterance("00:02:33,441 --> **Bo Larn:** yes") == (153_441, "Bo Larn", "yes")
    assert read_utterance("@1m05s (laughs) >> LARN Bo: no") == (65_000, "LARN Bo", "no")
    assert read_utterance("<00:00:09.581> <Larn, Bo> no") == (9_581, "Larn, Bo", "no")
    for empty in ("[inaudible 00:01:02] uhh...", "um, uh", "-- static -- hmm", "♪", "...", "(0:12)", "((door closes)) er", "Ana: um", " ", ""):
        assert read_utterance(empty)[2] is None, empty
    assert read_utterance(None) == (None, None, None)
    assert read_utterance("x " * 50_000)[2] is not None


def test_written_forms_meet_the_person():
    keys = person_keys("Ana Larn (Birch Foods)")
    for form in ("Ana Larn", "larn ana", "LARN Ana", "Larn, Ana", "Ana_Larn", "A. Larn", "Ana L.", "Ana", "Larn", " Ana Larn | iPhone", "Ana Larn - USER", "Ana Larn [Guest]"):
        assert label_key(form) in keys, form
    for generic in ("Speaker 3", "SPEAKER_02", "Conference Room B", "-", "", None, "Unknown"):
        assert label_key(generic) is None


PLACES = st.tuples(st.integers(0, 30), st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.integers(1, 3)), st.booleans())


@given(st.lists(PLACES, max_size=25, unique_by=lambda r: r[0]))
def test_order_keeps_all_and_obeys_timing(rows):
    order, _ = precedence_order(rows)
    assert sorted(order) == list(range(len(rows)))
    time = [rows[i][1] if rows[i][1] is not None else rows[i][2] if rows[i][2] is not None else 99 for i in order]
    assert time == sorted(time)


def test_contradicting_constraints_lose_by_their_weight():
    # offsets say 1, 2, 3; the written times say 3 before 1
    assert precedence_order([(1, 100, 9, 1, False), (2, 200, None, 2, False), (3, 300, 4, 1, False)]) == ([0, 1, 2], 1)
    # written times that agree are no conflict, and they order what has one offset
    assert precedence_order([(1, 100, 9, 1, False), (2, 100, 5, 2, False), (3, 300, 12, 1, False)]) == ([1, 0, 2], 0)
    # at one moment a question comes before the others' words, though its id is larger
    assert precedence_order([(1, 100, None, 1, False), (2, 100, None, 2, True), (3, 100, None, 2, False)]) == ([1, 0, 2], 0)
    # but not where written times say otherwise
    assert precedence_order([(1, 100, 3, 1, False), (2, 100, 7, 2, True)]) == ([0, 1], 1)
    # no time at all: by id, behind the others; no id last
    assert precedence_order([(None, None, None, 1, False), (2, None, None, 2, True), (1, None, None, 1, False), (7, 5, None, 1, False)])[0] == [3, 2, 1, 0]


def test_weakest_edge_of_a_cycle_is_dropped():
    graph = Precedence(4)
    for a, b, weight in ((0, 1, (3, 0.0)), (1, 2, (2, -1.0)), (2, 3, (2, -5.0)), (3, 0, (2, -3.0)), (2, 0, (1, 0.0))):
        graph.edge(a, b, weight)
    assert graph.order(lambda i: (i,)) == ([3, 0, 1, 2], [(2, 3, (2, -5.0)), (2, 0, (1, 0.0))])


def test_many_contradictions_at_once():
    n = 300
    order, conflicts = precedence_order([(k, k, n - k, 1 + k % 2, False) for k in range(n)])
    assert order == list(range(n)) and conflicts == n - 1


def test_words_left_out_only_mark():
    for text in ("[00:01:02] Ana: hello um, there?", "um, uh", "Ana: um", "(laughs) yes", "...", "<00:00:09.581> <Larn, Bo> no", "♪ la", "“Well” she said", "? what", ""):
        at, label, spoken = read_utterance(text)
        marked = read_utterance(text, words=False)
        assert marked[:2] == (at, label) and (marked[2] is None) == (spoken is None)


def say(rec, utt, at, seat, text, name=None):
    return (rec, utt, at, 10, (seat, name), text, T, 1)


def test_turns(spark):
    people = [("r", ([(1, "Ana Larn", "Ana", "USER"), (2, None, "Bo", "GUEST"), None],), T)]
    rows = [
        say("r", 5, 0, 1, "one"),
        say("r", 4, 1000, None, "two", "A. Larn"),
        say("r", 4, 1000, None, "two", "A. Larn"),
        say("r", 3, None, None, "[00:00:02] Bo: three"),
        say("r", 2, 2500, 1, "um"),
        say("r", 1, 3000, 2, "four"),
        say("r", 9, 700_000, 2, "five"),  # another chunk, the same turn
        say("r", 8, 700_500, None, "who", "Speaker 2"),
        say(None, 7, 1, 1, "x"),
        ("r", 10, 800_000, None, None, None, T, 1),
    ]
    turns = speaker_turns(spark.createDataFrame(rows, TRANSCRIPT), spark.createDataFrame(people, RECORDING)).orderBy("turn_no").collect()
    assert [(t["turn_no"], t["speaker_id"], t["first_utterance_id"], t["utterance_count"], t["text"]) for t in turns] == [(1, 1, 5, 2, "one two"), (2, 2, 3, 3, "three four five"), (3, None, 8, 1, "who")]
    bare = speaker_turns(spark.createDataFrame(rows, TRANSCRIPT), spark.createDataFrame(people, RECORDING), words=False).orderBy("turn_no").collect()
    assert [tuple(t) for t in bare] == [tuple(t)[:-1] for t in turns]
    untimed = [say("q", k, None, 1 + k // 5000, "x") for k in range(9990, -1, -1)] + [say("q", None, None, 2, "y")] * 2 + [say("q", 3, 50, 2, "z")]
    turns = speaker_turns(spark.createDataFrame(untimed, TRANSCRIPT), spark.createDataFrame([], RECORDING), words=False).orderBy("turn_no").collect()
    assert [(t["speaker_id"], t["first_utterance_id"], t["utterance_count"]) for t in turns] == [(2, 3, 1), (1, 0, 5000), (2, 5000, 4993)]
    assert speaker_turns(spark.createDataFrame([], TRANSCRIPT), spark.createDataFrame([], RECORDING)).count() == 0
