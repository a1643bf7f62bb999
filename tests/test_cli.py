from __future__ import annotations

import json

import pytest

from brindle.cli import main, parse_day
from brindle.operators.index import VersionedIndex


def run(spark, capsys, *argv):
    code = main(list(argv), spark)
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def corpus(path, bodies):
    for k, (ticket, body) in enumerate(bodies.items()):
        folder = path / "202601" / ticket
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "meta.json").write_text(json.dumps({"TICKET_ID": ticket, "TICKET_SUBJECT": f"Case {ticket}", "TAG_LIST": json.dumps(["agent_business_impact_p1"] if k == 0 else ["feature_request"]), "CREATED_AT": f"2026-01-{10 + k}"}))
        (folder / "body.md").write_text(body)


def test_build_search_topics_incidence(spark, capsys, tmp_path):
    root, index = str(tmp_path / "raw"), str(tmp_path / "index")
    corpus(tmp_path / "raw", {"11": "the webhook relay drops rows", "12": "the invoice shows a wrong seat count", "13": "export of contacts stops"})
    common = ("--corpus", "support_tickets", "--index", index)
    assert run(spark, capsys, "search", *common, "webhook")[0] == 2
    assert run(spark, capsys, "build", *common, "--root", root, "--check") == (0, {"new": 3})
    code, built = run(spark, capsys, "build", *common, "--root", root)
    assert code == 0 and built["record_count"] == 3 and built["version"] == 1 and "unreadable" not in built
    (tmp_path / "raw" / "202601" / "bad").mkdir()
    (tmp_path / "raw" / "202601" / "bad" / "meta.json").write_text("{ no json")
    assert run(spark, capsys, "build", *common, "--root", root, "--check")[1] == {"unchanged": 3, "unreadable": 1}
    (tmp_path / "raw" / "202601" / "bad" / "meta.json").unlink()
    assert run(spark, capsys, "build", *common, "--root", root, "--dry-run")[1] == {"unchanged": 3, "records": 3}
    code, hits = run(spark, capsys, "search", *common, "--mode", "keyword", "relays webhooks")
    assert code == 0 and [h["id"] for h in hits] == ["support:11"]
    assert [h["parent_id"] for h in run(spark, capsys, "search", *common, "--group", "--date-from", "2026-01-12", "contacts")[1]] == ["support:13"]
    assert run(spark, capsys, "search", *common, "--date-from", "soon", "x")[0] == 2
    assert run(spark, capsys, "incidence", *common)[1]["impact_p1"] == 1
    asked = run(spark, capsys, "incidence", *common, "--question", "webhook", "--mode", "keyword")[1]
    assert [h["id"] for h in asked["hits"]] == ["support:11"] and asked["hits"][0]["incidence"]["business_impact"] == "P1" and asked["summary"]["results_returned"] == 1
    fitted = run(spark, capsys, "topics", *common, "--topics", "2", "--least", "1", "--inspect", "1")[1]
    assert fitted["version"] == 2 and len(fitted["samples"]) == fitted["topics"] == 2
    assert run(spark, capsys, "build", *common, "--root", root, "--retry-skipped", "--check")[1] == {"unchanged": 3}
    (tmp_path / "raw" / "202601" / "13" / "body.md").unlink()
    (tmp_path / "raw" / "202601" / "13" / "meta.json").unlink()
    corpus(tmp_path / "raw", {"14": "the dialer drops calls"})
    code, built = run(spark, capsys, "build", *common, "--root", root)
    assert code == 0 and built["record_count"] == 3 and built["deleted"] == 1 and built["version"] == 3
    topics = run(spark, capsys, "search", *common, "--topic-search", "topic case")[1]  # topics outlive a build
    assert topics and all(t["representatives"] for t in topics) and topics[0]["top_recordings"]
    hits = run(spark, capsys, "search", *common, "--mode", "keyword", "--topic", str(topics[0]["topic_id"]), "webhook relay invoice seat drops")[1]
    members = {r["record_id"] for r in VersionedIndex(spark, f"{index}/support_tickets").read("record_topics").where(f"topic_id = {topics[0]['topic_id']}").collect()}
    assert hits and {h["id"] for h in hits} <= members
    assert run(spark, capsys, "search", *common, "--topic", "99", "webhook")[0] == 2
    assert [h["id"] for h in run(spark, capsys, "search", *common, "--mode", "keyword", "dialers")[1]] == ["support:14"]
    assert run(spark, capsys, "catalog", *common, "--out", str(tmp_path / "catalog"))[1]["topics"] >= 2
    text = "\n".join(p.read_text() for p in (tmp_path / "catalog").glob("part*"))
    assert text.startswith("# Topics") and "| [0](#topic-0" in text and "### Topic 0: " in text


def test_calls_in_windows(spark, capsys, tmp_path):
    folder = tmp_path / "raw" / "7" / "202601" / "5"
    folder.mkdir(parents=True)
    words = " ".join(f"{a}{b}word" for a in "abcdefgh" for b in "abcdefgh")
    (folder / "transcript.json").write_text(json.dumps({"recordingId": "5", "utterances": [{"offsetMs": 1000 * i, "durationMs": 1, "speaker": {"inMeetingId": 1, "displayName": "Ana"} if i else None, "text": words} for i in range(3)]}))
    (folder / "recording.json").write_text(json.dumps({"id": "5", "attributes": {"title": "Demo", "createdAt": "2026-01-05", "participants": [{"inMeetingId": 1, "displayName": "Ana", "type": "PROSPECT"}]}}))
    common = ("--corpus", "call_transcripts", "--index", str(tmp_path / "index"))
    assert run(spark, capsys, "build", *common, "--root", str(tmp_path / "raw"))[1]["record_count"] == 1
    hit = run(spark, capsys, "search", *common, "--mode", "keyword", "aaword")[1][0]
    assert hit["id"] == "call:5:c0000" and hit["text"].startswith("[Unknown, UNKNOWN @ 00:00] ")  # the windows hold the rendered lines alone
    assert (hit["chunk_index"], hit["chunk_start_mmss"], hit["chunk_end_ms"], hit["chunk_speakers"], hit["chunk_utterance_count"]) == ("0", "00:00", "2001", '["PROSPECT","UNKNOWN"]', "3")
    assert run(spark, capsys, "incidence", *common)[1] == {"parents": 1, "parents_with_customer_voice": 1}


def test_days():
    assert parse_day(" ") is None and parse_day("2026-01-02") == "2026-01-02"
    with pytest.raises(Exception, match="not a date"):
        parse_day("2026-13-01")
