from __future__ import annotations

import re

import pyarrow.parquet as pq

from brindle.llm import pii
from brindle.llm.pii import find_personal, model, name_lexicon, redact_personal
from brindle.llm.pii_model import FIRST, LAST, Scorer, decode, train
from brindle.llm.pii_samples import COMPANIES, STREET_NAMES, TOWNS, Sampler, carriers, labelled_sample


def scores(weights, sample, kind_of):
    scorer = Scorer(weights)
    right = found = wanted = 0
    for text, gold in sample:
        got = set(decode(text, kind_of, scorer))
        right, found, wanted = right + len(got & set(gold)), found + len(got), wanted + len(gold)
    return right / found, right / wanted


def test_held_out_carriers():
    """A fifth of the carrier sentences is never seen in training, nor are the names, numbers and addresses in them."""
    sample, sampler = labelled_sample(fold=1)
    unseen, other = labelled_sample(1000, seed=77, fold=1, held_out=True)
    precision, recall = scores(train(sample, sampler.kind_of), unseen, other.kind_of)
    assert precision > 0.88 and recall > 0.85


def test_seen_carriers_with_other_items():
    sample, sampler = labelled_sample(800, seed=77)
    precision, recall = scores(model(), sample, sampler.kind_of)
    assert precision > 0.97 and recall > 0.96


def test_no_carrier_or_part_comes_from_the_tables(small):
    root = small.rsplit("/", 1)[0] + "/sf0.1"
    columns = {"transcript": "text", "records": "text", "documents": "text", "eval_items": "text", "meta": "TICKET_SUBJECT", "topics": "label", "accounts": "name"}
    texts = "\n".join(t for name, column in columns.items() for t in pq.read_table(f"{root}/{name}.parquet", columns=[column])[column].unique().to_pylist() if t).lower()
    for part in {p for c in carriers() for p in re.split(r"\{.\}", c)}:
        assert sum(c.isalpha() for c in part) < 7 or part.lower() not in texts, part
    for word in [*COMPANIES.split("|"), *TOWNS, *STREET_NAMES]:
        assert not re.search(rf"\b{re.escape(word.lower())}\b", texts), word


def test_segments_of_any_length():
    scorer = Scorer(model())
    mail = "a" * 150 + "@" + "b" * 90 + ".example"
    assert decode(f"Write to {mail} please.", lambda w: 0, scorer) == [(9, 9 + len(mail), "email")]
    known = {"anna": FIRST, "maria": FIRST, "luisa": FIRST, "oakwith": LAST, "larnby": LAST}
    text = "I spoke to Anna Maria Luisa Oakwith Larnby on Sunday."
    found = decode(text, lambda w: known.get(w, 0), scorer)  # maybe in two segments, but no word is lost
    assert "".join(text[a:b] for a, b, _ in found).replace(" ", "") == "AnnaMariaLuisaOakwithLarnby"


def test_filter_grows_with_the_names(spark, monkeypatch):
    monkeypatch.setattr(pii, "FILTER_BITS_LEAST", 1 << 10)
    people = [(k, (k, f"Fa{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} Nono", None, "USER")) for k in range(4000)]
    calls = spark.createDataFrame([("r", ([p for _, p in people],))], CALLS)
    lexicon = name_lexicon(frames(spark, [])[0].limit(0), calls)
    assert lexicon.bits >= 64 * 4000 and lexicon.kind_of("nono") == LAST and lexicon.kind_of("faaaa") == FIRST
    assert sum(lexicon.kind_of(f"x{k}") > 0 for k in range(20_000)) < 40


def test_sample_is_the_same_each_time():
    assert labelled_sample(50)[0] == labelled_sample(50)[0]
    assert isinstance(Sampler(1).kind_of("none"), int)


CALLS = "id string, attributes struct<participants:array<struct<inMeetingId:bigint,displayName:string,firstName:string,type:string>>>"
TALK = "utterance_id bigint, speaker struct<inMeetingId:bigint,displayName:string>, text string, row_key string"


def frames(spark, texts):
    people = [(1, "Grace Larnby", "Grace", "USER"), (2, "Mark Oakwith", "Mark", "GUEST"), (3, None, "Will", None), None]
    calls = spark.createDataFrame([("r", (people,)), ("s", None)], CALLS)
    return spark.createDataFrame([(k, (1, "LARNBY Grace"), t, "clash") for k, t in texts], TALK), calls


def test_items_and_placeholders(spark):
    texts = [
        (1, "Hi Grace, call 07700 900 123 or write to mark.oakwith@birch.example please."),
        (2, "Mark my words, the grace period ends. Will this work in the main street campaign?"),
        (3, "Our ticket number is OPS-9210 and the request id was XM5051324."),
        (4, "My passport number is XM5051324."),
        (5, "Visit us at Flat 7, 206 Cobble Lane, Castelmare. um..."),
        (6, None),
        (7, ""),
        (None, "Grace"),
        (8, "Grace Larnby. " * 20_000),
        (9, "Send it to grace dot larnby at birch dot example."),
    ]
    talk, calls = frames(spark, texts)
    lexicon = name_lexicon(talk, calls)
    assert lexicon.kind_of("grace") == FIRST and lexicon.kind_of("oakwith") == LAST and lexicon.kind_of("period") == 0
    got = {tuple(r) for r in find_personal(talk, "utterance_id", "text", lexicon).collect()}
    assert got == {
        ("1", "name", "Grace"), ("1", "phone", "07700 900 123"), ("1", "email", "mark.oakwith@birch.example"),
        ("4", "id_number", "XM5051324"), ("5", "address", "Flat 7, 206 Cobble Lane, Castelmare"), ("8", "name", "Grace Larnby"), ("9", "email", "grace dot larnby at birch dot example"),
    }
    clean = {r["row_key"]: r["text"] for r in redact_personal(talk, "utterance_id", "text", lexicon).collect()}
    assert clean["1"] == "Hi [NAME], call [PHONE] or write to [EMAIL] please." and clean["6"] is None and clean["7"] == "" and clean["2"] == texts[1][1]
    assert find_personal(talk.limit(0), "utterance_id", "text", name_lexicon(talk.limit(0), calls.limit(0))).count() == 0
