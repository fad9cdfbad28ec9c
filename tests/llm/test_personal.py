"""Personal information: cases, offsets, and redaction that leaves the rest alone."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalmill.llm.personal import ANNOUNCES, GERMAN_STREET, Finder, Shadow, find_personal, learned_names, redact, redacted

GIVEN = "Lucia Noor Oliver Ines Elena Petra".split()
OTHERS = ["Port Varn", "Blue Kasvir", "The Silent Mirror", "Kerola Falls"]
FINDER = Finder(GIVEN, OTHERS)


def found(text):
    return {(k, text[a:b]) for a, b, k in FINDER.spans(text)}


@pytest.mark.parametrize("text,want", [
    ("Contact: Lucia Norr <w_norr@mail.brack.example>", {("name", "Lucia Norr"), ("email", "w_norr@mail.brack.example")}),
    ("from=tarno at quizpost dot example tel=+1-312-555-0114", {("email", "tarno at quizpost dot example"), ("phone", "1-312-555-0114")}),
    ("You can reach me at g-trem(at)harbour-quiz [dot] example.", {("email", "g-trem(at)harbour-quiz [dot] example")}),
    ("Mon adresse : hugo59 @ quizpost.example.", {("email", "hugo59 @ quizpost.example")}),
    ("pаvel@post.invalid", {("email", "pаvel@post.invalid")}),  # a Cyrillic letter
    ("or ring +44 (0)7700 900 180.", {("phone", "44 (0)7700 900 180")}),
    ("call (415) 555-0140 ext. 14", {("phone", "415) 555-0140")}),
    ("Rückruf bitte unter +49 (0)30/23125-277.", {("phone", "49 (0)30/23125-277")}),
    ("Llámame al 600-555-855.", {("phone", "600-555-855")}),
    ("Appelez-moi au 0033199089474", {("phone", "0033199089474")}),
    ("call five five five two three four six", {("phone", "")} - {("phone", "")}),
    ("social security number 955-95-2332.", {("identity_number", "955-95-2332")}),
    ("passport no. X07576040, identity card x0 419 9924", {("identity_number", "X07576040"), ("identity_number", "x0 419 9924")}),
    ("National Insurance no. QQ 30 22 31 D.", {("identity_number", "QQ 30 22 31 D")}),
    ("NIR : 1 07 13 99 397 696 44.", {("identity_number", "1 07 13 99 397 696 44")}),
    ("DNI: 00.306.583-P.", {("identity_number", "00.306.583-P")}),
    ("codice fiscale BBVWGL89X59Z989G.", {("identity_number", "BBVWGL89X59Z989G")}),
    ("Personalausweis Nr. L07X 00S46.", {("identity_number", "L07X 00S46")}),
    ("Write to Flat 9, 12 Upper Ropewalk St, Port X.", {("street_address", "12 Upper Ropewalk St")}),
    ("Am Quarryplatz 100.", {("street_address", "Am Quarryplatz 100")}),
    ("13 bis, rue des Lindenmills, 54045 Lyon", {("street_address", "13 bis, rue des Lindenmills")}),
    ("Via Quarry, 161 e C/ Marlowe, 27", {("street_address", "Via Quarry, 161"), ("street_address", "C/ Marlowe, 27")}),
    ("Signed, Mrs Noor Gunder", {("name", "Noor Gunder")}),
    ("Mi chiamo Tarnow, Oliver e abito", {("name", "Tarnow, Oliver")}),
    ("GREVOU Ines-Elena", {("name", "GREVOU Ines-Elena")}),
    ("Ask P. Lindq from the league office", {("name", "P. Lindq")}),
    ("- Petra della Oyel\nnext", {("name", "Petra della Oyel")}),
    ("Thanks to Xaver Quint-Müll for spotting this one.", {("name", "Xaver Quint-Müll")}),
])
def test_cases(text, want):
    assert found(text) == want


@pytest.mark.parametrize("text,want", [
    ("My colleague Olumide Adebayo called", "Olumide Adebayo"), ("Please forward this to Svetlana Ivanova", "Svetlana Ivanova"), ("I spoke with Dr. Hiroshi Tanaka", "Hiroshi Tanaka"),
    ("Best wishes,\nCarmen Ruiz", "Carmen Ruiz"), ("written by Mehmet Yilmaz", "Mehmet Yilmaz"), ("I met João da Silva yesterday", "João da Silva"), ("Monsieur Jean Dupont est là", "Jean Dupont"),
    ("Yesterday Wilma Ek (wilma.ek@x.example) won", "Wilma Ek"), ("> - P. Lindq", "P. Lindq"), ("- P. Lindq", "P. Lindq"), ("Signed, A. B. Smith", "A. B. Smith"), ("Payee: Bjorn Dahl; 12", "Bjorn Dahl"),
    ("Meine Kollegin Heike Vogel fragt", "Heike Vogel"), ("Gracias a Ignacio Prieto por todo", "Ignacio Prieto"), ("Merci à Thibault Lemaire", "Thibault Lemaire"), ("Mit freundlichen Grüßen\nUwe Brandt", "Uwe Brandt"),
])
def test_names_by_evidence(text, want):
    assert ("name", want) in found(text)


@pytest.mark.parametrize("text", ["Thanks to the Picture Desk for it", "Write to Port Varn now", "Ask Table Captain", "Contact: Blue Kasvir", "I am Team Seven", "My Neighbour Keeps Re-Using The Old Crafts Set On Most Days Again And Again", "Ask The Silent Mirror"])
def test_no_names(text):
    assert not found(text)


@pytest.mark.parametrize("text,kind,want", [
    ("Call 01632 960 001 now", "phone", "01632 960 001"), ("+31 20 123 4567", "phone", "31 20 123 4567"), ("00420 601 123 456", "phone", "00420 601 123 456"), ("(0161) 496 0123", "phone", "0161) 496 0123"),
    ("at 742 Evergreen Plaza", "street_address", "742 Evergreen Plaza"), ("10 Downing Boulevard", "street_address", "10 Downing Boulevard"), ("Keizersgracht 123", "street_address", "Keizersgracht 123"), ("Rua Augusta, 24", "street_address", "Rua Augusta, 24"),
])
def test_other_plans(text, kind, want):
    assert (kind, want) in found(text)


def test_filters_lose_nothing():
    """A text that a costly pattern matches has one of the signs without which it isn't tried."""
    for sign in GERMAN_STREET:
        assert any(k == "street_address" for k, _ in found(f"Linden{sign} 12")), sign
    for word in ("passport", "pass-nr", "passeport", "pasaporte", "passaporto", "identity card", "id card", "ausweis", "personalausweis", "carte d'identité"):
        assert any(x in word for x in ANNOUNCES) and ("identity_number", "Q1234567X") in found(f"{word}: Q1234567X"), word


def test_learned(spark):
    docs = spark.createDataFrame([(f"{k}. Signed, Zuleika {s}\nAsk Port Varn",) for k, s in enumerate("Brandt Prieto Lemaire Vogel".split())] + [("Signed, Once Only",), (None,)], "text string")
    assert learned_names(docs, "text", OTHERS) == ["zuleika"] and learned_names(docs.where("false"), "text") == []
    assert ("name", "zuleika brandt") in {(k, t[a:b]) for t in ["so zuleika brandt wrote"] for a, b, k in Finder(["zuleika"]).spans(t)}


@pytest.mark.parametrize("text", [
    "Invoice 2022-64276 covers 2025-03-23.", "Runtime 2.41.0, host 192.0.2.17, seed 55434.", "QB-69/21787", "See thread #66002", "final score 21-17.", "Handle @tabletop_39 posted", "12345678901234567890123456789012345678901234567890",
    "Run pelagic-14b__v3_json__ron__20260308-1049 finished", "The hall in Lake Grim opens at 18:30.", "6. As of 2019, which place lent its name", "Port Varn and The Silent Mirror", "", "   ", "At the last minute, an older draft voted.",
])
def test_nothing(text):
    assert not found(text)


def test_offsets_after_rewriting():
    text = "a​b   x(at)y [dot] example, Café – tel=617.555.0154"
    got = found(text)
    assert ("email", "x(at)y [dot] example") in got and ("phone", "617.555.0154") in got
    assert redact(text, FINDER.spans(text)) == "a​b   [EMAIL], Café – tel=[PHONE]"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_any_text(text):
    spans = FINDER.spans(text)
    assert all(0 <= a < b <= len(text) for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    s = Shadow(text)
    assert s.begin is None or len(s.begin) == len(s.end) == len(s.text)


def test_spark(spark):
    long = "The mill stood near. " * 20_000 + "Signed, Noor Gunder"
    docs = spark.createDataFrame([(1, "cc: a@b.example a@b.example", "k"), (2, None, "k"), (3, "", "k"), (4, long, None), (1, "cc: a@b.example", "k")], "doc_id bigint, text string, kind string")
    got = sorted(map(tuple, find_personal(docs, "doc_id", "text", GIVEN).collect()))
    assert got == [(1, "email", "a@b.example"), (1, "email", "a@b.example"), (4, "name", "Noor Gunder")]
    r = {x.doc_id: x for x in redacted(docs.where("doc_id > 1"), "text", GIVEN).collect()}
    assert r[2].redacted is None and r[3].redacted == "" and r[4].redacted.endswith("Signed, [NAME]")
    assert find_personal(docs.where("doc_id < 0"), "doc_id", "text", GIVEN).count() == 0


def test_small_table(spark, small, q):
    assert q["p9_found"](spark, small).count() == q["p9_found"](spark, small).distinct().count() > 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert q["p9_redacted"](spark, small).count() == docs.count()
