"""Truncation and broken pairs: cases, and agreement with what is known of the data."""

import math
import random
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalmill.llm.language import LanguageModel, fit_languages
from evalmill.llm.pairs import KEYS, TEMPLATES, alone, defect, defective_pairs, is_copy, is_refusal, lcs, near, unusual, with_options
from evalmill.llm.truncation import contexts, core, cut_name, gathered, is_open_json, piece_contexts, prior_odds, truncated_replies, typed_name

QUESTION = "Which place lent its name to the Kerola marathon's half-way mark?"
OPTIONS = ["Port Varn", "Lake Somil", "Peter de Quesouhiar", "Saint Zovavin"]


@pytest.fixture(scope="module")
def model(spark, small):
    return fit_languages(spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet"))


@pytest.mark.parametrize("text,want", [('{"answer": "A"}', False), ('{"answer": "A', True), ('{"a": {"b": "}"', True), ("plain", None), ("a {set} of", None), ('```json\n{"answer": "A"}\n```', False), ('{"a": "\\"}', True), ("", None), ("{", True)])
def test_open_json(text, want):
    assert is_open_json(text) is want


def test_core():
    assert core("It is lef…") == "It is lef" and core("Done. [truncated]") == "Done" and core("Port Var...") == "Port Var" and core(" ") == ""


def test_contexts_end_is_last():
    text = "I believe it is Port Varn. The mill stood"
    assert list(contexts(text, final=True)) == [c for c in contexts(text)][-len(list(contexts(text, final=True))):]
    assert not list(contexts("")) and list(contexts("x" * 3000))


@pytest.mark.parametrize("text,at_limit,want", [("It's Bromqui", False, True), ("Bromquim Valley", False, False), ("Valley, Bromquim", False, False), ("valey, the bromquim", False, False), ("St. Voulfumyun", False, False), ("Saint Voulfumyu", True, True), ("Saint Voulfumyu", False, False), ("Something else", False, False), ("", True, False)])
def test_cut_name(text, at_limit, want):
    assert cut_name(text, ["Port Jirbreag", "Bromquim Valley", "Saint Voulfumyun"], at_limit) is want if text else True


def corpus(spark):
    names = ["Port Varn", "Lake Somil", "Mount Tarrow", "Saint Brelda", "Kerola Falls"]
    whole = [f"{lead} {n}{tail}" for n in names for lead in ("The answer is", "I believe it is", "Option A,") for tail in (". The old mill stood near the river long before the bridge was built.", ", since the others do not match the question.", ".")]
    rows = [(i, f"q{i % 5}", t, False) for i, t in enumerate(whole * 3)]
    return rows, names


def test_replies(spark):
    rows, names = corpus(spark)
    cut = {1000: "I believe it is Lake Somil. The old mill sto", 1001: "The answer is Port Varn. The old mill stood near the…", 1002: '{"answer": "Port', 1003: "Option A, Lake So", 1004: "I believe it is Saint Brelda. The old mill stood near the river long before the"}
    fine = {2000: "I believe it is Kerola Falls", 2001: "B", 2002: "True", 2003: '{"answer": "Port Varn"}', 2004: "The answer is Lake Somil, since the others do not match the question", 2005: "", 2006: None, 2007: "   ", 2008: "**B**"}
    df = spark.createDataFrame(rows + [(i, "q1", t, True) for i, t in {**cut, **fine}.items()], "response_id bigint, question_id string, content string, full boolean").withColumn("prior", F.when(F.col("full"), 0.8).otherwise(0.0))
    questions = spark.createDataFrame([(f"q{i}", names[:4]) for i in range(5)] + [("none", None)], "question_id string, options array<string>")
    df = df.selectExpr("*", "'x' as name", "'y' as core", "1 as word", "true as open", "'z' as evidence", "array('q') as options")
    got = {r.response_id for r in truncated_replies(df, "content", "question_id", "prior", questions).collect()}
    assert {i for i in got if i >= 1000} == set(cut)
    assert not any(i < 1000 for i in got)
    assert truncated_replies(df.where("response_id < 0"), "content", "question_id", "prior", questions).count() == 0


def test_prior(spark):
    rows = [("Port Varn", "stop", 3, 8), ("Port Varn", "stop", 8, 8), ("Port Varn", None, 3, 8), ("x" * 60, "stop", 3, 8), ("Port Varn…", "stop", 3, 8), (None, None, None, None)]
    df = spark.createDataFrame(rows, "t string, f string, c int, m int").select(prior_odds(*map(F.col, "tfcm")).alias("p"))
    assert [r.p for r in df.collect()] == [-1.3, 0.8, 0.8, 0.0, 0.0, 0.8]


def test_found_agrees_with_open_json_and_finish_reason(spark, small, q):
    rows = spark.read.parquet(f"{small}/llm_responses.parquet").select("response_id", "content", "finish_reason").collect()
    found = {r.response_id for r in q["p4_found"](spark, small).collect()}
    by = {r.response_id: r for r in rows}
    assert found <= set(by) and all(by[i].content and by[i].content.strip() for i in found)
    assert all(r.response_id in found for r in rows if r.content and is_open_json(r.content))
    plain = [r for r in rows if r.content and len(r.content.strip()) == 1]
    assert plain and not any(r.response_id in found for r in plain)


@pytest.mark.parametrize("text", ["I'm sorry, but I can't help with that.", "I’m afraid I must decline to answer this one. Thank you for understanding.", "UNFORTUNATELY I CANNOT PROVIDE AN ANSWER.", "I DON'T KNOW", "i dont know", "Not sure.", "Unknown", "N/A", "No idea.", "Sorry, no.", "Could you give more context? I cannot answer as it stands."])
def test_refusals(text):
    assert is_refusal(text) and defect(QUESTION, text) == "refusal" and defect(QUESTION, '{"answer": "%s"}' % text) == "refusal"


@pytest.mark.parametrize("text", ["Sorry for the delay - it is C.", "I'm not sure, but the answer is D.", "I'm not sure, but false.", "I don't know much about this, but Port Varn it is.", "I can't be certain; my pick is Saint Brelda.", "Unknown to many, but true.", "I cannot verify every detail, yet it is false.", "B", "True", "Port Varn", "none of the above", "42", '{"answer": "C", "why": "I am not sure, but the answer is C."}'])
def test_no_defect(text, model):
    assert defect(QUESTION, text, OPTIONS, model) is None


@pytest.mark.parametrize("text", [None, "", "  ", "​", "-", "...", "**", '""', "{}", "{ }", '{"answer": ""}', '{"answer": null}', "<p></p>", "``````", "—", "null"])
def test_empty(text):
    assert defect(QUESTION, text) == "empty"


def test_copies(model):
    for text in (QUESTION, QUESTION.lower(), f"You asked: {QUESTION}", f'"{QUESTION}"', QUESTION.replace("the ", ""), '{"answer": "%s"}' % QUESTION):
        assert defect(QUESTION, text, OPTIONS, model) == "copied_question", text
    assert not is_copy(QUESTION, QUESTION + " The correct answer is C) Port Varn.") and not is_copy("The Wuko beetle can't fly.", "The Wuko beetle can't fly. False")
    assert not is_copy("", "x") and not is_copy(QUESTION, "Port Varn")


@pytest.mark.parametrize("text", ["La bonne réponse est Port Varn.", "Die richtige Antwort ist Port Varn.", "Vrai.", "Falsch", "Es verdad.", "Правильный ответ: Port Varn.", "正解はPort Varnです。", "Het juiste antwoord is Port Varn.", "Acho que é Port Varn, pois não há outra opção.", "Rätt svar är Port Varn.", "Poprawna odpowiedź to Port Varn."])
def test_other_language(text, model):
    options = ["True", "False"] if len(text.split()) < 3 else ["Port Varn", "Lake Somil"]
    assert defect(QUESTION, text, options, model) == "other_language"


def test_names_are_of_no_language(model):
    for text in ("Peter de Quesouhiar", "peter de quesouhair", "Sant Zovavin", "La Falls", "zovavin saint", "It's Port Varm", "", "42"):
        assert defect(QUESTION, text, OPTIONS, model) in (None, "empty"), text


#: None of these is in the test data.
REFUSED = """That falls outside my area of expertise.|I won't be able to respond to that question.|I'm not comfortable answering that.|Apologies, but this is more than I am able to tell you.
I haven't the faintest idea.|Regrettably, I lack the data to settle this.|This is beyond the scope of my knowledge.|There's no way for me to determine that.|I must respectfully decline.|We do not have any record of it.
I don't possess information about this marathon.|It is not something I can answer.|Honestly, no clue whatsoever.|I am not qualified to judge this.|I'm unsure.|I can't verify that, so I will refrain from guessing.|My knowledge does not cover this.
I'd prefer not to speculate.|Not enough context was given for me to decide.|I'm afraid that I could not find any details on that.|No comment.|Skip.|I do not want to answer this.|Unable to determine.|That isn't something I am able to help with.|You would have to ask somebody else, as I have no knowledge of it.|Nothing in my training covers this.|It would be improper for me to say.|I can neither confirm nor deny that.|Sorry, that one has me stumped.""".replace("\n", "|").split("|")
ANSWERED = """I'm unsure, but I'd go with Lake Somil.|Not certain at all. My money is on B.|I have no record of it; still, Port Varn seems right.|Without more context I'd say (C).|I can't be positive, though probably Saint Zovavin.|Nobody knows for sure. True.
It is Port Varn, though I lack details.|My best guess: Lake Somil.|There is little information on it, yet the answer is Peter de Quesouhiar.|The archive holds no records of the year, but Lake Somil was meant.|I could not say it better: Port Varn.|I do not think so: false.|lake somil, no idea why""".replace("\n", "|").split("|")
FOREIGN = """Selon moi, il faut choisir Port Varn.|Pienso que debe ser Lake Somil.|Penso che sia Port Varn.|Natürlich Port Varn, keine Frage.|Wahrscheinlich handelt es sich um Lake Somil.|Je dirais plutôt Port Varn, sans en être sûr.|Sin duda alguna, es Lake Somil.|Direi proprio Port Varn.
Ich würde auf Port Varn tippen.|Ik zou voor Port Varn kiezen.|Jag skulle gissa på Port Varn.|Eu escolheria Port Varn sem hesitar.|Wydaje mi się, że chodzi o Port Varn.|Je n'en sais rien.|Das weiß ich leider nicht.""".replace("\n", "|").split("|")
#: Of languages that nothing was fitted on.
UNKNOWN = """Riktig svar er uten tvil Port Varn.|Správna odpoveď je určite Port Varn.|La resposta correcta és segurament Port Varn.|Jawaban yang benar adalah Port Varn.|Točan odgovor je vjerojatno Port Varn.|Õige vastus on kindlasti Port Varn.|Pareiza atbilde ir noteikti Port Varn.|תשובה נכונה Port Varn|ठीक जवाब Port Varn|Správný výsledok: 正しい""".split("|")
PLAIN = """I reckon it must be Port Varn.|Port Varn, beyond doubt.|Could well be Lake Somil.|Certainly Port Varn; the others are too young.|the harbour town of port varn|Surely none but Saint Zovavin qualifies.|Probably the lake.|C, obviously|Oh, that's easy: Port Varn!|second option|Peter de Quesouhiar founded it|Hmm - Lake Somil then""".replace("\n", "|").split("|")


def share(texts, want, model):
    return sum(defect(QUESTION, t, OPTIONS, model) == want for t in texts) / len(texts)


def test_held_out_refusals(model):
    assert share(REFUSED, "refusal", model) >= 0.9
    assert share([f"{t} Thank you so much for your patience with me today, and please do come back whenever you wish to talk about anything else at all; it is always a pleasure. " * k for t in REFUSED[:10] for k in (1, 3)], "refusal", model) >= 0.9
    assert share(ANSWERED, "refusal", model) <= 0.1


def test_every_template_has_a_key():
    assert all(set(KEYS).intersection(places) for places, _ in TEMPLATES)


def test_held_out_languages(model):
    assert share(FOREIGN, "other_language", model) >= 0.9
    assert share(UNKNOWN, "other_language", model) >= 0.75
    assert share(PLAIN + ANSWERED, "other_language", model) == 0


def test_first_look_loses_nothing(model):
    for text in [*REFUSED, *ANSWERED, *FOREIGN, *PLAIN, QUESTION]:
        if alone(text, model) is None:
            assert with_options(QUESTION, text, OPTIONS, model, {}) in (None, "copied_question"), text
    assert unusual("Welcher Berg ist der höchste im ganzen Land und warum ist das so?", model) and not unusual(QUESTION, model) and not unusual(None, model)
    assert defect("Welcher Berg ist der höchste im ganzen Land und warum ist das so?", "Das ist doch der große Berg im Norden.", OPTIONS, model) is None


def test_languages_without_labels(spark):
    none = spark.createDataFrame([(None, None), ("x y", None), (None, "en"), ("  ", "fr"), ("a b c", "und"), ("d e", "klingon")], "text string, lang string")
    for m in (fit_languages(none), fit_languages(none.where("false")), fit_languages(None)):
        assert m.counts == LanguageModel({}).counts and m.usual and m.of("The right answer is the other one") == "en" and m.of("") == m.usual


def test_lcs():
    assert lcs(list("abcbdab"), list("bdcaba")).count(True) == 4 and lcs([], ["a"]) == [False] and lcs(["a"], []) == []


def test_pairs(spark, model):
    rows, names = corpus(spark)
    base = [(i, q, QUESTION, t, m) for i, q, t, m in rows]
    more = {5000: None, 5001: "I have no clue.", 5002: QUESTION, 5003: "La bonne réponse est Port Varn.", 5004: "The answer is Port Varn. The old mill sto", 5005: "B"}
    schema = "answer_id bigint, question_id string, question string, ai_answer string, full boolean"
    df = spark.createDataFrame(base + [(i, "q1", QUESTION, t, False) for i, t in more.items()] + [(5006, None, None, "B", None)], schema).withColumn("prior", F.when(F.col("full"), 0.8))
    questions = spark.createDataFrame([(f"q{i}", names[:4]) for i in range(5)], "question_id string, options array<string>")
    got = {r.answer_id: r.defect for r in defective_pairs(df, "answer_id", "question", "ai_answer", "question_id", "prior", questions, model).collect()}
    assert got == {5000: "empty", 5001: "refusal", 5002: "copied_question", 5003: "other_language", 5004: "truncated"}
    assert defective_pairs(df.where("answer_id < 0"), "answer_id", "question", "ai_answer", "question_id", "prior", questions, model).count() == 0


def test_small_table(spark, small, q):
    got = q["p5_found"](spark, small).collect()
    ids = [r.answer_id for r in got]
    assert len(ids) == len(set(ids)) and {r.defect for r in got} <= {"empty", "truncated", "refusal", "copied_question", "other_language"}
    assert q["p5_by_type"](spark, small).agg({"n": "sum"}).first()[0] == len(got)
    assert q["p4_shares"](spark, small).where("truncated_share > 1").count() == 0


def test_short_replies_are_judged(spark):
    rows, names = corpus(spark)
    cut = {1000: ("Option A, Lake So", 30), 1001: ("I believe it is", 26), 1002: ("Kerola Fal", 12), 1003: ("I believe it is Kerola Falls. The old mill stood in Xavomp", 60), 1004: ("Option A, Saint Br", 5), 1005: ("Kerola F", 2), 1006: ("Zumba Qu", 20)}
    fine = {2000: ("I believe it is Kerola Falls", 7), 2001: ("Lake Somi", 3), 2002: ("Kerola Fals", 3), 2003: ("Somil, Lake", 3), 2004: ("B", 1), 2005: ("Zumba Qualin", 3), 2006: ("Kerola Falls. The old mill stood near the river long before the bridge was built", 30)}
    all_ = [(i, q, t, 1 + len(t) // 4) for i, q, t, _ in rows] + [(i, "q4", t, n) for i, (t, n) in {**cut, **fine}.items()]
    df = spark.createDataFrame(all_, "response_id bigint, question_id string, content string, n int").withColumn("prior", prior_odds(F.col("content"), F.lit("stop"), F.col("n"), F.lit(96)))
    questions = spark.createDataFrame([(f"q{i}", names) for i in range(5)], "question_id string, options array<string>")
    got = {r.response_id for r in truncated_replies(df, "content", "question_id", "prior", questions).collect()}
    assert got == set(cut)


@pytest.mark.parametrize("text,cut,typed", [("answer is dyeatrel, Lake Non", False, True), ("I'd say Lake Nondy", True, False), ("Lake Nondyeatre", False, True), ("Wi thtîlake", False, False), ("TheWinter of Orm", True, False), ("ormlas,TheWinterof", False, True)])
def test_short_names(text, cut, typed):
    options = ["Lake Nondyeatrel", "The Winter of Ormlas"]
    assert cut_name(text, options, False, True) is cut and typed_name(text, options) is typed


def test_spent_tokens(spark):
    rows = [("Port Varn", 20, 64), ("Port Varn", 64, 64), ("Port Varn", 20, None), ("正解は", 4, 64), ("x" * 60, 40, 64), ("x" * 60, 16, 64)]
    df = spark.createDataFrame(rows, "t string, c int, m int").select(prior_odds(F.col("t"), F.lit("stop"), F.col("c"), F.col("m")).alias("p"))
    assert [r.p for r in df.collect()] == [2.2, 0.8, 2.2, -1.3, 2.2, 0.0]


def test_a_word_of_any_length(spark):
    import time

    long = "x" * 20 + "QmFzZTY0" * 130_000
    began = time.time()
    assert sum(len(c) for c, _ in contexts(long[:200_000])) < 200_000 * 6 * 40 and time.time() - began < 30
    rows, names = corpus(spark)
    df = spark.createDataFrame([*rows, (1000, "q1", long, True), (1001, "q1", "I believe it is Lake Somil. The old mill sto", True)], "response_id bigint, question_id string, content string, full boolean").withColumn("prior", F.when(F.col("full"), 0.8).otherwise(0.0))
    questions = spark.createDataFrame([(f"q{i}", names) for i in range(5)], "question_id string, options array<string>")
    assert 1001 in {r.response_id for r in truncated_replies(df, "content", "question_id", "prior", questions).collect()}
    assert time.time() - began < 90


def edits(a, b):
    """By the whole table; neighbours swapped are one edit."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_near():
    draw = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(draw.choices("abcde"[: draw.randint(2, 5)], k=draw.randint(0, 8))) for _ in range(2))
        assert all(near(a, b, k) == (edits(a, b) <= k) for k in range(5)), (a, b)


def lines_of(call):
    """Lines of Python that a call runs: its work, whatever the machine."""
    n, before = 0, sys.gettrace()

    def trace(frame, event, arg):
        nonlocal n
        n += event == "line"
        return trace

    sys.settrace(trace)
    try:
        call()
    finally:
        sys.settrace(before)
    return n


def test_work_of_near_and_gathered():
    a, b = "voulfumyunbromquimvalley", "vuolfumyumbromquinvalleys"
    assert near(a, b, 4) and lines_of(lambda: near(a, b, 4)) < 20 * len(b)  # not all pairs of letters
    list(gathered("The answer is Port Varn. The old mill stood near the river."))
    met = piece_contexts.cache_info()
    list(gathered("The answer is Port Somil. The old mill stood near the river."))
    assert piece_contexts.cache_info().misses - met.misses <= 2 and piece_contexts.cache_info().hits > met.hits  # what stands behind another word, and the name


@pytest.mark.parametrize("text", ["", "  ", "B", "I believe it is Port Varn. The mill of Orm and the Lake stood", "'Bob's' end…  (It's Jean-Luc 2nd's!) x.", "Éa é. 正解は Port Varn。 ٣² ½_a", ". a", "Well ... no . Yes", "ab" * 15_000 + ". C"])
def test_gathered_is_all_contexts(text):
    want, all_, ending = list(contexts(text)), Counter(), Counter()
    for keys, ends in gathered(text):
        all_.update(keys)
        ending.update(ends)
    assert all_ == Counter(k for k, _ in want) and ending == Counter(k for k, end in want if end)


def test_kept_pairs_change_no_probability(model):
    model.letters()
    for w in ("answer", "größe", "x", "正解"):
        assert math.isclose(model._all.log_by_pairs(w), sum(map(math.log, model._all.steps_of(f"^{w}$"))), abs_tol=1e-12)
