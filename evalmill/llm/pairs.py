"""Broken prompt and response pairs, each with its type of defect.

Copies are found by shingle containment and confirmed by the longest common subsequence of tokens.
Refusals are aligned with short templates whose places are classes of words, anywhere in a reply of
any length; what a reply chooses is looked for beside them. Languages are told by the model of
``language``, truncation by that of ``truncation``.
"""

from __future__ import annotations

import functools
import html
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch, spread, tasks
from .canonical import fold
from .language import LanguageModel, script, words
from .truncation import cut_replies, is_open_json, judged_replies

TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
TAG = re.compile(r"<[^<>]{0,80}>|```\w*|`+|[*_#~|>]+")
DEFECTS = ("empty", "truncated", "refusal", "copied_question", "other_language")

# --- refusals: classes of words, and the order in which a refusal has them ------------------------

JOINED = [(re.compile(p, re.I), to) for p, to in (
    (r"\bcan not\b", "cannot"), (r"\b(do|does|did|is|are|was|were|have|has|had|could|would|should|will|must|need)\s+not\b", r"\1n't"), (r"\b(ca|do|does|did|is|are|was|were|have|has|had|could|would|should|wo)nt\b", r"\1n't"),
    (r"\bn\s*/\s*a\b", "unknown"), (r"\bam not\b|'m not\b", " not"),
)]
CLASSES = {
    "not": "not no never none nothing nobody cannot without lack lacks lacked lacking insufficient neither nor little",
    "cannot": "cannot can't couldn't won't wouldn't shan't unable refuse refuses refusing decline declines declining declined incapable impossible refrain abstain",
    "able": "able willing comfortable allowed permitted qualified equipped designed supposed prepared inclined going position authorised authorized free competent confident ready keen happy",
    "unwilling": "prefer rather must have need wish want choose like",
    "say": "answer answered answering answers respond responding reply say saying tell telling help helping assist assisting assistance provide providing give giving offer offering comply complying choose choosing pick picking select selecting decide deciding determine determined determining guess guessing speculate speculating comment commenting fulfil fulfill fulfilled discuss discussing identify verify confirm judge address share recall remember commit settle venture certify responses response solve attempt",
    "know": "know knows knew known knowledge information info idea clue clues data access context record records expertise certainty basis confidence detail details answer opinion sources source inkling notion memory evidence grounds insight recollection facts",
    "sure": "sure certain confident positive",
    "beyond": "outside beyond past exceeds above",
    "scope": "expertise knowledge scope training trained remit abilities ability capabilities capability competence domain area field understanding reach purview limits grasp know learned learnt taught",
    "proper": "appropriate proper right ethical responsible something place",
    "cover": "cover covers covered covering mention mentions include includes contain contains address addresses",
    "ask": "could can would may please need require provide give share clarify",
    "more": "more further additional clarify clarification rephrase reword context details specifics",
    "off": "sure idea clue certain",
    "speak": "i i'm i'd i've i'll we we're we'd we've my our me us sorry afraid apologies apologize apologise regret unfortunately this that request it question there model ai",
}
CLASSES = {k: frozenset(v.split()) for k, v in CLASSES.items()}
#: (classes in order, words that may lie between two of them).
TEMPLATES = [
    (("cannot", "say"), 4), (("not", "able", "say"), 4), (("unwilling", "not", "say"), 3), (("not", "want", "say"), 3), (("unwilling", "cannot"), 2), (("say", "cannot"), 2),
    (("speak", "not", "know"), 4), (("not", "know"), 3), (("cannot", "know"), 3), (("not", "off"), 1), (("unsure",), 0), (("beyond", "scope"), 5),
    (("not", "proper", "say"), 5), (("not", "proper", "me"), 2), (("know", "not", "cover"), 6), (("not", "know", "cover"), 6), (("ask", "more", "more"), 3), (("say", "not", "possible"), 3), (("than", "able", "say"), 3), (("not", "way", "say"), 5),
]
CLASSES |= {
    "want": frozenset("want wish like care dare intend mean plan propose".split()),
    "unsure": frozenset("unsure uncertain unknown unaware unfamiliar undecided stumped clueless unanswerable undeterminable".split()),
    "me": frozenset("me us my".split()), "possible": frozenset("possible available accessible feasible".split()),
    "than": frozenset(("than",)), "way": frozenset("way means method chance hope".split()),
}
#: The classes of each word that has any, and the places of each template.
KINDS = {w: frozenset(k for k, members in CLASSES.items() if w in members) for w in frozenset().union(*CLASSES.values())}
PLACES = [frozenset(template) for template, _ in TEMPLATES]
NO_KIND, NOT = frozenset(), frozenset(("not",))
#: Every template has a place of one of these classes: a reply without such a word aligns with none.
KEYS = ("not", "cannot", "unsure", "beyond", "more", "than")
KEY_WORDS = frozenset().union(*(CLASSES[k] for k in KEYS))
#: Replies that decline only where they are all that is said.
ALONE = frozenset("pass skip dunno unknown none sorry no idea clue comment answer next question sure not thanks thank you please".split())
DECLINES = ({"pass"}, {"skip"}, {"dunno"}, {"unknown"}, {"comment"}, {"sorry", "no"}, {"no", "answer"})
#: What introduces a choice behind a doubt.
CHOICE = re.compile(
    r"(?:^|[^\w'])(?:[A-D](?=[).:,]|\s*$)|\(?[A-D]\)|(?:option|answer is|it is|it's|is|say|choose|pick|go with|going with|be)\s+\(?[A-D]\b|(?:answer|guess|pick|choice|bet|vote|money|hunch|instinct)\s*(?:is|:|would be|goes to|goes with|on)"
    r"|i(?:'d| would| will|'ll)?\s+(?:still\s+)?(?:say|guess|go\s+(?:with|for)|going\s+with|pick|choose|opt)\b(?!\s+(?:that|so|not)\b)|(?:probably|perhaps|maybe|likely|presumably|possibly)\s+(?:it\s+is\s+|it's\s+)?[\"“*(]*[A-Z0-9]|\bit is\s*[.!]?\s*$)"
)
VERDICT = re.compile(r"\b(?:true|false|yes)\b(?!\s+or\s+(?:true|false|no)\b)", re.I)
BOTH = re.compile(r"\b(?:true|false|yes|no)(?:,)?\s+(?:or|and|nor)\s+(?:true|false|yes|no)\b", re.I)
SENTENCE = re.compile(r"[^.!?;\n]+[.!?;\n]*")


def tokens(text: str) -> list[str]:
    return [t.lower() for t in TOKEN.findall(text.replace("’", "'"))]


def said(answer: str) -> str | None:
    """What a reply says: without markup, and of a whole JSON object its answer; None if that is empty."""
    text = html.unescape(answer).strip()
    fenced = re.sub(r"^```\w*\s*|\s*```$", "", text)
    if is_open_json(fenced) is False:
        try:
            value = json.loads(fenced[fenced.index("{") : fenced.rindex("}") + 1])
        except ValueError:
            value = None
        if isinstance(value, dict):
            got = value.get("answer") if "answer" in value else " ".join(str(v) for v in value.values() if isinstance(v, (str, int, float, bool)))
            if isinstance(got, (dict, list)):
                got = " ".join(map(str, got.values() if isinstance(got, dict) else got))
            text = "" if got is None else str(got)
    elif re.fullmatch(r"[\s\[\]{}\"':,]*(?:null|none|nil)?[\s\[\]{}\"':,]*", fenced, re.I) and not re.fullmatch(r"\W*none\W*", fenced, re.I):
        return None
    text = TAG.sub(" ", text)
    return text if any(c.isalnum() for c in text) else None


def lcs(a: list[str], b: list[str]) -> list[bool]:
    """For each token of ``b`` whether it belongs to the longest common subsequence with ``a``; a bit for each pair of places is kept."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    free, columns = full, []
    for y in b:
        hit = free & places.get(y, 0)
        free = (free + hit | free - hit) & full
        columns.append(free)
    inside, i, j = [False] * len(b), len(a), len(b)
    while i and j:
        if columns[j - 1] >> i - 1 & 1:  # a's token adds nothing up to here
            i -= 1
        else:
            if a[i - 1] == b[j - 1]:
                inside[j - 1] = True
                i -= 1
            j -= 1
    return inside


def shingles(t: list[str], k: int = 3) -> set[tuple[str, ...]]:
    return {tuple(t[i : i + k]) for i in range(max(1, len(t) - k + 1))}


def aligned(t: list[str]) -> list[bool]:
    """For each token whether a refusal template is aligned there; all places of a text are tried."""
    kinds = [KINDS.get(w, NO_KIND) | NOT if w.endswith("n't") else KINDS.get(w, NO_KIND) for w in t]
    held = NO_KIND.union(*kinds)
    covered = [False] * len(t)
    for (template, gap), places in zip(TEMPLATES, PLACES):
        if not places <= held:
            continue
        for start, k in enumerate(kinds):
            if template[0] not in k:
                continue
            at = [start]
            for slot in template[1:]:
                following = next((j for j in range(at[-1] + 1, min(len(t), at[-1] + gap + 2)) if slot in kinds[j]), None)
                if following is None:
                    break
                at.append(following)
            else:
                for j in range(at[0], at[-1] + 1):
                    covered[j] = True
    return covered


def declining(text: str, question: str = "") -> tuple[bool, str]:
    """(whether a reply declines, what it says beside that); words of the question that it gives back are left out."""
    text = text.replace("’", "'")
    plain = tokens(text)
    if not (KEY_WORDS.intersection(plain) or "n/a" in text.lower().replace(" ", "") or any(w.endswith(("nt", "n't")) for w in plain)) and (len(plain) > 6 or not ALONE.issuperset(plain)):
        return False, text
    for pattern, to in JOINED:
        text = pattern.sub(to, text)
    q = tokens(question)
    given, rest, declines, n = shingles(q, 4) if len(q) > 3 else set(), [], False, 0
    for m in SENTENCE.finditer(text):
        sentence = m.group()
        found = list(TOKEN.finditer(sentence))
        t = [x.group().lower() for x in found]
        back = [False] * len(t)
        for i in range(len(t) - 3):
            if tuple(t[i : i + 4]) in given:
                back[i : i + 4] = [True] * 4
        n += len(t)
        covered = aligned(["" if b else w for w, b in zip(t, back)])
        declines |= any(covered)
        kept, at = [], 0
        for x, c, b in zip(found, covered, back):
            if c or b:
                kept.append(sentence[at : x.start()])
                at = x.end()
        rest.append("".join([*kept, sentence[at:]]))
    left = " ".join(rest)
    t = tokens(text)
    if not declines and len(t) <= 6 and t and ALONE.issuperset(t) and any(d.issubset(t) for d in DECLINES):
        declines = True
    return declines, left


def near(a: str, b: str, k: int) -> bool:
    """Whether two words are ``k`` edits apart or less; neighbours swapped are one edit."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > k or k < 1:
        return False
    if not a:
        return True
    if len(set(a).difference(b)) > k or len(set(b).difference(a)) > k:  # an edit brings or takes one letter
        return False
    # The columns of the table of edits as bit sets of where it goes up and down (Hyyrö).
    last, full = 1 << len(a) - 1, (1 << len(a)) - 1
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    up, down, diagonal, before, edits = full, 0, 0, 0, len(a)
    for y in b:
        hit = places.get(y, 0)
        swapped = (~diagonal & hit) << 1 & before
        diagonal = ((hit & up) + up ^ up | hit | down | swapped) & full
        more, less = (down | ~(diagonal | up)) & full, diagonal & up
        if more & last:
            edits += 1
        elif less & last:
            edits -= 1
        more, less = more << 1 | 1, less << 1
        up, down, before = (less | ~(diagonal | more)) & full, more & diagonal & full, hit
    return edits <= k


@functools.lru_cache(maxsize=20_000)
def _parts(option: str) -> tuple[str, ...]:
    """The words of an option that tell it."""
    return tuple(w for w in fold(option) if len(w) > 2 and w not in ("the", "and", "for"))


def chooses(text: str, question: str = "", options: list[str] | None = None) -> bool:
    """Whether a text chooses: a letter, a verdict, a turn of speech, an option, or a name that isn't the question's."""
    if CHOICE.search(text) or VERDICT.search(BOTH.sub(" ", text)):
        return True
    t, asked = set(fold(text)), set(fold(question))
    named = 0
    for option in options or []:
        parts = [w for w in _parts(option) if w not in asked]
        letters = sum(map(len, parts))
        hit = sum(len(p) for p in parts if p in t or any(near(w, p, (len(p) + 1) // 4) for w in t))
        named += bool(letters) and hit * 2 > letters
    if named and named < max(2, len(options or [])):
        return True
    ask = set(tokens(question))
    return any(capital and not start and w not in ask and w not in CLASSES["speak"] and len(w) > 2 for w, capital, start in words(text))


def is_refusal(text: str, question: str = "", options: list[str] | None = None) -> bool:
    """Whether a reply declines or claims not to know, and chooses nothing."""
    declines, rest = declining(text, question)
    return declines and not chooses(rest, question, options)


def is_copy(question: str, text: str) -> bool:
    """Whether a reply gives back the question and no answer."""
    q, a = tokens(question), tokens(text)
    held = set(a)
    if len(q) < 3 or sum(w in held for w in q) < 0.75 * len(q):  # no subsequence can be longer
        return False
    joined = " ".join(q)
    if joined not in " ".join(a):
        contained = shingles(q)
        if len(contained & shingles(a)) < 0.5 * len(contained):
            return False
    inside = lcs(q, a)
    rest = [w for w, c in zip(a, inside) if not c and w not in ASKED]
    return sum(inside) >= 0.75 * len(q) and len(rest) <= max(1, len(q) // 8) and not any(w in ("true", "false", "yes", "no") or len(w) == 1 and w in "bcd" for w in rest)


#: Fixed: frames around a question that is given back.
ASKED = "question q the is you asked asks was your prompt well so ok okay right hmm here again let me see answering answer a".split()

# --- languages ------------------------------------------------------------------------------------

#: Log-odds from which the words of a reply are of another language than its question's, by the number of words that tell it (the last for more): one may be a slip.
FOREIGN = (99.0, 9.0, 6.0, 5.0)
VERDICTS = frozenset(("true", "false"))
#: Fixed: true and false in other languages, where these two are the options.
VERDICT_WORDS = frozenset("""wahr unwahr falsch richtig stimmt vrai faux verdadero falso cierto vero verdadeiro waar onwaar juist onjuist sant falskt sandt
falsk prawda fałsz pravda nepravda doğru yanlış adevărat igaz hamis totta oui nein sí sì sim ja si""".split())


def foreign_script(text: str, question: str) -> bool:
    """Whether a tenth of a text's letters, and two at least, are of a script that its question has none of."""
    if text.isascii() and question.isascii():
        return False
    mine, asked = script(text), script(question)
    foreign = sum(n for s, n in mine.items() if s not in asked and s not in ("LATIN", "MODIFIER", "FEMININE", "MASCULINE") and s)
    if not asked and not foreign:
        return False
    latin = mine["LATIN"] if asked and "LATIN" not in asked else 0
    return foreign + latin >= 2 and (foreign + latin) * 10 >= sum(mine.values())


@functools.lru_cache(maxsize=20_000)
def _names(options: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """The words of the options, also two of them run together, and each option's letters."""
    names = [w for o in options for w, _, _ in words(o)]
    return names + [a + b for a, b in zip(names, names[1:])], ["".join(c for c in o.lower() if c.isalpha()) for o in options]


def own_words(text: str, question: str, options: list[str], model: LanguageModel, base: str) -> list[tuple[str, bool]]:
    """The words of a reply without names: those of the options, as they are or with slips, run together or split, and of the question."""
    verdict = all(o.lower() in VERDICTS for o in options) and bool(options)
    known = {w for w, _, _ in words(question)}
    names, squeezed = ([], []) if verdict else _names(tuple(options))
    exact = known.union(VERDICTS if verdict else names)
    said_ = [(w, c and not verdict) for w, c, start in words(text) if start]
    out = []
    for i, (w, capital) in enumerate(said_):
        if w in exact:
            continue
        if model.most(w, capital, base) > 1:
            pieces = [w, w + said_[i + 1][0] if i + 1 < len(said_) else w, said_[i - 1][0] + w if i else w]
            if any(abs(len(x) - len(n)) <= (k := max(1, (len(n) + (j == 0)) // (3 + (j > 0)))) and near(x, n, k) for j, x in enumerate(pieces) for n in names if len(n) > 2) or len(w) < 4 and any(x in s for x in pieces[1:] if len(x) > 4 for s in squeezed):
                continue
        out.append((w, capital))
    return out


def spoken(text: str, question: str, options: list[str], model: LanguageModel, memo: dict) -> str | None:
    """The language of a reply if it isn't its question's: a code, or ``other``."""
    if foreign_script(text, question):
        return "other"
    if question not in memo:
        memo[question] = model.of(question) if question else model.usual
    base = memo[question]
    own = own_words(text, question, options, model, base)
    if base == "en" and options and all(o.lower() in VERDICTS for o in options) and len(own) <= 3 and any(w in VERDICT_WORDS or w.partition("'")[2] in VERDICT_WORDS for w, _ in own):
        return "other"
    best, odds = model.compare(own, base)
    return best.strip("-") if best != base and odds > FOREIGN[min(model.telling(own, best, base), 3)] else None


def alone(answer: str | None, model: LanguageModel) -> str | None:
    """What an answer tells by itself: ``empty``, ``fine`` (a letter or verdict, whatever was asked), ``?`` if it may decline or
    be of another language than the usual one, or null: it may still give back its question."""
    text = said(answer) if answer else None
    if text is None:
        return "empty"
    bare = text.strip().lower()
    if bare in VERDICTS or re.fullmatch(r"\W*[a-d]\W*", bare):
        return "fine"
    if declining(text)[0]:
        return "?"
    if not text.isascii() and set(script(text)) - {"LATIN", "MODIFIER", "FEMININE", "MASCULINE"}:
        return "?"
    own = [(w, False) for w, _, start in words(text) if start and w not in VERDICTS]
    if len(own) <= 3 and any(w in VERDICT_WORDS or w.partition("'")[2] in VERDICT_WORDS for w, _ in own):
        return "?"
    return "?" if model.may_be(own, model.usual, FOREIGN) else None


def unusual(question: str | None, model: LanguageModel) -> bool:
    """Whether a question is of another language than the usual one, or another script: its answers are held against that."""
    return bool(question) and (model.of(question) != model.usual or not question.isascii() and bool(set(script(question)) - {"LATIN", "MODIFIER", "FEMININE", "MASCULINE"}))


def with_options(question: str | None, answer: str, options: list[str], model: LanguageModel, memo: dict) -> str | None:
    """The defect of a pair that isn't ``empty`` or ``fine``, other than truncation."""
    text = said(answer) if answer else None
    if text is None:
        return "empty"
    if is_refusal(text, question or "", options):
        return "refusal"
    if question and is_copy(question, text):
        return "copied_question"
    return "other_language" if spoken(text, question or "", options, model, memo) else None


def defect(question: str | None, answer: str | None, options: list[str] | None = None, model: LanguageModel | None = None) -> str | None:
    """The defect of one pair, other than truncation."""
    model = model or LanguageModel({})
    first = alone(answer, model)
    if first in ("empty", "fine"):
        return "empty" if first == "empty" else None
    if first == "?" or unusual(question, model):
        return with_options(question, answer or "", options or [], model, {})
    return "copied_question" if question and is_copy(question, said(answer) or "") else None


def defective_pairs(rows: DataFrame, id_col: str, question_col: str, answer_col: str, question_id: str, prior_col: str, questions: DataFrame, model: LanguageModel) -> DataFrame:
    """(id, defect) of the defective ``rows``, one defect each.

    ``questions`` has the ``options`` by ``question_id``; a question that isn't there has none. A
    truncated answer counts as that, whatever else it is; a null, blank or empty one is ``empty``.
    Without a question no copy is found and the language is held to be the usual one. Rows repeated under
    one id come out once each.

    Each distinct answer is looked at once; only the rows whose answer may decline or be foreign, or
    whose question is, go on to be judged with their question's options, and of the others those long enough to be copies.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    # Calls to what follows would be doubled by filters on what they give, were they held to be deterministic.
    @F.pandas_udf(T.StringType())
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for answers in batches:
            yield pd.Series([alone(a, shared.value) for a in answers], dtype="object")

    @F.pandas_udf(T.BooleanType())
    def strange(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for asked in batches:
            yield pd.Series([unusual(q, shared.value) for q in asked], dtype="bool")

    @F.pandas_udf(T.StringType())
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo: dict = {}
        for asked, answers, options in batches:
            if len(memo) > 50_000:
                memo.clear()
            yield pd.Series([with_options(q, a, [x for x in o if x] if o is not None else [], shared.value, memo) for q, a, o in zip(asked, answers, options)], dtype="object")

    @F.pandas_udf(T.BooleanType())
    def copied(asked: pd.Series, answers: pd.Series) -> pd.Series:
        return pd.Series([is_copy(q, said(a) or "") for q, a in zip(asked, answers)], dtype="bool")

    look, strange, judge, copied = (f.asNondeterministic() for f in (look, strange, judge, copied))
    named = rows.select(F.col(id_col).alias("_id"), F.col(question_id).alias(question_id), F.col(question_col).alias("_q"), F.col(answer_col).alias("_a"), F.col(prior_col).alias("_p"))
    judged = judged_replies(named, "_a", question_id, "_p", {"_look": look})
    blank = named.where(F.col("_a").isNull() | ~F.col("_a").rlike(r"\S")).select("_id", F.lit("empty").alias("_d"), F.lit(None).cast("boolean").alias("_whole"))
    told = judged.select("_given.*", "_look")
    odd = scratch(spread(named.select("_q").where("_q is not null").distinct(), "_q").select("_q", strange("_q").alias("_odd")).where("_odd"), "odd")
    told = told.join(odd, "_q", "left")
    ask = F.coalesce(F.col("_look") == "?", F.lit(False)) | (F.col("_odd") & (F.coalesce(F.col("_look"), F.lit("")) != "fine") & (F.coalesce(F.col("_look"), F.lit("")) != "empty"))
    ask = F.coalesce(ask, F.lit(False))
    known = questions.select(F.col(question_id).alias("_qid"), F.col("options").alias("_options"))
    # Whatever Spark takes its size for, it is work for all cores.
    asked = told.where(ask).join(known, F.col(question_id) == F.col("_qid"), "left").repartition(tasks(rows.sparkSession), "_id").select("_id", "_q", "_a", judge("_q", "_a", "_options").alias("_d"))
    # A copy has three quarters of its question's words; markup may hide some of the signs between them.
    size = lambda c: F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+"))
    long = told.where(~ask & F.col("_look").isNull() & F.col("_q").isNotNull()).where(size("_a") >= 0.6 * size("_q"))
    copies = long.repartition(tasks(rows.sparkSession), "_id").where(copied("_q", "_a")).select("_id", "_q", "_a", F.lit("copied_question").alias("_d"))
    last = lambda c: F.regexp_extract(F.lower(c), r"(?U)(\w+)\W*$", 1)
    both = asked.where("_d is not null").unionByName(copies).unionByName(told.where("_look = 'empty'").select("_id", "_q", "_a", F.lit("empty").alias("_d")))
    other = both.select("_id", "_d", F.when(F.col("_d") == "copied_question", last("_q") == last("_a")).alias("_whole")).unionByName(blank)
    other = scratch(other.select(F.col("_id").alias(id_col), F.col("_d").alias("defect"), "_whole"), "other")
    # A question that is given back to its last word isn't cut, however unusual an end that is.
    whole = other.where("defect = 'copied_question' and _whole").select(id_col).distinct()
    cut = cut_replies(judged, question_id, questions).select(F.col("_id").alias(id_col), F.lit("truncated").alias("defect"))
    cut = scratch(cut.join(whole, id_col, "left_anti"), "cut")
    return cut.unionByName(other.drop("_whole").join(cut.select(id_col).distinct(), id_col, "left_anti"))
