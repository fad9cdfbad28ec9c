"""Texts that stop before they were complete.

A backward character n-gram model, counted over all texts, tells how likely a text goes on after its
final context. Contexts are read backwards from a place to three kinds of start: to the begin of the
last word (does the word end here?), to the begin of the last name (does the name?), and over 8 to 32
characters with names and numbers masked (does the sentence?). A text is truncated if its own final
context has log-odds below a threshold, all other texts of its column being the witness. The thresholds
are the same for every column and language, and texts of all languages are counted together.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import lookup_join
from ..session import scratch, spread, tasks
from .canonical import aliases, fold, limit

#: Signs and marks after which a text still counts as stopping where they begin.
MARKS = re.compile(r"(?:\s|…|\.{2,}|[\[(<](?:cut|truncated|continued|snip|more|\.\.\.|…)[^\])>]*[\])>]|[*_`\"“”’'.!?。]|(?<=\s)-+)+$", re.I)
SENTENCE_END = re.compile(r"[.!?。][*_`\"”’')\]}\s]*$")
ELLIPSIS = re.compile(r"(?:…|\.\.+)[*_`\"”’')\]}\s]*$")
CLOSERS = "*_`\"”’')]}.!?…。"
NAME = re.compile(r"[^\W\d_a-zß-öø-ÿ][\w'’-]*(?: (?:(?:of|for|and|the|de) )*[^\W\d_a-zß-öø-ÿ][\w'’-]*| (?:of|for|and the|and|de)(?= |$))*")
STOP = re.compile(r"[.!?。]")
PIECE = re.compile(r"\S+")
#: In ASCII: words, of which those with a capital are masked, and digits as 0.
LATIN_WORD = re.compile(r"[A-Za-z][A-Za-z'-]*")
DIGITS = str.maketrans("123456789", "000000000")
#: Characters of a masked context, the longest first, by the sign of its kind.
ORDERS = (("0", 28), ("1", 18), ("2", 10))
#: Characters of a word and of a name that a context holds at most: the model's order there.
WORD_ORDER, NAME_ORDER = 24, 48
#: Answers of one word; other texts begin with the same letters.
WHOLE = frozenset("true false yes no y n a b c d vrai faux oui non wahr falsch ja nein richtig verdadero falso cierto sí si vero".split())
#: Log-odds of an end under which a final context counts as cut; by kind of context.
THRESHOLDS = {"word": -2.2, "last": -2.9, "never_last": -4.5, "name": -2.2, "masked": -2.2, "masked_name": -2.6}
#: Other texts with the context that it takes to tell anything.
LEAST = {"word": 4, "last": 30, "name": 4, "masked": 10}
FLUSH = 400_000


def core(text: str) -> str:
    """The text without what may stand after its last letter."""
    return MARKS.sub("", text)


def masked(text: str) -> tuple[str, list[int]]:
    """Capitalised words as X, digits as 0; and how long that is up to each place of the text."""
    out: list[str] = []
    upto = [0]
    if text.isascii():
        last = 0
        for m in LATIN_WORD.finditer(text):
            a, b = m.span()
            if text[a] < "a":
                out += text[last:a], "X"
                at = upto[-1] + a - last
                upto.extend(range(upto[-1] + 1, at + 1))
                upto.extend([at + 1] * (b - a))
                last = b
        out.append(text[last:])
        upto.extend(range(upto[-1] + 1, upto[-1] + len(text) - last + 1))
        return "".join(out).translate(DIGITS), upto
    word = capital = False
    for c in text:
        if c.isalpha() or (word and c in "'’-"):
            if not word:
                word, capital = True, c.isupper()
                out.append("X" if capital else c)
            elif not capital:
                out.append(c)
        else:
            word = False
            out.append("0" if c.isdigit() else c)
        upto.append(len(out))
    return "".join(out), upto


def sentence_ends(text: str) -> set[int]:
    """The places where a sentence or the text ends."""
    n = len(text)
    ends = {n}
    for m in STOP.finditer(text):
        a, b = m.start(), m.end()
        while a and text[a - 1] in CLOSERS:
            a -= 1
        while b < n and text[b] in CLOSERS:
            b += 1
        if b == n or text[b].isspace():
            ends.add(a)
    return ends


def contexts(text: str, final: bool = False) -> Iterator[tuple[str, bool]]:
    """(context, whether what it names ends here) for each place of a text, or for its end only.

    The first character of a context is its kind: w, v and e for a word (does it end, by what stands
    before it or alone; does the text end behind it), n for a name, a number for masked ones of that order.
    """
    n = len(text)
    if not n:
        return
    mask, upto = masked(text)
    low = list(accumulate(map(str.islower, mask), initial=0))
    ends = sentence_ends(text)
    start = 0
    names = iter([*[m.span() for m in NAME.finditer(text)], (n + 1, n + 1)])
    following = next(names)
    if final:  # begin where the last word does
        start = n if text[-1].isspace() else n - len(text.rsplit(None, 1)[-1])
    for i in range(n if final else 1, n + 1):
        c = text[i - 1]
        if c.isspace():
            start = i
            continue
        while i > following[1]:
            following = next(names)
        if final and i < n:
            continue
        end = i in ends
        boundary = i == n or not text[i].isalnum()
        if not c.isdigit():  # a number is known by the sentence around it only
            at = max(start - 2, i - WORD_ORDER - 2)
            yield ("w" if at >= 0 else "w^") + text[max(at, 0) : i], boundary
            word = text[max(start, i - WORD_ORDER) : i]
            yield "v" + word, boundary
            if boundary:
                yield "e" + word, end
                if following[0] < i <= following[1]:
                    at = max(following[0] - 2, i - NAME_ORDER - 2)
                    yield ("n" if at >= 0 else "n^") + text[max(at, 0) : i], i == following[1]
        e = upto[i]
        if boundary or mask[e - 1] != "X":
            for k, order in ORDERS:
                at = e - order
                if at > -8 and low[e] - low[at if at > 0 else 0] > 2:  # of names alone it tells nothing
                    yield (k + mask[at:e] if at > 0 else k + "^" + mask[:e]), end


#: Characters of pieces whose contexts are kept, as they are likely to come again, and contexts that are gathered at once.
PIECE_KEPT, GATHERED = 24, 10_000


@functools.lru_cache(maxsize=20_000)
def piece_contexts(before: str, piece: str, ends: tuple[int, ...], low: int, high: int) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The contexts of the words (w, v, e) in what stands between spaces, at its places ``low`` to ``high``, and those of them that end.

    ``before`` are the two characters before it, or less where the text begins with it; ``ends`` are places in it.
    """
    whole, at, n = before + piece, len(before), len(piece)
    all_: list[str] = []
    ending: list[str] = []
    for i in range(low, high + 1):
        if piece[i - 1].isdigit():  # a number is known by the sentence around it only
            continue
        boundary = i == n or not piece[i].isalnum()
        start = max(at - 2, at + i - WORD_ORDER - 2)
        word = piece[max(0, i - WORD_ORDER) : i]
        here = [("w" if start >= 0 else "w^") + whole[max(start, 0) : at + i], "v" + word]
        all_ += here
        if boundary:
            ending += here
            all_.append("e" + word)
            if i in ends:
                ending.append("e" + word)
    return tuple(all_), tuple(ending)


def gathered(text: str) -> Iterator[tuple[list[str], list[str]]]:
    """``contexts`` in any order, many at once: all of them, and those that end."""
    n = len(text)
    if not n:
        return
    mask, upto = masked(text)
    low = list(accumulate(map(str.islower, mask), initial=0))
    ends = sentence_ends(text)
    all_: list[str] = []
    ending: list[str] = []
    orders = [(k, order, k + "^") for k, order in ORDERS]
    stops, next_stop = sorted(ends), 0
    for m in PIECE.finditer(text):
        a, b = m.span()
        while stops[next_stop] <= a:
            next_stop += 1
        following = next_stop
        while following < len(stops) and stops[following] <= b:
            following += 1
        before, piece, places = text[max(a - 2, 0) : a], text[a:b], tuple(i - a for i in stops[next_stop:following])
        of = piece_contexts if b - a <= PIECE_KEPT else piece_contexts.__wrapped__
        for begin_at in range(0, b - a, GATHERED):
            own, own_ending = of(before, piece, places, begin_at + 1, min(b - a, begin_at + GATHERED))
            all_ += own
            ending += own_ending
            if len(all_) > GATHERED:
                yield all_, ending
                all_, ending = [], []
        for i in range(a + 1, b + 1):
            e = upto[i]
            if mask[e - 1] == "X" and i < n and text[i].isalnum():
                continue
            end, so_far = i in ends, low[e]
            for k, order, begin in orders:
                at = e - order
                if at > 0:
                    if so_far - low[at] > 2:
                        all_.append(key := k + mask[at:e])
                        if end:
                            ending.append(key)
                elif at > -8 and so_far > 2:
                    all_.append(key := begin + mask[:e])
                    if end:
                        ending.append(key)
            if len(all_) > GATHERED:
                yield all_, ending
                all_, ending = [], []
    for m in NAME.finditer(text):
        a, b = m.span()
        for i in range(a + 1, b + 1):
            c = text[i - 1]
            if not c.isspace() and not c.isdigit() and (i == n or not text[i].isalnum()):
                at = max(a - 2, i - NAME_ORDER - 2)
                all_.append(key := ("n" if at >= 0 else "n^") + text[max(at, 0) : i])
                if i == b:
                    ending.append(key)
        if len(all_) > GATHERED:
            yield all_, ending
            all_, ending = [], []
    yield all_, ending


def is_open_json(text: str) -> bool | None:
    """Whether a JSON object lacks its end; None if the text is none."""
    at = text.find("{")
    if at < 0 or re.search(r"[^\s`:a-zA-Z.,!]", text[:at]) or not re.match(r'\{\s*(?:"|$)', text[at:]):
        return None
    depth, quoted, escaped = 0, False, False
    for c in text[at:]:
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return False
    return True


def looked_at(text: str) -> tuple[str, bool, bool, list[str]]:
    """(what the model sees, whether it is an open JSON object, whether a sentence sign ends it, its final contexts).

    A JSON object that is whole is complete, whatever it says; so are one-word answers.
    """
    state = is_open_json(text)
    seen = "" if state is not None else core(text)
    if not any(map(str.isalnum, seen)) or seen.strip(" \t\n*_`\"'()[]:").lower() in WHOLE:
        seen = ""
    stopped = bool(SENTENCE_END.search(text)) and not ELLIPSIS.search(text)
    return seen, bool(state), stopped, [k for k, _ in contexts(seen, final=True)]


def _count(texts: DataFrame) -> DataFrame:
    """(context, n, ends) over all ``text``s; each task adds up what it sees before anything is shuffled."""
    schema = T.StructType([T.StructField("context", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ends", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        ended: Counter = Counter()

        def flush() -> pd.DataFrame:
            keys = list(seen)
            out = pd.DataFrame({"context": keys, "n": [seen[k] for k in keys], "ends": [ended[k] for k in keys]})
            seen.clear()
            ended.clear()
            return out

        for b in batches:
            for text in b["core"]:
                for all_, ending in gathered(text):
                    seen.update(all_)
                    ended.update(ending)
                    if len(seen) > FLUSH:  # within a text, too
                        yield flush()
        if seen:
            yield flush()

    return spread(texts.select("core"), "core", tasks_per_core=1).mapInPandas(count, schema).groupBy("context").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def log_odds(n: Column, ends: Column) -> Column:
    """Of an end, by the other texts: the text itself is taken off both."""
    return F.log((ends - 1 + 0.3) / (n - ends + 0.7))


def text_odds(texts: DataFrame, text_col: str) -> DataFrame:
    """``texts`` (one row for each distinct text) with what the model says of their ends.

    Columns: ``core``, ``open`` (an open JSON object), ``stopped`` (a sentence sign ends it), and the
    log-odds that the last word, the text behind it, the last name and the sentence end here; null
    where too few other texts have the context. Null, empty and blank texts have none.
    """
    prepared = T.StructType([T.StructField("core", T.StringType()), T.StructField("open", T.BooleanType()), T.StructField("stopped", T.BooleanType()), T.StructField("finals", T.ArrayType(T.StringType()))])

    @F.pandas_udf(prepared)
    def prepare(column: pd.Series) -> pd.DataFrame:
        rows = []
        for t in column:
            rows.append(looked_at(t or ""))
        return pd.DataFrame(rows, columns=["core", "open", "stopped", "finals"])

    base = scratch(texts.select(F.col(text_col).alias("_text"), prepare(text_col).alias("_p")).select("_text", F.monotonically_increasing_id().alias("_id"), "_p.*"), "texts")
    counts = _count(base.where("not open"))
    finals = base.where("not open").select("_id", F.explode("finals").alias("context"))
    met = finals.join(counts, "context").select("_id", F.substring("context", 1, 1).alias("kind"), "n", log_odds(F.col("n"), F.col("ends")).alias("odds"))

    def of(kind: str, least: int) -> Column:
        return F.max(F.when((F.col("kind") == kind) & (F.col("n") > least), F.col("odds")))

    found = met.groupBy("_id").agg(
        F.coalesce(of("w", LEAST["word"]), of("v", LEAST["word"])).alias("word"), of("e", LEAST["last"]).alias("last"), of("n", LEAST["name"]).alias("name"),
        F.coalesce(*(of(k, LEAST["masked"]) for k, _ in ORDERS)).alias("masked"),
    )
    return base.join(found, "_id", "left").drop("_id", "finals").withColumnRenamed("_text", text_col)


def cut_evidence(prior: Column, thresholds: dict | None = None) -> Column:
    """What shows that a text of ``text_odds`` is cut: json, word, sentence, name or null.

    ``prior`` is added to the thresholds (see ``prior_odds``). From ``PRIOR_SPENT`` on, more was written
    than the text holds, so that a last word that no other text has counts as cut, too.
    """
    t = THRESHOLDS | (thresholds or {})
    ends_in_name = F.col("core").rlike(r"(?:^|[^\p{L}\p{N}])\p{Lu}[\p{L}'’-]*$")
    masked_limit = F.when(ends_in_name, t["masked_name"]).otherwise(t["masked"]) + prior / 2
    turned = F.col("core").rlike(r",\s+(?:the\s+)?\p{Lu}[^,]*$") & (prior < PRIOR_SPENT)  # "Marthaiquos, The Cathedral of"
    running = (
        F.when(F.col("word") < t["word"] + prior, "word")
        .when(F.col("masked") < masked_limit, "sentence")
        .when((F.col("last") < t["last"] + prior) & (F.coalesce("masked", F.lit(-1.0)) < 0) & ~turned, "sentence")
        .when((F.col("last") < t["never_last"]) & (prior >= 0) & ~turned, "sentence")
        .when((F.col("name") < t["name"] + prior) & ~turned, "name")
        .when((prior >= PRIOR_SPENT) & F.col("word").isNull() & F.col("core").rlike(r"[\p{L}\p{N}]$"), "word")
    )
    return F.when(F.col("open"), "json").when(~F.col("stopped"), running)


#: Finish reasons that say a reply is complete. They are sometimes wrong.
COMPLETE = ("stop", "eosFound", "eos", "end_turn")
#: Shift of the thresholds for replies that used up their tokens or don't say that they are complete, and for short ones that do.
PRIOR_OPEN, PRIOR_SHORT, SHORT = 0.8, -1.3, 46
#: Shift for replies below the token limit that took more tokens than their text: SPENT and as many a byte.
PRIOR_SPENT, SPENT, SPENT_BYTE = 2.2, 2, 1.25 / 4


def prior_odds(text: Column, finish_reason: Column, completion_tokens: Column, max_tokens: Column) -> Column:
    """How much sooner a text is held to be cut, by what its record says; that alone makes no text truncated."""
    at_limit = F.coalesce((max_tokens > 0) & (completion_tokens >= max_tokens), F.lit(False))
    complete = F.coalesce(finish_reason.isin(*COMPLETE), F.lit(False))
    marked = text.rlike(r"(?:…|\.\.)\s*$")
    spent = F.coalesce(~at_limit & (completion_tokens > SPENT + SPENT_BYTE * F.octet_length(text)), F.lit(False))
    return F.when(spent, PRIOR_SPENT).when(at_limit | ~complete, PRIOR_OPEN).when((F.length(text) < SHORT) & ~marked, PRIOR_SHORT).otherwise(0.0)


def prefix_cost(tail: str, name: str, starts: set[int] | None = None) -> list[int]:
    """For each length of a prefix of ``name``, the fewest edits between it and some end of ``tail``, which begins anywhere or at ``starts``."""
    row = list(range(len(name) + 1))
    for i, c in enumerate(tail, 1):
        new = [0 if starts is None or i in starts else row[0] + 1]
        for j, d in enumerate(name, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return row


def _reach(options: list[str]) -> int:
    """Letters at a text's end that can belong to one of the names: twice the longest one's, as edits are no more than its letters."""
    return max(60, 2 * max(map(len, options), default=0))


def cut_cost(core_text: str, options: list[str], at_limit: bool = False, by_word: bool = False) -> tuple[int, int, int]:
    """Fewest edits between the text's end and one of the names without its end, that part's letters, and the fewest to a name as it is.

    With ``by_word`` it begins where a word of the text does.
    """
    words = [w for w in fold(re.split(r"[.!?:]\s", core_text)[-1]) if w != "the"]
    joined = "".join(words)
    tail = joined[-_reach(options) :]
    starts = None
    if by_word:
        begins = [sum(map(len, words[:i])) + k for i, w in enumerate(words) for k in ((0, 3) if w.startswith("the") else (0,))]
        starts = {b - len(joined) + len(tail) for b in begins}
    cost, length, straight = 99, 0, 99
    for option in options:
        letters = "".join(w for w in fold(option) if w != "the")
        costs = prefix_cost(tail, letters, starts)
        if letters:
            straight = min(straight, costs[-1])
        for j, c in enumerate(costs):
            if j >= (2 if at_limit else 4) and j < len(letters) - (not at_limit) and c - j / 100 < cost - length / 100:
                cost, length = c, j
    return cost, length, straight


def whole_cost(core_text: str, options: list[str]) -> tuple[int, int]:
    """Fewest edits between the text's end and one of the names as a whole, and that name's letters.

    It may be written in any order or short form, joined, or turned around a comma.
    """
    last = re.split(r"[.!?:]\s", core_text)[-1]
    said = fold(last)
    reach = _reach(options)
    tails = {"".join(w for w in said if w != "the")[-reach:], "".join(said)[-reach:]}
    before, comma, behind = last.rpartition(",")
    if comma:  # what stands before a comma may have words around the name
        tails |= {"".join([*fold(behind), *fold(before)[-k:]])[-reach:] for k in (1, 2, 3)}
    whole, size = 99, 0
    for option in options:
        name = " ".join(w for w in fold(option) if w != "the")
        for a in {*aliases(name), *aliases(option)}:
            found = min(prefix_cost(x, a)[-1] for x in tails)
            if found < whole:
                whole, size = found, len(a)
    return whole, size


def cut_name(core_text: str, options: list[str], at_limit: bool = False, by_word: bool = False) -> bool:
    """Whether a text ends in one of the names, but without the name's end.

    It is closer to a prefix of a name, by two edits or more, than to any name as a whole, in whatever
    order or short form that is written. Articles don't count. At the token limit a name that lacks a
    single letter, or has but two, is enough if it is written without a slip.
    """
    cost, length, straight = cut_cost(core_text, options, at_limit, by_word)
    near = length >= 4 and cost <= length // 6 and straight > 2 + cost
    if not near and not (at_limit and not cost and straight):
        return False  # most texts; other orders and short forms take longer to compare
    whole, _ = whole_cost(core_text, options)
    if at_limit and not cost and whole:
        return len(fold(core_text)[-1]) <= length or length >= 4
    return near and whole - cost >= 2 and whole > 2 + cost


def typed_name(core_text: str, options: list[str]) -> bool:
    """Whether a text ends in one of the names as a whole, but for slips; two letters lost at its end are none."""
    whole, size = whole_cost(core_text, options)
    return whole <= limit(size) and whole - cut_cost(core_text, options)[0] < 2


@F.pandas_udf(T.BooleanType())
def cut_name_udf(cores: pd.Series, options: pd.Series, priors: pd.Series) -> pd.Series:
    return pd.Series([o is not None and cut_name(c, [x for x in o if x], p > 0, p < 0) for c, o, p in zip(cores, options, priors)], dtype="bool")


@F.pandas_udf(T.BooleanType())
def typed_name_udf(cores: pd.Series, options: pd.Series) -> pd.Series:
    return pd.Series([o is not None and typed_name(c, [x for x in o if x]) for c, o in zip(cores, options)], dtype="bool")


def judged_replies(rows: DataFrame, text_col: str, question_col: str, prior_col: str, more: dict[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """``rows`` with a text that isn't blank, as ``_given``, with the odds of ``text_odds`` and the evidence that these give.

    Each distinct text is judged once; ``more`` are further columns made of it, in the same pass.
    """
    given = [c for c in rows.columns if c != "evidence"]
    packed = rows.select(F.struct(*given).alias("_given"), F.col(text_col).alias("_text"), F.col(question_col).alias("_question"), F.coalesce(prior_col, F.lit(0.0)).alias("_prior"))
    full = packed.where(F.col("_text").isNotNull() & F.col("_text").rlike(r"\S"))
    distinct = scratch(full.groupBy("_text").agg(F.count("*").alias("_n")), "distinct")
    total = distinct.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    odds = text_odds(spread(distinct.select("_text"), "_text"), "_text").withColumns({c: f("_text") for c, f in (more or {}).items()})
    judged = lookup_join(full, scratch(odds, "odds").join(distinct, "_text"), ["_text"], "_n", total)
    return scratch(judged.withColumn("evidence", cut_evidence(F.col("_prior"))).drop("_text"), "judged")


def cut_replies(judged: DataFrame, question_col: str, questions: DataFrame) -> DataFrame:
    """The rows of ``judged_replies`` that are truncated, with ``evidence``; see ``truncated_replies``."""
    # No more than a few per cent of the rows: texts whose last word nobody else wrote or most go on with, and short ones that may be names with a slip.
    unseen = F.col("evidence").isNull() & ~F.col("stopped") & (F.coalesce("word", F.lit(-1.0)) < 0) & F.col("core").rlike(r"\p{L}{2}$")
    short = F.col("evidence").isNotNull() & ~F.col("open") & (F.col("_prior") < 0) & (F.size(F.split("core", r"\s+")) < 5)
    options = questions.select(F.col(question_col).alias("_question"), F.col("options").alias("_options"))
    named = judged.where(unseen).select("_given", "core", "_question", "_prior").join(options, "_question").where(cut_name_udf("core", "_options", "_prior"))
    cut = judged.where(short).select("_given", "core", "_question", "evidence").join(options, "_question", "left").where(~typed_name_udf("core", "_options"))
    out = judged.where(F.col("evidence").isNotNull() & ~short).select("_given.*", "evidence").unionByName(cut.select("_given.*", "evidence"))
    return out.unionByName(named.select("_given.*", F.lit("option").alias("evidence")))


def truncated_replies(rows: DataFrame, text_col: str, question_col: str, prior_col: str, questions: DataFrame) -> DataFrame:
    """``rows`` whose text is truncated, with ``evidence``.

    Each distinct text is judged once. What no other text can witness (a last word that none of them
    has) is held against the names among the ``options`` of the row's question (``questions``:
    question_col, options). So is a text of less than five words with a negative prior that the model
    holds to be cut: it is complete if it is an option as typed, with a slip. Rows with a null or blank text are never truncated; a null ``prior_col``
    (see ``prior_odds``) counts as 0; a column ``evidence`` is replaced; a question that isn't known, or has no options, leaves a text complete.
    """
    return cut_replies(judged_replies(rows, text_col, question_col, prior_col), question_col, questions)
