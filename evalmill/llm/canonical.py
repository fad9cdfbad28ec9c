"""Map free-entered values to the entries of a reference list.

The entries and their aliases form a trie over folded letters and digits. Each distinct value is a
Levenshtein automaton: one bit for each of its positions and number of edits. The trie is walked
level by level with the automata of a whole batch at once (numpy arrays of bit sets), dead branches
being dropped. A match may begin at any word of the value and end at any word, so that words around
a name don't matter, and an entry may be written in another order, abbreviated or with its number in
digits, as alias paths have that.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import scratch, spread, tasks

#: Ways in which words of names are abbreviated or written otherwise.
WORD_FORMS = {
    "saint": ["st"], "mount": ["mt"], "lake": ["l", "lk"], "port": ["pt"], "valley": ["vly", "val"], "falls": ["fls"],
    "and": ["n"], "the": [""], "one": ["1"], "two": ["2"], "three": ["3"], "four": ["4"], "five": ["5"], "six": ["6"],
    "seven": ["7"], "eight": ["8"], "nine": ["9"], "ten": ["10"], "eleven": ["11"], "twelve": ["12"],
}
#: Digits that stand for letters of the same look.
LOOKS = str.maketrans("01", "ol")
WORD = re.compile(r"[^\W_]+")
#: Words that frame an answer; they count for nothing when it is weighed how much of a value a match explains.
FRAMING = frozenset("answer is id say its it i think probably the option maybe perhaps believe".split())


def fold(text: str) -> list[str]:
    """The words of a text without case, accents, punctuation and look-alike digits."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", text.replace("&", " and ").replace("'", "").replace("’", "")) if not unicodedata.combining(c))
    return WORD.findall(flat.casefold().translate(LOOKS))


def limit(length: int) -> int:
    """Edits allowed for an alias of so many letters."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 10 else 3


def aliases(name: str) -> dict[str, bool]:
    """The folded ways to write a name: its words rotated, abbreviated, without its article. True for
    those that lack letters of a word, which must explain a value whole."""
    words = fold(name)
    forms = {tuple(words): False} if words else {}
    for i, w in enumerate(words):
        for other in WORD_FORMS.get(w, []) if len(words) > 1 else []:
            forms |= {(*f[:i], other.translate(LOOKS), *f[i + 1 :]): True for f in list(forms)}
    out: dict[str, bool] = {}
    for f, short in forms.items():
        for i in range(len(f)):
            a = "".join(f[i:] + f[:i])
            if len(a) >= 3 or not short:
                out[a] = short and out.get(a, True)
    return out


class Trie:
    """Breadth-first arrays: the children of a node are neighbours."""

    def __init__(self, entries: list[tuple[int, str]]):
        tree: dict = {}
        for entry, name in entries:
            for a, short in aliases(name or "").items():
                node = tree
                for c in a:
                    node = node.setdefault(c, {})
                node.setdefault("", set()).add((entry, len(a), short))
        self.codes: dict[str, int] = {}
        letter, first, count, ends, room, level = [-1], [0], [0], [tree.get("", set())], [0], [tree]
        parents = [-1]
        at = 0
        while level:
            following = []
            for node in level:
                kids = [(c, k) for c, k in node.items() if c]
                first[at], count[at] = len(letter), len(kids)
                for c, k in kids:
                    letter.append(self.codes.setdefault(c, len(self.codes)))
                    ends.append(k.get("", set()))
                    first.append(0)
                    count.append(0)
                    parents.append(at)
                    following.append(k)
                at += 1
            level = following
        room = [max((limit(n) for _, n, _ in e), default=-1) for e in ends]
        self.own = np.array(room, dtype="int8")
        for i in range(len(room) - 1, 0, -1):
            room[parents[i]] = max(room[parents[i]], room[i])
        self.letter, self.first, self.count = (np.array(x, dtype="int32") for x in (letter, first, count))
        self.room = np.array(room, dtype="int8")
        self.ends = [tuple(e) for e in ends]

    def search(self, values: list[list[str]], edits: int) -> list[set[tuple[int, int, bool, int]]]:
        """For each list of folded words, all entries with an alias in it within ``edits`` and the alias'
        own limit: (entry, letters of the alias, whether it is a short form, edits)."""
        found: list[set[tuple[int, int, bool, int]]] = [set() for _ in values]
        by_width: dict[int, list[int]] = {}
        for i, words in enumerate(values):
            if words:
                by_width.setdefault(sum(map(len, words)) // 64 + 1, []).append(i)
        for width, members in by_width.items():
            # The more edits, the more branches live at once; and bit sets as wide as the values are long.
            step = max(1, (4000 >> 2 * edits) // width)
            for k in range(0, len(members), step):
                self._search(values, members[k : k + step], width, edits, found)
        return found

    def _search(self, values, members, width, edits, found) -> None:
        letters = len(self.codes)
        masks = np.zeros((len(members), letters + 1, width), dtype="uint64")
        begin, end = np.zeros((len(members), width), dtype="uint64"), np.zeros((len(members), width), dtype="uint64")
        one = [np.uint64(1 << b) for b in range(64)]
        for row, i in enumerate(members):
            p = 0
            for w in values[i]:
                begin[row, p >> 6] |= one[p & 63]
                for c in w:
                    masks[row, self.codes.get(c, letters), p >> 6] |= one[p & 63]
                    p += 1
                end[row, p >> 6] |= one[p & 63]

        def up(x):
            y = x << np.uint64(1)
            if width > 1:
                y[:, 1:] |= x[:, :-1] >> np.uint64(63)
            return y

        after = masks >> np.uint64(1)  # of the letter that follows a position
        if width > 1:
            after[:, :, :-1] |= masks[:, :, 1:] << np.uint64(63)
        state = [begin]
        for _ in range(edits):
            state.append(state[-1] | up(state[-1]))
        swapped = [np.zeros_like(begin)] * (edits + 1)  # one letter into two that changed places
        query, node = np.arange(len(members)), np.zeros(len(members), dtype="int32")
        while len(query):
            n = self.count[node]
            at = np.repeat(np.arange(len(node)), n)
            child = self.first[node][at] + (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n))
            query = query[at]
            mask, following = masks[query, self.letter[child]], after[query, self.letter[child]]
            new, swaps, before = [], [], None
            for e in range(edits + 1):
                old = state[e][at]
                r = up(old & mask)
                if e:
                    r |= before | up(before | new[-1]) | up(up(swapped[e][at] & mask))
                new.append(r)
                swaps.append(before & following if e else old[:0])
                before = old
            room = self.room[child]
            alive = new[0].any(axis=1)
            for e in range(1, edits + 1):
                alive |= (new[e] | swaps[e]).any(axis=1) & (room >= e)
            query, child = query[alive], child[alive]
            state = [r[alive] for r in new]
            swapped = [r[alive] if e else state[0] for e, r in enumerate(swaps)]
            own = self.own[child]
            done = own < 0
            for e in range(edits + 1):
                hit = ~done & (own >= e) & (state[e] & end[query]).any(axis=1)
                for q, c in zip(query[hit], child[hit]):
                    found[members[q]].update((entry, length, short, e) for entry, length, short in self.ends[c] if e <= limit(length))
                done |= hit
            node = child


def choose(words: list[str], candidates: set[tuple[int, int, bool, int]]) -> tuple[int, int, bool]:
    """(entry, score, whether more edits can't give a better one).

    The entry that explains most letters with the fewest edits; 0 if none does or two do it equally.
    What a match leaves over, framing words aside, counts against it, and a match that is short or
    written in a short form must be the whole value but for a letter if it has edits.
    """
    size = sum(len(w) for w in words if w not in FRAMING)
    best: dict[int, int] = {}
    for entry, length, short, e in candidates:
        over = max(0, size - length)
        if e and (e > 2 or not length - 1 <= size <= length + 1 if short else over > (2 if length < 10 else length // 2)):
            continue
        best[entry] = max(best.get(entry, -99), length - 3 * e - over)
    if not best:
        return 0, -99, False
    top = max(best.values())
    winners = [x for x, score in best.items() if score == top]
    return (winners[0] if len(winners) == 1 else 0), top, top >= size - 3


def nearest(trie: Trie, words: list[list[str]]) -> list[tuple[int, int]]:
    """(entry or 0, score) of each value: nearest first, more edits only where fewer don't explain it."""
    out = [(0, -99)] * len(words)
    open_ = [i for i, w in enumerate(words) if w]
    for edits in (0, 1, 3):
        following = []
        for i, found in zip(open_, trie.search([words[i] for i in open_], edits)):
            entry, score, settled = choose(words[i], found)
            out[i] = (entry, score)
            if not settled:
                following.append(i)
        open_ = following
    return out


def turned(text: str) -> str:
    """A text with its parts around the first comma changed."""
    return " ".join(reversed(text.split(",", 1)))


def match_values(values: DataFrame, entries: DataFrame, value: str, block: int = 200_000) -> DataFrame:
    """``values`` (one row for each distinct value) with ``entry_id``, 0 for those that match nothing.

    ``entries`` (entry_id, name) is a reference list of a few thousand rows. It is taken in blocks of
    ``block`` entries, each of which is sent to the tasks as one trie. What matches no entry of any block is
    tried once more with its parts changed around a comma: a name that was broken by a blank before they changed places.
    """
    spark = values.sparkSession
    n = entries.count()
    parts = [entries] if n <= block else [entries.where(F.pmod(F.xxhash64("entry_id"), F.lit(-(-n // block))) == i) for i in range(-(-n // block))]
    tries = [spark.sparkContext.broadcast(Trie([(r.entry_id, r.name) for r in part.select("entry_id", "name").where("entry_id is not null and name is not null").collect()])) for part in parts]
    schema = f"`{value}` string, entry_id int, score int"

    def matched(texts: DataFrame, form: Callable[[str], str]) -> DataFrame:
        out = None
        for trie in tries:

            def match(batches: Iterator[pd.DataFrame], trie=trie) -> Iterator[pd.DataFrame]:
                for b in batches:
                    t = b[value].tolist()
                    got = nearest(trie.value, [fold(form(x)) for x in t])
                    yield pd.DataFrame({value: t, "entry_id": [x[0] for x in got], "score": [x[1] for x in got]})

            found = texts.select(value).mapInPandas(match, schema)
            out = found if out is None else out.unionByName(found)
        if len(tries) == 1:
            return out
        best = out.groupBy(value).agg(F.max("score").alias("score"))
        tied = F.when(F.count_distinct("entry_id") == 1, F.max("entry_id")).otherwise(0)
        return out.join(best, [value, "score"]).groupBy(value).agg(tied.alias("entry_id"), F.max("score").alias("score"))

    first = scratch(matched(values, str), "matched")
    open_ = (F.col("entry_id") == 0) & F.contains(value, F.lit(","))
    again = matched(first.where(open_).repartition(tasks(spark), value), turned).select(value, F.col("entry_id").alias("_entry"), F.col("score").alias("_score"))
    better = F.struct("_entry", "_score") > F.struct("entry_id", "score")
    retried = first.where(open_).join(again, value).select(value, F.when(better, F.col("_entry")).otherwise(F.col("entry_id")).alias("entry_id"))
    return first.where(~open_).select(value, "entry_id").unionByName(retried)


def canonical_entries(rows: DataFrame, entries: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``entry_id``: the entry each non-null ``value`` stands for, 0 if none.

    Each distinct value is matched once. Rows with a null value are left out; blank values match
    nothing. Copies of a row each come out; an empty reference list leaves all unmatched; a column
    ``entry_id`` of the rows is replaced.
    """
    rows = rows.drop("entry_id")
    distinct = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    distinct = scratch(distinct, "values")
    total = distinct.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    lookup = match_values(spread(distinct, value), entries, value)
    lookup = scratch(lookup, "lookup").join(distinct, value)
    return lookup_join(rows.where(F.col(value).isNotNull()), lookup, [value], "_n", total)
