"""The language that the words of a short text are of.

A model of letters for each language gives each word a probability, by contexts of one to four letters
with Witten-Bell smoothing, down to letter pairs of all languages together. Any word may also be a
name, as a model of names has it, so that a name tells nothing, or a slip, which keeps to the letter pairs of
its language. Texts are compared by the log-odds of their words; one more model, of the words of all
languages but one, stands for languages that no text was labelled with.

The models are fitted on a bounded sample of labelled texts: about ``per_language`` whole texts of each
label, drawn by a hash (repeated texts all or none), of which the ``per_vocabulary`` most frequent words of each label are kept, but
for those that are far more frequent under another label: texts quote other languages.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
START = re.compile(r"(?:^|[.!?:;>\n\"“„«(*–-])\s*$")
#: Articles of the Universal Declaration of Human Rights: words of languages that few or no texts are labelled with.
DECLARATION = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Een ieder heeft aanspraak op alle rechten en vrijheden, in deze Verklaring opgesomd, zonder enig onderscheid van welke aard ook, zoals ras, kleur, geslacht, taal, godsdienst, politieke of andere overtuiging, nationale of maatschappelijke afkomst, eigendom, geboorte of andere status. Een ieder heeft het recht op leven, vrijheid en onschendbaarheid van zijn persoon.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todos os seres humanos podem invocar os direitos e as liberdades proclamados na presente Declaração, sem distinção alguma, nomeadamente de raça, de cor, de sexo, de língua, de religião, de opinião política ou outra, de origem nacional ou social, de fortuna, de nascimento ou de qualquer outra situação. Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. Var och en är berättigad till alla de rättigheter och friheter som uttalas i denna förklaring utan åtskillnad av något slag, såsom på grund av ras, hudfärg, kön, språk, religion, politisk eller annan uppfattning, nationellt eller socialt ursprung, egendom, börd eller ställning i övrigt. Var och en har rätt till liv, frihet och personlig säkerhet.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej Deklaracji bez względu na jakiekolwiek różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych i innych, narodowości, pochodzenia społecznego, majątku, urodzenia lub jakiegokolwiek innego stanu. Każdy człowiek ma prawo do życia, wolności i bezpieczeństwa swej osoby.",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
}
#: A few plain sentences, the same in each language: its commonest words, where no text is labelled with it.
PLAIN = {
    "en": "I think the right answer to this question is the second one, but I am not sure. That is true, the other one is false. It must be an old town by the river, because nobody else was there. Yes, of course; no, certainly not.",
    "de": "Ich denke, dass die richtige Antwort auf diese Frage die zweite ist, aber ich bin nicht sicher. Das ist wahr, das andere ist falsch. Es muss eine alte Stadt am Fluss sein, weil sonst niemand dort war. Ja, natürlich; nein, sicher nicht.",
    "fr": "Je pense que la bonne réponse à cette question est la deuxième, mais je ne suis pas sûr. C'est vrai, l'autre est faux. Ce doit être une vieille ville au bord de la rivière, parce qu'il n'y avait personne d'autre. Oui, bien sûr ; non, certainement pas.",
    "es": "Pienso que la respuesta correcta a esta pregunta es la segunda, pero no estoy seguro. Eso es verdad, lo otro es falso. Tiene que ser una ciudad antigua junto al río, porque no había nadie más. Sí, claro; no, seguro que no.",
    "it": "Penso che la risposta giusta a questa domanda sia la seconda, ma non sono sicuro. Questo è vero, l'altro è falso. Deve essere una vecchia città sul fiume, perché non c'era nessun altro. Sì, certo; no, sicuramente no.",
    "nl": "Ik denk dat het goede antwoord op deze vraag het tweede is, maar ik weet het niet zeker. Dat is waar, het andere is niet waar. Het moet een oude stad aan de rivier zijn, want er was niemand anders. Ja, natuurlijk; nee, zeker niet.",
    "pt": "Penso que a resposta correta a esta pergunta é a segunda, mas não tenho a certeza. Isso é verdade, o outro é falso. Deve ser uma cidade antiga junto ao rio, porque não havia mais ninguém. Sim, claro; não, de certeza que não.",
    "sv": "Jag tror att det rätta svaret på den här frågan är det andra, men jag är inte säker. Det är sant, det andra är falskt. Det måste vara en gammal stad vid floden, för ingen annan var där. Ja, naturligtvis; nej, absolut inte.",
    "pl": "Myślę, że właściwa odpowiedź na to pytanie to ta druga, ale nie jestem pewien. To prawda, a tamto to fałsz. To musi być stare miasto nad rzeką, bo nikogo innego tam nie było. Tak, oczywiście; nie, na pewno nie.",
    "da": "Jeg tror, at det rigtige svar på dette spørgsmål er det andet, men jeg er ikke sikker. Det er sandt, det andet er falsk. Det må være en gammel by ved floden, for der var ingen andre. Ja, selvfølgelig; nej, bestemt ikke.",
    "fi": "Luulen, että oikea vastaus tähän kysymykseen on toinen, mutta en ole varma. Se on totta, toinen on väärin. Sen täytyy olla vanha kaupunki joen varrella, koska siellä ei ollut ketään muuta. Kyllä, tietysti; ei, ei varmasti.",
    "cs": "Myslím, že správná odpověď na tuto otázku je ta druhá, ale nejsem si jistý. To je pravda, to druhé je nepravda. Musí to být staré město u řeky, protože tam nikdo jiný nebyl. Ano, samozřejmě; ne, určitě ne.",
    "tr": "Bu sorunun doğru cevabının ikincisi olduğunu düşünüyorum ama emin değilim. Bu doğru, diğeri yanlış. Nehir kıyısında eski bir şehir olmalı, çünkü orada başka kimse yoktu. Evet, tabii; hayır, kesinlikle hayır.",
    "ro": "Cred că răspunsul corect la această întrebare este al doilea, dar nu sunt sigur. Acesta este adevărat, celălalt este fals. Trebuie să fie un oraș vechi lângă râu, pentru că nu era nimeni altcineva. Da, desigur; nu, sigur nu.",
    "hu": "Azt hiszem, hogy a helyes válasz erre a kérdésre a második, de nem vagyok biztos benne. Ez igaz, a másik hamis. Egy régi városnak kell lennie a folyó mellett, mert senki más nem volt ott. Igen, persze; nem, biztosan nem.",
}
NAMES, OTHER = "-names", "-other"
#: Share of words that are names, of those with a capital and the others; share that are slips.
NAME_SHARE, SLIP_SHARE = {True: 0.4, False: 0.004}, 0.03
#: Log-odds against the usual language from which a text of its own is held to be of another.
CLEAR = 18.0


def words(text: str) -> list[tuple[str, bool, bool]]:
    """(word in lower case, whether it has a capital, whether a sentence may begin with it); words with digits tell nothing."""
    shout = text == text.upper()
    out = []
    for m in WORD.finditer(text):
        w = m.group().replace("’", "'")
        if w.isalpha() or not any(map(str.isdigit, w)):
            capital, at = w[0].isupper() and not shout, m.start()
            inside = at > 1 and text[at - 1] == " " and text[at - 2].isalnum()  # as most are
            out.append((w.lower(), capital, not capital or not inside and bool(START.search(text[max(0, at - 4) : at]))))
    return out


@functools.lru_cache(maxsize=100_000)
def _script(c: str) -> str:
    return unicodedata.name(c, " ").split(" ")[0] if c.isalpha() else ""


def script(text: str) -> Counter:
    """Letters by script, as the first word of their names tells it."""
    if text.isascii():
        return Counter({"LATIN": sum(map(str.isalpha, text))})
    return Counter(x for x in map(_script, text) if x)


def code(label):
    """Of a label as en, EN or en-GB the language: a Column. Labels of other forms, and und, have none."""
    lower = F.lower(F.regexp_extract(label, r"^\s*(\p{Alpha}{2,3})(?:[-_].*)?\s*$", 1))
    return F.when((lower != "") & (lower != "und"), lower)


class Letters:
    """Probabilities of words in several languages at once, by contexts of up to ``orders[language] - 1`` letters.

    Of each context there is one vector of what it leaves to shorter ones and, for each letter that
    follows, one of what that has of it; ``base`` gives what is left in the end.
    """

    def __init__(self, counts: dict[str, dict[str, int]], orders: dict[str, int], base: Letters | None = None):
        self.names, self.base = list(counts), base
        following: dict[str, dict[str, np.ndarray]] = {}
        for column, name in enumerate(self.names):
            for w, k in counts[name].items():
                weight, s = math.sqrt(k), f"^{w}$"  # words of a frequent sentence mustn't outweigh all others
                for i in range(1, len(s)):
                    for o in range(min(orders[name], i + 1)):
                        vectors = following.setdefault(s[i - o : i], {})
                        if s[i] not in vectors:
                            vectors[s[i]] = np.zeros(len(self.names))
                        vectors[s[i]][column] += weight
        self.left, self.of = {}, {}
        for context, vectors in following.items():
            stacked = np.array(list(vectors.values()))
            kinds = (stacked > 0).sum(axis=0)
            total = np.where(kinds, stacked.sum(axis=0) + kinds, 1.0)
            self.left[context] = np.where(kinds, kinds / total, 1.0)
            self.of.update({(context, c): v / total for c, v in vectors.items()})
        self.longest = max(orders.values(), default=0)
        self._rows: dict[str, int] = {}
        self._kept = np.empty((1024, 2, len(self.names)))
        self._pairs: dict[str, float] = {}

    def steps(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities by all contexts, and by those of one letter at most. What a letter has behind a context is kept."""
        s = f"^{word}$"
        k = self.longest - 1
        rows = [self._row(s[max(0, i - k) : i + 1]) for i in range(1, len(s))]
        both = self._kept[rows].sum(axis=0)
        return both[0], both[1]

    def _row(self, window: str) -> int:
        at = self._rows.get(window)
        if at is None:
            if len(self._rows) == len(self._kept):
                self._kept = np.concatenate([self._kept, np.empty_like(self._kept)])
            at = self._rows[window] = len(self._rows)
            self._logs(window, self._kept[at])
        return at

    def _logs(self, s: str, out: np.ndarray) -> None:
        i = len(s) - 1
        p = short = np.full(len(self.names), self.base.steps_of(s[-2:])[0] if self.base else 1 / 500)
        for o in range(min(self.longest, i + 1)):
            left = self.left.get(s[i - o : i])
            if left is None:
                break
            p = p * left
            of = self.of.get((s[i - o : i], s[i]))
            if of is not None:
                p = p + of
            if o < 2:
                short = p
        np.log(p, out=out[0])
        np.log(short, out=out[1])

    def steps_of(self, s: str) -> list[float]:
        """Probabilities of the letters of a word between its marks, for a single language."""
        out = []
        for i in range(1, len(s)):
            p = 1 / 500
            for o in range(min(self.longest, i + 1)):
                left = self.left.get(s[i - o : i])
                if left is None:
                    break
                of = self.of.get((s[i - o : i], s[i]))
                p = p * left[0] + (0.0 if of is None else of[0])
            out.append(float(p))
        return out

    def log_by_pairs(self, word: str) -> float:
        """Log probability of a word for a single language with contexts of one letter at most. That of each pair is kept."""
        s, total = f"^{word}$", 0.0
        for i in range(1, len(s)):
            pair = s[i - 1 : i + 1]
            log = self._pairs.get(pair)
            if log is None:
                if len(self._pairs) > 200_000:
                    self._pairs.clear()
                log = self._pairs[pair] = math.log(self.steps_of(pair)[0])
            total += log
        return total


class LanguageModel:
    """``counts``: words of each language, and names under NAMES. The tables are made on first use, once in each process."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.counts = {k: dict(v) for k, v in counts.items()}
        for language, text in DECLARATION.items():
            mine = self.counts.setdefault(language, {})
            for w, _, _ in words(f"{text} {PLAIN[language]}"):
                mine[w] = mine.get(w, 0) + 9
        labelled = {k: sum(v.values()) for k, v in self.counts.items() if k != NAMES}
        self.usual = max(labelled, key=lambda k: (labelled[k], k == "en", k))
        self._letters: Letters | None = None

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "usual": self.usual, "_letters": None}

    def letters(self) -> Letters:
        if self._letters is None:
            both: Counter = Counter()
            foreign: Counter = Counter()
            for k, v in self.counts.items():
                both.update(v)
                if k not in (NAMES, self.usual):
                    foreign.update(v)
            columns = {k: v for k, v in self.counts.items() if k != NAMES} | {OTHER: foreign, NAMES: self.counts.get(NAMES, {})}
            self._all = Letters({"all": both}, {"all": 2})
            self._letters = Letters(columns, {k: 3 if k in (OTHER, NAMES) else 5 for k in columns}, self._all)
            self._languages = self._letters.names[:-1]
            self._place = {k: i for i, k in enumerate(self._languages)}
            self._memo: dict = {}
            self._gains: dict = {}
        return self._letters

    def log(self, word: str, capital: bool) -> np.ndarray:
        """Log probabilities of a word in each language, in the order of ``languages``."""
        letters, key = self.letters(), (word, capital)
        found = self._memo.get(key)
        if found is None:
            if len(self._memo) > 200_000:
                self._memo.clear()
            if len(letters._rows) > 200_000:
                letters._rows.clear()
            full, short = (np.maximum(x, -600.0) for x in letters.steps(word))
            share = NAME_SHARE[capital]
            name = share * math.exp(max(full[-1], self._all.log_by_pairs(word), -600.0))
            found = self._memo[key] = np.log((1 - share - SLIP_SHARE) * np.exp(full[:-1]) + SLIP_SHARE * np.exp(short[:-1]) + name)
        return found

    def gains(self, word: str, capital: bool, base: str) -> np.ndarray:
        """Log-odds of a word in each language against ``base``."""
        return self._gained(word, capital, base)[0]

    def most(self, word: str, capital: bool, base: str) -> float:
        """The largest of these log-odds."""
        return self._gained(word, capital, base)[1]

    def _gained(self, word: str, capital: bool, base: str) -> tuple[np.ndarray, float]:
        self.letters()
        key = (word, capital, base)
        found = self._gains.get(key)
        if found is None:
            if len(self._gains) > 100_000:
                self._gains.clear()
            p = self.log(word, capital)
            gains = p - p[self._place[base]]
            found = self._gains[key] = gains, float(gains.max())
        return found

    def languages(self) -> list[str]:
        self.letters()
        return self._languages

    def compare(self, said: list[tuple[str, bool]], base: str) -> tuple[str, float]:
        """The language that fits best, and its log-odds against ``base``."""
        if not said:
            return base, 0.0
        total = sum(self.gains(w, c, base) for w, c in said)
        best = int(np.argmax(total))
        return (self._languages[best], float(total[best])) if total[best] > 0 else (base, 0.0)

    def may_be(self, said: list[tuple[str, bool]], base: str, limits: tuple[float, ...]) -> bool:
        """Whether some of these words may have log-odds against ``base``, in one language, above the limit for as many words as tell it."""
        if not said:
            return False
        found = [self._gained(w, c, base) for w, c in said]
        if sum(most for _, most in found) <= min(limits):  # no language has more
            return False
        gains = np.array([g for g, _ in found])
        told = np.minimum((gains > 0.5).sum(axis=0), len(limits) - 1)
        return bool((np.maximum(gains, 0.0).sum(axis=0) > np.asarray(limits)[told]).any())

    def telling(self, said: list[tuple[str, bool]], language: str, base: str) -> int:
        """How many of these words speak for a language."""
        at = self.languages().index(language)
        return sum(bool(self.gains(w, c, base)[at] > 0.5) for w, c in said)

    def of(self, text: str) -> str:
        """The language of a text, by its words but those that are names by their capital; the usual one if nothing tells otherwise."""
        best, odds = self.compare([(w, c) for w, c, start in words(text) if start], self.usual)
        return best if odds > CLEAR and best != OTHER else self.usual


def count_words(texts: Iterable[tuple[str, str]]) -> Counter:
    """(language, word) of (label, text); names under NAMES."""
    seen: Counter = Counter()
    for label, text in texts:
        for w, capital, start in words(text):
            seen[(NAMES if capital and not start else label, w)] += 1
    return seen


def own_counts(counts: dict[str, dict[str, int]], quoted: float = 1 / 3) -> dict[str, dict[str, int]]:
    """Without words whose share under a label is less than ``quoted`` of that under another, and labels with less than a hundredth of the usual one's words."""
    sizes = {k: sum(v.values()) for k, v in counts.items() if k != NAMES}
    kept = {k for k, n in sizes.items() if n * 100 >= max(sizes.values())}
    most: dict[str, float] = {}
    for k in kept:
        for w, n in counts[k].items():
            most[w] = max(most.get(w, 0.0), n / sizes[k])
    return {k: {w: n for w, n in v.items() if k == NAMES or n / sizes[k] >= quoted * most[w]} for k, v in counts.items() if k in kept or k == NAMES}


def fit_languages(docs: DataFrame | None, text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, per_vocabulary: int = 5000) -> LanguageModel:
    """The model fitted on ``docs``; without them, or without labels, on the declaration alone.

    Null and blank texts and labels that are none count for nothing; wrong labels are outvoted. Labels
    with less than a hundredth of the usual one's words are left out. The counts that come to the driver
    are no more than ``per_vocabulary`` for each label, of which no more than 60 are taken.
    """
    if docs is None:
        return LanguageModel({})
    labelled = docs.select(code(F.col(lang_col).cast("string")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and trim(text) <> ''")
    # Drawn by the hash of a text, each label with the share that gives as many; so no text is sorted or moved.
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(60)
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("_n"))
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0
    sample = labelled.join(F.broadcast(sizes), "lang").where(place < share).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(*k, n) for k, n in count_words(zip(b["lang"], b["text"])).items()], columns=["lang", "word", "n"])

    counted = sample.mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    largest = counted.groupBy("lang").agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), "lang").limit(60)
    ranked = counted.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("_k") <= per_vocabulary)
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in ranked.join(F.broadcast(largest), "lang").collect():
        counts[r.lang][r.word] = r.n
    return LanguageModel(own_counts(counts))
