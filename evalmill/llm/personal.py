"""Personal information inside free text: found, and replaced by typed placeholders.

A text is rewritten by small transducers into a plain shadow: look-alike letters, digits and signs
become the usual ones, invisible characters go, spelt digits become digits, and disguised "at" and
"dot" of addresses become signs. Each character of the shadow keeps the span of the text it stands
for, so that identifiers found in the shadow are mapped back to the text as it stands.

Names need evidence: a given name (of a reference list, or learned from the corpus where titles,
introductions and signatures show it), or a pair of capitalised words behind a title, a word for a person, a turn
of speech that takes one, a greeting at a letter's end, or beside a mail address made of them.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "identity_number", "street_address", "phone", "name")

# --- the shadow ---------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("АВЕКМНОРСТУХІЈЅаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοι", "ABEKMHOPCTYXIJSaeopcyxijsdhqwABEZHIKMNOPTYXoi"))
SIGNS = dict.fromkeys("‐‑‒–—−﹣", "-") | dict.fromkeys("      \t", " ") | dict.fromkeys("’‘ʼ", "'") | {"․": ".", "。": ".", "﹫": "@"}
INVISIBLE = re.compile("[​‌⁠﻿­]")
MIXED = re.compile(r"[^\W\d_]*[A-Za-z@][^\W\d_]*")


def _ascii(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _plain(c: str) -> str:
    """One character for one: the sign it stands for."""
    if c in SIGNS:
        return SIGNS[c]
    k = unicodedata.normalize("NFKC", c)
    return k if len(k) == 1 and k.isascii() else c


class Shadow:
    """``text`` with, for each character, the begin and end of what it stands for in the source."""

    def __init__(self, source: str):
        self.source, self.text, self.begin, self.end = source, source, None, None
        if not source.isascii():
            chars = {c: _plain(c) for c in set(source) if ord(c) > 127}
            self.text = source.translate(str.maketrans(chars))
            if any(c in LOOKALIKES for c in chars):  # only in words that are Latin otherwise
                self.text = MIXED.sub(lambda m: "".join(LOOKALIKES.get(c, c) for c in m.group()), self.text)
            self.rewrite(INVISIBLE, lambda m: "")

    def rewrite(self, pattern: re.Pattern, to) -> None:
        """Replace the matches; what a replacement is longer or shorter is kept track of."""
        found = list(pattern.finditer(self.text))
        if not found:
            return
        if self.begin is None:
            self.begin, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, begin, end, at = [], [], [], 0
        for m in found:
            new = to(m)
            if new is None:
                continue
            text += [self.text[at : m.start()], new]
            begin += self.begin[at : m.start()] + [self.begin[m.start()]] * len(new)
            end += self.end[at : m.start()] + [self.end[m.end() - 1]] * len(new)
            at = m.end()
        self.text = "".join([*text, self.text[at:]])
        self.begin, self.end = begin + self.begin[at:], end + self.end[at:]

    def span(self, start: int, stop: int) -> tuple[int, int]:
        """The source's span of the shadow's, from its first letter or digit to its last."""
        while start < stop and not self.text[start].isalnum():
            start += 1
        while stop > start and not self.text[stop - 1].isalnum():
            stop -= 1
        if self.begin is None or start == stop:
            return start, stop
        return self.begin[start], self.end[stop - 1]


AT = r"(?:\(at\)|\[at\]|\{at\}|<at>|\(a\)|@)"
AT_WORD = r"(?:at|arobase|arroba|chiocciola|klammeraffe)"
DOT = r"(?:\(dot\)|\[dot\]|\{dot\}|\(\.\)|\[\.\])"
DOT_WORD = r"(?:dot|point|punkt|punto)"
LOCAL = r"[a-z0-9][a-z0-9._+%-]*"
LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
#: An address with its signs disguised: bracketed or spaced ones anywhere, bare words only where both are words.
DISGUISED = re.compile(
    rf"(?<![\w.+@-])(?P<local>{LOCAL})(?P<at> ?{AT} ?| {AT_WORD} (?={LABEL}(?: ?{DOT} ?| {DOT_WORD} ){LABEL}))(?P<domain>{LABEL}(?:(?: ?{DOT} ?| {DOT_WORD} |\.){LABEL})+)(?![\w@])", re.I
)
DOTS = re.compile(rf" ?{DOT} ?| {DOT_WORD} ", re.I)


def _join_address(m: re.Match) -> str | None:
    plain = f"{m['local']}@{DOTS.sub('.', m['domain'])}"
    return None if plain == m.group() else plain


NUMBER_WORDS = [
    "zero oh one two three four five six seven eight nine", "null eins zwei zwo drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zero uno due tre quattro cinque sei sette otto nove",
]
SPELT = {w: d for line, digits in zip(NUMBER_WORDS, ("00123456789", "01223456789", "0123456789", "0123456789", "0123456789")) for w, d in zip(line.split(), digits)}
SPELT_RUN = re.compile(rf"\b(?=[zotfsendcuqhvà-ÿ])(?:{'|'.join(SPELT)})(?:[ -](?:{'|'.join(SPELT)})){{5,}}\b", re.I)


def _digits(m: re.Match) -> str:
    return "".join(SPELT[w.lower()] for w in re.split("[ -]", m.group()))


# --- what is looked for -------------------------------------------------------------------------

EMAIL = re.compile(rf"(?<![\w.+@-]){LOCAL}@{LABEL}(?:\.{LABEL})+", re.I)

S = r"[ .\-/]?"
#: National plans, with or without country code and with the usual separators; then any number with a country code, and any
#: national one of an area code with its zero and two groups.
PHONE = re.compile(
    r"(?=[+(\d])(?<![\w#@./-])(?:" + "|".join([
        rf"(?:(?:\+|00)44{S}(?:\(0\){S})?|0)7\d{{3}}{S}\d{{3}}{S}\d{{3}}",
        rf"(?:(?:\+|00)44{S}(?:\(0\){S})?|0)20{S}\d{{4}}{S}\d{{4}}",
        rf"(?:(?:\+|00)44{S}(?:\(0\){S})?|0|\(0)1\d{{2,3}}\)?{S}\d{{3}}{S}\d{{3,4}}",
        rf"(?:(?:\+|00)?1{S})?\(?[2-9]\d\d\)?{S}\d{{3}}{S}\d{{4}}",
        rf"(?:(?:\+|00)33{S}(?:\(0\){S})?|0)[1-9](?:{S}\d\d){{4}}",
        rf"(?:(?:\+|00)49{S}(?:\(0\){S})?|0|\(0)[1-9]\d{{1,3}}\)?{S}\d{{4,6}}{S}\d{{2,4}}",
        rf"(?:(?:\+|00)34{S})?[679]\d\d(?P<es>{S})\d{{3}}(?P=es)\d{{3}}",
        rf"(?:(?:\+|00)39{S})?0[1-9]\d{{0,2}}{S}\d{{3}}{S}\d{{3,4}}",
        rf"(?:\+|00)[1-9]\d{{0,2}}{S}(?:\(0\){S})?\(?\d{{1,4}}\)?(?:{S}\d{{2,4}}){{2,4}}",
        rf"\(?0[1-9]\d{{1,3}}\)?[ .\-/]\d{{3,4}}[ .\-/]\d{{3,4}}",
    ]) + r")(?![\w/@]|[-.]\d)"
)
MORE_DIGITS = re.compile(r"[ .\-]\d{2,4}(?![\w/@]|[-.]\d)")
#: Digits of the longest number: with a country code, and without.
LONGEST = {True: 15, False: 11}


def phones(text: str) -> Iterator[tuple[int, int]]:
    """Spans of telephone numbers, each as long as its plan allows."""
    for m in PHONE.finditer(text):
        end = m.end()
        full = LONGEST[m.group().startswith(("+", "00"))]
        while (more := MORE_DIGITS.match(text, end)) and sum(map(str.isdigit, text[m.start() : more.end()])) <= full and sum(map(str.isdigit, text[m.start() : end])) < 10:
            end = more.end()
        yield m.start(), end


#: Plain strings without any of which a costly pattern needn't be tried.
ANNOUNCES = ("pass", "ausweis", "identity", "id card", "identité", "pasaporte")
ANNOUNCED = r"(?:passports?|pass(?:port)?-?(?:nr|no|number)|passeport|pasaporte|passaporto|identity card|id card|ausweis|personalausweis|carte d'identité)"
IDENTITY = [
    re.compile(r"(?<![\w./+-])\d{3}([- .])\d{2}\1\d{4}(?![\w-])"),
    re.compile(r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])", re.I),
    re.compile(r"(?<![\w./+-])[12]([ .]?)\d{2}\1\d{2}\1(?:\d{2}|2[AB])\1\d{3}\1\d{3}\1\d{2}(?![\w-])"),
    re.compile(r"(?<![\w./+-])\d{2}\.?\d{3}\.?\d{3}[- ]?[A-Z](?![\w-])", re.I),
    re.compile(r"(?<![\w./+-])[XYZ][- ]?\d{7}[- ]?[A-Z](?![\w-])", re.I),
    re.compile(r"(?<![\w-])[A-Z]{3} ?[A-Z]{3} ?\d{2}[A-Z]\d{2} ?[A-Z]\d{3}[A-Z](?![\w-])", re.I),
    re.compile(r"(?<![\w-])[A-Z]\d{2}[A-Z] ?\d{2}[A-Z]\d{2}(?![\w-])", re.I),
    re.compile(r"(?<![\w-])[A-Z]\d{7,8}(?![\w-])"),
    re.compile(r"(?<![\w-])[A-Z]\d \d{3} \d{4}(?![\w-])", re.I),
    re.compile(ANNOUNCED + r"(?: ?(?:no|nr|number|n°)\b)?[.:]{0,2} {0,2}(?P<v>(?=[a-z]*\d)[A-Z0-9]{6,12})(?![\w-])", re.I),
]

#: Words for streets by language: what follows a name with the number before it, the same where only a capital tells it from other
#: words, what is part of the name's last word with the number behind it, and what goes before the name with the number before or behind.
STREETS = {
    "en": "street st road rd lane ln avenue ave hill close terrace court ct drive dr crescent grove gardens mews boulevard blvd parkway highway alley esplanade promenade",
    "en_capital": "Place Square Row Walk Way Gate Plaza Boulevard Parade Quay Park Circle Green Wharf Passage Rise View",
    "de_nl": "straße strasse str. gasse weg platz allee ufer damm ring chaussee markt straat laan gracht plein kade dijk singel",
    "fr": "rue avenue av. boulevard bd place pl. chemin quai allée impasse cours route passage square",
    "it": "via viale v.le piazza p.za piazzale corso vicolo largo lungomare strada",
    "es_pt": "calle c/ avenida avda avda. av. plaza pza pza. paseo camino ronda carrer rua travessa praça",
}


def _any(kind: str) -> str:
    return "|".join(sorted(map(re.escape, STREETS[kind].split()), key=len, reverse=True))


GERMAN_STREET = tuple(STREETS["de_nl"].split())
WORD_EN = r"(?!(?:which|the|this|that|and|or|of|in|at|on|was|were|is|first|next|other|same|more|about|for|its?|minutes?|years?|points?)\b)[a-zà-ÿ][a-zà-ÿ']+"
ADDRESS = [
    re.compile(rf"(?<![\w./#-])\d{{1,4}}[a-z]?(?:-\d{{1,4}}[a-z]?)?,? (?:(?:upper|lower|old|new|north|south|east|west|great|little) )?{WORD_EN} (?:{_any('en')})\b", re.I),
    re.compile(rf"(?<![\w./#-])\d{{1,4}}[a-z]?(?:-\d{{1,4}}[a-z]?)?,? (?:(?:Upper|Lower|Old|New|North|South|East|West) )?[A-ZÀ-Ý][\w']+ (?:{_any('en_capital')})\b"),
    re.compile(rf"(?<!\w)(?:(?:am|an der|auf dem|im) )?[a-zà-ÿ][a-zà-ÿ-]*(?:{_any('de_nl')}),? \d{{1,4}}(?: ?[a-z]\b)?(?:-\d{{1,4}}[a-z]?)?(?!\w)", re.I),
    re.compile(rf"(?<![\w./#-])\d{{1,4}}(?: ?(?:bis|ter|quater|[a-d]\b))?,? (?:{_any('fr')})(?: (?:du|des|de la|de l'|de|d'))? ?[a-zà-ÿ][a-zà-ÿ'-]+", re.I),
    re.compile(rf"(?<!\w)(?:{_any('it')})(?: (?:dei|del|della|delle|degli|di|de'))? [a-zà-ÿ][a-zà-ÿ'-]+,? (?:n\. ?)?\d{{1,4}}(?:/?[a-z])?(?!\w)", re.I),
    re.compile(rf"(?<!\w)(?:{_any('es_pt')})(?: (?:del|de la|de los|de las|de|da|do))? ?[a-zà-ÿ][a-zà-ÿ'-]+,? (?:n\.º ?)?\d{{1,4}}(?: ?[a-z]\b)?(?!\w)", re.I),
]

TITLE = r"(?:mrs?|ms|miss|dr|prof|professor|sir|herr|frau|mme|mlle|monsieur|madame|don|doña|sr|sra|sig|sig\.ra|signora?|dott|dott\.ssa|m)\.? "
PARTICLE = r"(?:(?:de la|van der|van den|von der|de|von|van|della|del|di|da|du|le|la|bin|ter|zu) |al-|el-)"
#: Words that aren't surnames, wherever they follow a given name.
NO_SURNAME = frozenset("""and or the a an is was has had will would can for from to in on at of with by not but as et ou le la les un une
est a und oder der die das ist hat y o el los es ha e il lo gli i è che che per von please dear kind best regards table round thanks
signed contact copy write ask call text send nuestro el mi la merci personne nous notre""".split())
FUNCTION = re.compile(r"[a-zà-ÿ'-]+")


#: What a person's name follows, in plain letters: turns of speech that take a person, words for persons, and ends of letters.
BEFORE_NAME = """my name is|i am|i'm|this is|thanks to|thank you|thanks|written by|signed by|signed|typed in by|typed by|sent by|posted by|edited by|reported by|reviewed by|hosted by|told by|asked by|given by|found by
spoke with|spoke to|speak with|speak to|talked to|talked with|talk to|meet with|met with|met|meeting with|call|called|contact|contact:|ask|asked|tell|told|write to|wrote to|forward this to|forward it to|forwarded to|send this to|send it to|sent to|reply to
introduce|invite|invited|payee|payee:|details:|attn:|attention:|name:|from:|to:|cc:|by:|colleague|friend|boss|manager|neighbour|neighbor|brother|sister|husband|wife|son|daughter|mother|father|cousin|uncle|aunt|teacher|captain|author|editor|assistant|secretary|chair|chairman|treasurer
mein name ist|ich heiße|ich bin|danke an|post bitte an|geschrieben von|unterschrieben von|sprach mit|gesprochen mit|auszahlung:|kollege|kollegin|freund|freundin|nachbar|nachbarin
je m'appelle|je suis|merci à|écrire à|écrit par|signé|parlé avec|parlé à|paiement:|paiement :|collègue|ami|amie|voisin|voisine
me llamo|mi nombre es|soy|gracias a|escrito por|firmado|hablé con|enviar el premio a|pago:|colega|amigo|amiga|vecino|vecina
mi chiamo|il mio nome è|sono|grazie a|scritto da|firmato|parlato con|spedire a|pagamento:|collega|amico|amica|vicino|vicina"""
NOUNS = frozenset("kollege kollegin freund freundin nachbar nachbarin auszahlung".split())
LETTER_END = """regards|kind regards|best wishes|with best wishes|sincerely|yours sincerely|yours truly|yours faithfully|cheers|all the best|many thanks|grüße|grüßen|cordialement|bien à vous|amicalement|saludo|saludos|atentamente|saluti|signed"""
#: Words that are in no person's name: of groups, days, titles of works, places. Those of a reference list's other kinds go with them.
NOT_PERSON = frozenset("""the a an and or of for to in on at team table club league quiz desk jury committee host round office society university school press company group panel board service support
department question answer picture sheet item option monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
der die das le la les el los las il lo gli un une una dear hello hi please thanks i we you he she it they my our your who what which when where how why new old north south east west great saint port lake mount falls valley""".split())
PART = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ][\w']*(?:[A-Z][a-z]+)?"
TITLES = re.compile(TITLE, re.I)


SENTENCE_START = re.compile(r"(?:^|[.!?:;>\n-])[ ]*$")


def _phrases(text: str) -> dict[str, list[str]]:
    """Phrases by their last word."""
    out: dict[str, list[str]] = {}
    for phrase in text.replace("\n", "|").split("|"):
        out.setdefault(re.findall(r"[^\W_]+", phrase)[-1], []).append(phrase)
    return out


class Finder:
    """Finds personal information; ``given`` are given names that mark a person's name, ``others`` names of what is no person."""

    word = re.compile(r"[^\W\d_]+")

    def __init__(self, given: list[str], others: list[str] = ()):
        w, gap = r"[a-zà-ÿ][a-zà-ÿ']+", r"[ ]{1,3}"
        surname = rf"(?:{PARTICLE})?{w}(?:-{w})?"
        self.given = frozenset(g.lower() for g in given if g)
        self.others = frozenset(o.lower() for o in others if o)
        self.not_person = NOT_PERSON | frozenset(x for o in others for x in re.findall(r"[^\W\d_]+", (o or "").lower()))
        self.double = re.compile(rf"-(?P<w>{w})", re.I)
        self.initial_or_word = re.compile(rf"{gap}(?:(?P<i>[a-zà-ÿ])\.|(?P<w>{w}))", re.I)
        self.behind = re.compile(rf"{gap}(?P<s>{surname})(?![\w@])", re.I)
        self.turned = re.compile(rf"(?<![\w@.-])(?P<s>{surname}),{gap}$", re.I)
        self.upper = re.compile(rf"(?<![\w@.-])(?P<s>(?:(?i:{PARTICLE}))?[A-ZÀ-Ý][A-ZÀ-Ý']{{2,}}(?:-[A-ZÀ-Ý']{{2,}})?){gap}$")
        lead = r"[,:.!]?[ ]{0,3}(?:\n[ ]{0,3})?(?:> ?)?"
        title = rf"(?:(?i:{TITLE})){{0,2}}"
        pair = rf"{PART}(?:-{PART})?(?:{gap}[A-ZÀ-Ý]\.)?{gap}(?:{PARTICLE})?{PART}(?:-{PART})?"
        initials = rf"(?:[a-zà-ÿ]\. ?){{1,2}} ?{surname}"
        self.after_speech = re.compile(rf"[ ]{{1,3}}{title}(?P<n>{pair}|(?i:{initials}))(?![\w@])")
        self.after_end = re.compile(rf"{lead}{title}(?P<n>{pair}|(?i:{initials}))(?=[ ]{{0,3}}(?:[\r\n<(,;.]|$|[ ][^\W\d_]))")
        self.initials = re.compile(rf"{lead}(?P<n>{initials})(?![\w@])", re.I)
        self.after_title = re.compile(rf"(?P<n>{pair}|(?i:{initials}))(?![\w@])")
        #: Initials at the begin of a line behind a dash, and before a bracket with an address or number.
        self.lines = [re.compile(rf"(?:^|\n)(?:> )?- {title}(?P<n>{initials})(?!\w)", re.I), re.compile(rf"(?:^|[\n.!?;] ?(?:> )?){title}(?P<n>{initials})(?= \([^)\n]*(?:@|\d))", re.I)]
        self.pair = re.compile(rf"(?<![\w@.-])(?=(?P<n>{pair})(?![\w@]))")
        self.speech, self.ends = _phrases(BEFORE_NAME), _phrases(LETTER_END)
        self.titles = frozenset(re.findall(r"[^\W\d_]+", "mr mrs ms miss dr prof professor sir herr frau mme mlle monsieur madame don doña sr sra sig signora signor dott"))

    def _name(self, surname: str, given: str) -> bool:
        last = FUNCTION.findall(surname.lower())
        if not last or last[-1] in NO_SURNAME or last[0] in NO_SURNAME and len(last) == 1:
            return False
        # a common word behind a given name
        return not (given[0].isupper() and surname.split("-")[-1].split(" ")[-1][0].islower() and not given.isupper())

    def _person(self, name: str) -> bool:
        """Whether a pair of capitalised words may be a person's name."""
        parts = self.word.findall(name.lower())
        if len(parts) < 2 or name.lower() in self.others or parts[-1] in NO_SURNAME or parts[0] in self.titles:
            return False
        return not any(p in self.not_person and p not in self.given for p in parts if len(p) > 1) or parts[0] in self.given

    def names(self, plain: str) -> Iterator[tuple[int, int]]:
        low = plain.lower()
        if len(low) != len(plain):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)
        long = [w for w in self.word.findall(plain) if len(w) > 3]
        headline = sum(w[0].isupper() for w in long) > 0.6 * len(long) > 6  # where all words have capitals they tell nothing
        for m in self.word.finditer(low):
            a, b = m.span()
            w = m.group()
            if w in self.given and not (a and (plain[a - 1].isalnum() or plain[a - 1] in "_@.-'")):
                yield from self._at(plain, a, b)
            for phrases, pattern in ((self.speech, self.after_speech), (self.ends, self.after_end)):
                for phrase in phrases.get(w, ()):
                    end = b + len(phrase) - len(phrase.rstrip(" :"))
                    if low.startswith(phrase, end - len(phrase)) and not (end > len(phrase) and low[end - len(phrase) - 1].isalnum()):
                        found = self.initials.match(plain, end) or pattern.match(plain, end)
                        # a phrase written with a capital inside a sentence is part of a headline, where capitals tell nothing
                        weak = headline or phrases is self.speech and plain[a].isupper() and not phrase.endswith(":") and w not in NOUNS and not SENTENCE_START.search(plain[max(0, end - len(phrase) - 4) : end - len(phrase)])
                        if found and (not weak or "." in found["n"]) and self._person(found["n"]):
                            yield found.span("n")
            if w in self.titles and (t := TITLES.match(plain, a)) and not (a and plain[a - 1].isalnum()):
                found = self.after_title.match(plain, t.end())
                if found and self._person(found["n"]):
                    yield found.span("n")
        for p in self.lines:
            for m in p.finditer(plain):
                yield m.span("n")

    def _at(self, plain: str, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Names that have a given name at ``a`` to ``b``: in front of the surname, or behind it and a comma or capitals."""
        if (d := self.double.match(plain, b)) and d["w"].lower() in self.given:
            b = d.end()
        given_end = [b]
        if more := self.initial_or_word.match(plain, b):
            if more["i"] or more["w"].lower() in self.given:
                given_end.insert(0, more.end())
        before = plain[max(0, a - 80) : a]
        end = next((e for e in given_end if e == b or not plain[e : e + 1].isalnum()), b)
        if (t := self.turned.search(before)) and self._name(t["s"], plain[a:b]) and plain[end : end + 1] != "@":
            yield a - len(before) + t.start(), end
        if (t := self.upper.search(before)) and self._name(t["s"], plain[a:b]) and plain[end : end + 1] not in ("@", "-"):
            yield a - len(before) + t.start(), end
        for e in given_end:
            if (s := self.behind.match(plain, e)) and self._name(s["s"], plain[a:e]):
                yield a, s.end()
                return

    def beside_address(self, plain: str, addresses: list[str]) -> Iterator[tuple[int, int]]:
        """Pairs of capitalised words that a mail address of the same text is made of."""
        local = [re.sub(r"[^a-z]", "", x.split("@")[0].lower()) for x in addresses]
        for m in self.pair.finditer(plain):
            parts = self.word.findall(_ascii(m["n"].lower()))
            if any(parts[-1] in x and len(parts[0]) > 1 and (parts[0] in x or x.startswith(parts[0][0] + parts[-1])) for x in local) and self._person(m["n"]):
                yield m.span("n")

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(begin, end, kind) of what is found, in order and without overlaps."""
        shadow = Shadow(text)
        shadow.text = shadow.text.replace("\t", " ")
        shadow.rewrite(DISGUISED, _join_address)
        shadow.rewrite(SPELT_RUN, _digits)
        plain = shadow.text
        found = [(m.span(), "email") for m in EMAIL.finditer(plain)]
        addresses = [plain[a:b] for (a, b), _ in found]
        low = re.sub(" {2,}", " ", plain.lower())
        has = lambda signs: any(x in low for x in signs)
        for p in IDENTITY[: None if has(ANNOUNCES) else -1]:
            found += [(m.span("v") if "v" in p.groupindex else m.span(), "identity_number") for m in p.finditer(plain)]
        for i, p in enumerate(ADDRESS):
            if i != 2 or has(GERMAN_STREET):
                found += [(m.span(), "street_address") for m in p.finditer(plain)]
        found += [(s, "phone") for s in phones(plain)]
        names = {*self.names(plain), *(self.beside_address(plain, addresses) if addresses else ())}
        found += [(s, "name") for s in sorted(names, key=lambda s: (s[0] - s[1], s))]  # the longest of those that overlap
        out: list[tuple[int, int, str]] = []
        taken: list[tuple[int, int]] = []
        for (a, b), kind in found:  # earlier kinds go first where two overlap
            at = bisect.bisect(taken, (a, b))
            if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
                continue
            taken.insert(at, (a, b))
            begin, end = shadow.span(a, b)
            if begin < end:
                out.append((begin, end, kind))
        return sorted(out)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder for each span, unchanged otherwise."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def learned_names(docs: DataFrame, text_col: str, others: list[str] = (), least: int = 3) -> list[str]:
    """Given names that the corpus itself shows: first words of names behind titles, introductions and letters' ends in ``least`` texts.

    Counted over all texts. They are words of a language's stock of names, some thousands at most, and come to the driver.
    """

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder([], others)
        for b in batches:
            found: list[str] = []
            for text in b["_text"]:
                parts = {finder.word.findall(text[x:y])[0].lower() for x, y in finder.names(text.replace("\t", " "))}
                found += [p for p in parts if len(p) > 2]
            yield pd.DataFrame({"given": found})

    texts = docs.select(F.col(text_col).cast("string").alias("_text")).where("_text <> ''").distinct()
    counted = texts.mapInPandas(learn, "given string").groupBy("given").count().where(F.col("count") >= least)
    return [r.given for r in counted.collect()]


def _spread(docs: DataFrame, *by) -> DataFrame:
    """Rows spread by a hash: compressed files of a few MB hold texts that take minutes, and moving a text costs far less than searching it."""
    parts = max(docs.sparkSession.sparkContext.defaultParallelism * 2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return docs.repartition(parts, F.xxhash64(*by))


def find_personal(docs: DataFrame, id_col: str, text_col: str, given: list[str], others: list[str] = ()) -> DataFrame:
    """(id, kind, value): each distinct item of each row's text, as it stands there.

    Null, empty and blank texts have none; rows with one id give their items each. Each row is looked at
    alone, whatever its length. ``given`` and ``others``: see ``Finder``.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(given, others)
        for b in batches:
            rows = []
            for i, text in enumerate(b["_text"]):
                if text:
                    rows += [(i, kind, value) for kind, value in dict.fromkeys((k, text[x:y]) for x, y, k in finder.spans(text))]
            if rows:
                where, kinds, values = zip(*rows)
                yield pd.DataFrame({id_col: b["_id"].iloc[list(where)].to_numpy(), "kind": kinds, "value": values})

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.col("_text") != "")
    return _spread(texts, "_id", "_text").mapInPandas(find, schema)


def redacted(docs: DataFrame, text_col: str, given: list[str], others: list[str] = (), out: str = "redacted") -> DataFrame:
    """``docs`` with a column ``out``: the text with typed placeholders. A null text stays null."""

    @F.pandas_udf(T.StringType())
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(given, others)
        for s in batches:
            yield s.map(lambda t: redact(t, finder.spans(t)) if t else t)

    spread = _spread(docs, F.monotonically_increasing_id(), text_col)  # rows alike go to different tasks, too
    return spread.withColumn(out, replace(F.col(text_col).cast("string")))
