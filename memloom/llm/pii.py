"""Personal information in free text: found, typed, and replaced by placeholders.

Regular expressions propose spans, validators (checksums, ranges that are never
issued) confirm them, and words nearby raise or lower the score; what reaches
the threshold is a mention.  Mentions don't overlap.  Positions count code points.

All work is per text (Arrow batches, no shuffle).  The name lexicon is a table of
known people; it is handed to the tasks only up to ``LEXICON_MOST`` names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("person", "email", "phone", "id_number", "address")
PLACEHOLDERS = {"person": "[PERSON]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "card": "[CARD]", "iban": "[IBAN]"}
THRESHOLD = 0.6
LEXICON_MOST = 200_000

# Words that, shortly before or after a span, speak for a kind.
_PHONE_WORDS = r"phone|tel|call|mobile|number changed|ring|тел|звон|контакт|телефон|rückruf|anruf|telefon|mobil|unter|fax"
_ID_WORDS = r"national id|passport|ssn|tax number|tax id|insurance|identity|паспорт|снилс|инн|полис|steuer-id|ausweis|sozialversicherung|personalausweis|reisepass"
# Words before a number that is no one's.
_NUMBER_DECOYS = r"(?:build|rev|revision|offsets?|run id|epoch|version|port|ticket|hash|commit|step|rows|line|строка|zeile|lane|release|выпуска|ausgabe|версии)\W{0,3}$"
_STREET_TYPES = (
    r"(?:Street|Road|Avenue|Lane|Court|Close|Terrace|Drive|Place|Square|Boulevard|Way|Crescent|Grove|Row|Hill|Gardens|Park|Mews|Parade)\b"
    r"|(?:St|Rd|Ave|Ln|Ct|Dr|Pl|Sq|Blvd)\b\.?"
)

_C = r"[A-Za-zÄÖÜäöüßÀ-ÖØ-öø-ÿА-Яа-яЁё]"
_UP = r"[A-ZÄÖÜÀ-ÖØ-ÞА-ЯЁ]"
_NAME = rf"{_C}[{_C[1:-1]}'’-]+"
_INITIAL = rf"{_C}\."
# Small words between given and family names.
_PARTICLE = r"(?:(?:van|von)(?:[ ](?:der|den|dem))?|de(?:[ ](?:la|los|las))?|del|della|di|da|dos|du|bin|ibn|ter|ten)"
_PARTICLES = frozenset("van von der den dem de la los las del della di da dos du bin ibn ter ten".split())
_NAME_SHAPES = (
    rf"(?P<g5>{_NAME})(?:[ ](?-i:{_UP}\.|{_UP}[{_C[1:-1]}'’-]+)){{0,2}}?[ ]{_PARTICLE}[ ](?P<f5>(?-i:{_UP}[{_C[1:-1]}'’-]+))"
    rf"|(?P<f1>{_NAME}),[ ](?P<g1>{_NAME}(?:[ ]{_INITIAL})?)"
    rf"|(?P<g2>{_NAME})(?:[ ]{_INITIAL}){{0,2}}[ ](?P<f2>{_NAME})"
    rf"|(?P<g3>{_INITIAL}(?:[ ]?{_INITIAL})?)[ ]?(?P<f3>{_NAME})"
    rf"|(?P<f4>{_NAME})[ ](?P<g4>{_INITIAL}(?:[ ]?{_INITIAL})?)(?!\w)"
)
_TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Herrn?|Frau|Hr|Fr|Sir|г-н|г-жа|господин|госпожа|товарищ)\.?[ ])?"
# What stands right before a person's name, with how sure that makes it.
_PERSON_CUES = {
    "thanks, ": 0.45, "thanks ": 0.45, "thank you, ": 0.45, "thank you ": 0.45, "cheers, ": 0.45, "regards, ": 0.45, "спасибо, ": 0.45, "danke, ": 0.45,
    "ask ": 0.45, "loop in ": 0.45, "paired with ": 0.45, "account of ": 0.45, "form of ": 0.45, "signed off by ": 0.45, "on behalf of ": 0.45,
    "met with ": 0.45, "reported by ": 0.45, "written by ": 0.45, "assigned to ": 0.45, "owned by ": 0.45, "approved by ": 0.45, "talk to ": 0.45, "ping ": 0.45,
    "signed-off-by: ": 0.55, "reviewed-by: ": 0.55, "author: ": 0.55, "owner: ": 0.55, "assignee: ": 0.55, "reporter: ": 0.55, "from: ": 0.55, "contact: ": 0.55, "attn: ": 0.55,
    '"owner": "': 0.55, '"author": "': 0.55, '"user": "': 0.55, '"name": "': 0.55, '"contact": "': 0.55,
    "gez. ": 0.45, "bitte ": 0.45, "herr ": 0.45, "herrn ": 0.45, "frau ": 0.45, "unterzeichnet: ": 0.45, "im auftrag ": 0.45, "ansprechpartner: ": 0.45, "verantwortlich: ": 0.45,
    "ответственный: ": 0.5, "ответственная: ": 0.5, "автор правки — ": 0.5, "автор: ": 0.5, "дежурит ": 0.5, "дежурный: ": 0.5, "дежурная: ": 0.5, "подпись: ": 0.5,
    "исполнитель: ": 0.5, "спросить ": 0.5, "контактное лицо: ": 0.5, "с уважением, ": 0.5,
    "dr. ": 0.5, "prof. ": 0.5, "mr. ": 0.5, "mrs. ": 0.5, "ms. ": 0.5, "— ": 0.25, "– ": 0.25, "von ": 0.2,
}
# What stands right before a phone number, an identity number, or in a street's name.
_PHONE_CUES = ("phone ", "phone: ", "tel. ", "tel: ", "tel ", "call me under ", "call ", "mobile ", "number changed to ", "тел. ", "телефон ", "звонить ", "контакт ", "rückruf unter ", "anruf unter ", "fax ")
_ID_CUES = (
    "national id: ", "national id ", "passport no. ", "passport ", "ssn ", "ssn: ", "tax number ", "tax id ", "паспорт ", "снилс ", "инн ", "steuer-id ", "ausweisnummer ",
    "personalausweis ", "reisepass ",
)
_RUSSIAN_CUES = ("ул.", "улица", "пер.", "переулок", "проспект", "пр-т", "просп.", "пр.", "шоссе", "ш.", "бульвар", "бул.", "б-р", "наб.", "набережная", "площадь", "пл.", "проезд", "тупик", "аллея")
_GERMAN_CUES = ("straße", "strasse", "str.", "weg", "gasse", "allee", "ring", "platz", "ufer", "damm", "steig", "pfad", "chaussee", "markt", "graben", "zeile", "hof")
# What follows a person's name.
_PERSON_AFTER = (
    r"[ ]?(?:,[ ](?:phone|tel|mobile|тел|моб|handy|[+(]?\d)|[<(][^<>()\s]+(?:@|\(at\)|[ ]?\[at\]|[ ]@)"
    r"|(?:fragen|anrufen|wohnt|lebt|arbeitet|sagte?|schrieb|about|still|lives|lived|works|worked|said|says|asked|asks|told|wrote|writes|replied|called|joined|signed)\b"
    r"|(?:живёт|живет|работает|сказала?|написала?|спросила?|ответила?|просит|подписала?)\b|on[ ]\S*[/:._]|on\b|\"?, \"(?:mail|email|phone)\")"
)
# Who a person is to others, right before the name.
_ROLES = (
    r"(?:manager|boss|colleague|teammate|patient|client|customer|doctor|nurse|teacher|student|lawyer|friend|neighbou?r|wife|husband|brother|sister|mother|father|son|daughter|engineer|developer|"
    r"maintainer|reviewer|editor|author|owner|founder|director|ceo|cto|secretary|assistant|candidate|applicant|tenant|user|named|called|kolleg(?:e|en|in)|chef|chefin|patient(?:in)?|kund(?:e|en|in)|"
    r"nachbar(?:in)?|freund(?:in)?|arzt|ärztin|lehrer(?:in)?|коллега|коллеге|начальник|директор|врач|пациент(?:ка)?|клиент(?:ка)?|друг|подруга|сосед(?:ка)?|инженер)[ ,:]{1,2}$"
)
# Words before a name that often, but not only, lead to a person.
_LEADS = r"(?:^|[^\w])(?:to|with|by|from|for|and|tell|told|email|call|contact|meet|met|hi|hello|dear|mit|von|an|für|und|bei|hallo|liebe[r]?|с|от|для|и|к|у)[ ,]{1,2}$"
# Words before a name that make it one of a thing.
_THINGS = r"(?:release|version|build|project|product|milestone|codename|service|module|package|library|tool|branch|feature|релиз|версия|выпуск|проект|сервис|ausgabe|projekt|dienst|modul)[ :]{1,2}[\"'«„]?$"
# Common given names.
_GIVEN_NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark paul steven andrew kenneth george edward brian kevin peter henry jack oliver harry "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra emily emma alice grace olivia sophie charlotte lucy helen laura julia anna maria eva clara nina "
    "hans klaus jürgen wolfgang stefan andreas markus lukas jonas felix max moritz karl heinz petra sabine monika ursula renate heike katrin birgit ingrid greta lena hannah "
    "josé juan carlos luis miguel pedro carmen isabel lucía pierre jean louis claude marie camille giovanni marco luca giulia francesca ahmed mohammed fatima wei li yuki kenji ravi priya arjun "
    "иван пётр алексей сергей дмитрий андрей михаил николай владимир александр павел игорь олег юрий борис виктор анна мария елена ольга наталья татьяна ирина светлана екатерина юлия людмила галина дарья вера".split()
)
# Words that are no part of a name where a name could stand.
_NOT_NAMES = frozenset(
    "the a an of in on at to for with and or but not by as is was it its this that these those he she we you they i my our your his her "
    "das der die den dem des ein eine im am alle laut ohne nach neben seit vor bei innerhalb und oder nicht на по при без до после около вместо через раз ради "
    "если чтобы внутри во со про и или не указан steht read still about fragen wohnt see per once under from while when whenever between against following "
    "during before next outside within since only default project ticket please invoice ship signed reporter thanks ask call passport national phone "
    "street road avenue north south east west new saint monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split()
)


def luhn_ok(digits: str) -> bool:
    """Luhn's check digit over a string of digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97_ok(iban: str) -> bool:
    """The check of an IBAN (ISO 7064 mod 97-10)."""
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def inn_ok(d: str) -> bool:
    """The check digits of a Russian tax number of 12 digits."""
    w = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
    n = [int(c) for c in d]
    return sum(a * b for a, b in zip(w[1:], n)) % 11 % 10 == n[10] and sum(a * b for a, b in zip(w, n)) % 11 % 10 == n[11]


def snils_ok(d: str) -> bool:
    """The check number of a Russian insurance number of 11 digits."""
    return sum((9 - i) * int(c) for i, c in enumerate(d[:9])) % 101 % 100 == int(d[9:])


def steuer_id_ok(d: str) -> bool:
    """The check digit of a German tax number of 11 digits (ISO 7064 mod 11, 10)."""
    p = 10
    for c in d[:10]:
        s = (int(c) + p) % 10 or 10
        p = 2 * s % 11
    return d[0] != "0" and (11 - p) % 10 == int(d[10])


def never_issued(compact: str) -> bool:
    """True in ranges of identity numbers that are never issued, which stand in for real ones."""
    if re.fullmatch(r"\d{9}", compact):
        return compact[:3] in ("000", "666") or compact[0] == "9"
    if re.fullmatch(r"\d{10,12}", compact):
        return compact[:2] == "00"
    return bool(re.fullmatch(r"QQ\d{6}[A-D]?|P00\d{6}|L00X\d{5}", compact))


_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._+%-]*[A-Za-z0-9_+-])?"
_EMAIL = re.compile(
    rf"(?<![\w.+@%-])({_LOCAL})(?:(@)|([ ]@[ ])|([ ]?[\[(](?:at|AT|собака)[\])][ ]?))"
    r"([A-Za-z0-9][A-Za-z0-9-]*(?:(?:\.|[ ]?[\[(](?:dot|DOT|точка)[\])][ ]?)[A-Za-z0-9][A-Za-z0-9-]*)+)"
)
_PHONE = re.compile(
    r"(?<![\w+@/:#=.-])(?<!\d[ -])(?:"
    r"\+\d{8,14}(?![\d-])"
    r"|\+\d{1,3}[ .-]?\(\d{2,5}\)[ .-]?\d{2,8}(?:[ -]\d{2,4}){0,3}"
    r"|\+\d{1,3}(?:[ .-]\d{2,8}){2,5}"
    r"|00\d{2}[ ]\(0\)\d{2,4}[ ]?\d{4,9}"
    r"|8[ ]?\(\d{3,5}\)[ ]?\d{2,3}-\d{2}-?\d{2}"
    r"|8[ -]\d{3}[ -]\d{3}[ -]\d{2}[ -]\d{2}"
    r"|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}"
    r"|\d{3}([.-])\d{3}\1\d{4}"
    r"|\(0[1-9]\d{1,4}\)[ ]\d{3,8}(?:[ ]?[/-][ ]?\d{1,4})?"
    r"|0[1-9]\d{3}[ ]\d{3}[ ]?\d{3}"
    r"|0[1-9]\d{1,3}[ ]\d{5,8}(?:[ /-]{1,3}\d{1,4})?"
    r")(?![\w@])(?![.-]\d)"
)
_PHONE_LOOSE = re.compile(r"[+(]?\d[\d ()/.-]{6,18}\d(?![\w])")
_ID = re.compile(
    r"(?<![\w+@/:#=.-])(?<!\d[ -])(?:"
    r"\d{3}([- ])\d{2}\1\d{4}"
    r"|QQ[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]"
    r"|P00\d{6}|L00X\d{5}"
    r"|\d{3}-\d{3}-\d{3}[ -]\d{2}"
    r"|00[ ]\d{3}[ ]\d{3}[ ]\d{3}"
    r"|\d{4}[ ]\d{6}|\d{2}[ ]\d{2}[ ]\d{6}"
    r"|\d{10,12}"
    r")(?![\w@])(?![.-]\d)"
)
_ID_LABELLED = re.compile(r"[A-Z0-9](?:[A-Z0-9]|[ -](?=[A-Z0-9]*\d)){5,17}(?!\w)")
_CARD = re.compile(r"(?<![\w.-])(?:\d[ -]?){12,18}\d(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)")
_ADDRESS_EN = re.compile(
    r"(?<![\w/.-])(?:(?:Flat|Unit|Apt|Apartment|Suite|Room)\.?[ ]#?\d+[A-Za-z]?(?:,[ ]|[ ]|/))?\d{1,5}[A-Za-z]?(?:[-/]\d+[A-Za-z]?)?[ ]"
    rf"(?:{_UP}[a-zA-Z'’]+[ ]){{1,3}}(?:{_STREET_TYPES})(?:,[ ](?:Apt|Flat|Unit|Suite|Room)\.?[ ]#?\d+[A-Za-z]?)?(?:,[ ]{_UP}[a-z]+(?![\w]))?"
)
_GERMAN_STREETS = "|".join(map(re.escape, _GERMAN_CUES))
_ADDRESS_DE = re.compile(
    rf"(?<![\w/.-]){_UP}[a-zäöüß-]*(?:{_GERMAN_STREETS})[ ]\d{{1,4}}[ ]?[a-z]?(?![\w.:/])(?:,[ ]\d{{5}}[ ]{_UP}[a-zäöüß-]+)?"
    rf"|(?<![\w/.-]){_UP}[a-zäöüß-]+[ ](?:Straße|Strasse|Str\.|Weg|Gasse|Allee|Ring|Platz|Ufer|Damm)[ ]\d{{1,4}}[ ]?[a-z]?(?![\w.:/])(?:,[ ]\d{{5}}[ ]{_UP}[a-zäöüß-]+)?"
)
_ADDRESS_RU = re.compile(
    r"(?<![\w/.-])(?:кв\.[ ]\d+,[ ]|(?:г\.[ ])?)?(?:ул\.|улица|пер\.|переулок|проспект|пр-т|просп\.|пр\.|шоссе|ш\.|бульвар|бул\.|б-р|наб\.|набережная|площадь|пл\.|проезд|тупик|аллея)[ ]?"
    r"[А-ЯЁ][а-яё-]+(?:[ ][А-ЯЁ][а-яё-]+)?,[ ](?:д\.|дом)?[ ]?\d{1,4}(?:[а-яА-Я](?!\w))?(?:[ ]?/[ ]?\d{1,4})?"
    r"(?:,[ ](?:корп\.|к\.|стр\.)[ ]?\d+)?(?:,[ ](?:кв\.|квартира)[ ]?\d+)?", re.I
)
_TO_NAME = r"(?:(?:de[ ]la|de[ ]los|de[ ]las|della|delle|dos|das|des|del|de|du|da|do|d['’]|l['’])[ ]?)?"
_ADDRESS_ROMANCE = re.compile(
    rf"(?<![\w/.-])\d{{1,4}}(?:[ ]?(?:bis|ter))?,?[ ](?:rue|avenue|boulevard|quai|allée|impasse|chemin)[ ]{_TO_NAME}{_UP}[\w'’-]+(?:[ -]{_UP}[\w'’-]+){{0,3}}"
    rf"|(?<![\w/.-])(?:Calle|Avenida|Paseo|Plaza|Carrera|Viale|Piazza|Corso|Rua|Travessa|Praça)[ ]{_TO_NAME}{_UP}[\w'’-]+(?:[ ]{_TO_NAME}{_UP}[\w'’-]+){{0,3}},?[ ](?:n\.?º?[ ]?)?\d{{1,4}}(?![\w.:/])"
)
_RU_BEFORE = re.compile(r"(?:кв\.[ ]\d+,[ ]|г\.[ ])$", re.I)
_UPNAME = rf"{_UP}[{_C[1:-1]}'’-]+"
_CAPITALS = re.compile(
    rf"(?<![\w.@/'’-])(?P<given>{_UPNAME})(?:(?:[ ](?:{_UP}\.|{_UPNAME})){{0,3}}?[ ]{_PARTICLE}|(?:[ ]{_UP}\.){{0,2}})[ ](?P<family>{_UPNAME})(?![\w@])"
)
_ROLE, _LEAD, _THING = (re.compile(x) for x in (_ROLES, _LEADS, _THINGS))
_TITLED = re.compile(r"(?:^|[^\w])(?<!\d[ ])(?:dr|prof|mr|mrs|ms|herrn?|frau|hr|fr|sir|г-н|г-жа|господин|госпожа)\.?[ ]$")
_NAMED = re.compile(rf"{_TITLE}(?:{_NAME_SHAPES})(?![\w@])", re.I)
_AFTER = re.compile(_PERSON_AFTER, re.I)
_SHAPE = re.compile(rf"(?:{_NAME_SHAPES})(?![\w@])")


class Lexicon:
    """Given and family names of known people, lower-cased, with an automaton that finds them and all cues in one pass."""

    def __init__(self, given: Iterable[str] = (), family: Iterable[str] = ()):
        self.given = frozenset(x.lower() for x in given if x)
        self.family = frozenset(x.lower() for x in family if x)
        self._find = None

    def __getstate__(self):
        return {"given": self.given, "family": self.family, "_find": None}

    def cues(self, lower: str) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(start, end, kinds) of all cues and family names in a lower-cased text."""
        if self._find is None:
            import ahocorasick

            kinds: dict[str, set[str]] = {}
            for kind, words in (
                ("family", self.family), ("person", _PERSON_CUES), ("phone", _PHONE_CUES), ("id", _ID_CUES), ("ru", _RUSSIAN_CUES), ("de", _GERMAN_CUES),
                ("email", ("@", "(at)", "[at]", "(собака)", "[собака]")),
            ):
                for w in words:
                    kinds.setdefault(w, set()).add(kind)
            self._find = ahocorasick.Automaton()
            for w, k in kinds.items():
                self._find.add_word(w, (len(w), tuple(sorted(k))))
            self._find.make_automaton()
        for last, (n, k) in self._find.iter(lower):
            yield last - n + 1, last + 1, k


def _numbers(text: str, lower: str) -> Iterator[tuple[int, int, str, float]]:
    def context(a: int, b: int, words: str, ahead: int = 28) -> bool:
        return bool(re.search(words, lower[max(0, a - 30) : a])) or bool(ahead and re.search(words, lower[b : b + ahead]))

    def decoy(a: int) -> bool:
        return bool(re.search(_NUMBER_DECOYS, lower[max(0, a - 24) : a]))

    for m in _PHONE.finditer(text):
        a, b = m.span()
        plus = text[a] in "+(" or text[a : a + 2] == "00"
        labelled = bool(re.search(rf"(?:{_ID_WORDS})\W{{0,3}}$", lower[max(0, a - 24) : a]))
        score = 0.65 + 0.1 * plus + 0.25 * context(a, b, _PHONE_WORDS, 0) - 0.5 * decoy(a) - 0.2 * context(a, b, _ID_WORDS, 0) - 0.4 * labelled
        yield a, b, "phone", score
    for m in _ID.finditer(text):
        a, b = m.span()
        compact = re.sub(r"[ -]", "", m[0])
        checked = compact.isdigit() and ((len(compact) == 12 and inn_ok(compact)) or (len(compact) == 11 and (snils_ok if "-" in m[0] else steuer_id_ok)(compact)))
        known = never_issued(compact) or checked
        score = 0.3 + 0.35 * known + 0.4 * context(a, b, _ID_WORDS) - 0.5 * decoy(a) - 0.3 * context(a, b, _PHONE_WORDS, 0)
        yield a, b, "id_number", score
    for m in _CARD.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        if len(set(digits)) > 1 and luhn_ok(digits):
            yield *m.span(), "card", 0.35 + 0.4 * context(*m.span(), r"card|visa|карт|karte")
    for m in _IBAN.finditer(text):
        if mod97_ok(m[0].replace(" ", "")):
            yield *m.span(), "iban", 0.9


def _person(text: str, m: re.Match, trust: float, lexicon: Lexicon) -> tuple[int, int, str, float]:
    """The span of the name in a match of the name shapes, scored by case, lexicon and what follows."""
    parts = [x for x in ("g1", "g2", "g3", "g4", "g5", "f1", "f2", "f3", "f4", "f5") if m[x]]
    given, family = sorted(parts, key=lambda x: x[0] == "f")
    a, b = min(map(m.start, parts)), max(map(m.end, parts))
    given, family = m[given], m[family]
    if m["g5"] and (words := text[a:b].split(" "))[1].lower() not in _PARTICLES and not _NOT_NAMES.isdisjoint(x.lower() for x in words[2:] if x.lower() not in _PARTICLES):
        family, b = words[1], a + len(words[0]) + 1 + len(words[1])  # the name ends before other words
    g, f = given.split(" ")[0].lower(), family.lower()
    if f in _NOT_NAMES or g in _NOT_NAMES:
        return a, b, "person", 0.0
    score = trust + (0.15 if family[:1].isupper() else -0.05) + (0.1 if given[:1].isupper() else -0.05)
    score -= 0.3 * (given[:1].islower() and family[:1].isupper())  # a small word before a capital one
    score += 0.35 * (f in lexicon.family) + (0.3 if g in lexicon.given else 0.1 * (g.endswith(".") and f in lexicon.family))
    score += 0.25 * bool(_AFTER.match(text, b)) + 0.2 * bool(trust and re.search(_ID_WORDS, text[max(0, a - 45) : a].lower()))
    score -= 0.5 * any(x in "_/" or x.isdigit() for x in text[a:b]) + 0.4 * (b < len(text) and text[b] in "_/:\\" and text[b + 1 : b + 2].isalnum())
    return a, b, "person", score


def _capitals(text: str, lower: str, lexicon: Lexicon) -> Iterator[tuple[int, int, str, float]]:
    """Capitalised names, scored by what stands around them and by known given names; no cue need come before."""
    at = 0
    while m := _CAPITALS.search(text, at):
        a, b = m.span()
        at = m.end("given")
        given, family = m["given"].lower(), m["family"].lower()
        if given in _NOT_NAMES or family in _NOT_NAMES:
            continue
        known = given in _GIVEN_NAMES or given in lexicon.given
        while known and family in _GIVEN_NAMES and (more := _NEXT_NAME.match(text, b)):  # second given names
            b, family = more.end(), more[1].lower()
        before = lower[max(0, a - 32) : a]
        score = 0.25 + 0.4 * known + 0.35 * (family in lexicon.family) + 0.3 * bool(_ROLE.search(before)) + 0.15 * bool(_LEAD.search(before))
        score += 0.35 * bool(_TITLED.search(before)) + 0.3 * bool(_AFTER.match(text, b)) - 0.5 * bool(_THING.search(before))
        score -= 0.4 * (b < len(text) and text[b] in "_/:\\" and text[b + 1 : b + 2].isalnum()) + 0.5 * any(x in "_/" or x.isdigit() for x in text[a:b])
        yield a, b, "person", min(score, 0.99)


_NEXT_NAME = re.compile(rf"(?:[ ]{_UP}\.)?[ ]({_UPNAME})(?![\w@])")


def _run(text: str, at: int, more: str) -> int:
    """Where the run of letters, digits and characters in ``more`` begins that ends before ``at``."""
    while at > 0 and (text[at - 1].isalnum() or text[at - 1] in more):
        at -= 1
    return at


def _mailboxes(text: str, a: int, b: int) -> Iterator[tuple[int, int, str, float]]:
    """The mailbox around the sign at a..b, however long its parts are."""
    for end in {a, a - 1 if a and text[a - 1] == " " else a}:
        at = end
        while at > 0 and (text[at - 1] in "._+%-" or (text[at - 1].isascii() and text[at - 1].isalnum())):
            at -= 1
        if (m := _EMAIL.match(text, at)) and m.start(1) <= a < m.end():
            top = re.split(r"[^a-z0-9-]+", m[5].lower().rstrip("])"))[-1]
            service = m[1].lower() in ("git", "hg", "svn", "root", "www") or text[m.end() : m.end() + 1] in (":", "/")
            if top.isalpha() and len(top) > 1 and not service:
                yield m.start(), m.end(), "email", 0.95 if m[2] else 0.85


def _streets(text: str, a: int) -> Iterator[int]:
    """Where a German street could begin whose kind stands at a: with its own word, or with the word before."""
    at = _run(text, a, "-")
    yield at
    if at == a and a > 1 and text[a - 1] == " ":
        yield _run(text, a - 1, "-")


def _cued(text: str, lower: str, lexicon: Lexicon) -> Iterator[tuple[int, int, str, float]]:
    for a, b, kinds in lexicon.cues(lower):
        begins = not (a and (lower[a - 1].isalnum() or lower[a - 1] in "_-"))
        for kind in kinds:
            if kind == "email":
                yield from _mailboxes(text, a, b)
            elif kind == "person":
                unit = lower[b - 2 : b] == ". " and a > 1 and lower[a - 2].isdigit()  # milliseconds, no title
                if begins and not unit and (m := _NAMED.match(text, b)):
                    yield _person(text, m, _PERSON_CUES[lower[a:b]], lexicon)
            elif kind == "family":
                apart = begins and lower[a - 1 : a] not in ("@", "+", ".", "/", ":") and not (b < len(lower) and (lower[b].isalnum() or lower[b] in "_@+-/:"))
                for at in _starts(text, a) if apart else ():
                    m = _SHAPE.match(text, at)
                    if m and b <= m.end():
                        yield _person(text, m, 0.05, lexicon)
            elif kind == "phone":
                if begins and (m := _PHONE_LOOSE.match(text, b)) and 7 <= sum(map(str.isdigit, m[0])) <= 15:
                    yield *m.span(), "phone", 0.62
            elif kind == "id":
                if begins and (m := _ID_LABELLED.match(text, b)) and sum(map(str.isdigit, m[0])) >= 5:
                    yield *m.span(), "id_number", 0.66
            elif kind == "ru":
                if begins:
                    ahead = _RU_BEFORE.search(text, max(0, _run(text, max(0, a - 2), "") - 4), a)
                    for at in (ahead.start(), a) if ahead else (a,):
                        if m := _ADDRESS_RU.match(text, at):
                            yield *m.span(), "address", 0.8
                            break
            elif text[b : b + 1] == " " and text[b + 1 : b + 2].isdigit():
                for at in _streets(text, a):
                    if m := _ADDRESS_DE.match(text, at):
                        yield *m.span(), "address", 0.8


def _starts(text: str, a: int) -> Iterator[int]:
    """Where a name could begin that has its family name at a: there, or up to four words before."""
    yield a
    at = a
    for _ in range(4):
        if at < 2 or text[at - 1] != " ":
            return
        end = at - 1
        at = end
        while at > 0 and (text[at - 1].isalpha() or text[at - 1] in "'’-."):
            at -= 1
        if at == end:
            return
        yield at


def mentions(text: str | None, lexicon: Lexicon, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """Mentions (start, end, kind, score) of one text, by position; none overlap, the higher score wins, then the longer."""
    if not text:
        return []
    lower = text.lower()
    if len(lower) != len(text):  # a few capital letters have longer small forms
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    found = list(_cued(text, lower, lexicon))
    found += _numbers(text, lower)
    found += _capitals(text, lower, lexicon)
    found += ((*m.span(), "address", 0.8) for p in (_ADDRESS_EN, _ADDRESS_ROMANCE) for m in p.finditer(text))
    out: list[tuple[int, int, str, float]] = []
    for x in sorted({x for x in found if x[3] >= threshold}, key=lambda x: (-round(x[3], 6), x[0] - x[1], x[0], x[2])):
        i = bisect_left(out, x)  # by position; those taken don't overlap, so its neighbours tell
        if (i == 0 or out[i - 1][1] <= x[0]) and (i == len(out) or x[1] <= out[i][0]):
            out.insert(i, x)
    return out


def replaced(text: str | None, found: Sequence[tuple[int, int, str, float]]) -> str | None:
    """The text with each mention replaced by the placeholder of its kind, all else unchanged."""
    if not text or not found:
        return text
    parts, at = [], 0
    for a, b, kind, _ in found:
        parts += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*parts, text[at:]])


def lexicon_of(people: DataFrame, given: str = "given_name", family: str = "family_name") -> Lexicon:
    """The names of a table of people; refuses tables with more than ``LEXICON_MOST`` names."""
    names = people.select(F.explode(F.array(F.struct(F.lit("g").alias("k"), F.trim(given).alias("n")), F.struct(F.lit("f").alias("k"), F.trim(family).alias("n")))).alias("x"))
    rows = names.select("x.*").filter("n <> ''").distinct().limit(LEXICON_MOST + 1).collect()
    if len(rows) > LEXICON_MOST:
        raise ValueError(f"more than {LEXICON_MOST} names; use a smaller table of people")
    return Lexicon((r.n for r in rows if r.k == "g"), (r.n for r in rows if r.k == "f"))


def find_mentions(records: DataFrame, id_col: str, fields: Sequence[str], lexicon: Lexicon, *, threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, field_name, kind, start_at, end_at, score): one row per mention in the named text fields.

    Null and empty texts have none; any other columns are ignored, whatever they are called.
    """
    names = list(fields)

    def scan(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            for i, name in enumerate(names):
                for row_id, text in zip(ids, batch.column(i + 1).to_pylist()):
                    rows += [(row_id, name, kind, a, b, score) for a, b, kind, score in mentions(text, lexicon, threshold)]
            if rows:
                c = list(zip(*rows))
                arrays = [pa.array(c[0], pa.int64()), pa.array(c[1]), pa.array(c[2]), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["row_id", "field_name", "kind", "start_at", "end_at", "score"])

    chosen = records.select(F.col(f"`{id_col}`").cast("long").alias("id"), *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(names)])
    return chosen.mapInArrow(scan, "row_id long, field_name string, kind string, start_at long, end_at long, score double")


def redact(records: DataFrame, fields: Sequence[str], lexicon: Lexicon, *, threshold: float = THRESHOLD) -> DataFrame:
    """The records with the mentions in the named fields replaced by placeholders; all else as it was."""

    @F.pandas_udf("string")
    def hidden(texts):
        return texts.map(lambda t: replaced(t, mentions(t, lexicon, threshold)) if isinstance(t, str) else None)

    return records.withColumns({c: hidden(F.col(f"`{c}`")) for c in fields})
