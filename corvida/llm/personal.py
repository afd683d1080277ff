"""Personal information in free text: found from anchors, replaced by typed placeholders.

An Aho-Corasick automaton finds the anchors (at-signs in any writing, schemes,
identifier and account cues, street words, box cues, titles, given names, verbs of
persons, number words) in one pass; runs of digits and capitals with a stop are
anchors of numbers and initials. At each anchor a local parser expands to both
sides and validates the boundaries, and check digits where a number has them.
Spans that overlap are settled in the order of TYPES; what the parsers reject stays
as it is. Given names are fixed ones and those that columns of names teach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lines import FUNCTION_WORDS
from .names import TITLES, formal_names

#: A word of a column of names that leads so many different last words is a given name.
LEADS = 3
#: Up to so many learned names go to every task.
BROADCAST_NAMES = 100_000
TYPES = ("credentials", "email", "id_number", "account_number", "street_address", "phone", "person_name")
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}

# Words of identifiers, streets, boxes and numbers.
ID_CUES = (
    "ssn", "social security", "social", "soc. sec", "passport", "driver's licen", "drivers licen", "driver licen", "driver’s licen",
    "driving licen", "licence no", "license no", "alien registration", "alien number", "a-number", "national insurance", "nino",
)
STREET_WORDS = (
    "street", "st", "avenue", "ave", "road", "rd", "boulevard", "blvd", "lane", "ln", "drive", "dr", "court", "ct", "way", "terrace",
    "ter", "place", "pl", "square", "sq", "highway", "hwy", "parkway", "pkwy", "circle", "cir", "trail", "trl", "row", "close",
    "crescent", "quay", "wharf", "alley", "walk", "mews", "loop",
)
STREET_BEFORE = ("rue", "avenue", "boulevard", "place", "chemin", "quai", "impasse", "allée", "calle", "via", "viale", "piazza", "plaza", "avenida")
STREET_ENDINGS = ("gasse", "straße", "strasse", "str.", "weg", "platz", "allee", "ufer", "damm")
BOX_CUES = ("p.o", "po box", "p o box", "post office box", "post box", "postfach", "apartado", "b.p.", "boîte postale", "pob ")
NUMBER_WORDS = "zero oh one two three four five six seven eight nine".split()
ACCOUNT_CUES = ("account", "acct", "iban", "card", "routing", "sort code")
SCHEMES = ("https://", "http://", "ftp://", "sftp://", "ssh://", "imap://", "smtp://", "postgres://", "mysql://")
#: Verbs beside which two words with a capital are a person.
PERSON_VERBS = ("called", "met", "told", "asked", "said", "testified", "stated", "phoned", "emailed", "married", "hired")
#: A number after one of these words is no personal number.
OTHER_NUMBERS = (
    "invoice", "check", "cheque", "lot", "bates", "docket", "exhibit", "page", "room", "case", "no", "item", "flight", "tail", "order",
    "receipt", "paid", "shelf", "paragraph", "section", "volume", "aircraft", "tracking",
)

_L = r"[^\W\d_]"
_NAME_WORD = rf"{_L}+(?:[-'’]{_L}+)*"
_UNIT = r"(?:,?\s+(?:Apt\.?|Apartment|Unit|Suite|Ste\.?|Floor|Fl\.?|#)\s*#?\s*\w{1,6})?"

_EMAIL_LEFT = re.compile(r"[\w.+%'-]{1,64}$")
_EMAIL_DOMAIN = re.compile(
    r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:(?:\.|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+)[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+", re.I
)
_AT = re.compile(r"\s*(?:[\[({]\s*at\s*[\])}]|@|%40)\s*", re.I)
_USERINFO = re.compile(r"[^\s/@:]{1,64}:[^\s/@]{1,128}(?=@[\w.-])")
_DIGITS = re.compile(r"\d+")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")
_ACCOUNT = re.compile(r"[\s.:]*(?:number|num|no|nr|code|#)?[\s.:#]{0,3}(?:is|was)?\s{0,2}((?:\d[ -]?){5,17}\d)(?![\w-])", re.I)
_ID_VALUES = (
    (("ssn", "soc"), re.compile(r"\W{0,4}(?:security)?\W{0,3}(?:number|num|no\.?)?[\s:#.-]{0,4}(?:is|was)?\s{0,2}(\d{3}[\s.-]?\d{2}[\s.-]?\d{4})(?!\d)", re.I)),
    (("passport",), re.compile(r"\W{0,3}(?:number|num|no\.?|#)?[\s:#.-]{0,4}([A-Z]{0,2}\d{6,9}[A-Z]?)\b", re.I)),
    (("driv", "lic"), re.compile(r"(?:er['’]?s?\s+)?(?:licen[cs]e)?s?e?\s*(?:number|num|no\.?|#)?[\s:#.]{0,4}([A-Z]{0,2}[\s-]?\d[\d -]{5,18}\d)(?!\d)", re.I)),
    (("alien", "a-n"), re.compile(r"(?:\s+registration)?\s*(?:number|num|no\.?|#)?[\s:#.]{0,4}(A?[\s-]{0,2}\d{3}[\s-]?\d{3}[\s-]?\d{2,3})(?!\d)", re.I)),
    (("nat", "nino"), re.compile(r"(?:\s+insurance)?\s*(?:number|num|no\.?|#)?[\s:#.]{0,4}([A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D])\b", re.I)),
)
_SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")
_NINO = re.compile(r"(?<!\w)[A-Z]{2} \d{2} \d{2} \d{2} [A-D](?!\w)")
_A_NUMBER = re.compile(r"(?<![\w-])A-?\d{3}[ -]\d{3}[ -]\d{3}(?!\w)")
_LICENCE = re.compile(r"(?<![\w-])[A-Z]\d{3}-\d{3}-\d{2}-\d{3}-\d(?![\w-])")
_PHONE = re.compile(
    r"(?<![\w./#-])(?:"
    r"\+\d{1,3}[\s.-]?(?:\(\d{1,4}\)|\d{1,4})(?:[\s.-]?\d{2,4}){2,4}"
    r"|(?:1[\s.-])?\(\d{3}\)[\s.-]*\d{3}[\s.-]?\d{4}"
    r"|1[\s.-]\d{3}[\s.-]\d{3}[\s.-]\d{4}"
    r"|\d{3}([\s.-])\d{3}\1\d{4}"
    r"|0\d{2,4}[ ]\d{3,4}[ ]\d{3,4}"
    r"|\d{10}|\d{3}[-.]\d{4}"
    r")(?:\s*(?:ext|x|extension)\.?\s*\d{1,6})?(?![\w-])(?!\.\d)"
)
_SPOKEN = re.compile(rf"(?:(?:{'|'.join(NUMBER_WORDS)})[\s,-]+){{6,}}(?:{'|'.join(NUMBER_WORDS)})\b", re.I)
_STREET_AFTER = re.compile(
    rf"(?<![\w./#-])\d{{1,6}}[A-Z]?\s+(?:(?:[NSEW]{{1,2}}\.?|North|South|East|West|Old|New)\s+)?(?:(?:\d{{1,3}}(?:st|nd|rd|th)|{_NAME_WORD})\s+){{1,4}}?"
    rf"(?:{'|'.join(STREET_WORDS)})\b\.?{_UNIT}", re.I
)
_STREET_RUE = re.compile(
    rf"(?<![\w./-])\d{{1,5}}(?:\s?(?:bis|ter))?,?\s+(?:{'|'.join(STREET_BEFORE)})\s+(?:(?:de|du|des|del|della|la|le|les|l'|d')\s*){{0,3}}{_NAME_WORD}"
    rf"|(?:calle|via|viale|piazza|avenida)\s+(?:{_NAME_WORD}\s+){{1,3}},?\s*\d{{1,5}}\b", re.I
)
_STREET_GERMAN = re.compile(rf"\b{_L}{{2,}}(?:{'|'.join(map(re.escape, STREET_ENDINGS))})\s+\d{{1,4}}\s?[a-z]?\b", re.I)
_BOX = re.compile(
    r"\b(?:p\.?\s*o\.?\s*(?:box|b\.)|pob|post(?:al)?\s+office\s+box|post\s*box|postfach|apartado(?:\s+de\s+correos)?|b\.p\.|boîte\s+postale)"
    r"\W{0,3}(?:no\.?\s*)?\d[\d-]*", re.I
)
_WORD = re.compile(_NAME_WORD)
_LINE_MARK = re.compile(r"(?:^|\n)[ \t]*$")


def _surname(word: str) -> bool:
    """Shaped like a surname: a capital first, and more than two letters."""
    return len(word) > 2 and word[0].isupper() and (word[1:].islower() or word.isupper() or "-" in word or "'" in word or "’" in word or word[1:2].islower())


def valid_ssn(number: str) -> bool:
    """Whether a number can stand for a social security number.

    Areas 000 and 666 are never given out. Groups of zeros aren't either, but such a
    number is a mistyped one more often than none, and a mask had better cover it.
    """
    d = re.sub(r"\D", "", number)
    return len(d) == 9 and d[:3] not in ("000", "666")


def valid_card(number: str) -> bool:
    """Whether a card number's check digit is right (Luhn)."""
    d = [int(c) for c in number if c.isdigit()]
    total = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
    return 13 <= len(d) <= 19 and any(d) and total % 10 == 0


def valid_iban(number: str) -> bool:
    """Whether an account number's two check digits are right (modulo 97)."""
    c = number.replace(" ", "").upper()
    return 15 <= len(c) <= 34 and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


class Finder:
    """Spans of personal information in a text, for given names and anchors fixed at the start."""

    def __init__(self, learned: frozenset[str] = frozenset()):
        import ahocorasick

        given = {k.lower() for k in formal_names()} | {n.lower() for n in learned}
        titles = {t.lower() for t in TITLES}
        self.given, self.titles = given, titles
        anchors: dict[str, str] = {}
        for kind, words in (
            ("name", given), ("title", titles), ("street", STREET_WORDS), ("street", STREET_BEFORE), ("german", STREET_ENDINGS),
            ("box", BOX_CUES), ("id", ID_CUES), ("account", ACCOUNT_CUES), ("scheme", SCHEMES), ("verb", PERSON_VERBS), ("spoken", NUMBER_WORDS),
            ("email", ("@", "%40", "(at)", "[at]", "{at}", "( at )", "[ at ]")),
        ):
            for w in words:
                anchors[w] = f"{anchors[w]} {kind}" if w in anchors else kind
        self.automaton = ahocorasick.Automaton()
        for w, kind in anchors.items():
            self.automaton.add_word(w, (w, kind.split()))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Disjoint (start, end, type), in order of place."""
        low = text.lower()
        if len(low) != len(text):  # a few letters grow when lower-cased
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found: dict[str, list[tuple[int, int]]] = {t: [] for t in TYPES}
        hints: dict[str, list[tuple[int, int]]] = {}
        for last, (word, kinds) in self.automaton.iter(low):
            start = last + 1 - len(word)
            for kind in kinds:
                if kind in ("name", "title", "street", "spoken", "account", "verb") and not self._whole(low, start, last + 1):
                    continue
                hints.setdefault(kind, []).append((start, last + 1))
        for _, end in hints.get("scheme", ()):
            m = _USERINFO.match(text, end)
            if m:
                found["credentials"].append(m.span())
        secret = found["credentials"]
        for start, end in hints.get("email", ()):
            if not any(e == start for _, e in secret):
                found["email"] += self._email(text, start, end)
        for start, end in hints.get("id", ()):
            found["id_number"] += self._identifier(text, low, start, end)
        digits = [m.span() for m in _DIGITS.finditer(text)]
        if digits:
            self._numbers(text, low, digits, found)
            for _, end in hints.get("account", ()):
                m = _ACCOUNT.match(text, end)
                if m:
                    found["account_number"].append(m.span(1))
            for start, end in hints.get("street", ()):
                found["street_address"] += self._near(text, start, end, _STREET_AFTER, self._street) + self._near(text, start, end, _STREET_RUE, self._street)
            for start, end in hints.get("german", ()):
                found["street_address"] += self._near(text, start, end, _STREET_GERMAN)
            for start, end in hints.get("box", ()):
                found["street_address"] += self._near(text, start, end, _BOX)
        if len(hints.get("spoken", ())) >= 7:
            found["phone"] += [m.span() for m in _SPOKEN.finditer(text)]
        taken: list[tuple[int, int, str]] = []
        for kind in TYPES[:-1]:
            taken += self._free(found[kind], taken, kind)
        names: list[tuple[int, int]] = []
        for start, end in hints.get("name", ()):
            names += self._given(text, low, start, end)
        for start, end in hints.get("title", ()):
            names += self._titled(text, low, start, end)
        for start, end in hints.get("verb", ()):
            names += self._acting(text, start, end)
        names += self._initials(text)
        taken += self._free(sorted(names, key=lambda s: (s[0], -s[1])), taken, "person_name")
        return sorted(taken)

    def _numbers(self, text: str, low: str, digits: list[tuple[int, int]], found: dict[str, list[tuple[int, int]]]) -> None:
        """Numbers that tell their type by their shape, from each run of digits on."""
        done = 0
        for start, end in digits:
            if start < done:
                continue
            at = start
            while at and text[at - 1] in "+(" and start - at < 2:
                at -= 1
            for kind, rule, before, check in _SHAPES:
                place = max(0, start - before) if before else start
                m = rule.match(text, place) if before or kind != "phone" else rule.match(text, at) or rule.match(text, start)
                if m and (check is None or check(m.group())) and not self._other_number(low, m.start()):
                    found[kind].append(m.span())
                    done = max(end, m.end())
                    break

    @staticmethod
    def _near(text: str, start: int, end: int, rule: re.Pattern, check=None) -> list[tuple[int, int]]:
        """Matches of a rule that hold the anchor, looked for around it."""
        out = []
        for m in rule.finditer(text, max(0, start - 100), min(len(text), end + 80)):
            if m.start() <= start and m.end() >= end and (check is None or check(m.group())):
                out.append(m.span())
        return out

    @staticmethod
    def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int, str]], kind: str) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []
        for s, e in spans:
            if e > s and not any(s < b and a < e for a, b, _ in taken) and not any(s < b and a < e for a, b, _ in out):
                out.append((s, e, kind))
        return out

    @staticmethod
    def _whole(low: str, start: int, end: int) -> bool:
        return not (start and (low[start - 1].isalnum() or low[start - 1] == "_")) and not (end < len(low) and low[end].isalnum())

    @staticmethod
    def _email(text: str, start: int, end: int) -> list[tuple[int, int]]:
        at = _AT.match(text, start) or _AT.match(text, max(0, start - 1))
        if not at:
            return []
        left_end = start
        while left_end and text[left_end - 1] in " \t":
            left_end -= 1
        left = _EMAIL_LEFT.search(text, max(0, left_end - 64), left_end)
        domain = _EMAIL_DOMAIN.match(text, at.end())
        if not left or not domain or not any(c.isalnum() for c in left.group()):
            return []
        name = left.group().lstrip(".'-")
        tail = re.split(r"[^a-z]+", domain.group().lower())[-1]
        if not name or len(tail) < 2:
            return []
        begin = left_end - len(name)
        if text[max(0, begin - 7) : begin].lower() == "mailto:":
            begin -= 7
        return [(begin, domain.end())]

    @staticmethod
    def _identifier(text: str, low: str, start: int, end: int) -> list[tuple[int, int]]:
        for cues, value in _ID_VALUES:
            if low.startswith(cues, start):
                m = value.match(text, end)
                if m and cues[0] == "ssn" and not valid_ssn(m.group(1)):
                    return []
                return [m.span(1)] if m else []
        return []

    @staticmethod
    def _other_number(low: str, start: int) -> bool:
        before = re.search(r"([a-z$]+)\W{0,3}$", low[max(0, start - 24) : start])
        return bool(before and (before.group(1) in OTHER_NUMBERS or before.group(1) == "$")) or low[max(0, start - 1) : start] == "$"

    @staticmethod
    def _street(found: str) -> bool:
        words = found.split()[1:]
        return bool(words) and (words[0][0].isupper() or words[0][0].isdigit() or words[0].lower() in STREET_BEFORE) and not any(
            w[0].islower() and w.lower() not in ("rue", "de", "du", "des", "del", "la", "le", "les", "via", "calle") for w in words[:-1]
        )

    def _given(self, text: str, low: str, start: int, end: int) -> list[tuple[int, int]]:
        """Given name, optional middle initial, surname; or surname, given name."""
        if not text[start].isupper():
            after = re.compile(rf"\s+({_L}{{7,}})\b").match(text, end)
            rare = low[start:end] not in _COMMON_WORDS
            return [(start, after.end())] if after and rare and after.group(1).islower() and after.group(1) not in _COMMON_WORDS and _LOWER_NAME.match(text, start) else []
        after = re.compile(rf"\s+(?:{_L}\.\s*|{_L}\s+)?({_NAME_WORD})").match(text, end)
        if after:
            word = after.group(1)
            word = word[:-2] if word[-2:] in ("'s", "’s", "'S", "’S") else word
            if _surname(word) and word.lower() not in _NOT_SURNAMES:
                return [(start, after.start(1) + len(word))]
        before = re.compile(rf"({_NAME_WORD})(,?)\s+$").search(text, max(0, start - 40), start)
        if before and _surname(before.group(1)) and before.group(1).lower() not in _NOT_SURNAMES | self.titles:
            word = before.group(1)
            sentence_start = not text[: before.start()].strip() or text[: before.start()].rstrip()[-1:] in ".?!:\"“"
            if before.group(2) or (word.isupper() and not sentence_start) or (len(word) > 7 and not sentence_start):
                return [(before.start(1), end)]
        return []

    def _titled(self, text: str, low: str, start: int, end: int) -> list[tuple[int, int]]:
        if not text[start].isupper():
            return []
        m = re.compile(rf"\.?\s+(?:(?:{_L}\.\s*){{1,2}}|({_NAME_WORD})\s+)?({_NAME_WORD})").match(text, end)
        single = re.compile(rf"\.?\s+({_NAME_WORD})").match(text, end)
        best = None
        for found, group in ((single, 1), (m, 2)):
            if not found:
                continue
            word = found.group(group)
            word = word[:-2] if word[-2:] in ("'s", "’s", "'S", "’S") else word
            if group == 2 and found.group(1) and found.group(1).lower() not in self.given:
                continue
            if _surname(word) and word.lower() not in _NOT_SURNAMES:
                best = (start, found.start(group) + len(word))
        return [best] if best else []

    @staticmethod
    def _acting(text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Two words with a capital before a person's verb, or after one."""
        out = []
        for m in (_TWO_BEFORE.search(text, max(0, start - 80), start), _TWO_AFTER.match(text, end)):
            if m and not any(w.lower() in _NOT_SURNAMES or not _surname(w) for w in m.group(1).split()):
                out.append(m.span(1))
        return out

    @staticmethod
    def _initials(text: str) -> list[tuple[int, int]]:
        out = []
        for m in _INITIAL_FIRST.finditer(text):
            word = m.group(2)
            word = word[:-2] if word[-2:] in ("'s", "’s", "'S", "’S") else word
            if not _surname(word) or len(word) < 4 or word.lower() in _NOT_SURNAMES:
                continue
            before = text[max(0, m.start() - 40) : m.start()]
            if m.group(1)[0] in "QA" and word == m.group(2) and _LINE_MARK.search(before):
                continue  # a transcript's question or answer
            if _NO_INITIAL.search(before):
                continue
            out.append((m.start(), m.start(2) + len(word)))
        for m in _INITIAL_LAST.finditer(text):
            if _surname(m.group(1)) and m.group(1).lower() not in _NOT_SURNAMES:
                out.append(m.span())
        return out


# Shapes of numbers: type, rule, characters before the digits that belong to it, and check.
_SHAPES = (
    ("account_number", _IBAN, 2, valid_iban), ("account_number", _CARD, 0, valid_card), ("id_number", _SSN, 0, valid_ssn), ("id_number", _NINO, 3, None),
    ("id_number", _A_NUMBER, 2, None), ("id_number", _A_NUMBER, 1, None), ("id_number", _LICENCE, 1, None), ("phone", _PHONE, 0, None),
)
_TWO_BEFORE = re.compile(rf"(?<![\w.'’-])([A-ZÀ-Þ]{_L}{{2,}} [A-ZÀ-Þ]{_L}{{2,}})\s+$")
_TWO_AFTER = re.compile(rf"\s+([A-ZÀ-Þ]{_L}{{2,}} [A-ZÀ-Þ]{_L}{{2,}})(?!\s+[A-ZÀ-Þ])")
_INITIAL_FIRST = re.compile(rf"(?<![\w.'’-])([A-ZÀ-Þ]\.(?:\s*[A-ZÀ-Þ]\.)?)\s+({_NAME_WORD})")
_INITIAL_LAST = re.compile(rf"(?<![\w.-])({_L}{{5,}}),\s+[A-ZÀ-Þ]\.(?!\w)(?!\s?[A-ZÀ-Þ]\.)")
#: Before a capital that is no initial: house and unit numbers, further initials, labelled things.
_NO_INITIAL = re.compile(r"(?:\d|(?<![^\W\d_])[A-Z]\.|\b(?i:exhibit|unit|apt|suite|room|box|section|part|plan|volume|class))[ ,#]*$")
_LOWER_NAME = re.compile(rf"{_L}+\s+{_L}+")
# Words with a capital that are no surnames after a name or initial.
_NOT_SURNAMES = frozenset(
    "the and or of in on at to for from with by is was had has said that this it he she they we you room exhibit page county street "
    "avenue road lane drive court island lake harbor bay cape llc inc llp ltd trust bank club press holdings company group foundation "
    "university institute academy fund partners charter service properties gallery models sheriff aviation did does who what when "
    "where why how yes no not i a an mr mrs ms dr prof question answer witness deponent january february march april may june july "
    "august september october november december monday tuesday wednesday thursday friday saturday sunday box unit suite apt north "
    "south east west flight invoice docket bates lot check sent subject dear re".split()
)
_COMMON_WORDS = frozenset(
    "will mark grace bill frank jack art rob bob rich ray pat sue dot kit drew don rose may june al jon em ed jim nick meg tim tom sam "
    "pip hal ham ben dan ned ted nat cat liv nan barb chuck sandy ginny penny teddy dolly victor harry quinn pet".split()
)


@lru_cache(maxsize=4)
def finder(learned: frozenset[str] = frozenset()) -> Finder:
    return Finder(learned)


def redact(text: str | None, spans: list[tuple[int, int, str]] | None = None, learned: frozenset[str] = frozenset()) -> str | None:
    """The text with each span replaced by its placeholder; the rest unchanged."""
    if not text:
        return text
    out, at = [], 0
    for s, e, kind in finder(learned).spans(text) if spans is None else spans:
        out += [text[at:s], PLACEHOLDERS[kind]]
        at = e
    return "".join([*out, text[at:]])


def learned_names(rows: DataFrame, name_cols: list[str]) -> DataFrame:
    """(token): words that lead LEADS or more different last words in columns of names, and aren't function words."""
    names = rows.select(F.explode(F.array(*name_cols)).alias("name")).filter("name IS NOT NULL").dropDuplicates()
    words = F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}'’-]{2,}"), F.lit(0))
    told = names.select(F.filter(words, lambda w: ~w.isin([t.lower() for t in TITLES])).alias("w")).filter("size(w) BETWEEN 2 AND 4")
    pairs = told.select(F.col("w")[0].alias("token"), F.element_at("w", -1).alias("last"))
    leads = pairs.groupBy("token").agg(F.countDistinct("last").alias("n")).filter(F.col("n") >= LEADS)
    return leads.select("token").filter(~F.col("token").isin(sorted(FUNCTION_WORDS)))


def _with_known(rows: DataFrame, fields: list[str], learned: DataFrame | None) -> tuple[DataFrame, frozenset[str]]:
    """The rows with an array of the learned names in their fields (`_known`), or these names for all rows.

    Up to BROADCAST_NAMES names go to the tasks; more are looked up by the words of each row, in a join.
    """
    if learned is None:
        return rows.withColumn("_known", F.lit(None).cast("array<string>")), frozenset()
    learned = cut_lineage(learned)
    if learned.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        return rows.withColumn("_known", F.lit(None).cast("array<string>")), frozenset(r.token for r in learned.collect())
    key = F.xxhash64(*fields)
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *fields)), F.lit(r"[\p{L}'’-]{2,}"), F.lit(0))
    held = rows.select(key.alias("_key"), F.explode(F.array_distinct(words)).alias("token")).join(learned, "token", "left_semi")
    known = held.groupBy("_key").agg(F.collect_set("token").alias("_known"))
    return rows.withColumn("_key", key).join(known, "_key", "left").drop("_key"), frozenset()


def _finders(batch: pa.RecordBatch, learned: frozenset[str]) -> list[Finder]:
    known = batch.column("_known").to_pylist()
    return [finder(learned) if k is None else finder(frozenset(k)) for k in known]


def _found(batches: Iterator[pa.RecordBatch], fields: list[str], types: tuple[str, ...], learned: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, finders = batch.column("id").to_pylist(), _finders(batch, learned)
        rows = set()
        for field in fields:
            for key, text, own in zip(ids, batch.column(field).to_pylist(), finders, strict=True):
                if text:
                    rows |= {(key, field, kind) for _, _, kind in own.spans(text) if kind in types}
        columns = list(zip(*sorted(rows), strict=True)) or [(), (), ()]
        schema = (pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], ["id", "field_name", "pii_type"])


def personal_information(
    rows: DataFrame, id_col: str, fields: list[str], name_cols: list[str] | None = None, types: tuple[str, ...] = TYPES
) -> DataFrame:
    """(id, field_name, pii_type): the types that occur in a field of a row, each once.

    Given names are also learned from name_cols, if there are any. Null and empty
    fields hold nothing. Repeated rows of one id give one result; rows without an id
    can't be reported and are left out.
    """
    chosen = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *fields)
    known, learned = _with_known(chosen, fields, learned_names(rows, name_cols) if name_cols else None)
    return (
        known.mapInArrow(partial(_found, fields=fields, types=types, learned=learned), "id long, field_name string, pii_type string")
        .dropDuplicates()
        .withColumnRenamed("id", id_col)
    )


def redacted(rows: DataFrame, fields: list[str], name_cols: list[str] | None = None) -> DataFrame:
    """The rows, all columns kept, with placeholders in the given fields; null stays null."""
    known, learned = _with_known(rows, fields, learned_names(rows, name_cols) if name_cols else None)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            finders = _finders(batch, learned)
            for field in fields:
                i = batch.schema.get_field_index(field)
                texts = [redact(t, own.spans(t) if t else []) for t, own in zip(batch.column(i).to_pylist(), finders, strict=True)]
                batch = batch.set_column(i, field, pa.array(texts, pa.string()))
            yield batch.drop_columns(["_known"])

    return known.mapInArrow(replace, rows.schema)
