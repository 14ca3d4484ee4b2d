"""Personal information in free text, found by a semi-Markov conditional random field.

A segmentation of a text is a sequence of entity segments between stretches that belong to none.
A segment is scored as a whole: by its form (grouping of digits, build of a name out of known
and unknown words, parts of an address), by what stands before and behind it, by whether it
could be longer, and by the kind of the entity right before it (transitions). A dynamic programme
over segments of bounded length picks boundaries and types of all entities of a text together.

Segments are read off the text's tokens: every run of digit groups and codes, every mail-like run,
every run of capitalised words, initials and listed words that a name might be (whether or not
any list has them), every end of a street that a number, a unit, a town or a postcode may give.
The bounds on a segment are stated below; what is longer is no candidate.

The weights are fitted by maximum likelihood on a bounded, documented number of sentences that
``pii_training`` generates (which says where these come from). They are fitted in a few seconds when first needed; no document is
read for it and no weight is stored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = ("email", "phone", "id_number", "address", "name")
#: Bounds of a segment: characters of any, groups and digits of a number, chunks of a code,
#: capitalised words of a town, words and initials of a name.
MOST_CHARS = 160
MOST_GROUPS = 8
MOST_DIGITS = 16
MOST_CHUNKS = 6
MOST_TOWN_WORDS = 4
MOST_NAME_WORDS = 5
#: Entities no farther apart than this many characters are neighbours with a transition.
NEAR = 4
NEXT = "next"
#: Different staff names that are sent to the executors.
MOST_STAFF = 200_000

S = "[     ]"
_WORD = re.compile(r"[^\W\d_]+(?:['’\-‑][^\W\d_]+)*")
_APOSTROPHE = re.compile("['’]")
_HOST = r"[\w\-]+"
_MAILS = tuple(
    re.compile(r"(?<![\w.+\-])\w[\w.+\-]*" + at + _HOST + rf"(?:{dot}{_HOST})+")
    for at, dot in (
        (rf"{S}?@{S}?", r"\."),
        (rf"{S}?[\(\[\{{]{S}?(?:at|AT|@){S}?[\)\]\}}]{S}?", rf"(?:\.|{S}?[\(\[\{{]{S}?(?:dot|DOT|\.){S}?[\)\]\}}]{S}?|{S}(?:dot|DOT){S})"),
        (rf"{S}(?:at|AT){S}", rf"{S}(?:dot|DOT){S}"),
    )
)
_DOT = re.compile(rf"\.|{S}?[\(\[\{{]{S}?(?:dot|DOT|\.){S}?[\)\]\}}]{S}?|{S}(?:dot|DOT){S}")
_AT = re.compile(rf"@{S}?|[\(\[\{{]{S}?(?:at|AT){S}?[\)\]\}}]|{S}(?:at|AT){S}")
_RUN = re.compile(rf"(?<![\w.,:/])(?:\+{S}?)?\(?\d+(?:(?:{S}|[.\-–/]|\)[.\-]|\){S}?|{S}?\()\d+)*(?!\w)")
_EXT = re.compile(rf"{S}?(?:,{S}?)?(?:ext\.?|extension|x|Durchwahl|Durchw\.|App\.|poste|int\.|extensión){S}?\d{{1,5}}(?!\w)", re.I)
_CHUNK = r"(?:[A-Z](?=[A-Z]*\d)[A-Z0-9]{6,10}(?![A-Za-z0-9])|\d+[A-Z]{1,2}\d*|[A-Z]{1,4}\d+[A-Z]?|\d+|[A-Z]{1,4}(?![a-z]))"
_CODE = re.compile(rf"(?=[A-Z0-9])(?<![\w\-/.+]){_CHUNK}(?:(?:{S}|[\-/.]){_CHUNK})*(?!\w)")
_CHUNKS = re.compile(_CHUNK)
_GROUP = re.compile(r"\d+")
_BLANK = re.compile(S)
_UPPER = re.compile(r"[A-Z]")

_CAP = r"(?:St\.|ST\.|Mt\.|[A-ZÀ-ÖØ-Þ][\w'’\-]*)"
# Words for kinds of streets.
_EN_TYPES = "Road Street Lane Avenue Drive Close Crescent Row Walk Hill Way Court Place Terrace Square Gardens Grove Mews Park Rise View Green Yard Boulevard Parkway Rd St Ave Blvd Ln Dr Ct Pl".split()
_FR_TYPES = "rue avenue impasse chemin quai boulevard place allée route cours passage square sentier villa".split()
_DE_ENDS = "straße strasse str. gasse weg allee platz ufer damm ring hof steig markt".split()
_ES_TYPES = "Calle Avenida Plaza Camino Paseo Carretera Ronda Travesía Callejón Avda. C/".split()
_any = lambda words: "(?:" + "|".join(re.escape(w) for w in sorted({x for w in words for x in (w, w.upper())}, key=lambda w: (-len(w), w))) + ")"
_STREETS = {
    "en": re.compile(rf"(?<![\w/.\-])\d{{1,5}}[A-Za-z]?\s(?:{_CAP}\s){{1,4}}{_any(_EN_TYPES)}(?!\w)"),
    "fr": re.compile(rf"(?<![\w/.\-])\d{{1,4}}(?:\s?(?:bis|ter|quater|BIS|TER))?,?\s{_any(_FR_TYPES)}(?:\s[\w'’\-]+){{1,6}}"),
    "de": re.compile(rf"(?<!\w)(?:[A-ZÄÖÜ][\w\-]*{_any(_DE_ENDS)}|{_CAP}\s(?:Straße|Str\.|Allee|Platz|Weg)|(?:Am|An|Im|Zum|Zur|Auf|Unter|AM|AN|IM|ZUM|ZUR)(?:\s(?:der|dem|den|DER|DEM|DEN))?(?:\s{_CAP}){{1,3}})\s\d{{1,4}}\s?[a-z]?(?!\w)(?![.\-]\d)"),
    "es": re.compile(rf"(?<!\w){_any(_ES_TYPES)}\s?[\w'’\-]+(?:\s[\w'’\-]+){{0,6}}?,?\s(?:n\.?º\s?)?\d{{1,4}}(?!\w)"),
    "xx": re.compile(rf"(?<!\w){_CAP}(?:\s{_CAP}){{1,3}}\s\d{{1,4}}[a-z]?(?=,\s(?:[A-Z]{{1,2}}-)?\d{{4,5}}\s[A-ZÀ-Þ])"),
}
_GATES = {"es": re.compile(_any(_ES_TYPES)), "xx": re.compile(r"\d[a-z]?,\s(?:[A-Z]{1,2}-)?\d{4,5}\s")}
_DIGIT = re.compile(r"\d")
_FLAT = re.compile(r"(?:Flat|Apt\.?|Unit|Apartment|Wohnung|Appt\.?|FLAT|APT|UNIT)\s\d+[a-zA-Z]?,\s$")
_UNIT = re.compile(r",\s(?:(?:Apt\.?|Flat|Unit|Suite|Appt\.?|APT|FLAT|UNIT|SUITE)\s\d+[a-zA-Z]?|\d{1,2}\.?[ºª°o](?:\s[A-Z])?(?!\w)|bajo|ático|BAJO|ÁTICO)")
_ZIP = re.compile(r"(?<!\w)(?:(?:[A-Z]{2}\s)?\d{5}(?:-\d{4})?|(?:[A-Z]{1,2}-)?\d{4,5}|[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2})(?!\w)")
_TOWN = re.compile(r"[A-ZÀ-ÖØ-Þ][\w'’\-]*")
_LINK = re.compile(r"(?:de|del|de la|la|le|les|sur|an der|am|im|of|upon|DE|DEL|LA|OF)(?!\w)")
_SEP = re.compile(r",?\s{1,2}(?:>\s)?")
_BLANKS = re.compile(r"\s")
_COMMA = re.compile(r",?\s")
_ZIP_END = re.compile(r"(?:^|,?\s)(?:(?:[A-Z]{2}\s)?\d{4,5}|[A-Z]{1,2}\d\w?\s\d\w{2})$")
_ZIP_HEAD = re.compile(r"^\W*(?:(?:[A-Z]{1,2}-)?\d{4,5})?\s*")
_JOINT = re.compile(r"[^\S\n]?\n?[^\S\n]?(?:>\s)?")

#: Words between the parts of a family name.
PARTICLES = frozenset("von van de der den del della di da dos du la le zu zur ten ter el al bin y".split())
#: Articles, pronouns, prepositions and the like, which begin no name however they are written.
FUNCTION_WORDS = frozenset(
    "a an the this that these those and or but for from with without after before between both could would should please nothing nobody only its our your my his her their when where which what how why who if as at in on of to by "
    "no not two it we you they he she is are was were be there here then so all any each every some can may must do does did have has had let "
    "der die das dem den ein eine einer und oder bitte nach zwischen im am zum zur mit ohne für von bei wir sie er es ich ist sind war auf aus "
    "des les un une est pour avec sans rien il elle nous vous dans sur au aux et ou par selon "
    "los las una para tras según sin con en por se lo su sus que del al".split()
)


@dataclass(frozen=True)
class Lexicon:
    """What is known of names and places: any of these sets may be empty."""

    given: frozenset[str]
    family: frozenset[str]
    places: frozenset[str]

    @classmethod
    def of(cls, people: Iterable[tuple[str | None, str | None, str | None]]) -> Lexicon:
        given, family, places = set(), set(), set()
        for g, f, p in people:
            for known, s in ((given, g), (family, f), (places, p)):
                if s and s.strip():
                    known.add(s.strip().lower())
        return cls(frozenset(given), frozenset(family), frozenset(places))


#: Widespread given names of English, German, French and Spanish speakers.
GIVEN = frozenset(
    "alice adam alan albert alejandro alex alexander alfred amelia amy ana andrea andreas andrew angela anna anne anthony antoine antonio arthur barbara beatriz ben benjamin bernard bernd birgit brian camille carlos carmen caroline "
    "catherine charles charlotte chloe christian christine christopher claire clara claudia claus daniel david deborah diana diego dieter dorothy edward elena elizabeth emily emma eric erik eva felix fernando florian francisco frank "
    "françois franz gabriel george gerhard grace gregory guillaume hannah hans harry heinrich helen helga henri henry hugo ian ines ingrid isabel jack jacques jakob james jan jane javier jean jennifer jessica joan johann john jonathan "
    "jorge josé joseph juan julia jürgen karen karin karl katharina katherine kevin klaus laura laurent lea linda lisa louis louise lucas lucia lucy luis luke manuel marco margaret maria marie mark markus martin mary matthew maximilian "
    "michael michel miguel monika natalie nicolas nicole oliver olivia pablo pascal patricia patrick paul paula pedro peter philip pierre rachel rafael raquel rebecca renate richard robert rosa ruth samuel sandra sarah sebastian sofia "
    "sophie stefan stephen susan sylvie teresa thomas timothy ursula uwe victor victoria walter werner william wolfgang yves".split()
)

Part = tuple  # features of a part of a segment: ((slot, value), ...)
Fold = Callable[[str, Part], object]
#: Parts of names whose scores are remembered; then memory starts anew.
MEMORY = 400_000


# ---------------------------------------------------------------- segments


def word_spans(text: str) -> list[tuple[int, int]]:
    """Words with inner hyphens and apostrophes; a possessive 's and an elided article (l', d') are no part of them."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if not _APOSTROPHE.search(text):
        return spans
    out = []
    for a, b in spans:
        w = text[a:b]
        if len(w) > 2:
            if w[1] in "'’" and (w[0] in "dlnscjmt" or w[0] in "DLNSCJMT" and w[2].islower()):
                out.append((a, a + 1))
                a += 2
            if b - a > 2 and text[b - 2] in "'’" and text[b - 1] in "sS":
                b -= 2
        out.append((a, b))
    return out


class Page:
    """A text with its words."""

    def __init__(self, text: str):
        self.text = text
        self.words = word_spans(text)
        self.ends = [b for _, b in self.words]

    def around(self, a: int, b: int) -> tuple[str, str, str, str, str, str]:
        """What stands before and behind a stretch: last word, the two last, mark between, characters beside it, next word."""
        text, k = self.text, bisect_right(self.ends, a)
        word = two = "^"
        mark = ""
        if k:
            x, y = self.words[k - 1]
            word = two = text[x:y].lower()
            gap = text[y:a]
            mark = "" if gap == " " else "\n" if "\n" in gap else "#" if _DIGIT.search(gap) else gap.strip()[:2]
            if k > 1:
                x, y = self.words[k - 2]
                two = text[x:y].lower() + " " + word
        c = text[b : b + 1]
        nxt = "-"
        if c == " " or c == "\xa0":
            k = bisect_right(self.ends, b)
            if k < len(self.words) and self.words[k][0] == b + 1:
                x, y = self.words[k]
                nxt = text[x:y].lower()
        return word, two, mark, _kind_of(text[a - 1]) if a else "^", _kind_of(c) if c else "$", nxt


class Folder:
    """Folds features, of parts that occurred before from memory."""

    def __init__(self, fold: Fold, memo: dict):
        self.fold, self.memo = fold, memo

    def around(self, kind: str, key: tuple[str, str, str, str, str, str]) -> object:
        got = self.memo.get((kind, key))
        if got is None:
            word, two, mark, before, behind, nxt = key
            got = self.memo[kind, key] = self.fold(kind, (("b1", word), ("b2", two), ("bm", (word, mark)), ("bc", before), ("ac", behind), ("a1", nxt)))
        return got


def _kind_of(c: str) -> str:
    return "a" if c.isalpha() else "9" if c.isdigit() else c


def _mails(page: Page, folder: Folder) -> Iterator[tuple[int, int, str, object]]:
    text = page.text
    forms = []
    if "@" in text:
        forms.append(("sign", _MAILS[0]))
    if "@" in text or "at" in text or "AT" in text:
        forms += [("bracket", _MAILS[1])] if any(c in text for c in "([{") else []
        forms += [("word", _MAILS[2])] if " dot " in text or " DOT " in text else []
    for form, rx in forms:
        for m in rx.finditer(text):
            a, whole = m.start(), m.group()
            at = _AT.search(whole).end()
            stops = [d.start() for d in _DOT.finditer(whole, at)]
            for e in [*stops[1:], len(whole)]:
                last = re.split(r"[^\w\-]+", whole[:e])[-1]
                f = (("email", ""), ("form", form), ("last", "9" if last[:1].isdigit() else "a" if last.isalpha() else "?"), ("whole", e == len(whole)), ("host", whole[at : at + 1].isdigit()))
                yield a, a + e, "email", folder.fold("email", f) + folder.around("email", page.around(a, a + e))


_size = lambda m: str(len(m.group()))
_SEPARATORS = frozenset(" -./–")


def _form(s: str, n: int, full: bool) -> Part:
    """The form of a run of ``n`` digits; the last feature tells what separates its groups."""
    sign = _GROUP.sub(_size, _BLANK.sub(" ", s))
    lead = "+" if s[0] == "+" else "(" if s[0] == "(" else "00" if s.startswith("00") else "0" if s[0] == "0" else "20" if s[:2] in ("19", "20") else "d"
    seps = "".join(sorted(set(sign) & _SEPARATORS))
    return (
        ("number", ""), ("sign", sign), ("n", min(n, 14)), ("lead", lead), ("full", full), ("ln", (lead, n)), ("sn", (seps, n)), ("groups", sign.count(" ") + sign.count("-") + sign.count(".")),
        ("fs", (full, sign)), ("ls", (lead, seps)), ("seps", seps),
    )


_ALIKE = str.maketrans("123456789" + "BCDEFGHIJKLMNOPQRSTUVWXYZ" + "\xa0", "0" * 9 + "A" * 25 + " ")


def _numbers(page: Page, folder: Folder) -> Iterator[tuple[int, int, str, object]]:
    text, memo, fold = page.text, folder.memo, folder.fold
    for m in _RUN.finditer(text):
        at, stop = m.span()
        if stop - at < 6:
            continue
        run = m.group()
        spans = [g.span() for g in _GROUP.finditer(run)]
        upto = [0]  # digits in the groups before
        for x, y in spans:
            upto.append(upto[-1] + y - x)
        n = len(spans)
        if upto[-1] < 6:
            continue
        ext = _EXT.match(text, stop)
        for i in range(n):
            a = spans[i][0]
            if a and run[a - 1] == "(":
                a -= 1
            if a and run[a - 1] == "+":
                a -= 1
            elif a > 1 and run[a - 2] == "+":
                a -= 2
            for j in range(i, min(n, i + MOST_GROUPS)):
                digits = upto[j + 1] - upto[i]
                if digits < 6:
                    continue
                if digits > MOST_DIGITS:
                    break
                b = spans[j][1]
                part = run[a:b]
                if part.count("(") != part.count(")"):
                    continue
                start, end = at + a, at + b
                full = i == 0 and j == n - 1
                key = (part.translate(_ALIKE), part[:2], full)
                context = page.around(start, end)
                ways = [("phone", end, "none"), ("id_number", end, "")]
                if ext and j == n - 1:
                    ways = [("phone", end, "left"), ("phone", ext.end(), "taken"), ("id_number", end, "")]
                for kind, e, how in ways:
                    form = memo.get((kind, key, how))
                    if form is None:
                        f = _form(part, digits, full)
                        form = memo[kind, key, how] = fold(kind, (*f, ("ext", how)) if kind == "phone" else f)
                    c = context if e == end else page.around(start, e)
                    seps = (kind, c[0], key[0])
                    said = memo.get(seps)
                    if said is None:
                        said = memo[seps] = fold(kind, (("bs", (c[0], "".join(sorted(set(key[0]) & _SEPARATORS)), digits)),))
                    yield start, e, kind, form + said + folder.around(kind, c)
    for m in _CODE.finditer(text):
        code = m.group()
        if code.isdigit() or not _UPPER.search(code):
            continue
        at = m.start()
        chunks = [(c.start(), c.end(), c.group()) for c in _CHUNKS.finditer(code)]
        upto, alnum = [0], [0]
        for x, y, c in chunks:
            upto.append(upto[-1] + sum(map(str.isdigit, c)))
            alnum.append(alnum[-1] + y - x)
        n = len(chunks)
        for i in range(n):
            for j in range(i, min(n, i + MOST_CHUNKS)):
                digits, letters = upto[j + 1] - upto[i], alnum[j + 1] - alnum[i] - upto[j + 1] + upto[i]
                if digits < 4 or digits > MOST_DIGITS or not letters:
                    continue
                x, y = chunks[i][0], chunks[j][1]
                head = chunks[i][2] if chunks[i][2].isalpha() else "#"
                first, last = i == 0, j == n - 1
                key = (code[x:y].translate(_ALIKE), head, first, last)
                form = memo.get(key)
                if form is None:
                    sign = _GROUP.sub(_size, key[0])
                    f = (
                        ("code", ""), ("code sign", sign), ("code head", head), ("code n", digits), ("code letters", min(4, letters)), ("code whole", first and last), ("code first", (first, last)),
                        ("code seps", "".join(sorted(set(sign) & _SEPARATORS))), ("code ws", (first and last, sign)),
                    )
                    form = memo[key] = fold("id_number", f)
                yield at + x, at + y, "id_number", form + folder.around("id_number", page.around(at + x, at + y))


def _town_ends(text: str, at: int) -> list[tuple[int, int]]:
    """(end, words) of the words of a place name that may begin at ``at``."""
    out, pos, n = [], at, 0
    while n < MOST_TOWN_WORDS:
        m = _TOWN.match(text, pos)
        if not m:
            link = _LINK.match(text, pos) if n else None
            if not link or text[link.end() : link.end() + 1] != " ":
                break
            pos = link.end() + 1
            continue
        n += 1
        end = m.end() - (1 if m.group()[-1] in "-'’" else 0)
        out.append((end, n))
        if text[m.end() : m.end() + 1] != " ":
            break
        pos = m.end() + 1
    return out


def _addresses(page: Page, lexicon: Lexicon, folder: Folder) -> Iterator[tuple[int, int, str, object]]:
    text = page.text
    for style, rx in _STREETS.items():
        # what a street of this style can't do without
        if style in _GATES and not _GATES[style].search(text):
            continue
        for m in rx.finditer(text):
            starts = [(m.start(), "no")]
            flat = _FLAT.search(text, max(0, m.start() - 20), m.start())
            if flat:
                starts = [(m.start(), "left"), (flat.start(), "taken")]
            core = m.end()
            ends: list[tuple[int, str, str, int]] = [(core, "no", "no", 0)]
            unit = _UNIT.match(text, core)
            for base, u in [(core, "no" if not unit else "left"), *([(unit.end(), "taken")] if unit else [])]:
                if base > core:
                    ends.append((base, u, "no", 0))
                sep = _SEP.match(text, base)
                if not sep:
                    continue
                z = _ZIP.match(text, sep.end())
                if z:
                    ends.append((z.end(), u, "first", 0))
                    gap = _BLANKS.match(text, z.end())
                    if gap:
                        ends += [(e, u, "first", n) for e, n in _town_ends(text, gap.end())]
                elif "," in sep.group() or "\n" in sep.group():
                    for e, n in _town_ends(text, sep.end()):
                        ends.append((e, u, "no", n))
                        gap = _COMMA.match(text, e)
                        z = _ZIP.match(text, gap.end()) if gap else None
                        if z:
                            ends.append((z.end(), u, "last", n))
            far = max(e[0] for e in ends)
            for e, u, zip_, n in ends:
                town = ""
                if n:
                    town = _ZIP_END.sub("", text[core:e]).rsplit(",", 1)[-1]
                    town = " ".join(_ZIP_HEAD.sub("", town).split()).lower()
                known = town in lexicon.places
                more = bool(_town_ends(text, e + 1)) if text[e : e + 1] == " " else False
                for a, fl in starts:
                    f = (
                        ("address", ""), ("address style", style), ("address flat", fl), ("address unit", u), ("address zip", zip_), ("address town", (n, zip_)), ("address far", (e == far, n > 0)),
                        ("address known", (known, zip_)), ("address kn", (known, n)), ("address form", (style, zip_, n > 0)), ("address more", (more, n > 0)), ("address tail", e == far and not more),
                    )
                    yield a, e, "address", folder.fold("address", f) + folder.around("address", page.around(a, e))


def _names(page: Page, lexicon: Lexicon, folder: Folder, known: frozenset[str]) -> Iterator[tuple[int, int, str, object]]:
    """Every run of up to MOST_NAME_WORDS words that may be a name; parts that occurred before are taken from memory."""
    text, words, memo, fold = page.text, page.words, folder.memo, folder.fold
    given, family = lexicon.given, lexicon.family
    units: list[tuple[int, int, str, str, int, str]] = []  # start, end, class, style, number of the word, word
    for k, (a, b) in enumerate(words):
        if text[a].isupper():
            w = text[a:b]
            if b - a == 1:
                if text[b : b + 1] == ".":
                    units.append((a, b + 1, "I", "", k, w))
                continue
            low = w.lower()
            kind = ("B" if low in given else "F") if low in family else "G" if low in given else "g" if low in GIVEN else "X"
            if kind == "X" and low in FUNCTION_WORDS and low not in PARTICLES:
                continue
            units.append((a, b, "p" if kind == "X" and low in PARTICLES else kind, "l" if w[0].islower() else "U" if b - a > 2 and w.isupper() else "T", k, low))
        else:
            w = text[a:b]
            if w in PARTICLES:
                units.append((a, b, "p", "", k, w))
            elif w in family:
                units.append((a, b, "B" if w in given else "F", "l", k, w))
            elif w in given:
                units.append((a, b, "G", "l", k, w))
    n = len(units)
    joints = ["|"] * n  # what joins a unit to the next
    for i in range(n - 1):
        x, y = units[i][1], units[i + 1][0]
        if y - x <= 4:
            gap = text[x:y]
            joints[i] = " " if gap == " " or gap and _JOINT.fullmatch(gap) and gap.count("\n") < 2 else "," if gap in (", ", ", ", ",\n") else "|"
    lower: set[str] | None = None
    inner: list[object] = [None] * n
    right: list[object] = [None] * n
    last = len(words) - 1
    for i in range(n):
        start, _, cls, _, p, _ = units[i]
        if cls == "p" and joints[i] == "|":
            continue
        ahead = units[i - 1][2] + joints[i - 1] if i and joints[i - 1] != "|" else "-"
        build, shape, total, lead = "", "", None, None
        for j in range(i, min(n, i + MOST_NAME_WORDS)):
            a, b, cls, style, k, low = units[j]
            if j > i:
                if joints[j - 1] == "|":
                    break
                build += joints[j - 1]
            build += cls
            if style and style not in shape:
                shape += style
            part = inner[j]
            if part is None:
                if cls in "Xg":
                    if lower is None:
                        lower = {text[x:y] for x, y in words}
                    key = (cls, style, low, style != "l" and low in lower)
                else:
                    key = (cls, style, low if cls == "I" else "")
                part = memo.get(key)
                if part is None:
                    if cls in "Xg":
                        f = (("word", low if low in known else "?"), ("end", low[-3:]), ("end2", low[-2:]), ("lower", (cls, key[3])), ("long", min(len(low), 12)), ("hyphen", "-" in low))
                    else:
                        f = (("initial", low),) if cls == "I" else (("listed", (cls, style)),)
                    part = memo[key] = fold("name", f)
                inner[j] = part
            total = part if total is None else total + part
            if cls in "Ip":
                continue
            if lead is None:
                if p:
                    x, y = words[p - 1]
                    prev, gap, was = text[x:y], text[y:start], "l" if text[x].islower() else "U" if y - x > 2 and text[x:y].isupper() else "T"
                    prev = prev.lower()
                    two = text[slice(*words[p - 2])].lower() if p > 1 else "^"
                else:
                    prev, gap, was, two = "^", text[:start], "", "^"
                mark = "" if gap == " " else "\n" if "\n" in gap else "#" if _DIGIT.search(gap) else gap.strip()[:2]
                if p and prev not in known:
                    prev = "?" + was
                key = (prev, mark, two, was, text[start - 1] if start else "^", ahead)
                lead = memo.get(key)
                if lead is None:
                    f = (("b1", prev), ("bm", (prev, mark)), ("b2", (two, prev)), ("mark", mark), ("bc", _kind_of(key[4])), ("ahead", ahead), ("bs", was if mark == "" else mark))
                    lead = memo[key] = fold("name", f)
            behind = joints[j] + units[j + 1][2] if joints[j] != "|" else "-"
            tail = right[j]
            if tail is None:
                if k < last:
                    x, y = words[k + 1]
                    nxt, gap, was = text[x:y], text[b:x], "l" if text[x].islower() else "U" if y - x > 2 and text[x:y].isupper() else "T"
                    nxt = nxt.lower()
                    if nxt not in known:
                        nxt = "?" + was
                else:
                    nxt, gap, was = "$", text[b:], ""
                mark = "" if gap == " " else "\n" if "\n" in gap else "#" if _DIGIT.search(gap) else gap.strip()[:2]
                two = text[b : b + 2]
                key = (nxt, mark, was, two, behind)
                tail = memo.get(key)
                if tail is None:
                    stuck = two[:1] in ("-", "_", "@", "+", "/") or (two[:1] == "." and two[1:2].isalnum())
                    f = (("a1", nxt), ("am", (nxt, mark)), ("amark", mark), ("ac", _kind_of(two[0]) if two else "$"), ("stuck", stuck), ("behind", behind), ("as", was if mark == "" else mark))
                    tail = memo[key] = fold("name", f)
                right[j] = tail
            key = (build, shape, ahead, behind, "form")
            form = memo.get(key)
            if form is None:
                of = "".join(sorted(shape)) if len(shape) < 3 else "mix"
                f = (("name", ""), ("build", build), ("shape", (build, of)), ("ba", (build, ahead)), ("bb", (build, behind)), ("free", (build, ahead == "-", behind == "-")))
                form = memo[key] = fold("name", f)
            yield start, b, "name", lead + total + form + tail


def segments(text: str, lexicon: Lexicon, fold: Fold = lambda kind, f: f, known: frozenset[str] = frozenset(), memo: dict | None = None) -> list[tuple[int, int, str, object]]:
    """(start, end, kind, folded features) of every candidate; ``fold`` turns features into what is added up."""
    page, folder = Page(text), Folder(fold, {} if memo is None else memo)
    out = [*_mails(page, folder), *_names(page, lexicon, folder, known)]
    if _DIGIT.search(text):
        out += [*_numbers(page, folder), *_addresses(page, lexicon, folder)]
    return [s for s in out if 0 < s[1] - s[0] <= MOST_CHARS]


def _between(text: str, a: int, b: int) -> str:
    return _BLANK.sub(" ", text[a:b])


# ---------------------------------------------------------------- model


class SemiCrf:
    """Weights of features; a text's segmentations are weighted by the sum of theirs."""

    def __init__(self, lexicon: Lexicon, weights: dict[str, dict[tuple, float]] | None = None, known: frozenset[str] = frozenset()):
        self.memo: dict = {}
        self.lexicon, self.weights, self.known = lexicon, weights or {kind: {} for kind in (*TYPES, NEXT)}, known

    def score(self, kind: str, part: Part) -> float:
        get = self.weights[kind].get
        s = 0.0
        for f in part:
            s += get(f, 0.0)
        return s

    def decode(self, text: str) -> list[tuple[int, int, str]]:
        """The best segmentation's entities, in order."""
        get = self.weights[NEXT].get
        # what follows another entity can gain no more than the best transition
        gain = self.gain
        if len(self.memo) > MEMORY:
            self.memo.clear()
        found = [(e, a, kind, s) for a, e, kind, s in segments(text, self.lexicon, self.score, self.known, self.memo) if s + gain > 0]
        if not found:
            return []
        found.sort()
        n = len(found)
        ends = [f[0] for f in found]
        alone = [0.0] * n  # best segmentation that ends with this segment
        came = [-1] * n  # the neighbour before it, if that is the best way
        best = [0.0] * (n + 1)
        take = [-1] * (n + 1)
        far = [0] * n
        for k in range(n):
            end, start, kind, s = found[k]
            f = far[k] = bisect_right(ends, start - NEAR - 1, 0, k)
            v = best[f]
            for j in range(f, bisect_right(ends, start, 0, k)):
                w = alone[j] + get((found[j][2], kind, _between(text, found[j][0], start)), 0.0)
                if w > v:
                    v, came[k] = w, j
            alone[k] = v + s
            if alone[k] > best[k]:
                best[k + 1], take[k + 1] = alone[k], k
            else:
                best[k + 1], take[k + 1] = best[k], take[k]
        out, k = [], take[n]
        while k >= 0:
            end, start, kind, _ = found[k]
            out.append((start, end, kind))
            k = came[k] if came[k] >= 0 else take[far[k]]
        return out[::-1]

    @property
    def gain(self) -> float:
        got = self.__dict__.get("_gain")
        if got is None:
            got = self.__dict__["_gain"] = 2 * max([0.0, *self.weights[NEXT].values()])
        return got

    def fit(self, labelled: Sequence[tuple[str, set[tuple[int, int, str]]]], epochs: int = 4, rate: float = 0.2, l2: float = 1e-5) -> SemiCrf:
        """Maximum likelihood by AdaGrad over texts in a fixed order; entities that are no candidates are left out."""
        ids: dict[tuple, int] = {}
        code = lambda f: ids.setdefault(f, len(ids))
        prepared, memo = [], {}
        # words of a few texts only stand for all words the model will not know
        held = Counter(w for text, _ in labelled for w in {text[a:b].lower() for a, b in word_spans(text)})
        known = self.known = frozenset(w for w, n in held.items() if n >= 5)
        for text, gold in labelled:
            segs = sorted(segments(text, self.lexicon, known=known, memo=memo), key=lambda s: (s[1], s[0], s[2]))
            if not segs:
                continue
            n = len(segs)
            ends = [s[1] for s in segs]
            far = [bisect_right(ends, s[0] - NEAR - 1, 0, k) for k, s in enumerate(segs)]
            pairs = []  # (before, after) neighbours
            for k, s in enumerate(segs):
                pairs += [(j, k) for j in range(far[k], bisect_right(ends, s[0], 0, k))]
            is_gold = np.array([(s[0], s[1], s[2]) in gold for s in segs], float)
            flat = [code((s[2], f)) for s in segs for f in s[3]] + [code((NEXT, (segs[j][2], segs[k][2], _between(text, segs[j][1], segs[k][0])))) for j, k in pairs]
            sizes = [len(s[3]) for s in segs] + [1] * len(pairs)
            chosen = [k for k in range(n) if is_gold[k]]
            linked = {(j, k) for j, k in zip(chosen, chosen[1:])}
            gold_pairs = np.array([float(p in linked) for p in pairs])
            used, inverse = np.unique(np.array(flat), return_inverse=True)
            starts = sorted(range(n), key=lambda k: segs[k][0])
            firsts = [segs[k][0] for k in starts]
            beyond = [bisect_left(firsts, segs[k][1] + NEAR + 1) for k in range(n)]
            before: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            behind: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            for p, (j, k) in enumerate(pairs):
                before[k].append((j, n + p))
                behind[j].append((k, n + p))
            prepared.append((n, np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(sizes)), sizes), used, inverse, far, starts, beyond, before, behind, pairs, np.concatenate((is_gold, gold_pairs))))
        w, g2 = np.zeros(len(ids)), np.zeros(len(ids))
        add = lambda x, y: (x if x > y else y) + math.log1p(math.exp(-abs(x - y)))
        for _ in range(epochs):
            for n, offsets, owner, used, inverse, far, starts, beyond, before, behind, pairs, gold in prepared:
                sc = np.add.reduceat(w[used][inverse], offsets).tolist()
                fore = [0.0] * (n + 1)  # log sum over segmentations of the first segments by end
                to = [0.0] * n  # the same, ending with this one
                for k in range(n):
                    v = fore[far[k]]
                    for j, p in before[k]:
                        v = add(v, to[j] + sc[p])
                    to[k] = v + sc[k]
                    fore[k + 1] = add(fore[k], to[k])
                back = [0.0] * (n + 1)  # over the segments from a rank on, in order of start
                on = [0.0] * n  # over what may follow this one
                for r in range(n - 1, -1, -1):
                    k = starts[r]
                    v = back[beyond[k]]
                    for m, p in behind[k]:
                        v = add(v, sc[m] + sc[p] + on[m])
                    on[k] = v
                    back[r] = add(back[r + 1], sc[k] + v)
                z = fore[n]
                likely = [math.exp(min(0.0, to[k] + on[k] - z)) for k in range(n)]
                likely += [math.exp(min(0.0, to[j] + sc[n + p] + sc[k] + on[k] - z)) for p, (j, k) in enumerate(pairs)]
                d = gold - np.array(likely)
                if np.abs(d).max() < 1e-3:
                    continue
                g = np.bincount(inverse, d[owner], len(used)) - l2 * w[used]
                h = g2[used] + g * g
                g2[used] = h
                w[used] += rate * g / np.sqrt(h + 1e-8)
        self.weights = {kind: {} for kind in (*TYPES, NEXT)}
        for (kind, f), i in ids.items():
            if abs(w[i]) > 1e-6:
                self.weights[kind][f] = float(w[i])
        self.__dict__.pop("_gain", None)
        self.memo.clear()
        return self


_FITTED: dict[tuple, SemiCrf] = {}


def fitted(lexicon: Lexicon, sentences: int = 24000, seed: int = 9) -> SemiCrf:
    """The model for a lexicon, fitted once per process on ``sentences`` generated texts."""
    key = (lexicon, sentences, seed)
    if key not in _FITTED:
        from skydrift.llm.pii_training import labelled_texts

        _FITTED[key] = SemiCrf(lexicon).fit(labelled_texts(lexicon, sentences, seed))
    return _FITTED[key]


# ---------------------------------------------------------------- operators


def lexicon_of(people: DataFrame, documents: DataFrame | None = None) -> Lexicon:
    """From a staff list (given_name, family_name, site), of at most MOST_STAFF different names.

    Of a longer list the names whose first word occurs in ``documents`` are taken, which loses
    nothing that could be found; if these are still more, the list can't be broadcast and that is an error.
    """
    from pyspark.sql import functions as F

    one = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lower(F.trim(c)).alias("v")) for k, c in enumerate(("given_name", "family_name", "site"))])).alias("n")
    names = people.select(one).select("n.k", "n.v").where("v is not null and v <> ''").distinct()
    rows = names.limit(MOST_STAFF + 1).collect()
    if len(rows) > MOST_STAFF and documents is not None:
        word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1)))).alias("w")
        seen = documents.where("text is not null").select(word).distinct()
        first = F.regexp_extract("v", r"([\p{L}]+)", 1)
        rows = names.join(seen, first == F.col("w"), "left_semi").limit(MOST_STAFF + 1).collect()
    if len(rows) > MOST_STAFF:
        raise ValueError(f"a staff list of more than {MOST_STAFF} names that occur is no lexicon to broadcast")
    kinds = [frozenset(r.v for r in rows if r.k == k) for k in range(3)]
    return Lexicon(*kinds)


def find_pii(documents: DataFrame, people: DataFrame) -> DataFrame:
    """doc_id, pii_type, pii_text: the entities of each text, once per document, type and text.

    pii_text is the stretch exactly as it stands in the text. Null and empty texts hold none;
    rows without an id are ignored; a document given twice counts once. Whole texts are read.
    """
    model = documents.sparkSession.sparkContext.broadcast(fitted(lexicon_of(people, documents)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            ids, kinds, spans = [], [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for kind, span in {(k, t[a:e]) for a, e, k in m.decode(t)}:
                    ids.append(i)
                    kinds.append(kind)
                    spans.append(span)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "pii_type", "pii_text"])

    rows = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    return rows.mapInArrow(find, "doc_id long, pii_type string, pii_text string").distinct()


def redact(text: str, entities: Sequence[tuple[int, int, str]]) -> str:
    """The text with each entity replaced by its typed placeholder, otherwise unchanged."""
    out, at = [], 0
    for a, b, kind in entities:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact_pii(documents: DataFrame, people: DataFrame) -> DataFrame:
    """doc_id, text with placeholders, n_entities; null texts stay null, every row comes out once."""
    model = documents.sparkSession.sparkContext.broadcast(fitted(lexicon_of(people, documents)))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            texts, counts = [], []
            for t in b.column("text").to_pylist():
                found = m.decode(t) if t else []
                texts.append(redact(t, found) if t else t)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_entities"])

    return documents.select("doc_id", "text").mapInArrow(replace, "doc_id long, text string, n_entities int")
