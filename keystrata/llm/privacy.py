"""Personal information in free text: candidates by form, decided by what their terms disclose.

Three passes, all over the whole corpus:

1. Every text is searched once for places that could name or reach a person. What form alone proves is
   sure: mail addresses, phone numbers with a prefix or an area code, identity numbers in separated
   groups, postal addresses with a postcode. Everything else is only possible: sequences of capitalised
   words, quoted values of keys that end in "name", other groups of digits, numbers beside capitalised
   words. A possible place leaves with the terms that could decide it: the parts of the name, the one
   and two words before it, the label of the number, the words of the street.
2. Co-occurrence over the corpus says how strongly a term reveals a protected entity. A part of a name
   is counted by how often it stands beside a sure place; a context (words before names) by how often
   the names behind it do, or hold a part that does; then the parts once more, with such contexts as
   company. A label is counted by the share of sure numbers behind it, a street word by the share of
   addresses with a postcode. Its disclosure is the log-odds of that, in bits. Terms often seen and
   almost never in such company are public: words, companies, products.
3. A possible place counts if one of its terms discloses more than the threshold, or if it stands beside
   a sure place, unless one of its terms is public. There is no list of words that introduce a person, a
   number or a street.

Terms over the threshold are thereby removed from the text wherever they name someone: the place is
generalised to a placeholder of its kind, the rest of the text stays as it is.

Positions count Unicode code points. Null and empty texts have no places. Overlapping places: mail
address before postal address before phone before number before name, then the earlier and longer. The
work is linear in the length of a text, whatever it holds; nothing is looked for within a distance.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.sources.scratch import written

#: Bits of disclosure from which a part of a name counts as revealing.
THRESHOLD_BITS = -2.5
#: Bits from which the words before names reveal that a name follows, and places they must stand before.
CONTEXT_BITS, CONTEXT_TIMES = -0.5, 3
#: Places a term must stand in, and bits it must stay below, to count as public.
PUBLIC_TIMES = 8
PUBLIC_BITS = -5.0
#: Log-odds of sure numbers behind a label from which its other numbers count, and of postcodes for a street word.
LABEL_BITS, PHONE_BITS, STREET_BITS = -3.0, 0.0, -2.5

SURE, POSSIBLE = 0, 2
#: Among the terms of a name: its parts do not decide it, only the words before it.
ONLY_BEHIND = ","

_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĲĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽΑ-ΩЀ-Я"
_L = r"[^\W\d_]"
_WORD = rf"(?:[OD]['’])?[{_UPPER}]{_L}+(?:-(?:[OD]['’])?[{_UPPER}]{_L}+)*"
_INITIAL = rf"[{_UPPER}]\."
_PARTICLE = r"(?:van|von|del|de|da|di|du|af|av|der|den|ter|zu|la|le)(?: (?:la|der|den|las|los))?"
#: Words that stand before a name without being part of it.
_LEAD = r"(?:FIXME|TODO|XXX|NOTE|HACK|Ms|Mr|Mrs|Dr|Prof|Sir|By|By|From|To|With|Thanks|Contact|Ask|Written|Created|Copyright|Author|Maintainer|Write|The|All|Tel|Fax|Phone|Box|Co)"
_NAME = re.compile(
    rf"(?<![\w.’-])(?<!\w')(?!{_LEAD}\b)(?:(?:{_WORD}|{_INITIAL})(?: {_INITIAL}){{0,3}}(?: {_PARTICLE})? {_WORD}(?!\w|['’]\w)"
    rf"|{_WORD}, (?:{_WORD}|{_INITIAL})(?: {_INITIAL}){{0,3}}(?!\w|['’]\w))"
    r"|[ァ-ヶー]+(?:・[ァ-ヶー]+)+"
)
#: The pattern takes three initials in a row, for linear time; longer runs are taken by ``_whole``.
_BEFORE = re.compile(rf"(?<![\w.’-])(?<!\w')(?!{_LEAD}\b)(?:{_WORD}|{_INITIAL}) ")
_MORE_INITIALS = re.compile(rf"(?: {_INITIAL})+(?!\w|['’]\w)")
_FIELD = re.compile(rf"name[\"']?\s*[:=]\s*[\"']((?:[^\"'\n]|(?<=[OD])'(?={_L}))+)[\"']", re.IGNORECASE)
_PERSON_ROW = re.compile(r"(?i:insert into (\w+) values) ?\((?:\d+, )?'((?:[^'\n]|'')+)', '((?:[^'\n]|'')+)', '([^'\n]+)'")
_PERSON_FIELD = re.compile(rf"(?:{_WORD}|{_INITIAL}|[{_UPPER}]{_L}*''{_L}+|[ァ-ヶー・]+)(?:[ -](?:{_PARTICLE} )?(?:{_WORD}|[OD]''{_L}+))*|{_PARTICLE} {_WORD}")
#: Endings of organisations.
_ORG = frozenset("labs works foundation collective systems group team inc ltd llc corp gmbh ag authors contributors developers project society institute university company committee".split())
_TLD = r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
_MAIL = re.compile(
    r"(?<![\w.+%-])[A-Za-z0-9_][A-Za-z0-9._+-]*(?:"
    rf"(?:@|%40|&#64;|&commat;| ?[(\[{{] ?at ?[)\]}}] ?){_TLD}"
    r"| ?[(\[{] ?at ?[)\]}] ?[A-Za-z0-9-]+(?: ?[(\[{] ?dot ?[)\]}] ?[A-Za-z0-9-]+)+"
    r"| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)",
    re.IGNORECASE,
)
_MAIL_MARKS = ("@", "%40", "&#64;", "&commat;", " dot ")
_MAIL_HINT = re.compile(r"@|%40|&#64;|&commat;|(?<= at )[A-Za-z0-9-]+ dot |[(\[{] ?at ?[)\]}]", re.IGNORECASE)
_BRACKET_AT = re.compile(r"[(\[{] ?at ?[)\]}]", re.IGNORECASE)
_PHONE = re.compile(
    r"(?<![\w.+/-])(?<!\d,)(?:"
    r"\+\d{8,15}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]\d{2,8}){0,5}"
    r"|00\d{2}(?: \d{1,5}){2,5}"
    r"|\(\d{3}\) ?\d{3}-\d{4}|\(0\d{1,4}\) ?\d{3,8}(?:[ -]\d{3,8})*"
    r"|1-\d{3}-\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}"
    r"|0\d(?:\.\d\d){4}|0\d(?: \d\d){4}"
    r"|0\d{2,4}/\d{3,8}(?:-\d{1,5})?|0\d{4} \d{6}|0\d{3} \d{3} \d{4}|0\d{2} \d{4} \d{4}"
    r")(?![\w/]|[.-]\d)"
)
_NUMBER = re.compile(
    r"(?<![\w.+/-])(?:(\d{3}-\d\d-\d{4}|[A-Z]{2} \d\d \d\d \d\d [A-Z])|\d{3} \d\d \d{4}|\d{11}|\d{9}|\d{8}-?[A-ZÑ]|[A-Z]{2}\d{6}[A-Z]|[A-Z]{1,2}\d{7})(?![\w/-]|\.\d)"
)
#: Digits in groups or in one, whatever the grouping; what is around them is looked at afterwards.
_RUN = re.compile(r"(?<![\w.+/-])\(?\d(?:[ ./()-]{0,2}+\d)++")
_DATE = re.compile(r"\d{4}[-./]\d\d[-./]\d\d|\d\d[-./]\d\d[-./]\d{4}|(?:1[89]|20)\d\d[ -]+(?:1[89]|20)\d\d$")
_LETTERS, _WORD_OR_END = re.compile(r"[^\W\d_]+|©"), re.compile(r"[^\W\d_]+|\n")
_PLACE = rf"[{_UPPER}]{_L}+(?:[ -][{_UPPER}]{_L}+)*"
_PLAIN = rf"(?:[OD]['’])?[{_UPPER}](?:(?![A-Z]){_L}|['’](?={_L}))+(?:-[{_UPPER}](?:(?![A-Z]){_L})+)*"
_UNIT = r"(?:, (?:Apt|Unit|Suite|Flat|Floor|Room|Ste)\.? ?[\w-]+)?"
_TOWN = rf"(, {_PLACE}(?:, (?:[A-Z]{{1,2}}\d[\dA-Z]? \d[A-Z]{{2}}|[A-Z]{{2}} \d{{5}}(?:-\d{{4}})?)| \d{{5}}(?:-\d{{4}})?)(?!\w))?"
_CODE_TOWN = rf"(, \d{{4,5}} {_PLACE})?"
#: A number, then the street: capitalised words, or a lower-case word and a name.
_NUMBER_STREET = re.compile(rf"(?<![\w.-])\d{{1,5}}[A-Za-z]?,? (?:(?:bis |ter )?([a-zß-ÿ]+) (?:des |de la |de l'|du |de |d')?)?({_PLAIN}(?: {_PLAIN})*+)(\.?)(?![\w-])({_UNIT})(?:{_CODE_TOWN}(?!\d){_TOWN})")
#: The street, then its number: one word, or a word for a street that stands apart and a name.
_STREET_NUMBER = re.compile(rf"(?<![\w.-])((?:(?:Calle|Avenida|Plaza|Via|Rua|Viale|Corso|Passeig|Ulica|Rue) (?:de |del |de la |da |di |do |dos |las |los )?)(?:{_PLAIN} )?)?({_PLAIN}\.?) \d{{1,5}} ?[a-z]?(?!\w)(?:, \d+\.?[ºª] [A-Z])?{_CODE_TOWN}", re.UNICODE)
_BOX = re.compile(rf"P\. ?O\. Box \d+{_TOWN}")
_HOUSE = re.compile(rf"\d[A-Za-z]?,? [^\W\d_]|[^\W\d_]\.? \d|Box \d")
_DIGITS = re.compile(r"\d[\d .()/-]{4,}\d|\d{4}-[^\W\d_]")
_CAPITAL = re.compile(rf" [{_UPPER}]")
_VOWEL = re.compile("[aeiouyäöüáéíóúàèìòùâêîôûæøå]", re.IGNORECASE)
_ODD = re.compile("[！-～‐‑  　]")
_SAME = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x2010: 0x2D, 0x2011: 0x2D, 0xA0: 0x20, 0x202F: 0x20, 0x3000: 0x20}
_PART = re.compile(rf"{_L}+(?:['’]{_L}+)*|[ァ-ヶー]+")
_PARTICLES = frozenset("van von del de da di du af av der den ter zu la le las los".split())

KINDS = ("email", "address", "phone", "idnum", "name")
_COLUMNS = "doc_id bigint, kind string, start_char int, end_char int, standing int, beside boolean, terms array<string>"


def _parts(name: str) -> list[str]:
    """Parts of a name that can disclose, folded; initials and particles are left out."""
    words = [p.casefold().replace("’", "'") for p in _PART.findall(name) if len(p) > 1 and p not in _PARTICLES]
    return [w[2:] if w[:2] in ("o'", "d'") else w for w in words]


def candidates(text: str) -> list[tuple[str, int, int, int, bool, list[str]]]:
    """Places of a text that name or reach a person, or could: (kind, start, end, standing, beside, terms).

    ``beside`` says that a possible place stands in the company that the co-occurrence counts are about; a
    sure place is company by itself.
    """
    plain = text.translate(_SAME) if not text.isascii() and _ODD.search(text) else text
    taken, out = _Taken(), []
    folded = plain.lower()

    def sure(kind: str, a: int, b: int, terms: list[str]) -> None:
        out.append((kind, a, b, SURE, True, terms))
        taken.add(a, b, kind)

    if any(x in folded for x in _MAIL_MARKS) or _BRACKET_AT.search(plain):
        for a, b in _mails(plain):
            sure("email", a, b, [])
        taken.settle()
    streets: list[tuple[str, int, int, int, bool, list[str]]] = []
    for line, end in _lines(_HOUSE, plain):
        for place in _addresses(plain, line, end):
            if not taken.over(place[1], place[2]):
                streets.append(place)
    streets.sort(key=lambda p: (p[1], -p[2]))
    for place in streets:
        if place[3] != SURE:
            out.append(place)
        elif not taken.over(place[1], place[2]):
            sure("address", place[1], place[2], place[5])
    taken.settle()

    digits = list(_lines(_DIGITS, plain))
    words = _Words(plain)
    for line, end in digits:
        for m in _PHONE.finditer(plain, line, end):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15 and not taken.over(*m.span()):
                sure("phone", *m.span(), words.terms("p", line, m.start()))
    taken.settle()
    rows = {m.start(4): m for m in _PERSON_ROW.finditer(plain)} if "'" in plain else {}
    words = _Words(plain)
    for line, end in digits:
        for m in _NUMBER.finditer(plain, line, end):
            a, b = m.span()
            if taken.over(a, b):
                continue
            labels = [f"i:into {rows[a].group(1).casefold()}"] if a in rows else words.terms("i", line, a)
            if m.group(1):
                sure("idnum", a, b, labels)
            else:
                near = taken.before(a)
                beside = near is not None and near[1] == "phone" and near[0] >= line and plain[near[0] : a].strip(" ") in ("", ";", ",", "\t", "|")
                out.append(("idnum", a, b, POSSIBLE, beside, labels))
    taken.settle()
    words = _Words(plain)
    for line, end in digits:
        for m in _RUN.finditer(plain, line, end):
            a, b = m.span()
            n = sum(c.isdigit() for c in m.group())
            after = plain[b : b + 2]
            if not 8 <= n <= 15 or after[:1].isalnum() or after[:1] in ("/", "_") or after[:1] in (".", "-") and after[1:].isalnum() or _DATE.match(m.group()) or taken.over(a, b):
                continue
            labels = words.terms("p", line, a)
            if labels and not _NUMBER.fullmatch(m.group()):  # else it is a number above
                out.append(("phone", a, b, POSSIBLE, False, labels))
                out.append(("idnum", a, b, POSSIBLE, False, [f"i{x[1:]}" for x in labels]))

    numbers = {o[1] for o in out if o[0] == "idnum"}
    for at, m in rows.items():
        if at not in numbers:
            continue
        near = taken.over(at, at + 1)
        for g in (2, 3):
            a, b = m.span(g)
            if _PERSON_FIELD.fullmatch(text, a, b) and not taken.over(a, b):
                parts = [f"n:{p}" for p in _parts(text[a:b].replace("''", "'"))]
                out.append(("name", a, b, POSSIBLE, near is not None, [*parts, f"c:into {m.group(1).casefold()}"]))
                taken.add(a, b, "")
    if "name" in folded:
        for m in _FIELD.finditer(text):
            a, b = m.span(1)
            if _PERSON_FIELD.fullmatch(text, a, b) and not taken.over(a, b) and not _camel(text[a:b]) and not any(p in _ORG for p in _parts(text[a:b])):
                key = _key(text, m.start() + 4)
                beside = " " in text[a:b] and _beside(text, taken, a, b)
                out.append(("name", a, b, POSSIBLE, beside, [*[f"n:{p}" for p in _parts(text[a:b])], f"c:{key}:"]))
                taken.add(a, b, "")
    taken.settle()
    words = _Words(text)
    for line, end in _lines(_CAPITAL, text) if "・" not in text else _every_line(text):
        at = line
        while m := _NAME.search(text, at, end):
            a, b = _whole(text, *m.span(), at, end)
            at = b
            clash = taken.over(a, b)
            if clash:
                at = max(a + 1, clash[1] if clash[0] <= a else a + 1)
                continue
            name = text[a:b]
            parts = _parts(name)
            if not parts or any(p in _ORG for p in parts) or any(_camel(w) for w in name.split()):
                at = _after_first(text, a, b)
                continue
            beside = _beside(text, taken, a, b)
            if "," in name and not (beside or text[a - 1 : a] in tuple("\"'[(*|;")):
                # "Family, Given" where what stands before it reveals a name; else it begins with the second part
                out.append(("name", a, b, POSSIBLE, False, [*[f"n:{p}" for p in parts], ONLY_BEHIND, *words.terms("c", line, a)]))
                at = _after_first(text, a, b)
                continue
            out.append(("name", a, b, POSSIBLE, beside, [*[f"n:{p}" for p in parts], *words.terms("c", line, a)]))
    return out


def _key(text: str, end: int) -> str:
    """The letters of the key that ends here, folded: its word, and the word before if it is just "name"."""
    a = end
    while a > 0 and (text[a - 1].isalnum() or text[a - 1] == "_"):
        a -= 1
    if end - a == 4 and a > 1 and text[a - 1] in " -" and text[a - 2].isalpha():
        a -= 1
        while a > 0 and text[a - 1].isalpha():
            a -= 1
    return "".join(c for c in text[a:end].casefold() if c.isalpha())


def _every_line(text: str) -> Iterator[tuple[int, int]]:
    begin = 0
    while begin < len(text):
        end = text.find("\n", begin)
        end = len(text) if end < 0 else end
        yield begin, end
        begin = end + 1


def _mails(plain: str) -> Iterator[tuple[int, int]]:
    """Mail addresses; not remotes of repositories, servers with a port or users of a connection string."""
    for line, end in _lines(_MAIL_HINT, plain):
        seen = token = line  # where the run of characters that an address of a resource can hold begins
        scheme = -1
        for m in _MAIL.finditer(plain, line, end):
            a, b = m.span()
            token = max(token, *(plain.rfind(c, seen, a) + 1 for c in " \t\"'<>(),;|[]{}`"))
            scheme = max(scheme, plain.rfind("://", seen, a))
            seen = a
            if plain.startswith("git@", a) or plain[b : b + 1] == ":" and plain[b + 1 : b + 2].isalnum():
                continue
            if scheme >= token and plain[a - 1] not in "=?&":
                continue
            yield a, b


def _addresses(plain: str, line: int, end: int) -> Iterator[tuple[str, int, int, int, bool, list[str]]]:
    """Places of a line that have the form of a postal address; with a postcode of five signs they are sure."""
    for m in _BOX.finditer(plain, line, end):
        yield "address", *m.span(), SURE, True, ["a:box"]
    for m in _NUMBER_STREET.finditer(plain, line, end):
        low, words, unit, code, town = m.group(1), m.group(2), m.group(4), m.group(5), m.group(6)
        coded = bool(town) or bool(code) and code[2:7].isdigit()
        if low:
            if coded or not code:
                yield "address", m.start(), m.end(), SURE if coded else POSSIBLE, coded, [f"a^{low.casefold()}"]
            continue
        last = words.rpartition(" ")[2]
        if town and " " in words:
            yield "address", *m.span(), SURE, True, [f"a:{last.casefold()}"]
            continue
        # the street may end with any of the words from the second on; unit and town belong to the last
        at = m.start(2)
        for n, word in enumerate(words.split(" ")):
            at += len(word) + 1
            if n:
                whole = at > m.end(2)
                # a full stop belongs to a word without vowels, which is an abbreviation
                to = m.end(4) if whole and unit else m.end(3) if whole and not _VOWEL.search(word) else m.end(2) if whole else at - 1
                yield "address", m.start(), to, POSSIBLE, False, [f"a:{word.casefold()}"]
    for m in _STREET_NUMBER.finditer(plain, line, end):
        apart, word, code = m.group(1), m.group(2).casefold().rstrip("."), m.group(3)
        coded = bool(code) and code[2:7].isdigit()
        terms = [f"a<{apart.split()[0].casefold()}"] if apart else [f"a~{word[-n:]}" for n in (3, 4, 5, 6) if len(word) > n]
        if terms:
            yield "address", m.start(), m.end(), SURE if coded else POSSIBLE, coded, terms


def _beside(text: str, taken: _Taken, a: int, b: int) -> bool:
    """Whether a sure place stands on the same line with at most one word between."""
    before, after = taken.before(a), taken.after(b)
    return before is not None and before[1] != "" and _close(text, before[0], a) or after is not None and after[1] != "" and _close(text, b, after[0])


def _close(text: str, a: int, b: int) -> bool:
    words = 0
    for m in _WORD_OR_END.finditer(text, a, b):
        if m.group() == "\n":
            return False
        words += 1
        if words > 1:
            return False
    return True


def _lines(hint: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the lines in which a hint occurs."""
    m = hint.search(text)
    while m:
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        yield text.rfind("\n", 0, m.start() + 1) + 1, end
        m = hint.search(text, end)


def _camel(word: str) -> bool:
    return bool(re.search(r"[a-z][A-Z]", word.replace("O'", "").replace("O’", "")))


def _whole(text: str, a: int, b: int, low: int, high: int) -> tuple[int, int]:
    """Bounds of a name with all of its initials, within ``[low, high)``."""
    if text[a + 1 : a + 2] == ".":
        while a - 3 >= low and text[a - 2 : a] == ". " and (m := _BEFORE.match(text, a - 3)) and m.end() == a:
            a -= 3
        # the word before the first initial belongs to it, as in a shorter run
        begin = max(low, text.rfind(" ", low, max(low, a - 1)) + 1)
        a = next((p for p in range(begin, a - 1) if (m := _BEFORE.match(text, p)) and m.end() == a), a)
    if text[b - 1] == "." and (m := _MORE_INITIALS.match(text, b, high)):
        b = m.end()
    return a, b


def _after_first(text: str, a: int, b: int) -> int:
    """Where to look on after a sequence that is no name: behind its first word."""
    space = text.find(" ", a, b)
    return b if space < 0 else space + 1


class _Taken:
    """Disjoint stretches of a text that are taken, in order, each with the kind of what lies there.

    A search adds its own in ascending order; ``settle`` after it puts them to those of the searches before.
    """

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.kinds: list[str] = []
        self._new: tuple[list[int], list[int], list[str]] = ([], [], [])

    def add(self, a: int, b: int, kind: str) -> None:
        for column, value in zip(self._new, (a, b, kind)):
            column.append(value)

    def settle(self) -> None:
        if self._new[0]:
            every = sorted([*zip(self.starts, self.ends, self.kinds), *zip(*self._new)])
            self.starts, self.ends, self.kinds = [list(x) for x in zip(*every)]
            self._new = ([], [], [])

    def over(self, a: int, b: int) -> tuple[int, int] | None:
        """A taken stretch that shares a character with ``[a, b)``."""
        for starts, ends in ((self.starts, self.ends), self._new[:2]):
            i = bisect_left(starts, b) - 1
            if i >= 0 and ends[i] > a:
                return starts[i], ends[i]
        return None

    def before(self, a: int) -> tuple[int, str] | None:
        """End and kind of the last settled stretch that ends at or before ``a``."""
        i = bisect_left(self.starts, a) - 1
        return (self.ends[i], self.kinds[i]) if i >= 0 and self.ends[i] <= a else None

    def after(self, b: int) -> tuple[int, str] | None:
        """Start and kind of the first settled stretch that begins at or after ``b``."""
        i = bisect_left(self.starts, b)
        return (self.starts[i], self.kinds[i]) if i < len(self.starts) else None


class _Words:
    """The last two words before places of a text, asked for in ascending order; each line is read once."""

    def __init__(self, text: str):
        self.text, self.line, self.at = text, -1, 0
        self.words: list[str] = []

    def terms(self, prefix: str, line: int, at: int) -> list[str]:
        """The word before a place on its line, whatever signs stand between, and the two words before it."""
        if line != self.line or at < self.at:
            self.line, self.at, self.words = line, line, []
        found = _LETTERS.findall(self.text, self.at, at)
        self.words, self.at = [*self.words, *found][-2:], at
        return [f"{prefix}:{' '.join(self.words[-n:]).casefold()}" for n in range(1, len(self.words) + 1)]


def find_candidates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All sure and possible places of all texts."""

    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string())]

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, types)], ["doc_id", "kind", "start_char", "end_char", "standing", "beside", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, value in enumerate(batch.column(1)):  # one text at a time is a Python string
                rows += [(ids[i], *c) for c in candidates(value.as_py() or "")]
                if len(rows) > 20_000:
                    yield made(rows)
                    rows = []
            yield made(rows)

    return documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("text <> ''").mapInArrow(run, _COLUMNS)


def disclosed(pairs: DataFrame) -> DataFrame:
    """``term, places, beside, bits`` from one row per term and place, ``company`` telling where it stands.

    Terms are counted before they are shuffled, so a term that holds a third of all rows is a row per task.
    """
    counts = pairs.groupBy("term").agg(F.count("*").alias("places"), F.sum(F.col("company").cast("bigint")).alias("beside"))
    return counts.withColumn("bits", F.log2((F.col("beside") + 0.25) / (F.col("places") - F.col("beside") + 0.25)))


_PLACE_KEY = ["doc_id", "kind", "start_char", "end_char"]


def _told(places: DataFrame, terms: DataFrame, company) -> DataFrame:
    """Places (``_PLACE_KEY``, ``terms``, ``beside``) with the strongest of what their terms say.

    Adds ``reveals`` and ``public``, true if one of the terms is. Only terms that say something are joined.
    """
    said = terms.filter("reveals or public").select("term", "reveals", "public")
    spread = places.select(*_PLACE_KEY, *company, F.explode_outer("terms").alias("term"))
    told = spread.join(said, "term", "left").groupBy(*_PLACE_KEY, *company)
    return told.agg(F.max(F.coalesce("reveals", F.lit(False))).alias("reveals"), F.max(F.coalesce("public", F.lit(False))).alias("public"), F.collect_list("term").alias("terms"))


def _starts(prefix: str):
    return F.col("term").startswith(prefix)


def name_evidence(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(places, contexts, parts)`` of names: what co-occurrence says of the words before and the parts.

    ``places`` has every possible name once with ``behind`` (beside a sure place, or behind words that
    reveal a name); ``contexts`` and ``parts`` are ``disclosed`` with ``reveals`` and ``public``.
    """
    names = found.filter("kind = 'name'").select(*_PLACE_KEY, "terms", "beside")
    own = ~F.array_contains("terms", ONLY_BEHIND)
    pairs = lambda df, company: df.filter(own).select(F.explode("terms").alias("term"), company.alias("company")).filter(_starts("n:"))
    reveals = (F.col("beside") > 0) & (F.col("bits") >= THRESHOLD_BITS)
    first = disclosed(pairs(names, F.col("beside"))).withColumn("reveals", reveals).withColumn("public", F.lit(False))
    seen = written(_told(names, first, ["beside"]), "names-1")
    behind = seen.select(F.explode("terms").alias("term"), (F.col("beside") | F.col("reveals")).alias("company")).filter(_starts("c:"))
    contexts = disclosed(behind).withColumn("reveals", (F.col("beside") > 0) & (F.col("places") >= CONTEXT_TIMES) & (F.col("bits") >= CONTEXT_BITS)).withColumn("public", F.lit(False))
    placed = _told(seen.drop("reveals", "public"), contexts, ["beside"])
    places = written(placed.select(*_PLACE_KEY, "terms", (F.col("beside") | F.col("reveals")).alias("behind")), "names-2")
    parts = disclosed(pairs(places, F.col("behind"))).withColumn("reveals", reveals).withColumn("public", (F.col("bits") < PUBLIC_BITS) & (F.col("places") >= PUBLIC_TIMES))
    return places, contexts, parts


def label_evidence(found: DataFrame) -> DataFrame:
    """Labels of numbers and words of streets, ``disclosed``, with ``reveals``."""
    others = found.filter("kind in ('phone', 'idnum', 'address')")
    company = F.when(F.col("kind") == "address", F.col("beside")).otherwise(F.col("standing") == SURE)
    counted = disclosed(others.select(F.explode("terms").alias("term"), company.alias("company")))
    limit = F.when(_starts("i:"), LABEL_BITS).when(_starts("p:"), PHONE_BITS).otherwise(STREET_BITS)
    often = F.when(_starts("a"), F.col("places") >= CONTEXT_TIMES).otherwise(True)
    return counted.withColumn("reveals", (F.col("beside") > 0) & (F.col("bits") >= limit) & often)


def decide(found: DataFrame) -> DataFrame:
    """The places that count: ``doc_id, kind, start_char, end_char``, none over another."""
    sure = found.filter(F.col("standing") == SURE).select(*_PLACE_KEY)
    places, _, parts = name_evidence(found)
    own = ~F.array_contains("terms", ONLY_BEHIND)
    names = _told(places, parts, ["behind"]).filter(~F.col("public") & (F.col("behind") | F.col("reveals") & own)).select(*_PLACE_KEY)
    open_ = found.filter((F.col("standing") != SURE) & (F.col("kind") != "name")).select(*_PLACE_KEY, "terms", "beside")
    labels = label_evidence(found).withColumn("public", F.lit(False))
    others = _told(open_, labels, ["beside"]).filter((F.col("kind") != "address") & F.col("beside") | F.col("reveals")).select(*_PLACE_KEY)
    return _apart(sure.unionByName(names).unionByName(others))


def _apart(places: DataFrame) -> DataFrame:
    """Of places that share a character the one whose kind comes first in ``KINDS``, then the earlier, then the longer.

    The places of one document, which its text bounds, meet in one row.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = places.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start_char", (-F.col("end_char")).alias("back")))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, starts, ends = [], [], [], []
            for doc, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                taken, now = _Taken(), 0
                for s in spans:
                    if s["rank"] != now:
                        taken.settle()
                        now = s["rank"]
                    a, b = s["start_char"], -s["back"]
                    if not taken.over(a, b):
                        taken.add(a, b, "")
                        ids.append(doc)
                        kinds.append(KINDS[now - 1])
                        starts.append(a)
                        ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], _PLACE_KEY)

    return spans.mapInArrow(run, "doc_id bigint, kind string, start_char int, end_char int")


def disclosure(found: DataFrame) -> DataFrame:
    """``term, places, beside, bits, reveals, public``: how strongly every term reveals an entity."""
    _, contexts, parts = name_evidence(found)
    labels = label_evidence(found).withColumn("public", F.lit(False))
    return parts.unionByName(contexts).unionByName(labels)


def find_personal(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every place with personal information: ``doc_id, kind, start_char, end_char``.

    Places found twice or overlapping are settled within their document.
    """
    return decide(written(find_candidates(documents, key, text), "personal"))


def redact(documents: DataFrame, places: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text`` with every place replaced by ``<KIND>``; texts without places and null texts unchanged."""
    spans = places.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "kind"))).alias("spans"))
    joined = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(spans, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if value and marks:
                    parts, last = [], 0
                    for s in marks:
                        if s["start_char"] >= last:
                            parts += [value[last : s["start_char"]], f"<{s['kind'].upper()}>"]
                            last = s["end_char"]
                    value = "".join([*parts, value[last:]])
                texts.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    out = joined.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {documents.schema[key].dataType.simpleString()}, text string")
    return out.withColumnRenamed("doc_id", key)
