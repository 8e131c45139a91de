"""Personal data replaced by keyed surrogates of the same type and form."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..operators.relational import numbered
from .common import Scratch, extended, free_name, pick, sealed, small

#: Forms of address and the gender that they tell; fixed values.
FEMALE = (
    "Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Fräulein", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Doña",
    "Госпожа", "Госпожи", "Госпоже", "Госпожу", "Госпожой", "Г-жа", "Г-жи", "Г-же", "Г-жу", "Г-жой", "Пани", "Κυρία", "Κυρίας", "Κα", "Κας", "Δεσποινίς", "Δις",
)
MALE = (
    "Mr", "Mister", "Sir", "Lord", "Herr", "Herrn", "Monsieur", "Señor", "Sr",
    "Господин", "Господина", "Господину", "Господином", "Господине", "Г-н", "Г-на", "Г-ну", "Г-ном", "Г-не", "Пан", "Κύριος", "Κύριο", "Κυρίου", "Κύριε", "Κος", "Κου", "Κον",
)
EITHER = ("Mx", "Dr", "Doctor", "Prof", "Professor", "Товарищ", "Доктор", "Д-р", "Профессор", "Проф", "Δρ", "Καθηγητής", "Καθηγήτρια")
#: Those that are also written in lower case; English ones are common words then.
LOWER = {*FEMALE[FEMALE.index("Madame") :], *MALE[MALE.index("Monsieur") :], *EITHER[EITHER.index("Товарищ") :]}
#: Given names by script and gender with the endings of invented ones, syllables of invented family names, and their endings, which tell the gender and stay; fixed values.
GIVEN = {
    "LATIN": {
        "f": ("Anna", "Clara", "Elena", "Emma", "Ida", "Julia", "Laura", "Lena", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Sofia", "Vera"),
        "m": ("Adam", "Anton", "Bruno", "Carl", "David", "Felix", "Hugo", "Jonas", "Leo", "Marco", "Martin", "Oscar", "Paul", "Peter", "Simon", "Victor"),
    },
    "CYRILLIC": {
        "f": ("Анна", "Вера", "Елена", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "Софья", "Тамара", "Юлия"),
        "m": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Максим", "Олег", "Павел", "Роман", "Фёдор"),
    },
    "GREEK": {
        "f": ("Άννα", "Βάσω", "Ειρήνη", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"),
        "m": ("Αλέξης", "Βασίλης", "Γιάννης", "Γιώργος", "Ηλίας", "Κώστας", "Μάριος", "Νίκος", "Πέτρος", "Στέλιος"),
    },
}
GIVEN_ENDING = {"LATIN": {"f": "na", "m": "no"}, "CYRILLIC": {"f": "на", "m": "ник"}, "GREEK": {"f": "να", "m": "νος"}}
SYLLABLES = {
    "LATIN": ("ba", "be", "bo", "da", "del", "do", "fa", "fen", "ga", "gor", "ha", "hel", "ka", "kel", "la", "len", "lo", "ma", "mer", "mo", "na", "ner", "pa", "pel", "ra", "ron", "sa", "sel", "ta", "ten", "va", "vor"),
    "CYRILLIC": ("ба", "бе", "бо", "ва", "ве", "га", "да", "де", "за", "ка", "ко", "ла", "ле", "ма", "мо", "на"),
    "GREEK": ("βα", "γα", "δα", "ζα", "θε", "κα", "κο", "λα", "λε", "μα", "μο", "να", "πα", "ρα", "σα", "τα"),
}
ENDING = re.compile(r"(?<=..)(?:(?:[оеё]в|[иы]н)(?:а|ой|у|ым|е)?|[сц]к(?:ий|ая|ого|ой|ому|ую|им|ом)|όπουλος|όπουλο|οπούλου|ίδης|ίδη|ίδου|άκης|άκη|[οηα]ς|ου)$")
#: Rounds in which surrogates are drawn, and after how many of them a form that may grow gets a character more.
ROUNDS, GROWS = 24, 4
GENDER = {form: g for g, forms in (("f", FEMALE), ("m", MALE), ("x", EITHER)) for f in forms for form in (f, f.upper(), *([f.lower()] if f in LOWER else ()))}
ADDRESS = "|".join(sorted(map(re.escape, GENDER), key=len, reverse=True))
#: Small words inside names, which stay; and words that begin sentences: no names unless a capital follows.
PARTICLE = "de|del|della|der|den|di|da|das|do|dos|du|des|la|las|le|los|van|von|vom|zu|zum|zur|ten|ter|bin|ibn|al|el|af|av|y"
OPENING = (
    "The|Then|This|That|There|He|She|It|They|We|You|I|And|But|In|On|At|As|If|When|Who|What|After|For|So|A|An|Der|Die|Das|Dann|Er|Sie|Es|Wir|Ich|Und|Aber|Im|Am|Ein|Eine|Als|Wer|"
    "Il|Elle|Ils|On|Nous|Je|Le|La|Les|Un|Une|Et|Mais|Puis|Ce|Dans|Él|Ella|El|Los|Las|Una|Y|Pero|En|Es|Он|Она|Они|Мы|Я|И|Но|А|В|На|Это|Αυτός|Αυτή|Ο|Η|Το|Και"
)


def _letters(fits) -> str:
    """A pattern for one letter that fits, with the marks that combine with it."""
    return "[" + "".join(c for c in map(chr, range(0x10000)) if c.isalpha() and fits(c)) + "][̀-ͯ]*"


def _person_pattern() -> str:
    capital, plain = _letters(lambda c: c.isupper() or c.istitle()), _letters(lambda c: c.lower() == c.upper())
    letter, mark, gap = "(?:[^\\W\\d_][̀-ͯ]*)", "['’ʼ‐‑-]", r"(?=\s)[^\S\n]*\n?[^\S\n]*"
    tail = rf"(?:{mark}{capital}{letter}*)*(?!{letter})"
    word = rf"(?:(?:[dDlL]['’])?{capital}(?:['’ʼ]{letter}{{2,}}|{letter}+|{mark}{capital}{letter}+){tail})"
    initial = rf"{capital}(?:\.[‐‑-]?|(?={gap}{capital}))"
    no = rf"(?!(?:{ADDRESS})(?:\.|{gap}{capital}))(?!(?:{OPENING})(?![^\W_])(?!\.|{gap}{capital}))"
    step = rf"{no}(?:{word}|{initial})"
    small = rf"(?:(?:{PARTICLE}){gap})*"
    title = rf"(?:{ADDRESS})(?:\.(?:{gap})?|{gap})"
    return rf"(?<![^\W_])(?P<address>(?:{title})+|M\.{gap})(?P<person>{small}{step}(?:(?:{gap}|(?<=[.‐‑-])){small}{step})*|{plain}{letter}*(?:{gap}{plain}{letter}*){{0,2}})"


PERSON = re.compile(_person_pattern())
#: Without a match there is no person.
ADDRESSED = re.compile(rf"[{''.join(sorted({f[0] for f in GENDER}))}](?<![^\W_].)(?:{'|'.join(sorted({re.escape(f[1:]) for f in GENDER} | {''}, key=len, reverse=True))})[.\s]")
NAME = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f'’ʼ])*")
SMALL = frozenset(PARTICLE.split("|"))
OPENS = frozenset(OPENING.split("|"))

#: Types in order of precedence where matches begin at the same place.
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----",
    "email": r"(?<![\w.%+-])[\w.%+-]+@(?:[^\W_](?:[^\W_]|-)*\.)+[^\W\d_]{2,}\b",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b(?:ghp|gho|ghs)_[A-Za-z0-9]{20,}\b|\bsk-[A-Za-z0-9_-]{16,}",
    "secret": r"(?i:(?:password|passwd|passphrase|pwd|secret|token|(?:api|access|private|secret|account|auth)[_-]?key)s?\\?[\"']?[^\S\n]*\n?[^\S\n]*(?:=>|:?=|:)[^\S\n]*\n?[^\S\n]*)"
    r"(?:\\?[\"'](?=[^\"'\n]*[^\W_])(?P<quoted>[^\"'\n\\]{6,})(?=\\?[\"'])|\\?[\"']?(?=[^\s\"',;]*[^\W_])(?P<secret>(?:[^\s\"',;\\]|\\[^\s\"']){6,}))",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b",
    "card": r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ipv4": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,35}::|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f])(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)",
    "phone": r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w])|(?<![\w.])\+\d{8,14}(?!\w)"
    r"|(?<![\w.+])(?:\+|00)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\d(?:[ .-]\d\d){4}|\d{3}(?:[ .-]\d\d){3})(?!\w)"
    r"|(?<![\w.+])(?:\+|00)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\(?\d{1,4}\)?(?:[ ./-]?\d{2,4}){2,5}(?!\w)"
    r"|(?<![\w.+])(?:(?:0\d|\(0\d\))(?:[ .-]\d\d){4}|[6-9]\d\d(?:[ .-]\d\d){3})(?!\w)|(?<![\w.+])0\d{1,4} ?/ ?\d{3,8}(?:[ -]?\d{2,4})?(?!\w)|(?<![\w.+-])(?:0[1-9]\d{8,10}|[67]\d{8})(?![\w-]|\.\d)",
}
FIND = re.compile("|".join(f"(?P<is_{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
PHONE = re.compile(PATTERNS["phone"])
#: Without one of these no pattern matches.
HINT = re.compile(rf"[@\d]|BEGIN|AKIA|ASIA|gh[pos]_|sk-|(?i:pass|pwd|secret|token|key)")
SPAN = "array<struct<start: int, end: int, kind: string, value: string>>"


def ascii_digits(text: str) -> str:
    """Decimal digits of all scripts as 0 to 9."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def luhn(digits: str) -> bool:
    """Whether the digits' check sum is right."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _is_card(text: str) -> bool:
    """Whether it has the check sum and the first digit of a payment card's number."""
    digits = normal("card", text)
    return digits[0] in "23456" and luhn(digits)


def _is_ipv6(text: str) -> bool:
    """Whether it is an address with five hexadecimal digits at least (not ::1)."""
    try:
        return ipaddress.IPv6Address(text) is not None and len(text.replace(":", "")) > 4
    except ValueError:
        return False


def normal(kind: str, found: str) -> str:
    """One form for all spellings of an entity, so that each gets the same surrogate."""
    if kind == "email":
        return found.lower()
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(found))
    if kind == "ipv4":
        return ascii_digits(found)
    if kind in ("card", "phone", "ssn", "iban"):
        return re.sub(r"[^0-9A-Za-z+]", "", ascii_digits(found))
    return found


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities of a text, from left to right; a person's kind tells the gender."""
    if not text:
        return []
    spans = []
    for m in FIND.finditer(text) if HINT.search(text) else ():
        kind = next(k for k in PATTERNS if m.group(f"is_{k}") is not None)
        if kind == "card" and not _is_card(m.group()):  # a plain number, or a long phone number
            kind, m = "phone", PHONE.match(text, m.start())
            if m is None:
                continue
        group = 0 if kind != "secret" else kind if m[kind] is not None else "quoted"
        if kind == "phone" and not 9 <= sum(c.isdecimal() for c in m.group()) <= 15:
            continue
        if kind == "ipv6" and not _is_ipv6(m.group()) or kind == "ipv4" and not all(int(x) < 256 for x in m.group().split(".")):
            continue
        spans.append((m.start(group), m.end(group), kind, normal(kind, m.group(group))))
    return sorted(spans + _persons(text, spans)) if ADDRESSED.search(text) else spans


def _persons(text: str, spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Names after forms of address, then all other mentions of the same names in the text; none inside `spans`."""
    taken = bytearray(len(text))
    for start, end, *_ in spans:
        taken[start:end] = b"\1" * (end - start)
    named, names, letters = [], set(), set()
    for m in PERSON.finditer(text):
        if any(taken[m.start("person") : m.end("person")]):
            continue
        told = [GENDER[a] for a in re.findall(ADDRESS, m["address"])] or ["m"]
        named.append((*m.span("person"), f"person_{next((g for g in told if g != 'x'), 'x')}", m["person"]))
        taken[m.start("person") : m.end("person")] = b"\1" * len(m["person"])
        for word in NAME.findall(m["person"]):
            letters.add(word[0])
            if len(word) > 1 and word not in SMALL and word not in OPENS:
                names |= {word, word.upper(), word.title() if word.isupper() else word}
    if names:
        some = "|".join(sorted(map(re.escape, names), key=len, reverse=True))
        some = rf"(?:{some})(?=(?:['’]?[sS])?(?![^\W_]))"
        first = "".join(map(re.escape, sorted(letters)))
        for m in re.finditer(rf"(?<![^\W_])(?:[{first}]\.\s?)*{some}(?:[\s‐‑-]{some})*", text):
            if not any(taken[m.start() : m.end()]):
                named.append((*m.span(), "person_n", m.group()))
    return named


def named(word: str) -> str:
    """One form for a name's spellings in capitals, with other apostrophes and by combining marks."""
    return re.sub(r"(?:(?<=^)|(?<='))\w", lambda m: m.group().upper(), re.sub("[’ʼ]", "'", unicodedata.normalize("NFC", word)).lower())


def parts(spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Persons split into names, so that each name of a text has one surrogate, alone or with others; other spans as given.

    Kinds are person_f, person_m and person_x for given names by gender, person_n for family names, and
    initial for single letters; those that stand for a known given name have its kind and value.
    """
    split, roles, full = [], {}, []
    for start, _, kind, value in (s for s in spans if s[2].startswith("person")):
        words = [(start + m.start(), start + m.end(), named(m.group())) for m in NAME.finditer(value) if m.group() not in SMALL]
        long = [w for w in words if len(w[2]) > 1]
        given = []
        if kind != "person_n" and len(long) > 1 and script(long[0][2][0]) in SYLLABLES:
            given = [long[0]]  # and what a hyphen joins to it
            for w in long[1:]:
                if w[0] != given[-1][1] + 1 or value[given[-1][1] - start] not in "‐‑-":
                    break
                given.append(w)
            if len(given) == len(long):  # a family name of two
                given = []
        for w in given:
            if roles.get(w[2], "person_x") == "person_x":
                roles[w[2]] = kind
        full.append(({w[2] for w in long}, [w[2] for w in given]))
        split.append((kind, words, {w[2] for w in given}))
    out = [s for s in spans if not s[2].startswith("person")]
    for kind, words, given in split:
        own = {w[2] for w in words if len(w[2]) > 1}
        for start, end, word in words:
            if len(word) == 1 and word != word.lower():
                meant = next((g for others, first in full if own & others for g in first if g[0] == word), None)
                out.append((start, end, roles[meant], meant) if meant else (start, end, "initial", word))
            elif word in given and kind in ("person_f", "person_m"):
                out.append((start, end, kind, word))
            else:
                out.append((start, end, roles.get(word, "person_n"), word))
    return sorted(out)


def script(c: str) -> str:
    """The first word of a character's name, which tells the script of a letter."""
    return unicodedata.name(c, "").split(" ")[0]


POOLS: dict[tuple, list[str]] = {}


def pool(c: str) -> list[str]:
    """The letters of the same script and case as this one in its 256 code points; of ASCII letters the ASCII ones."""
    key = (ord(c) >> 8, c.isascii(), c.isupper(), script(c))
    if key not in POOLS:
        near = map(chr, range(key[0] << 8, (key[0] + 1) << 8))
        POOLS[key] = [x for x in near if x.isalpha() and (x.isascii(), x.isupper(), script(x)) == key[1:]]
    return POOLS[key]


class Stream:
    """Numbers that follow from key, entity and attempt alone."""

    def __init__(self, key: bytes, *parts: str):
        self.seed, self.pool, self.turn = hashlib.blake2b("\0".join(parts).encode(), key=key).digest(), b"", 0

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.blake2b(self.seed + self.turn.to_bytes(4, "big")).digest()
            self.turn += 1
        x, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return x % n

    def like(self, text: str) -> str:
        """A text of the same form: letters for letters of the same script and case, digits for digits, hex stays hex, all else kept."""
        hexadecimal = re.fullmatch(r"[0-9a-f]{8,}", text) is not None and not text.isdecimal()
        out = []
        for c in text:
            if hexadecimal:
                out.append("0123456789abcdef"[self.below(16)])
            elif c.isdecimal():
                out.append(chr(ord(c) - unicodedata.decimal(c) + self.below(10)))
            elif c.isalpha():
                letters = pool(c)
                out.append(letters[self.below(len(letters))])
            else:
                out.append(c)
        return "".join(out)


def _person(stream: Stream, kind: str, value: str, more: int, first: bool) -> str:
    """A name, with `more` syllables or letters than its first surrogate. Scripts without syllables get letters of the same script."""
    own = next((x for x in SYLLABLES if x == script(value[0])), None)
    if own is None:
        return stream.like(value + value[-1] * more)
    invented = lambda n: "".join(SYLLABLES[own][stream.below(len(SYLLABLES[own]))] for _ in range(n)).capitalize()
    head, mark, _ = value.rpartition("'")
    if kind == "person_n":
        ending = ENDING.search(value)
        return ("".join(chr(ord("A") + stream.below(26)) for _ in head[:1]) + mark if head else "") + (invented(3 + more) + ending.group() if ending else invented(4 + more))
    gender = kind[-1] if kind[-1] in "fm" else "fm"[stream.below(2)]
    names = GIVEN[own][gender]
    return names[stream.below(len(names))] if first else invented(2 + more) + GIVEN_ENDING[own][gender]


def _initial(key: bytes, letter: str) -> str:
    """Another letter of the alphabet, for each letter its own: the next in an order that follows from the key."""
    low, high = next(((a, z) for a, z in ("AZ", "АЯ", "ΑΩ") if a <= letter <= z), ("A", "Z"))
    order = [chr(n) for n in range(ord(low), ord(high) + 1) if chr(n).isalpha()]
    order.sort(key=lambda c: Stream(key, "initial", c).below(2**63))
    return order[(order.index(letter) + 1) % len(order)] if letter in order else order[Stream(key, "initial", letter).below(len(order))]


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement of an entity's normal form, itself in normal form; another with each attempt, and a longer one
    with every GROWS of them where the type allows it (card, social security and bank numbers, IPv4 addresses and private keys have their length)."""
    stream, more = Stream(key, kind, value, str(attempt)), attempt // GROWS
    if kind.startswith("person"):
        return _person(stream, kind, value, more, attempt < GROWS)
    if kind == "initial":
        return _initial(key, value)
    if kind == "email":
        name, _, host = value.partition("@")
        *own, top = host.split(".")
        site = Stream(key, "host", host)  # the same for all addresses at it
        return f"{stream.like(name + 'a' * more)}@{'.'.join([*map(site.like, own), top])}"
    if kind == "ipv4":
        return ".".join(str(1 + stream.below(254)) for _ in range(4))
    if kind == "ipv6":
        digits = "0123456789abcdef"
        return re.sub("[0-9a-f]+", lambda m: digits[1 + stream.below(15)] + "".join(digits[stream.below(16)] for _ in range(min(3, len(m.group()) - 1 + more))), value)
    if kind == "phone":
        kept = 2 if value.startswith("+") else 1 if value[0] in "067" else 0
        return value[:kept] + stream.like(value[kept:] + "0" * min(more, 15 - len(value.lstrip("+"))))
    if kind == "access_key":
        head = re.match(r"AKIA|ASIA|gh[pos]_|sk-|", value).group()
        return head + stream.like(value[len(head) :])
    if kind == "private_key":
        return re.sub(r"(?<=-----\n)[\s\S]+(?=-----END)|(?<=KEY-----)[A-Za-z0-9+/=\s]+", lambda m: stream.like(m.group()), value, count=1)
    if kind == "card":
        body = value[0] + stream.like(value[1:-1])
        last = next(d for d in "0123456789" if luhn(body + d))
        return body + (last if luhn(value) else str((int(last) + 1 + stream.below(9)) % 10))
    if kind == "iban":
        return value[:2] + stream.like(value[2:])
    return stream.like(value + ("a" * more if kind == "secret" else ""))


def _scripted(digits: str, like: str) -> str:
    """The digits in the script of a digit."""
    return "".join(chr(ord(like) - unicodedata.decimal(like) + int(d)) if d.isdecimal() else d for d in digits)


def dressed(kind: str, found: str, new: str) -> str:
    """A surrogate in the form of the spelling that it replaces: separators, scripts of digits, capitals of e-mail addresses and names, initials."""
    if kind.startswith("person"):
        return new[0] if len(found) == 1 and found.isupper() else new.upper() if found.isupper() and found.lower() != found else new
    if kind in ("card", "phone", "ssn", "iban"):
        marks = iter(new)
        digit = next((c for c in reversed(found) if c.isdecimal()), "0")
        out = [c if not (c.isdecimal() or re.match(r"[0-9A-Za-z+]", c)) else _scripted(m, c) if c.isdecimal() and (m := next(marks, "")) else next(marks, "") for c in found]
        return "".join(out) + _scripted("".join(marks), digit)
    if kind == "ipv4":
        return _scripted(new, next(c for c in found if c.isdecimal()))
    if kind == "ipv6":
        return new.upper() if found == found.upper() else new
    if kind == "email" and len(new) >= len(found):
        name, at = found.index("@"), len(new) - len(found) + found.index("@")
        head = "".join(n.upper() if c.isupper() else n for c, n in zip(found[:name], new, strict=False)) + new[name:at]
        return head + "".join(n.upper() if c.isupper() else n for c, n in zip(found[name:], new[at:], strict=True))
    return new


def _detected(batches):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
    for batch in batches:
        spans = [detect(text) for text in batch.column("text").to_pylist()]
        rows = [[dict(zip(("start", "end", "kind", "value"), s, strict=True)) for s in parts(own)] if own else None for own in spans]
        yield batch.append_column("n_spans", pa.array(map(len, spans), pa.int32())).append_column("spans", pa.array(rows, kind))


def _invented(key: bytes, attempt: int):
    def run(batches):
        for batch in batches:
            rows = zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("value"), pa.array([surrogate(key, *r, attempt) for r in rows], pa.string())], ["kind", "value", "surrogate"])

    return run


def _replaced(batches):
    for batch in batches:
        texts = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
            parts, at = [], 0
            for s in sorted(found, key=lambda s: s["start"]):
                parts += [text[at : s["start"]], dressed(s["kind"], text[s["start"] : s["end"]], s["surrogate"])]
                at = s["end"]
            texts.append("".join(parts) + text[at:])
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns(["found"])


DRAWN = "kind string, value string, surrogate string"


def surrogates(entities: DataFrame, key: bytes, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value), no two of a type with one surrogate, and none that is an entity's own value.

    In each round those without one draw it, by key, kind, value and round alone. A surrogate is taken if it is no value in the documents, no
    other entity of the type has it, and of those that draw it now this is the smallest; what is taken stays, so
    that rounds soon deal with few entities. Forms that the corpus fills grow (`surrogate`). Where a type's form cannot grow and `rounds` are over,
    the entities left stand in an order by key and each gets the value of the next, so that nothing ever fails.
    """
    type_of = F.substring_index("kind", "_", 1).alias("type")
    entities = scratch.keep(entities.select("kind", "value"))
    values = entities.select(F.col("value").alias("surrogate")).distinct()
    pending, settled, drawn = entities, [], None
    for attempt in range(rounds):
        drawn = scratch.keep(pending.mapInArrow(_invented(key, attempt), DRAWN).withColumn("type", type_of))
        first = drawn.groupBy("type", "surrogate").agg(F.min(F.struct("kind", "value")).alias("first"))
        taken = first.join(values, "surrogate", "left_anti")
        for before in settled:
            taken = taken.join(before, ["type", "surrogate"], "left_anti")
        settled.append(scratch.keep(taken.select("type", "surrogate", "first.kind", "first.value")))
        pending = drawn.join(settled[-1], ["kind", "value"], "left_anti").select("kind", "value")
        if pending.isEmpty():
            break
    else:
        drawn = drawn.join(settled[-1], ["kind", "value"], "left_anti") if settled else entities.mapInArrow(_invented(key, 0), DRAWN).withColumn("type", type_of)
        settled.append(_passed_on(drawn, settled))
    out = settled[0].select("kind", "value", "surrogate")
    for more in settled[1:]:
        out = out.union(more.select("kind", "value", "surrogate"))
    return out


def _passed_on(left: DataFrame, settled: list[DataFrame]) -> DataFrame:
    """Each entity left gets the value of the next in the order of the last draw; one with a surrogate stands among them, lest one be alone."""
    ring = left.withColumn("left", F.lit(True))
    if settled:
        other = settled[0].groupBy("type").agg(F.min(F.struct("surrogate", "kind", "value")).alias("o")).select("o.kind", "o.value", "o.surrogate", "type", F.lit(False).alias("left"))
        ring = ring.unionByName(other)
    ring = numbered(ring, [("type", False), ("surrogate", False), ("kind", False), ("value", False)])
    ends = ring.groupBy("type").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    after = ring.join(F.broadcast(ends), "type").withColumn("next", F.when(F.col("pos") == F.col("last"), F.col("first")).otherwise(F.col("pos") + 1)).filter("left")
    given = after.join(ring.select(F.col("pos").alias("next"), F.col("value").alias("given")), "next")
    # Of a type's only entity, whose form has no other value, a longer one.
    return given.select("type", F.when(F.col("given") == F.col("value"), F.concat("value", F.lit("0"))).otherwise(F.col("given")).alias("surrogate"), "kind", "value")


def replace_private(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents with surrogates for personal data in text, and n_entities behind; columns otherwise as given.

    Found are e-mail addresses, phone numbers, card numbers (with their check sum), IBANs, social security numbers, IP addresses, access keys,
    passwords and tokens, private keys, and names after a form of address, which tells the gender, with all other mentions
    of these names in the same text. An entity has the same surrogate wherever it stands, in all spellings that differ by
    separators or (in e-mail) case; two entities never share one. Of persons each name is an entity, so that
    forms of address, given names and initials may come and go; a given name's surrogate has the gender told, in this text or
    another. Surrogates keep type, length (but of names), separators, case, script and check sums.

    Entities are found once in whole texts, and the documents written with them. Distinct ones get their surrogates (`surrogates`), which go
    back by a join on the entity; only documents that hold any are shuffled, the others pass as they are.

    Digits of all scripts count. Null and empty texts pass unchanged with 0 entities. Repeated rows are changed alike. If there is a column n_entities
    already, the new one is n_entities_2. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    plain, names, new = sealed(docs)
    rows = plain.withColumnRenamed(new["text"], "text")
    columns = [("text" if c == new["text"] else c) for c in names]
    found = rows.mapInArrow(_detected, extended(rows, "n_spans", "int").add("spans", DataType.fromDDL(SPAN)))
    found = scratch.keep(found.withColumn("row", F.monotonically_increasing_id()))
    spans = found.filter("n_spans > 0").select("row", F.inline("spans"))
    # A given name whose gender is told elsewhere only has that.
    told = spans.filter("kind IN ('person_f', 'person_m')").groupBy("value").agg(F.min("kind").alias("told")).withColumn("kind", F.lit("person_x"))
    told = scratch.keep(told)
    spans = scratch.keep(spans.join(small(told), ["kind", "value"], "left").withColumn("kind", F.coalesce("told", "kind")).drop("told"))
    scratch.drop(told)
    entities = scratch.keep(spans.select("kind", "value").distinct())
    initials = entities.filter("kind = 'initial'").mapInArrow(_invented(key, 0), DRAWN)
    own = Scratch(docs.sparkSession)
    drawn = scratch.keep(surrogates(entities.filter("kind <> 'initial'"), key, own).union(initials))
    own.clear()
    drawn = small(drawn)
    told = spans.join(drawn, ["kind", "value"]).groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind", "surrogate")).alias("found"))
    held = found.filter("n_spans > 0").join(told, "row").withColumn("n_entities", F.col("n_spans")).select(*columns, "n_entities", "found")
    changed = held.mapInArrow(_replaced, held.drop("found").schema)
    same = found.filter("n_spans = 0").select(*columns, F.lit(0).alias("n_entities"))
    return changed.union(same).toDF(*docs.columns, free_name("n_entities", docs.columns))


def private_texts(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, n_entities, text) after `replace_private`, for each document row."""
    return replace_private(pick(docs, doc_id="doc_id", text="text"), key).select("doc_id", "n_entities", "text")
