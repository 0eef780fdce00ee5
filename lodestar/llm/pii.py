"""Personal data and secrets replaced by keyed, type-consistent surrogates.

Detection finds e-mail addresses, phone, card, bank and social security numbers, IP addresses,
access keys and passwords, and names of persons after a title, after words like "my name is" or with a
known given name. A name found in a document is then replaced wherever the document has it as a
capitalised word by itself (names in ideographs: anywhere).

A surrogate is made by a keyed permutation of the values of the same kind and format (a Feistel
network over their number, walked until it stays among them, conjugated with a step by one so that
nothing maps to itself). So it has the same length, separators and classes of characters: every
letter and digit, whatever its script, stands for one of the same script and case (``alphabet``), and
only marks and signs stay. Check digits are made anew; a given name becomes one of the same gender
and script; a name keeps its script, vowels and consonants; upper and lower case stay. A draw that
holds the original, or two letters in a row of a short one at their places, is made again. Mentions
are brought to one canonical form first (digits of a number, lower case of an address), so one entity
gets one surrogate in all its spellings and in all documents, with no table of entities. A word of an
address has the surrogate that it would have as a name, unless one of the two had to be drawn again.

The key is the session's ``spark.lodestar.pii.secret``. Where that is unset, a random key is made that
only this application ever has: nobody can undo its surrogates, and another run gives other ones.

Within a format the permutation keeps entities apart. The collision check does the rest, in Spark:
over the distinct entities of the corpus, names and domains of addresses included, a surrogate that is
also a real entity, or that another entity has, is drawn again with another number of attempts, until
none is left; after ``SAME_FORMAT`` attempts the format gets longer, so that this ends (a given name
that is taken becomes a double name at once). Only those entities (few, as formats have many more
values than entities) form a table; it goes along as a broadcast below ``MOST_SENT`` entities and by a
join per document beyond. Otherwise each text is just scanned.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._common import Workspace, doc_key, read, runs, schema, texts

KEY = "spark.lodestar.pii.secret"
SAME_FORMAT = 8
DRAWS = 32
SHORT = 64
PIECE = 200
MOST_SENT = 50_000

DIGITS, HEX = "0123456789", "0123456789abcdef"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = "!#$%&*+-./:=?@^_~"
_LETTERS = [
    DIGITS, LOWER, UPPER, "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
]
_SOUNDS = ["aeiouy", "bcdfghjklmnpqrstvwxz", "αεηιουω", "βγδζθκλμνξπρστφχψ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ", "çñß", "ήίόύώάέ"]
#: Given names by gender and script (fixed values).
GIVEN = {
    ("f", "latin"): "Alice Amelia Andrea Anna Barbara Camille Carla Carmen Charlotte Claire Clara Elena Elisabeth Emily Emma Eva Grace Hannah Helen Ines Isabel Jane Julia Karin Laura Lena Linda Lucia Maria Marie Martha Mary Monika Nina Nora Olivia Patricia Paula Petra Rosa Ruth Sarah Sofia Sophie Susan Teresa Ursula Vera".split(),
    ("m", "latin"): "Adam Alan Albert Alexander Andrew Anton Arthur Bernd Carlos Charles Christian Daniel David Diego Edward Erik Felix Francisco Frank Friedrich Georg George Hans Henry Hugo Jacques James Javier Jean John Jorge Joseph Juan Karl Klaus Louis Luis Manuel Mark Martin Michael Miguel Paul Peter Philippe Pierre Robert Thomas".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
    ("f", "greek"): "Άννα Βασιλική Γεωργία Ελένη Ειρήνη Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("m", "greek"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Παναγιώτης Σπύρος Χρήστος".split(),
}
#: Titles by gender; "" where they do not tell (fixed values).
TITLES = {"m": "Mr Herr Monsieur Señor Signor господин Κύριος".split(), "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Signora госпожа Κυρία".split(), "": "Dr Prof Professor Doctor Doktor".split()}
#: Domains that name no person or firm (fixed values).
SHARED = frozenset("gmail.com googlemail.com outlook.com hotmail.com live.com yahoo.com icloud.com aol.com gmx.de gmx.net web.de orange.fr free.fr mail.ru yandex.ru proton.me protonmail.com example.com example.org example.net".split())

#: Scripts of very many letters: (first, last); other letters belong to blocks of 128 (fixed values).
_WIDE = [(0x3041, 0x3096), (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x2A6DF)]


def _ranges(kinds: str) -> str:
    """The characters of the first plane with some categories, as ranges of a character class."""
    wanted = frozenset(kinds.split())
    inside = [unicodedata.category(chr(k)) in wanted for k in range(0x10000)]
    edges = [k for k in range(1, 0x10001) if (k < 0x10000 and inside[k]) != inside[k - 1]]
    return "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in zip(edges[::2], edges[1::2], strict=True))


#: Digits of other scripts begin with none of these bytes.
_NO_DIGITS = bytes(range(0xD9))
_ASCII_RUNS = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))
#: The first run of ASCII letters of each title and given name that has one.
_TITLE_RUNS, _GIVEN_RUNS = (frozenset(x for n in names if (x := (re.match("[A-Za-z]*", n)[0]).encode())) for names in ([t for x in TITLES.values() for t in x], [n for x in GIVEN.values() for n in x]))
_LOCAL_WORDS = re.compile(r"(?<![^\W_])[^\W\d_]{3,}(?![^\W_])")
_SAYS = ("y name is", "ein name ist", "ch heiße", "e m'appelle", "e m’appelle", "e llamo", "i nombre es")
_GENDER = {n: key for key, names in GIVEN.items() for n in names}
_GIVEN_LOWER = frozenset(n.lower() for n in _GENDER)
_LETTER = _ranges("Lu Ll Lt Lm Lo Mn Mc") + "\U00010000-\U0001efff\U00020000-\U0003ffff"
#: Up to four ideographs or Korean syllables, or a word that does not begin with a small letter.
_FIRST = _ranges("Lu Lt Lo")
_CAP = rf"(?:[\u3400-\u9fff\uac00-\ud7a3]{{1,4}}|[{_FIRST}](?:['’][{_FIRST}])?[{_LETTER}]+(?:['’-][{_LETTER}]+)*)"
#: Initials and particles before a name (fixed values).
_LINK = rf"(?:[{_FIRST}]\.[  ]?|(?:van|von|de|der|den|del|della|di|da|dos|du|la|le|bin|ibn|al|zu|ter)[  ]){{0,3}}"
_EMAIL = re.compile(r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@(?:[^\W_](?:(?:[^\W_]|-)*[^\W_])?\.)+(?:xn--[a-z0-9-]+|[A-Za-z]{2,}(?![A-Za-z0-9_-])|[^\W\d_]{2,}(?![\w-]))")
_IP4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])")
#: Eight groups, or fewer and a double colon; ipaddress tells which of them are addresses.
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:)|(?<=:):){2,8}(?:[0-9A-Fa-f]{1,4})?(?!\w|:[0-9A-Fa-f:]|\.[0-9])")
#: Complete numbers of the ten-digit plan end there; others take the groups that follow.
_PLAN = r"\+1[ .-]?(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[1-9][0-9]{0,2}[ .-]?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
_ABROAD = r"(?:\+|(?<![0-9])00)[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[ .-]?[0-9]{2,5})"
_PHONE = re.compile(rf"(?<![\w+.-])(?:{_PLAN}|{_ABROAD}{{1,4}}|\([2-9][0-9]{{2}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}|[2-9][0-9]{{2}}([ .-])[0-9]{{3}}\1[0-9]{{4}})(?!\w|[.-][0-9])")
#: The same with fewer groups, for a match with too many digits.
_SHORTER = [re.compile(rf"(?:{_PLAN})(?!\w)"), *(re.compile(rf"{_ABROAD}{{1,{k}}}(?!\w)") for k in (3, 2, 1))]
#: Numbers of no plan that is known here, after a word that tells what they are.
_CUED = re.compile(r"(?i)(?<!\w)(?:tel(?:efon|ephone|efono|éfono)?|téléphone|tél|phone|fon|fax|mobile?|móvil|handy|cell|portable|call|ring)\.?(?: (?:no|nr|number|at|us at|me at))?\.?:? {0,2}(\(?[0-9][0-9 ()./-]{5,20}[0-9])(?![\w-]|[.,][0-9])")
_CARD = re.compile(r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){2}(?:\1[0-9]{1,3})?|3[47][0-9]{2}([ -])[0-9]{6}\2[0-9]{5})(?![\w-]|\.[0-9])")
#: The issuers' numbers and lengths; the group is what names the issuer (fixed values).
_ISSUER = re.compile(r"(4)(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(5[1-5])[0-9]{14}|(222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|(3[47])[0-9]{13}|(6011|64[4-9]|65|62)[0-9]{12,17}|(352[89]|35[3-8][0-9])[0-9]{12,15}|(30[0-5]|36|38)[0-9]{11,12}|(5018|5020|5038|5893|6304|6759|676[1-3])[0-9]{9,15}")
_SSN = re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_AWS = re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)")
_MARK = re.compile(r"(?:gh[pousr]_|sk-|xox[abprs]-|AIza|glpat-)?")
_MARKED = re.compile(r"(?<!\w)(?:gh[pousr]_|sk-|xox[abprs]-|AIza|glpat-)[A-Za-z0-9_-]{16,}")
_SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|passwort|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*(?:\"([^\"\n]{4,}+)\"|'([^'\n]{4,}+)'|[\"']?([^\s\"',;]{4,}+))")
_TITLED = re.compile(rf"(?<!\w)({'|'.join(t for x in TITLES.values() for t in x)})\.?[  ]{_LINK}({_CAP})(?:[  ]{_LINK}({_CAP}))?")
_SAID = re.compile(rf"(?<!\w)(?:[Mm]y name is|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es)[  ]{_LINK}({_CAP})(?:[  ]{_LINK}({_CAP}))?")
_GIVEN = re.compile(rf"(?<!\w)({'|'.join(_GENDER)})[  ]{_LINK}({_CAP})")
_WORDS = re.compile(rf"(?<!\w){_CAP}(?!\w)")
_PART = re.compile(r"[^'’-]+")
_IDEOGRAPHS = re.compile(r"[\u3400-\u9fff\uac00-\ud7a3]{2,4}\Z")
_POSSESSIVE = re.compile(r"['’][sS]\Z")
#: Words that are no name where they stand by themselves, though one was taken for a name after a given name or title.
_NO_NAMES = frozenset("a an and are as at but by for from he her his i in is it its my no not of on or our she that the their they this to was we who will with you am auf aus das dem den der die du ein eine er es für ich ihr im ist mit nicht sie und uns von war wir zu au aux ce de des du elle en est et il ils je la le les mais nous ou par pas pour que qui son sur un une vous al con del el ella es la las lo los no por que se si su un una y yo в и к на не но он она они с что я η και ο οι στο τα την της το του".split()) | {t.lower() for x in TITLES.values() for t in x}
_TITLE_GENDER = {t: g for g, x in TITLES.items() for t in x}


class Permutations:
    """Keyed permutations of 0 .. n - 1 without a fixed point."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _walk(self, x: int, n: int, label: bytes, back: bool) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, size = (1 << half) - 1, (half + 7) // 8
        while True:
            a, b = x >> half, x & mask
            for r in range(9, -1, -1) if back else range(10):
                if back:
                    a, b = b ^ self._round(label, r, a, size) & mask, a
                else:
                    a, b = b, a ^ self._round(label, r, b, size) & mask
            x = a << half | b
            if x < n:
                return x

    def _round(self, label: bytes, r: int, value: int, size: int) -> int:
        out, k = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(b"%d|%d|" % (r, k) + label + value.to_bytes(size, "big"), key=self.key).digest()
            k += 1
        return int.from_bytes(out[:size], "big")

    def __call__(self, x: int, n: int, label: str) -> int:
        if n < 2:
            return x
        tag = label.encode()
        return self._walk((self._walk(x, n, tag, False) + 1) % n, n, tag, True)


@lru_cache(None)
def alphabet(c: str) -> str:
    """The characters that may stand for a letter or digit: those of its script and case; empty for marks, signs and spaces.

    Small and capital letters that do not turn into each other and back are left out; such a one (as
    the dotless i) itself goes by an alphabet it is not in.
    """
    for a in _LETTERS:
        if c in a:
            return a
    kind = lambda x: {"Lt": "Lu", "Lm": "Lo", "Nl": "No"}.get(k := unicodedata.category(x), k)
    own, word = kind(c), unicodedata.name(c, "").split(" ")[0]
    if own[0] not in "LN":
        return ""
    low, high = next(((a, b) for a, b in _WIDE if a <= ord(c) <= b), (ord(c) & ~127, ord(c) | 127))
    steady = lambda x: own not in ("Lu", "Ll") or len(x.swapcase()) == 1 and x.swapcase().swapcase() == x != x.swapcase()
    found = "".join(x for x in map(chr, range(low, high + 1)) if kind(x) == own and unicodedata.name(x, "").split(" ")[0] == word and steady(x)) if own != "No" else ""
    return found if len(found) > 1 else UPPER if own == "Lu" else DIGITS if own[0] == "N" else LOWER


@lru_cache(None)
def sounds(c: str) -> str:
    """Of a small letter's alphabet the vowels for a vowel, the others for another one."""
    for a in _SOUNDS:
        if c in a:
            return a
    vowel = lambda x: unicodedata.normalize("NFD", x)[0] in "aeiouyαεηιουωаеиоуыэюя"
    found = "".join(x for x in alphabet(c) if vowel(x) == vowel(c))
    return found if len(found) > 1 else alphabet(c)


@lru_cache(None)
def _sign(c: str) -> str:
    """The same for what is no letter or digit: signs of ASCII that end no secret, or others of the block and category."""
    if c in SIGNS:
        return SIGNS
    if c.isascii() or c.isspace():
        return ""
    found = "".join(x for x in map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1)) if unicodedata.category(x) == unicodedata.category(c))
    return found if len(found) > 1 and unicodedata.category(c)[0] in "SP" else ""


def lower(text: str) -> str:
    """In small letters, of the same length."""
    return text.lower() if len(text.lower()) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def session_key(spark: SparkSession) -> bytes:
    """The key that the session sets, or a random one for each application."""
    if found := spark.conf.get(KEY, None):
        return found.encode()
    return _RANDOM.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


_RANDOM: dict[str, bytes] = {}


def luhn(digits: str) -> int:
    """The check digit of some digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _issuer(digits: str) -> int:
    """How many digits of a card's number name its issuer; 0 if it is none's."""
    m = _ISSUER.fullmatch(digits)
    return len(m[m.lastindex]) if m else 0


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


class Surrogates:
    """surrogate(kind, canonical, attempt): another value of the kind and format."""

    def __init__(self, key: bytes):
        self.permute = Permutations(key)
        self.surrogate = lru_cache(1 << 16)(self._surrogate)

    def _mixed(self, label: str, text: str, classes: list[str]) -> str:
        if len(text) > PIECE:  # a piece goes by those before it, so that the whole is still a permutation
            out, before = [], hashlib.blake2b(digest_size=16)
            for a in range(0, len(text), PIECE):
                own = f"{label}|{before.hexdigest()}" if a else label
                out.append(self._mixed(own, text[a : a + PIECE], classes[a : a + PIECE]))
                before.update(text[a : a + PIECE].encode("utf-8", "replace"))
            return "".join(out)
        n, x = 1, 0
        for c, a in zip(text, classes, strict=True):
            if a:
                n, x = n * len(a), x * len(a) + (k if (k := a.find(c)) >= 0 else ord(c) % len(a))
        x = self.permute(x, n, label + "|" + "|".join(a or c for c, a in zip(text, classes, strict=True)))
        out = []
        for c, a in zip(reversed(text), reversed(classes), strict=True):
            if a:
                x, k = divmod(x, len(a))
                out.append(a[k])
            else:
                out.append(c)
        return "".join(reversed(out))

    def _surrogate(self, kind: str, value: str, attempt: int = 0) -> str:
        more = max(0, attempt - SAME_FORMAT)  # a longer format once the same one has been tried often enough
        new = value
        for k in range(DRAWS):
            new = self._draw(kind, value, f"{attempt}.{k}" if k else str(attempt), more)
            if _apart_from(kind, value, new):
                return new
        return new if new != value else self._other(kind, value, attempt)

    def _other(self, kind: str, value: str, attempt: int) -> str:
        """For a value without a letter, digit or sign that others could stand for."""
        out = hashlib.blake2b(f"{kind}|{attempt}|{value}".encode("utf-8", "replace"), key=self.permute.key).hexdigest()
        return (out * (len(value) // len(out) + 1))[: max(4, len(value) + max(0, attempt - SAME_FORMAT))]

    def _draw(self, kind: str, value: str, label: str, more: int) -> str:
        attempt, label = label, f"{kind}|{label}"
        if kind == "email":  # the address at its own domain, which has a surrogate of its own
            local, _, domain = value.partition("@")
            local += LOWER[0] * more
            classes, names = [alphabet(c) for c in local], {}
            if attempt == "0":  # words that could be names have the surrogates of these
                for m in _LOCAL_WORDS.finditer(local):
                    if m[0] not in _GIVEN_LOWER:
                        names[m.start()] = self.surrogate("name", m[0], 0)
                        classes[m.start() : m.end()] = [""] * len(m[0])
            local = self._mixed(label, local, classes)
            for at, new in names.items():
                local = local[:at] + new + local[at + len(new) :]
            return f"{local}@{domain}"
        if kind == "domain":
            first, *labels, last = value.split(".")
            return ".".join([*(self._mixed(label, x, [alphabet(c) for c in x]) for x in (first + LOWER[0] * more, *labels)), last])
        if kind == "ip4":
            parts = [int(x) for x in value.split(".")]
            sizes = [254 if 0 < p < 255 else 1 for p in parts]
            n, x = 1, 0
            for p, s in zip(parts, sizes, strict=True):
                n, x = n * s, x * s + (p - 1 if s > 1 else 0)
            x = self.permute(x, n, label + str([p if s == 1 else -1 for p, s in zip(parts, sizes, strict=True)]))
            out = []
            for p, s in zip(reversed(parts), reversed(sizes), strict=True):
                x, k = divmod(x, s)
                out.append(str(k + 1 if s > 1 else p))
            return ".".join(reversed(out)) + more * ".1"
        if kind == "card":
            offset = (int(value[-1]) - luhn(value[:-1])) % 10
            body = value[:-1] + "0" * more
            keep = _issuer(value)
            body = self._mixed(f"{label}|{offset}", body, [""] * keep + [DIGITS] * (len(body) - keep))
            return body + str((luhn(body) + offset) % 10)
        if kind == "iban":
            rest = value[4:] + "0" * more
            rest = self._mixed(label, rest, [alphabet(c) for c in rest])
            return value[:2] + iban_check(value[:2], rest) + rest
        if kind == "phone":
            head, _, number = value.rpartition(" ")
            number += "0" * more
            classes = [DIGITS] * len(number)
            if len(number) == 10 and number[0] in "23456789" and number[3] in "23456789":
                classes[0] = classes[3] = "23456789"
                if number[3:6] == "555":
                    classes[3:6] = ["", "", ""]
            return f"{head} {self._mixed(label, number, classes)}"
        if kind in ("name", "name f", "name m"):
            body = value + "a" * more
            classes = [sounds(c) for c in body]
            if len(body) > 2 and body[-1] != body[-1].upper():  # endings tell the gender, in scripts with capitals
                classes[-1] = ""
            return self._mixed("name|" + attempt, body, classes)
        if kind.startswith("given "):
            _, gender, script = kind.split(" ")
            names = GIVEN[gender, script]
            if attempt.split(".")[0] == "0":
                return names[self.permute(names.index(value), len(names), label)]
            first, second = divmod(self.permute(names.index(value), len(names) ** 2, label), len(names))
            return f"{names[first]}-{names[second]}" + more * "a"
        if kind == "ip6":  # groups of zeros stay, so that the address can be shortened in the same place
            value += "0" * more
            classes = [HEX[1:] if k == 0 or value[k - 1] == ":" else HEX for k in range(len(value))]
            return self._mixed(label, value, ["" if c == ":" or c == "0" and a != HEX else a for c, a in zip(value, classes, strict=True)])
        value += "0" * more
        keep = 4 if kind == "aws" else len(_MARK.match(value)[0])
        body = value[keep:]
        if len(value) >= 16 and not set(value) - set(HEX) and kind != "ssn":
            classes = [HEX] * len(body)
        else:
            classes = [alphabet(c) for c in body]
            if 2 * sum(map(bool, classes)) < len(body):  # mostly signs
                classes = [a or _sign(c) for c, a in zip(body, classes, strict=True)]
        return self._mixed(label, value, [""] * keep + classes)


def _apart_from(kind: str, value: str, new: str) -> bool:
    """Whether a draw shows nothing of the original."""
    if kind == "email":  # the domain is looked at by itself
        value, new = value.partition("@")[0], new.partition("@")[0]
    a, b = value.lower(), new.lower()
    if a in b:
        return False
    if len(a) > SHORT or kind.startswith("given ") or kind not in ("email", "domain", "secret", "name", "name f", "name m"):
        return True
    same = [x == y and x.isalpha() for x, y in zip(a, b, strict=False)]
    if kind == "secret":  # the mark of its kind stays
        same = same[len(_MARK.match(value)[0]) :]
    if kind == "domain":  # the last label stays
        same = same[: a.rfind(".")]
    return not any(x and y for x, y in zip(same, same[1:], strict=False))


def own_domain(domain: str) -> bool:
    """Whether a domain may name a person or firm."""
    return domain not in SHARED and not any(domain.endswith("." + x) for x in SHARED)


def _script(name: str) -> str:
    return "cyrillic" if re.search("[А-я]", name) else "greek" if re.search("[Ͱ-Ͽ]", name) else "latin"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of each entity, in order, without overlaps; of overlapping ones the first, then the longest."""
    found: list[tuple[int, int, str, str]] = []
    low, flat = text.lower(), _flat(text)
    titled, given = _names_in(text)
    if "=" in text or ":" in text:
        if any(w in low for w in ("passw", "pwd", "token", "secret", "key")):
            for m in _SECRET.finditer(text):
                k = next(i for i in (1, 2, 3) if m[i] is not None)
                found.append((*m.span(k), "secret", m[k]))
        found += [(*m.span(), "ip6", x) for m in (_IP6.finditer(text) if text.count(":") > 1 else ()) if (x := _ip6(m[0])) is not None]
    if "@" in text:
        found += [(*m.span(), "email", lower(m[0])) for m in _EMAIL.finditer(text)]
    if "AKIA" in text or "ASIA" in text:
        found += [(*m.span(), "aws", m[0]) for m in _AWS.finditer(text)]
    if "_" in text or "-" in text or "AIza" in text:
        found += [(*m.span(), "secret", m[0]) for m in _MARKED.finditer(text)]
    if any(d in flat for d in DIGITS):
        found += [(*m.span(), "ip4", m[0]) for m in _IP4.finditer(flat) if any(0 < int(x) < 255 for x in m[0].split("."))]
        for m in _IBAN.finditer(flat):
            value = m[0].replace(" ", "")
            if len(value) >= 15 and iban_check(value[:2], value[4:]) == value[2:4]:
                found.append((*m.span(), "iban", value))
        for m in _CARD.finditer(flat):
            value = re.sub(r"\D", "", m[0])
            if _issuer(value) and luhn(value[:-1]) == int(value[-1]):  # other long numbers are no cards
                found.append((*m.span(), "card", value))
        found += [(*m.span(), "ssn", m[0].replace("-", "")) for m in _SSN.finditer(flat)]
        for a, b in _phones(flat):
            value = re.sub(r"\D", "", flat[a:b])
            abroad = flat[a] == "+" or flat[a : a + 2] == "00"
            value = value[2:] if flat[a : a + 2] == "00" else value
            head = value[: max(0, len(value) - 10)] if abroad else ""
            # +1 and a bare ten-digit number are one entity
            found.append((a, b, "phone", f"{'' if head == '1' else head} {value[len(head) :]}"))
    for m in _TITLED.finditer(text) if titled else ():
        gender = _TITLE_GENDER[m[1]]
        first, last = (m[2], m[3]) if m[3] else (None, m[2])
        if first:
            found.append((*m.span(2), *_given(first, gender)))
        found.append(_last(*m.span(3 if first else 2), last))
    for m in _SAID.finditer(text) if any(x in low for x in _SAYS) else ():
        if m[2]:
            found.append((*m.span(1), *_given(m[1], "")))
        found.append(_last(*m.span(2 if m[2] else 1), m[2] or m[1]))
    for m in _GIVEN.finditer(text) if given else ():
        found.append((*m.span(1), *_given(m[1], "")))
        found.append(_last(*m.span(2), m[2]))
    out = _apart(found)
    names = {}
    for *_, kind, value in out:
        if kind.startswith(("name", "given ")) and lower(value) not in _NO_NAMES:
            names.setdefault(lower(value), (kind, value))
    return _apart(out + _bare(text, names, {x[0] for x in out})) if names else out


def _last(start: int, end: int, name: str) -> tuple[int, int, str, str]:
    name = _POSSESSIVE.sub("", name)
    return start, start + len(name), "name", lower(name)


def _bare(text: str, names: dict[str, tuple[str, str]], starts: set[int]) -> list[tuple[int, int, str, str]]:
    """The mentions by themselves of names that the document has elsewhere; as they are written there, or in capitals."""
    found = []
    for name in filter(_IDEOGRAPHS.match, names):  # such scripts have no gaps between words
        found += [(m.start(), m.end(), *names[name]) for m in re.finditer(re.escape(name), text) if m.start() not in starts]
    for m in _WORDS.finditer(text):
        if m.start() in starts:
            continue
        if (x := names.get(lower(m[0]))) is not None:
            found.append((*m.span(), *x))
        elif len(m[0]) > 2 and not m[0].isalpha():  # "Weber's", "Weber-Haus"
            for part in _PART.finditer(m[0]):
                if part[0][0].isupper() and (x := names.get(lower(part[0]))) is not None:
                    found.append((m.start() + part.start(), m.start() + part.end(), *x))
    return found


def _apart(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for x in found:
        if x[0] >= end and x[1] > x[0]:
            out.append(x)
            end = x[1]
    return out


def _flat(text: str) -> str:
    """With the decimal digits of all scripts as those of ASCII; of the same length."""
    if text.isascii() or not text.encode("utf-8", "replace").translate(None, _NO_DIGITS):
        return text
    if not (other := {c for c in set(text) if not c.isascii() and c.isdecimal()}):
        return text
    return text.translate({ord(c): str(unicodedata.decimal(c)) for c in other})


def _names_in(text: str) -> tuple[bool, bool]:
    """Whether a text may have a title, and a listed given name: by its runs of ASCII letters; where other alphabets have some, by their letters."""
    raw = text.encode("utf-8", "replace")
    runs_ = set(raw.translate(_ASCII_RUNS).split())
    other = any(x in raw for x in (b"\xce", b"\xcf", b"\xd0", b"\xd1"))  # Greek and Cyrillic
    return other or not runs_.isdisjoint(_TITLE_RUNS), other or not runs_.isdisjoint(_GIVEN_RUNS)


def _phones(text: str):
    """(start, end) of phone numbers of 8 to 15 digits (7 after a word for one); of a longer match, as many groups as are one."""
    for m in _CUED.finditer(text):
        if 7 <= sum(c.isdigit() for c in m[1]) <= 15 and m[1].count("(") == m[1].count(")"):
            yield m.span(1)
    at = 0
    while (m := _PHONE.search(text, at)) is not None:
        digits = sum(c.isdigit() for c in m[0])
        if digits > 15:
            m = next((x for p in _SHORTER if (x := p.match(text, m.start())) and 8 <= sum(c.isdigit() for c in x[0]) <= 15), m)
            digits = sum(c.isdigit() for c in m[0])
        if 8 <= digits <= 15:
            yield m.span()
            at = m.end()
        else:
            at = m.start() + 1


def _ip6(text: str) -> str | None:
    """The eight groups of an address without leading zeros; none if it is no address, or names no host."""
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    if value < 2 or not any(c in DIGITS for c in text) and text.count(":") < 3:  # "a::b" is code
        return None
    return ":".join(f"{value >> 16 * k & 0xFFFF:x}" for k in range(7, -1, -1))


def _given(name: str, gender: str) -> tuple[str, str]:
    if name in _GENDER:
        return f"given {' '.join(_GENDER[name])}", name
    return f"name {gender}".strip(), lower(name)


def render(kind: str, original: str, canonical: str, surrogate: str) -> str:
    """The surrogate in the spelling of the mention: its separators, its upper and lower case."""
    if kind in ("phone", "card", "ssn", "iban"):
        new, pattern = surrogate.rpartition(" ")[2] if kind == "phone" else surrogate, r"[0-9]" if kind != "iban" else r"[A-Z0-9]"
        zero = {c: chr(ord(c) - unicodedata.decimal(c)) for c in set(original) if c.isdecimal()}
        places = [m.start() for m in re.finditer(pattern, _flat(original))]
        own = len(canonical.rpartition(" ")[2]) if kind == "phone" else len(canonical)
        places = places[len(places) - own :]
        out = list(original)
        for p, c in zip(places, new, strict=False):
            out[p] = chr(ord(zero[original[p]]) + int(c)) if c in DIGITS and original[p] in zero else c
        return "".join(out) + new[own:]
    if kind == "ip6":
        new = surrogate.split(":")
        head, gap, tail = original.partition("::")
        head, tail = head.split(":") if head else [], tail.split(":") if tail else []
        first, last = ([x.zfill(len(o)) for o, x in zip(own, part, strict=False)] for own, part in ((head, new), (tail, new[len(new) - len(tail) :])))
        out = ":".join(first) + gap + ":".join(last)
        return out.upper() if original.upper() == original != original.lower() else out
    if kind in ("email", "name", "name f", "name m"):
        cased = [s.upper() if o.isupper() and len(s.upper()) == 1 else s for o, s in zip(original, surrogate, strict=False)]
        return "".join(cased) + surrogate[len(cased) :]
    if kind.startswith("given ") and len(original) > 1 and original.isupper():
        return surrogate.upper()
    return surrogate


def replace(text: str, maker: Surrogates, overrides: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced. overrides: attempt numbers above 0 of (kind, value)."""

    def drawn(kind, value):
        return maker.surrogate(kind, value, overrides.get((_group(kind), value), 0))

    def new(kind, value):
        if kind != "email":
            return drawn(kind, value)
        local, domain = drawn(kind, value).partition("@")[::2]
        return f"{local}@{drawn('domain', domain) if own_domain(domain) else domain}"

    found = detect(text)
    if not found:
        return text, []
    pieces, at = [], 0
    for a, b, kind, value in found:
        pieces += [text[at:a], render(kind, text[a:b], value, new(kind, value))]
        at = b
    return "".join([*pieces, text[at:]]), [k.split(" ")[0] for *_, k, _ in found]


def _group(kind: str) -> str:
    return "name" if kind.startswith("name") else kind


def mentions(documents: DataFrame) -> DataFrame:
    """(k1, k2, kind, value): the distinct entities of each document, domains of addresses included, by document key."""
    rows = documents.select(*doc_key(), "text").filter("text is not null")

    def scan(batches):
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            out = []
            for k, raw in enumerate(texts(batch.column("text"))):
                own = {(_group(kind), value) for *_, kind, value in detect(raw.decode("utf-8", "replace"))}
                own |= {("domain", x) for kind, value in own if kind == "email" and own_domain(x := value.partition("@")[2])}
                for kind, value in own:
                    out.append((int(k1[k]), int(k2[k]), kind, value))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["k1", "k2", "kind", "value"])

    return rows.mapInArrow(scan, "k1 long, k2 long, kind string, value string")


def _attempts(ws: Workspace, entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate collides; all by joins of distinct entities."""

    def drawn(rows: DataFrame, attempt: int) -> DataFrame:
        def scan(batches):
            maker = Surrogates(key)
            for batch in batches:
                out = []
                for kind, value in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), strict=True):
                    new = maker.surrogate(kind, value, attempt)
                    name = kind.startswith(("name", "given "))  # given names and others must not be taken for each other
                    out.append(("name", lower(value), lower(new)) if name else (kind, value, new))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in out], pa.string()) for i in range(3))], ["kind", "value", "space", "real", "new"])

        return rows.select("kind", "value").mapInArrow(scan, "kind string, value string, space string, real string, new string")

    pending, attempt, taken, moved, real = entities, 0, None, None, None
    while True:
        tried = ws.save(drawn(pending, attempt), f"tried-{attempt}")
        real = tried.select("space", F.col("real").alias("new")) if real is None else real
        first = tried.groupBy("space", "new").agg(F.min(F.struct("kind", "value")).alias("first"))
        good = first.join(real, ["space", "new"], "left_anti")
        if taken is not None:
            good = good.join(taken, ["space", "new"], "left_anti")
        good = ws.save(good.select("space", "new", "first.kind", "first.value"), f"good-{attempt}")
        if attempt:
            now = good.select("kind", "value", F.lit(attempt).alias("attempt"))
            moved = now if moved is None else moved.union(now)
        taken = good.select("space", "new") if taken is None else taken.union(good.select("space", "new"))
        pending = ws.save(tried.select("kind", "value").join(good.select("kind", "value"), ["kind", "value"], "left_anti"), f"pending-{attempt}")
        if not pending.limit(1).count():
            return moved
        attempt += 1


def surrogates(spark: SparkSession, documents: DataFrame, key: bytes | None = None, most_sent: int = MOST_SENT, counts: tuple[str, str] | None = ("__n", "__kinds")) -> DataFrame:
    """All columns of the table with the text replaced, then the number of entities and their kinds in columns named ``counts`` (none if None).

    A null text stays null and an empty one empty; a text without entities is unchanged, byte for byte.
    Repeated rows give equal rows. Null ids are as good as others. An empty table stays empty. Columns
    of the input that are named as ``counts`` are replaced; all others stay, whatever their names.
    key: if None, that of the session (``session_key``).
    """
    ws, key = Workspace(spark, "pii"), session_key(spark) if key is None else key
    documents = documents.drop(*counts) if counts else documents
    names = documents.columns
    free = lambda x: x if x not in names else free(x + "_")
    mine, k1, k2 = map(free, ("__own", "__k1", "__k2"))
    found = ws.save(mentions(documents), "mentions")
    entities = ws.save(found.select("kind", "value").distinct(), "entities")
    moved = _attempts(ws, entities, key)
    at = names.index("text")
    n = 0 if moved is None else moved.count()
    sent, rows = spark.sparkContext.broadcast({}), documents
    if n and n <= most_sent:
        sent = spark.sparkContext.broadcast({(r.kind, r.value): r.attempt for r in moved.toLocalIterator()})
    elif n:
        lists = found.join(moved, ["kind", "value"]).distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(mine))
        rows = documents.select("*", *(c.alias(x) for c, x in zip(doc_key(), (k1, k2), strict=True)))
        rows = rows.join(lists.withColumnsRenamed({"k1": k1, "k2": k2}), [k1, k2], "left").select(*(F.col(f"`{c}`") for c in names), mine)
    own = n > most_sent

    def scan(batches):
        maker = Surrogates(key)
        for batch in batches:
            for a, b in runs(batch.column(at)):
                part = batch.slice(a, b - a)
                null = part.column(at).is_null().to_pylist()
                lists = part.columns[-1].to_pylist() if own else None
                new, count, kinds = [], [], []
                for k, raw in enumerate(texts(part.column(at))):
                    overrides = {(x["kind"], x["value"]): x["attempt"] for x in lists[k] or ()} if own else sent.value
                    text, hit = replace(raw.decode("utf-8", "replace"), maker, overrides)
                    new.append(None if null[k] else text if hit else raw.decode("utf-8", "replace"))
                    count.append(len(hit))
                    kinds.append(",".join(sorted(set(hit))))
                columns = list(part.columns[: len(names)])
                columns[at] = pa.array(new, pa.string())
                more = [pa.array(count, pa.int64()), pa.array(kinds, pa.string())] if counts else []
                yield pa.RecordBatch.from_arrays([*columns, *more], [*names, *(counts or ())])

    return rows.mapInArrow(scan, schema(documents, names, f"`{counts[0]}` long, `{counts[1]}` string" if counts else ""))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table: doc_id, text with surrogates, n_entities, kinds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates(spark, docs, counts=("n_entities", "kinds"))


def rewritten(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The table with the texts replaced and n_chars, where there is such a column, made to fit."""
    out = surrogates(spark, documents, counts=None)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return out
