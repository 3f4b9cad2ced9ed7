"""Personal data: validated values replaced by format-preserving pseudonyms.

Each value is permuted by a keyed Feistel network within the values of its own format:
a card number becomes another card number of its length and first digit with a right
check digit, a date another date, an address another address. A permutation keeps equal
values equal and different values different, so that records stay linked across documents
and formats, and the holder of the key can undo it.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
import secrets
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquarry.llm import common

ROUNDS = 10


def feistel(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: unbalanced halves, and cycle-walking to stay inside."""
    if size < 2:
        return value
    left_size = math.isqrt(size - 1) + 1
    right_size = -(-size // left_size)
    width = max(8, (max(left_size, right_size).bit_length() + 7) // 8 + 8)

    def f(step: int, half: int) -> int:
        text = f"{tweak}|{size:x}|{step}|{half:x}".encode()  # hex: decimal digits of long values have a limit
        return int.from_bytes(hashlib.blake2b(text, key=key, digest_size=min(64, width)).digest(), "big")

    while True:
        left, right = divmod(value, right_size)
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if step % 2:
                right = (right + sign * f(step, left)) % right_size
            else:
                left = (left + sign * f(step, right)) % left_size
        value = left * right_size + right
        if value < size:
            return value


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def laid_out(text: str, digits: str) -> str:
    """``text`` with its digits replaced by others, in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


def luhn_digit(payload: str) -> str:
    """The check digit that follows a payload."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


class Card:
    """13 to 19 digits, in groups or not, with a right check digit."""

    pattern = re.compile(r"(?<![\w+.-])[2-6]\d(?:[ -]?\d){10,16}\d(?![\w-]|\.\d)")

    @staticmethod
    def valid(text: str) -> bool:
        d = digits_of(text)
        return 13 <= len(d) <= 19 and luhn_digit(d[:-1]) == d[-1]

    @staticmethod
    def permute(text: str, p: Callable[[int, int, str], int]) -> str:
        d = digits_of(text)
        size = len(d) - 2
        payload = d[0] + str(p(int(d[1:-1]), 10**size, f"card{len(d)}{d[0]}")).zfill(size)
        return laid_out(text, payload + luhn_digit(payload))


class Iban:
    """A country, two check digits by ISO 7064, and the account."""

    pattern = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")

    @staticmethod
    def check(country: str, account: str) -> str:
        return str(98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97).zfill(2)

    @classmethod
    def valid(cls, text: str) -> bool:
        t = text.replace(" ", "")
        return 15 <= len(t) <= 34 and cls.check(t[:2], t[4:]) == t[2:4] and any(c.isdigit() for c in t[4:])

    @classmethod
    def permute(cls, text: str, p: Callable[[int, int, str], int]) -> str:
        t = text.replace(" ", "")
        account = permuted_string(t[4:], "iban" + t[:2], p)
        new = iter(t[:2] + cls.check(t[:2], account) + account)
        return "".join(c if c == " " else next(new) for c in text)


#: Country calling codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


class Phone:
    """North American numbers, and others with a country code."""

    pattern = re.compile(r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d\)?){7,12}(?!\w)")

    @staticmethod
    def valid(text: str) -> bool:
        return 8 <= len(digits_of(text)) <= 15

    @staticmethod
    def permute(text: str, p: Callable[[int, int, str], int]) -> str:
        d = digits_of(text)
        if text.startswith("+") and d[0] != "1":
            code = 1 if d[0] == "7" else 2 if d[:2] in TWO_DIGIT_CODES else 3
            return laid_out(text, d[:code] + permuted_string(d[code:], "phone" + d[:code], p))
        code, own = d[:-10], d[-10:]
        if own[0] >= "2" and own[3] >= "2":  # area and exchange codes begin with 2 to 9
            value = (int(own[:3]) - 200) * 8_000_000 + (int(own[3:6]) - 200) * 10_000 + int(own[6:])
            value = p(value, 6_400_000_000, "phone1")
            own = f"{value // 8_000_000 + 200}{value // 10_000 % 800 + 200}{value % 10_000:04d}"
        else:
            own = permuted_string(own, "phone", p)
        return laid_out(text, code + own)


class Address:
    """IPv4 addresses."""

    pattern = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")

    @staticmethod
    def valid(text: str) -> bool:
        return all(int(x) < 256 for x in text.split("."))

    @staticmethod
    def permute(text: str, p: Callable[[int, int, str], int]) -> str:
        value = p(int.from_bytes(bytes(map(int, text.split("."))), "big"), 1 << 32, "address")
        return ".".join(map(str, value.to_bytes(4, "big")))


class SocialNumber:
    """Nine digits as 3-2-4, of an area, group and serial that can be issued."""

    pattern = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
    areas = [a for a in range(1, 900) if a != 666]

    @classmethod
    def valid(cls, text: str) -> bool:
        a, b, c = map(int, text.split("-"))
        return 0 < a < 900 and a != 666 and b > 0 and c > 0

    @classmethod
    def permute(cls, text: str, p: Callable[[int, int, str], int]) -> str:
        a, b, c = map(int, text.split("-"))
        value = (cls.areas.index(a) * 99 + b - 1) * 9999 + c - 1
        value, c = divmod(p(value, len(cls.areas) * 99 * 9999, "social"), 9999)
        a, b = divmod(value, 99)
        return f"{cls.areas[a]:03d}-{b + 1:02d}-{c + 1:04d}"


class Date:
    """Calendar dates as y-m-d or y/m/d, and d.m.y."""

    pattern = re.compile(r"(?<![\w.-])(?:(?:19|20)\d\d([-/])\d\d\1\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![\w-]|\.\d)")
    first, count = datetime.date(1900, 1, 1).toordinal(), 73_049  # to the end of 2099

    @staticmethod
    def read(text: str) -> datetime.date:
        y, m, d = (text[:4], text[5:7], text[8:]) if text[4] in "-/" else (text[6:], text[3:5], text[:2])
        return datetime.date(int(y), int(m), int(d))

    @classmethod
    def valid(cls, text: str) -> bool:
        try:
            cls.read(text)
        except ValueError:
            return False
        return True

    @classmethod
    def permute(cls, text: str, p: Callable[[int, int, str], int]) -> str:
        new = datetime.date.fromordinal(cls.first + p(cls.read(text).toordinal() - cls.first, cls.count, "date"))
        if text[4] in "-/":
            return f"{new.year}{text[4]}{new.month:02d}{text[4]}{new.day:02d}"
        return f"{new.day:02d}.{new.month:02d}.{new.year}"


class Email:
    """Mail addresses; letters and digits change, signs and the last label stay, case is no difference."""

    pattern = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")

    @staticmethod
    def valid(text: str) -> bool:
        local, _, host = text.partition("@")
        return len(local) <= 64 and len(host) <= 255  # the longest that mail has

    @staticmethod
    def permute(text: str, p: Callable[[int, int, str], int]) -> str:
        local, _, host = text.partition("@")
        host, dot, last = host.rpartition(".")
        return permuted_string(local, "local", p) + "@" + permuted_string(host, "host", p) + dot + last


def permuted_string(text: str, tweak: str, p: Callable[[int, int, str], int]) -> str:
    """Letters and digits permuted together within the strings of the same pattern."""
    shape = re.sub("[A-Za-z]", "a", re.sub(r"\d", "9", text))
    value, size = 0, 1
    for c in text:
        radix = 10 if c.isdigit() else 26 if c.isalpha() else 1
        value = value * radix + (int(c) if radix == 10 else ord(c.lower()) - 97 if radix == 26 else 0)
        size *= radix
    value = p(value, size, tweak + shape)
    out = []
    for c in reversed(text):
        radix = 10 if c.isdigit() else 26 if c.isalpha() else 1
        value, digit = divmod(value, radix)
        new = str(digit) if radix == 10 else chr(97 + digit) if radix == 26 else c
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out))


#: In order of precedence: what an earlier kind has taken, a later one leaves.
KINDS = {"email": Email, "iban": Iban, "card": Card, "phone": Phone, "social": SocialNumber, "address": Address, "date": Date}
_SOME = re.compile(r"[0-9][^\n]{4}|@")


def find(text: str) -> list[tuple[int, int, str]]:
    """Valid values by place: start, end, kind; they don't overlap."""
    out: list[tuple[int, int, str]] = []  # sorted
    if not _SOME.search(text):
        return out
    for kind, rule in KINDS.items():
        if kind == "email" and "@" not in text:
            continue
        taken = common.overlap_test((a, b) for a, b, _ in out)
        out = sorted(out + [(*m.span(), kind) for m in rule.pattern.finditer(text) if rule.valid(m[0]) and not taken(*m.span())])
    return out


class Pseudonyms:
    """Values to pseudonyms under a key, remembered while a worker lives."""

    def __init__(self, key: bytes):
        self.key = key
        self.of = functools.lru_cache(50_000)(self._of)

    def _of(self, kind: str, value: str, back: bool = False) -> str:
        return KINDS[kind].permute(value, lambda v, n, tweak: feistel(v, n, self.key, tweak, back))

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and what was found where in it."""
        found = find(text)
        parts, at = [], 0
        for a, b, kind in found:
            parts += [text[at:a], self.of(kind, text[a:b])]
            at = b
        return "".join([*parts, text[at:]]) if found else text, found


#: The setting that names the key, as text.
KEY_SETTING = "spark.terraquarry.pii.key"


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's setting names; without one, a new random key.

    Values are linked within what one key has made: set one to link results of different runs.
    """
    named = spark.conf.get(KEY_SETTING, None)
    return hashlib.blake2b(named.encode()).digest() if named else secrets.token_bytes(32)


def pseudonymise(docs: DataFrame, *, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its personal data replaced: doc_id, text, n_found, n_<kind>, spans.

    spans lists kind:start:end of the input text, in order, joined by commas; ends are
    exclusive, in code points. A null text stays null with nothing found; a text without
    personal data is unchanged; repeated rows are treated alike; other columns are ignored;
    an empty table gives no rows. Values that no rule validates stay as they are, such as
    mail addresses of more than 64 characters before the sign or 255 after it. Whoever has
    the key (64 bytes at most) can undo the pseudonyms.
    """
    common.tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in common.chunks(batches):
            texts, counts, spans = [], [], []
            for text in batch.column("text").to_pylist():
                new, found = names.replace(text) if text is not None else (None, [])
                kinds = Counter(k for _, _, k in found)
                texts.append(new)
                counts.append((len(found), *(kinds[k] for k in KINDS)))
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k in found))
            columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), *columns, pa.array(spans, pa.string())], names=["doc_id", "text", "n_found", *(f"n_{k}" for k in KINDS), "spans"])

    counts = ", ".join(f"{c} long" for c in ("n_found", *(f"n_{k}" for k in KINDS)))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, {counts}, spans string")


def pseudonymised_text(docs: DataFrame, *, key: bytes, text_col: str = "text") -> DataFrame:
    """The same for a table with any columns: the text column alone is changed, in place."""
    common.tune(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in common.chunks(batches, text_col):
            texts = [names.replace(t)[0] if t is not None else None for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
