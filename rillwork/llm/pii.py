"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Every value is found by its shape, validated (Luhn, mod-97, calendar, octet and numbering-plan rules), read as a number below the
count of values of its format, permuted by a keyed Feistel network (cycle-walking keeps the result below that count), and
written back in the same format.  The permutation depends on the key, the kind and the format alone, so equal values get equal
pseudonyms in all documents, different values get different ones, and the holder of the key can undo it.

Kinds: ``email`` (local part), ``card`` (scheme digit kept, check digit made valid), ``iban`` (country kept, check digits made valid),
``phone``, ``ssn``, ``ip`` (digits of each octet kept in number), ``date`` (any day from 1900 to 2099; order, separator and the digits of day
and month are kept), ``secret`` (access keys, and values
assigned to a name such as password or token: the whole run, dots between segments included).  Numbers that fail validation are left alone,
but for phone numbers marked by a + or by brackets: those that fail the numbering plan are permuted among themselves.

Dates are permuted among the dates that can be written with as many digits and are read in the same order, so that a pseudonym is read as its
original was.  The same day written in two ways with two digits for day and month has one pseudonym; one-digit forms are permuted by themselves.

The key comes from the session setting ``spark.rillwork.pii.key``.  Where that is unset, as in tests, the queries use a public key and warn: what
is replaced with it can be undone by anyone.  ``transform`` has no default.

Defined results.  Null text stays null with no findings; empty text stays empty.  Where shapes overlap the kind named first wins, in the order secret, email,
iban, card, phone, ssn, ip, date.  A date that reads both ways is taken as month/day/year for slashes, as day.month.year for points and hyphens.  Repeated
rows each give a row; all other columns pass through, and where one is called n_replaced or pii_kinds already, the new one is n_replaced_1 or pii_kinds_1.
An empty table gives no rows.

One narrow pass over whole texts; no shuffle, nothing broadcast but the key.  Work is linear in the text but for single values.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import bounded_batches, free_name, sliced

KEY_SETTING = "spark.rillwork.pii.key"
#: For tests and trials; it is public.
TRIAL_KEY = b"pseudonym key: replace in production"
ROUNDS = 8
KINDS = ("secret", "email", "iban", "card", "phone", "ssn", "ip", "date")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX, _HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"


@functools.lru_cache(4096)
def _keyed(key: bytes, tweak: bytes):
    return hashlib.blake2b(key=hashlib.blake2b(key, digest_size=32).digest(), person=hashlib.blake2b(tweak, digest_size=16).digest())


def permute(value: int, size: int, key: bytes, tweak: bytes, *, back: bool = False) -> int:
    """A keyed permutation of 0 .. size-1; back=True undoes it."""
    if size < 2:
        return value
    half = max(1, (size - 1).bit_length() + 1) // 2 or 1
    mask = (1 << half) - 1
    width, keyed = (half + 7) // 8, _keyed(key, tweak)

    def f(i: int, x: int) -> int:
        out, block = b"", 0
        while len(out) < width:
            h = keyed.copy()
            h.update(bytes([i, block]) + x.to_bytes(width, "big"))
            out += h.digest()
            block += 1
        return int.from_bytes(out[:width], "big") & mask

    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ f(i, left), left
            else:
                left, right = right, left ^ f(i, right)
        value = left << half | right
        if value < size:
            return value


def _mixed(places: list[tuple[int, int]], key: bytes, tweak: bytes, back: bool) -> list[int]:
    """Permutes a number of digits with the given (digit, radix)."""
    value, size = 0, 1
    for d, r in places:
        value, size = value * r + d, size * r
    value = permute(value, size, key, tweak + b"/%d" % size, back=back)
    out = []
    for _, r in reversed(places):
        value, d = divmod(value, r)
        out.append(d)
    return out[::-1]


def _by_class(text: str, key: bytes, tweak: bytes, back: bool, classes=(_DIGITS, _LOWER, _UPPER)) -> str:
    """Permutes the characters of the given classes, each within its class; others stay."""
    at = [(i, c, c.find(ch)) for i, ch in enumerate(text) for c in classes if ch in c]
    new = _mixed([(d, len(c)) for _, c, d in at], key, tweak + b"/" + "".join("x" if any(ch in c for c in classes) else ch for ch in text).encode(), back)
    out = list(text)
    for (i, c, _), d in zip(at, new):
        out[i] = c[d]
    return "".join(out)


def _fill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in turn."""
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), shape)


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits + check valid."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


#: Digits in the groups of card numbers that are written in groups.
_CARD_GROUPS = ((4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), (4, 4, 5))


def _card(m: re.Match, key: bytes, back: bool) -> str | None:
    groups = tuple(map(len, re.split("[ -]", m[0])))
    if len(groups) > 1 and groups not in _CARD_GROUPS:
        return None
    d = re.sub("[^0-9]", "", m[0])
    if not 13 <= len(d) <= 19 or d[0] not in "23456" or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    new = d[0] + "".join(map(str, _mixed([(int(c), 10) for c in d[1:-1]], key, b"card" + d[0].encode(), back)))
    return _fill(m[0], new + luhn_digit(new))


def _iban(m: re.Match, key: bytes, back: bool) -> str | None:
    """The longest valid start of the match that ends before a space or the match's end."""
    number = lambda t: int("".join(str(int(c, 36)) for c in t)) % 97
    for end in [len(m[0]), *sorted((i for i, c in enumerate(m[0]) if c == " "), reverse=True)]:
        s = m[0][:end].replace(" ", "")
        if 15 <= len(s) <= 34 and number(s[4:] + s[:4]) == 1:
            body = _by_class(s[4:], key, b"iban" + s[:2].encode(), back)
            new = iter(s[:2] + f"{98 - number(body + s[:2] + '00'):02d}" + body)
            return "".join(c if c == " " else next(new) for c in m[0][:end]) + m[0][end:]
    return None


def _phone(m: re.Match, key: bytes, back: bool) -> str | None:
    d = re.sub("[^0-9]", "", m[0])
    marked = m[0].startswith("+") or "(" in m[0]
    if m[0].startswith("+") and not (len(d) == 11 and d[0] == "1"):
        if not 9 <= len(d) <= 15:
            return None
        n = 1 if d[0] == "1" else 2
        kept, rest = d[:n], d[n:]
        return _fill(m[0], kept + "".join(map(str, _mixed([(int(c), 10) for c in rest], key, b"phone" + kept.encode(), back))))
    kept, d = (d[:1], d[1:]) if len(d) == 11 and d[0] == "1" else ("", d)
    if len(d) != 10:
        return None
    if d[0] in "01" or d[3] in "01":
        if not marked:
            return None
        while True:  # among the numbers that fail the plan, so that none meets the pseudonym of one that keeps it
            d = "".join(map(str, _mixed([(int(c), 10) for c in d], key, b"phone/any", back)))
            if d[0] in "01" or d[3] in "01":
                return _fill(m[0], kept + d)
    new = _mixed([(int(c) - 2, 8) if i in (0, 3) else (int(c), 10) for i, c in enumerate(d)], key, b"phone", back)
    return _fill(m[0], kept + "".join(str(x + 2 * (i in (0, 3))) for i, x in enumerate(new)))


def _ssn(m: re.Match, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, re.findall("[0-9]+", m[0]))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    a, g, s = _mixed([(area - 1 - (area > 666), 898), (group - 1, 99), (serial - 1, 9999)], key, b"ssn", back)
    return _fill(m[0], f"{a + 1 + (a >= 665):03d}{g + 1:02d}{s + 1:04d}")


def _ip(m: re.Match, key: bytes, back: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    low, count = (0, 0, 10, 100), (0, 10, 90, 156)
    new = _mixed([(int(p) - low[len(p)], count[len(p)]) for p in parts], key, b"ip" + "".join(str(len(p)) for p in parts).encode(), back)
    return ".".join(str(x + low[len(p)]) for x, p in zip(new, parts))


@functools.cache
def _days(month_digits: int, day_digits: int, late: bool) -> tuple[list[datetime.date], dict[datetime.date, int]]:
    """The days from 1900 to 2099 that can be written with so many digits (late: only those after the 12th), and the place of each."""
    first, last = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
    days = [d for d in map(datetime.date.fromordinal, range(first, last + 1)) if (month_digits == 2 or d.month < 10) and (day_digits == 2 or d.day < 10) and (not late or d.day > 12)]
    return days, {d: i for i, d in enumerate(days)}


def _date(m: re.Match, key: bytes, back: bool) -> str | None:
    a, sep, b, c = re.fullmatch(r"(\d+)([-/.])(\d+)[-/.](\d+)", m[0]).groups()
    orders = ["ymd"] if len(a) == 4 else (["mdy", "dmy"] if sep == "/" else ["dmy", "mdy"])
    for order in orders:
        part = dict(zip(order, (a, b, c)))
        # The second order is only read where the first can't be: where a day after the 12th stands in the month's place.
        form = len(part["m"]), len(part["d"]), order != orders[0]
        days, place = _days(*form)
        try:
            at = place.get(datetime.date(*(int(part[k]) for k in "ymd")))
        except ValueError:
            continue
        if at is not None:
            new = days[permute(at, len(days), key, b"date/%d%d%d" % form, back=back)]
            number = {"y": f"{new.year}", "m": f"{new.month:0{form[0]}d}", "d": f"{new.day:0{form[1]}d}"}
            return sep.join(number[k] for k in order)
    return None


def _email(m: re.Match, key: bytes, back: bool) -> str | None:
    local, at, domain = m[0].rpartition("@")
    return _by_class(local, key, b"email/" + domain.lower().encode(), back) + at + domain


#: Characters of a secret that are permuted as one number; its cost grows with the square of the length.
_BLOCK = 1024


def _long(text: str, key: bytes, tweak: bytes, back: bool, classes) -> str:
    """_by_class for any length: by blocks, each with a tweak of the length and of all that stands before it."""
    if len(text) <= _BLOCK:
        return _by_class(text, key, tweak, back, classes)
    out, seen = [], hashlib.blake2b(b"%d" % len(text), key=hashlib.blake2b(key, digest_size=32).digest(), digest_size=16)
    for i in range(0, len(text), _BLOCK):
        part = text[i : i + _BLOCK]
        out.append(_by_class(part, key, tweak + seen.digest(), back, classes))
        seen.update((out[-1] if back else part).encode())
    return "".join(out)


def _secret(m: re.Match, key: bytes, back: bool) -> str | None:
    value = m["value"] or m["access"]
    start = m.start("value") if m["value"] else m.start("access")
    fixed = next((p for p in ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-") if value.startswith(p)), "")
    hexed = next((c for c in (_HEX, _HEX_UPPER) if set(value) - {"."} <= set(c) and not value.replace(".", "").isdigit()), None)
    new = fixed + _long(value[len(fixed) :], key, b"secret/" + fixed.encode(), back, (hexed,) if hexed else (_DIGITS, _LOWER, _UPPER))
    return m[0][: start - m.start()] + new + m[0][start - m.start() + len(value) :]


_NAME = r"(?i:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key)"
_ADDRESS = r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
#: A whole run of segments with dots between them, of any length: a digit somewhere, a segment of eight characters or more, and, if
#: the first is shorter, no e-mail address.  A segment that names the next value isn't part of it.
_VALUE = (
    rf"(?=[A-Za-z0-9_+/-])(?=(?:[A-Za-z_+/-]|={{0,2}}\.(?=[A-Za-z0-9_+/-]))*+[0-9])(?=(?:[A-Za-z0-9_+/-]*+={{0,2}}\.)*?[A-Za-z0-9_+/-]{{8}})(?:(?=[A-Za-z0-9_+/-]{{8}})|(?!{_ADDRESS}))"
    rf"[A-Za-z0-9_+/-]++={{0,2}}(?:\.(?![A-Za-z0-9_+/-]*{_NAME}[ \t]{{0,2}}[=:])[A-Za-z0-9_+/-]++={{0,2}})*+"
)
#: kind, what a text must hold to be searched, shape, validation and pseudonym
_RULES = (
    ("secret", None, re.compile(rf"(?<![A-Za-z0-9_])(?:(?P<access>(?:AKIA|ASIA)[A-Z0-9]{{16}}|gh[po]_[A-Za-z0-9]{{36}}|xox[bp]-[A-Za-z0-9-]{{20,}}|sk-[A-Za-z0-9]{{20,}})(?![A-Za-z0-9])|{_NAME}[ \t]{{0,2}}[=:][ \t]{{0,2}}[\"']?(?P<value>{_VALUE}))"), _secret),
    ("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"), _email),
    ("iban", None, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), _iban),
    ("card", None, re.compile(r"(?<![0-9A-Za-z.+-])[2-6][0-9]{3}(?:[ -]?[0-9]){9,15}(?![0-9A-Za-z]|[.-][0-9])"), _card),
    ("phone", None, re.compile(r"(?<![0-9A-Za-z.+-])(?:(?:\+1[ .-]?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])|(?:1[ .-])?\([0-9]{3}\)[ .-]?)[0-9]{3}|(?:1[ .-])?[2-9][0-9]{2}[ .-][2-9][0-9]{2})[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])|(?<![0-9A-Za-z.+-])\+[1-9](?:[ .()-]{0,2}[0-9]){8,14}(?![0-9A-Za-z])"), _phone),
    ("ssn", "-", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"), _ssn),
    ("ip", ".", re.compile(r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"), _ip),
    ("date", None, re.compile(r"(?<![0-9A-Za-z./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"), _date),
)
_DIGIT = re.compile("[0-9]")


def pseudonymise(text: str, key: bytes = TRIAL_KEY, *, back: bool = False) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds found in order; back=True restores the original."""
    if not _DIGIT.search(text) and "@" not in text:  # every kind but an e-mail address holds a digit
        return text, []
    found: list[tuple[int, int, str, str]] = []  # in order, without overlaps
    for kind, needs, shape, make in _RULES:
        if needs and needs not in text:
            continue
        own, i = [], 0
        for m in shape.finditer(text):
            a, b = m.span()
            while i < len(found) and found[i][1] <= a:
                i += 1
            if i < len(found) and found[i][0] < b:
                continue
            new = make(m, key, back)
            if new is not None:
                own.append((a, b, kind, new))
        found = sorted(found + own)
    if not found:
        return text, []
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], [k for _, _, k, _ in found]


def session_key(spark: SparkSession) -> bytes:
    """The key of the session, or else the public one with a warning."""
    own = spark.conf.get(KEY_SETTING, None)
    if own:
        if len(own) < 16:
            raise ValueError(f"{KEY_SETTING} must have 16 characters or more")
        return own.encode()
    warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a public key and can be undone by anyone", stacklevel=2)
    return TRIAL_KEY


def transform(docs: DataFrame, key: bytes, counts: bool = True) -> DataFrame:
    """All columns with text replaced; with counts, also n_replaced and pii_kinds (kind to number)."""
    if not key:
        raise ValueError("a key is required")
    n_text = bounded_batches(docs).columns.index("text")
    names = [free_name(n, docs.columns) for n in ("n_replaced", "pii_kinds")] if counts else []

    def run(batches):
        for b in sliced(batches, n_text):
            done = [(None, []) if t is None else pseudonymise(t, key) for t in b.column(n_text).to_pylist()]
            cols = list(b.columns)
            cols[n_text] = pa.array([d[0] for d in done], pa.string())
            if counts:
                cols += [pa.array([len(d[1]) for d in done], pa.int64()), pa.array([[(k, d[1].count(k)) for k in KINDS if k in d[1]] for d in done], pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *names])

    extra = [T.StructField(n, kind) for n, kind in zip(names, (T.LongType(), T.MapType(T.StringType(), T.LongType())))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kinds = [F.coalesce(F.col("pii_kinds")[k], F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return transform(docs, session_key(spark)).select("doc_id", "text", "n_replaced", *kinds)
