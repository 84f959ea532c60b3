"""Format-preserving Feistel pseudonyms for personal data.

Numbers and dates are validated (Luhn, mod 97, octet and calendar ranges, issued areas), then permuted
under a key within the set of valid values of their format: a card number becomes another that passes
its check, a date another date in the same notation. Separators stay. As the permutation depends on the
key and the kind alone, equal values become equal pseudonyms in every document, without a table of values;
who has the key can invert it. Each permutation is an alternating Feistel network over two halves in mixed
radix with keyed BLAKE2b as the round function, walked on domains that aren't a product until a valid value; a
value is sent there, moved on by a keyed step and sent back, so that none becomes itself. Days after the 12th stay
so, as D/M/Y and M/D/Y are told apart by them. Local parts of mail addresses and hexadecimal secrets are permuted
letter by letter class in the same way; a letter of any script stays in its script, and what has one possible value
alone is left as it is and isn't counted. Digits of all scripts are read as numbers and written in the script of
the first of them.

A run of groups of digits (or of capitals and digits) can hold a number and its neighbours. Where the whole run
isn't valid, every stretch from a group's start to a group's end is tried, so that a valid number is found
beside others; a long list of short numbers can hold valid stretches by chance, which are replaced as well.

Defined results: a null text stays null and has no spans; a number that fails its check is left alone; a date
keeps its notation but is written with four and two digits;
repeated rows become alike; an empty table gives an empty result; texts are never cut; other columns are
ignored by pseudonymise.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import documents, ship

ROUNDS = 10
#: Key of the registered query; a real job passes its own secret.
QUERY_KEY = b"public demonstration key"
#: Classes of characters that permute among themselves.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7))
_CLASS = {c: k for k, cs in enumerate(CLASSES) for c in cs}
_others: dict[str, str] = {}
DIGITS = frozenset("0123456789")
#: Months of all years that dates know; days within the 2,400 months NEAR permute among themselves, and so do the days before and after.
MONTHS, NEAR = 9999 * 12, (1899 * 12, 2099 * 12)
#: The digit that a digit of another script means.
_FOLD = {c: str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x110000) if chr(c).isdecimal()}


def _round(key: bytes, kind: str, i: int, half: int, size: int, modulus: int) -> int:
    size_of = (modulus.bit_length() + 7) // 8 + 8
    out = b""
    while len(out) < size_of:
        out += hashlib.blake2b(f"{kind}|{i}|{half}|{size}|{modulus}|{len(out)}".encode(), key=key[:64]).digest()
    return int.from_bytes(out[:size_of], "big") % modulus


def _feistel(value: int, left: int, right: int, key: bytes, kind: str, undo: bool) -> int:
    a, b = divmod(value, right)
    for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        sign = -1 if undo else 1
        if i % 2:
            b = (b + sign * _round(key, kind, i, a, left, right)) % right
        else:
            a = (a + sign * _round(key, kind, i, b, right, left)) % left
    return a * right + b


def permute(value: int, n: int, key: bytes, kind: str, undo: bool = False) -> int:
    """A permutation of 0 to n - 1 that leaves no value in its place (if n is over 1); undo inverts it."""
    if n < 2:
        return value
    side = 1 << (n.bit_length() // 2)
    other = -(-n // side)

    def walked(x: int, back: bool) -> int:
        x = _feistel(x, other, side, key, kind, back)
        while x >= n:  # the product is larger than n, by less than a side
            x = _feistel(x, other, side, key, kind, back)
        return x

    step = 1 + _round(key, kind + "|step", 0, 0, n, n - 1)
    return walked((walked(value, False) + (-step if undo else step)) % n, True)


def _letters(c: str) -> str:
    """The characters that c permutes with: of CLASSES, or else letters of its kind among its 128 neighbours."""
    if c in _CLASS:
        return CLASSES[_CLASS[c]]
    if c.isascii() or not c.isalnum():
        return c
    if c not in _others:
        block, kind = ord(c) & ~0x7F, unicodedata.category(c)
        _others[c] = "".join(x for x in map(chr, range(block, block + 128)) if unicodedata.category(x) == kind and x not in _CLASS)
    return _others[c]


def permute_text(s: str, key: bytes, kind: str, undo: bool = False) -> str:
    """Letters and digits are permuted as one number in mixed radix; the rest stays in place."""
    classes = [_letters(c) for c in s]
    value, n = 0, 1
    for c, cs in zip(s, classes, strict=True):
        value, n = value * len(cs) + cs.index(c), n * len(cs)
    shape = kind + "|" + "".join(cs[0] for cs in classes)
    value = permute(value, n, key, shape, undo)
    out = []
    for cs in reversed(classes):
        value, digit = divmod(value, len(cs))
        out.append(cs[digit])
    return "".join(reversed(out))


def _refill(s: str, digits: str) -> str:
    """s with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in s)


def _luhn_sum(body: str) -> int:
    """Weighted sum of a body without its check digit."""
    return sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(body))))


def _digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


def card(s: str, key: bytes, undo: bool = False) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or (_luhn_sum(d[:-1]) + int(d[-1])) % 10:
        return None
    body = permute_text(d[:-1], key, "card", undo)
    return _refill(s, body + str(-_luhn_sum(body) % 10))


def ip(s: str, key: bytes, undo: bool = False) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", undo)
    return ".".join(map(str, value.to_bytes(4, "big")))


def phone(s: str, key: bytes, undo: bool = False) -> str | None:
    """The country code stays."""
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", s)
    head = code[0] if code else ""
    rest = s[len(head) :]
    return head + _refill(rest, permute_text(_digits(rest), key, "phone", undo)) if 7 <= len(_digits(rest)) <= 14 else None


def ssn(s: str, key: bytes, undo: bool = False) -> str | None:
    a, b, c = map(int, s.split("-"))
    if not (0 < a < 900 and a != 666 and b and c):
        return None
    n = permute((((a - 1 if a < 666 else a - 2) * 99) + b - 1) * 9999 + c - 1, 898 * 99 * 9999, key, "ssn", undo)
    a, b, c = n // (99 * 9999), n // 9999 % 99, n % 9999
    return f"{a + 1 if a < 665 else a + 2:03d}-{b + 1:02d}-{c + 1:04d}"


def iban(s: str, key: bytes, undo: bool = False) -> str | None:
    c = s.replace(" ", "")
    check = lambda x: int("".join(str(int(ch, 36)) for ch in x)) % 97
    if not 15 <= len(c) <= 34 or check(c[4:] + c[:4]) != 1:
        return None
    body = permute_text(c[4:], key, "iban" + c[:2], undo)
    new = iter(c[:2] + f"{98 - check(body + c[:2] + '00'):02d}" + body)
    return "".join(ch if ch == " " else next(new) for ch in s)


def _late_before(month: int) -> int:
    """Days after the 12th before a month, counted from year 1."""
    return datetime.date(1 + month // 12, 1 + month % 12, 1).toordinal() - 1 - 12 * month


def _day(rank: int, late: bool) -> datetime.date:
    """The rank-th day up to the 12th of a month, or after it."""
    month = bisect.bisect_right(range(MONTHS), rank, key=_late_before) - 1 if late else rank // 12
    day = 13 + rank - _late_before(month) if late else 1 + rank % 12
    return datetime.date(1 + month // 12, 1 + month % 12, day)


def _rank(month: int, day: int, late: bool) -> int:
    return _late_before(month) + day - 13 if late else month * 12 + day - 1


def date(s: str, key: bytes, undo: bool = False) -> str | None:
    """Y-M-D, Y/M/D, D.M.Y, M/D/Y or else D/M/Y; equal days stay equal across notations."""
    sep = next(c for c in s if c not in DIGITS)
    x = s.split(sep)
    orders = ["ymd"] if len(x[0]) == 4 else ["dmy"] if sep == "." else ["mdy", "dmy"]
    for order in orders:
        try:
            old = datetime.date(*(int(x[order.index(c)]) for c in "ymd"))
        except ValueError:
            continue
        late = old.day > 12
        # days near and far permute among themselves, and so do those up to the 12th and after it
        lo, hi, all_ = _rank(NEAR[0], 13 if late else 1, late), _rank(NEAR[1], 13 if late else 1, late), MONTHS * 12
        if late:
            all_ = _late_before(MONTHS - 1) + 31 - 12
        rank = _rank(old.year * 12 + old.month - 13, old.day, late)
        if lo <= rank < hi:
            rank = lo + permute(rank - lo, hi - lo, key, f"date{late}", undo)
        else:
            rank = permute(rank if rank < lo else rank - hi + lo, all_ - hi + lo, key, f"far date{late}", undo)
            rank += hi - lo if rank >= lo else 0
        new = _day(rank, late)
        parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return sep.join(parts[c] for c in order)
    return None


def mail(s: str, key: bytes, undo: bool = False) -> str | None:
    local, _, host = s.rpartition("@")
    new = permute_text(local, key, "mail", undo)
    return None if new == local else new + "@" + host


def secret(s: str, key: bytes, undo: bool = False) -> str | None:
    """Hexadecimal digits, lower or upper case."""
    if not re.search("[0-9]", s) or not re.search(r"[A-Fa-f]", s) or not (s == s.lower() or s == s.upper()):
        return None
    out = f"{permute(int(s, 16), 16 ** len(s), key, f'secret{len(s)}', undo):0{len(s)}x}"
    return out if s == s.lower() else out.upper()


#: In the order of precedence at one place.
KINDS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "mail": (r"[^\s@<>\"'(),;:|=\[\]{}#$&*%!/\\]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+", mail),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    "secret": (r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])", secret),
    "date": (r"(?<![0-9.])(?:[0-9]{4}([-/])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./])[0-9]{1,2}\2[0-9]{4})(?![0-9-])(?!\.[0-9])", date),
    "ip": (r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])", ip),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ssn),
    "card": (r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", card),
    "phone": (r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w])", phone),
}
_ANY = {k: re.compile(p) for k, (p, _) in KINDS.items()}
_HINT = re.compile("[0-9@]")
_DIGIT_RUN = re.compile("[0-9](?:[ -]?[0-9]){12,}")
_GROUP = re.compile("[0-9]+")
#: First digits and lengths of the large issuers' cards, in a first group of four digits at least.
_ISSUED = re.compile(r"(?=[0-9]{4})(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[0689][0-9]{12,17}|35[0-9]{14,17}|6[0-9]{15,18})")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})")
#: Fixed value: length of an IBAN by country.
IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in "15:NO 16:BE 18:DK,FK,FI,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU".split()) for c in cs.split(",")}


def _capital(c: str) -> bool:
    return "0" <= c <= "9" or "A" <= c <= "Z"


def _cards(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, stop, whether it is likely) of 13 to 19 digits in whole groups that pass their check; likely are whole runs and issued numbers."""
    for run in _DIGIT_RUN.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, *run.span())]
        digits = _digits(run[0])
        # sums of the digits so far, those at odd or at even places doubled
        sums = [[0, *accumulate(int(c) if i % 2 == p else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(digits))] for p in (0, 1)]
        ends = [0, *accumulate(b - a for a, b in groups)]
        for i, (start, first_stop) in enumerate(groups):
            for j in range(i + 1, len(ends)):
                n = ends[j] - ends[i]
                if n > 19:
                    break
                own = sums[(ends[j] - 1) % 2]
                if n >= 13 and (own[ends[j]] - own[ends[i]]) % 10 == 0:
                    stop = groups[j - 1][1]
                    yield start, stop, (start, stop) == run.span() or bool(first_stop - start >= 4 and _ISSUED.fullmatch(digits, ends[i], ends[j]))


def _ibans(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, stop, whether it is likely) of 15 to 34 capitals and digits in groups of four; likely are those of the country's length."""
    for m in _IBAN_HEAD.finditer(text):
        at, n = m.start(), 0
        while at < len(text) and n < 34 and _capital(text[at]):
            at, n = at + 1, n + 1
            follows = text[at : at + 1]
            if n >= 15 and not (follows.isascii() and follows.isalnum()):
                yield m.start(), at, n == IBAN_LENGTHS.get(text[m.start() : m.start() + 2])
            if n % 4 == 0 and follows == " ":
                at += 1


def _phones(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, stop, True) of each match; of one with too many digits, without its last groups."""
    for m in _ANY["phone"].finditer(text):
        stop = m.end()
        while phone(text[m.start() : stop], b"") is None:
            shorter = re.search("[ .-][0-9]+$", text[m.start() : stop])
            if not shorter:
                break
            stop = m.start() + shorter.start()
        yield m.start(), stop, True


_WITHIN = {"card": _cards, "iban": _ibans, "phone": _phones}


def pseudonymise_text(text: str, key: bytes, undo: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """(new text, spans of the old one by kind). At overlaps the earlier start wins, then the kind named first, then the longer; stretches that are valid but not likely come after all others, the longer first."""
    whole = text
    if not text.isascii() and any(map(str.isdecimal, text)):
        text = text.translate(_FOLD)  # character by character, so spans are the same
    if not _HINT.search(text):
        return whole, []
    found = []
    for order, (kind, (_, fn)) in enumerate(KINDS.items()):
        if kind == "mail" and "@" not in text:
            continue
        for start, stop, likely in _WITHIN[kind](text) if kind in _WITHIN else ((*m.span(), True) for m in _ANY[kind].finditer(text)):
            new = "" if kind == "card" else fn(text[start:stop], key, undo)  # a long run has many cards to choose from
            if new is not None:
                found.append(((0, start, order, start - stop) if likely else (1, start - stop, start, order), start, stop, kind, new))
    taken, chosen = [], {}
    for _, start, stop, kind, new in sorted(found):
        k = bisect.bisect(taken, start)
        if (not k or chosen[taken[k - 1]][0] <= start) and (k == len(taken) or stop <= taken[k]):
            taken.insert(k, start)
            chosen[start] = (stop, kind, new)
    out, spans, at = [], [], 0
    for start in taken:
        stop, kind, new = chosen[start]
        new = new or KINDS[kind][1](text[start:stop], key, undo)
        first = next((c for c in whole[start:stop] if c.isdecimal()), "0")
        if not first.isascii():
            zero = ord(first) - unicodedata.decimal(first)
            new = "".join(chr(zero + int(c)) if c in DIGITS else c for c in new)
        out += [whole[at:start], new]
        spans.append((kind, start, stop))
        at = stop
    return "".join([*out, whole[at:]]), spans


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans) of every row: the text with pseudonyms, and what they replaced where in the old text."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                done = [(None, []) if x is None else pseudonymise_text(x, key) for x in part.column(1).to_pylist()]
                spans = [[dict(zip(("kind", "start", "stop"), s, strict=True)) for s in x[1]] for x in done]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in done], pa.string()), pa.array(spans, pa.list_(kind))], ["id", "text", "spans"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(rewritten, "id long, text string, spans array<struct<kind:string,start:int,stop:int>>")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(documents(spark, sf_dir), QUERY_KEY)
    return out.select(F.col("id").alias("doc_id"), "text", F.size("spans").cast("long").alias("n_spans"), F.array_join(F.transform("spans", lambda s: s.kind), ",").alias("kinds"))
