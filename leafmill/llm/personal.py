"""Personal information in free text: found, and replaced by typed placeholders.

Pieces are found by shape, context and validity.  Numbers that a person is known
by are told from numbers of things (cases, lots, meters, orders) by the words
before and after them and by what their kind allows (parts of a social security
number that are never zero, prefixes of insurance numbers, first digits of area
and exchange codes, days that exist); names are told from firms, places and
streets by their shape and by the words they stand beside.  In the placeholder a
number keeps its format: what identifies it (the national number of a phone
without country code, trunk zero and extension; the digits of an id number; the
day of a date) goes through a keyed Feistel permutation of its own domain, so
equal numbers stay equal in every document and spelling, different numbers stay
different, and nobody without the key can go back.  Emails, names and addresses
get a keyed tag in the same way.

Limits of the checks: social security areas from 900 and the insurance prefix QQ
(numbers kept for examples and taxpayers) count as valid, as do area codes such
as 911; plain numbers after a label are checked by length only.

Defined results: null, empty and blank texts hold nothing and come back as they
are; pieces never overlap (email before id, phone, address and person); a piece
that stands twice in a text is reported once; white space inside a piece counts
as one space; texts of any length are read whole; repeated pages give their
rows once.  Dates of a person (birth, issue, expiry: a date after such a word) are
replaced in ``redact``; they are no kind of ``find``.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "phone", "id_number", "address", "person")

_EMAIL = re.compile(
    r"[A-Za-z0-9][\w.+-]*(?:\s?@\s?|\s?[\[(]at[\])]\s?)[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]dot[\])]\s?)[A-Za-z0-9-]+)*(?:\.|\s?[\[(]dot[\])]\s?)[A-Za-z]{2,}", re.I
)

_LABEL = re.compile(
    r"(?:\bSSN|\bSS ?#|\bsoc(?:ial|\.)\s+sec(?:urity|\.)|\btax(?:payer)?\s+(?:id|identification|number|no)|\bT?ITIN|\bnational\s+insurance|\bNI\b"
    r"|\bpassport|\blicen[cs]e|\bDL\b)(?:\s*(?:number|num\.?|no\.?|id|identification|card|of|#))*\s*[:#]?\s*$",
    re.I,
)
# a value in the shape of an identity number; the plain shapes need a label before them
_ID = re.compile(
    r"(?<![\w.,$/-])(?:"
    r"(?P<nino>[A-Z]{2}[\s-]?\d{2}[\s-]?\d{2}[\s-]?\d{2}[\s-]?[A-D])"
    r"|(?P<ssn>\d{3}(?:-\d{2}-|\s\d{2}\s)\d{4})"
    r"|(?P<licence>[A-Z]\d{3}-\d{4}-\d{4})"
    r"|(?P<plain>[A-Z]{0,2}\d{6,10})"
    r")(?![\w/-]|[.,]\d)"
)
_PHONE = re.compile(
    r"(?<![\w.,$/#-])(?:"
    r"\+\d{1,3}\s?\(?\d{2,5}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}"
    r"|(?:1[\s.-]?)?\(\d{3}\)\s?\d{3}[\s.-]?\d{4}"
    r"|(?:1[\s.-])?\d{3}(?:(?P<sep>[\s.-])\d{3}(?P=sep)\d{4}|\d{7})"
    r"|0\d{4}\s\d{3}\s?\d{3}|0\d{2}\s\d{4}\s\d{4}|0\d{3}\s\d{3}\s\d{4}"
    r"|(?:1\s)?\d{3}\s\d{3}\s\d{4}|\d{3}[.-]\d{4}"
    r")(?:,?\s*(?:ext\.?|extension|x)\s*\d{1,5})?(?![\w/-]|[.,]\d)",
    re.I,
)
_NOT_PHONE_BEFORE = re.compile(
    r"(?:\b(?:lot|meter(?:\s+\w+)?|serial|case|claim|order|invoice|form|bates|file|vol\.?|ref\.?|appendix|account|policy|docket|device|model|part|batch|item)"
    r"(?:\s+(?:number|no\.?|nr\.?))?|\bno\.|#|\$|[A-Z]{1,4}-)\s*$",
    re.I,
)
_PHONE_CUE = re.compile(r"(?:\btel(?:ephone)?|\bphone|\bfax|\bcall(?:back)?|\bmobile|\bcell|\breached|\bline|\bleft)\b.{0,12}$", re.I | re.S)
_UNITS_AFTER = re.compile(r"\s*(?:uni[tf]s|pieces|copies|k[wW]h|miles|km|items)\b")

_STREET = r"(?:Ave(?:nue)?|Blvd|Boulevard|Cres(?:cent)?|Close|Court|Ct|Drive|Gardens|Highway|Lane|Ln|Parkway|Place|Pl|Road|Rd|Square|Street|St|Terrace|Way)"
_STREET_CAPS = re.sub(r"[A-Za-z]+", lambda m: m.group().upper(), _STREET)
_UNIT = r"(?:,?\s+(?:(?:Apt|Apartment|Flat|Suite|Ste|Unit|Room|Floor)\.?\s*#?\s*\w{1,5}|#\s?\d{1,5}\w?))?"
_WORD = r"(?:[A-Z][a-z]+(?:'s)?|[A-Z]{2,}(?:'S)?)"
_HOUSE = re.compile(r"\d{1,5}[A-Za-z]?\s+[A-Z]")
_ADDRESS = re.compile(
    rf"(?<![\w.,$/-])\d{{1,5}}[A-Za-z]?\s+(?:(?:North|South|East|West|NORTH|SOUTH|EAST|WEST|[NSEW]{{1,2}}\.?)\s+)?{_WORD}(?:\s+{_WORD}){{0,2}}?\s+(?:{_STREET}|{_STREET_CAPS})\b"
    rf"(?:(?<=St)\.|(?<=ST)\.)?{_UNIT}"
)
_CALLE = re.compile(rf"\b(?:Calle|Avenida|Plaza|Camino|CALLE|AVENIDA)\s+(?:(?:de|del|la|las|los)\s+)*{_WORD}(?:\s+{_WORD}){{0,2}},?\s+\d{{1,5}}\b{_UNIT}")
_STRASSE = re.compile(rf"\b[A-Z][A-Za-z]*(?:straße|strasse|STRASSE|STRAßE)\s+\d{{1,5}}[a-z]?\b{_UNIT}")

# Words that begin sentences, head columns or belong to firms and places: never part of a person's name.
_NEVER = """
About According After Again All Also Although Among And Another Any As At Because Before Behind Below Beside Between Both But By Contrary Copies Copy
Deliveries Despite Draft During Each Early Either Every Fax For Form From Further He Here His How However If In Into It Its Last Late Later Left Lot Man
Many May Meanwhile Most Near Neighbours Neither Nobody Nor Not Nothing Now Of Off On Once One Only Or Order Our Out Outside Over Page Please Printed
Questions Received Returned See She Serial Shall Signed Since Some Still Subject Such Telephone Tel That The Their Then There These They This Those Three
Through To Today Tomorrow Two Under Unless Until Upon Was We What When Where Whether Which While Who Why Will With Within Without Witness Yesterday Yet You Your
January February March April June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday
Mr Mrs Ms Miss Dr Prof Sir Madam Herr Frau Señor Señora Officer Judge Nurse
Holder Account Amount Appendix Balance Batch Charge Claim Claims Code Contents Checklist Date Description Due Gross Index Invoice Item Items Net Number Opened Paid
Period Qty Quantity Rate Record Records Reference Ref Sheet Total Units Vol Volume Ward File Case Schedule Enclosures Confidential Proceedings Bates Note
Archive Agency Association Authority Bank Board Bureau Centre Center Church City Clinic College Committee Company Corporation Council County Court Department District
Foundation Group Holdings Hospital Hotel House Inc Institute Insurance Limited Ltd Market Ministry Motors Museum Mutual Office Partners Precinct Railway School Services
Society State Station Store Trust Union University Works
Avenue Ave Blvd Boulevard Calle Crescent Drive Lane Road Rd Ln Ct Street St Way Place Square Gate Hollow Mill Pit Rest Hill Bridge
New Old Great North South East West Northern Southern Eastern Western Upper Lower Central Greater Little Saint Machine
Der Die Das Den Dem Des Ein Eine Einen Und Am Im An Auf Aus Bei Bis Für Laut Mit Nach Seit Trotz Über Um Unter Vom Von Vor Während Wegen Zu Zum Zur Es Er Sie Wir Ich Man
El La Los Las Un Una Uno Del Con Cuando Desde Durante En Entre Hasta Ningún Para Pero Por Porque Que Queda Según Se Si Sin Sobre Tras Su Sus No Aunque Como
""".split()
_NEVER_SET = frozenset(w.lower() for w in _NEVER)
# Words after a name that make it a firm, an office or a place.
_PLACES = """
Claims Archive Agency Association Authority Bank Board Bureau Centre Center Church City Clinic College Committee Company Corporation Council County Court Department District
Foundation Group Holdings Hospital Hotel House Inc Institute Insurance Limited Ltd Market Ministry Motors Museum Mutual Office Partners Precinct Railway Records School
Services Society State Station Store Trust Union University Works Avenue Ave Blvd Boulevard Crescent Drive Lane Road Rd Ln Ct Street St Way Place Square Gate Hollow Mill
Pit Rest Hill Bridge
""".split()
_PLACE_SET = frozenset(w.lower() for w in _PLACES)
_BREAK = r"(?:[-‐¬­] ?\n\s*[a-z]+)?"
_UP, _LOW = "A-ZÁÀÂÉÈÍÓÔÚÑÇŁŚŻ", "a-záàâãéèêëíîïóòôõúùûñçłńśźżąćę"
_PART = rf"(?:[{_UP}][{_LOW}]{{2,}}{_BREAK}|[A-Z]{{3,}})"
_LAST = rf"{_PART}(?:-\s?{_PART})?"
_PERSON = re.compile(
    rf"{_LAST}(?:(?P<comma>,)\s{{1,2}}(?:{_PART}(?: +[A-Z]\.)?|[A-Z]\.(?:\s?[A-Z]\.)?)|\s{{1,2}}(?:[A-Z]\.\s+){{0,2}}{_LAST})(?![\w@']|-\w)"
    rf"|[A-Z]\.\s{{1,2}}(?:[A-Z]\.\s{{1,2}})?{_LAST}(?![\w@']|-\w)"
)
_TOKEN = re.compile(rf"{_PART}|[A-Z]\.")
_JOIN = re.compile(r"[-‐¬­] ?\n\s*(?=[a-z])")
_NEXT_WORD = re.compile(r"[\s,&-]{1,3}([A-Za-z]+)")
_RUN_AFTER = re.compile(r"\s[A-Z]{3,}\b")
#: Fixed value: the exchange kept for directory enquiries and examples, which no other number uses.
OPEN_EXCHANGES = ("555",)
_FIGURES = re.compile(r"\d[\d\s().+-]{4,}\d")
_NON_DIGIT = re.compile(r"\D")
_EXTENSION = re.compile(r"(?i)ext|x")
_LETTERS = re.compile(r"[A-Za-z]{2,}")
_SPACE = re.compile(r"\s+")


def valid_ssn(digits: str) -> bool:
    """No area 000 or 666, no group 00, no serial 0000; areas from 900 are no social security numbers and bound by none of this."""
    return digits[0] == "9" or (digits[:3] not in ("000", "666") and digits[3:5] != "00" and digits[5:] != "0000")


# Letters and prefixes national insurance numbers are never given.
_NINO_NEVER = ("DFIUV", "DFIOUV", ("BG", "GB", "NK", "KN", "TN", "NT", "ZZ"))


def valid_nino(piece: str) -> bool:
    letters = piece[:2]
    return letters == "QQ" or (letters[0] not in _NINO_NEVER[0] and letters[1] not in _NINO_NEVER[1] and letters not in _NINO_NEVER[2])


def phone_parts(piece: str) -> tuple[str, str, str] | None:
    """(country, national number, extension) of a phone number, None where its plan does not allow it.

    Without a country code a number with a trunk zero is British, any other North
    American; a local number keeps its seven digits.
    """
    main, *rest = _EXTENSION.split(piece, maxsplit=1)
    extension = _NON_DIGIT.sub("", rest[0]) if rest else ""
    digits = _NON_DIGIT.sub("", main)
    if main.lstrip().startswith("+") and not digits.startswith("1"):
        country = digits[: max(2, min(3, len(digits) - 10))]
        national = digits[len(country) :].removeprefix("0")
        return (country, national, extension) if 6 <= len(national) <= 12 and len(digits) <= 15 else None
    if digits.startswith("0"):
        return ("44", digits[1:], extension) if len(digits) in (10, 11) and digits[1] != "0" else None
    if len(digits) == 11 and digits[0] == "1":
        digits = digits[1:]
    if len(digits) == 7:
        return ("1", digits, extension) if digits[0] > "1" else None
    return ("1", digits, extension) if len(digits) == 10 and digits[0] > "1" and digits[3] > "1" else None


_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_DATE = re.compile(
    rf"(?<![\w./-])(?:(?P<y1>\d{{4}})(?P<s1>[-/.])(?P<m1>\d{{1,2}})(?P=s1)(?P<d1>\d{{1,2}})|(?P<a2>\d{{1,2}})(?P<s2>[-/.])(?P<b2>\d{{1,2}})(?P=s2)(?P<y2>\d{{4}})"
    rf"|(?P<d3>\d{{1,2}})\s(?P<m3>{_MONTH})\.?,?\s(?P<y3>\d{{4}})|(?P<m4>{_MONTH})\.?\s(?P<d4>\d{{1,2}}),?\s(?P<y4>\d{{4}}))(?![\w/-]|\.\d)",
    re.I,
)
_DATE_CUE = re.compile(r"(?:\bD\.?O\.?B\.?|\bborn(?:\s+on)?|\bbirth(?:date|day)?|\bdate\s+of\s+(?:birth|issue|expiry)|\bissued(?:\s+on)?|\bexpir(?:es|y|ation)(?:\s+(?:on|date))?)\s*[:.#-]?\s*$", re.I)
#: Days a date is permuted within.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def day_of(m: re.Match) -> int | None:
    """The ordinal of a written date within the permuted days; where day and month can be told only by custom, the month stands first."""
    g = m.groupdict()
    if g["y1"]:
        y, mo, d = g["y1"], g["m1"], g["d1"]
    elif g["y2"]:
        y, mo, d = (g["y2"], g["b2"], g["a2"]) if int(g["a2"]) > 12 or g["s2"] == "." else (g["y2"], g["a2"], g["b2"])
    else:
        y, name, d = (g["y3"], g["m3"], g["d3"]) if g["y3"] else (g["y4"], g["m4"], g["d4"])
        mo = next(k for k, x in enumerate(_MONTHS, 1) if x.startswith(name.lower()[:3]))
    try:
        day = datetime.date(int(y), int(mo), int(d)).toordinal()
    except ValueError:
        return None
    return day if FIRST_DAY <= day <= LAST_DAY else None


def _squeezed(piece: str) -> str:
    return _SPACE.sub(" ", piece).strip()


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every piece, in order, none overlapping."""
    if not text or text.isspace():
        return []
    found: list[tuple[int, int, str]] = []

    def blank(body: str, since: int) -> str:
        for a, b, _ in found[since:]:
            body = body[:a] + "\x00" * (b - a) + body[b:]
        return body

    body = text
    if "@" in text or "at]" in text or "at)" in text or "AT]" in text:
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
        body = blank(body, 0)
    n = len(found)
    spans = [(max(0, m.start() - 4), m.end() + 18) for m in _FIGURES.finditer(body)]
    for lo, hi in spans:
        for m in _ID.finditer(body, lo, hi):
            a, kind = m.start(), m.lastgroup
            before = _JOIN.sub("", body[max(0, a - 56) : a])
            if kind == "plain" or (kind == "ssn" and "-" not in m.group()):
                ok = bool(_LABEL.search(before)) or (kind == "ssn" and not _NOT_PHONE_BEFORE.search(before))
            else:
                ok = bool(_LABEL.search(before)) or not _NOT_PHONE_BEFORE.search(before)
            if kind == "ssn":
                ok = ok and valid_ssn(_NON_DIGIT.sub("", m.group()))
            elif kind == "nino":
                ok = ok and valid_nino(m.group())
            if ok:
                found.append((a, m.end(), "id_number"))
    body = blank(body, n)
    n = len(found)
    for lo, hi in spans:
        for m in _PHONE.finditer(body, lo, hi):
            a, b, piece = m.start(), m.end(), m.group()
            before = _JOIN.sub("", body[max(0, a - 40) : a])
            if _NOT_PHONE_BEFORE.search(before) or _UNITS_AFTER.match(body, b):
                continue
            parts = phone_parts(piece)
            if parts is None:
                continue
            # seven digits in the shape of a local number, or ten in a row, are a phone by their words or by their exchange
            if (len(parts[1]) == 7 or piece.isdigit()) and not (_PHONE_CUE.search(before) or parts[1][-7:-4] in OPEN_EXCHANGES):
                continue
            found.append((a, b, "phone"))
    at = 0
    for m in _HOUSE.finditer(body):
        if m.start() >= at and (full := _ADDRESS.match(body, m.start())):
            at = full.end()
            found.append((m.start(), at, "address"))
    if "Calle" in body or "CALLE" in body or "Avenida" in body or "Plaza" in body or "Camino" in body:
        found += [(m.start(), m.end(), "address") for m in _CALLE.finditer(body)]
    if "stra" in body or "STRA" in body:
        found += [(m.start(), m.end(), "address") for m in _STRASSE.finditer(body)]
    body = blank(body, n)
    at = 0
    while m := _PERSON.search(body, at):
        at = m.end()
        a = m.start()
        stop = None
        for t in _TOKEN.finditer(body, a, m.end()):
            if _JOIN.sub("", t.group()).lower() in _NEVER_SET:
                stop = t
                break
        if stop is not None:  # go on behind the word that no name holds, or behind the first word
            first = _TOKEN.match(body, a)
            at = max(a + 1, stop.end() if stop.start() == a or m["comma"] is None else first.end())
            continue
        if a and (body[a - 1].isalnum() or body[a - 1] in "@_'" or (body[a - 1] == "-" and a > 1 and body[a - 2].isalnum())):
            at = a + 1
            continue
        words = [w.lower() for w in _LETTERS.findall(m.group())]
        if len(words) > 1 and len(set(words)) == 1:
            continue
        after = _NEXT_WORD.match(body, m.end())
        if after and after[1].lower() in _PLACE_SET and after[1][0].isupper():
            continue
        if m.group().isupper() and m["comma"] is None and "." not in m.group() and _RUN_AFTER.match(body, m.end()):
            continue
        if body[a + 1 : a + 2] == "." and a > 1 and body[a - 1] == " " and (body[a - 2].isdigit() or body[a - 2].isupper()):
            continue  # the last letter of a number such as "12 34 56 C." before a sentence
        found.append((a, m.end(), "person"))
    found.sort()
    out: list[tuple[int, int, str]] = []
    for piece in found:
        if not out or piece[0] >= out[-1][1]:
            out.append(piece)
    return out


def feistel_digits(digits: str, key: bytes, rounds: int = 10) -> str:
    """A keyed permutation of the strings of ``len(digits)`` digits (one digit: a keyed shift)."""
    n = len(digits)
    if n < 2:
        shift = hmac.new(key, b"digit", hashlib.sha256).digest()[0]
        return str((int(digits) + shift) % 10) if digits else digits
    u = n // 2
    a, b = digits[:u], digits[u:]
    for r in range(rounds):
        mac = hmac.new(key, f"{n}|{r}|{b}".encode(), hashlib.sha256).digest()
        c = (int(a) + int.from_bytes(mac[:16], "big")) % 10 ** len(a)
        a, b = b, str(c).zfill(len(a))
    return a + b


def feistel_undo(digits: str, key: bytes, rounds: int = 10) -> str:
    n = len(digits)
    if n < 2:
        shift = hmac.new(key, b"digit", hashlib.sha256).digest()[0]
        return str((int(digits) - shift) % 10) if digits else digits
    u = n // 2 if rounds % 2 == 0 else n - n // 2
    a, b = digits[:u], digits[u:]
    for r in reversed(range(rounds)):
        mac = hmac.new(key, f"{n}|{r}|{a}".encode(), hashlib.sha256).digest()
        c = (int(b) - int.from_bytes(mac[:16], "big")) % 10 ** len(b)
        a, b = str(c).zfill(len(b)), a
    return a + b


def permute_date(ordinal: int, first: int, last: int, key: bytes) -> int:
    """A day within [first, last] (proleptic ordinals) permuted within that range by walking its cycle."""
    span = last - first + 1
    width = len(str(span - 1))
    x = ordinal - first
    while True:
        x = int(feistel_digits(str(x).zfill(width), key))
        if x < span:
            return first + x


def _key(key: bytes, use: str) -> bytes:
    return hmac.new(key, use.encode(), hashlib.sha256).digest()


def _refilled(piece: str, digits: str) -> str:
    """The piece with its last ``len(digits)`` digits replaced."""
    at = [k for k, c in enumerate(piece) if c.isascii() and c.isdigit()][-len(digits) :] if digits else []
    out = list(piece)
    for k, c in zip(at, digits):
        out[k] = c
    return "".join(out)


def pseudonym(piece: str, kind: str, key: bytes) -> str:
    """The placeholder of a piece: typed, and the same for equal values of the kind in any spelling."""
    piece = _squeezed(piece)
    if kind == "phone" and (parts := phone_parts(piece)):
        country, national, extension = parts
        main = piece[: m.start()] if (m := _EXTENSION.search(piece)) else piece
        moved = _refilled(main, feistel_digits(national, _key(key, f"phone {country} {len(national)}")))
        return f"[PHONE {moved}{_refilled(piece[len(main):], feistel_digits(extension, _key(key, 'extension')))}]"
    digits = "".join(c for c in piece if c.isascii() and c.isdigit())
    if kind == "id_number" and digits:
        return f"[ID_NUMBER {_refilled(piece, feistel_digits(digits, _key(key, kind)))}]"
    plain = re.sub(r"[\W_]+", " ", piece).strip().lower()
    return f"[{kind.upper()} {hmac.new(key, f'{kind}|{plain}'.encode(), hashlib.sha256).hexdigest()[:10]}]"


def date_pseudonym(m: re.Match, key: bytes) -> str | None:
    """The placeholder of a written date: another day in the same way of writing; None where it is no day."""
    day = day_of(m)
    if day is None:
        return None
    moved = datetime.date.fromordinal(permute_date(day, FIRST_DAY, LAST_DAY, _key(key, "date")))
    g = m.groupdict()
    if g["y1"]:
        text = f"{moved.year}{g['s1']}{moved.month:0{len(g['m1'])}d}{g['s1']}{moved.day:0{len(g['d1'])}d}"
    elif g["y2"]:
        first, second = (moved.day, moved.month) if int(g["a2"]) > 12 or g["s2"] == "." else (moved.month, moved.day)
        text = f"{first:02d}{g['s2']}{second:02d}{g['s2']}{moved.year}"
    else:
        name = _MONTHS[moved.month - 1].capitalize()
        text = f"{moved.day} {name} {moved.year}" if g["y3"] else f"{name} {moved.day}, {moved.year}"
    return f"[DATE {text}]"


def redact(text: str | None, key: bytes) -> str | None:
    if not text or text.isspace():
        return text
    pieces = [(a, b, pseudonym(text[a:b], kind, key)) for a, b, kind in find(text)]
    taken = [(a, b) for a, b, _ in pieces]
    for m in _DATE.finditer(text):
        if _DATE_CUE.search(text[max(0, m.start() - 24) : m.start()]) and all(m.end() <= a or m.start() >= b for a, b in taken) and (moved := date_pseudonym(m, key)):
            pieces.append((m.start(), m.end(), moved))
    if not pieces:
        return text
    out, at = [], 0
    for a, b, placeholder in sorted(pieces):
        out += [text[at:a], placeholder]
        at = b
    out.append(text[at:])
    return "".join(out)


def found_pieces(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(id, kind, found_text): one Arrow pass; only the pieces, not the texts, are shuffled to drop repeats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, kind, piece) for i, t in zip(b["id"], b["text"]) for kind, piece in dict.fromkeys((k, _squeezed(t[a:z])) for a, z, k in find(t))]
            yield pd.DataFrame(rows, columns=["id", "kind", "found_text"])

    kind = pages.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("kind", T.StringType()), T.StructField("found_text", T.StringType())])
    rows = pages.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("id is not null and text is not null")
    return rows.mapInPandas(run, schema).dropDuplicates().withColumnRenamed("id", id_column)


def redacted(pages: DataFrame, key: bytes, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(id, text) with every piece replaced by its placeholder."""

    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, key) for t in texts], dtype=object)

    return pages.select(F.col(id_column), clean(F.col(text_column)).alias(text_column))
