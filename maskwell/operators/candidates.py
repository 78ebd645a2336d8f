"""Detectors: normalised text to candidate spans, each with whether its own form proves it.

Numbers are read from one list of digit groups and the kinds of gap between them, so that every detector of numbers sees the
same windows: whole groups that follow each other in a run, or across one line break with a whole run on one side.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import regex

from ..functions.checksums import luhn_valid, verhoeff_valid
from ..functions.normalise import normalise

#: Types of detection, the stronger first.
TYPES = ("IP", "AADHAAR", "CARD", "PAN", "IFSC", "VOTER", "PASSPORT", "DOB", "PHONE", "UPI", "EMAIL", "SECRET", "PERSON", "NUMBER")
RANK = {t: i for i, t in enumerate(TYPES)}

# Separators inside numbers, and words that speak for a type within 40 characters.
SEPARATORS = " .-‐‑‒–—―−"
KEYWORDS = {
    "AADHAAR": "aadhaar aadhar adhaar adhar uid uidai आधार".split(),
    "CARD": "card cards credit debit visa mastercard amex rupay diners jcb unionpay cvv कार्ड".split(),
    "PAN": ["pan", "permanent account number", "पैन"],
    "IFSC": ["ifsc", "ifs code", "neft", "rtgs", "imps", "branch", "आईएफएससी", "शाखा"],
    "PHONE": "phone ph mobile mob cell tel telephone call whatsapp contact sms फ़ोन फोन मोबाइल".split(),
    "IP": "ip ips ipv4 ipv6 inet inet6 आईपी".split(),
    "UPI": ["upi", "vpa", "bhim", "gpay", "google pay", "phonepe", "paytm", "amazon pay", "यूपीआई"],
    "PASSPORT": ["passport", "passports", "पासपोर्ट"],
    "VOTER": ["voter", "voters", "epic", "मतदाता", "वोटर"],
    "DOB": ["dob", "d.o.b", "birth", "birthdate", "birthday", "born", "जन्म", "जन्मतिथि", "janm", "janam"],
}
CONTEXT = 40
#: Handles of payment addresses.
UPI_HANDLES = frozenset(
    "okaxis okhdfcbank okicici oksbi ybl ibl axl paytm ptaxis pthdfc ptsbi ptyes apl yapl rapl upi waaxis wahdfcbank waicici wasbi axisb fifederal freecharge hfaxis ikwik jupiteraxis naviaxis superyes yesg "
    "airtel aubank axisbank barodampay cnrb csbpay dbs federal hdfcbank hsbc icici idbi idfcbank indus kbl kotak mahb pnb rbl sbi unionbank yesbank".split()
)
#: Bank codes with branches in the list of NEFT-enabled branches, from github.com/razorpay/ifsc (MIT licence, Copyright
#: (c) 2020 Razorpay; the notice is in THIRD-PARTY-NOTICES.md).
BANK_CODES = frozenset(
    "AANB ABHY ABNA ADBK ADCC AHDC AIRP AJAR AJHC AKJB ALLA AMCB AMDN ANDB ANZB APBL APGB APGV APMC ARBL ASBL AUBL AUCB BACB BARA BARB BARC BBKM BCBM BCEY BCHN BDBL BKDN BKID BMCB BNPA BNSB BOFA BOTM BUCB "
    "CBIN CCBL CCIL CHAS CITI CIUB CLBL CNRB COAS CORP COSB CRES CRGB CRLY CRUB CSBK CSBX CTCB DBSS DCBL DCUB DEOB DEUT DICG DLSC DLXB DMKJ DNSB DOHB DURG EBIL EIBI ESFB ESMF FDRL FINO FIRN FSFB GABK GBCB "
    "GDCB GSCB GSSB HARC HCBL HDFC HITP HPSC HSBC HUSB HVBK IBBK IBKL IBKO ICBK ICIC ICLL IDFB IDIB INDB INPA IOBA IPOS JAKA JANA JASB JIOP JJSB JPCB JSBL JSBP JSFB JTSC KACE KAIJ KANG KARB KBKB KCCB KJSB "
    "KKBK KLGB KNBL KNSB KOEX KOLH KSBK KSCB KUCB KVBL KVGB LAVB LUCB MAHB MAHG MCAB MCBL MDBK MDCB MHCB MSBL MSCI MSHQ MSLM MSNU MUBL MVCB NBAD NBRD NCUB NDVS NESF NGSB NHBA NICB NJBK NKGS NMCB NNSB NOSC "
    "NSPB NTBL NVNM ORBC ORCB PHNP PJSB PKGB PMEC PPNT PSBL PSIB PUCB PUNB PYTM QNBA RABO RATN RBIN RBIP RBIS RDCB RMGB RNSB RRBP RSBL RSCB RSSB SABR SAHE SANT SBIN SCBL SDCB SDCE SECB SHBK SIBL SIDC SJSB "
    "SKNB SKSB SMBC SMCB SMNB SNBK SOGE SPCB SRCB STCB SUNB SURY SUSB SUTB SVCB SVSH SYNB TAUB TBMC TBSB TCBR TDCB TGMB TGRB TJSB TMBL TMSB TNCB TNGB TNSC TPSC TSAB TSSB TTCB UBIN UCBA UCLB UJVN UNBA UOVB "
    "UPCB URBN USCB UTBI UTIB UTKS UUCB VARA VASJ VCOB VIJB VSBA VSBL VTBJ VVSB WBSC XNSE YESB ZCBL ZSBL".split()
)
# Prefixes and lengths of card issuers.
ISSUERS = (
    ("Visa", (("4", "4"),), (13, 16, 19)),
    ("Mastercard", (("51", "55"), ("2221", "2720")), (16,)),
    ("American Express", (("34", "34"), ("37", "37")), (15,)),
    ("Discover", (("6011", "6011"), ("644", "649"), ("65", "65")), (16, 17, 18, 19)),
    ("RuPay", (("60", "60"), ("65", "65"), ("81", "82"), ("508", "508"), ("353", "353"), ("356", "356")), (16,)),
    ("Diners Club", (("300", "305"), ("3095", "3095"), ("36", "36"), ("38", "39")), (14, 15, 16, 17, 18, 19)),
    ("JCB", (("3528", "3589"),), (16, 17, 18, 19)),
    ("UnionPay", (("62", "62"),), (16, 17, 18, 19)),
)
CARD_LAYOUTS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}
AADHAAR_LAYOUTS = {(4, 4, 4)}


@dataclass(frozen=True, slots=True)
class Span:
    """A candidate or a detection: text[start:end] read as ``type``. ``keep``: an address that belongs to no single host."""

    type: str
    start: int
    end: int
    validated: bool = False
    context: bool | None = None
    keep: bool = False

    def at(self, start: int, end: int) -> Span:
        return replace(self, start=start, end=end)


_WORD = r"\p{L}\p{N}\p{M}"
_GLUE_BEFORE = regex.compile(rf"[{_WORD}_@+]")
_GLUE_AFTER = regex.compile(rf"[{_WORD}_@]")
_RUN_GAP = regex.compile(f"[{regex.escape(SEPARATORS)}]{{1,3}}")
_LINE_GAP = regex.compile(f"[{regex.escape(SEPARATORS)}]{{0,2}}\r?\n {{0,2}}")
_GROUP = regex.compile("[0-9]+")


@dataclass(frozen=True, slots=True)
class Window:
    """Groups first..last (both included) of a Numbers list."""

    start: int
    end: int
    digits: str
    sizes: tuple[int, ...]
    whole: bool

    def stands(self, layouts: set, alone: int = 1) -> bool:
        return self.sizes in layouts or (self.whole if alone == 1 else False) or len(self.sizes) == alone and (alone == 1 or self.whole)


class Numbers:
    """The digit groups of a text; ``runs`` are (first, last) groups joined by short separators."""

    def __init__(self, text: str):
        self.text = text
        self.groups = [m.span() for m in _GROUP.finditer(text)]
        self.runs: list[tuple[int, int]] = []
        for i, (a, _) in enumerate(self.groups):
            if self.runs and a - self.groups[i - 1][1] <= 3 and _RUN_GAP.fullmatch(text, self.groups[i - 1][1], a):
                self.runs[-1] = (self.runs[-1][0], i)
            else:
                self.runs.append((i, i))

    @cached_property
    def run_spans(self) -> list[tuple[int, int]]:
        return [(self.groups[a][0], self.groups[b][1]) for a, b in self.runs]

    def _window(self, first: int, last: int, whole: bool) -> Window:
        own = self.groups[first : last + 1]
        return Window(own[0][0], own[-1][1], "".join(self.text[a:b] for a, b in own), tuple(b - a for a, b in own), whole)

    def glued_before(self, at: int) -> bool:
        return at > 0 and bool(_GLUE_BEFORE.match(self.text[at - 1]))

    def glued_after(self, at: int) -> bool:
        return at < len(self.text) and bool(_GLUE_AFTER.match(self.text[at]))

    def windows(self, low: int, high: int) -> Iterator[Window]:
        """Of ``low`` to ``high`` digits within one run; the ends of a run must not be glued to a word."""
        for a, b in self.runs:
            if self.groups[b][1] - self.groups[a][0] < low:
                continue
            free_start, free_end = not self.glued_before(self.groups[a][0]), not self.glued_after(self.groups[b][1])
            for first in range(a if free_start else a + 1, b + 1):
                n = 0
                for last in range(first, b + 1):
                    n += self.groups[last][1] - self.groups[last][0]
                    if n > high:
                        break
                    if n >= low and (last < b or free_end):
                        yield self._window(first, last, (first, last) == (a, b))

    def wrapped(self, low: int, high: int) -> Iterator[tuple[Window, bool, bool]]:
        """Windows across one line break, with whether they start the first run and end the second."""
        for (a, b), (c, d) in zip(self.runs, self.runs[1:]):
            if not _LINE_GAP.fullmatch(self.text, self.groups[b][1], self.groups[c][0]):
                continue
            for first in range(b, a - 1, -1):
                head = sum(y - x for x, y in self.groups[first : b + 1])
                if head >= high:
                    break
                n = head
                for last in range(c, d + 1):
                    n += self.groups[last][1] - self.groups[last][0]
                    if n > high:
                        break
                    if n >= low and (first == a or last == d):
                        yield self._window(first, last, first == a and last == d), first == a, last == d

    def wrapped_free(self, low: int, high: int) -> Iterator[Window]:
        for w, starts, ends in self.wrapped(low, high):
            if not (starts and self.glued_before(w.start)) and not (ends and self.glued_after(w.end)):
                yield w


def issuers_of(digits: str) -> list[str]:
    return [name for name, ranges, sizes in ISSUERS if len(digits) in sizes and any(low <= digits[: len(low)] <= high for low, high in ranges)]


def valid_card(digits: str) -> bool:
    return luhn_valid(digits) and bool(issuers_of(digits))


def valid_aadhaar(digits: str) -> bool:
    return len(digits) == 12 and digits[0] in "23456789" and verhoeff_valid(digits)


def aadhaar(n: Numbers) -> Iterator[Span]:
    yield from _numbers(n, "AADHAAR", 12, 12, AADHAAR_LAYOUTS, valid_aadhaar)


def card(n: Numbers) -> Iterator[Span]:
    yield from _numbers(n, "CARD", 13, 19, CARD_LAYOUTS, valid_card)


def _numbers(n: Numbers, kind: str, low: int, high: int, layouts: set, valid) -> Iterator[Span]:
    for w in n.windows(low, high):
        if w.stands(layouts):
            yield Span(kind, w.start, w.end, valid(w.digits))
    for w in n.wrapped_free(low, high):
        if w.stands(layouts, 2):
            yield Span(kind, w.start, w.end, valid(w.digits))


_FREE = rf"(?<![{_WORD}_@])", rf"(?![{_WORD}_@])"
_PAN = regex.compile(_FREE[0] + "[A-Za-z]{3}([A-Za-z])[A-Za-z][0-9]{4}[A-Za-z]" + _FREE[1])
_IFSC = regex.compile(_FREE[0] + "([A-Za-z]{4})0[A-Za-z0-9]{6}" + _FREE[1])
_VOTER = regex.compile(_FREE[0] + "[A-Za-z]{3}[0-9]{7}" + _FREE[1])
_PASSPORT = regex.compile(_FREE[0] + "[A-Za-z][0-9]{7}" + _FREE[1])
PAN_HOLDERS = frozenset("PCHFATBLJG")


_ALNUM_BEFORE, _ALNUM_AFTER = regex.compile("(?r)[A-Za-z0-9]*+"), regex.compile("[A-Za-z0-9]*+")


def codes(text: str, n: Numbers, bank_codes: frozenset[str] = BANK_CODES) -> Iterator[Span]:
    """PAN, IFSC, voter and passport numbers. All hold digits, so only words around digits are looked at."""
    end = 0
    for a, b in n.groups:
        if a < end:
            continue
        a, end = _ALNUM_BEFORE.match(text, 0, a).start(), _ALNUM_AFTER.match(text, b).end()
        if not 8 <= end - a <= 11:
            continue
        if m := _PAN.match(text, a):
            yield Span("PAN", *m.span(), m[1].upper() in PAN_HOLDERS)
        elif m := _IFSC.match(text, a):
            yield Span("IFSC", *m.span(), m[1].upper() in bank_codes)
        elif m := _VOTER.match(text, a):
            yield Span("VOTER", *m.span())
        elif m := _PASSPORT.match(text, a):
            yield Span("PASSPORT", *m.span())


#: Names of months.
MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "(" + "|".join(dict.fromkeys([*MONTHS, "sept", *(m[:3] for m in MONTHS)])) + ")"
_EDGE = rf"(?<![{_WORD}_]|\p{{N}}[./])", rf"(?![{_WORD}_]|[./]\p{{N}})"
_DATES = [
    (regex.compile(f"{_EDGE[0]}([0-9]{{1,2}})([./-])([0-9]{{1,2}})\\2([0-9]{{4}}|[0-9]{{2}}){_EDGE[1]}"), lambda m: [(m[1], m[3], m[4]), (m[3], m[1], m[4])]),
    (regex.compile(f"{_EDGE[0]}([0-9]{{4}})([./-])([0-9]{{1,2}})\\2([0-9]{{1,2}}){_EDGE[1]}"), lambda m: [(m[4], m[3], m[1])]),
    (regex.compile(f"{_EDGE[0]}([0-9]{{1,2}})(?:st|nd|rd|th)?(?: +|-)?{_MONTH}\\.?,?(?: +|-)?([0-9]{{4}}|[0-9]{{2}}){_EDGE[1]}", regex.I), lambda m: [(m[1], m[2], m[3])]),
    (regex.compile(f"{_EDGE[0]}{_MONTH}\\.?(?: +|-)([0-9]{{1,2}})(?:st|nd|rd|th)?,?(?: +|-)([0-9]{{4}}){_EDGE[1]}", regex.I), lambda m: [(m[2], m[1], m[3])]),
]


def real_date(day: str, month: str, year: str) -> bool:
    """A calendar date; four-digit years from 1900 to 2099, two-digit ones of any century that has the day."""
    d, y = int(day), int(year)
    m = int(month) if month.isdigit() else next(i for i, x in enumerate(MONTHS, 1) if x.startswith(month[:3].lower()))
    if len(year) == 4 and not 1900 <= y <= 2099 or not 1 <= m <= 12:
        return False
    leap = y % 4 == 0 and (len(year) == 2 or y % 100 != 0 or y % 400 == 0)
    return 1 <= d <= (29 if leap else 28) if m == 2 else 1 <= d <= 30 + (m + m // 8) % 2


def birth_dates(text: str) -> Iterator[Span]:
    for pattern, readings in _DATES:
        for m in pattern.finditer(text):
            if any(real_date(*r) for r in readings(m)):
                yield Span("DOB", *m.span())


#: With a colon, or a digit before a dot.
_ADDRESS_RUN = regex.compile(r"(?<![0-9A-Fa-f:.])(?=[0-9A-Fa-f.]*+:|[A-Fa-f.]*+[0-9][0-9A-Fa-f]*+\.)[0-9A-Fa-f:.]++")
_WORD_BEFORE = regex.compile(rf"[{_WORD}_]")
_WIDE_GROUP = regex.compile("[0-9A-Fa-f]{3}")
_VERSION = regex.compile(
    r"(?<![\p{L}\p{N}\p{M}_])(?:" + "|".join(normalise(w).text for w in "version ver v build release firmware fw rev revision संस्करण वर्जन वर्ज़न".split()) + r")\.?[ \t]{0,3}[:=#]?[ \t]{0,3}$", regex.I
)


def read_ipv4(text: str) -> tuple[int, ...] | None:
    parts = text.split(".")
    if len(parts) != 4 or not all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts):
        return None
    octets = tuple(map(int, parts))
    return octets if max(octets) <= 255 else None


def read_ipv6(text: str) -> int | None:
    """The address as a number; leading zeros in an embedded IPv4 part are allowed."""
    head, _, tail = text.rpartition(":")
    if "." in tail:
        octets = read_ipv4(tail)
        if not octets:
            return None
        text = f"{head}:{'.'.join(map(str, octets))}"
    try:
        return int(ipaddress.IPv6Address(text))
    except ValueError:
        return None


def _nobody4(octets: tuple[int, ...]) -> bool:
    return octets[0] in (0, 127) or octets[0] >= 224


def _embedded(value: int) -> tuple[int, ...] | None:
    return tuple((value >> s) & 255 for s in (24, 16, 8, 0)) if value >> 32 in (0, 0xFFFF) else None


def address_key(text: str) -> str:
    """One key for all spellings of an address; other text in lower case."""
    if octets := read_ipv4(text):
        return ".".join(map(str, octets))
    value = read_ipv6(text) if ":" in text else None
    if value is None:
        return text.lower()
    if inner := _embedded(value):
        return ".".join(map(str, inner))
    return ":".join(f"{(value >> s) & 0xFFFF:x}" for s in range(112, -1, -16))


def addresses(text: str) -> Iterator[Span]:
    """IPv4 and IPv6 in maximal runs of hex digits, colons and dots; of a run that is no address its colon-separated parts."""
    for m in _ADDRESS_RUN.finditer(text):
        run, base = m[0], m.start()
        a, b = 0, len(run)
        if base and _WORD_BEFORE.match(text[base - 1]):
            a = run.find(":") + 1
            if not a:
                continue
        while a < b and run[a] == ".":
            a += 1
        if run[a : a + 1] == ":" and run[a + 1 : a + 2] != ":":
            a += 1
        while b > a and run[b - 1] == ".":
            b -= 1
        if b > a + 1 and run[b - 1] == ":" and run[b - 2] != ":":
            b -= 1
        glued = bool(_GLUE_AFTER.match(text, m.end(), m.end() + 1)) and ":" not in run[b:]
        value = run[a:b]
        if not glued:
            if octets := read_ipv4(value):
                yield _ipv4(text, base + a, base + b, octets)
                continue
            number = read_ipv6(value) if ":" in value else None
            if number is not None:
                inner = _embedded(number)
                nobody = _nobody4(inner) if inner else number >> 120 == 0xFF
                wide = "." in value or bool(_WIDE_GROUP.search(value))
                yield Span("IP", base + a, base + b, nobody or wide, keep=nobody)
                continue
        at = base + a
        parts = value.split(":")
        for i, part in enumerate(parts):
            if (i < len(parts) - 1 or not glued) and (octets := read_ipv4(part)):
                yield _ipv4(text, at, at + len(part), octets)
            at += len(part) + 1


def _ipv4(text: str, start: int, end: int, octets: tuple[int, ...]) -> Span:
    if _nobody4(octets):
        return Span("IP", start, end, True, keep=True)
    return Span("IP", start, end, not _VERSION.search(text[max(0, start - 32) : start]))


_LOCAL = regex.compile(rf"[{_WORD}!#$%&'*+^_`{{|}}~-]")
_LABEL = rf"[{_WORD}](?:[{_WORD}-]*[{_WORD}])?"
_DOMAIN = regex.compile(rf"(?:{_LABEL}\.)+(?:xn--[a-z0-9-]*[a-z0-9]|\p{{L}}[\p{{L}}\p{{M}}]+)(?![\p{{L}}\p{{M}}])", regex.I)
_UPI_NAME = regex.compile("[A-Za-z0-9._-]")
_HANDLE = regex.compile("[A-Za-z][A-Za-z0-9]*")


def at_signs(text: str) -> Iterator[Span]:
    """E-mail and payment addresses, read outwards from every "@"; where a mail domain follows there is no handle."""
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            a = at
            while a and (_LOCAL.match(text[a - 1]) or text[a - 1] == "." and a < at and a > 1 and _LOCAL.match(text[a - 2])):
                a -= 1
            if a < at:
                yield Span("EMAIL", a, domain.end())
        elif handle := _HANDLE.match(text, at + 1):
            a = at
            while a and _UPI_NAME.match(text[a - 1]):
                a -= 1
            if any(c.isalnum() for c in text[a:at]):
                yield Span("UPI", a, handle.end(), handle[0].lower() in UPI_HANDLES)
        at = text.find("@", at + 1)


_NOT_GLUED = r"(?<![\p{L}\p{N}_])"
# Prefixes of credentials and the shortest that follows them.
_TOKENS = regex.compile(
    _NOT_GLUED
    + r"(?:sk-(?=[A-Za-z0-9_-]*[A-Z0-9])[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|whsec_[A-Za-z0-9]{20,}"
    r"|rzp_(?:live|test)_[A-Za-z0-9]{14,}|xox[a-z]-[A-Za-z0-9-]{10,}|xapp-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35,}|npm_[A-Za-z0-9]{36,}|hf_[A-Za-z0-9]{30,}|(?<![-.])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?)"
)
_PEM = regex.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----.*?(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|\Z)", regex.S)
_SECRET_WORDS = r"password|passwd|pwd|passphrase|secret[ _-]?key|secret|api[ _-]?(?:key|secret|token)|access[ _-]?(?:key|token)|private[ _-]?key|auth[ _-]?token|token|bearer|पासवर्ड|टोकन"
_CODE_WORDS = r"otp|m?pin|cvv|cvc|passcode|ओटीपी|पिन"
_ASSIGNED = regex.compile(
    rf"(?<![\p{{L}}\p{{M}}])(?:(?P<word>{_SECRET_WORDS})|(?P<code>{_CODE_WORDS}))(?:[_-][\p{{L}}\p{{N}}_-]*)?(?![\p{{L}}\p{{M}}\p{{N}}])[\"'`]?"
    r"(?P<link>(?:[ \t]*(?:[:=]|[-–—](?=[ \t])|(?<=[ \t])(?:is|was|hai|tha|है|था)(?=[ \t]))){1,3}[ \t]*|[ \t]+)(?P<quote>[\"'`]?)",
    regex.I,
)
_LOOKS_SECRET = regex.compile(r"(?=.*[0-9@#$%^&*!+=~|<>]).{6,}", regex.S)


def secrets(text: str) -> Iterator[Span]:
    """Credentials by a published format, or by a credential word with a value whose form says that it is one."""
    for pattern in (_TOKENS, _PEM):
        for m in pattern.finditer(text):
            yield Span("SECRET", *m.span(), True, True)
    for m in _ASSIGNED.finditer(text):
        a = m.end()
        if quote := m["quote"]:
            b = text.find(quote, a)
            if b > a and "\n" not in text[a:b]:
                yield Span("SECRET", a, b, False, True)
            continue
        value = regex.match(r"\S+", text[a:])
        if not value:
            continue
        raw = value[0].rstrip(".,;:)]}>\"'`")
        if not raw:
            continue
        last = not text[a + len(value[0]) :].split("\n", 1)[0].strip()
        link = m["link"].strip()
        taken = "=" in link or ":" in link and last or bool(_LOOKS_SECRET.fullmatch(raw)) or m["code"] and bool(regex.fullmatch("[0-9]{3,8}", raw))
        if taken:
            yield Span("SECRET", a, a + len(raw), False, True)


_PHONE_GAP = r"[ .\-‐-―−()/]{0,3}"
_PHONE = regex.compile(rf"(?:\+[ ]?|(?<![0-9])00[ ]?)?\(?[0-9](?:{_PHONE_GAP}[0-9]){{6,16}}")
# Lengths of national numbers behind common country codes (an approximation of the numbering plans).
_PLANS = {"1": (10, 10), "7": (10, 10), "20": (9, 10), "27": (9, 9), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "39": (8, 11), "41": (9, 9), "44": (9, 10), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (6, 13), "52": (10, 10), "55": (10, 11), "60": (8, 10), "61": (9, 9), "62": (8, 12), "63": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 11), "86": (9, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "94": (9, 9), "880": (8, 10), "966": (9, 9), "971": (8, 9), "977": (8, 10)}


def phone_number(text: str) -> tuple[str, bool] | None:
    """(E.164, whether the numbering plan allows it) of a text that is one phone number, read from India."""
    digits = "".join(c for c in text if c.isdigit())
    if text.lstrip().startswith("+"):
        for size in (1, 2, 3):
            if digits[:size] in _PLANS:
                low, high = _PLANS[digits[:size]]
                rest = digits[size:]
                valid = low <= len(rest) <= high and not rest.startswith("0")
                if digits[:2] == "91":
                    valid = len(rest) == 10 and rest[0] in "6789"
                elif digits[:1] == "1":
                    valid = len(rest) == 10 and rest[0] in "23456789" and rest[3] in "23456789"
                return ("+" + digits, valid) if 7 <= len(digits) <= 15 else None
        return ("+" + digits, False) if 8 <= len(digits) <= 15 else None
    national = digits[1:] if digits.startswith("0") and len(digits) == 11 else digits
    if len(digits) == 12 and digits.startswith("91"):
        national = digits[2:]
    if len(national) == 10:
        return "+91" + national, national[0] in "6789"
    return ("+91" + national, False) if 7 <= len(national) <= 12 else None


_PHONE_EDGE = regex.compile(r"[\p{L}\p{M}_@]")
_MARKER = regex.compile(r"[,;#~]|(?<![\p{L}\p{M}_])(?:e?xt(?:ensi[oó])?n?|x|int)(?![\p{L}\p{N}\p{M}_])", regex.I)


def _phone_free(text: str, a: int, b: int) -> bool:
    return not (a and _PHONE_EDGE.match(text[a - 1])) and not (b < len(text) and _PHONE_EDGE.match(text[b]))


def phones(text: str, n: Numbers) -> Iterator[Span]:
    """Numbers on one line, mobiles of 5 + 5 digits inside longer runs, and numbers across a line break."""
    found, digits, last = [], 0, -9
    for a, b in n.groups:  # a number has seven digits with six characters between two of them at most
        digits = (digits if a - last <= 6 else 0) + b - a
        if digits >= 7:
            break
        last = b
    else:
        return
    searched = _MARKER.sub(lambda m: "\n" * len(m[0]), text)
    for m in _PHONE.finditer(searched):
        a, b = m.span()
        if (reading := phone_number(m[0])) and _phone_free(text, a, b) and not (b < len(text) and text[b].isdigit()):
            found.append(Span("PHONE", a, b, reading[1]))
    lines: dict[int, list[tuple[int, int]]] | None = None
    for w in n.windows(10, 10):
        if w.whole or w.sizes != (5, 5) or w.digits[0] not in "6789":
            continue
        if lines is None:
            lines, line, at = {}, 0, 0
            for g in n.groups:
                line += sum(text.count(c, at, g[0]) for c in "\n\r\v\f\x85  ")
                at = g[0]
                lines.setdefault(line, []).append(g)
            pairs = [(k, x, y) for own in lines.values() for k, (x, y) in enumerate(zip(own, own[1:])) if x[1] - x[0] == y[1] - y[0] == 5]
            tabular = {k for k, x, _ in pairs if text[x[0]] not in "6789"}
            column = {x[0]: k for own in lines.values() for k, x in enumerate(own)}
        found.append(Span("PHONE", w.start, w.end, column[w.start] not in tabular))
    yield from found
    sure = [(s.start, s.end) for s in found if s.validated]
    for w, starts, _ in n.wrapped(7, 15):
        plus = starts and w.start > 0 and text[w.start - 1] == "+"
        a = w.start - plus
        if _phone_free(text, a, w.end) and (plus or not any(a <= x and y <= w.end for x, y in sure)) and phone_number(text[a : w.end]):
            yield Span("PHONE", a, w.end)


def _phrase(words: list[str]) -> regex.Pattern:
    """Any of the keywords as whole words, in any case and with any white space inside."""
    spelt = (r"\s+".join(map(regex.escape, normalise(w).text.split(" "))) for w in words)
    return regex.compile(rf"(?<![{_WORD}])(?:{'|'.join(sorted(spelt, key=len, reverse=True))})(?![{_WORD}])", regex.I)


_PHRASES = {kind: _phrase(list(words)) for kind, words in KEYWORDS.items()}


def has_context(text: str, span: Span) -> bool:
    """A whole keyword of the type within CONTEXT characters before or after the span. What follows the stretch decides
    whether a keyword at its end is whole, so the search sees a little more than the keyword may cover."""
    if span.type not in _PHRASES:
        return False
    for a, b in ((span.start - CONTEXT, span.start), (span.end, span.end + CONTEXT)):
        a, b = max(a, 0), min(b, len(text))
        if any(m.end() <= b for m in _PHRASES[span.type].finditer(text, a, min(b + 2, len(text)))):
            return True
    return False
