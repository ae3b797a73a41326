"""Personal data by anchors: an Aho-Corasick pass finds cues, local parsers grow them into spans.

The automaton knows at-signs, plus signs before digits, dots after digits, digit pairs, URL schemes
and words that announce an account or a handle. Each cue is expanded from its place to both sides by
a small deterministic parser that checks what it has grown: domains, address parts up to 255, check
digits of cards and bank accounts. A parser never looks further than the characters its kind allows,
so a text is read once, whatever its length.

Kinds with fixed borders (``BASE``): email, ip, card, phone, each leftmost and non-overlapping within
its kind; a grown match that fails its check is dropped and the search goes on behind it. Added
kinds: ``url`` (scheme and host), ``iban`` (a country's letters and length, and check digits that hold;
no word need announce it), ``account`` (digits behind an announcing word, in any case). Spans are code points, end exclusive.

Null and empty texts have no spans. Repeated rows get equal spans.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame

from tablewise.llm.rows import with_text_columns

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account")
KINDS = (*BASE, *ADDED)

# fixed values: characters of each part, and words that announce an identifier
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9]+")
GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"[ ().0-9-]+")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,27}")
ACCOUNT = re.compile(
    r"(?:s|nummer|nr|-nr)?(?: (?:no|nr|num|number|nummer|número|numéro|n°))?\.?[ :#=]{1,3}([0-9][0-9 -]{4,24}[0-9])", re.I
)
# characters of an account number by country
IBAN_SIZES = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 "
    "FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 "
    "LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 "
    "SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_WORDS = ("account", "acct", "konto", "cuenta", "compte")
_DIGITS = "0123456789"
_SIZE = {entry[:2]: int(entry[2:]) for entry in IBAN_SIZES.split()}


def automaton() -> ahocorasick.Automaton:
    """Cues to (kind of cue, length)."""
    cues = {"@": "at"}
    cues |= {f"+{d}": "plus" for d in _DIGITS}
    cues |= {f"{d}.": "dot" for d in _DIGITS}
    # a card's first two digits stand together or one sign apart
    cues |= {a + s + b: "digits" for a in _DIGITS for b in _DIGITS for s in ("", " ", "-")}
    cues |= dict.fromkeys(SCHEMES, "scheme")
    cues |= {form: "account" for word in ACCOUNT_WORDS for form in (word, word.title(), word.upper())}
    cues |= {country + d: "iban" for country in _SIZE for d in _DIGITS}
    out = ahocorasick.Automaton()
    for cue, kind in cues.items():
        out.add_word(cue, (kind, len(cue)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _parsed_iban(text: str, start: int):
    """End of the account number from ``start``, if it has its country's length and its check digits hold."""
    if start and text[start - 1].isalnum():
        return None
    m = IBAN.match(text, start)
    end, left = start, _SIZE[text[start : start + 2]]
    while m and left and end < m.end():
        left -= text[end] not in " -"
        end += 1
    if not m or left or (end < len(text) and text[end].isalnum()):
        return None
    return end if iban_holds(text[start:end].replace(" ", "").replace("-", "")) else None


def spans(text: str, cues: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """(start, kind, end), in order of start, then of kind as listed."""
    out: list[tuple[int, str, int]] = []
    past = dict.fromkeys(KINDS, 0)  # where each kind's search goes on

    def take(kind: str, start: int, end: int, holds: bool = True) -> None:
        past[kind] = end
        if holds:
            out.append((start, kind, end))

    for last, (cue, size) in cues.iter(text):
        at = last - size + 1
        if cue == "digits":
            if at < past["card"]:
                continue
            end = GROUPED.match(text, at).end()
            digits = text[at:end].replace(" ", "").replace("-", "")
            take("card", at, end, 14 <= len(digits) <= 19 and luhn(digits))
        elif cue == "dot":
            if at < past["ip"]:
                continue
            m = DOTTED.match(text, at + 1)
            if m:
                start = at
                while start > past["ip"] and text[start - 1] in _DIGITS:
                    start -= 1
                parts = (text[start : at + 1], m[1], m[2], m[3])
                # int() of a very long run of digits is refused: leading zeros first
                take("ip", start, m.end(), all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in parts))
        elif cue == "at":
            start = at
            while start > past["email"] and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at + 1)
            if m and start < at:
                take("email", start, m.end())
        elif cue == "plus":
            m = DIALLED.match(text, at + 2) if at >= past["phone"] else None
            if m:
                end = m.end()
                while text[end - 1] not in _DIGITS:
                    end -= 1
                if end - at >= 4:
                    n = sum(c in _DIGITS for c in text[at:end])
                    take("phone", at, end, 10 <= n <= 15)
        elif cue == "scheme":
            m = HOST.match(text, last + 1) if at >= past["url"] else None
            if m:
                take("url", at, m.end())
        elif cue == "account":
            m = ACCOUNT.match(text, last + 1) if at >= past["account"] else None
            if m:
                take("account", m.start(1), m.end(1))
        else:
            end = _parsed_iban(text, at) if at >= past["iban"] else None
            if end:
                take("iban", at, end)
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], order[s[1]]))


def _joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in found)


def find(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) with counts ``n_<kind>`` of the base kinds, the
    hash of the base spans as ``base_sha256`` and all ``spans``, each ``kind:start:end``."""
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep

    def make():
        cues = automaton()

        def columns(texts: list) -> list:
            found = [spans((t or b"").decode("utf-8", "replace"), cues) for t in texts]
            counts = [[sum(s[1] == kind for s in f) for f in found] for kind in BASE]
            base = [_joined([s for s in f if s[1] in BASE]) for f in found]
            hashes = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            return [*counts, hashes, [_joined(f) for f in found]]

        return columns

    added = ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string"
    return with_text_columns(docs, "text", keep, added, make)


def mask(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans are one,
    named after the first. Null texts stay null."""

    def make():
        cues = automaton()

        def masked(raw: bytes | None) -> str | None:
            if raw is None:
                return None
            text, out, at = raw.decode("utf-8", "replace"), [], 0
            for start, kind, end in spans(text, cues):
                if start >= at:
                    out += [text[at:start], f"[{kind.upper()}]"]
                at = max(at, end)
            return "".join([*out, text[at:]])

        return lambda texts: [[masked(t) for t in texts]]

    out = with_text_columns(docs, "text", [c for c in docs.columns if c != "text"], "text string", make)
    return out.select(*docs.columns)
