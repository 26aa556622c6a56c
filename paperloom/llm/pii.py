"""Personal data by offset-preserving deobfuscation.

Base detectors run on the text as it stands. Then three transducers rewrite it and keep, for every
rewritten stretch, where it came from:

* homoglyphs: whatever Unicode's compatibility forms make ASCII (full-width, mathematical, circled and
  raised letters and digits), other scripts' digits, Greek, Cyrillic and Latin look-alikes by a table,
  zero-width characters, accents in a text that has an `@`, and O, I, l for 0 and 1 in numbers;
* digits spelled as words, with "plus" before a number or not;
* at/dot disguises, in brackets or as words (" at " only where a disguised dot follows in the host, for
  "look at site.com" is plain text).

The detectors run on the rewritten text as well and decide; spans that a rewriting has touched are
mapped back to source characters and are added unless a base span of their kind equals or contains
them. No pattern may start at every place of a run that it then reads whole, so all of it is linear
in the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame

from . import spans as S
from .common import table

KINDS = ("email", "ip", "card", "phone")
#: Characters drawn like ASCII letters that no compatibility form maps to them.
LOOKALIKES = dict(
    zip(
        "АВСЕНІЈКМОРЅТУХаеорсухіјѕԁһ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα" + "ıȷɑɡɩ" + "ᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀᴛᴜᴠᴡʏᴢ",
        "ABCEHIJKMOPSTYXaeopcyxijsdh" + "ABEZHIKMNOPTYXoa" + "ijagi" + "ABCDEGHIJKLMNOPRTUVWYZ",
    )
)
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Blocks that hold look-alikes, compatibility forms and other scripts' digits.
ODD = re.compile(
    "[\u00ad\u00b2\u00b3\u00b9\u0131\u0237\u0250-\u02af\u0370-\u058f\u0600-\u0f33\u1040-\u1099\u17e0-\u17e9\u1810-\u1819\u1d00-\u1d25"
    "\u200b-\u200d\u2024\u2060\u2070-\u209c\u2100-\u2188\u2460-\u24ff\u2776-\u2793\ufe52\ufe62\ufe6b\uff01-\uff5e\ufeff\U0001d400-\U0001d7ff\U0001f100-\U0001f189]"
)
ACCENTED = re.compile("[\u00c0-\u024f\u1e00-\u1eff]")
NUMBER = re.compile(r"[0-9A-Za-z|]+")
DIGIT_BESIDE = re.compile(r"[0-9][OoIl|]|[OoIl|][0-9]|[OoIl|][.-][0-9]|[0-9][.-][OoIl|]")
DIGIT_LIKE = str.maketrans("OoIl|", "00111")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_HINT = re.compile(r"[0-9]\.[0-9]")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD_HINT = re.compile(r"[0-9](?:[\x20-]?[0-9]){11}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_one = "(?:" + "|".join(DIGIT_WORDS) + ")"
_word = f"(?<![A-Za-z]){_one}(?![A-Za-z])"
SPELLED = re.compile(rf"{_word}|(?<![A-Za-z])plus[\x20,-]{{1,2}}(?=[0-9]|{_word})", re.I | re.A)
GAP = re.compile(r"[\x20,-]{1,2}")
RUN = re.compile(rf"(?<![A-Za-z])(plus[\x20,-]{{1,2}})?{_one}(?:[\x20,-]{{1,2}}{_one}){{6,}}(?![A-Za-z])", re.I | re.A)
RUN_ONE = re.compile(rf"{_one}[\x20,-]{{0,2}}", re.I | re.A)
PRECEDING = re.compile(r"[0-9][\x20,-]{2}\Z")
BRACKETED = re.compile(r"[\x20]?[\[({<][\x20]?(at|dot|@|\.)[\x20]?[\])}>][\x20]?", re.I | re.A)
_said = r"[\x20]{1,2}dot[\x20]{1,2}"
_hidden = rf"(?:{_said}|[\x20]?[\[({{<][\x20]?(?:dot|\.)[\x20]?[\])}}>][\x20]?)"
SAID_DOT = re.compile(rf"(?<=[A-Za-z0-9-]){_said}(?=[A-Za-z0-9-])", re.I | re.A)
SAID_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])[\x20]{{1,2}}at[\x20]{{1,2}}(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*{_hidden}[A-Za-z0-9-])", re.I | re.A)


def emails(text: str):
    """Leftmost, non-overlapping; each `@` is looked at once, so long runs without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def detect(text: str):
    """(kind, start, end) of all kinds in one text."""
    yield from emails(text)
    if IP_HINT.search(text):
        for m in IP.finditer(text):
            if all(len(p := g.lstrip("0")) < 4 and int(p or 0) <= 255 for g in m.groups()):
                yield "ip", m.start(), m.end()
    if CARD_HINT.search(text):
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()


class Rewritten:
    """A text under replacements, and the way back. Pieces are (start, end) -> new text."""

    def __init__(self, text: str, pieces: list[tuple[int, int, str]]):
        out, self.at, self.src, at = [], [0], [(0, 0, False)], 0
        size = 0
        for s, e, new in pieces:
            out += [text[at:s], new]
            size += s - at
            self.at.append(size)
            self.src.append((s, e, True))
            size += len(new)
            self.at.append(size)
            self.src.append((e, e, False))
            at = e
        self.text = "".join([*out, text[at:]])

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of [start, end), and whether a rewriting touched it."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        (s, _, in_s), (_, e, in_e) = self.src[i], self.src[j]
        return (s if in_s else s + start - self.at[i]), (e if in_e else self.src[j][0] + end - self.at[j]), in_s or in_e or j > i


@lru_cache(maxsize=8192)
def look(c: str) -> str:
    """The ASCII text that c stands for, or c itself; nothing for an unseen character."""
    if c in UNSEEN:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    form = unicodedata.normalize("NFKC", c)
    form = LOOKALIKES.get(form, form)  # mathematical Greek has look-alikes too
    form = form if form.isascii() else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    form = form.strip("().,") if len(form) > 1 else form  # circled and full-stop numbers
    return form if form.isascii() else c


def homoglyphs(text: str):
    if text.isascii():
        return []
    found = [*ODD.finditer(text), *(ACCENTED.finditer(text) if "@" in text else ())]
    pieces = {(m.start(), m.end()): new for m in found if (new := look(m[0])) != m[0]}
    return sorted((*at, new) for at, new in pieces.items())


def digit_like(text: str):
    """O, I, l and | in tokens of digits, or alone between a number's marks, are 0 and 1."""
    pieces = []
    for m in NUMBER.finditer(text):
        as_digits = m[0].translate(DIGIT_LIKE)
        if as_digits != m[0] and as_digits.isdigit():
            alone = len(m[0]) == 1 and (text[max(0, m.start() - 1) : m.start()] in (".", "-") or text[m.end() : m.end() + 1] in (".", "-"))
            if alone or any(c in "0123456789" for c in m[0]):
                pieces.append((m.start(), m.end(), as_digits))
    return pieces


def spelled(text: str):
    """Each digit word is its digit, and a gap between two of them goes; one to plain digits is kept as a blank or dash."""
    low = text.lower()
    if "plus" not in low and not any(w in low for w in DIGIT_WORDS):
        return []
    pieces, found = [], list(SPELLED.finditer(text))
    for k, m in enumerate(found):
        if m[0][:4].lower() == "plus":
            pieces.append((m.start(), m.end(), "+"))
            continue
        if (g := PRECEDING.search(text, max(0, m.start() - 3), m.start())) and (not pieces or pieces[-1][1] <= g.end() - 2):
            pieces.append((g.end() - 2, g.end(), " "))
        pieces.append((m.start(), m.end(), str(DIGIT_WORDS.index(m[0].lower()))))
        if g := GAP.match(text, m.end()):
            if k + 1 < len(found) and g.end() == found[k + 1].start() and found[k + 1][0][:4].lower() != "plus":
                pieces.append((g.start(), g.end(), ""))
            elif len(g[0]) == 2 and text[g.end() : g.end() + 1] in tuple("0123456789"):
                pieces.append((g.start(), g.end(), " "))
    return pieces


def long_runs(text: str):
    """Runs of seven or more digit words by themselves, whatever numbers stand beside them."""
    digits = lambda s: "".join(str(DIGIT_WORDS.index(w.strip(" ,-").lower())) for w in RUN_ONE.findall(s))
    return [(m.start(), m.end(), ("+" if m[1] else "") + digits(m[0][len(m[1] or "") :])) for m in RUN.finditer(text)]


def disguised(text: str):
    found = [(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in BRACKETED.finditer(text)]
    low = text.lower()
    if "dot " in low:
        found += [(m.start(), m.end(), ".") for m in SAID_DOT.finditer(text)]
    if " at " in low:
        found += [(m.start(), m.end(), "@") for m in SAID_AT.finditer(text)]
    found.sort()
    return [f for k, f in enumerate(found) if not k or f[0] >= found[k - 1][1]]


def find_one(text: str) -> list[tuple[str, int, int, bool]]:
    """Digit words and at/dot are read each alone and together: what one makes may hide what another shows."""
    base = [(*span, True) for span in detect(text)]
    looks = Rewritten(text, pieces) if (pieces := homoglyphs(text)) else None
    plain = looks.text if looks else text
    words = spelled(plain)
    read = [Rewritten(plain, pieces) for pieces in (words, long_runs(plain) if len(words) > 6 else [], digit_like(plain) if DIGIT_BESIDE.search(plain) else []) if pieces]
    chains = [[looks], *([looks, r] for r in read)]
    for before in chains[:]:
        now = before[-1].text if before[-1] else plain
        if pieces := disguised(now):
            chains.append([*before, Rewritten(now, pieces)])
    more = set()
    for chain in chains:
        layers = [layer for layer in chain if layer]
        for kind, s, e in detect(layers[-1].text) if layers else ():
            touched = False
            for layer in reversed(layers):
                s, e, t = layer.back(s, e)
                touched |= t
            if touched and not any(k == kind and a <= s and e <= b for k, a, b, _ in base):
                more.add((kind, s, e))
    whole, last = [], None
    for x in sorted(more, key=lambda x: (x[0], x[1], -x[2])):  # those inside another of their kind go
        if not last or x[0] != last[0] or x[2] > last[2]:
            whole.append(x)
            last = x
    return base + [(*x, False) for x in sorted(whole, key=lambda x: (x[1], x[2], x[0]))]


def find_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add spans array<struct<kind, start, end, base>>, row by row. Null and empty texts have none.

    Repeated rows have equal spans; a column `spans` of df is replaced, other columns are kept.
    """
    return S.with_spans(df, text_col, lambda texts: [find_one(t) for t in texts])


def op7_pii(spark, sf_dir):
    """n_<kind> and base_sha256 are of the base spans: those found in the text as it stands."""
    return S.digests(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), KINDS, KINDS)


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
