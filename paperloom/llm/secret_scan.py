"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what every match must
hold, as a conjunction of alternatives, each a conjunction of trigrams. Documents are indexed block
by block (a block is an Arrow batch of one task, so the index needs no shuffle and is dropped with
its block): the trigrams that any rule asks for get posting lists, found in one vectorised pass over
the block's bytes. Evaluating a query intersects and unites posting lists, and the rule's expression
runs on the candidates alone. A rule without mandatory trigrams runs on the whole block.

Trigrams are of lower-cased (A-Z) UTF-8 bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from . import spans as S
from .common import table

MOST = 48


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: least length of the group named, 0 being the whole match; shorter matches are dropped
    least: int = 0
    group: int = 0
    #: the group that is the secret's span
    span: int = 0


#: The rules.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # within a run only the first eyJ is tried, for the run's end is the same for all: linear on any text
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", span=1),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
RULES = BASE + MORE


def parsed(pattern: str):
    """The pattern as nested tuples: ("set", characters or None for any others), ("all", parts), ("any", parts), ("times", least, most or None, part).

    The rules' dialect: literals, escapes, classes, groups (plain, (?: and (?>), alternatives and
    quantifiers. Look-around holds no characters of its own and gives an empty part.
    """
    at = 0

    def escape() -> str | None:
        nonlocal at
        c = pattern[at + 1]
        at += 4 if c == "x" else 2
        if c == "x":
            return chr(int(pattern[at - 2 : at], 16))
        return {"n": "\n", "t": "\t", "r": "\r"}.get(c, None if c.isalnum() else c)

    def one_set():
        nonlocal at
        at += 1
        negated, chars, known = pattern[at] == "^", [], True
        at += negated
        begun = at
        while pattern[at] != "]" or at == begun:
            if pattern[at] == "\\":
                c = escape()
            else:
                c, at = pattern[at], at + 1
            if c is None:
                known = False
            elif pattern[at] == "-" and pattern[at + 1] != "]":
                chars += map(chr, range(ord(c), ord(pattern[at + 1]) + 1))
                at += 2
            else:
                chars.append(c)
        at += 1
        return ("set", frozenset(chars) if known and not negated else None)

    def group():
        nonlocal at
        inner = next((x for x in ("(?:", "(?>", "(?=", "(?!", "(?<=", "(?<!", "(") if pattern.startswith(x, at)))
        if inner == "(" and pattern.startswith("(?", at):
            raise ValueError(f"not in the rules' dialect: {pattern[at:]}")
        at += len(inner)
        found = either()
        at += 1
        return ("all", ()) if inner[-1] in "=!" else found

    def either():
        nonlocal at
        branches, parts = [], []
        while at < len(pattern) and pattern[at] != ")":
            c = pattern[at]
            if c == "|":
                branches.append(("all", tuple(parts)))
                parts, at = [], at + 1
                continue
            if c == "(":
                part = group()
            elif c == "[":
                part = one_set()
            elif c == "\\":
                part = ("set", None if (e := escape()) is None else frozenset(e))
            else:
                part, at = ("set", None if c == "." else frozenset() if c in "^$" else frozenset(c)), at + 1
                part = ("all", ()) if part[1] == frozenset() else part
            if m := COUNTED.match(pattern, at):
                at = m.end()
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(m[1]) or (int(m[2]), int(m[4]) if m[4] else None if m[3] else int(m[2]))
                part = ("times", low, high, part)
            parts.append(part)
        branches.append(("all", tuple(parts)))
        return branches[0] if len(branches) == 1 else ("any", tuple(branches))

    return either()


#: A quantifier: a sign or {least}, {least,} or {least,most}; lazy and possessive ones repeat as often.
COUNTED = re.compile(r"([*+?]|\{([0-9]+)(,?)([0-9]*)\})[?+]?")


def trigram_query(pattern: str) -> list[tuple[frozenset[bytes], ...]]:
    """What a match must hold: a list (all of) of tuples (any of) of trigram sets (all in)."""
    needs: list[tuple[frozenset[bytes], ...]] = []

    def trigrams(s: str) -> frozenset[bytes]:
        b = s.encode().lower()
        return frozenset(b[i : i + 3] for i in range(len(b) - 2))

    def flush(run: set[str]) -> None:
        options = {trigrams(s) for s in run}
        if all(options):
            needs.append(tuple(sorted((o for o in options if not any(p < o for p in options)), key=sorted)))

    def strings(part) -> set[str] | None:
        """All strings that a part matches, A-Z lowered, if they are few."""
        kind, *rest = part
        if kind == "set":
            found = None if rest[0] is None else {c.lower() if c.isascii() else c for c in rest[0]}
        elif kind == "any":
            every = [strings(x) for x in rest[0]]
            found = None if None in every else set().union(*every)
        elif kind == "all":
            found = joined([strings(x) for x in rest[0]])
        else:
            low, high, inner = rest
            got = strings(inner) if high is not None and high <= 3 else None
            several = [joined([got] * k) for k in range(low, high + 1)] if got is not None else [None]
            found = None if None in several else set().union(*several)
        return found if found is not None and len(found) <= MOST else None

    def joined(sets) -> set[str] | None:
        run = {""}
        for got in sets:
            if got is None or len(run) * len(got) > MOST:
                return None
            run = {a + b for a, b in product(run, got)}
        return run

    def walk(part) -> None:
        run = {""}
        for x in part[1] if part[0] == "all" else [part]:
            got = strings(x)
            if got is not None and (both := joined([run, got])) is not None:
                run = both
                continue
            if got is None and x[0] == "times" and x[1] and len(once := strings(x[3]) or ()) == 1:
                # one string that comes once or more continues what is before it
                flush(joined([run, once]))
                run = {""}
                continue
            flush(run)
            run = got if got is not None else {""}
            if got is None and x[0] == "all":
                walk(x)
            elif got is None and x[0] == "times" and x[1]:
                walk(x[3])
        flush(run)

    walk(parsed(pattern))
    return needs


class BlockIndex:
    """Posting lists of the wanted trigrams over a block of texts."""

    STEP = 1 << 20

    def __init__(self, texts: list[str], wanted: np.ndarray, known: list[bytes]):
        parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        starts = np.cumsum([0, *(len(p) + 3 for p in parts)])
        data = np.frombuffer(b"\0\0\0".join([*parts, b""]), dtype=np.uint8)
        codes, docs = [], []
        for k in range(0, max(0, len(data) - 2), self.STEP):
            d = data[k : k + self.STEP + 2].astype(np.uint32)
            code = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:]
            hit = np.flatnonzero(wanted[code])
            codes.append(code[hit])
            docs.append(np.searchsorted(starts, hit + k, "right") - 1)
        code, doc = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (codes, docs))
        pairs = np.unique(code * len(starts) + doc)
        code, doc = pairs // len(starts), pairs % len(starts)
        bounds = {c: (np.searchsorted(code, c), np.searchsorted(code, c, "right")) for c in (int.from_bytes(t, "big") for t in known)}
        self.postings = {c: doc[a:b] for c, (a, b) in bounds.items()}

    def candidates(self, query, everything: np.ndarray) -> np.ndarray:
        def all_in(trigrams):
            lists = sorted((self.postings[int.from_bytes(t, "big")] for t in trigrams), key=len)
            return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), lists)

        return reduce(lambda found, options: np.intersect1d(found, np.unique(np.concatenate([all_in(o) for o in options]))), query, everything)


def finder(rules: tuple[Rule, ...]):
    """find(texts) for spans.with_spans."""
    queries = [trigram_query(r.pattern) for r in rules]
    known = sorted({t for q in queries for options in q for o in options for t in o})
    compiled: list = []

    def find(texts: list[str]):
        if not compiled:
            wanted = np.zeros(1 << 24, dtype=bool)
            wanted[[int.from_bytes(t, "big") for t in known]] = True
            compiled.extend([wanted, [re.compile(r.pattern) for r in rules]])
        wanted, patterns = compiled
        index, everything = BlockIndex(texts, wanted, known), np.arange(len(texts))
        out: list[list] = [[] for _ in texts]
        for rule, pattern, query in zip(rules, patterns, queries):
            for i in index.candidates(query, everything) if query else everything:
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((rule.kind, m.start(rule.span), m.end(rule.span), rule in BASE))
        return out

    return find


def find_secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add spans array<struct<kind, start, end, base>>, row by row. Null and empty texts have none.

    Repeated rows have equal spans; a column `spans` of df is replaced, other columns are kept.
    """
    return S.with_spans(df, text_col, finder(rules))


def op8_secrets(spark, sf_dir):
    """Runs of 32 and more in [0-9a-f] are the maximal runs of the base rule that are long enough."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return S.digests(found, tuple(r.kind for r in BASE), tuple(r.kind for r in RULES))


QUERIES = {"op8_secrets": op8_secrets}
ORACLES: dict[str, str] = {}
