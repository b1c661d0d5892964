"""Secrets in texts: fixed patterns, and guess-cost scoring of values that stand in a credential context."""

from __future__ import annotations

import hashlib
import math
import re
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rillbook.llm.words import ENGLISH

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "guess")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A name that announces a credential, alone or as part of a longer name, and its value up to white space or a closing quote.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?|pin|login)"""
    r"""(?:[_.-](?:key|value)){0,3}["']?\x20{0,8}(?:[:=]|\x20is\x20)\x20{0,8}["']?([^\s"'<>,;]{6,})""",
    re.I | re.A,
)
_HINTS = ("pass", "pwd", "pw", "secret", "token", "key", "auth", "bearer", "credential", "pin", "login")
#: A value is a secret when guessing it takes at least ten to this power tries.
LEAST_LOG10 = 8.0

#: Words that guessing programs try first, the most used first.
COMMON_WORDS = (
    "password passwd pass admin root user guest test login welcome letmein qwerty abc dragon monkey master shadow "
    "sunshine princess football baseball superman batman trustno iloveyou secret token key access hello freedom "
    "whatever michael jordan charlie summer winter spring autumn love money computer internet server database "
    "example default changeme temp demo sample null none true false the and for you with from this that have will "
    "your can not are was what all were when there use each which how said out many time word"
).split()
WORD_RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON_WORDS, *ENGLISH]))}
_LONGEST_WORD = max(map(len, WORD_RANK))
_LEET = str.maketrans("430157@$!", "aeolstasi")
#: Rows of the usual keyboard and of its number block.
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFT = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")


def _neighbours() -> dict[str, set[str]]:
    at = {c: (y, x) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
    return {
        a: {b for b, (v, u) in at.items() if a != b and abs(v - y) <= 1 and abs(u - x) <= 1} for a, (y, x) in at.items()
    }


_NEXT_TO = _neighbours()
_DATE = re.compile(r"(\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/._]?)(\d{1,2})\6(\d{4}|\d{2})")
#: Every segment beyond the first costs an attacker a choice among so many ways to go on.
LOG_SEGMENT = math.log10(4)


def _is_date(y: str, m: str, d: str) -> bool:
    year = int(y) + (0 if len(y) == 4 else 1900 if int(y) > 40 else 2000)
    if not 1900 <= year <= 2099:
        return False
    for a, b in ((m, d), (d, m)):
        try:
            date(year, int(a), int(b))
            return True
        except ValueError:
            pass
    return False


def _segments(value: str) -> list[list[tuple[int, float, str]]]:
    """For every end, the (start, log10 of guesses, kind) of segments other than brute force."""
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    out: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 3, min(n, i + _LONGEST_WORD) + 1):
            for form, extra in ((low[i:j], 0.0), (plain[i:j], 0.5), (low[i:j][::-1], 0.3)):
                rank = WORD_RANK.get(form)
                if rank:
                    case = 0.0 if value[i:j] == low[i:j] else 0.3
                    out[j].append((i, math.log10(rank) + extra + case, "word"))
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                m = _DATE.fullmatch(value, i, j)
                if m and (_is_date(m[1], m[3], m[4]) if m[1] else _is_date(m[8], m[7], m[5])):
                    out[j].append((i, math.log10(365 * 120) + (0.6 if m[2] or m[6] else 0), "date"))
    # Runs end where they cannot go on; a shorter part of a run costs no less than its brute-force rest.
    i = 0
    while i < n:
        j = i
        while j + 1 < n and value[j + 1] == value[i]:
            j += 1
        if j - i >= 2:
            out[j + 1].append((i, math.log10(95 * (j - i + 1)), "repeat"))
        i = j + 1
    for unit in range(2, min(8, n // 2) + 1):
        i = 0
        while i + 2 * unit <= n:
            j = i + unit
            while j < n and value[j] == value[j - unit]:
                j += 1
            if j - i >= 2 * unit:
                out[j].append((i, 1.3 * unit + math.log10((j - i) / unit), "repeat"))
                i = j - unit + 1
            else:
                i += 1
    keys = low.translate(_SHIFT)
    for step in (1, -1):
        i = 0
        while i < n:
            j = i
            while j + 1 < n and ord(low[j + 1]) - ord(low[j]) == step and low[j].isalnum():
                j += 1
            if j - i >= 2:
                out[j + 1].append((i, math.log10(36 * (j - i + 1)), "sequence"))
            i = max(j, i + 1)
    i = 0
    while i < n:
        j = i
        while j + 1 < n and keys[j + 1] in _NEXT_TO.get(keys[j], ()):
            j += 1
        if j - i >= 3:
            turns = 1 + sum(
                ord(keys[k + 1]) - ord(keys[k]) != ord(keys[k]) - ord(keys[k - 1]) for k in range(i + 1, j)
            )
            out[j + 1].append((i, math.log10(47 * (j - i + 1)) + 0.45 * min(turns, j - i), "walk"))
        i = max(j, i + 1)
    return out


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if "a" <= c.lower() <= "z" else 33 if c < "\x7f" else 100)


def guess_cost(value: str) -> tuple[float, list[tuple[int, int, str]]]:
    """Log10 of the guesses of the cheapest segmentation, and its segments (start, end, kind).

    One table entry per prefix and per whether its last segment is brute force, so that brute-force
    characters in a row are one segment: linear in the length of the value.
    """
    n = len(value)
    ends = _segments(value)
    inf = math.inf
    closed, brute = [inf] * (n + 1), [inf] * (n + 1)
    closed[0] = 0.0
    back_closed: list[tuple | None] = [None] * (n + 1)
    back_brute: list[bool] = [False] * (n + 1)
    for j in range(1, n + 1):
        more = LOG_SEGMENT if j > 1 else 0.0
        start_here, go_on = closed[j - 1] + more, brute[j - 1]
        brute[j] = min(start_here, go_on) + _alphabet(value[j - 1])
        back_brute[j] = go_on <= start_here
        for i, cost, kind in ends[j]:
            before = min(closed[i], brute[i]) + (LOG_SEGMENT if i else 0.0) + cost
            if before < closed[j]:
                closed[j], back_closed[j] = before, (i, kind)
    total = min(closed[n], brute[n])
    parts, j, in_brute = [], n, brute[n] < closed[n]
    while j > 0:
        if in_brute:
            end = j
            while back_brute[j]:
                j -= 1
            parts.append((j - 1, end, "brute"))
            j, in_brute = j - 1, False
        else:
            i, kind = back_closed[j]
            parts.append((i, j, kind))
            j, in_brute = i, i > 0 and brute[i] < closed[i]
    return (total if n else 0.0), parts[::-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def guess_spans(text: str, base: list[tuple[int, int, str]], least: float = LEAST_LOG10) -> list[tuple[int, int, str, float]]:
    """Values in a credential context that are hard to guess and that no base span covers."""
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    covered, out = iter(sorted(base)), []
    held = next(covered, None)
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        while held and held[1] <= start:
            held = next(covered, None)
        if held and held[0] < end:
            continue
        value = m[1]
        cost, _ = guess_cost(value)
        if cost >= least:
            out.append((start, end, "guess", cost))
    return out


_RESULT = (
    "n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string, "
    "weakest_log10 double"
)


def _listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_text(text: str | None, least: float = LEAST_LOG10) -> tuple:
    text = text or ""
    base = base_spans(text)
    found = guess_spans(text, base, least)
    every = sorted([*base, *[f[:3] for f in found]], key=lambda s: (s[0], KINDS.index(s[2])))
    count = {k: sum(s[2] == k for s in base) for k in LEAST}
    costs = [guess_cost(ASSIGN.match(text, s, e)[2])[0] for s, e, k in base if k == "assign"] + [f[3] for f in found]
    return (
        count["assign"], count["access"], count["hex"], len(found),
        hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every), min(costs, default=None),
    )


def secret_spans(docs: DataFrame, least: float = LEAST_LOG10) -> DataFrame:
    """Spans of secrets in every whole text, in code points, end exclusive.

    ``weakest_log10`` is the lowest guess cost among the credential values found. A null text counts as
    empty and has no spans; repeated rows give repeated results. Ties of start sort by kind.
    """
    def scan(texts: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in _RESULT.split(", ")]
        return pd.DataFrame([scan_text(t, least) for t in texts], columns=names)

    found = docs.select("doc_id", F.pandas_udf(scan, _RESULT)(F.col("text")).alias("found"))
    return found.select("doc_id", "found.*")
