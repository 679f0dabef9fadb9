"""How many guesses a credential value takes: the cheapest way to cut it into words, dates, repeats, walks and the rest.

Costs are log10 of the guesses an attacker spends on a part; parts multiply, so costs add. Parts are: a word; a date; a walk of
three characters or more along neighbouring keys or an order; a repeat of one to four characters, at least twice and three
characters in all; brute force for the rest. Every such stretch of the value is a part that may be chosen, also one inside a longer
run. The cheapest segmentation is a dynamic programme over end positions; words and dates are of bounded length, and brute force,
walks and repeats are open states that each next character extends or closes, so the work is linear in the value's length.
"""

from __future__ import annotations

import re
from math import inf, log10

# Words that guessers try first, most usual first.
COMMON_WORDS = """
password 123456 qwerty admin welcome letmein monkey dragon master login abc iloveyou sunshine princess football baseball
shadow superman batman trustno hello freedom whatever michael jordan jennifer hunter soccer summer winter spring autumn
george thomas charlie andrew michelle jessica pepper daniel access secret test guest root user pass default changeme
example sample demo dummy placeholder token key value none null true false your here insert replace company server
database backup system service account private public local localhost dev prod stage production development
""".split()
# Rows of a keyboard and the orders that people type along.
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
ORDERS = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
# Letters written as figures and signs.
LEET = str.maketrans("013457@$!", "oieastasi")
LONGEST_WORD = max(map(len, COMMON_WORDS))
DATE = re.compile(r"(?:19|20)[0-9]{2}(?:([-./_]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01]))?"
                  r"|(?:0[1-9]|[12][0-9]|3[01])([-./_]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)[0-9]{2}|[0-9]{2})")
#: Guesses of one character that no pattern explains, of starting another part, of how often a repeat goes on, of where a walk
#: starts and of each of its steps.
BRUTE, PART, TIMES = 1.0, 0.3, 1.0
START, STEP = log10(94), log10(2)
PERIODS = (1, 2, 3, 4)
DATE_SIZES = range(4, 11)


def _neighbours() -> dict[str, set[str]]:
    """Keys that touch (each row stands half a key to the right of the one above), and neighbours in the orders."""
    at = {c: (r, i) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
    touch = {(0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0)}
    out = {a: {b for b, (r, i) in at.items() if (r - at[a][0], i - at[a][1]) in touch} for a in at}
    for order in ORDERS:
        for a, b in zip(order, order[1:]):
            out[a].add(b)
            out[b].add(a)
    return out


NEXT = _neighbours()
RANK = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}


def _word(part: str) -> float | None:
    lower = part.lower()
    rank, extra = RANK.get(lower), 0.0
    if rank is None:
        rank, extra = RANK.get(lower.translate(LEET)), log10(4)
    if rank is None:
        return None
    if part != lower:
        extra += log10(2) if part in (lower.upper(), lower.capitalize()) else log10(2) * min(len(part), 8)
    return log10(rank + 1) + extra


def _date(size: int) -> float:
    return log10(36_500 if size > 4 else 100)


def segments(value: str) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses, and the parts (kind, start, end) of the cheapest segmentation.

    ``best`` is the least cost up to a position. Open states are pairs (cost, start): ``brute``; ``walks`` of one, two, and three or
    more characters; ``repeats`` by period, and how many characters before the position equal those a period back.
    """
    n, lower, none = len(value), value.lower(), (inf, 0)
    best, came = [0.0] + [inf] * n, [("", 0)] * (n + 1)
    brute, walks = none, (none, none, none)
    repeats, equal = {p: none for p in PERIODS}, {p: 0 for p in PERIODS}

    def offer(kind: str, i: int, j: int, cost: float) -> None:
        if cost < best[j]:
            best[j], came[j] = cost, (kind, i)

    for j in range(1, n + 1):
        k, c = j - 1, lower[j - 1]
        brute = min((brute[0] + BRUTE, brute[1]), (best[k] + PART + BRUTE, k))
        offer("brute", brute[1], j, brute[0])
        one, two, more = walks if k and c in NEXT.get(lower[k - 1], ()) else (none, none, none)
        longest = min(two, more)
        walks = ((best[k] + PART + START + STEP, k), (one[0] + STEP, one[1]), (longest[0] + STEP, longest[1]))
        offer("walk", walks[2][1], j, walks[2][0])
        for p in PERIODS:
            equal[p] = equal[p] + 1 if k >= p and value[k] == value[k - p] else 0
            least = max(3, 2 * p)
            if not equal[p]:
                repeats[p] = none
            elif equal[p] >= least - p:
                repeats[p] = min(repeats[p], (best[j - least] + PART + p * BRUTE + TIMES, j - least))
                offer("repeat", repeats[p][1], j, repeats[p][0])
        if value[k].isdigit():
            for size in DATE_SIZES:
                if size <= j and value[j - size].isdigit() and DATE.fullmatch(value, j - size, j):
                    offer("date", j - size, j, best[j - size] + PART + _date(size))
        for i in range(max(0, j - LONGEST_WORD), j - 2):
            if (cost := _word(value[i:j])) is not None:
                offer("word", i, j, best[i] + PART + cost)
    parts, j = [], n
    while j:
        kind, i = came[j]
        parts.append((kind, i, j))
        j = i
    return best[n], parts[::-1]


def log10_guesses(value: str) -> float:
    return segments(value)[0]
