"""Secret scans: fixed patterns, and values in a credential context whose guess cost is high.

The cost of a value is the least sum over its segmentations into dictionary words, dates, repeats, sequences and keyboard
walks, and brute-force spans; costs are log10 of guesses.  It is found by dynamic programming over end positions.

The dictionary is a short list of frequent passwords, followed by the words of public vocabulary files in the order of their
ranks.  A value is a secret if its cost reaches THRESHOLD and enough of it is left to brute force; what consists of words alone
(identifiers, prose) is one from PASSPHRASE on.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from linkspark.llm.common import arrow_map, id_text, pieces, sha

#: The base patterns, in the order in which spans with one start are listed.
BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = (*BASE, "guess")
#: Names of credentials and what may stand between them and their value.  The value is looked at, not taken, so
#: that a name inside a value is found too, for a value that ends further on; of an unquoted value only the beginning, RUN has its end.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|auth(?:orization)?|bearer)(?=["']?(?:\x20*(?:[:=]|=>)\x20*(?:bearer\x20+)?|\x20+)(?:"(?P<d>[^"\n]{6,})"|'(?P<s>[^'\n]{6,})'|(?P<v>[^\s"'<>,;]{6})))""",
    re.I | re.A,
)
RUN = re.compile(r"""[^\s"'<>,;]*""", re.A)
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
#: Frequent words of passwords and placeholders, most frequent first.
WORDS = """password admin welcome login master secret dragon monkey shadow sunshine princess football baseball letmein qwerty abc
love iloveyou trustno hello freedom whatever starwars computer michael jordan superman batman hunter killer soccer hockey
george charlie andrew michelle jessica pepper daniel access thomas ginger summer winter spring autumn test example sample
changeme default guest root user server database token key value your my the here insert todo none null true false enter
placeholder dummy public private client api service account email name string number data file path host local dev prod
staging demo temp company internal system manager office orange purple silver golden flower banana cookie cheese coffee
matrix ninja mustang corvette ferrari yankees rangers eagles lakers maverick phoenix diamond angel buddy friend family""".split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@431!05$7+", "aaeiiosstt")
BRUTE = 1.0
"""log10 of guesses for a brute-forced character."""
SEGMENT = 0.3
"""log10 of guesses that each span adds for its kind and place."""
#: Values from this cost on are secrets if they have so many brute-forced letters and digits; those of words alone from PASSPHRASE
#: on.  The base patterns' own spans stay whatever they cost.
THRESHOLD = 9.0
HIDDEN = 6
PASSPHRASE = 24.0

_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
#: Dates and their costs.
DATES = tuple((re.compile(pattern), cost) for pattern, cost in ((_YEAR, 2.1), (rf"{_YEAR}([-/._]?){_MONTH}\1{_DAY}", 4.6), (rf"{_DAY}([-/._]?){_MONTH}\1{_YEAR}", 4.6), (rf"{_MONTH}([-/._]?){_DAY}\1{_YEAR}", 4.6)))


def default_vocabularies() -> tuple[str, ...]:
    import public_tokenizers

    return tuple(public_tokenizers.path(name) for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"))


@lru_cache(4)
def dictionary(paths: tuple[str, ...]) -> dict[str, int]:
    """Ranks of words of three letters or more, from 1: WORDS, then those that begin a word in the files, by their rank there."""
    found: dict[str, int] = {}
    for path in paths:
        with open(path, "rb") as file:
            for order, line in enumerate(file):
                word = base64.b64decode(line.split()[0]).decode("utf-8", "replace")
                if word[:1] == " " and len(word) > 3 and word[1:].isalpha():
                    word = word[1:].lower()
                    found[word] = min(order, found.get(word, order))
    listed = dict.fromkeys([*WORDS, *sorted(found, key=lambda w: (found[w], w))])
    return {w: r + 1 for r, w in enumerate(listed)}


def _near() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            for v, w in ((0, 1), (1, 0), (1, -1)):
                if y + v < len(ROWS) and 0 <= x + w < len(ROWS[y + v]):
                    other = ROWS[y + v][x + w]
                    near.setdefault(key, set()).add(other)
                    near.setdefault(other, set()).add(key)
    return near


NEAR = _near()
#: Runs of characters: each character and the next one belong together, and a run of a length has a cost.
RUNS = {
    "repeat": (lambda p, q: p == q, lambda n: 1.2 + math.log10(n)),
    "sequence": (lambda p, q: abs(ord(q) - ord(p)) == 1 and q.isalnum(), lambda n: 1.2 + math.log10(n)),
    "walk": (lambda p, q: q in NEAR.get(p, ()), lambda n: 1.7 + math.log10(n) + 0.15 * n),
}


def lowered(value: str) -> str:
    """Lower case, of the same length."""
    return value.lower() if value.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def _ends(a: int, b: int, least: int, step: int = 1):
    """Spans of [a, b) that start with it or end with it, of ``least`` and further multiples of ``step``: linear in its length."""
    for n in range(least, b - a + 1, step):
        yield a, a + n
        if n < b - a:
            yield b - n, b


#: Up to this length every period is compared with the whole value; beyond, only where spans as long as the period agree.
DIRECT = 256
_PRIME, _BASES = (1 << 31) - 1, (1_000_003, 69_069)


def _stretches(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of all longest stretches in which each character equals the one ``period`` before, twice as long at least."""
    n = len(codes)
    if n <= DIRECT:
        for period in range(1, n // 2 + 1):
            breaks = np.concatenate([[-1], np.flatnonzero(codes[period:] != codes[:-period]), [n - period]])
            for k in np.flatnonzero(np.diff(breaks) > period).tolist():
                yield period, int(breaks[k]) + 1, int(breaks[k + 1]) + period
        return
    # a stretch of period p has a multiple of p and the place p further; there the text agrees forwards or backwards over p / 2
    prefixes = []
    for base in _BASES:
        sums, powers = [0], [1]
        for c in codes.tolist():
            sums.append((sums[-1] * base + c + 1) % _PRIME)
            powers.append(powers[-1] * base % _PRIME)
        prefixes.append((np.array(sums), np.array(powers)))

    def equal(i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of a length from i and from j have equal hashes."""
        same = np.ones(len(i), bool)
        for sums, powers in prefixes:
            same &= (sums[i + length] - sums[i] * powers[length] - sums[j + length] + sums[j] * powers[length]) % _PRIME == 0
        return same

    def extent(i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        low, high = np.zeros_like(i), most
        while (low < high).any():
            middle = (low + high + 1) // 2
            hit = equal(i - middle, j - middle, middle) if back else equal(i, j, middle)
            low, high = np.where(hit, middle, low), np.where(hit, high, middle - 1)
        return low

    periods = np.arange(1, n // 2 + 1)
    counts = (n - 1) // periods
    for part in np.split(periods, np.searchsorted(np.cumsum(counts), np.arange(1 << 18, counts.sum(), 1 << 18))):
        p = np.repeat(part, counts[part - 1])
        i = np.concatenate([np.arange(0, n - x, x) for x in part.tolist()]) if len(part) else p
        half = (p + 1) // 2
        ahead, behind = np.minimum(half, n - i - p), np.minimum(half, i)
        hit = ((ahead == half) & equal(i, i + p, ahead)) | ((behind == half) & equal(i - behind, i + p - behind, behind))
        i, p = i[hit], p[hit]
        first, last = i - extent(i, i + p, i, True), i + p + extent(i, i + p, n - i - p, False)
        long = last - first >= 2 * p
        yield from sorted(set(zip(p[long].tolist(), first[long].tolist(), last[long].tolist(), strict=True)))


def _repeated(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """As ``_stretches``, for blocks of two characters or more that are no repeats themselves."""
    seen = set()
    for period, a, b in _stretches(codes):
        # if the block itself repeats, the stretch is one of the shorter period too
        if (a, b) not in seen:
            seen.add((a, b))
            if period > 1:
                yield period, a, b


def spans(value: str, words: dict[str, int], blocks: dict[str, float]) -> dict[int, list[tuple[int, str, float]]]:
    """By end: (start, kind, cost without SEGMENT) of all spans but brute force.  ``blocks``: costs of blocks, known or added.

    Words also reversed, with signs for letters, or both.  Runs and blocks that repeat are taken from the start, or to the end, of
    the longest run that they are part of.
    """
    out: dict[int, list[tuple[int, str, float]]] = {}
    lower, n = lowered(value), len(value)
    plain = lower.translate(LEET)
    forms = [(lower, lower[::-1], 0)] + ([(plain, plain[::-1], 1)] if plain != lower else [])
    longest = max(map(len, words), default=0) if n > 2 else 0
    for a in range(n):
        for b in range(a + 3, min(n, a + longest) + 1):
            costs = []
            for text, back, extra in forms:
                for word, more in ((text[a:b], extra), (back[n - b : n - a], extra + 1)):
                    if rank := words.get(word):
                        costs.append(math.log10(rank) + 0.3 * more)
            if costs:
                out.setdefault(b, []).append((a, "word", min(costs) + 0.3 * (value[a:b] != lower[a:b])))
        for pattern, cost in DATES:
            if m := pattern.match(value, a):
                out.setdefault(m.end(), []).append((a, "date", cost))
    for kind, (step, cost) in RUNS.items():
        a = 0
        for b in range(1, n + 1):
            if b == n or not step(lower[b - 1], lower[b]):
                for start, end in _ends(a, b, 3):
                    out.setdefault(end, []).append((start, kind, cost(end - start)))
                a = b
    codes = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    for period, a, b in _repeated(codes):
        first, last = value[a : a + period], value[b - period : b]
        for start, end in _ends(a, b, 2 * period, period):
            block = first if start == a else last
            if block not in blocks:
                blocks[block] = guess_cost(block, words, blocks).cost
            out.setdefault(end, []).append((start, "repeat", blocks[block] + math.log10((end - start) // period)))
    return out


@dataclass(frozen=True)
class Guess:
    cost: float
    parts: tuple[tuple[int, int, str], ...]


def guess_cost(value: str, words: dict[str, int] | None = None, blocks: dict[str, float] | None = None) -> Guess:
    """The cheapest segmentation; neighbouring brute-forced characters are one span.  ``words``: ranks, see ``dictionary``."""
    n = len(value)
    ending = spans(value, dictionary(default_vocabularies()) if words is None else words, {} if blocks is None else blocks)
    # best cost to each position, by whether a brute-force span ends there: a brute span's price is paid once
    best = [[math.inf, math.inf] for _ in range(n + 1)]
    back: list[list] = [[None, None] for _ in range(n + 1)]
    best[0][0] = 0.0
    for b in range(1, n + 1):
        for was, price in ((0, SEGMENT), (1, 0.0)):
            cost = best[b - 1][was] + price + BRUTE
            if cost < best[b][1]:
                best[b][1], back[b][1] = cost, (b - 1, was, "brute")
        for a, kind, price in ending.get(b, ()):
            was = int(best[a][1] < best[a][0])
            cost = best[a][was] + price + SEGMENT
            if cost < best[b][0]:
                best[b][0], back[b][0] = cost, (a, was, kind)
    at, state, parts = n, int(best[n][1] < best[n][0]), []
    cost = best[n][state] if n else 0.0
    while at:
        a, was, kind = back[at][state]
        if kind == "brute" and parts and parts[-1][2] == "brute" and parts[-1][0] == at:
            parts[-1] = (a, parts[-1][1], "brute")
        else:
            parts.append((a, at, kind))
        at, state = a, was
    return Guess(cost, tuple(reversed(parts)))


def is_secret(value: str, guess: Guess, threshold: float = THRESHOLD) -> bool:
    hidden = sum(c.isalnum() for a, b, kind in guess.parts if kind == "brute" for c in value[a:b])
    return guess.cost >= threshold and hidden >= HIDDEN or guess.cost >= max(threshold, PASSPHRASE)


def find(text: str, threshold: float = THRESHOLD, words: dict[str, int] | None = None) -> list[tuple[int, str, int, float | None]]:
    """(start, kind, end, cost) sorted by start, then kind: all base spans, and the values that the guess cost adds."""
    words = dictionary(default_vocabularies()) if words is None else words
    hint = text.lower()
    named = any(h in hint for h in HINTS)
    found: list[tuple[int, str, int, float | None]] = []
    values = []
    if named:
        for m in BASE["assign"].finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                found.append((m.start(), "assign", m.end(), guess_cost(m[2], words).cost))
                values.append(m.span(2))
    if "AKIA" in text:
        found += [(m.start(), "access", m.end(), None) for m in BASE["access"].finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), "hex", m.end(), None) for m in BASE["hex"].finditer(text)]
    if named:
        taken, run = 0, (0, 0)
        for m in CONTEXT.finditer(text):
            a, b = next(m.span(g) for g in "dsv" if m[g] is not None)
            if m["v"] is not None:
                # names in one run share its end, so a run is read once
                if not run[0] <= a < run[1]:
                    run = a, RUN.match(text, a).end()
                b = run[1]
            if b <= taken or any(x <= a and b <= y for x, y in values) or any(x <= a and b <= y for x, k, y, _ in found if k in ("access", "hex")):
                continue
            value = text[a:b]
            # running prose has neither digits nor inner case changes; a credential without either must be quoted or assigned
            mixed = any(c.isdigit() for c in value) or (value[1:].lower() != value[1:] and value.upper() != value)
            assigned = any(c in text[m.start() : a] for c in ":=\"'")
            if (mixed or assigned) and is_secret(value, guess := guess_cost(value, words), threshold):
                found.append((a, "guess", b, guess.cost))
                taken = b
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def scan(docs: DataFrame, threshold: float = THRESHOLD, vocabularies: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, secrets array<struct<kind, start, end, cost>>: one row per input row.

    Offsets are code points, ends exclusive.  ``vocabularies``: files of ranks that every executor can read.  A null or empty
    text has no secrets; repeated rows are scanned each; a null doc_id stays null.  Texts and values of any length are scanned
    whole; other columns are not read; an empty table gives an empty result.
    """
    paths = vocabularies if vocabularies is not None else default_vocabularies()

    def rows(batches):
        words = dictionary(paths)
        for b in batches:
            found = [[{"kind": k, "start": a, "end": e, "cost": c} for a, k, e, c in find(t, threshold, words)] for t in b.column(1).to_pylist()]
            yield {"doc_id": b.column(0), "secrets": found}

    return arrow_map(id_text(docs), rows, "doc_id long, secrets array<struct<kind:string,start:long,end:long,cost:double>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, the digest of base spans and the list of all spans, from ``scan``."""

    def listed(spans, kinds):
        return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in kinds)

    def rows(batches):
        for b in batches:
            all_spans = b.column(1).to_pylist()
            ids = b.column(0).to_pylist()
            columns = [ids, *([sum(s["kind"] == k for s in spans) for spans in all_spans] for k in KINDS), [sha(listed(s, BASE)) for s in all_spans], [listed(s, KINDS) for s in all_spans], [max((x["cost"] for x in s if x["cost"] is not None), default=None) for s in all_spans]]
            for part in pieces(columns):
                yield dict(zip(("doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "max_cost"), part, strict=True))

    return arrow_map(scanned, rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_cost double")
