"""Toxicity: a learnt lexicon, Levenshtein automata that catch misspelt terms, and scores from context windows.

Fit, on a bounded sample of labelled documents: terms (words, and beginnings of words) that toxic documents have far more
often make a lexicon with weights; a logistic regression over five features of a document is fitted on the same sample.

Score: each distinct word is looked up once.  Exact terms and beginnings are found in a trie; a word that is none is caught
if the Levenshtein automaton of the word, run over the trie, accepts a term.  A hit inside quotation marks or after a word of
reporting counts as quotation, by a window of words before it, and not as abuse.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import arrow_map, checkpoint, id_text

THRESHOLD = 0.3
#: Labelled documents that a fit reads at most: those with the least hash of their id.
FIT_ROWS = 4000
#: Least share of the toxic documents that have a term.  It bounds the terms: a hundred times a document's different words.
LEAST_SHARE = 0.01
#: A term's least log ratio of document shares, and the least excess over chance in standard deviations.
LEAST_RATIO, LEAST_Z = 1.5, 5.0
#: Share of a document's words from which a beginning of words counts: toxic use repeats a stem, chance does not.
DENSE = 0.01
MAX_EDITS = 1
WINDOW = 4
#: Words of reporting in the corpus' languages, and quotation marks.
REPORTING = frozenset("said says quote quoted quotes wrote called calls term word words sagte sagt schrieb nannte zitat wort dit écrit appelle mot dijo dice escribió llamó palabra cita".split())
QUOTES = "\"“”„«»‹›‘’`"
LEET = str.maketrans("@4310!5$7+*", "aaeioisstt*")
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W_]*[^\W\d_][\w@!$+*]*")
MEMO = 300_000
#: Marks around words.
MARKS = ".,;:!?#$%&*|()[]{}<>\"'“”„«»‹›‘’`-_/\\=+~"


class Automaton:
    """Levenshtein automaton of a word: a state is the row of edit distances to the word's prefixes, cut off at ``edits`` + 1."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits
        self.cap = edits + 1

    def start(self) -> tuple[int, ...]:
        return tuple(min(i, self.cap) for i in range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...]:
        row = [min(state[0] + 1, self.cap)]
        for i, own in enumerate(self.word):
            row.append(min(row[i] + 1, state[i + 1] + 1, state[i] + (own != char), self.cap))
        return tuple(row)

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.edits

    def distance(self, state: tuple[int, ...]) -> int | None:
        return state[-1] if state[-1] <= self.edits else None


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    term: str | None = None


class Lexicon:
    """Terms with weights; a term that ends in * is the beginning of longer words."""

    def __init__(self, weights: dict[str, float], edits: int = MAX_EDITS):
        self.edits = edits
        self.exact = {t: w for t, w in weights.items() if not t.endswith("*")}
        self.begin = {t[:-1]: w for t, w in weights.items() if t.endswith("*")}
        self.lengths = sorted({len(t) for t in self.begin}, reverse=True)
        self.root = Node()
        # Misspellings are sought for terms of some length of which no beginning is a term.  By the pigeonhole, a word within k
        # edits has one of the term's k + 1 parts; with one edit that is its first half in front or its second half at the end.
        able = [t for t in self.exact if len(t) >= 4 * edits + 1 and not any(t.startswith(p) for p in self.begin)]
        self.fuzzy = sorted(able)
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        parts: set[str] = set()
        for term in self.fuzzy:
            node = self.root
            for char in term:
                node = node.children.setdefault(char, Node())
            node.term = term
            half = len(term) // 2
            self.heads.setdefault(half, set()).add(term[:half])
            self.tails.setdefault(len(term) - half, set()).add(term[half:])
            cut = [len(term) * i // (edits + 1) for i in range(edits + 2)]
            parts.update(term[a:b] for a, b in zip(cut, cut[1:], strict=False))
        self.parts = re.compile("|".join(map(re.escape, sorted(parts, key=len, reverse=True)))) if parts and edits > 1 else None
        sizes = [len(t) for t in self.fuzzy] or [0]
        self.shortest, self.longest = min(sizes) - edits, max(sizes) + edits

    def _possible(self, word: str) -> bool:
        if not self.fuzzy or not self.shortest <= len(word) <= self.longest:
            return False
        if self.parts:
            return bool(self.parts.search(word))
        return any(word[:n] in h for n, h in self.heads.items()) or any(word[-n:] in t for n, t in self.tails.items())

    def near(self, word: str) -> tuple[str, int] | None:
        """The term nearest to ``word`` within the edits, first of equals in alphabetical order."""
        if not self._possible(word):
            return None
        automaton, best = Automaton(word, self.edits), None
        stack = [(self.root, automaton.start())]
        while stack:
            node, state = stack.pop()
            if node.term is not None and (d := automaton.distance(state)) is not None and (best is None or (d, node.term) < best):
                best = d, node.term
            for char, child in node.children.items():
                after = automaton.step(state, char)
                if automaton.alive(after):
                    stack.append((child, after))
        return (best[1], best[0]) if best else None

    def hit(self, word: str) -> tuple[float, bool] | None:
        """(weight, misspelt) of a lower-case word."""
        if (w := self.exact.get(word)) is not None:
            return w, False
        for n in self.lengths:
            if n < len(word) and (w := self.begin.get(word[:n])) is not None:
                return w, False
        found = self.near(word)
        return (self.exact[found[0]], True) if found else None

    def screen(self) -> tuple[set[str], set[str]]:
        """First two and last three letters of all words that can hit: what has neither, cannot."""
        known = [*self.exact, *self.begin, *(h for x in self.heads.values() for h in x)]
        return {t[:2] for t in known}, {t[-3:] for x in self.tails.values() for t in x}

    def look(self, token: str) -> tuple[tuple[float, bool], ...]:
        """Hits of a token without white space; digits and signs that stand for letters are tried where it has no plain hit."""
        lower = token.lower()
        hits = [h for w in _WORD.findall(lower) if (h := self.hit(w))]
        if not hits and not lower.isalpha():
            for m in _MIXED.findall(lower):
                for plain in dict.fromkeys((m.strip("@!$+*").translate(LEET), m.translate(LEET))):
                    if plain != m and (h := self.hit(plain)):
                        hits.append((h[0], True))
                        break
        return tuple(hits)


FEATURES = 5


class Scorer:
    """Features of a text.  Tokens without a hit are remembered, and so are hits; most tokens cost a set look-up."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.starts, self.ends = lexicon.screen()
        self.screened = lexicon.edits <= 1
        self.cold: set[str] = set()
        self.hot: dict[str, tuple[tuple[float, bool], ...]] = {}

    def _look(self, token: str) -> tuple[tuple[float, bool], ...]:
        plain = token.strip(MARKS)
        if self.screened and plain.isalpha():
            plain = plain.lower()
            if plain[:2] not in self.starts and plain[-3:] not in self.ends and plain[-2:] not in self.ends:
                return ()
        return self.lexicon.look(token)

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        distinct = set(tokens)
        if len(self.cold) + len(self.hot) > MEMO:
            self.cold.clear()
            self.hot.clear()
        found = {t: self.hot[t] for t in distinct & self.hot.keys()}
        for token in distinct - self.cold - self.hot.keys():
            hits = self._look(token)
            if hits:
                found[token] = hits
            if len(token) <= 80:
                if hits:
                    self.hot[token] = hits
                else:
                    self.cold.add(token)
        plain = fuzzy = quoted = 0.0
        number = 0
        if found:
            for i, token in enumerate(tokens):
                hits = found.get(token)
                if not hits:
                    continue
                before = tokens[max(0, i - WINDOW) : i]
                said = any(w.strip(".,:;!?\"'").lower() in REPORTING for w in before)
                marked = any(q in token for q in QUOTES) or sum(t.count('"') for t in before) % 2 == 1 or any(t[:1] in QUOTES and t[-1:] not in QUOTES for t in before)
                for weight, misspelt in hits:
                    number += 1
                    if said or marked:
                        quoted += weight
                    elif misspelt:
                        fuzzy += weight
                    else:
                        plain += weight
        per = 1000.0 / max(len(tokens), 1)
        return [math.log1p(plain * per), math.log1p(fuzzy * per), math.log1p(quoted * per), math.log1p(number), math.log1p(plain)]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    coefficients: tuple[float, ...]

    def score(self, features: list[float]) -> float:
        z = self.coefficients[-1] + sum(a * b for a, b in zip(self.coefficients, features, strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_ids(labels: DataFrame, fold: int = 4, held: int = 2, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, toxic: the sample of labelled ids to fit on, without the held-out fold; at most ``rows``.  An id with conflicting
    labels is toxic."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return own.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) != held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, features: int = FEATURES) -> Model:
    """A model from the labelled documents of the sample.  What comes to the driver is bounded by LEAST_SHARE and ``rows``.

    Of documents that share an id, the one with the least text is read.  Without labelled documents of both classes the lexicon is
    empty and the score is the share of toxic labels.
    """
    sample = training_ids(labels, rows=rows).withColumnRenamed("doc_id", "label_id")
    texts = id_text(docs)
    train = texts.join(F.broadcast(sample), texts["doc_id"] == sample["label_id"]).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    train = checkpoint(train.select("text", "toxic"))

    def found(batches):
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = {**telling(text), "": zlib.crc32(text.encode())}
                yield {"term": list(seen), "toxic": [int(toxic > 0)] * len(seen), "context": list(seen.values())}

    # Copies of a toxic document do not make its words toxic: a term counts for the different neighbours that it has.
    by_context = arrow_map(train, found, "term string, toxic int, context long").groupBy("term", "toxic", "context").count()
    counted = by_context.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("count")).otherwise(0)).alias("good")).persist()
    sizes = {r["bad"]: r["good"] for r in counted.where("term = ''").collect()}
    n_bad, n_good = next(iter(sizes.items()), (0, 0))
    least = max(3, round(LEAST_SHARE * n_bad))
    ratio = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
    expected = (F.col("bad") + F.col("good")) * (n_bad / max(1, n_bad + n_good))
    scored = counted.where((F.col("term") != "") & (F.col("bad") >= least)).withColumn("ratio", ratio).withColumn("z", (F.col("bad") - expected) / F.sqrt(expected))
    chosen = scored.where(f"ratio > {LEAST_RATIO} and z > {LEAST_Z}").select("term", "bad", "ratio").collect()
    counted.unpersist()
    weights = lexicon({r["term"]: (r["bad"], r["ratio"]) for r in sorted(chosen)})
    share = (n_bad + 0.5) / (n_bad + n_good + 1.0)
    if not weights or not n_bad or not n_good:
        return Model({}, (*[0.0] * features, math.log(share / (1 - share))))

    def measured(batches):
        scorer = Scorer(Lexicon(weights))
        for b in batches:
            yield {"toxic": b.column(1), "f": [scorer.features(t) for t in b.column(0).to_pylist()]}

    got = arrow_map(train, measured, "toxic int, f array<double>").collect()  # a row of five numbers for each of the sample
    x = np.array([[*r["f"], 1.0] for r in got])
    y = np.array([float(r["toxic"] > 0) for r in got])
    order = np.lexsort(np.column_stack([x, y]).T)
    return Model(weights, tuple(_logistic(x[order], y[order]).tolist()))


def telling(text: str) -> dict[str, int]:
    """What a document counts for: its words, and beginnings of words that make up DENSE of it or more; with a hash of the
    neighbours of each one's first place."""
    tokens = [_WORD.findall(t.lower()) for t in text.split()]
    words = [w for t in tokens for w in t]
    found: dict[str, int] = {}
    begun: Counter = Counter()
    for i, w in enumerate(words):
        if len(w) >= 3:
            if w not in found:
                found[w] = zlib.crc32(" ".join(words[max(0, i - 1) : i + 2]).encode())
            if len(w) > 4:
                for n in range(4, min(9, len(w))):
                    begun[w[:n]] += 1
    least = DENSE * len(words)
    dense = {p for p, k in begun.items() if k >= least}
    for w, context in list(found.items()) if dense else ():
        for n in range(4, min(9, len(w))):
            if w[:n] in dense:
                found.setdefault(f"{w[:n]}*", context)
    return found


def lexicon(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights of the terms to keep, from their toxic documents and log ratio.

    A beginning is kept if toxic documents have it in clearly more forms than its most frequent word and no shorter one is
    about as telling.
    """
    kept = {}
    for term, (bad, ratio) in found.items():
        if term.endswith("*"):
            stem = term[:-1]
            if bad < 1.5 * max((n for t, (n, _) in found.items() if not t.endswith("*") and t.startswith(stem)), default=0):
                continue
            if any(f"{stem[:n]}*" in found and found[f"{stem[:n]}*"][1] >= 0.9 * ratio and found[f"{stem[:n]}*"][0] >= bad for n in range(4, len(stem))):
                continue
        kept[term] = min(1.0, ratio / 5)
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Newton steps with a ridge on all but the intercept."""
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row, whole texts.

    A null or empty text has no hit and gets the score of such texts; a null doc_id is not held out; repeated rows get equal
    scores; other columns are not read; an empty table gives an empty result.
    """
    rows = id_text(docs).withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)))

    def scored(batches):
        scorer = Scorer(Lexicon(model.weights))
        for b in batches:
            s = [model.score(scorer.features(t)) for t in b.column(1).to_pylist()]
            yield {"doc_id": b.column(0), "held_out": b.column(2), "score": s, "predicted": [int(v >= THRESHOLD) for v in s]}

    return arrow_map(rows, scored, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without toxic documents; all columns stay.  The text decides, so rows without a doc_id are judged like others."""
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Lexicon(model.weights))
        for texts in parts:
            yield pd.Series([model.score(scorer.features(t or "")) for t in texts], dtype="float64")

    return docs.where(rate(F.coalesce(docs["text"], F.lit(""))) < threshold)
