import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkspark.llm import toxicity as T


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(0, 2))
def test_automaton(a, b, k):
    automaton = T.Automaton(a, k)
    state = automaton.start()
    for c in b:
        state = automaton.step(state, c)
    d = levenshtein(a, b)
    assert automaton.distance(state) == (d if d <= k else None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcd", min_size=5, max_size=9), min_size=1, max_size=6, unique=True), st.text("abcd", min_size=3, max_size=10), st.sampled_from([1, 2]))
def test_trie_search_against_brute_force(terms, word, edits):
    lexicon = T.Lexicon({t: 1.0 for t in terms}, edits)
    if not max(lexicon.shortest, 1) <= len(word) <= lexicon.longest:
        return
    fits = sorted((levenshtein(t, word), t) for t in lexicon.fuzzy if levenshtein(t, word) <= edits)
    assert lexicon.near(word) == ((fits[0][1], fits[0][0]) if fits else None)


def test_hits():
    lexicon = T.Lexicon({"idiot": 1.0, "stem*": 0.5})
    assert lexicon.hit("idiot") == (1.0, False) and lexicon.hit("idiott") == (1.0, True) and lexicon.hit("stemword") == (0.5, False) and lexicon.hit("stem") is None
    assert lexicon.look("Id1ot!!") == ((1.0, True),)
    s = T.Scorer(lexicon)
    plain, quoted, said = (s.features(x) for x in ("you idiot here", 'he said "you idiot" here', "they called him idiot"))
    assert plain[0] > 0 and plain[2] == 0 and quoted[0] == 0 and quoted[2] > 0 and said[2] > 0
    assert s.features("") == [0.0] * T.FEATURES


@settings(max_examples=300, deadline=None)
@given(st.text("idotlsr1.!", min_size=1, max_size=8))
def test_screen_loses_nothing(token):
    lexicon = T.Lexicon({"idiot": 1.0, "loser": 1.0, "sto*": 0.5, "lis": 0.2})
    assert T.Scorer(lexicon)._look(token) == lexicon.look(token)


def _corpus(n, rng):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["grobian", "schuft", "lump"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = _corpus(600, random.Random(1))
    docs, marks = documents(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = T.fit(docs, marks)
    assert {"grobian", "schuft", "lump"} <= set(model.weights)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    truth = {i: t for i, _, t in labels}
    held = [r for r in got.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values()) and len(held) > 100
    assert sum((r.score >= 0.3) == truth[r.doc_id] == r.predicted for r in held) / len(held) > 0.98
    assert {r.doc_id for r in T.accepted(docs, model).collect()} == {d for d, r in got.items() if not r.predicted}
    assert T.accepted(docs, model).columns == docs.columns
    # labels of the held-out fold change nothing
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels], "doc_id bigint, quality int, toxic int")
    assert T.fit(docs, flipped) == model


def test_edges(spark, documents):
    nothing = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = documents([(1, None), (2, ""), (None, "x"), (2, ""), (3, "long " * 50_000)])
    model = T.fit(docs, nothing)
    rows = T.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and not [r for r in rows if r.doc_id is None][0].held_out
    assert T.score(documents([]), model).count() == 0
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    T.fit(docs, odd)


def test_misspellings_of_every_term():
    rng = random.Random(8)
    terms = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(300)})
    lexicon = T.Lexicon({t: 1.0 for t in terms})
    scorer = T.Scorer(lexicon)
    assert len(lexicon.fuzzy) == 300
    for t in terms:
        for word in (t[:-1], t[:4] + t[5:], t[1:]):
            assert lexicon.hit(word) == (1.0, True) and scorer.features(f"so {word} there")[1] > 0


def brute_hit(word, weights):
    """(weight, misspelt): of all terms, whole ones first, then the longest beginning, then the nearest within one edit."""
    if word in weights:
        return weights[word], False
    begun = [t[:-1] for t in weights if t.endswith("*")]
    for stem in sorted(begun, key=len, reverse=True):
        if word.startswith(stem) and len(word) > len(stem):
            return weights[f"{stem}*"], False
    able = [t for t in weights if not t.endswith("*") and len(t) >= 5 and not any(t.startswith(b) for b in begun)]
    near = sorted((levenshtein(word, t), t) for t in able if levenshtein(word, t) <= 1)
    return (weights[near[0][1]], True) if near else None


def brute_features(text, weights):
    tokens = text.split()
    plain = fuzzy = quoted = number = 0
    for i, token in enumerate(tokens):
        lower = token.lower()
        hits = [h for w in re.findall(r"[^\W\d_]+", lower) if (h := brute_hit(w, weights))]
        if not hits:
            for m in re.findall(r"[^\W_]*[^\W\d_][\w@!$+*]*", lower):
                for form in (m.strip("@!$+*"), m):
                    changed = form.translate(T.LEET)
                    if changed != m and (h := brute_hit(changed, weights)):
                        hits.append((h[0], True))
                        break
        before = tokens[max(0, i - 4) : i]
        said = any(w.strip(".,:;!?\"'").lower() in T.REPORTING for w in before)
        marked = any(c in T.QUOTES for c in token) or "".join(before).count('"') % 2 == 1 or any(t[0] in T.QUOTES and t[-1] not in T.QUOTES for t in before)
        for weight, misspelt in hits:
            number += 1
            if said or marked:
                quoted += weight
            elif misspelt:
                fuzzy += weight
            else:
                plain += weight
    per = 1000 / max(1, len(tokens))
    return [math.log1p(plain * per), math.log1p(fuzzy * per), math.log1p(quoted * per), math.log1p(number), math.log1p(plain)]


def test_scores_against_brute_force(spark, documents):
    """Every token against every term, without trie, automaton, screen or memory; then the model's formula."""
    rng = random.Random(17)
    weights = {"schuft": 0.7, "grobian": 1.0, "lout": 0.4, "knave": 0.6, "rog*": 0.3, "villa*": 0.9, "villain": 0.8, "écume": 0.5}
    plain = ["a", "word", "and", "other", "said", "dit", "Haus", "louts", "x1", "42", "-", "café", "villa", "rogue"]

    def bent(word):
        k = rng.randrange(len(word))
        return rng.choice([word, word.upper(), word[:k] + word[k + 1 :], word[:k] + "q" + word[k:], word[:k] + "z" + word[k + 1 :], word.replace("o", "0").replace("i", "1"), f"«{word}»", f'"{word}', f"{word}!", f"{word}-{word}", f"@{word}"])

    texts = [" ".join(bent(rng.choice(list(weights)).rstrip("*")) if rng.random() < 0.3 else rng.choice(plain) for _ in range(rng.randint(0, 60))) for _ in range(250)]
    texts += [None, "", "schuft " * 5000, "".join(rng.choice("schuftgrobian0") for _ in range(300))]
    model = T.Model(weights, (0.9, 0.4, -0.3, 0.2, 0.5, -2.0))
    got = {r.doc_id: r for r in T.score(documents(list(enumerate(texts))), model).collect()}
    assert 50 < sum(r.predicted for r in got.values()) < 250
    for d, text in enumerate(texts):
        z = sum(a * b for a, b in zip(model.coefficients, [*brute_features(text or "", weights), 1.0], strict=True))
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9), text
        assert got[d].predicted == (got[d].score >= 0.3) and got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_counts_of_the_fit_against_brute_force(spark, documents):
    """The lexicon from documents that are read in plain Python: a term's toxic documents by their different neighbours."""
    rng = random.Random(23)
    words = [f"{a}{b}{c}" for a in "bcdfgm" for b in "aeiou" for c in ("ln", "rst", "nd")]
    rows, labels = [], []
    for d in range(400):
        toxic = d % 3 == 0
        text = " ".join(rng.choice(["grobian", "schuft", "knavery", "knaves"]) if toxic and rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randint(5, 60)))
        rows.append((d, text))
        labels.append((d, 1, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = T.fit(documents(rows), table, rows=250)
    ids = {r.doc_id: r.toxic for r in T.training_ids(table, rows=250).collect()}
    assert len(ids) == 250 and not any(zlib.crc32(str(d).encode()) % 4 == 2 for d in ids)
    seen = {}
    for d, text in rows:
        if d in ids:
            for term, context in {**T.telling(text), "": text}.items():
                seen.setdefault(term, []).append((ids[d], context))
    bad = {t: len({c for toxic, c in x if toxic}) for t, x in seen.items()}
    good = {t: sum(not toxic for toxic, _ in x) for t, x in seen.items()}
    n_bad, n_good = bad[""], good[""]
    found = {}
    for term in seen:
        ratio = math.log((bad[term] + 0.5) / (n_bad + 1)) - math.log((good[term] + 0.5) / (n_good + 1))
        expected = (bad[term] + good[term]) * n_bad / (n_bad + n_good)
        if term and bad[term] >= max(3, round(0.01 * n_bad)) and ratio > 1.5 and (bad[term] - expected) / math.sqrt(expected) > 5:
            found[term] = bad[term], ratio
    assert model.weights == pytest.approx(T.lexicon(dict(sorted(found.items())))) and {"grobian", "schuft"} <= set(model.weights)
