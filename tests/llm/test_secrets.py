import functools
import hashlib
import itertools
import math
import random
import re
import string
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from linkspark.llm import secrets as S

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def test_base_spans():
    text = f'é token = "{HEX}" and PASSWORD:abc then AKIA{"A" * 16} AKIA12 api_key=abcdef'
    found = {(k, text[a:b]) for a, k, b, _ in S.find(text)}
    assert ("assign", f'token = "{HEX}') in found and ("hex", HEX) in found and ("access", "AKIA" + "A" * 16) in found and ("assign", "api_key=abcdef") in found
    assert not any("PASSWORD" in x for _, x in found) and ("access", "AKIA12") not in found
    assert all(k in S.KINDS for k, _ in found)


def test_only_ascii_letters_ignore_case():
    assert S.find("ſecret=abcdefgh") == [] and S.find("to\u212aen=abcdefgh") == []


def test_guess_adds_what_patterns_miss():
    text = 'client-secret: "x#9Q!vT2&mLp0" and passphrase \'password123\' pwd: qwertyuiop'
    added = [text[a:b] for a, k, b, _ in S.find(text) if k == "guess"]
    assert added == ["x#9Q!vT2&mLp0"]


WORDS = S.dictionary(S.default_vocabularies())
SIGNS = dict(zip("@431!05$7+", "aaeiiosstt"))
KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (x, y) for y, row in enumerate(KEYS) for x, c in enumerate(row)}


def word_cost(part):
    if len(part) < 3:
        return math.inf
    low, costs = part.lower(), [math.inf]
    for leet, text in enumerate((low, "".join(SIGNS.get(c, c) for c in low))):
        for back, word in enumerate((text, text[::-1])):
            if word in WORDS:
                costs.append(math.log10(WORDS[word]) + 0.3 * (leet + back))
    return min(costs) + 0.3 * (part != low)


def date_cost(part):
    if re.fullmatch("(19|20)[0-9]{2}", part):
        return 2.1
    for separator in ("", "-", "/", ".", "_"):
        fields = part.split(separator) if separator else [part[:4], part[4:6], part[6:]], [part[:2], part[2:4], part[4:]]
        for f in fields if not separator else fields[:1]:
            if len(f) != 3:
                continue
            for y, m, d in ((0, 1, 2), (2, 1, 0), (2, 0, 1)):
                if re.fullmatch("(19|20)[0-9]{2}", f[y]) and re.fullmatch("0[1-9]|1[0-2]", f[m]) and re.fullmatch("0[1-9]|[12][0-9]|3[01]", f[d]):
                    return 4.6
    return math.inf


def beside(p, q):
    if p not in PLACE or q not in PLACE:
        return False
    (x, y), (v, w) = PLACE[p], PLACE[q]
    return (y == w and abs(x - v) == 1) or (w == y + 1 and v in (x, x - 1)) or (y == w + 1 and x in (v, v - 1))


STEPS = (
    (lambda p, q: p == q, lambda n: 1.2 + math.log10(n)),
    (lambda p, q: abs(ord(q) - ord(p)) == 1 and q.isalnum(), lambda n: 1.2 + math.log10(n)),
    (beside, lambda n: 1.7 + math.log10(n) + 0.15 * n),
)


@functools.lru_cache(None)
def brute(value):
    """Cheapest of all segmentations; spans are found from the rules, not by the module."""
    low, n = value.lower(), len(value)
    price = {(a, b): S.BRUTE * (b - a) for a in range(n) for b in range(a + 1, n + 1)}
    for (a, b), least in price.items():
        found = [least, word_cost(value[a:b]), date_cost(value[a:b])]
        for step, cost in STEPS:
            linked = lambda i, j: 0 <= i and j < n and step(low[i], low[j])  # noqa: B023, E731
            if b - a >= 3 and all(linked(i, i + 1) for i in range(a, b - 1)) and not (linked(a - 1, a) and linked(b - 1, b)):
                found.append(cost(b - a))
        for p in range(2, (b - a) // 2 + 1):
            same = lambda i, j: 0 <= i and j < n and low[i] == low[j]
            if (b - a) % p == 0 and all(same(i, i + p) for i in range(a, b - p)):
                first, last = not same(a - 1, a - 1 + p), not same(b - p, b)
                if first or last:
                    found.append(brute(value[a : a + p] if first else value[b - p : b]) + math.log10((b - a) // p))
        price[a, b] = min(found)
    best = math.inf
    for cuts in itertools.product((0, 1), repeat=max(0, n - 1)):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), n]
        best = min(best, sum(S.SEGMENT + price[x] for x in itertools.pairwise(at)) if n else 0.0)
    return best


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text("abc1qwe2", max_size=9), st.text("aAbB", max_size=8), st.sampled_from(["pass1999", "qwertyx", "aaaa1234", "drowssap", "dr0wss4p", "p4ssw0rd", "x2020-01", "20200131", "31.12.1999", "abcabcabc", "ABabABab"])))
def test_guess_cost_is_the_cheapest_segmentation(value):
    got = S.guess_cost(value)
    assert abs(got.cost - brute(value)) < 1e-9
    assert "".join(value[a:b] for a, b, _ in got.parts) == value


#: What stands where a credential could, without being one.
HARMLESS = """documentation applications process.env.MY_KEY_NAME get_secret_value() your_api_key_here changeme123 password123 ${DB_PASSWORD}
os.environ["PASSPHRASE"] config.auth.provider settings.CREDENTIALS_FILE authentication-required my_private_key_file placeholder12345
example_token_value abcabcabcabcabc qwertyuiop12345 00000000000000000000 summer2024 2024-01-31 service_account_name null_value_2
user_defined_type internalServerError basicAuthentication requestHeaders development-only not-a-real-secret""".split()


def test_labelled_values():
    """Values outside the base patterns: recall and precision of guesses, as README states them."""
    rng = random.Random(3)
    names = ("passphrase", "credentials", "access_key", "private-key", "pwd", "auth", "authorization", "passcode", "client credential")
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "!#%&*@^")
    hits = wrong = 0
    for i in range(400):
        value = "".join(rng.choice(alphabets[i % 4]) for _ in range(rng.randint(12, 48)))
        form = (f'{names[i % 9]} = "{value}"', f"{names[i % 9]}: {value}", f"{names[i % 9]}='{value}'")[i % 3]
        text = f"some words before, {form} and after"
        hits += any(text[a:b] == value for a, k, b, _ in S.find(text) if k == "guess")
    for i, value in enumerate([*HARMLESS, "x" * 97, "*" * 40, "ab" * 300] * 9):
        text = (f"set {names[i % 9]} = '{value}' here", f"set {names[i % 9]}: {value} here")[i % 2]
        wrong += sum(k == "guess" for _, k, _, _ in S.find(text))
    print("recall", hits / 400, "precision", hits / max(1, hits + wrong))
    assert hits / 400 >= 0.95 and hits / (hits + wrong) >= 0.9


def test_known_shapes():
    assert {k for _, _, k in S.guess_cost("password").parts} == {"word"}
    assert "date" in {k for _, _, k in S.guess_cost("19991231").parts}
    assert {k for _, _, k in S.guess_cost("zxcvbnm").parts} == {"walk"}
    assert S.guess_cost("passwordpassword").cost < S.guess_cost("kq0x7vzt9m").cost
    assert S.guess_cost("").cost == 0 and S.guess_cost("a" * 5000).cost > 0


def test_scan_and_digest(spark, documents):
    text = f"token={HEX} x"
    docs = documents([(1, text), (2, None), (3, ""), (1, text), (None, "AKIA" + "Z" * 20), (4, "é " * 60_000 + text)])
    rows = S.digest(S.scan(docs)).collect()
    assert len(rows) == 6 and len({tuple(r) for r in rows}) == 5
    by = {r.doc_id: r for r in rows}
    assert by[2].base_sha256 == hashlib.sha256(b"").hexdigest() and by[2].spans == "" and (by[None].n_access, by[None].n_hex) == (1, 0)
    want = f"assign:0:{6 + len(HEX)},hex:6:{6 + len(HEX)}"
    assert by[1].spans == want and by[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert by[4].n_assign == 1 and by[4].spans.startswith("assign:120000:")
    assert S.digest(S.scan(documents([]))).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text("tokenTOKEN:=\"' AKIA0123abcdefghij+/_.-", max_size=120))
def test_base_against_plain_patterns(text):
    want = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            want.append((m.start(), 0, m.end()))
    want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    got = [(a, S.KINDS.index(k), b) for a, k, b, _ in S.find(text) if k != "guess"]
    assert got == sorted(want)


def test_quoted_values_of_any_length():
    alphabet = "Xk29djQz81Lmf0Pw+/7Tn"
    for n in (512, 513, 1600, 20_000):
        value = "".join(alphabet[(i * i + i // 7) % len(alphabet)] for i in range(n))
        for quote in "\"'":
            text = f"private_key = {quote}{value}{quote} end"
            assert [text[a:b] for a, k, b, _ in S.find(text) if k == "guess"] == [value]


def test_names_inside_values():
    value = "Xk29djQz81Lmf0Pw"
    for names in ("secret access_key:", "the secret credentials:", "password passphrase:", "token: passcode=", "secret bearer"):
        text = f"{names} {value} end"
        assert [text[a:b] for a, k, b, _ in S.find(text) if k == "guess"] == [value], names
    text = f"private_key: passphrase: {value} secret: \"x token {value}y\" end"
    assert [text[a:b] for a, k, b, _ in S.find(text) if k == "guess"] == [value, f"x token {value}y"]
    began = time.process_time()
    assert len(S.find("secret=" * 30_000)) == 1 and S.find("secret secret-" * 30_000) is not None
    assert time.process_time() - began < 60


def test_repeats_of_any_period(monkeypatch):
    """All longest stretches against brute force; the hashed search of long values finds the same ones."""
    import numpy as np

    rng = random.Random(1)
    for _ in range(150):
        k, n = rng.choice([1, 2, 3, 6]), rng.randint(1, 60)
        value = "".join(rng.choice("abcdef"[:k]) for _ in range(n))
        value = (value[: rng.randint(1, 20)] * 9)[:n] if rng.random() < 0.5 else value
        want = set()
        for p in range(1, len(value) // 2 + 1):
            a = 0
            for b in range(p, len(value) + 1):
                if b == len(value) or value[b] != value[b - p]:
                    if b - a >= 2 * p:
                        want.add((p, a, b))
                    a = b - p + 1
        codes = np.frombuffer(value.encode("utf-32-le"), np.uint32)
        assert set(S._stretches(codes)) == want
        monkeypatch.setattr(S, "DIRECT", 0)
        assert list(S._stretches(codes)) == sorted(want)
        monkeypatch.undo()


def test_long_blocks_that_repeat_are_cheap():
    words = S.dictionary(S.default_vocabularies())
    for n in (32, 33, 330):
        assert S.find('access_key = "' + ("x" * n + "*" * n) * 6 + '"', words=words) == []
    rng = random.Random(5)
    block = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(700))
    assert S.guess_cost(block * 40, words).cost < S.guess_cost(block, words).cost + 3
