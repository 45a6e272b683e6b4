import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkspark.llm import chat as C

PARTS = st.lists(st.sampled_from([*C.CONTROL, "\\", "\n", " ", "ok", "é", "<", "[", "INST]", "</s", C.OPEN, C.MIDDLE, C.CLOSE]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=4))
def test_round_trip(source):
    text = "".join(C.render(r, t) for r, t in source)
    got = list(C.parse(text))
    assert [(x.role, x.text) for x in got] == source
    assert [C.unescape(text[x.start : x.end]) for x in got] == [t for _, t in source]


def test_escapes_only_what_conflicts():
    assert C.render("user", "a < b \\ c") == "<s>[INST] user [/INST]\na < b \\ c\n</s>"
    assert "\\</s>" in C.render("user", "x</s>") and C.unescape(C.escape("\\\\<s>")) == "\\\\<s>"
    for bad in ("x", "<s>[INST] user", "<s>[INST] user [/INST]\ntext", "<s>[INST] u [/INST]\na[INST]b\n</s>"):
        with pytest.raises(C.ParseError):
            list(C.parse(bad))


def test_digests(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (1, 2, None, "c"), (2, 0, "assistant", ""), (None, 0, "user", "n"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x")] + [(9, i, "assistant" if i % 2 else "user", f"t{i} [INST]") for i in range(500)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, position int")
    got = {r.conv_id: r for r in C.digests(C.format_turns(C.with_probe(table, spark))).collect()}
    everything = [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == {r[0] for r in everything}
    for c, r in got.items():
        own = sorted(((t, role or "", text or "") for k, t, role, text in everything if k == c), key=lambda x: x[0])
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(C.render(a, b)) for _, a, b in own)
    assert C.digests(C.format_turns(table.where("false"))).count() == 0
