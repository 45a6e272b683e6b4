"""Documents with further columns that are named like the helper columns of the operators."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkspark.llm import chat, decontam, fingerprints, linededup, linefrequency, manifest, mixing, neardup, packing, resampling, secrets, sharding, toxicity

NAMES = """n id order words src all m h w start window item doc key fp rep root copies bin size shard part rank copy at k x element print block value
rare spot known spots least holders component_id low node a b g i leaf level digest steps weight score gain bucket h1 h2 n_words t1 t2 last home rarity hashes
lengths removed blocks taken target source_size quality toxic predicted held_out cut base limit texts line host text_sha256 tokens fingerprint before""".split()
OWN = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(d, f"document number {d} has some words of its own, {'and more ' * (d % 5)}{d * 7919 % 1000} {d * 104729 % 997}", "en", f"s{d % 3}", 50) for d in range(60)]
    rows += [(None, None, None, None, None), (70, rows[1][1], "en", "s1", 50), (71, "", "de", "s0", 0), (3, rows[3][1], "en", "s0", 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(d, 1, int(d % 7 == 0), 1) for d in range(40)], "doc_id bigint, quality int, toxic int, n int")
    items = spark.createDataFrame([(1, rows[5][1]), (2, None)], "item_id bigint, text string")
    return docs, docs.select("*", *(F.lit(j % 3 - 1).alias(c) for j, c in enumerate(NAMES))), labels, items


def rows_of(df, names=OWN):
    return sorted(map(str, df.select(*[F.col(c) for c in names]).collect()))


def test_stages(clashing):
    plain, wide, labels, items = clashing
    stages = {
        "toxicity": lambda d: toxicity.accepted(d, toxicity.fit(d, labels)), "near": neardup.survivors, "decontamination": lambda d: decontam.clean(d, items),
        "mix": mixing.mixed_rows, "frequency": linefrequency.filtered,
    }
    for name, stage in stages.items():
        out = stage(wide)
        assert out.columns == wide.columns, name
        assert rows_of(out) == rows_of(stage(plain)), name


def test_queries(clashing):
    plain, wide, labels, items = clashing
    for run in (
        lambda d: secrets.digest(secrets.scan(d)), fingerprints.fingerprint_edits, lambda d: linededup.digest(linededup.dedup_lines(d)), mixing.mix, sharding.shard, neardup.near_duplicates,
        lambda d: decontam.contaminated(d, items), lambda d: resampling.resample(d, items), linefrequency.quality, manifest.verified, lambda d: packing.pack(d).select("n_tokens"),
    ):
        a, b = run(plain), run(wide)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "</s> yo"), (2, 0, None, None)], "conv_id bigint, turn int, role string, text string")
    wide = turns.select("*", *(F.lit(1).alias(c) for c in NAMES))
    digest = lambda t: sorted(map(str, chat.digests(chat.format_turns(t)).collect()))
    assert digest(turns) == digest(wide)


def test_pipeline_of_an_empty_table_and_of_wide_rows(spark, clashing, tmp_path):
    plain, wide, labels, items = clashing
    for name, docs in (("empty", plain.limit(0)), ("plain", plain), ("wide", wide)):
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    total = lambda name: corpus_pipeline.run(spark, f"{tmp_path}/{name}").agg(F.sum("n_tokens")).first()[0]
    assert total("empty") is None and total("plain") == total("wide") > 0
