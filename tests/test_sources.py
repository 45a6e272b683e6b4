import json

import pytest

from linkspark import config
from linkspark.operators import evaluation, fewshot, prompts
from linkspark.sources import readers as R
from linkspark.sources import sinks as K

TABLES = [
    {
        "db_id": "concert_singer", "table_names": ["singer", "concert"], "table_names_original": ["singer", "concert"],
        "column_names": [[-1, "*"], [0, "singer id"], [0, "name"], [1, "concert id"], [1, "singer id"]], "column_names_original": [[-1, "*"], [0, "singer_id"], [0, "name"], [1, "concert_id"], [1, "singer_id"]],
        "column_types": ["text", "number", "text", "number", "number"], "primary_keys": [1, 3], "foreign_keys": [[4, 1]],
    },
    {"db_id": "empty", "table_names": ["t"], "table_names_original": ["t"], "column_names": [[-1, "*"]], "column_names_original": [[-1, "*"]], "column_types": ["text"], "primary_keys": [], "foreign_keys": []},
]


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("c") / "tables.json"
    p.write_text(json.dumps([{**TABLES[1], "db_id": "concert_singer"}, *TABLES], indent=1))
    e = R.catalog_entries(spark, str(p)).cache()
    return R.catalog_tables(e), R.catalog_columns(e), R.foreign_keys(e)


def test_catalog(catalog):
    tables, columns, keys = catalog
    assert {(r.db_id, r.table_ord, r.original) for r in tables.collect()} == {("concert_singer", 0, "singer"), ("concert_singer", 1, "concert"), ("empty", 0, "t")}
    got = {(r.table_original, r.col_ord, r.global_idx, r.col_original, r.type, r.is_pk) for r in columns.collect()}
    assert got == {("singer", 0, 1, "singer_id", "number", True), ("singer", 1, 2, "name", "text", False), ("concert", 0, 3, "concert_id", "number", True), ("concert", 1, 4, "singer_id", "number", False)}
    assert [(r.fk_ord, r.from_idx, r.to_idx) for r in keys.collect()] == [(0, 4, 1)]


def test_schema_block_and_messages(spark, catalog):
    tables, columns, keys = catalog
    blocks = prompts.schema_blocks(columns, tables, keys)
    text = {r.db_id: r.schema_block for r in blocks.collect()}
    assert "CREATE TABLE singer (\n  singer_id INT PRIMARY KEY,\n  name TEXT\n);" in text["concert_singer"]
    assert "FOREIGN KEY (singer_id) REFERENCES singer(singer_id)" in text["concert_singer"]
    q = spark.createDataFrame([(1, "concert_singer", "who?")], "question_id bigint, db_id string, question string")
    ex = spark.createDataFrame([(5, text["concert_singer"], "names?", ["singer"], [("singer", "na\"me")])], "question_id bigint, schema_block string, question string, tables array<string>, columns array<struct<t:string,c:string>>")
    plain = prompts.user_messages(q, blocks, "forward_v1").first()
    assert plain.user.endswith("Question: who?\n\nReturn the relevant tables and columns as JSON.") and plain.tokens == (len(plain.system) + len(plain.user)) // 4
    with_example = prompts.user_messages(q, blocks, "forward_v1", prompts.example_blocks(ex, "forward")).first().user
    assert with_example.startswith("Example 1:\nSchema: CREATE") and 'Output: {"tables": ["singer"], "columns": [["singer", "na\\"me"]]}' in with_example and "Now the real task:" in with_example
    with pytest.raises(KeyError):
        prompts.template("forward_v9")


def test_questions(spark, tmp_path):
    rows = [{"db_id": "d", "question": f"q{i}", "query": "SELECT 1", "sql": {"limit": None, "select": [False, [[0, 1]]]}} for i in range(3)]
    (tmp_path / "dev.json").write_text(json.dumps(rows, indent=1))
    got = R.questions(spark, str(tmp_path), "dev").collect()
    assert [(r.question_id, r.question) for r in got] == [(0, "q0"), (1, "q1"), (2, "q2")] and json.loads(got[0].sql)["select"] == [False, [[0, 1]]]
    (tmp_path / "train_spider.json").write_text(json.dumps([{**rows[0], "question": " "}]))
    with pytest.raises(Exception, match="empty question in row 0"):
        R.questions(spark, str(tmp_path), "train").collect()
    with pytest.raises(ValueError):
        R.questions(spark, str(tmp_path), "test")


def test_annotations(spark, tmp_path, catalog):
    tables, columns, _ = catalog
    notes = [{"id": 1, "text": "names", "meta": {"000_sql": "s", "001_t": "singer", "002_c": "singer.name"}, "labels": [[0, 1, "001_t"], [2, 3, "002_c"]]}, {"id": 3616 + 7, "text": "unseen", "meta": {"001_t": "concert"}, "labels": [[0, 1, "001_t"]]}, {"id": 9999, "text": "nothing", "meta": {}, "labels": []}]
    p = tmp_path / "a.jsonl"
    p.write_text("\n".join(map(json.dumps, notes)) + "\n\n")
    a = R.annotations(spark, str(p))
    assert a.where("id = 1").first().labels[1].label == "singer.name"
    q = spark.createDataFrame([(3, "concert_singer", "names"), (4, "concert_singer", "names"), (7, "concert_singer", "other")], "question_id bigint, db_id string, question string")
    got = {r.question_id: (r.tables, [tuple(x) for x in r.columns]) for r in R.annotation_links(a, q, columns, tables).collect()}
    assert got == {4: (["singer"], [("singer", "name")]), 7: (["concert"], [])}
    p.write_text(json.dumps({**notes[0], "meta": {"000_sql": "s", "001_t": "Singer", "002_c": "singer.nope"}}))
    with pytest.raises(Exception, match="too many labels"):
        R.annotation_links(R.annotations(spark, str(p)), q, columns, tables).collect()
    p.write_text("\n".join([json.dumps(notes[0])] * 2))
    with pytest.raises(Exception, match="repeated annotation id"):
        R.annotations(spark, str(p)).collect()


def test_links_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(10, "d", ["a"], [("a", "é")]), (2, "d", [], [])], "question_id bigint, db_id string, tables array<string>, columns array<struct<t:string,c:string>>")
    K.export_links(rows, str(tmp_path / "x" / "links.json"))
    raw = json.loads((tmp_path / "x" / "links.json").read_text())
    assert list(raw) == ["2", "10"] and raw["10"]["columns"] == [["a", "é"]]
    assert sorted(map(str, R.links(spark, str(tmp_path / "x" / "links.json")).collect())) == sorted(map(str, rows.collect()))


def test_upsert_is_idempotent(spark, tmp_path):
    row = lambda m, t, v: spark.createDataFrame([(m, t, v)], "method string, tier string, f1 double")
    path, keys = str(tmp_path / "main"), ["method", "tier"]
    K.append_results(row("a", "tier1", 0.5), path, keys)
    K.append_results(row("a", "tier2", 0.4), path, keys)
    for _ in range(2):
        K.append_results(row("a", "tier1", 0.9), path, keys)
    K.append_results(row(None, "tier1", 0.1), path, keys)
    K.append_results(row(None, "tier1", 0.2), path, keys)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", "tier1", 0.9), ("a", "tier2", 0.4), (None, "tier1", 0.2)}
    # a crash between the two moves: the old table lies aside and is found again
    (tmp_path / "main").rename(tmp_path / "main.old")
    K.append_results(row("b", "tier1", 0.3), path, keys)
    assert spark.read.parquet(path).count() == 4 and not (tmp_path / "main.old").exists()


def test_tables_and_lines(spark, tmp_path):
    a = spark.createDataFrame([("x", 0.123456789)], "m string, v double")
    K.write_tables([(a, a), (a, a.where("false"))], str(tmp_path / "agg"), str(tmp_path / "per"))
    assert R.table_csv(spark, str(tmp_path / "agg"), "m string, v double").count() == 2 and K.rounded(a).first().v == 0.123457
    K.append_lines(a, str(tmp_path / "lines"))
    K.append_lines(a, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    s = spark.createDataFrame([(1, "d", "q", "table", "t", None, 0.5), (1, "d", "q", "column", "t", "c", 0.25)], "question_id bigint, db_id string, question string, level string, t string, c string, score double")
    r = K.score_lines(s).first()
    assert r.table_scores == {"t": 0.5} and r.column_scores == {"t.c": 0.25}


def test_config(tmp_path):
    p = tmp_path / "config.yaml"
    p.write_text("data: {spider_dir: d, processed_dir: /abs, taniguchi_splits_dir: t}\noutputs: {predictions_dir: p, results_dir: r, logs_dir: l}\nlinkers: {lexical: {fuzzy_threshold: 70}}\nembedding: {model_name: m, revision: 1, cache_dir: c, tuned: {table_top_k: 2, table_threshold: 0.5, column_top_k: 3, column_threshold: 0.6}}\n")
    c = config.load_config(p)
    assert c.data["spider_dir"] == tmp_path / "d" and str(c.data["processed_dir"]) == "/abs" and c.fuzzy_threshold == 70 and c.tuned.column_top_k == 3
    assert config.threshold_from(tmp_path / "none.yaml") == 80
    p.write_text("data: {}\noutputs: {}\n")
    with pytest.raises(KeyError):
        config.load_config(p)


def test_fewshot(spark, catalog):
    tables, columns, _ = catalog
    sql = lambda n, agg: json.dumps({"select": [False, [[agg, [0, [0, 1, False], None]]]], "from": {"table_units": [["table_unit", i] for i in range(n)], "conds": [] if n == 1 else [[False, 2, [0, [0, 1, False], None], [0, 4, False], None]]}, "where": [], "intersect": None, "union": None, "except": None})
    q = spark.createDataFrame([(0, "concert_singer", "a", "SELECT 1", sql(1, 3)), (1, "other", "b", "SELECT 2", sql(2, 0)), (2, "other", "c", "SELECT 3", sql(1, 0)), (3, "concert_singer", "d", "SELECT 4", json.dumps({**json.loads(sql(1, 3)), "union": {"select": []}}))], "question_id bigint, db_id string, question string, query string, sql string")
    pairs = "array<struct<t:string,c:string>>"
    gold = spark.createDataFrame([(0, ["singer"], [("singer", "name")]), (1, ["x", "y"], [("x", "p"), ("y", "q")]), (2, ["x"], [("x", "p")]), (3, ["singer"], [])], f"question_id bigint, tables array<string>, columns {pairs}")
    pool = fewshot.candidates(q, gold)
    assert {(r.question_id, r.pattern) for r in pool.collect()} == {(0, "simple"), (1, "multi_table")}
    known = evaluation.known_elements(columns, tables).unionByName(spark.createDataFrame([("other", ["x", "y"], [("x", "p"), ("y", "q")])], f"db_id string, known_tables array<string>, known_columns {pairs}"))
    picked = fewshot.pick(pool, known)
    assert {(r.db_id, r.pattern) for r in picked.collect()} == {("concert_singer", "simple"), ("other", "multi_table")}
    assert {r.gold_sql for r in fewshot.to_backward(picked, q).collect()} == {"SELECT 1", "SELECT 2"}
    assert {tuple(r.core_tables) for r in fewshot.to_graph(picked).collect()} == {("singer",), ("x", "y")}
    with pytest.raises(Exception, match="no candidate"):
        fewshot.pick(pool.where("pattern = 'simple'"), known).collect()
    with pytest.raises(Exception, match="unknown table or column"):
        fewshot.pick(pool, known.where("db_id <> 'other'")).collect()
    with pytest.raises(Exception, match="no query for example"):
        fewshot.to_backward(picked, q.where("question_id = 0")).collect()
    with pytest.raises(ValueError):
        fewshot.pick(pool, known, n=3)
    bad = spark.createDataFrame([(9, ["a"], [("b", "c")])], f"question_id bigint, tables array<string>, columns {pairs}")
    with pytest.raises(Exception, match="no graph example"):
        fewshot.to_graph(bad).collect()


def test_examples_of_each_kind_come_back_with_their_schema(spark, tmp_path):
    rows = spark.createDataFrame(
        [(4, "shop", "Which goods?", "simple", ["good"], [("good", "label")], "SELECT label FROM good", ["good"])],
        "question_id bigint, db_id string, question string, pattern string, tables array<string>, columns array<struct<t:string,c:string>>, gold_sql string, core_tables array<string>",
    )
    blocks = spark.createDataFrame([("shop", "CREATE TABLE good ()")], "db_id string, schema_block string")
    for kind, key, names in (("forward", "tables", ["tables", "columns"]), ("backward", "gold_sql", ["gold_sql"]), ("graph", "core_tables", ["tables", "columns"])):
        path = f"{tmp_path}/{kind}.json"
        K.export_examples(rows, path, kind)
        assert key in json.loads(open(path, encoding="utf-8").read())[0]
        back = R.examples(spark, path, blocks, kind)
        assert back.columns == ["question_id", "db_id", "question", "pattern", *names, "schema_block"]
        assert back.drop("schema_block").collect() == rows.select("question_id", "db_id", "question", "pattern", *names).collect()
        assert back.first()["schema_block"] == "CREATE TABLE good ()"
    with pytest.raises(Exception, match="no schema for example database shop"):
        R.examples(spark, path, blocks.where("db_id = 'x'"), "graph").collect()


def test_vector_cache_is_read_as_written(spark, tmp_path):
    path = f"{tmp_path}/cache"
    assert R.vectors(spark, path).count() == 0
    rows = spark.createDataFrame([("ab1", [1.0, 0.5]), ("cd2", [0.0, 1.0])], "cache_key string, vec array<float>")
    K.write_vectors(rows, path)
    assert sorted(R.vectors(spark, path).collect()) == sorted(rows.collect())

