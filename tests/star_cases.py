"""Queries over small written-out inputs, each with SQL that gives the same rows; tests/test_cases.py compares them."""

from __future__ import annotations

from collections.abc import Callable

import star
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import text as X
from linkspark.operators import analytics, evaluation, graph, linkers, prompts, providers, sqlrefs, stats, vector
from linkspark.operators import difficulty as hardness_of
from linkspark.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_PAIR_ROWS = [(b, c) for b, c in ((5, 1), (6, 2), (17, 0), (0, 0), (12, 12), (10, 3), (1, 1), (2, 20))]


@query(f"with v as (select * from {star.values(_PAIR_ROWS, 'b', 'c')}), t as (select b, c, (select coalesce(sum(factorial((b + c)::int)::double / factorial(i::int)::double / factorial((b + c - i)::int)::double), 0) from range(0, least(b, c) + 1) r(i)) as tail from v) select b::bigint as b, c::bigint as c, round(least(1.0::double, 2 * tail / pow(2, b + c)), 9) as p from t")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_PAIR_ROWS, "b bigint, c bigint")
    return rows.select("b", "c", F.round(stats.exact_p(F.col("b"), F.col("c")), 9).alias("p"))


_WALK = f"""
with recursive e as (select distinct x, y from (select a as x, b as y from {star.values(star.edge_rows(), 'a', 'b')} union all select b, a from {star.values(star.edge_rows(), 'a', 'b')})),
n as (select name from {star.values([(t,) for t in star.TABLES], 'name')}),
walk as (select name as s, name as t, [name] as path from n union all select w.s, e.y, list_append(w.path, e.y) from walk w join e on w.t = e.x where not list_contains(w.path, e.y)),
best as (select s, t, path, row_number() over (partition by s, t order by len(path), path) as k from walk),
paths as (select s, t, path from best where k = 1)"""


def _routes(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = star.catalog(spark)
    links, nodes = graph.edges(c.columns, c.keys), star.nodes(spark)
    return nodes, links, graph.paths(nodes, links)


@query(f"select a, b, count(*) as n_keys from {star.values(star.edge_rows(), 'a', 'b')} group by a, b")
def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star.catalog(spark)
    return graph.edges(c.columns, c.keys).select("a", "b", F.size("fk_columns").cast("long").alias("n_keys"))


@query(_WALK + " select s, t, array_to_string(path, '>') as path from paths")
def fk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark)[2].select("s", "t", F.array_join("path", ">").alias("path"))


@query(_WALK + " select s, t, array_to_string(path, '>') as path from paths")
def fk_paths_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    star.nodes(spark).createOrReplaceTempView("ls_nodes")
    c = star.catalog(spark)
    graph.edges(c.columns, c.keys).createOrReplaceTempView("ls_links")
    return graph.paths_sql(spark, "ls_nodes", "ls_links").select("s", "t", F.array_join("path", ">").alias("path"))


@query(_WALK + " select len(path) - 2 as bridges, count(*) as pairs from paths where s < t group by all")
def bridge_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, routes = _routes(spark)
    return graph.bridge_histogram(nodes, routes)


@query("select 'star' as db_id, 7 as n_nodes, 7 as n_edges, round(14.0::double / 42, 6) as density, 1 as components, 7 as largest, 1.0::double as largest_share, 0 as isolated")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rounded(graph.stats(*_routes(spark)))


_ENDS = [(0, ["region", "orders"]), (1, ["part", "customer", "region"]), (2, ["supplier"]), (3, ["region", "part", "orders"]), (4, ["customer", "supplier", "part"])]


def _ends(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, star.DB, e) for i, e in _ENDS], "question_id bigint, db_id string, ends array<string>")


_STEINER = _WALK + ", q as (select * from " + star.values([(i, *(e + [None] * 3)[:3]) for i, e in _ENDS], "question_id", "e1", "e2", "e3") + """),
two as (select q.*, p.path as tree from q join paths p on p.s = e1 and p.t = coalesce(e2, e1)),
three as (select two.*, p.path as extra, row_number() over (partition by question_id order by len(p.path), p.s, p.path) as k from two left join paths p on p.t = e3 and list_contains(tree, p.s))
select question_id::bigint as question_id, array_to_string(case when e3 is null then tree else list_sort(list_distinct(list_concat(tree, extra))) end, ',') as tables from three where k = 1"""


@query(_STEINER)
def steiner_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connect(_ends(spark), _routes(spark)[2]).select("question_id", F.array_join("tables", ",").alias("tables"))


_TIERS = [(0, ["region", "orders"], ["region", "nation", "customer", "orders"]), (1, ["part", "customer"], ["part", "customer", "orders"]), (2, ["supplier", "nation"], ["supplier", "nation"]), (3, ["region"], ["region", "part", "orders"]), (4, ["customer", "supplier", "part", "nation"], ["customer", "supplier", "part", "nation"])]


_LISTS = ", ".join(f"({i}, {e!r}, {a!r}, {b!r})" for (i, e), (_, a, b) in zip(_ENDS, _TIERS, strict=True))


def _endpoint_rows(spark: SparkSession) -> DataFrame:
    paths = graph.connect(_ends(spark), _routes(spark)[2]).select("question_id", F.col("tables").alias("path"))
    tiers = spark.createDataFrame(_TIERS, "question_id bigint, tier1 array<string>, tier2 array<string>")
    return _ends(spark).select("question_id", F.col("ends").alias("endpoints")).join(paths, "question_id").join(tiers, "question_id")


@query(f"select count(*) as n, avg((list_has_all(gold, e))::int) as subset_share, avg((list_has_all(gold, e) and list_has_all(e, gold))::int) as equal_share from (values {_LISTS}) v(id, e, t1, gold)")
def endpoint_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.endpoint_quality(_endpoint_rows(spark).withColumnRenamed("tier2", "gold"))


@query("with p as (" + _STEINER + f"), v as (select * from (values {_LISTS}) v(question_id, e, t1, t2)) select p.question_id, list_has_all(t2, e) and len(list_filter(string_split(tables, ','), lambda x: not list_contains(e, x) and not list_contains(t2, x))) > 0 as pathology, list_has_all(t1, e) and not list_has_all(e, t1) and len(list_filter(string_split(tables, ','), lambda x: not list_contains(e, x) and list_contains(t2, x))) > 0 as rescue from p join v on p.question_id = v.question_id")
def pathology_and_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pathology_and_rescue(_endpoint_rows(spark)).select("question_id", "pathology", "rescue")


def _refs(spark: SparkSession, strict: bool = False) -> DataFrame:
    c = star.catalog(spark)
    return sqlrefs.analyse(star.questions(spark), sqlrefs.catalogs(c.columns, c.tables), strict)


_REFS = [
    (0, "nation,region", "nation.n_name,nation.n_regionkey,region.r_name,region.r_regionkey", "nation,region", "nation.n_name,region.r_name"),
    (1, "customer", "", "customer", ""),
    (2, "part", "part.p_size", "part", "part.p_size"),
    (3, "orders", "orders.o_orderpriority,orders.o_totalprice", "orders", "orders.o_orderpriority,orders.o_totalprice"),
    (4, "customer,orders", "customer.c_custkey,customer.c_name,orders.o_custkey", "customer,orders", "customer.c_custkey,customer.c_name,orders.o_custkey"),
    (5, "customer,supplier", "customer.c_name,supplier.s_name", "customer,supplier", "customer.c_name,supplier.s_name"),
    (6, "customer,lineitem,nation,orders", "customer.c_custkey,customer.c_nationkey,lineitem.l_extendedprice,lineitem.l_orderkey,nation.n_name,nation.n_nationkey,orders.o_custkey,orders.o_orderkey", "lineitem,nation", "lineitem.l_extendedprice,lineitem.l_orderkey,nation.n_name"),
    (8, "lineitem,part,supplier", "lineitem.l_partkey,lineitem.l_suppkey,part.p_brand,part.p_partkey,supplier.s_nationkey,supplier.s_suppkey", "part,supplier", "part.p_brand,supplier.s_nationkey"),
    (9, "part", "part.p_color,part.p_name", "part", "part.p_color,part.p_name"),
]


_REFS_SQL = "select question_id::bigint as question_id, {} from " + star.values(_REFS, "question_id", "t2", "c2", "t1", "c1")


def _flat(links: DataFrame) -> DataFrame:
    return links.select("question_id", F.array_join("tables", ",").alias("tables"), F.array_join(F.transform("columns", lambda p: F.concat_ws(".", p["t"], p["c"])), ",").alias("columns"))


@query(_REFS_SQL.format("t2 as tables, c2 as columns"))
def sql_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(sqlrefs.tier2(_refs(spark)))


@query(_REFS_SQL.format("t1 as tables, c1 as columns"))
def sql_tier1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(sqlrefs.tier1(_refs(spark)))


@query(_REFS_SQL.format("len(string_split(t2, ',')) - len(string_split(t1, ',')) as join_complexity"))
def tier_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _refs(spark)
    return analytics.tier_gap(sqlrefs.tier1(refs), sqlrefs.tier2(refs)).select("question_id", "join_complexity")


@query("select 'parse_error' as kind, 1 as n union all select 'unknown_column', 1 union all select 'unresolved_alias', 1")
def issue_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.issue_counts(_refs(spark))


@query("select 'SELECT' as role, 11 as n union all select 'WHERE', 3 union all select 'JOIN_ON', 11 union all select 'multiple', 3")
def clause_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlrefs.clause_roles(_refs(spark)).groupBy("role").agg(F.count("*").alias("n"))


@query("select 7 as question_id, 'ExtractionError' as error_type")
def extraction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlrefs.errors(_refs(spark)).select("question_id", "error_type")


_TRIPLES = [(a, n, x) for a in range(5) for n in range(3) for x in range(5)]


@query("select clauses::bigint as clauses, nested::bigint as nested, extras::bigint as extras, case when clauses <= 1 and extras = 0 and nested = 0 then 'easy' when (extras <= 2 and clauses <= 1 and nested = 0) or (clauses <= 2 and extras < 2 and nested = 0) then 'medium' when (extras > 2 and clauses <= 2 and nested = 0) or (clauses > 2 and clauses <= 3 and extras <= 2 and nested = 0) or (clauses <= 1 and extras = 0 and nested <= 1) then 'hard' else 'extra' end as hardness from " + star.values(_TRIPLES, "clauses", "nested", "extras"))
def hardness_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_TRIPLES, "clauses bigint, nested bigint, extras bigint")
    return rows.withColumn("hardness", hardness_of.label(F.col("clauses"), F.col("nested"), F.col("extras")))


@query("select 'star' as db_id, '" + "\n\n".join(f"CREATE TABLE {t} (\n" + ",\n".join([f"  {c.split(':')[0]} {prompts.SQL_TYPES[c.split(':')[1]]}" + (" PRIMARY KEY" if c.endswith(":1") else "") for c in cols.split()] + [f"  FOREIGN KEY ({k.split()[0]}) REFERENCES {next(o for o, x in star.TABLES.items() if k.split()[1] + ':' in x)}({k.split()[1]})" for k in star.KEYS if k.split()[0] + ":" in cols]) + "\n);" for t, cols in star.TABLES.items()) + "' as schema_block")
def ddl_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.catalog(spark).blocks()


_ANSWERS = [
    (0, '{"tables": ["nation"], "columns": [["nation", "n_name"]]}', True), (1, '{"tables": [], "columns": []}', True), (2, '{"tables": ["a", 1], "columns": []}', False),
    (3, '{"tables": ["a"]}', False), (4, '{"tables": ["a"], "columns": [["a"]]}', False), (5, "prose", False), (6, '```json\n{"tables": ["a"], "columns": []}\n```', True),
    (7, '{"tables": ["a", "b", "c", "d"], "columns": []}', True), (8, '{"tables": "a", "columns": []}', False), (9, '{"tables": ["a"], "columns": [["a", 2]]}', False),
]


@query("select id::bigint as id, valid from " + star.values([(i, v) for i, _, v in _ANSWERS], "id", "valid"))
def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, a) for i, a, _ in _ANSWERS], "id bigint, response string")
    return rows.select("id", X.valid_links(X.tolerant_json(F.col("response"))).alias("valid"))


def _replay(spark: SparkSession, version: str, answers: dict[int, list[str]]) -> providers.Provider:
    messages = prompts.user_messages(star.questions(spark), star.catalog(spark).blocks(), version)
    scripts = spark.createDataFrame([(i, t, a) for i, turns in answers.items() for t, a in enumerate(turns)], "question_id bigint, turn int, response string")
    return providers.replay(messages.join(scripts, "question_id").select(F.sha2("user", 256).alias("user_hash"), "turn", "response"))


_ONE, _TWO = '{"tables": ["nation"], "columns": [["nation", "n_name"]]}', '{"tables": ["region", "nation"], "columns": []}'


@query("select question_id::bigint as question_id, tables, columns, parsed::bigint as n_samples_parsed from " + star.values([(i, *({0: ("nation,region", "nation.n_name", 3), 1: ("nation", "nation.n_name", 2)}.get(i, ("", "", 0)))) for i in range(10)], "question_id", "tables", "columns", "parsed"))
def forward_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = _replay(spark, "forward_v1", {0: [_ONE, _TWO, _ONE], 1: [_ONE, "not json at all", _ONE]})
    rows = linkers.forward_linker(provider)(star.questions(spark), star.catalog(spark))
    return rows.select("question_id", F.array_join(F.array_sort("tables"), ",").alias("tables"), F.array_join(F.transform("columns", lambda p: F.concat_ws(".", p["t"], p["c"])), ",").alias("columns"), "n_samples_parsed")


@query("select question_id::bigint as question_id, tables, columns from " + star.values([(i, *({0: ("nation,region", "nation.n_name,nation.n_regionkey,region.r_regionkey"), 1: ("customer", "")}.get(i, ("", "")))) for i in range(10)], "question_id", "tables", "columns"))
def backward_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = _replay(spark, "backward_v1", {0: ["```sql\nSELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey\n```"], 1: ["SELECT count(*) FROM customer"], 2: ["SELECT ((("]})
    return _flat(linkers.backward_linker(provider)(star.questions(spark), star.catalog(spark)))


@query("select question_id::bigint as question_id, tables, columns, dropped::bigint as dropped_columns, hallucinated::bigint as hallucinated_endpoints, failure from " + star.values([(i, *({0: ("region,nation,customer,orders", "nation.n_name", 1, 0, None), 1: ("customer", "", 0, 1, None), 2: ("", "", 0, 1, "no_valid_endpoints")}.get(i, ("", "", 0, 0, "parse")))) for i in range(10)], "question_id", "tables", "columns", "dropped", "hallucinated", "failure"))
def graph_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = _replay(spark, "graph_endpoint_v2", {0: ['{"core_tables": ["region", "ORDERS"], "columns": [["nation", "N_NAME"], ["part", "p_size"]]}'], 1: ['{"core_tables": ["customer", "fake"], "columns": []}'], 2: ['{"core_tables": ["fake"], "columns": []}'], 3: ["prose"]})
    rows = linkers.graph_linker(provider)(star.questions(spark), star.catalog(spark))
    return rows.select("question_id", F.array_join("tables", ",").alias("tables"), F.array_join(F.transform("columns", lambda p: F.concat_ws(".", p["t"], p["c"])), ",").alias("columns"), "dropped_columns", "hallucinated_endpoints", "failure")


@query()
def lexical_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(linkers.lexical_linker(80)(star.questions(spark), star.catalog(spark)))


@query()
def vector_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkspark.config import TunedVector

    return _flat(linkers.vector_linker(vector.hashing_encoder(), TunedVector(2, 0.1, 3, 0.2))(star.questions(spark), star.catalog(spark)))


@query("select level, precision, recall, f1, srr, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn from (values ('tables', round(8.0::double / 9, 6), round(8.0::double / 10, 6), round(16.0::double / 19, 6), 0.75::double, 8, 1, 2)) v(level, precision, recall, f1, srr, tp, fp, fn)")
def pooled_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = lambda rows: spark.createDataFrame([(i, t.split(",") if t else []) for i, t in rows], "question_id bigint, tables array<string>")
    gold = links([(0, "a,b"), (1, "a,b,c"), (2, "d,e,f,g,h"), (3, "")])
    predicted = links([(0, "a,b"), (1, "a"), (2, "d,e,f,g,h,x"), (3, "")])
    return sinks.rounded(evaluation.pooled(gold, predicted, "tables"))
