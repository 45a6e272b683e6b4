"""Methods compared on the events table, each query with its SQL.

A question is a user.  Its elements are event types (tables) and types with a range of values (columns); two methods and their union
predict those of some events, and two tiers of gold have those of others.  The schema lacks the type "error" and the range "v2".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import metrics as M
from linkspark.functions import text as X
from linkspark.operators import analytics, difficulty, evaluation, ledger, lexical, prompts, stats, tuning, votes
from linkspark.plans import testdata
from linkspark.plans.inputs import calls, lexical_inputs, table
from linkspark.plans.mechanisms import P_VALUES
from linkspark.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Which events (by id) a method sees, and which are gold.
METHODS = {"a": "event_id % 5 in (0, 1)", "b": "event_id % 5 in (1, 2)", "union": "event_id % 5 in (0, 1, 2)"}
TIERS = {"tier1": "event_id % 7 in (0, 1, 2)", "tier2": "event_id % 7 < 5"}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _links(spark: SparkSession, sf_dir: str, seen: str) -> DataFrame:
    """question_id, db_id, tables, columns of the events for which ``seen`` holds; every user has a row."""
    e = table(spark, sf_dir, "events").withColumn("c", F.concat(F.lit("v"), (F.floor(F.col("value") / 100) % 3).cast("string")))
    hit = F.expr(seen)
    pairs = F.array_sort(F.collect_set(F.when(hit, F.struct(F.col("event_type").alias("t"), "c"))))  # some types and ranges
    return e.groupBy(F.col("user_id").alias("question_id")).agg(F.lit("events").alias("db_id"), F.array_sort(F.collect_set(F.when(hit, F.col("event_type")))).alias("tables"), pairs.alias("columns"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("event_type").alias("original")).distinct().withColumn("db_id", F.lit("events"))
    columns = types.select("db_id", F.col("original").alias("table_original"), F.explode(F.array(F.lit("v0"), F.lit("v1"))).alias("col_original"))
    return evaluation.known_elements(columns, types)


def _rows(spark: SparkSession, sf_dir: str, *methods: str, tiers: tuple[str, ...] = tuple(TIERS)) -> DataFrame:
    """The per-query table of ``methods`` and ``tiers``."""
    known, out = _known(spark, sf_dir), None
    for tier in tiers:
        gold = _links(spark, sf_dir, TIERS[tier])
        for method in methods:
            rows = evaluation.per_query(gold, _links(spark, sf_dir, METHODS[method]), known, None, method, tier)
            out = rows if out is None else out.unionByName(rows)
    return out


_BASE = (
    "with e as (select user_id as question_id, event_type as t, 'v' || (cast(floor(value / 100) as bigint) % 3) as c, event_id from events), els as ("
    " select question_id, 'table' as level, t as el, t <> 'error' as known, event_id from e"
    " union all select question_id, 'column', t || '.' || c, t <> 'error' and c <> 'v2', event_id from e), flags as ("
    " select question_id, level, el, any_value(known) as known, "
    + ", ".join(f"bool_or({rule}) as {name}" for name, rule in (*((f"p_{m}", r) for m, r in METHODS.items()), *((f"g_{t}", r) for t, r in TIERS.items())))
    + " from els group by question_id, level, el), long as ("
    + " union all ".join(f"select question_id, level, el, known, '{m}' as method, '{t}' as tier, p_{m} as p, g_{t} as g from flags" for m in METHODS for t in TIERS)
    + """), counts as (
  select question_id, method, tier, level, count(*) filter (where p and known and g) as tp, count(*) filter (where p and known and not g) as fp, count(*) filter (where g and not (p and known)) as fn,
    count(*) filter (where p and not known) as bad, count(*) filter (where p) as raw, coalesce(string_agg(el, ',' order by el) filter (where p and not known), '') as bad_list
  from long group by question_id, method, tier, level
), scored as (
  select *, case when tp + fp = 0 then 1.0::double else tp::double / (tp + fp) end as pr, case when tp + fn = 0 then 1.0::double else tp::double / (tp + fn) end as re,
    case when tp + fp + fn = 0 then 1.0::double else 2.0::double * tp / (2 * tp + fp + fn) end as f1, fn = 0 as hit from counts
), agg as (
  select method, tier, level || 's' as level, avg(pr) as pr, avg(re) as re, avg(f1) as f1, avg(hit::int) as srr from scored group by method, tier, level
)"""
)


@query(
    _BASE
    + """ select t.question_id, t.method, t.tier, t.tp as table_tp, t.fp as table_fp, t.fn as table_fn, c.tp as column_tp, c.fp as column_fp, c.fn as column_fn, round(t.f1, 9) as table_f1, round(c.f1, 9) as column_f1,
  t.bad as table_hallucinated, c.bad as column_hallucinated, round(case when t.raw + c.raw = 0 then 0 else (t.bad + c.bad)::double / (t.raw + c.raw) end, 9) as hallucination_rate,
  t.bad_list as hallucinated_tables_list, c.bad_list as hallucinated_columns_list
from scored t join scored c using (question_id, method, tier) where t.level = 'table' and c.level = 'column'"""
)
def method_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, *METHODS)
    counts = [f"{level}_{n}" for level in ("table", "column") for n in ("tp", "fp", "fn", "hallucinated")]
    return rows.select("question_id", "method", "tier", *counts, *[F.round(c, 9).alias(c) for c in ("table_f1", "column_f1", "hallucination_rate")], "hallucinated_tables_list", "hallucinated_columns_list")


def _headline(spark: SparkSession, sf_dir: str, *methods: str, tiers: tuple[str, ...] = tuple(TIERS)) -> DataFrame:
    return evaluation.headline(evaluation.aggregate(_rows(spark, sf_dir, *methods, tiers=tiers)))


@query(_BASE + " select method, tier, level, round(pr, 6) as precision, round(re, 6) as recall, round(f1, 6) as f1, round(srr, 6) as srr from agg")
def method_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rounded(_headline(spark, sf_dir, *METHODS).select("method", "tier", "level", "precision", "recall", "f1", "srr"))


_WIDE = ("a", "union")


@query(
    _BASE + " select tier, level, " + ", ".join(f"round(max({x}) filter (where method = '{m}'), 6) as {m}_{n}" for m in _WIDE for x, n in (("pr", "precision"), ("re", "recall"), ("f1", "f1"), ("srr", "srr"))) + " from agg group by tier, level"
)
def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rounded(analytics.compare_wide(_headline(spark, sf_dir, *_WIDE), _WIDE))


@query(
    _BASE
    + """, gaps as (select method, level, max(f1) filter (where tier = 'tier2') - max(f1) filter (where tier = 'tier1') as gap from agg group by method, level)
select level, round(max(gap) filter (where method = 'a'), 6) as a_gap, round(max(gap) filter (where method = 'b'), 6) as b_gap, round(max(gap) filter (where method = 'a') / max(gap) filter (where method = 'b'), 6) as ratio from gaps group by level"""
)
def method_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = analytics.tier_asymmetry(_headline(spark, sf_dir, "a", "b"))
    wide = gaps.groupBy("level").pivot("method", ["a", "b"]).agg(F.first("gap")).select("level", F.col("a").alias("a_gap"), F.col("b").alias("b_gap"))
    return sinks.rounded(wide.join(analytics.asymmetry_ratio(gaps, "a", "b"), "level"))


@query(
    _BASE
    + """, w as (select tier, level, greatest(max(f1) filter (where method = 'a'), max(f1) filter (where method = 'b')) as best, max(f1) filter (where method = 'union') as u,
  max(pr) filter (where method = 'a') as pa, max(pr) filter (where method = 'b') as pb, max(pr) filter (where method = 'union') as pu from agg group by tier, level)
select tier, level, round(best, 6) as best_part_f1, round(u, 6) as union_f1, u > best as union_wins_f1, round(pa - pu, 6) as precision_cost_a, round(pb - pu, 6) as precision_cost_b from w"""
)
def method_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.union_against_parts(_headline(spark, sf_dir, *METHODS), ["a", "b"], "union")
    return sinks.rounded(rows.drop("best_part_f6", "union_f6", "union_wins_f6"))


@query(
    _BASE
    + """, costs as (select 'a' as method, count(*) filter (where event_id % 5 in (0, 1)) / 1000.0::double as usd from events union all select 'union', count(*) filter (where event_id % 5 in (0, 1, 2)) / 1000.0::double from events),
n as (select count(distinct user_id) as n from events), d as (select a.method, tier, level, f1, usd / n.n as per from agg a join costs using (method), n)
select x.tier, x.level, round(x.f1 / x.per, 6) as a_f1_per_dollar, round(y.f1 / y.per, 6) as union_f1_per_dollar, round((y.f1 - x.f1) / (y.per - x.per), 6) as gain_per_dollar
from d x join d y using (tier, level) where x.method = 'a' and y.method = 'union'"""
)
def method_per_dollar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    costs = e.select(F.explode(F.array(*[F.when(F.expr(METHODS[m]), F.lit(m)) for m in _WIDE])).alias("method")).where("method is not null").groupBy("method").agg((F.count("*") / 1000).alias("cost_usd"))
    dollars = analytics.per_dollar(_headline(spark, sf_dir, *_WIDE), costs, e.select("user_id").distinct().count())
    a, u = dollars.where("method = 'a'"), dollars.where("method = 'union'")
    name = lambda x, m: x.select("tier", "level", F.col("f1_per_dollar").alias(f"{m}_f1_per_dollar"))
    return sinks.rounded(name(a, "a").join(name(u, "union"), ["tier", "level"]).join(analytics.gain_per_dollar(a, u), ["tier", "level"]).drop("gain", "extra"))


@query(
    _BASE
    + """, pairs as (select x.tier, x.level as element_type, x.hit as ha, y.hit as hb from scored x join scored y using (question_id, tier, level) where x.method = 'a' and y.method = 'b'),
n as (select tier, element_type, count(*) filter (where ha and hb) as n_both, count(*) filter (where ha and not hb) as b, count(*) filter (where hb and not ha) as c, count(*) filter (where not ha and not hb) as n_neither from pairs group by all),
x as (select *, case when b + c = 0 then 0 else pow(abs(b - c) - 1, 2)::double / (b + c) end as x from n),
p as (select *, """
    + ", ".join(f"{sql} as {name}" for name, sql in P_VALUES.items())
    + """ from x)
select tier, element_type, n_both, b as n_a_only, c as n_b_only, n_neither, round(case when b + c < 25 then least(b, c) else x end, 6) as statistic, round(case when b + c < 25 then exact_p else asymptotic_p end, 7) as p_value,
  case when (case when b + c < 25 then exact_p else asymptotic_p end) < 0.001 then 'p < .001' when (case when b + c < 25 then exact_p else asymptotic_p end) < 0.05 then 'p < .05' else 'n.s.' end as band from p"""
)
def method_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.compare(_rows(spark, sf_dir, "a", "b"), "a", "b").drop("method_a", "method_b")
    return rows.withColumn("band", M.p_band(F.col("p_value"))).withColumns({"statistic": F.round("statistic", 6), "p_value": F.round("p_value", 7)})


_SETS = """with s as (select user_id as question_id, """ + ", ".join(f"coalesce(list_sort(list(distinct event_type) filter (where {rule})), []) as {name}" for name, rule in {**METHODS, **TIERS}.items()) + " from events group by user_id)"


@query(_SETS + " select question_id, len(list_intersect(a, b)) > 0 as intersects, len(list_intersect(a, b)) as n_both, len(a) - len(list_intersect(a, b)) as n_a_only, len(b) - len(list_intersect(a, b)) as n_b_only from s")
def method_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.endpoint_agreement(_links(spark, sf_dir, METHODS["a"]), _links(spark, sf_dir, METHODS["b"]))


_MINUS = "array_to_string(list_sort(list_filter({0}, lambda x: not list_contains({1}, x))), ',')"


@query(_SETS + f" select question_id, {_MINUS.format('a', 'b')} as missing, {_MINUS.format('b', 'a')} as extra from s where a <> b")
def method_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.disagreements(_links(spark, sf_dir, METHODS["a"]), _links(spark, sf_dir, METHODS["b"]))
    return rows.select("question_id", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("missing", "extra")])


@query(_SETS + f" select question_id, {_MINUS.format('tier2', 'tier1')} as gap_tables, len(tier2) - len(tier1) as join_complexity from s")
def method_tier_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.tier_gap(_links(spark, sf_dir, TIERS["tier1"]), _links(spark, sf_dir, TIERS["tier2"]))
    return rows.select("question_id", F.array_join(F.array_sort("gap_tables"), ",").alias("gap_tables"), "join_complexity")


@query(
    _SETS
    + """ select count(*) as n, round(avg(list_has_all(tier2, a)::int), 9) as subset_share, round(avg((tier2 = a)::int), 9) as equal_share,
  count(*) filter (where list_has_all(tier2, a) and len(list_filter("union", lambda x: not list_contains(a, x) and not list_contains(tier2, x))) > 0) as pathologies,
  count(*) filter (where list_has_all(tier1, a) and not list_has_all(a, tier1) and len(list_filter("union", lambda x: not list_contains(a, x) and list_contains(tier2, x))) > 0) as rescues from s"""
)
def method_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"endpoints": METHODS["a"], "path": METHODS["union"], "tier1": TIERS["tier1"], "tier2": TIERS["tier2"]}
    rows = None
    for name, rule in sets.items():
        one = _links(spark, sf_dir, rule).select("question_id", F.col("tables").alias(name))
        rows = one if rows is None else rows.join(one, "question_id")
    found = analytics.pathology_and_rescue(rows).agg(F.count("*").alias("n"), F.count_if("pathology").alias("pathologies"), F.count_if("rescue").alias("rescues"))
    return sinks.rounded(analytics.endpoint_quality(rows.withColumn("gold", F.col("tier2"))).join(found, "n"), 9)


@query(
    _BASE
    + """, m as (select t.question_id, t.method, (t.f1 + c.f1) / 2 as f from scored t join scored c using (question_id, method, tier) where tier = 'tier2' and t.level = 'table' and c.level = 'column')
select x.question_id, round(x.f, 9) as old_f1, round(y.f, 9) as new_f1, round(y.f - x.f, 9) as delta from m x join m y using (question_id) where x.method = 'a' and y.method = 'union' and x.f <> y.f"""
)
def method_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (_rows(spark, sf_dir, m, tiers=("tier2",)) for m in _WIDE)
    return sinks.rounded(analytics.version_deltas(old, new), 9)


@query(_SETS + " select count(*) as n, round(avg(len(a)), 9) as avg_tables, round(avg((len(a) = 0)::int), 9) as failure_rate, avg((len(a) = 0)::int) <= 0.02 as within_target from s")
def method_run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir, METHODS["a"]).withColumn("failed", F.size("tables") == 0)
    return sinks.rounded(ledger.run_statistics(links).select("n", "avg_tables", "failure_rate", "within_target"), 9)


@query("""
with s as (select user_id as q, event_id % 3 as s, event_type as t from events), v as (select q, t, count(distinct s) as n, bool_or(s = 0) as first from s group by q, t)
select strategy, count(*) as n from (select unnest(['k=1', 'k=3 union', 'k=3 majority', 'k=3 intersection']) as strategy, unnest([first, n >= 1, n >= 2, n >= 3]) as has from v) where has group by strategy
""")
def vote_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links each rule keeps of three samples a user."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), (F.col("event_id") % 3).cast("int").alias("sample_idx"), "event_type")
    none = F.array().cast("array<struct<t:string,c:string>>")
    samples = e.groupBy("question_id", "sample_idx").agg(F.array_sort(F.collect_set("event_type")).alias("tables"), none.alias("columns"))
    return votes.ablation(samples, 3).groupBy("strategy").agg(F.sum(F.size("tables")).alias("n"))


# ---- picks, sizes and small rules, over whole tables


def _pick(name: str, of: str, order: str, run: Callable[[DataFrame], DataFrame]) -> None:
    def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(testdata.QUERIES[of](spark, sf_dir))

    picked.__name__ = name
    query(f"select * from ({testdata.ORACLES[of]}) order by {order}")(picked)


_GRID_ORDER = "table_top_k, table_threshold, column_top_k, column_threshold"
_pick("grid_pick", "grid_tune", f"mean_f1 desc, mean_recall desc, {_GRID_ORDER} limit 1", tuning.pick_grid)
_pick("grid_best", "grid_tune", f"mean_f1 desc, mean_recall desc, {_GRID_ORDER} limit 20", lambda t: t.orderBy(F.desc("mean_f1"), F.desc("mean_recall"), *_GRID_ORDER.split(", ")).limit(20))
_pick("fuzzy_pick", "threshold_sweep", "table_f1 desc, column_f1 desc, fuzzy_threshold limit 1", tuning.pick_fuzzy)


@query("select l.doc_id is null as lacks_label, count(*) as n from documents d left join labels l on d.doc_id = l.doc_id group by all")
def unpaired_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda t: table(spark, sf_dir, t).select(F.col("doc_id").alias("question_id"))
    alone, _ = evaluation.unpaired(name("documents"), name("labels"))
    n = lambda rows, flag: rows.agg(F.lit(flag).alias("lacks_label"), F.count("*").alias("n"))
    both = analytics.common_questions(name("documents"), name("labels"))
    return n(alone, True).unionByName(n(both, False)).where("n > 0")


@query("select lang as split, count(*) as n, count(distinct source) as databases from documents group by lang")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.split_sizes(table(spark, sf_dir, "documents").select(F.col("lang").alias("split"), F.col("source").alias("db_id")))


@query("""
with o as (select l_orderkey as question_id, count(*) % 5 as clauses, count(*) filter (where l_returnflag = 'R') % 3 as nested, count(distinct l_suppkey) % 5 as extras from lineitem group by l_orderkey)
select case when clauses <= 1 and extras = 0 and nested = 0 then 'easy' when nested = 0 and ((extras <= 2 and clauses <= 1) or (clauses <= 2 and extras < 2)) then 'medium'
  when (nested = 0 and ((extras > 2 and clauses <= 2) or (clauses = 3 and extras <= 2))) or (clauses <= 1 and extras = 0 and nested <= 1) then 'hard' else 'extra' end as hardness, count(*) as n from o group by 1
""")
def hardness_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    counts = lines.groupBy("l_orderkey").agg((F.count("*") % 5).alias("c"), (F.count_if(F.col("l_returnflag") == "R") % 3).alias("n"), (F.countDistinct("l_suppkey") % 5).alias("x"))
    return counts.groupBy(difficulty.label(F.col("c"), F.col("n"), F.col("x")).alias("hardness")).agg(F.count("*").alias("n"))


@query("select event_id, event_id % 4 in (0, 1) as valid from events")
def answers_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of events: plain, fenced, with a number among the names, and cut off."""
    kind, t = F.col("event_id") % 4, F.to_json(F.array("event_type"))
    body = F.concat(F.lit('{"tables": '), t, F.lit(', "columns": [['), F.to_json(F.array("event_type")).substr(F.lit(2), F.length(t) - 2), F.lit(', "v0"]]}'))
    wrong = F.concat(F.lit('{"tables": ["a", '), F.col("event_id").cast("string"), F.lit('], "columns": []}'))
    answer = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, wrong).otherwise(body.substr(F.lit(1), F.length(body) - 1))
    return table(spark, sf_dir, "events").select("event_id", X.valid_links(X.tolerant_json(answer)).alias("valid"))


@query("select p_partkey, case when p_partkey % 3 = 0 then p_name else p_brand end as t, case when p_partkey % 3 = 0 then null else p_type || case when p_partkey % 3 = 2 then '.x' else '' end end as c from part")
def labels_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.concat("p_brand", F.lit("."), "p_type", F.when(F.col("p_partkey") % 3 == 2, F.lit(".x")).otherwise(""))
    t, c = X.after_first_dot(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(rest))
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t"), c.alias("c"))


@query("select conv_id, turn, sha256(role || chr(30) || text) as prompt_hash from conversations")
def turn_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.prompt_hash(F.col("role"), F.col("text")).alias("prompt_hash"))


@query(testdata.CALLS_SQL + " select round(sum(round_even(cost, 6)) + 3, 4) as cap_usd from k")
def cap_after_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.raised_cap(calls(spark, sf_dir)).select(F.round("cap_usd", 4).alias("cap_usd"))


@query(
    testdata.LEXICAL_SQL
    + """, hits as (select question_id, level, name from pairs where strategy is not null),
q2 as (select p_partkey as question_id from part)
select question_id, coalesce(string_agg(distinct name, ',' order by name) filter (where level = 'table'), '') as tables, coalesce(string_agg(distinct name, ',' order by name) filter (where level = 'column'), '') as columns
from q2 left join hits using (question_id) group by question_id"""
)
def lexical_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical links of every question, of both exact strategies; questions without a hit have empty ones."""
    questions, names = lexical_inputs(spark, sf_dir)
    hits = lexical.scores(questions, names, "levenshtein", 100).where("strategy <> 'fuzzy'")
    links = sinks.canonical(lexical.predictions(questions, hits))
    return links.select("question_id", F.array_join("tables", ",").alias("tables"), F.array_join(F.transform("columns", lambda p: p["c"]), ",").alias("columns"))
