"""The star schema of the test tables as a catalog, and a small corpus of questions with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators.linkers import Catalog

DB = "star"
TABLES = {
    "region": "r_regionkey:number:1 r_name:text:0",
    "nation": "n_nationkey:number:1 n_name:text:0 n_regionkey:number:0",
    "customer": "c_custkey:number:1 c_name:text:0 c_nationkey:number:0 c_acctbal:number:0 c_mktsegment:text:0",
    "supplier": "s_suppkey:number:1 s_name:text:0 s_nationkey:number:0 s_acctbal:number:0",
    "part": "p_partkey:number:1 p_name:text:0 p_brand:text:0 p_type:text:0 p_size:number:0 p_retailprice:number:0",
    "orders": "o_orderkey:number:1 o_custkey:number:0 o_orderstatus:text:0 o_totalprice:number:0 o_orderdate:time:0 o_orderpriority:text:0",
    "lineitem": "l_orderkey:number:0 l_partkey:number:0 l_suppkey:number:0 l_linenumber:number:0 l_quantity:number:0 l_extendedprice:number:0 l_shipdate:time:0",
}
KEYS = ("n_regionkey r_regionkey", "c_nationkey n_nationkey", "s_nationkey n_nationkey", "o_custkey c_custkey", "l_orderkey o_orderkey", "l_partkey p_partkey", "l_suppkey s_suppkey")

#: question_id, question, query
QUESTIONS = (
    (0, "What is the name of each nation and its region?", "SELECT n.n_name, r.r_name FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey"),
    (1, "How many customers are there?", "SELECT count(*) FROM customer"),
    (2, "List all parts of size 7.", "SELECT * FROM part WHERE p_size = 7"),
    (3, "Total price of orders by priority", "SELECT o_orderpriority, sum(o_totalprice) FROM orders GROUP BY o_orderpriority HAVING count(*) > 3 ORDER BY o_orderpriority"),
    (4, "Customers without orders", "SELECT c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    (5, "Suppliers and customers of one nation", "SELECT s_name FROM supplier UNION SELECT c_name FROM customer"),
    (6, "Revenue per nation", "WITH sold AS (SELECT l_orderkey, l_extendedprice FROM lineitem) SELECT n_name, sum(l_extendedprice) FROM sold JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    (7, "A broken query", "SELECT ((("),
    (8, "Brands that suppliers of a nation sell", "SELECT DISTINCT p.p_brand FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE s.s_nationkey = 3"),
    (9, "Unknown things", "SELECT p_color, q.p_name FROM part AS p"),
)


def columns_list() -> list[tuple]:
    out, index = [], 1
    for ord_, (table, columns) in enumerate(TABLES.items()):
        for i, c in enumerate(columns.split()):
            name, kind, key = c.split(":")
            out.append((DB, ord_, table, table, i, index, name.split("_", 1)[1], name, kind, key == "1"))
            index += 1
    return out


def keys_list() -> list[tuple[str, int, int, int]]:
    index = {c[7]: c[5] for c in columns_list()}
    return [(DB, i, index[k.split()[0]], index[k.split()[1]]) for i, k in enumerate(KEYS)]


def catalog(spark: SparkSession) -> Catalog:
    tables = spark.createDataFrame([(DB, i, t, t) for i, t in enumerate(TABLES)], "db_id string, table_ord int, name string, original string")
    columns = spark.createDataFrame(columns_list(), "db_id string, table_ord int, table_name string, table_original string, col_ord int, global_idx int, col_name string, col_original string, type string, is_pk boolean")
    keys = spark.createDataFrame(keys_list(), "db_id string, fk_ord int, from_idx int, to_idx int")
    return Catalog(tables, columns, keys)


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, DB, q, s) for i, q, s in QUESTIONS], "question_id bigint, db_id string, question string, query string")


def values(rows: list[tuple], *names: str) -> str:
    """A VALUES relation in SQL."""
    show = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") as v({', '.join(names)})"


def edge_rows() -> list[tuple[str, str]]:
    owner = {c[5]: c[3] for c in columns_list()}
    return [tuple(sorted((owner[f], owner[t]))) for _, _, f, t in keys_list()]


def nodes(spark: SparkSession) -> DataFrame:
    return catalog(spark).tables.select("db_id", F.col("original").alias("name"))
