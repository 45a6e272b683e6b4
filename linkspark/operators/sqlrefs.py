"""References of SQL text to a schema: tables, columns and the clauses they stand in.

The text is cut into tokens and read by a small recursive reader that knows queries, clauses and parentheses but no
expressions: inside a clause, a name that is no keyword, function, alias or type is a column.  The reader runs in Arrow
batches on the executors, so a corpus of any size is analysed in parallel; each schema is indexed once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are no names inside a clause.
KEYWORDS = frozenset("""select distinct all from where group by having order limit offset union intersect except join inner left right full
outer cross natural on using as and or not in is null like glob regexp match between exists case when then else end asc desc
nulls first last cast collate escape with recursive values true false interval date filter over partition rows range current
unbounded preceding following row isnull notnull""".split())
CLAUSE_WORDS = ("from", "where", "group", "having", "order", "limit", "union", "intersect", "except")
SETS = ("union", "intersect", "except")

_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\])|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<name>[^\W\d]\w*)|(?P<sign><>|!=|>=|<=|==|\|\||[-+*/%=<>(),.;?:@&|~])""", re.S)


class SqlError(ValueError):
    """The text is not a query."""


@dataclass
class Token:
    kind: str
    text: str

    @property
    def word(self) -> str:
        return self.text.lower() if self.kind == "name" else self.text


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"unexpected character at {at}")
        if m.lastgroup == "quoted":
            out.append(Token("quoted", m[0][1:-1].replace('""', '"')))
        elif m.lastgroup:
            out.append(Token(m.lastgroup, m[0]))
        at = m.end()
    return out


@dataclass
class Found:
    """What a text mentions, in order, before it is resolved."""

    tables: list[tuple[str, str | None]] = field(default_factory=list)
    columns: list[tuple[str | None, str, str]] = field(default_factory=list)
    """(qualifier, name, clause)"""
    stars: list[tuple[str | None, list[str]]] = field(default_factory=list)
    """(qualifier, tables of a bare star's FROM)"""
    ctes: set[str] = field(default_factory=set)
    first_from: list[str] = field(default_factory=list)
    """Tables of the outermost FROM, without joins."""


class Reader:
    def __init__(self, sql: str):
        self.tokens = tokens(sql)
        self.at = 0
        self.found = Found()
        self.in_on = 0

    def _peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else Token("end", "")

    def _word(self, *words: str) -> bool:
        t = self._peek()
        return t.kind == "name" and t.word in words

    def _sign(self, text: str, ahead: int = 0) -> bool:
        t = self._peek(ahead)
        return t.kind == "sign" and t.text == text

    def _take(self) -> Token:
        t = self._peek()
        if t.kind == "end":
            raise SqlError("unexpected end")
        self.at += 1
        return t

    def _expect(self, text: str) -> None:
        t = self._take()
        if t.word != text:
            raise SqlError(f"expected {text}, found {t.text}")

    def read(self) -> Found:
        self.query(outermost=True)
        while self._sign(";"):
            self.at += 1
        if self._peek().kind != "end":
            raise SqlError(f"unexpected {self._peek().text}")
        return self.found

    def query(self, outermost: bool = False) -> list[str]:
        """Reads a query with its set operations; gives the tables of the first FROM and its joins."""
        if self._word("with"):
            self._take()
            if self._word("recursive"):
                self._take()
            while True:
                self.found.ctes.add(self._name())
                if self._sign("("):
                    self._skip_parentheses()
                self._expect("as")
                self._expect("(")
                self.query()
                self._expect(")")
                if not self._sign(","):
                    break
                self._take()
        if self._sign("("):
            self._take()
            tables = self.query(outermost)
            self._expect(")")
        else:
            tables = self.select(outermost)
        while self._word(*SETS):
            self._take()
            if self._word("all", "distinct"):
                self._take()
            if self._sign("("):
                self._take()
                self.query()
                self._expect(")")
            else:
                self.select(False)
        if self._word("order"):
            self.order()
        if self._word("limit"):
            self.limit()
        return tables

    def _name(self) -> str:
        t = self._take()
        if t.kind not in ("name", "quoted") or (t.kind == "name" and t.word in CLAUSE_WORDS):
            raise SqlError(f"expected a name, found {t.text}")
        return t.text

    def _skip_parentheses(self) -> None:
        self._expect("(")
        depth = 1
        while depth:
            t = self._take()
            depth += (t.text == "(") - (t.text == ")") if t.kind == "sign" else 0

    def select(self, outermost: bool) -> list[str]:
        self._expect("select")
        if self._word("distinct", "all"):
            self._take()
        bare = False
        before = self.at
        while not (self._word(*CLAUSE_WORDS) or self._sign(")") or self._sign(";") or self._peek().kind == "end"):
            if self._sign("*") and self._starts_item(before):
                self._take()
                bare = True
            elif self._sign(","):
                self._take()
                before = self.at
            else:
                self.expression("SELECT", stop=(",", *CLAUSE_WORDS))
        if self.at == before and not bare:
            raise SqlError("nothing selected")
        tables: list[str] = []
        if self._word("from"):
            self._take()
            tables = self.sources(outermost)
        if bare:
            self.found.stars.append((None, tables))
        if self._word("where"):
            self._take()
            self.expression("WHERE", stop=CLAUSE_WORDS, need=True)
        if self._word("group"):
            self._take()
            self._expect("by")
            self.expression("GROUP_BY", stop=CLAUSE_WORDS, need=True)
        if self._word("having"):
            self._take()
            self.expression("HAVING", stop=CLAUSE_WORDS, need=True)
        if self._word("order"):
            self.order()
        if self._word("limit"):
            self.limit()
        return tables

    def _starts_item(self, before: int) -> bool:
        return self.at == before

    def order(self) -> None:
        self._take()
        self._expect("by")
        self.expression("ORDER_BY", stop=CLAUSE_WORDS, need=True)

    def limit(self) -> None:
        self._take()
        self.expression("OTHER", stop=CLAUSE_WORDS, need=True)

    def sources(self, outermost: bool) -> list[str]:
        tables = self.source()
        if outermost and not self.found.first_from:
            self.found.first_from = list(tables)
        while True:
            if self._sign(","):
                self._take()
                more = self.source()
            elif self._word("join", "inner", "left", "right", "full", "outer", "cross", "natural"):
                while not self._word("join"):
                    self._take()
                self._take()
                more = self.source()
                if self._word("on"):
                    self._take()
                    self.in_on += 1
                    self.expression("JOIN_ON", stop=(",", "join", "inner", "left", "right", "full", "cross", "natural", *CLAUSE_WORDS), need=True)
                    self.in_on -= 1
                elif self._word("using"):
                    self._take()
                    self._skip_parentheses()
            else:
                return tables
            tables += more

    def source(self) -> list[str]:
        if self._sign("("):
            self._take()
            tables = self.query() if self._word("select", "with") or self._sign("(") else self.sources(False)
            self._expect(")")
            self._alias()
            return tables
        name = self._name()
        while self._sign("."):
            self._take()
            name = self._name()
        self.found.tables.append((name, self._alias()))
        return [name]

    def _alias(self) -> str | None:
        if self._word("as"):
            self._take()
            return self._name()
        t = self._peek()
        if t.kind == "quoted" or (t.kind == "name" and t.word not in KEYWORDS):
            return self._take().text
        return None

    def expression(self, clause: str, stop: tuple[str, ...], need: bool = False) -> None:
        """Reads to a word or sign of ``stop`` outside parentheses, or to a closing parenthesis."""
        label = "JOIN_ON" if self.in_on else clause
        began = self.at
        after_operand = False
        while True:
            t = self._peek()
            if t.kind == "end" or (t.kind == "sign" and t.text in (")", ";")):
                break
            if t.word in stop and t.kind in ("name", "sign"):
                break
            if t.kind == "sign" and t.text == "(":
                self._take()
                if self._word("select", "with"):
                    self.query()
                else:
                    self.expression(clause, stop=())
                self._expect(")")
                after_operand = True
                continue
            self._take()
            if t.kind == "quoted" or (t.kind == "name" and t.word not in KEYWORDS):
                if self._sign("(") and t.kind == "name":
                    after_operand = False
                    self._call(clause)
                    after_operand = True
                    continue
                if after_operand and clause == "SELECT":  # an alias without AS
                    continue
                self._column(t, label)
                after_operand = True
            elif t.kind == "name" and t.word == "as":
                self._name()
                while self._sign("("):
                    self._skip_parentheses()
            elif t.kind == "name" and t.word == "cast" and self._sign("("):
                self._take()
                self.expression(clause, stop=("as",))
                depth = 0
                while not (self._sign(")") and depth == 0):
                    x = self._take()
                    depth += (x.text == "(") - (x.text == ")")
                self._expect(")")
                after_operand = True
            elif t.kind in ("string", "number") or (t.kind == "name" and t.word in ("null", "true", "false", "end")):
                after_operand = True
            else:
                after_operand = False
        if need and self.at == began:
            raise SqlError(f"empty {clause}")

    def _call(self, clause: str) -> None:
        self._take()
        if self._word("distinct"):
            self._take()
        if self._sign("*") and self._sign(")", 1):
            self._take()
        elif self._word("select", "with"):
            self.query()
        else:
            self.expression(clause, stop=())
        self._expect(")")

    def _column(self, first: Token, label: str) -> None:
        parts = [first.text]
        while self._sign("."):
            self._take()
            if self._sign("*"):
                self._take()
                self.found.stars.append((parts[-1], []))
                return
            parts.append(self._name())
        self.found.columns.append((parts[-2] if len(parts) > 1 else None, parts[-1], label))


class Index:
    """A schema by lower-case names."""

    def __init__(self, tables: list[str], columns: list[tuple[str, str]]):
        self.tables = {t.lower(): t for t in tables}
        self.columns: dict[str, dict[str, str]] = {t: {} for t in tables}
        self.owners: dict[str, list[str]] = {}
        for t, c in columns:
            self.columns.setdefault(t, {})[c.lower()] = c
            owners = self.owners.setdefault(c.lower(), [])
            if t not in owners:
                owners.append(t)


@dataclass
class References:
    tables: set[str] = field(default_factory=set)
    columns: dict[tuple[str, str], set[str]] = field(default_factory=dict)
    stars: set[str] = field(default_factory=set)
    issues: list[tuple[str, str]] = field(default_factory=list)


def references(sql: str, index: Index, strict: bool = False) -> References:
    """What a query refers to.  A text that can't be read gives nothing and the issue parse_error.

    Aliases hold for the whole text.  Strict drops what the schema lacks, lenient keeps it as written.  A column without a
    usable qualifier belongs to the query's only table that has it; of several, to the first FROM table or else the first in
    the schema; if no table of the query has it, to one of the schema that does, which then counts as mentioned.
    """
    out = References()
    try:
        found = Reader(sql).read()
    except (SqlError, RecursionError) as error:
        out.issues.append(("parse_error", str(error)))
        return out
    aliases: dict[str, str] = {}
    for name, alias in found.tables:
        if name in found.ctes:
            continue
        table = index.tables.get(name.lower())
        if table is None:
            out.issues.append(("unknown_table", name))
            if strict:
                continue
            table = name
        out.tables.add(table)
        for key in (alias, name, table):
            if key:
                aliases[key.lower()] = table
    first = next((index.tables[n.lower()] for n in found.first_from if n not in found.ctes and n.lower() in index.tables), None)

    def note(table: str, column: str, clause: str) -> None:
        out.columns.setdefault((table, column), set()).add(clause)

    for qualifier, name, clause in found.columns:
        table = aliases.get(qualifier.lower()) if qualifier else None
        if qualifier and table is None:
            out.issues.append(("unresolved_alias", qualifier))
        if table is not None:
            column = index.columns.get(table, {}).get(name.lower())
            if column is None:
                out.issues.append(("unknown_column", f"{table}.{name}"))
                if strict:
                    continue
                column = name
            note(table, column, clause)
            continue
        owners = index.owners.get(name.lower(), [])
        if not owners:
            out.issues.append(("unknown_column", name))
            if not strict:
                note(qualifier or first or "", name, clause)
            continue
        pool = [t for t in owners if t in out.tables] or owners
        table = first if first in pool else pool[0]
        out.tables.add(table)
        note(table, index.columns[table][name.lower()], clause)
    for qualifier, tables in found.stars:
        named = [aliases.get(qualifier.lower())] if qualifier else [index.tables.get(t.lower()) for t in tables if t not in found.ctes]
        out.stars |= {t for t in named if t in out.tables}
    return out


TYPE = "tables array<string>, columns array<struct<t:string,c:string,clauses:array<string>>>, stars array<string>, issues array<struct<kind:string,detail:string>>"


def catalogs(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """db_id, cat_tables, cat_columns: one row a schema, in schema order."""
    t = tables.groupBy("db_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_ord", "original"))), lambda x: x["original"]).alias("cat_tables"))
    c = columns.groupBy("db_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_ord", "global_idx", F.col("table_original").alias("t"), F.col("col_original").alias("c")))), lambda x: F.struct(x["t"].alias("t"), x["c"].alias("c"))).alias("cat_columns"))
    return t.join(c, "db_id", "left").select("db_id", "cat_tables", F.coalesce("cat_columns", F.array().cast("array<struct<t:string,c:string>>")).alias("cat_columns"))


def analyse(queries: DataFrame, catalog: DataFrame, strict: bool = False) -> DataFrame:
    """question_id, db_id and the references of ``query`` (see TYPE), sorted; without a schema the issue is missing_schema.

    queries: question_id, db_id, query; catalog: as ``catalogs``.
    """
    rows = queries.select("question_id", "db_id", "query").join(catalog, "db_id", "left").select("question_id", "db_id", "query", "cat_tables", "cat_columns")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = "question_id bigint, db_id string, " + TYPE
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Index] = {}
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["cat_tables"] is None:
                    refs = References(issues=[("missing_schema", r["db_id"] or "")])
                else:
                    if r["db_id"] not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[r["db_id"]] = Index(r["cat_tables"], [(x["t"], x["c"]) for x in r["cat_columns"]])
                    refs = references(r["query"] or "", known[r["db_id"]], strict)
                out.append({
                    "question_id": r["question_id"], "db_id": r["db_id"], "tables": sorted(refs.tables),
                    "columns": [{"t": t, "c": c, "clauses": sorted(v)} for (t, c), v in sorted(refs.columns.items())],
                    "stars": sorted(refs.stars), "issues": [{"kind": k, "detail": d} for k, d in refs.issues],
                })
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, ddl)


def failed() -> Column:
    return F.exists("issues", lambda i: i["kind"].isin("parse_error", "missing_schema"))


def _pairs(columns: Column) -> Column:
    return F.transform(columns, lambda x: F.struct(x["t"].alias("t"), x["c"].alias("c")))


def tier2(refs: DataFrame) -> DataFrame:
    """question_id, db_id, tables, columns: all references of queries that could be read."""
    return refs.where(~failed()).select("question_id", "db_id", "tables", _pairs(F.col("columns")).alias("columns"))


def tier1(refs: DataFrame) -> DataFrame:
    """References that serve more than joining: columns with a clause other than JOIN_ON; their tables, star tables, and tables of which no column is named."""
    kept = F.filter("columns", lambda x: F.size(F.array_except(x["clauses"], F.array(F.lit("JOIN_ON")))) > 0)
    silent = F.array_except("tables", F.transform("columns", lambda x: x["t"]))
    tables = F.array_union(F.array_union(F.transform(F.col("kept"), lambda x: x["t"]), F.col("stars")), silent)
    return refs.where(~failed()).withColumn("kept", kept).select("question_id", "db_id", F.array_sort(F.array_intersect(tables, "tables")).alias("tables"), _pairs(F.col("kept")).alias("columns"))


def errors(refs: DataFrame) -> DataFrame:
    """question_id, db_id, error_type, detail of queries that gave no links: the error log."""
    bad = F.filter("issues", lambda i: i["kind"].isin("parse_error", "missing_schema"))[0]
    return refs.where(failed()).select("question_id", "db_id", F.when(bad["kind"] == "parse_error", "ExtractionError").otherwise("MissingSchema").alias("error_type"), bad["detail"].alias("detail"))


def fail_fast(refs: DataFrame) -> DataFrame:
    """The same rows; the first error raises when they are read."""
    return refs.withColumn("question_id", F.when(failed(), F.raise_error(F.concat(F.lit("no references in question "), F.col("question_id").cast("string")))).otherwise(F.col("question_id")))


def clause_roles(refs: DataFrame) -> DataFrame:
    """question_id, t, c, role: the only clause of a column, or multiple."""
    return refs.select("question_id", F.explode("columns").alias("x")).select("question_id", "x.t", "x.c", F.when(F.size("x.clauses") == 1, F.col("x.clauses")[0]).otherwise("multiple").alias("role"))


def extraction_counts(refs: DataFrame) -> DataFrame:
    """n_ok and n_failed of a batch of analysed queries, as one row."""
    failed = F.exists("issues", lambda i: i["kind"] == "parse_error")
    return refs.agg(F.count_if(~failed).alias("n_ok"), F.count_if(failed).alias("n_failed"))
