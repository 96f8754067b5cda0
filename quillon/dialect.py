"""SQL text of the engine's dialect: statements are run, queries become DataFrames.

Besides Spark SQL it reads: double quotes around names, count(), e1 == e2, TABLESAMPLE ROW (n) and PERCENT (p), INTERVAL 'n' unit and "n days", DISTRIBUTED BY,
REPLICATED, ROUNDROBIN, CREATE STREAM, CREATE INDEX, COPY, ANALYZE and EXPLAIN. Set operations without parentheses go strictly from left to right.
In compat mode three-argument substring takes an end position, and whole numbers divide without a fraction.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import stats
from quillon.operators.relational import sample_percent, sample_rows
from quillon.sources.tables import Catalog, actual_rows, explain, plan_nodes

_SETTINGS = {"spark.sql.legacy.setopsPrecedence.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.ansi.enabled": "true"}
_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|[A-Za-z_][\w$]*|\d+(?:\.\d+)?|==|\|\||<>|<=|>=|!=|.", re.S)
_UNITS = {"day", "days", "month", "months", "year", "years", "hour", "hours", "minute", "minutes", "second", "seconds"}


def split_statements(text: str) -> list[str]:
    """Statements between semicolons that aren't in strings or comments."""
    out, now = [], ""
    for t in _TOKEN.findall(text):
        if t == ";":
            out.append(now)
            now = ""
        elif not t.startswith(("--", "/*")):
            now += t
        else:
            now += " "
    return [s.strip() for s in [*out, now] if s.strip()]


def _arguments(tokens: list[str], at: int) -> tuple[list[str], int]:
    """Texts of the arguments of a call whose opening parenthesis is at `at`, and the place after the closing one."""
    args, now, depth = [], "", 1
    i = at + 1
    while i < len(tokens):
        t = tokens[i]
        depth += (t == "(") - (t == ")")
        if not depth:
            return [*args, now], i + 1
        if t == "," and depth == 1:
            args.append(now)
            now = ""
        else:
            now += t
        i += 1
    raise ValueError("a parenthesis isn't closed")


def rewritten(sql: str, compat: bool = False) -> str:
    """The same query in Spark's dialect."""
    tokens = _TOKEN.findall(sql)
    out: list[str] = []
    i = 0
    while i < len(tokens):
        t, low = tokens[i], tokens[i].lower()
        k = i + 1
        while k < len(tokens) and tokens[k].isspace():
            k += 1
        after = tokens[k] if k < len(tokens) else ""
        if t == "==":
            out.append("=")
        elif low == "count" and after == "(" and tokens[k + 1 : k + 2] == [")"]:
            out.append("count(*)")
            i = k + 2
            continue
        elif compat and low in ("substr", "substring") and after == "(":
            args, i = _arguments(tokens, k)
            args = [rewritten(a, compat) for a in args]
            out.append(f"substring({args[0]}, {args[1]}, ({args[2]}) - ({args[1]}) + 1)" if len(args) == 3 else f"substring({', '.join(args)})")
            continue
        elif low == "interval" and re.fullmatch(r"'\s*\d+\s*'", after):
            j = k + 1
            while j < len(tokens) and tokens[j].isspace():
                j += 1
            unit = tokens[j].lower() if j < len(tokens) else ""
            if unit in _UNITS:
                n = int(after.strip("' "))
                n, unit = (n * 30, "day") if unit.startswith("month") else (n * 365, "day") if unit.startswith("year") else (n, unit.rstrip("s"))
                out.append(f"INTERVAL '{n}' {unit}")
                i = j + 1
                continue
            out.append(t)
        elif t.isdigit() and after.lower() in ("days", "months", "years") and k > i + 1:
            n = int(t) * {"days": 1, "months": 30, "years": 365}[after.lower()]
            out.append(f"INTERVAL '{n}' day")
            i = k + 1
            continue
        else:
            out.append(t)
        i += 1
    return "".join(out)


@contextmanager
def _settings(spark: SparkSession):
    old = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_SAMPLE = re.compile(r"(\w+)\s+tablesample\s+(row|percent)\s*\(\s*(\d+(?:\.\d+)?)\s*\)", re.I)


@dataclass
class Engine:
    """Runs statements of the dialect on a session."""

    spark: SparkSession
    compat: bool = False
    catalog: Catalog = field(init=False)
    statistics: dict[str, dict[str, stats.ColumnStats]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.catalog = Catalog(self.spark)

    def execute(self, text: str) -> list[DataFrame | str | None]:
        """Results of all statements: a DataFrame for a query, a text for EXPLAIN, None for the rest."""
        return [self.statement(s) for s in split_statements(text)]

    def sql(self, text: str) -> DataFrame:
        """The result of one query."""
        out = self.execute(text)
        if len(out) != 1 or not isinstance(out[0], DataFrame):
            raise ValueError("not one query")
        return out[0]

    def statement(self, s: str) -> DataFrame | str | None:
        for pattern, run in self._commands():
            if m := re.fullmatch(pattern, s, re.I | re.S):
                return run(m)
        return self.query(s)

    def query(self, s: str) -> DataFrame:
        def sampled(m: re.Match) -> str:
            name = f"__sample_{m[1]}_{m[2]}_{m[3].replace('.', '_')}".lower()
            df = self.spark.table(m[1])
            (sample_rows(df, int(m[3])) if m[2].lower() == "row" else sample_percent(df, float(m[3]))).createOrReplaceTempView(name)
            return f"{name} {m[1]}"

        with _settings(self.spark):
            df = self.spark.sql(rewritten(_SAMPLE.sub(sampled, s), self.compat))
            df.schema  # noqa: B018  analysed under these settings
            return df

    def _commands(self):
        c = self.catalog
        name = r'("?[\w$]+"?)'
        return (
            (rf"create\s+(?:table|stream)\s+(if\s+not\s+exists\s+)?{name}\s*\((.*)\)\s*(?:distributed\s+by\s+(\w+)|(replicated)|(roundrobin))?", lambda m: c.create_table(m[2].strip('"'), _columns(m[3]), "hash" if m[4] else (m[5] or m[6] or "none").lower(), m[4], bool(m[1]))),
            (rf"drop\s+table\s+(if\s+exists\s+)?{name}", lambda m: c.drop_table(m[2].strip('"'), bool(m[1]))),
            (rf"create\s+(unique\s+)?index\s+{name}\s+on\s+{name}\s*\(([^)]*)\)(?:\s*where.*)?", lambda m: c.create_index(m[2], m[3].strip('"'), [x.strip() for x in m[4].split(",")], bool(m[1]))),
            (rf"drop\s+index\s+{name}", lambda m: c.drop_index(m[1])),
            (rf"insert\s+into\s+{name}\s*(?:\(([^)]*)\)\s*)?((?:values|select|with|\().*)", lambda m: c.insert(m[1].strip('"'), self.query(m[3]), [x.strip() for x in m[2].split(",")] if m[2] else None)),
            (rf"copy\s+{name}\s+from\s+'([^']*)'(?:\s+where\s+(.*))?", lambda m: c.copy(m[1].strip('"'), m[2], F.expr(rewritten(m[3], self.compat)) if m[3] else None)),
            (rf"analyze\s+(?:table\s+)?{name}(?:\s+tablesample\s+row\s*\((\d+)\))?", lambda m: self._analyze(m[1].strip('"'), m[2])),
            (r"explain\s+(?:(execute|full|verbose)\s+)?((?:select|with|\().*)", lambda m: self._explained(self.query(m[2]), (m[1] or "").lower())),
        )

    def _explained(self, df: DataFrame, mode: str) -> str:
        """The plan; with EXECUTE its operators and the rows that each gave, with FULL the result as well."""
        if mode not in ("execute", "full"):
            return explain(df, "formatted" if mode == "verbose" else "simple")
        plan = "\n".join("  " * d + f"{name} (rows = {'?' if n is None else n})" for d, name, n in actual_rows(df))
        return plan + ("\n" + "\n".join(map(str, df.collect())) if mode == "full" else "")

    def plan(self, text: str) -> DataFrame:
        """(depth, node) of the optimized plan of a query, as a table."""
        return plan_nodes(self.sql(text))

    def _analyze(self, name: str, rows: str | None) -> None:
        df = self.spark.table(name)
        df = sample_rows(df, int(rows)) if rows else df
        self.statistics[name.lower()] = {c: stats.column_stats(df, c) for c in df.columns}


def _columns(text: str) -> list[tuple[str, str]]:
    """(name, type) of a column list; constraints are read and left out."""
    tokens, out, now, depth = _TOKEN.findall(text), [], "", 0
    for t in [*tokens, ","]:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            words = now.split(None, 1)
            if words and words[0].lower() not in ("primary", "foreign", "unique", "constraint", "check"):
                kind = re.split(r"\s+(?:not\s+null|null|primary|unique|default|references|check)\b", words[1] if len(words) > 1 else "", flags=re.I)[0]
                out.append((words[0].strip('"'), kind))
            now = ""
        else:
            now += t
    return out
