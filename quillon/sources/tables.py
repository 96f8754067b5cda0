"""Tables: definitions, delimited files, loading, indexes. Rows live in Spark's own catalog, as parquet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DISTRIBUTIONS = ("none", "hash", "replicated", "roundrobin")
BUCKETS = 10


def schema_of(columns: list[tuple[str, str]]) -> T.StructType:
    """A schema from (name, SQL type); names are compared without case and must differ."""
    names = [n.lower() for n, _ in columns]
    if dup := next((n for n in names if names.count(n) > 1), None):
        raise ValueError(f"duplicated column {dup}")
    alias = {"integer": "int", "text": "string", "double precision": "double", "datetime": "timestamp_ntz", "time": "timestamp_ntz", "numeric": "decimal"}
    fields = []
    for n, t in columns:
        t = t.strip().lower()
        head, _, rest = t.partition("(")
        kind = "string" if head.strip() in ("char", "varchar", "character varying") else alias.get(head.strip(), head.strip()) + (f"({rest}" if rest else "")
        fields.append(f"`{n}` {kind}")
    return T.StructType.fromDDL(", ".join(fields))


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|") -> DataFrame:
    """Rows of a delimited file without a header, typed by a schema; an empty field is null. A separator at the end of the lines is ignored."""
    text = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return spark.read.csv(path, schema=text, sep=sep, nullValue="", emptyValue="", enforceSchema=True, mode="PERMISSIVE", quote="")


def write_delimited(df: DataFrame, path: str, sep: str = "|") -> None:
    df.write.csv(path, sep=sep, nullValue="", emptyValue="", quote="")


@dataclass
class Index:
    table: str
    columns: tuple[str, ...]
    unique: bool


@dataclass
class Catalog:
    """What Spark's catalog doesn't keep: how a table is distributed, and its indexes."""

    spark: SparkSession
    distribution: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)

    def create_table(self, name: str, columns: list[tuple[str, str]], distribution: str = "none", by: str | None = None, if_not_exists: bool = False) -> None:
        """A hash-distributed table is bucketed by its column, so joins and groupings on that need no shuffle."""
        if distribution not in DISTRIBUTIONS or (distribution == "hash") != (by is not None):
            raise ValueError("a distribution is none, replicated, roundrobin, or hash by a column")
        schema = schema_of(columns)
        if by is not None and by.lower() not in (n.lower() for n in schema.names):
            raise ValueError(f"no column {by}")
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        cluster = f" CLUSTERED BY (`{by}`) INTO {BUCKETS} BUCKETS" if by else ""
        self.spark.sql(f"CREATE TABLE {'IF NOT EXISTS ' if if_not_exists else ''}`{name}` ({cols}) USING parquet{cluster}")
        self.distribution[name.lower()] = (distribution, by)

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        self.spark.sql(f"DROP TABLE {'IF EXISTS ' if if_exists else ''}`{name}`")
        self.distribution.pop(name.lower(), None)
        self.indexes = {k: i for k, i in self.indexes.items() if i.table != name.lower()}

    def table(self, name: str) -> DataFrame:
        """The table's rows; a replicated one is hinted to be broadcast, if its size allows."""
        from quillon.operators.relational import broadcast_if_small

        df = self.spark.table(name)
        return broadcast_if_small(df) if self.distribution.get(name.lower(), ("none", None))[0] == "replicated" else df

    def insert(self, name: str, rows: DataFrame, columns: list[str] | None = None) -> None:
        """Append rows; with columns, those that aren't named are null. Values are cast to the table's types."""
        target = self.spark.table(name)
        columns = columns or target.columns
        if len(columns) != len(rows.columns):
            raise ValueError(f"insert has {len(rows.columns)} values for {len(columns)} columns")
        given = dict(zip((c.lower() for c in columns), rows.columns))
        if unknown := given.keys() - {c.lower() for c in target.columns}:
            raise ValueError(f"no column {', '.join(sorted(unknown))}")
        out = [(F.col(f"`{given[f.name.lower()]}`") if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema]
        new = rows.select(*out)
        for i in self.indexes.values():
            if i.unique and i.table == name.lower():
                self._check_one(i, target.unionByName(new))
        new.write.insertInto(name)

    def copy(self, name: str, path: str, where: str | Column | None = None, sep: str = "|") -> None:
        """Append the rows of a delimited file that meet a condition."""
        rows = read_delimited(self.spark, path, self.spark.table(name).schema, sep)
        self.insert(name, rows.filter(where) if where is not None else rows)

    def create_index(self, name: str, table: str, columns: list[str], unique: bool = False) -> None:
        """Parquet has no index: this keeps the definition and, of a unique one, the promise."""
        if name.lower() in self.indexes:
            raise ValueError(f"index {name} exists")
        index = Index(table.lower(), tuple(columns), unique)
        self._check_one(index)
        self.indexes[name.lower()] = index

    def drop_index(self, name: str) -> None:
        if self.indexes.pop(name.lower(), None) is None:
            raise ValueError(f"no index {name}")

    def seek(self, name: str, op: str, value: object) -> DataFrame:
        """Rows whose first indexed column compares with a value; the filter reaches the parquet scan."""
        i = self.indexes[name.lower()]
        return seek(self.spark.table(i.table), i.columns[0], op, value)

    def _check_one(self, i: Index, rows: DataFrame | None = None) -> None:
        df = self.spark.table(i.table) if rows is None else rows
        if missing := [c for c in i.columns if c.lower() not in (x.lower() for x in df.columns)]:
            raise ValueError(f"no column {missing[0]}")
        if i.unique and duplicates(df, list(i.columns)).take(1):
            raise ValueError(f"duplicated key in a unique index of {i.table}")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row."""
    return df.groupBy(*keys).count().filter("count > 1")


def seek(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    """Rows whose column compares with a constant."""
    c, v = F.col(f"`{column}`"), F.lit(value)
    try:
        return df.filter({"=": c == v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op])
    except KeyError:
        raise ValueError(f"an index can't look up {op!r}") from None


def plan_nodes(df: DataFrame) -> DataFrame:
    """(depth, node) of the optimized plan, one row for each operator."""
    text = df._jdf.queryExecution().optimizedPlan().treeString()
    rows = []
    for line in text.splitlines():
        body = line.lstrip(" :+-")
        if body:
            rows.append(((len(line) - len(body)) // 3, body.split(" ", 1)[0]))
    return df.sparkSession.createDataFrame(rows, "depth int, node string")


def explain(df: DataFrame, mode: str = "simple") -> str:
    """The text of a plan: simple, extended, cost, codegen or formatted."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def actual_rows(df: DataFrame) -> list[tuple[int, str, int | None]]:
    """(depth, operator, rows that it gave) of the physical plan, after running it once; None where an operator doesn't count."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    out: list[tuple[int, str, int | None]] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan(), depth)
        if "QueryStage" in name:
            return walk(node.plan(), depth)
        if not name.startswith(("WholeStageCodegen", "InputAdapter", "AQEShuffleRead")):
            rows = node.metrics().get("numOutputRows")
            out.append((depth, name, rows.get().value() if rows.isDefined() else None))
            depth += 1
        below = node.children().iterator()
        while below.hasNext():
            walk(below.next(), depth)

    walk(execution.executedPlan(), 0)
    return out


def profiled(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """The same rows, and an observation whose row count is there once they were computed."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


__all__ = ["Catalog", "actual_rows", "Index", "duplicates", "explain", "plan_nodes", "profiled", "read_delimited", "schema_of", "seek", "write_delimited"]
