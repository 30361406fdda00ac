"""Tables, and what kind of table each is: sharded, global (copied to all), child of a sharded one, or single."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.sharding import ShardFunction


@dataclass
class TableConfig:
    name: str
    kind: str = "sharding"
    column: str | None = None
    function: ShardFunction | None = None
    parent: str | None = None
    parent_column: str | None = None
    max_rows: int | None = None
    #: The column that takes numbers of a sequence where an INSERT gives none.
    increment: str | None = None


class Catalog:
    """Tables of one folder of Parquet data, by name."""

    def __init__(self, spark: SparkSession, folder: str, tables: list[TableConfig] = ()):
        self.spark, self.folder = spark, folder
        self.tables = {t.name: t for t in tables}
        self.numbers: dict[str, int] = {}

    def next_number(self, name: str, count: int = 1) -> int:
        """The first of `count` numbers of a table's sequence."""
        first = self.numbers.get(name, 1)
        self.numbers[name] = first + count
        return first

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        most = self.tables[name].max_rows if name in self.tables else None
        return df if most is None else df.limit(most)

    def names(self) -> list[str]:
        """The folder's tables."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        return sorted(n.removesuffix(".parquet") for f in found if (n := f.getPath().getName()).endswith(".parquet"))

    def register(self, *names: str, collation: str | None = None) -> None:
        """Views of tables; with a collation such as UTF8_LCASE, texts compare, group, sort and join by it (no filter on them then reaches the scan)."""
        for name in names:
            df = self.table(name)
            if collation:
                df = df.select(*[F.collate(f.name, collation).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema])
            df.createOrReplaceTempView(name)

    def root(self, name: str) -> TableConfig:
        """The sharded table at the top of a chain of children."""
        t = self.tables[name]
        return self.root(t.parent) if t.kind == "child" else t

    def co_located(self, a: str, b: str) -> bool:
        """Whether equal join keys of two tables share a shard."""
        return self.tables[a].kind in ("sharding", "child") and self.root(a).name == self.root(b).name

    def describe(self) -> DataFrame:
        """The system table of tables."""
        rows = [(t.name, t.kind, t.column, type(t.function).__name__ if t.function else None, t.parent, t.parent_column, t.max_rows) for t in self.tables.values()]
        return self.spark.createDataFrame(rows, "name string, kind string, sharding_column string, function string, parent string, parent_column string, max_rows int")

    def shards_of(self, t: TableConfig) -> list[int]:
        """The shards of a table, where its function has a fixed number of them."""
        function = self.root(t.name).function if t.kind in ("sharding", "child") else None
        return sorted(function.shards()) if function else [0]

    def system(self, name: str) -> DataFrame:
        """A system table of the catalogue, by its name."""
        tables = list(self.tables.values())
        of = lambda kind: [(i, t) for i, t in enumerate(tables, 1) if t.kind == kind]
        title = lambda t: type(self.root(t.name).function).__name__.lower()
        functions = {title(t): self.root(t.name).function for t in tables if t.kind in ("sharding", "child") and self.root(t.name).function}
        nodes = sorted({s for t in tables for s in self.shards_of(t)})
        rows, schema = {
            "table": lambda: ([(i, t.name, t.kind, t.max_rows) for i, t in enumerate(tables, 1)], "id int, name string, type string, max_limit int"),
            "sharding_table": lambda: ([(i, t.increment, t.column, title(t)) for i, t in of("sharding")], "id int, increment_column string, sharding_column string, algorithm_name string"),
            "child_table": lambda: ([(i, t.parent, t.increment, t.column, t.parent_column) for i, t in of("child")], "id int, parent string, increment_column string, join_column string, parent_column string"),
            "global_table": lambda: ([(i, t.name) for i, t in of("global")], "id int, name string"),
            "single_table": lambda: ([(i, t.name) for i, t in of("single")], "id int, name string"),
            "table_sharding_node": lambda: ([(i, f"shard_{s}", k) for i, t in enumerate(tables, 1) for k, s in enumerate(nodes if t.kind == "global" else self.shards_of(t))], "id int, sharding_node string, `order` int"),
            "sharding_node": lambda: ([(f"shard_{s}",) for s in nodes], "name string"),
            "algorithm": lambda: ([(n, k, str(v)) for n, f in sorted(functions.items()) for k, v in vars(f).items()], "name string, `key` string, value string"),
            "schema": lambda: ([("default", len(tables))], "name string, tables int"),
            "version": lambda: ([(self.spark.version,)], "version string"),
        }.get(name, lambda: (None, ""))()
        if name in ("variables", "session_variables"):
            return self.variables()
        if rows is None:
            raise KeyError(name)
        return self.spark.createDataFrame(rows, schema)

    def columns(self, *names: str) -> DataFrame:
        """The system table of columns."""
        rows = [(n, i, f.name, f.dataType.simpleString(), f.nullable) for n in names for i, f in enumerate(self.table(n).schema)]
        return self.spark.createDataFrame(rows, "table_name string, position int, column_name string, type string, nullable boolean")

    def create_view(self, name: str, df: DataFrame, replace: bool = True) -> None:
        """CREATE [OR REPLACE] VIEW: the plan is kept and inlined where the view is read."""
        (df.createOrReplaceTempView if replace else df.createTempView)(name)

    def drop_view(self, name: str) -> bool:
        return self.spark.catalog.dropTempView(name)

    def create_table(self, name: str, schema: str) -> DataFrame:
        """CREATE TABLE: an empty table of that schema, as a view."""
        df = self.spark.createDataFrame([], schema)
        df.createOrReplaceTempView(name)
        return df

    def truncate(self, name: str) -> DataFrame:
        """TRUNCATE TABLE of a view's table."""
        df = self.spark.table(name).limit(0)
        df.createOrReplaceTempView(name)
        return df

    def alter(self, name: str, add: dict[str, str] | None = None, drop: list[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
        """ALTER TABLE: new columns are NULL."""
        df = self.spark.table(name)
        for column, kind in (add or {}).items():
            df = df.withColumn(column, F.lit(None).cast(kind))
        df = df.drop(*drop).withColumnsRenamed(rename or {})
        df.createOrReplaceTempView(name)
        return df

    def variables(self, like: str = "spark.sql.%") -> DataFrame:
        """The system table of session variables."""
        return self.spark.sql("SET -v").select(F.col("key").alias("variable_name"), F.col("value").alias("variable_value")).where(F.col("key").like(like))
