"""Databases over JDBC. Projection and predicate are pushed down by Spark; a limit goes into the query text."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

from kinfold.errors import ConfigurationError

# Driver class and default port of each supported database.
DRIVERS = {"mysql": ("com.mysql.cj.jdbc.Driver", 3306), "postgresql": ("org.postgresql.Driver", 5432)}


@dataclasses.dataclass(frozen=True)
class Database:
    """A stateless connection: nothing is opened until a frame is read."""

    kind: str
    host: str
    database: str
    user: str
    password: str
    port: int | None = None

    def __post_init__(self):
        if self.kind not in DRIVERS:
            raise ConfigurationError(f"unsupported database: {self.kind!r}", supported=sorted(DRIVERS))

    @property
    def url(self) -> str:
        return f"jdbc:{self.kind}://{self.host}:{self.port or DRIVERS[self.kind][1]}/{self.database}"

    def options(self) -> dict[str, str]:
        return {"url": self.url, "user": self.user, "password": self.password, "driver": DRIVERS[self.kind][0]}

    def driver_present(self, spark: SparkSession) -> bool:
        try:
            spark.sparkContext._jvm.java.lang.Class.forName(DRIVERS[self.kind][0])
            return True
        except Exception:
            return False

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options()).option("query", sql).load()

    def table(self, spark: SparkSession, name: str, columns: list[str] | None = None, where: str | None = None, limit: int | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
        """partition: (column, lower, upper, partitions) for a parallel read."""
        if limit is not None:
            return self.query(spark, table_sql(name, columns, where, limit, self.kind))
        reader = spark.read.format("jdbc").options(**self.options()).option("dbtable", quoted(name, self.kind))
        if partition:
            reader = reader.options(**dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition), strict=True)))
        return select(reader.load(), columns, where)

    def tables(self, spark: SparkSession) -> DataFrame:
        scope = "table_schema = 'public'" if self.kind == "postgresql" else "table_schema = database()"
        return self.query(spark, f"SELECT table_name FROM information_schema.tables WHERE {scope}")

    def table_info(self, spark: SparkSession, name: str) -> DataFrame:
        return describe(self.table(spark, name))


def quoted(name: str, kind: str) -> str:
    mark = "`" if kind == "mysql" else '"'
    return ".".join(mark + part.replace(mark, mark * 2) + mark for part in name.split("."))


def table_sql(name: str, columns: list[str] | None, where: str | None, limit: int | None, kind: str) -> str:
    """The text that runs in the database."""
    sql = f"SELECT {', '.join(quoted(c, kind) for c in columns) if columns else '*'} FROM {quoted(name, kind)}"
    sql += f" WHERE {where}" if where else ""
    return sql + (f" LIMIT {int(limit)}" if limit is not None else "")


def select(df: DataFrame, columns: list[str] | None = None, where: str | None = None, limit: int | None = None, order: list | None = None) -> DataFrame:
    """Predicate, projection and ordered limit of a table, from any source."""
    df = df.where(where) if where else df
    if limit is not None:
        df = df.orderBy(*(order or df.columns)).limit(limit)
    return df.select(*columns) if columns else df


def describe(df: DataFrame) -> DataFrame:
    """A row per column: position, name, type, and the table's row count."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    columns = spark.createDataFrame(rows, "position int, column_name string, data_type string")
    from pyspark.sql import functions as F

    return columns.crossJoin(df.agg(F.count(F.lit(1)).alias("row_count")))


def load_from_mysql(spark: SparkSession, host: str, database: str, user: str, password: str, table: str, port: int = 3306, **options) -> DataFrame:
    return Database("mysql", host, database, user, password, port).table(spark, table, **options)


def load_from_postgresql(spark: SparkSession, host: str, database: str, user: str, password: str, table: str, port: int = 5432, **options) -> DataFrame:
    return Database("postgresql", host, database, user, password, port).table(spark, table, **options)


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views of the session's catalog."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_name string, table_type string, is_temporary boolean")
