"""Databases over JDBC: keys and references out of the catalogue, rows read in ranges of the key."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import TableSpec

FETCH_ROWS = 100_000


@contextmanager
def connected(spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> Iterator[Any]:
    """A connection of the driver's JVM; properties: user, password and others, the driver's class as driver."""
    jvm = spark._jvm
    given = jvm.java.util.Properties()
    for name, value in (properties or {}).items():
        given.setProperty(name, value)
    if properties and "driver" in properties:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        yield connection
    finally:
        connection.close()


def _rows(result: Any, *columns: str | int) -> list[tuple]:
    out = []
    while result.next():
        out.append(tuple(result.getString(c) for c in columns))
    result.close()
    return out


def qualified(name: str, schema: str | None) -> str:
    return f"{schema}.{name}" if schema else name


def table_names(spark: SparkSession, url: str, schema: str | None = None, properties: dict[str, str] | None = None) -> list[str]:
    """The tables of a schema, those of fewest rows first; the database counts them."""
    with connected(spark, url, properties) as c:
        kinds = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        names = [n for (n,) in _rows(c.getMetaData().getTables(None, schema, "%", kinds), "TABLE_NAME")]
        size = {n: int(_rows(c.createStatement().executeQuery(f"SELECT COUNT(*) FROM {qualified(n, schema)}"), 1)[0][0]) for n in names}
    return sorted(names, key=lambda n: (size[n], n))


def table_specs(spark: SparkSession, url: str, tables: list[str], schema: str | None = None, properties: dict[str, str] | None = None) -> list[TableSpec]:
    """Key and references of tables. Refused is a table whose key isn't one column; references of several columns are left out."""
    specs = []
    with connected(spark, url, properties) as c:
        catalogue = c.getMetaData()
        for t in tables:
            key = _rows(catalogue.getPrimaryKeys(None, schema, t), "COLUMN_NAME")
            if len(key) != 1:
                raise ValueError(f"{t} must have a primary key of one column")
            refers = _rows(catalogue.getImportedKeys(None, schema, t), "FK_NAME", "FKCOLUMN_NAME", "PKTABLE_NAME")
            parts = Counter(name for name, _, _ in refers)
            specs.append(TableSpec(t, key[0][0], {column: other for name, column, other in refers if parts[name] == 1}))
    return specs


def read_table(spark: SparkSession, url: str, spec: TableSpec, partitions: int, schema: str | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """A table's rows, in as many ranges of its key as partitions if that is a number. Filters that follow reach the database."""
    at = qualified(spec.name, schema)
    options = {"url": url, "fetchsize": str(FETCH_ROWS), **(properties or {})}
    read = lambda **more: spark.read.format("jdbc").options(**options, **more).load()
    df = read(dbtable=at)
    if not dict(df.dtypes)[spec.key].startswith(("tinyint", "smallint", "int", "bigint", "decimal")):
        return df
    low, high = read(query=f"SELECT MIN({spec.key}) AS low, MAX({spec.key}) AS high FROM {at}").select(F.col("low").cast("string"), F.col("high").cast("string")).first()
    if low is None:
        return df
    return read(dbtable=at, partitionColumn=spec.key, lowerBound=low, upperBound=high, numPartitions=str(partitions))
