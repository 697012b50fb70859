"""The session that queries run in."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

#: What results and plans rely on, whatever the cluster's defaults.
DEFAULTS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def open_session(name: str = "stintline", settings: Mapping[str, str] | None = None, database: str | None = None) -> SparkSession:
    """The running session, or a new one, with DEFAULTS and settings; database, if named, is made and used."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**DEFAULTS, **(settings or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if database is not None:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        spark.catalog.setCurrentDatabase(database)
    return spark


def table_columns(spark: SparkSession, database: str | None = None) -> dict[str, list[str]]:
    """The columns of every table of the catalog, by name, in order."""
    held = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    names = [t.name for t in held if not t.isTemporary]
    return {n: [c.name for c in spark.catalog.listColumns(f"{database}.{n}" if database else n)] for n in sorted(names)}
