"""SQLite files as tables: stored graphs, coverage databases and caches.

A file is read whole by one task, from whatever store Spark reads; a file's rows leave it in chunks. Writing gives one file
for each key, built in memory and put into place by its name, so that a repeated task leaves the same file.
"""

from __future__ import annotations

import os
import re
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Rows of a chunk.
CHUNK = 10_000


def read_sqlite(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """The rows that ``sql`` gives in each of the SQLite files at ``path``, of all of them together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(content))
                yield from pd.read_sql_query(sql, con, chunksize=CHUNK)
                con.close()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sqlite").load(path).select("content")
    return files.mapInPandas(run, schema)


def write_sqlite(rows: DataFrame, key: str, table: str, folder: str, primary_key: str) -> DataFrame:
    """(key, file, rows): a file for each value of ``key``, its rows as ``table``; of equal primary keys the last one stays."""
    columns = [c for c in rows.columns if c != key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        con = sqlite3.connect(":memory:")
        con.execute(f"CREATE TABLE {table} ({', '.join(columns)}, PRIMARY KEY ({primary_key})) WITHOUT ROWID")
        con.executemany(f"INSERT OR REPLACE INTO {table} VALUES ({', '.join('?' * len(columns))})", pdf[columns].sort_values(columns).astype(object).values.tolist())
        con.commit()
        n = con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
        name = f"{folder}/{pdf[key].iloc[0]}.sqlite"
        local = re.match(r"file:/*(/.*)", name)
        store, plain = (fs.LocalFileSystem(), local[1]) if local else (fs.LocalFileSystem(), name) if name.startswith("/") else fs.FileSystem.from_uri(name)
        store.create_dir(os.path.dirname(plain), recursive=True)
        with store.open_output_stream(f"{plain}.tmp") as out:
            out.write(con.serialize())
        store.move(f"{plain}.tmp", plain)
        return pd.DataFrame({"key": [str(pdf[key].iloc[0])], "file": [name], "rows": [n]})

    return rows.groupBy(key).applyInPandas(run, "key string, file string, rows long")
