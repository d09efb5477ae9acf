"""Symbol indexes, page symbols, annotations and masks: what analyzers emit as nodes and edges."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Analyzers by name, in order of priority: (priority, requirement or None, function of DataFrames).
ANALYZERS: dict[str, tuple[int, Callable | None, Callable]] = {}


def analyzer(name: str, priority: int = 50, requires: Callable | None = None):
    """Register a DataFrame -> DataFrame analyzer; one whose ``requires`` fails isn't run."""

    def put(f):
        ANALYZERS[name] = (priority, requires, f)
        return f

    return put


def run_analyzers(files: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """The union of what all registered analyzers emit, each marked with its origin."""
    out = None
    for name, (_, requires, f) in sorted(ANALYZERS.items(), key=lambda x: (x[1][0], x[0])):
        if (only and name not in only) or (requires is not None and not requires(files)):
            continue
        part = f(files).withColumn("origin", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def some(predicate: str) -> Callable[[DataFrame], bool]:
    """A requirement: at least one row fulfils ``predicate``, an SQL expression."""
    return lambda df: not df.where(predicate).limit(1).isEmpty()


@analyzer("links", 10, some("text like '%<a%'"))
def links(files: DataFrame) -> DataFrame:
    """(path, target, pos) of the href attributes of a page, in order."""
    return files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"<a[^>]*href=\"([^\"]*)\""), 1)).alias("pos", "target"))


@analyzer("annotations", 20)
def annotations(files: DataFrame) -> DataFrame:
    """(path, target, pos) of comment directives `@calls: target`."""
    return files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"@calls:\s*([A-Za-z0-9_.]+)"), 1)).alias("pos", "target"))


def moniker(symbol: Column) -> Column:
    """struct(scheme, manager, package, version, owner, name, suffix) of `scheme manager package version descriptors`.

    Suffixes: `/` namespace, `#` type, `.` term, `().` method, `:` meta; local symbols have a name only.
    """
    part = lambda k: F.split_part(symbol, F.lit(" "), F.lit(k))
    path = F.regexp_extract(symbol, r"^\S+ \S+ \S+ \S+ (.*)$", 1)
    last = r"^(.*?)([A-Za-z0-9_$+`-]+)(\(\)\.|[/#.:!])$"
    local = symbol.startswith("local ")
    kind = F.regexp_extract(path, last, 3)
    names = F.create_map(*[F.lit(x) for x in ("/", "namespace", "#", "type", ".", "term", "().", "method", ":", "meta", "!", "macro")])
    return F.struct(
        F.when(~local, part(1)).alias("scheme"), F.when(~local, part(2)).alias("manager"), F.when(~local, part(3)).alias("package"), F.when(~local, part(4)).alias("version"),
        F.when(~local, F.regexp_extract(path, last, 1)).alias("owner"), F.when(local, F.substring(symbol, F.lit(7), F.length(symbol))).otherwise(F.regexp_extract(path, last, 2)).alias("name"), F.when(~local, F.element_at(names, kind)).alias("suffix"),
    )


def relationship_edges(index: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst, type): flags of relationships as typed edges; unknown targets become external names.

    index: symbol, relationships array<struct<symbol, implements, references>>; known: symbol, id.
    """
    r = index.select("symbol", F.inline("relationships").alias("target", "implements", "references"))
    j = r.join(known.withColumnRenamed("id", "src"), "symbol").join(known.toDF("target", "dst"), "target", "left")
    dst = F.coalesce("dst", F.concat(F.lit("py:external:0-0:"), "target", F.lit(":unresolved")))
    kind = F.filter(F.array(F.when(F.col("implements"), F.lit("implements")), F.when(F.col("references"), F.lit("references"))), lambda x: x.isNotNull())
    return j.select("src", dst.alias("dst"), F.explode(kind).alias("type"))


@F.pandas_udf(StringType())
def mask_comments(source: pd.Series) -> pd.Series:
    """Comments and docstrings blanked, lengths and lines kept. A scan with strings in mind; no built-in can keep lengths."""
    import re

    token = re.compile(r"(\"\"\".*?\"\"\"|'''.*?''')|(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(#[^\n]*)", re.S)
    blank = lambda m: m[0] if m[2] else re.sub(r"[^\n]", " ", m[0])
    return source.map(lambda s: None if s is None else token.sub(blank, s))


def header_owner(source: Column) -> Column:
    """objc where a header uses its syntax, else c_family."""
    return F.when(source.rlike(r"(?m)^\s*(@interface|@protocol|@property|#import)\b"), "objc").otherwise("c_family")
