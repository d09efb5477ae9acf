"""Tokens, masks, SQL statements, prose and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores, of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def letter_words(text: Column) -> Column:
    """Lower-case runs of two or more letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{2,})"), 1)


def identifier_tokens(name: Column) -> Column:
    """Parts of camelCase and snake_case names, in lower case."""
    split = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(split)), " "), lambda x: x != "")


def path_pattern(path: Column) -> Column:
    """*.min.<ext>, *.bundle.<ext>, or the first folder."""
    ext = F.substring_index(path, ".", -1)
    return F.when(path.rlike(r"\.min\.[^/]*$"), F.concat(F.lit("*.min."), ext)).when(path.rlike(r"\.bundle\.[^/]*$"), F.concat(F.lit("*.bundle."), ext)).otherwise(F.concat(F.substring_index(path, "/", 1), F.lit("/")))


def utc_day(stamp: Column) -> Column:
    """The date in the first ten characters; null if there is none."""
    return F.try_to_date(F.substring(stamp, 1, 10))


def mask(text: Column, item: str, reference: str) -> Column:
    """Item ids become ITEM and references REF, so that shared ids aren't shared words."""
    return F.regexp_replace(F.regexp_replace(text, item, "ITEM"), reference, "REF")


def find_items(docs: DataFrame, item: str, skip: Column) -> DataFrame:
    """(doc_id, item, begin, end) of every match of ``item`` in ``docs`` (doc_id, text), in characters from 0.

    ``skip``: array<struct<begin, end>>; matches that touch one of these ranges are left out. What lies between matches gives
    their places, so that the regular expression runs in the JVM; sums over a text's matches are one row's work.
    """
    found = docs.select("doc_id", F.split("text", item, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(f"({item})"), 1).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("begins"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["gap"]) + F.length(x["item"])).alias("at"), F.concat(acc["begins"], F.array(acc["at"] + F.length(x["gap"]))).alias("begins"))
    pairs = F.zip_with(F.slice("gaps", 1, F.size("items")), "items", lambda g, i: F.struct(g.alias("gap"), i.alias("item")))
    placed = found.where(F.size("items") > 0).withColumn("begins", F.aggregate(pairs, zero, step, lambda acc: acc["begins"]))
    rows = placed.select("doc_id", F.explode(F.arrays_zip("items", "begins")).alias("x")).select("doc_id", F.col("x.items").alias("item"), F.col("x.begins").alias("begin"))
    rows = rows.withColumn("end", F.col("begin") + F.length("item"))
    return rows.where(~F.exists(skip, lambda r: (F.col("end") > r["begin"]) & (F.col("begin") < r["end"])))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for none."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / 4))).cast("long")


def estimate_json_tokens(record: Column) -> Column:
    """A quarter of the characters of the compact JSON form, rounded down."""
    return F.floor(F.length(F.to_json(record)) / 4).cast("long")


def tier_spec(spec: Column) -> Column:
    """"4k" is 4000, "1.5k" 1500, "64000" itself."""
    s = F.lower(F.trim(spec))
    return F.when(s.endswith("k"), (F.expr("1D") * F.regexp_replace(s, "k$", "").cast("double") * 1000).cast("long")).otherwise(s.cast("long"))


# Words that stand where a table could and are none.
NOT_TABLES = ("select", "set", "values", "where", "and", "or")


def sql_tables(query: Column) -> Column:
    """Tables of a statement after FROM, JOIN, INTO and UPDATE, lower case, in order of first mention."""
    found = F.regexp_extract_all(query, F.lit(r"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+[`\"]?(\w+)"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(x)), lambda x: ~x.isin(*NOT_TABLES)))


def sql_kind(query: Column) -> Column:
    word = F.upper(F.regexp_extract(F.trim(query), r"^(?i)(select|insert|update|delete)", 1))
    return F.when(word == "", "OTHER").otherwise(word)


def digest16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def is_prose(item: Column) -> Column:
    """Aggregate: whether half of the strings or more hold a space."""
    return F.count_if(item.contains(" ")) * 2 >= F.count(item)


def plain_inline(line: Column) -> Column:
    """Markdown links, images, code and emphasis as plain words, leading quotes gone."""
    out = F.regexp_replace(line, r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"[*`]+|(?<![A-Za-z0-9])_+|_+(?![A-Za-z0-9])", "")
    return F.trim(F.regexp_replace(out, r"^\s*>+\s*(\[![A-Z]+\])?", ""))


def includes(source: Column) -> Column:
    """#include targets in order, with their brackets or quotes."""
    return F.regexp_extract_all(source, F.lit(r"#\s*include\s*([<\"][^>\"]+[>\"])"), 1)


def numbits(bits: Column) -> Column:
    """Numbers of the set bits of a blob, the lowest bit of the first byte being 0."""
    octets = F.transform(F.sequence(F.lit(0), F.length(bits) - 1), lambda i: F.conv(F.hex(F.substring(bits, i + 1, F.lit(1))), 16, 10).cast("int"))
    each = F.transform(octets, lambda b, i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(F.getbit(b, k) == 1, i * 8 + k)), lambda x: x.isNotNull()))
    return F.when(F.length(bits) > 0, F.flatten(each)).otherwise(F.array().cast("array<int>"))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a norm is below 1e-9."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-9) | (nb < 1e-9), 0.0).otherwise(dot(a, b) / (na * nb))


#: Rules of secrets: name and pattern.
SECRETS = {"key_assignment": r"(?i)\b(?:TOKEN|SECRET|PASSWORD|API_KEY)\s*=\s*\"([0-9A-Za-z_\-]{12,})\"", "aws_key": r"\b(AKIA[0-9A-Z]{16})\b", "private_key": r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"}


def secrets(text: Column) -> Column:
    """array<struct<rule, secret>> of all matches of all rules."""

    def matches(rule: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.struct(F.lit(rule).alias("rule"), x.alias("secret")))

    return F.concat(*[matches(r, p) for r, p in SECRETS.items()])


def truncate_at(text: Column, tokens_: int) -> Column:
    """The text if it fits, else up to the last blank line that fits, else a hard cut."""
    most = tokens_ * 4
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, r"(?s)^(.+)\n\n", 1)
    return F.when(F.length(text) <= most, text).when(cut != "", cut).otherwise(head)


def definitions_and_uses(line: Column) -> Column:
    """struct(defines, uses) of an assignment `a, b = expression`; other lines only use."""
    left = F.regexp_extract(line, r"^\s*([A-Za-z_][\w, ]*?)\s*[-+*/]?=(?!=)", 1)
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"([A-Za-z_]\w*)"), 1))
    right = F.when(left != "", F.regexp_replace(line, r"^[^=]*=", "")).otherwise(line)
    return F.struct(F.when(left != "", words(left)).otherwise(F.array().cast("array<string>")).alias("defines"), words(right).alias("uses"))
