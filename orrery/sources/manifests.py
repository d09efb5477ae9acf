"""Dependencies and targets that manifests declare, from their text, without leaving the JVM.

Every function takes a column of whole manifest texts and gives array<struct<name, version, scope>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scopes from the nearest to a runtime dependency to the furthest.
SCOPE_RANK = {"runtime": 0, "optional": 1, "dev": 2, "build": 3}


def _entries(names: Column, versions: Column, scope: str) -> Column:
    return F.zip_with(names, versions, lambda n, v: F.struct(n.alias("name"), v.alias("version"), F.lit(scope).alias("scope")))


def npm(text: Column) -> Column:
    """package.json: dependencies, optionalDependencies and devDependencies."""
    kinds = {"dependencies": "runtime", "optionalDependencies": "optional", "devDependencies": "dev"}
    doc = F.from_json(text, ", ".join(f"{k} map<string,string>" for k in kinds))
    none = F.create_map().cast("map<string,string>")

    def part(k: str, scope: str) -> Column:
        m = F.coalesce(doc[k], none)
        return _entries(F.map_keys(m), F.map_values(m), scope)

    return F.concat(*[part(k, s) for k, s in kinds.items()])


def npm_scripts(text: Column) -> Column:
    """array<struct<key, value>> of package.json's scripts."""
    return F.map_entries(F.from_json(text, "scripts map<string,string>")["scripts"])


def python(text: Column) -> Column:
    """pyproject.toml: [project] dependencies and [build-system] requires."""
    one = r"\"([A-Za-z0-9_.\-]+)\s*(?:\[[^\]]*\])?\s*[^\"]*\""
    version = r"\"[A-Za-z0-9_.\-]+\s*(?:\[[^\]]*\])?\s*([^\"]*)\""
    listed = r"\[((?:[^\]\"]|\"[^\"]*\")*)\]"
    own = F.regexp_extract(text, rf"(?:^|\n)dependencies\s*=\s*{listed}", 1)
    build = F.regexp_extract(text, rf"(?:^|\n)requires\s*=\s*{listed}", 1)
    part = lambda t, s: _entries(F.regexp_extract_all(t, F.lit(one), 1), F.regexp_extract_all(t, F.lit(version), 1), s)
    return F.concat(part(own, "runtime"), part(build, "build"))


def maven(text: Column) -> Column:
    """pom.xml dependencies that give group, artifact and version in that order."""
    p = r"(?s)<dependency>\s*<groupId>([^<]*)</groupId>\s*<artifactId>([^<]*)</artifactId>\s*(?:<version>([^<]*)</version>)?"
    group, artifact, version = (F.regexp_extract_all(text, F.lit(p), k) for k in (1, 2, 3))
    return _entries(F.zip_with(group, artifact, lambda a, b: F.concat(a, F.lit(":"), b)), version, "runtime")


def gradle(text: Column) -> Column:
    """implementation, api and testImplementation lines."""
    part = lambda word, s: _entries(F.regexp_extract_all(text, F.lit(rf"\b{word}\s*\(?['\"]([^:'\"]+:[^:'\"]+):[^'\"]+['\"]"), 1), F.regexp_extract_all(text, F.lit(rf"\b{word}\s*\(?['\"][^:'\"]+:[^:'\"]+:([^'\"]+)['\"]"), 1), s)
    return F.concat(part("(?:implementation|api)", "runtime"), part("testImplementation", "dev"))


def mix(text: Column) -> Column:
    """mix.exs dependencies: {:name, "version"}."""
    p = r"\{:([a-z_0-9]+),\s*\"([^\"]*)\""
    return _entries(F.regexp_extract_all(text, F.lit(p), 1), F.regexp_extract_all(text, F.lit(p), 2), "runtime")


PARSERS = {"package.json": npm, "pyproject.toml": python, "pom.xml": maven, "build.gradle": gradle, "mix.exs": mix}


def dependencies(files):
    """(path, name, version, scope) of a table of (path, text), by file name."""
    base = F.substring_index("path", "/", -1)
    found = None
    for name, parse in PARSERS.items():
        found = F.when(base == name, parse(F.col("text"))) if found is None else found.when(base == name, parse(F.col("text")))
    return files.select("path", F.inline(found))
