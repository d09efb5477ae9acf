"""Python source cut into blocks: module, classes and functions with shape digests and numbered statements.

Parsing needs the language's own parser, so it runs in Arrow-batched Python, a file at a time; nothing is kept between files.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
#: The name of a file's outermost block.
MODULE = "<module>"
BLOCKS = "path string, name string, first_line int, last_line int, header_line int, digest string, import_time boolean, statements int, error string"
OWNERS = "path string, line int, block string, ordinal int"


def shape(node: ast.AST) -> str:
    """A node's structure without positions and without the blocks inside it."""
    parts = []
    for name, value in ast.iter_fields(node):
        if isinstance(value, list):
            inner = ",".join(shape(v) if isinstance(v, ast.AST) else repr(v) for v in value if not isinstance(v, BLOCK))
            parts.append(f"{name}=[{inner}]")
        elif isinstance(value, ast.AST):
            parts.append(f"{name}={shape(value)}")
        else:
            parts.append(f"{name}={value!r}")
    return f"{type(node).__name__}({';'.join(parts)})"


def _near(node: ast.AST, kind: tuple[type, ...]) -> Iterator[ast.AST]:
    """Nodes of ``kind`` below ``node`` in tree order, outside of blocks in between."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, kind):
            yield child
        if not isinstance(child, BLOCK):
            yield from _near(child, kind)


def blocks_of(source: str) -> list[dict]:
    """The blocks of a source, outer before inner; ``spans`` are the lines of each one's own statements. A block owns its body, not its header."""

    def described(node: ast.AST, name: str, first: int, last: int, header: int, at_import: bool) -> dict:
        own = [(s.lineno, s.end_lineno) for s in _near(node, (ast.stmt, ast.excepthandler)) if not isinstance(s, BLOCK)]
        return {"name": name, "first_line": first, "last_line": last, "header_line": header, "digest": hashlib.sha256(shape(node).encode()).hexdigest()[:32], "import_time": at_import, "spans": own}

    tree = ast.parse(source)
    out = [described(tree, MODULE, 1, max(1, len(source.splitlines())), 1, True)]
    todo = [(tree, "", True)]
    while todo:
        node, prefix, at_import = todo.pop()
        seen: dict[str, int] = {}
        inner = []
        for child in _near(node, BLOCK):
            k = seen[child.name] = seen.get(child.name, 0) + 1
            name = f"{prefix}{child.name}" + (f"#{k}" if k > 1 else "")
            runs = at_import and isinstance(child, ast.ClassDef)
            out.append(described(child, name, child.body[0].lineno, child.end_lineno or child.lineno, min([child.lineno, *(d.lineno for d in child.decorator_list)]), runs))
            inner.append((child, f"{name}.", runs))
        todo += reversed(inner)
    return out


def owners(blocks: list[dict]) -> dict[int, tuple[str, int]]:
    """{line: (block, number of its statement)}: the innermost block's innermost statement; headers belong to none."""
    out: dict[int, tuple[str, int]] = {}
    for b in sorted(blocks, key=lambda b: (b["header_line"], -b["last_line"])) if blocks else []:
        if b["name"] != MODULE:
            for line in range(b["header_line"], b["last_line"] + 1):
                out.pop(line, None)
        for k, (first, last) in enumerate(b["spans"]):
            for line in range(first, last + 1):
                out[line] = (b["name"], k)
    return out


def _read(sources: DataFrame, rows, schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += rows(path, blocks_of(text))
                except (SyntaxError, ValueError, RecursionError) as e:
                    out += rows(path, [], type(e).__name__)
            yield pa.RecordBatch.from_pylist(out, schema)

    return sources.where("text is not null").select("path", "text").mapInArrow(run, ddl)


def source_blocks(sources: DataFrame) -> DataFrame:
    """BLOCKS of (path, text). A text that can't be parsed gives one row with the error; null texts give none."""
    kinds = {"first_line": pa.int32(), "last_line": pa.int32(), "header_line": pa.int32(), "statements": pa.int32(), "import_time": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.string())) for c in BLOCKS.split(", ")])

    def rows(path: str, found: list[dict], error: str | None = None) -> list[dict]:
        return [{"path": path, **b, "statements": len(b["spans"])} for b in found] or [{"path": path, "error": error}]

    return _read(sources, rows, schema, BLOCKS)


def statement_owners(sources: DataFrame) -> DataFrame:
    """OWNERS of (path, text): a row for each line that a statement owns. Texts that can't be parsed give none."""
    schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("block", pa.string()), ("ordinal", pa.int32())])

    def rows(path: str, found: list[dict], error: str | None = None) -> list[dict]:
        return [{"path": path, "line": line, "block": block, "ordinal": k} for line, (block, k) in sorted(owners(found).items())]

    return _read(sources, rows, schema, OWNERS)
