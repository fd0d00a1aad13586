"""Facts of Python sources, and edges between symbols by joins over them."""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table
from .notes import python_symbols

FACTS = "path string, fact string, qualname string, line int, name string, module string, alias string, level int"

# What a docstring cites (notes), and mentions in backticks.
CITATION = r"docs/[\w./-]+\.md"
MENTION = r"`([\w./-]+/[\w.-]+\.\w+)`"


def _uses(tree: ast.AST) -> Iterator[tuple]:
    """(fact, qualname, line, name) of the plain names that classes inherit
    and functions call; a call counts for the innermost function around it."""
    waiting = [(tree, "", None)]
    while waiting:
        node, prefix, function = waiting.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                yield from (("inherits", prefix + child.name, child.lineno, b.id) for b in child.bases if isinstance(b, ast.Name))
                waiting.append((child, f"{prefix}{child.name}.", None))
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                waiting.append((child, f"{prefix}{child.name}.", prefix + child.name))
            else:
                if isinstance(child, ast.Call) and isinstance(child.func, ast.Name) and function:
                    yield "calls", function, child.lineno, child.func.id
                waiting.append((child, prefix, function))


def _imports(tree: ast.AST) -> Iterator[tuple]:
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from (("import", "", node.lineno, "", a.name, a.asname or "", 0) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield from (("import", "", node.lineno, a.name, node.module or "", a.asname or "", node.level) for a in node.names)


def _comments(source: str, tree: ast.AST) -> list[tuple]:
    """Comments with the innermost symbol around them; none of a source that
    cannot be read as tokens."""
    spans, waiting = [], [(tree, "")]
    while waiting:
        node, prefix = waiting.pop()
        for child in ast.iter_child_nodes(node):
            named = isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))
            if named:
                spans.append((child.end_lineno - child.lineno, child.lineno, child.end_lineno, prefix + child.name))
            waiting.append((child, f"{prefix}{child.name}." if named else prefix))
    spans.sort()
    try:
        found = [(t.start[0], t.string) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, SyntaxError, ValueError):
        return []
    inside = lambda line: next((q for _, a, b, q in spans if a <= line <= b), "")
    return [("comment", inside(line), line, body) for line, body in found]


def python_facts(files: DataFrame) -> DataFrame:
    """FACTS of Python sources (path, data): comments, imports, and the plain
    names that are inherited or called. A file that does not parse has none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, data in zip(b["path"], b["data"], strict=True):
                try:
                    source = bytes(data).decode("utf-8", "replace")
                    tree = ast.parse(source)
                except (SyntaxError, ValueError):
                    continue
                rows += [(path, *fact) for fact in _imports(tree)]
                rows += [(path, *fact, "", "", 0) for fact in (*_comments(source, tree), *_uses(tree))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])

    return files.select("path", "data").mapInPandas(parse, FACTS)


def module_path(module: Column, level: Column, path: Column) -> Column:
    """The file of a module as an import in `path` names it: from the root, or
    `level` folders up from the file itself."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(path, "/")) - level))
    parts = F.when(level > 0, folders).otherwise(F.array().cast("array<string>"))
    own = F.when(module == "", F.array().cast("array<string>")).otherwise(F.split(module, r"\."))
    return F.concat(F.array_join(F.concat(parts, own), "/"), F.lit(".py"))


def code_edges(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(path, qualname, kind, target_path, target, line): what symbols inherit
    and call, where that can be told: a name of the same file's top level, or
    one that the file imports from a file that is there. Other names are
    dropped, and so are edges of a symbol to itself."""
    facts = write_table(facts if facts is not None else python_facts(files), "facts")  # each file is parsed once for either
    uses = facts.where("fact IN ('inherits', 'calls')").select("path", "qualname", F.col("fact").alias("kind"), "name", "line").distinct()
    top = write_table(python_symbols(files).select("path", "kind", "qualname"), "symbols").where("kind IN ('class', 'function') AND NOT contains(qualname, '.')").select("path", F.col("qualname").alias("name")).distinct()
    own = uses.join(top, ["path", "name"]).select("path", "qualname", "kind", F.col("path").alias("target_path"), F.col("name").alias("target"), "line")
    named = facts.where("fact = 'import' AND name <> ''").withColumn("known_as", F.when(F.col("alias") != "", F.col("alias")).otherwise(F.col("name")))
    last = named.groupBy("path", "known_as").agg(F.max_by(F.struct("module", "name", "level"), "line").alias("i"))
    last = last.select("path", F.col("known_as").alias("name"), F.col("i.name").alias("target"), module_path(F.col("i.module"), F.col("i.level"), F.col("path")).alias("target_path"))
    there = files.select(F.col("path").alias("target_path")).distinct()
    away = uses.join(top, ["path", "name"], "left_anti").join(last, ["path", "name"]).join(there, "target_path", "left_semi")
    out = own.unionAll(away.select("path", "qualname", "kind", "target_path", "target", "line"))
    return out.where((F.col("path") != F.col("target_path")) | (F.col("qualname") != F.col("target")))


def docstring_references(symbols: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, qualname, ref_type, target, source_line): the notes that
    docstrings cite and the paths they mention, each once per symbol; with
    `known` (ref), citations of notes that are not there are dropped."""
    rows = symbols.select("path", "qualname", F.col("line_start").alias("source_line"), "docstring")
    found = lambda pattern, group: F.explode(F.array_distinct(F.regexp_extract_all("docstring", F.lit(pattern), group)))
    cited = rows.select("path", "qualname", F.lit("note-citation").alias("ref_type"), found(CITATION, 0).alias("target"), "source_line")
    if known is not None:
        cited = cited.join(known.select(F.col("ref").alias("target")), "target", "left_semi").select("path", "qualname", "ref_type", "target", "source_line")
    return cited.unionAll(rows.select("path", "qualname", F.lit("path-mention"), found(MENTION, 1), "source_line"))
