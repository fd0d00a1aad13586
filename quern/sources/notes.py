"""Notes, transcripts, batches and logs as DataFrames."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..scratch import write_table

# Folders that hold no notes.
HOUSEKEEPING = (".git", "bak", ".recycle", "assets", ".obsidian")


def note_files(spark: SparkSession, root: str, pattern: str = "*.md", exclude: tuple[str, ...] = HOUSEKEEPING) -> DataFrame:
    """(path, data) of a tree of notes, path relative to the root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.removeprefix("file://").rstrip("/") + "/"
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/{1,3}", "/")
    rows = files.select(F.substring_index(path, base, -1).alias("path"), F.col("content").alias("data"))
    return rows.where(~F.exists(F.split("path", "/"), lambda p: p.isin(*exclude)))


def notes(files: DataFrame) -> DataFrame:
    """(source_path, digest, title, text, tags, links, properties)."""
    rows = files.select(F.col("path").alias("source_path"), F.sha2("data", 256).alias("digest"), text.titled(F.col("path")).alias("title"), text.decoded(F.col("data")).alias("text"))
    t = F.col("text")
    return rows.withColumns({"tags": text.tags(t), "links": text.links(t), "properties": text.properties(t)})


def note_chunks(rows: DataFrame, provenance: str, max_chars: int = 1200, overlap: int = 150) -> DataFrame:
    """Chunks of notes, property lines left out; the one derivation that
    ingest and verification share."""
    body = rows.withColumn("text", text.strip_properties(F.col("text")))
    out = text.chunked(body, "text", max_chars, overlap)
    doc = F.coalesce(F.col("properties")["id"], F.col("source_path")) if "properties" in rows.columns else F.col("source_path")
    return out.select(ids.chunk_id(doc, F.col("chunk_text")).alias("id"), doc.alias("doc_id"), "digest", "title", "source_path", "chunk_index", F.lit(provenance).alias("provenance"), F.col("chunk_text").alias("text"), ids.digest(F.col("chunk_text")).alias("hash"))


TRANSCRIPT = "type STRING, message STRUCT<role: STRING, content: STRING>"
BLOCKS = "ARRAY<STRUCT<type: STRING, text: STRING, id: STRING, name: STRING, input: STRING, tool_use_id: STRING, content: STRING>>"


def transcript_blocks(lines: DataFrame) -> DataFrame:
    """(session_id, line, role, block, kind, ...) from (session_id, line,
    value): JSON lines; torn ones have kind `torn`."""
    row = F.from_json("value", TRANSCRIPT, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json("value").isNotNull()
    content = F.col("r.message.content")
    listed = F.startswith(F.trim(content), F.lit("["))
    blocks = F.when(listed, F.from_json(content, BLOCKS)).otherwise(F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))), BLOCKS))
    rows = lines.withColumns({"r": row, "ok": F.coalesce(valid, F.lit(False))})
    rows = rows.select("session_id", "line", "ok", F.coalesce("r.message.role", "r.type").alias("role"), F.posexplode_outer(F.when(F.col("ok"), blocks)).alias("block", "b"))
    return rows.select("session_id", "line", "role", "block", F.when(~F.col("ok"), "torn").otherwise(F.col("b.type")).alias("kind"), "b.text", F.col("b.id").alias("use_id"), F.col("b.name").alias("tool"), "b.input", "b.tool_use_id", "b.content")


def utterances(blocks: DataFrame) -> DataFrame:
    """(session_id, turn_index, speaker, text): text blocks of users and
    assistants, numbered from 0 without gaps; secrets are named in `secret`
    and their text is dropped."""
    rows = blocks.where("kind = 'text' AND role IN ('user', 'assistant') AND trim(text) <> ''")
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("line", "block")) - 1
    secret = text.first_secret(F.col("text"))
    return rows.select("session_id", turn.alias("turn_index"), F.when(F.col("role") == "user", "owner").otherwise("agent").alias("speaker"), F.when(secret.isNull(), F.col("text")).alias("text"), secret.alias("secret"))


def transcript_events(blocks: DataFrame) -> DataFrame:
    """(session_id, ord, actor, kind, ref, turn_index): prompts, responses,
    tool uses with their results, numbered from 0."""
    results = blocks.where("kind = 'tool_result'").groupBy("session_id", F.col("tool_use_id").alias("use_id")).agg(F.max("content").alias("result"))
    rows = blocks.where("kind IN ('text', 'tool_use') AND role IN ('user', 'assistant')").join(results, ["session_id", "use_id"], "left")
    path = F.get_json_object("input", "$.file_path")
    command = F.get_json_object("input", "$.command")
    kind = (
        F.when((F.col("kind") == "text") & (F.col("role") == "user"), "prompt").when(F.col("kind") == "text", "response")
        .when(command.contains("git commit"), "commit").when(path.isNotNull(), "file_edit").otherwise("tool_use")
    )
    commit = F.regexp_extract(F.coalesce("result", F.lit("")), r"\[[^\]]* ([0-9a-f]{7,40})\]", 1)
    ref = F.when(kind == "commit", F.nullif(commit, F.lit(""))).when(kind == "file_edit", path).otherwise(F.col("tool"))
    w = Window.partitionBy("session_id").orderBy("line", "block")
    turns = F.sum((F.col("kind") == "text").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.select("session_id", (F.row_number().over(w) - 1).alias("ord"), F.when(F.col("role") == "user", "owner").otherwise("agent").alias("actor"), kind.alias("kind"), ref.alias("ref"), turns.alias("turn_index"))


def json_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of JSON batches as a stream; files that were read are moved
    to an archive folder beside it."""
    reader = spark.readStream.schema(schema).option("multiLine", True)
    return reader.option("cleanSource", "archive").option("sourceArchiveDir", folder.rstrip("/") + "-read").json(folder)


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit_sha, parent, at, author, subject, type, scope) from text files
    written by `git log --format=%H%x09%P%x09%cI%x09%an%x09%s`."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    kind, scope = text.commit_header(F.col("subject"))
    out = rows.select(F.get("c", F.lit(0)).alias("commit_sha"), F.nullif(F.get(F.split(F.get("c", F.lit(1)), " "), F.lit(0)), F.lit("")).alias("parent"), F.to_timestamp(F.get("c", F.lit(2))).alias("at"), F.get("c", F.lit(3)).alias("author"), F.get("c", F.lit(4)).alias("subject"))
    return out.withColumns({"type": kind, "scope": scope})


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, digest, qualname, kind, signature, docstring, line_start,
    line_end, imports) of Python sources (path, data); a file that does not
    parse has one row of kind `unparsed`."""
    schema = "path string, digest string, qualname string, kind string, signature string, docstring string, line_start int, line_end int, imports array<string>"

    def walk(node, prefix):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}{child.name}"
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                sig = f"{child.name}({ast.unparse(child.args)})" if kind == "function" else child.name
                yield name, kind, sig, ast.get_docstring(child) or "", child.lineno, child.end_lineno
                yield from walk(child, name + ".")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["data"], strict=True):
                raw = bytes(data)
                sha = hashlib.sha256(raw).hexdigest()
                try:
                    tree = ast.parse(raw)
                except (SyntaxError, ValueError):
                    rows.append((path, sha, "", "unparsed", "", "", 0, 0, []))
                    continue
                names = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                names += [n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module]
                rows.append((path, sha, "", "module", "", ast.get_docstring(tree) or "", 1, raw.count(b"\n") + 1, sorted(set(names))))
                rows += [(path, sha, *r, []) for r in walk(tree, "")]
            yield pd.DataFrame(rows, columns=["path", "digest", "qualname", "kind", "signature", "docstring", "line_start", "line_end", "imports"])

    return files.select("path", "data").mapInPandas(parse, schema)


def references(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(source_ref, target_ref, ref_type): links `[[x]]` and mentioned paths
    in texts (source_ref, text); targets that are not known are dropped."""
    linked = rows.select("source_ref", F.explode(text.links(F.col("text"))).alias("target_ref"), F.lit("link").alias("ref_type"))
    paths = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\w./-]+/[\w.-]+\.(?:md|py|toml|json)"), 0))
    mentioned = rows.select("source_ref", F.explode(paths).alias("target_ref"), F.lit("path").alias("ref_type"))
    out = linked.unionAll(mentioned).where("source_ref <> target_ref").distinct()
    return out.join(known.select(F.col("ref").alias("target_ref")), "target_ref", "left_semi").select("source_ref", "target_ref", "ref_type") if known is not None else out


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, href, n): link targets of pages."""
    hrefs = F.explode(F.regexp_extract_all("html", F.lit(r"href=\"([^\"]*)\""), 1))
    return pages.select("page_id", hrefs.alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


def _with_commits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, at, commit_sha, line) of the lines of changed files with the last
    commit above them in their block, null if none, and for every block a row
    without a line that has its last commit."""
    names = ["f", "at", "commit_sha", "line"]
    here, sha = None, None

    def end() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*here, sha, None), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names)

    for b in batches:
        lines, f, at = (b.column(i) for i in range(3))
        turn = np.flatnonzero((np.diff(f.dictionary_encode().indices.to_numpy()) != 0) | (np.diff(at.to_numpy()) != 0)) + 1
        for lo, hi in zip([0, *turn], [*turn, b.num_rows], strict=True):
            if hi == lo:
                continue
            block = f[int(lo)].as_py(), at[int(lo)].as_py()
            if block != here:
                if here is not None:
                    yield end()
                here, sha = block, None
            part = lines[lo:hi]
            # by place: if_else garbles the strings of a slice that starts later than its batch
            place = np.where(pc.match_substring_regex(part, "^[0-9a-f]{40}$").to_numpy(zero_copy_only=False), np.arange(hi - lo), -1)
            place = np.maximum.accumulate(place)
            found = pc.fill_null(part.take(pa.array(place, mask=place < 0)), pa.scalar(sha, pa.string()))
            sha = found[-1].as_py()
            changed = pc.starts_with(part, ":")
            kept = found.filter(changed)
            if len(kept):
                yield pa.RecordBatch.from_arrays([f[lo:hi].filter(changed), at[lo:hi].filter(changed), kept, part.filter(changed)], names)
    if here is not None:
        yield end()


def commit_diffs(spark: SparkSession, path: str) -> DataFrame:
    """(commit_sha, path, old_blob, new_blob) from text files written by
    `git log --raw --no-renames --no-abbrev --first-parent --format=%H`:
    a rename is a deletion and an addition; a blob that is not there is null."""
    # Files are read by blocks, line by line. A block's lines are in one task, in
    # order; what comes before its first commit belongs to the last one of an
    # earlier block of the file, which is known from one row for each block.
    lines = spark.read.text(path, lineSep="\n").select("value", "_metadata.file_path", "_metadata.file_block_start")
    filled = write_table(lines.mapInArrow(_with_commits, "f string, at long, commit_sha string, line string"), "commit-lines")
    own = Window.partitionBy("f").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as blocks
    last = filled.where("line IS NULL").select("f", "at", F.last("commit_sha", ignorenulls=True).over(own).alias("__last"))
    rows = filled.where("line IS NOT NULL").join(F.broadcast(last), ["f", "at"]).withColumn("commit_sha", F.coalesce("commit_sha", "__last"))
    rows = rows.select("commit_sha", F.split("line", "[ \t]").alias("c"), F.substring_index("line", "\t", -1).alias("path"))
    blob = lambda i: F.when(~F.get("c", F.lit(i)).rlike("^0+$"), F.get("c", F.lit(i)))
    return rows.select("commit_sha", "path", blob(2).alias("old_blob"), blob(3).alias("new_blob"))


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, expected, k) of a JSON file of golden queries."""
    return spark.read.schema("id STRING, query STRING, expected ARRAY<STRING>, k INT").option("multiLine", True).json(path)


def system_vitals(spark: SparkSession) -> DataFrame:
    """One reading of this host's load, as vitals rows."""
    import os
    from datetime import datetime, timezone

    now = datetime.now(timezone.utc).replace(tzinfo=None)
    values = list(zip(("load_1m", "load_5m", "load_15m"), os.getloadavg(), strict=True)) + [("cpus", float(os.cpu_count() or 0))]
    return spark.createDataFrame([(now, m, float(v), "", "host", None) for m, v in values], "ts TIMESTAMP_NTZ, metric STRING, value DOUBLE, unit STRING, source STRING, labels STRING")


def code_chunks(files: DataFrame, max_chars: int = 1200, overlap: int = 150) -> DataFrame:
    """(id, path, layer, qualname, line_start, line_end, text) of Python
    sources (path, data): doc (a symbol's signature and docstring), body (its
    source) and window (the whole file in windows). The id hashes the text
    without its header, so a moved symbol keeps its content hash."""
    symbols = python_symbols(files).where("kind IN ('class', 'function')")
    lines = F.split(text.decoded(F.col("data")), "\n")
    own = symbols.join(files.select("path", lines.alias("l")), "path")
    body = F.array_join(F.slice("l", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    doc = F.when(F.col("docstring") != "", F.concat_ws("\n", "signature", "docstring"))
    head = F.concat(F.lit("# "), "path", F.lit(" "), "qualname", F.lit("\n"))
    parts = own.select("path", "qualname", "line_start", "line_end", head.alias("head"), F.explode(F.array(F.struct(F.lit("doc").alias("layer"), doc.alias("text")), F.struct(F.lit("body").alias("layer"), body.alias("text")))).alias("p"))
    parts = parts.select("path", "p.layer", "qualname", "line_start", "line_end", "head", "p.text").where("text IS NOT NULL")

    @F.pandas_udf("array<string>")
    def windows(col: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in col:
            yield s.map(lambda t: text.chunk_windows(t, max_chars, overlap))

    whole = files.select("path", F.explode(windows(text.decoded(F.col("data")))).alias("text"))
    whole = whole.select("path", F.lit("window").alias("layer"), F.lit("").alias("qualname"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit("").alias("head"), "text")
    rows = parts.unionAll(whole)
    return rows.select(F.concat_ws(":", "path", "layer", ids.digest(F.col("text"))).alias("id"), "path", "layer", "qualname", "line_start", "line_end", F.concat("head", "text").alias("text"))
