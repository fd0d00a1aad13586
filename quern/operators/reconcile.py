"""Joins that reconcile tables: catalogs, commits, histories, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import digest
from ..scratch import partitions, write_table
from .merge import missing_from


def tails_of(nodes: DataFrame, head: str | None = None) -> DataFrame:
    """(head, tail) of hyperedges stored as (edge_id, node_id, role)."""
    h = nodes.where("role = 'head'").select("edge_id", F.col("node_id").alias("head"))
    t = nodes.where("role = 'tail'").select("edge_id", F.col("node_id").alias("tail"))
    out = h.join(t, "edge_id").select("head", "tail").distinct()
    return out.where(F.col("head") == head) if head is not None else out


def hyperedges(nodes: DataFrame) -> DataFrame:
    """(edge_id, head, tails)."""
    return nodes.groupBy("edge_id").agg(
        F.max(F.when(F.col("role") == "head", F.col("node_id"))).alias("head"),
        F.array_sort(F.collect_set(F.when(F.col("role") == "tail", F.col("node_id")))).alias("tails"),
    )


def value_changes(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before (nulls add nothing)."""
    kept = rows.where(F.col(value).isNotNull())
    before = F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    return kept.withColumn("__b", before).where(~F.col(value).eqNullSafe(F.col("__b"))).drop("__b")


def supersession_chains(diffs: DataFrame, commits: DataFrame) -> DataFrame:
    """(path, seq, blob): each path's distinct consecutive contents, in the
    order in which commits were captured; deletions add nothing."""
    rows = diffs.join(commits.select("commit_sha", "seq"), "commit_sha").select("path", "seq", F.col("new_blob").alias("blob"))
    return value_changes(rows, "path", ["seq"], "blob")


def review_queue(claims: DataFrame, runs: DataFrame, novel_only: bool = False) -> DataFrame:
    """Claims with their run's pipeline (`unknown` without a run), the novel
    and sure ones first within a pipeline, pipelines in turns."""
    rows = claims.join(runs.select("run_id", "pipeline"), "run_id", "left").withColumn("pipeline", F.coalesce("pipeline", F.lit("unknown")))
    if novel_only:
        rows = rows.where("novel")
    w = Window.partitionBy("pipeline").orderBy(F.desc("novel"), F.desc("confidence"), "claim_id")
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", "pipeline")


def origins(references: DataFrame, causes: DataFrame) -> DataFrame:
    """(edge_id, session_id, cause_id): the earliest cause of the commit at
    which an edge was seen; ties by id."""
    first = causes.groupBy(F.col("pair_cut_sha").alias("commit_sha")).agg(F.min(F.struct("event_order", F.col("edge_id").alias("cause_id"), "session_id")).alias("m"))
    best = references.select("edge_id", "commit_sha").distinct().join(first, "commit_sha").groupBy("edge_id").agg(F.min("m").alias("m"))
    return best.select("edge_id", F.col("m.session_id").alias("session_id"), F.col("m.cause_id").alias("cause_id"))


def resolve_prefixes(refs: DataFrame, commits: DataFrame, shortest: int = 4) -> DataFrame:
    """refs (ref) with commit_sha and outcome: resolved, ambiguous, unknown,
    or unparsed for what is no prefix of a hash.

    A prefix join without comparing all with all: every hash is keyed by its
    first `shortest` digits, and prefixes are joined on them."""
    fine = F.col("ref").rlike(f"^[0-9a-f]{{{shortest},40}}$")
    r = refs.select("ref").distinct().withColumn("__k", F.when(fine, F.substring("ref", 1, shortest)))
    c = commits.select("commit_sha", F.substring("commit_sha", 1, shortest).alias("__k"))
    hit = r.join(c, "__k", "left").withColumn("commit_sha", F.when(F.startswith("commit_sha", F.col("ref")), F.col("commit_sha")))
    out = hit.groupBy("ref").agg(F.countDistinct("commit_sha").alias("n"), F.min("commit_sha").alias("commit_sha"), F.max("__k").alias("__k"))
    outcome = F.when(F.col("__k").isNull(), "unparsed").when(F.col("n") == 0, "unknown").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return out.select("ref", F.when(F.col("n") == 1, F.col("commit_sha")).alias("commit_sha"), outcome.alias("outcome"))


def producers_of(attestations: DataFrame, hashes: DataFrame) -> DataFrame:
    """Attestations one of whose outputs is among the hashes."""
    out = attestations.select("id", F.explode("output_hashes").alias("hash")).join(hashes.select("hash").distinct(), "hash", "left_semi")
    return attestations.join(out.select("id").distinct(), "id", "left_semi")


def reads_from(produced: DataFrame, consumed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, one row `unmatched`): producer -> consumer of one identifier,
    not to itself; identifiers that nothing produced are counted."""
    edges = produced.select(F.col("event").alias("source"), "item").join(consumed.select(F.col("event").alias("target"), "item"), "item")
    edges = edges.where("source <> target").select("source", "target").distinct()
    lost = consumed.join(produced.select("item").distinct(), "item", "left_anti")
    return edges, lost.agg(F.count(F.lit(1)).alias("unmatched"))


def reconcile_files(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """(source_path, digest, outcome, old_path): unchanged, changed, new,
    renamed or gone. A new file is a rename if exactly one gone path had its
    content and no other new file has; else it is new."""
    c = catalog.where("active").select(F.col("source_path").alias("cp"), F.col("digest").alias("cd"))
    f = files.select(F.col("source_path").alias("fp"), F.col("digest").alias("fd"))
    both = c.join(f, F.col("cp") == F.col("fp"), "full")
    gone = both.where("fp IS NULL").groupBy(F.col("cd").alias("d")).agg(F.count(F.lit(1)).alias("ng"), F.min("cp").alias("old_path"))
    new = both.where("cp IS NULL").groupBy(F.col("fd").alias("d2")).agg(F.count(F.lit(1)).alias("nn"))
    moves = gone.where("ng = 1").join(new.where("nn = 1"), F.col("d") == F.col("d2")).select("d", "old_path")
    moved = both.join(moves, F.when(F.col("cp").isNull(), F.col("fd")) == F.col("d"), "left")
    left = moves.select(F.col("old_path").alias("left_path"))
    moved = moved.join(left, F.when(F.col("fp").isNull(), F.col("cp")) == F.col("left_path"), "left").where("left_path IS NULL")
    outcome = (
        F.when(F.col("fp").isNull(), "gone").when(F.col("cp").isNotNull() & (F.col("cd") == F.col("fd")), "unchanged")
        .when(F.col("cp").isNotNull(), "changed").when(F.col("old_path").isNotNull(), "renamed").otherwise("new")
    )
    return moved.select(F.coalesce("fp", "cp").alias("source_path"), F.coalesce("fd", "cd").alias("digest"), outcome.alias("outcome"), "old_path")


def prune_candidates(chunks: DataFrame, raw: DataFrame) -> DataFrame:
    """(digest, title) of chunks whose blob is gone, the first title each."""
    lost = missing_from(chunks.select("digest", "title", "id"), raw, ["digest"])
    return lost.groupBy("digest").agg(F.min_by("title", "id").alias("title"))


def verify_chunks(rows: DataFrame, raw_chunks: DataFrame) -> DataFrame:
    """rows (id, digest, text) with reason: null if the text is among the
    chunks derived anew from its blob, else raw-missing or text-not-in-raw."""
    known = raw_chunks.select(F.col("digest").alias("__d")).distinct()
    texts = raw_chunks.select(F.col("digest").alias("__d2"), digest(F.col("text")).alias("__t")).distinct()
    out = rows.join(known, F.col("digest") == F.col("__d"), "left")
    out = out.join(texts, (F.col("digest") == F.col("__d2")) & (digest(F.col("text")) == F.col("__t")), "left")
    reason = F.when(F.col("__d").isNull(), "raw-missing").when(F.col("__t").isNull(), "text-not-in-raw")
    return out.withColumn("reason", reason).drop("__d", "__d2", "__t")


def amendment(old: DataFrame, new: DataFrame, doc: str = "doc_id", chunk: str = "hash") -> DataFrame:
    """(doc_id, hash, outcome): retained, added or removed chunk hashes; the
    order of chunks does not matter."""
    o = old.select(doc, chunk).distinct().withColumn("was", F.lit(True))
    n = new.select(doc, chunk).distinct().withColumn("is", F.lit(True))
    outcome = F.when(F.col("was") & F.col("is"), "retained").when(F.col("is"), "added").otherwise("removed")
    return o.join(n, [doc, chunk], "full").select(doc, chunk, outcome.alias("outcome"))


def reuse_vectors(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused, missing): new chunks (doc_id, hash, ...) with the vector that
    their content already has, and those that must be embedded."""
    have = old.groupBy("hash").agg(F.first("vector").alias("vector"))
    return new.join(have, "hash"), new.join(have, "hash", "left_anti")


def proven_pairs(causes: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(a, b, session_id): distinct documents that one session touched, each
    at its earliest event. Without any, the evidence is empty: an error."""
    docs = causes.where("dst_type = 'doc'").groupBy("session_id", "dst").agg(F.min("event_order").alias("at"))
    if nodes is not None:
        docs = docs.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    pair = docs.select("session_id", F.col("dst").alias("a")).join(docs.select("session_id", F.col("dst").alias("b")), "session_id").where("a < b")
    if pair.isEmpty():
        raise ValueError("no session proves a pair")
    return pair.groupBy("a", "b").agg(F.min("session_id").alias("session_id"))


def coverage(events: DataFrame, edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row: events of the kinds that could be integrated, those that
    edges witness, and the share (0 of none)."""
    want = events.where(F.col("kind").isin(*kinds)).select("session_id", F.col("ord").alias("event_order"))
    got = edges.select("session_id", "event_order").distinct().withColumn("seen", F.lit(1))
    out = want.join(got, ["session_id", "event_order"], "left").agg(F.count(F.lit(1)).alias("integrable"), F.count("seen").alias("witnessed"))
    return out.withColumn("coverage", F.when(F.col("integrable") > 0, F.col("witnessed") / F.col("integrable")).otherwise(0.0))


def generation_bracket(ticks: DataFrame, walls: DataFrame) -> DataFrame:
    """walls (wall) with lo, hi, widened, future: the last generation at or
    before each wall time and the first after it. Clocks may run back: an
    inverted or wide bracket is widened to both and flagged."""
    # an as-of join: ticks and walls in one order, dealt by ranges of it; states
    # are carried along within a range, and over ranges by one row for each
    t = ticks.select(F.col("at").alias("x"), F.lit(0).alias("q"), F.col("generation").alias("g"))
    w = walls.select(F.col("wall").alias("x"), F.lit(1).alias("q"), F.lit(None).cast("int").alias("g"))
    rows = t.unionAll(w)
    rows = write_table(rows.repartitionByRange(partitions(rows.sparkSession), "x", "q").withColumn("__r", F.spark_partition_id()), "walls")
    # what comes after is what came before in the order turned round: a frame up
    # to the end of the range would be summed anew for each row
    before = Window.partitionBy("__r").orderBy("x", "q").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("__r").orderBy(F.desc("x"), F.desc("q")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(F.col("__r").alias("__range")).agg(F.max("g").alias("top"), F.min("g").alias("low"))
    over = Window.orderBy("__range")  # as many rows as ranges
    carried = ranges.select(
        "__range", F.max("top").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.min("low").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    out = rows.withColumns({"lo": F.max("g").over(before), "hi": F.min("g").over(after)}).where("q = 1")
    out = out.join(F.broadcast(carried), F.col("__r") == F.col("__range"))
    lo, hi = F.greatest("lo", "__before"), F.least("hi", "__after")
    out = out.select(F.col("x").alias("wall"), lo.alias("lo"), hi.alias("hi"))
    odd = (F.col("lo") > F.col("hi")) | (F.col("hi") - F.col("lo") > 1)
    return out.select(
        "wall", F.when(odd, F.least("lo", "hi")).otherwise(F.col("lo")).alias("lo"), F.when(odd, F.greatest("lo", "hi")).otherwise(F.col("hi")).alias("hi"),
        F.coalesce(odd, F.lit(False)).alias("widened"), F.col("hi").isNull().alias("future"),
    )


def stale_after(derived_from: DataFrame, start: DataFrame) -> DataFrame:
    """(id): everything derived, at any remove, from the start ids."""
    e = write_table(derived_from.select("id", "parent").distinct(), "derived")
    seen = start.select("id").distinct()
    frontier = seen
    while True:
        frontier = write_table(e.join(frontier.select(F.col("id").alias("parent")), "parent", "left_semi").select("id").distinct().join(seen, "id", "left_anti"), "stale")
        if frontier.isEmpty():
            return seen.join(start.select("id"), "id", "left_anti")
        seen = seen.unionAll(frontier)


def facts_introduced(facts: DataFrame, parents: DataFrame) -> DataFrame:
    """Facts (commit_sha, key, value) that a commit's first parent has not,
    or has with another value."""
    p = facts.select(F.col("commit_sha").alias("parent"), "key", F.col("value").alias("__old"), F.lit(True).alias("__had"))
    rows = facts.join(parents, "commit_sha", "left").join(p, ["parent", "key"], "left")
    return rows.where(F.col("__had").isNull() | ~F.col("value").eqNullSafe(F.col("__old"))).select("commit_sha", "key", "value")


def resolve_document(catalog: DataFrame, ref: str) -> str:
    """The one active document whose path is, or ends in, the reference."""
    found = catalog.where(F.col("active") & ((F.col("source_path") == ref) | F.endswith("source_path", F.lit("/" + ref)))).select("source_path").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{ref} names {'several documents' if found else 'no document'}")
    return found[0].source_path


def resolve_documents(catalog: DataFrame, refs: DataFrame) -> DataFrame:
    """refs (ref) with source_path and outcome (resolved, ambiguous, unknown):
    the one active document whose path is, or ends in, the reference. Every
    path is known by its own endings, so references are looked up by a join."""
    active = catalog.where("active").select("source_path").distinct()
    parts = F.split("source_path", "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    known = active.select("source_path", F.explode(F.array_distinct(endings)).alias("ref"))
    asked = refs.select("ref").distinct()
    found = known.join(asked, "ref", "left_semi").groupBy("ref").agg(F.countDistinct("source_path").alias("n"), F.min("source_path").alias("source_path"))
    out = asked.join(found, "ref", "left")
    what = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return out.select("ref", F.when(F.col("n") == 1, F.col("source_path")).alias("source_path"), what.alias("outcome"))


def cited_titles(outputs: DataFrame, sources: DataFrame, links: Column) -> DataFrame:
    """(id, title, outcome) of the titles an output cites: resolved,
    dangling (no source) or ambiguous (several)."""
    cited = outputs.select("id", F.explode(links).alias("title"))
    known = sources.groupBy("title").agg(F.countDistinct("digest").alias("n"))
    out = cited.join(known, "title", "left")
    return out.select("id", "title", F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("dangling").alias("outcome"))
