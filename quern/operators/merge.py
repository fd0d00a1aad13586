"""The write contracts of keyed tables, as DataFrame merges.

Each function returns the table after the write; nothing is changed in
place. Within a batch, rows of one key are decided by `order` (first or last).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import refuse


def same_key(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in key])


def keep_one(batch: DataFrame, key: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row of each key: the first or the last in `order`."""
    by = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    ranked = batch.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*by)))
    return ranked.where("__n = 1").drop("__n")


def missing_from(batch: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    return batch.join(table.select(*key), same_key(batch, table, key), "left_anti")


def insert_ignore(table: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of a key wins, those of the table before all."""
    fresh = missing_from(keep_one(batch, key, order), table, key)
    return table.unionByName(fresh.select(*table.columns))


def insert_replace(table: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of a key wins."""
    fresh = keep_one(batch, key, order, last=True)
    return missing_from(table, fresh, key).select(*table.columns).unionByName(fresh.select(*table.columns))


def replace_partition(table: DataFrame, batch: DataFrame, part: list[str]) -> DataFrame:
    """All rows of the parts that the batch names give way to the batch's."""
    return missing_from(table, batch.select(*part).distinct(), part).unionByName(batch.select(*table.columns))


def write_partitions(batch: DataFrame, path: str, part: list[str]) -> None:
    """The same as replace_partition on a partitioned folder: only the named
    parts' folders are rewritten."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(path)


def archive_replace(table: DataFrame, batch: DataFrame, key: list[str], version: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table, archive): a row of the same key and version stays; of another
    version it goes to the archive, with superseded_by, and the new one takes
    its place; new keys are added."""
    fresh = keep_one(batch, key, order)
    t, b = table.alias("t"), fresh.alias("b")
    cond = reduce(Column.__and__, [F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key])
    moved = t.join(b, cond & ~F.col(f"t.{version}").eqNullSafe(F.col(f"b.{version}")))
    archive = moved.select("t.*", F.col(f"b.{version}").alias("superseded_by"))
    replaced = moved.select("b.*")
    kept = missing_from(table, replaced, key)
    added = missing_from(fresh, table, key)
    return kept.unionByName(replaced.select(*table.columns)).unionByName(added.select(*table.columns)), archive


def upsert_catalog(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Catalog rows by source_path: new values win, a doc_id stays unless the
    batch states one; what is recorded is active."""
    t, b = table.alias("t"), keep_one(batch, ["source_path"], ["updated_at"], last=True).alias("b")
    both = t.join(b, F.col("t.source_path") == F.col("b.source_path"), "full")
    out = []
    for c in table.columns:
        if c == "active":
            col = F.when(F.col("b.source_path").isNotNull(), True).otherwise(F.col("t.active"))
        elif c == "doc_id":
            col = F.coalesce("b.doc_id", "t.doc_id", "b.source_path")
        else:
            col = F.coalesce(f"b.{c}", f"t.{c}")
        out.append(col.alias(c))
    return both.select(*out)


def tombstone(table: DataFrame, gone: DataFrame, key: str = "source_path") -> DataFrame:
    """Rows stay, inactive."""
    marks = gone.select(F.col(key).alias("__k")).distinct().withColumn("__gone", F.lit(True))
    joined = table.join(marks, F.col(key) == F.col("__k"), "left")
    return joined.select(*[F.when(F.col("__gone"), False).otherwise(F.col(c)).alias(c) if c == "active" else F.col(c) for c in table.columns])


def supersede(chunks: DataFrame, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(chunks, one row `flipped`): rows of the paths are no longer current;
    the count does not read the other columns."""
    hit = F.col("source_path").isin(*paths) if paths else F.lit(False)
    flipped = chunks.where(hit & F.col("current")).agg(F.count(F.lit(1)).alias("flipped"))
    return chunks.withColumn("current", F.col("current") & ~F.coalesce(hit, F.lit(False))), flipped


def relabel(table: DataFrame, col: str, old: str, new: str) -> DataFrame:
    return table.withColumn(col, F.when(F.col(col) == old, new).otherwise(F.col(col)))


def rekey_document(catalog: DataFrame, source_path: str, new_id: str, declared: bool = False) -> DataFrame:
    """The path's document under a new id: nothing to do if it has it; an id
    that another path holds is refused; a path with an id of its own needs a
    declaration."""
    rows = catalog.where((F.col("source_path") == source_path) | (F.col("doc_id") == new_id)).select("source_path", "doc_id").collect()
    own = [r for r in rows if r.source_path == source_path]
    if not own or own[0].doc_id == new_id:
        return catalog
    if any(r.source_path != source_path for r in rows):
        raise ValueError(f"{new_id} belongs to another document")
    if own[0].doc_id not in (None, source_path) and not declared:
        raise ValueError(f"{source_path} already has the id {own[0].doc_id}")
    return catalog.withColumn("doc_id", F.when(F.col("source_path") == source_path, new_id).otherwise(F.col("doc_id")))


def add_blobs(raw: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw, marks): content-addressed put of rows (data); marks has each
    digest and whether it is new. Nothing is ever overwritten."""
    keyed = blobs.select(F.sha2("data", 256).alias("digest"), "data").dropDuplicates(["digest"])
    known = raw.select(F.col("digest").alias("__d"))
    marks = keyed.join(known, F.col("digest") == F.col("__d"), "left").select("digest", F.col("__d").isNull().alias("is_new"))
    return raw.unionByName(missing_from(keyed, raw, ["digest"]).select(*raw.columns)), marks


def add_chunks(chunks: DataFrame, batch: DataFrame, dim: int) -> DataFrame:
    refuse(batch, F.size("vector") != dim, f"a vector has not {dim} parts")
    return chunks.unionByName(batch.select(*chunks.columns))


def add_edges(table: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    refuse(batch, (F.col("w") < 0) | ~F.col("sign").isin(1, -1), "weights are not negative and signs are 1 or -1")
    return insert_replace(table, batch, ["u", "v", "rel_type"], order)


def next_versions(versions: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Each row of the batch (doc_id, digest, at) is its document's next
    version; a return to earlier content is a version too."""
    top = versions.groupBy("doc_id").agg(F.max("version_seq").alias("__top"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    fresh = batch.join(top, "doc_id", "left").withColumn("version_seq", (F.coalesce("__top", F.lit(0)) + rank).cast("int"))
    return versions.unionByName(fresh.select(*versions.columns))


def stage(staged: DataFrame, batch: DataFrame, subspace: str, ttl_wall: str | None) -> DataFrame:
    """The batch enters as one generation, the next one."""
    tick = staged.agg(F.coalesce(F.max(F.greatest("generation", F.coalesce("tombstoned_at_gen", F.lit(0)))), F.lit(0)).alias("t")).first()["t"] + 1
    rows = batch.withColumns({"subspace_id": F.lit(subspace), "generation": F.lit(tick), "ttl_wall": F.lit(ttl_wall), "tombstoned_at_gen": F.lit(None)})
    return staged.unionByName(rows.select(*[F.col(c).cast(staged.schema[c].dataType).alias(c) for c in staged.columns]))


def tombstone_staged(staged: DataFrame, gone: Column, tick: int) -> DataFrame:
    """The first stamp stays."""
    stamp = F.coalesce("tombstoned_at_gen", F.when(gone, F.lit(tick)))
    return staged.withColumn("tombstoned_at_gen", stamp.cast("int"))


def append_verdicts(verdicts: DataFrame, batch: DataFrame, allowed: tuple[str, ...], signed: Column) -> DataFrame:
    """Verdicts of known kinds, signed, with rising sequence numbers, checked
    in that order; anything else refuses the batch."""
    refuse(batch, ~F.col("verdict").isin(*allowed), "unknown verdict")
    refuse(batch, ~signed, "a signature does not hold")
    top = verdicts.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    counts = batch.agg(F.min("seq").alias("lo"), F.count("seq").alias("n"), F.countDistinct("seq").alias("d")).first()
    if counts.n and (counts.lo <= top or counts.n != counts.d):
        raise ValueError("sequence numbers must rise")
    return verdicts.unionByName(batch.select(*verdicts.columns))


def purge_blob(raw: DataFrame, catalog: DataFrame, digest: str, confirm: bool) -> DataFrame:
    """Truly delete a blob that no active row refers to."""
    if not confirm:
        raise ValueError("a purge must be confirmed")
    if not catalog.where((F.col("digest") == digest) & F.col("active")).isEmpty():
        raise ValueError(f"{digest} is still referred to")
    return raw.where(F.col("digest") != digest)


def attest(actions: DataFrame, known: DataFrame) -> DataFrame:
    """actions (action, input_hashes, output_hashes, at) as attestations: the
    id is a digest of the record, parents are the attestations that produced
    its inputs. Appending goes by id, so a repeated record adds nothing."""
    rows = actions.withColumn("__row", F.xxhash64("action", "input_hashes", "output_hashes", "at"))
    made = known.select(F.col("id").alias("__parent"), F.explode("output_hashes").alias("__h"))
    wants = rows.select("__row", F.explode("input_hashes").alias("__h"))
    parents = wants.join(made, "__h").groupBy("__row").agg(F.array_sort(F.collect_set("__parent")).alias("derived_from_ids"))
    out = rows.join(parents, "__row", "left").withColumn("derived_from_ids", F.coalesce("derived_from_ids", F.array().cast("array<string>")))
    body = F.to_json(F.struct("action", "at", "derived_from_ids", "input_hashes", "output_hashes"))
    return out.select(F.sha2(body.cast("binary"), 256).alias("id"), "action", "input_hashes", "output_hashes", "derived_from_ids", "at")


def generations(archive: DataFrame, table: DataFrame, key: list[str], order: str) -> DataFrame:
    """Every generation of each key, archived ones first, with its place."""
    rows = archive.select(*table.columns, F.lit(False).alias("current")).unionByName(table.select("*", F.lit(True).alias("current")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("current", order)))


def plan_ids(catalog: DataFrame, minted: DataFrame) -> DataFrame:
    """(source_path, doc_id, outcome) of a planned migration to minted ids
    (source_path, new_id), nothing changed: keep, mint, or clash."""
    rows = catalog.join(minted, "source_path", "left")
    twice = minted.groupBy("new_id").agg(F.count(F.lit(1)).alias("__n"))
    held = catalog.select(F.col("doc_id").alias("new_id"), F.col("source_path").alias("__holder"))
    rows = rows.join(twice, "new_id", "left").join(held, "new_id", "left")
    clash = (F.col("__n") > 1) | (F.col("__holder").isNotNull() & (F.col("__holder") != F.col("source_path")))
    outcome = F.when(F.col("new_id").isNull() | (F.col("new_id") == F.col("doc_id")), "keep").when(clash, "clash").otherwise("mint")
    return rows.select("source_path", F.coalesce("new_id", "doc_id").alias("doc_id"), outcome.alias("outcome"))
