"""A Merkle manifest of a dataset, with a proof for every row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import partitions, write_table
from .common import fold_ascii, running_totals

#: Nodes that become one, and the levels that one task climbs at a time.
ARITY, LEVELS = 16, 3
#: Leaves of an aligned block: what a task holds of a tree.
BLOCK = ARITY**LEVELS

PATH = "array<struct<left: string, right: string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def node(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels until one of n nodes remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Treehash:
    """Nodes of one height over leaves that are pushed in order; what it holds
    below that height is one unfinished run a level."""

    def __init__(self, levels: int):
        self.open: list[list[str]] = [[] for _ in range(levels)]
        self.nodes: list[str] = []

    def push(self, digest: str) -> None:
        for run in self.open:
            run.append(digest)
            if len(run) < ARITY:
                return
            digest = node(run)
            run.clear()
        self.nodes.append(digest)

    def close(self) -> list[str]:
        """The nodes, the last runs being as short as they are."""
        for at, run in enumerate(self.open):
            if run:
                digest = node(run)
                run.clear()
                (self.open[at + 1] if at + 1 < len(self.open) else self.nodes).append(digest)
        return self.nodes


def block_root(leaves: list[str], levels: int) -> str:
    """The node `levels` above the first of at most ARITY ** levels leaves."""
    tree = Treehash(levels)
    for x in leaves:
        tree.push(x)
    return tree.close()[0]


class Traversal:
    """The path of one leaf after the other, in a block of n leaves.

    For every level it keeps the run that the present leaf's node stands in,
    and a treehash that is building the run after it: a step gives each
    treehash one leaf, so a run is ready just when it is due. Held are two
    runs a level and the treehashes' stacks, however many leaves there are;
    leaf(i) may be asked for any place."""

    def __init__(self, leaf: Callable[[int], str], n: int, levels: int):
        self.leaf, self.n, self.at = leaf, n, 0
        self.spans = [ARITY ** (h + 1) for h in range(levels)]
        first = [Treehash(h) for h in range(levels)]
        self.coming = [Treehash(h) for h in range(levels)]
        self.fed = [min(n, s) for s in self.spans]
        for tree, upto in zip(first, self.fed, strict=True):
            for i in range(upto):
                tree.push(leaf(i))
        self.runs = [t.close() for t in first]
        self.sides = [self.side(h) for h in range(levels)]

    def side(self, h: int) -> tuple[str, str]:
        run, own = self.runs[h], self.at // ARITY**h % ARITY
        return "".join(run[:own]), "".join(run[own + 1 :])

    def advance(self) -> None:
        self.at += 1
        for h, span in enumerate(self.spans):
            if self.fed[h] < self.n:
                self.coming[h].push(self.leaf(self.fed[h]))
                self.fed[h] += 1
            if self.at % span == 0:
                self.runs[h], self.coming[h] = self.coming[h].close(), Treehash(h)
            if self.at % (span // ARITY) == 0:
                self.sides[h] = self.side(h)


def _blocks(batches: Iterator[pa.RecordBatch], starts: Callable[[pa.RecordBatch], list[bool]]) -> Iterator[pa.Table]:
    """The rows of one block after the other; a row that `starts` says so
    begins a block."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        begin = 0
        for at, new in enumerate(starts(b)):
            if new:
                if at > begin:
                    held.append(b.slice(begin, at - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin = [], at
        if b.num_rows > begin:
            held.append(b.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _roots(nodes: DataFrame) -> DataFrame:
    """(tree, place, lone, root) of nodes' (tree, place, digest) blocks: the root as far
    up as one node remains (`lone`), and the node LEVELS up."""
    kind = nodes.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, lambda b: [p % BLOCK == 0 for p in b.column("place").to_pylist()]):
            leaves = block.column("digest").to_pylist()
            up = height(len(leaves))
            lone = whole = block_root(leaves, up)
            for _ in range(LEVELS - up):
                whole = node([whole])
            place = block.column("place")[0].as_py() // BLOCK
            row = [[block.column("tree")[0].as_py()], [place], [lone], [whole]]
            types = [block.schema.field("tree").type, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["tree", "place", "lone", "digest"])

    return _dealt(nodes.select("tree", "place", "digest")).mapInArrow(run, f"tree {kind}, place long, lone string, digest string")


def _dealt(rows: DataFrame, *first: str) -> DataFrame:
    """Rows by block, a block's rows next to each other in order."""
    block = F.expr(f"place div {BLOCK}").alias("__q_block")
    rows = rows.withColumn("__q_block", block)
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "tree", "__q_block").sortWithinPartitions("tree", "__q_block", *first, "place").drop("__q_block")


def _climb(nodes: DataFrame, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes (tree, place, digest) of every tier, the first as given, and
    (tree, tier, root) of every tree."""
    tiers, roots = [nodes], None
    while True:
        made = write_table(_roots(tiers[-1]), f"{tag}-roots")
        many = made.where("place > 0").select("tree").distinct()
        many = write_table(many, f"{tag}-many")
        same = lambda m: made["tree"].eqNullSafe(m["__q_tree"])  # noqa: E731, B023
        marks = many.select(F.col("tree").alias("__q_tree"))
        done = made.join(marks, same(marks), "left_anti").select("tree", F.lit(len(tiers)).alias("tier"), F.col("lone").alias("root"))
        roots = done if roots is None else roots.unionAll(done)
        if many.isEmpty():
            return tiers, roots
        tiers.append(write_table(made.join(marks, same(marks), "left_semi").select("tree", "place", "digest"), f"{tag}-tier"))


def _paths(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """nodes with `path` and the columns of `upper`: one row (tree, place of
    the block, last: whether its tree ends there, path, ...) for each block.

    A block's row is sorted before its nodes, so a task holds one block."""
    more = [c for c in upper.columns if c not in ("tree", "place", "last", "path")]
    own = [c for c in nodes.columns if c not in ("tree", "place", "digest")]
    top = upper.select("tree", (F.col("place") * BLOCK).alias("place"), F.lit(0).alias("__q_kind"), "last", "path", *more)
    low = nodes.withColumn("__q_kind", F.lit(1))
    rows = top.unionByName(low, allowMissingColumns=True).select("__q_kind", "tree", "place", "digest", "last", "path", *own, *more)
    out = rows.schema[1:4]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*out, *[rows.schema[c] for c in [*own, *more]]]) + f", path {PATH}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, lambda b: [k == 0 for k in b.column("__q_kind").to_pylist()]):
            head, rest = table.slice(0, 1).to_pylist()[0], table.slice(1).combine_chunks()
            leaves = rest.column("digest").to_pylist()
            n = len(leaves)
            if not n:
                continue
            levels = height(n) if head["last"] else LEVELS
            walk = Traversal(leaves.__getitem__, n, levels)
            above = [(x["left"], x["right"]) for x in head["path"]]
            sides = []
            for i in range(n):
                if i:
                    walk.advance()
                sides += walk.sides
                sides += above
            left, right = (pa.array([s[k] for s in sides], pa.string()) for k in (0, 1))
            step = levels + len(above)
            ends = pa.array(range(0, step * n + 1, step) if step else [0] * (n + 1), pa.int32())
            path = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([left, right], fields=list(_PATH.value_type)))
            columns = [rest.column(c).chunk(0) for c in ["tree", "place", "digest", *own]]
            columns += [pa.array([head[c]] * n, table.schema.field(c).type) for c in more]
            yield pa.RecordBatch.from_arrays([*columns, path], ["tree", "place", "digest", *own, *more, "path"])

    return _dealt(rows, "__q_kind").mapInArrow(run, out)


def _descend(tiers: list[DataFrame], tops: DataFrame, tag: str) -> DataFrame:
    """The first tier's nodes with their paths. tops: (tree, tier, path, ...),
    what a tree's last block carries on; blocks below take theirs from the
    node that they became."""
    upper = None
    for tier in range(len(tiers), 0, -1):
        ends = tops.where(F.col("tier") == tier).drop("tier").withColumns({"place": F.lit(0).cast("long"), "last": F.lit(True)})
        upper = ends if upper is None else ends.unionByName(upper.drop("digest").withColumn("last", F.lit(False)))
        upper = _paths(tiers[tier - 1], upper)
        if tier > 1:
            upper = write_table(upper, f"{tag}-paths")
    return upper


def prove(rows: DataFrame, by: str, order: list[str], leaf: str = "leaf") -> DataFrame:
    """rows with place (in its tree, from 0), subroot, root and path.

    Rows of one value of `by` are the leaves of one tree, in the order of
    `order` (nulls first), then of `leaf`; ARITY consecutive nodes, the last
    run as short as it is, become one while there are several. The trees'
    roots, by `by` (null first), are the leaves of the tree of the root. A
    path has one (left, right) a level, from the leaf up to the root: the
    digests of the siblings before and after, joined; `fold` follows it.

    Places come from a range partitioning; trees climb by aligned blocks of
    BLOCK nodes, one row a block and tier, whatever the size of a tree, and
    paths come down the same way: in a block a treehash traversal makes them
    leaf by leaf, and the path of the block is appended to each.

    Equal rows each get their own place. Null values of `by` are one tree.
    The names place, subroot, root and path are taken, and those that start
    with __q_. An empty table gives an empty one.
    """
    names = [c for c in rows.columns if c not in ("place", "subroot", "root", "path")]
    own = {c: f"__q_c{i}" for i, c in enumerate(names)}
    kept = rows.select(
        F.col(by).alias("tree"), F.col(leaf).alias("digest"), F.monotonically_increasing_id().alias("__q_row"), F.lit(1).cast("long").alias("__q_one"),
        *[F.col(f"`{c}`").alias(n) for c, n in own.items() if c not in (by, leaf)],
    )
    kept = write_table(kept, "leaves")  # once: the ranges are sampled from it; numbers of equal rows stay as they are
    placed = running_totals(kept, "__q_one", [*[own[c] for c in order], "digest", "__q_row"], ["tree"], "places")
    leaves = write_table(placed.drop("__q_row", "__q_one", "upto").withColumnRenamed("before", "place"), "places")
    tiers, roots = _climb(leaves, "leaves")
    subroots = write_table(roots, "subroots")
    ranked = running_totals(subroots.withColumn("__q_one", F.lit(1).cast("long")), "__q_one", ["tree"], tag="trees")
    trees = ranked.select(
        F.lit(0).alias("tree"), F.col("before").alias("place"), F.col("root").alias("digest"), F.col("tree").alias("__q_tree"), "tier"
    )
    trees = write_table(trees, "trees")
    high, root = _climb(trees, "trees")
    tops = root.select("tree", "tier", F.lit(None).cast(PATH).alias("path"), F.col("root").alias("top")).withColumn("path", F.coalesce("path", F.array().cast(PATH)))
    proven = _descend([trees, *high[1:]], tops, "trees")
    proven = proven.select(F.col("__q_tree").alias("tree"), "tier", "path", F.col("digest").alias("subroot"), "top")
    out = _descend(tiers, write_table(proven, "subroot-paths"), "leaves")
    back = [F.col("tree" if c == by else "digest" if c == leaf else n).alias(c) for c, n in own.items()]
    return out.select(*back, "place", "subroot", F.col("top").alias("root"), "path")


def leaf_digest(*cols: Column) -> Column:
    """Lowercase hex SHA-256 of the values in turn: `-` for a null, else the
    UTF-8 byte count, a colon and the value."""
    parts = []
    for c in cols:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The contract's row for each document: leaf, roots, digest of the proof,
    and whether the leaf still leads to the root after tampering, which
    lower-cases A-Z of the texts where 5 divides crc32(doc_id).

    Null columns are `-` in the leaf, a null text stays null, a null id is
    not tampered with. Repeated rows are leaves of their own."""
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaf = leaf_digest(*cols, F.col("text"))
    other = F.when(changed, leaf_digest(*cols, fold_ascii(F.col("text"))))
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), other.alias("tampered"))
    out = prove(rows, "source", ["doc_id"])
    siblings = F.aggregate("path", F.lit(""), lambda acc, x: F.concat(acc, x["left"], x["right"]))
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, by: str, levels: int) -> str:
    """Levels of trees: {name}0 has (by, i, d); {name}r{h} the runs of level h."""
    out = []
    for h in range(levels):
        out.append(f"{name}n{h} AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS n FROM {name}{h})")
        out.append(f"{name}r{h} AS (SELECT {by}, i // 16 AS run, any_value(n) AS n, list(d ORDER BY i) AS ds FROM {name}n{h} GROUP BY {by}, i // 16)")
        out.append(f"{name}{h + 1} AS (SELECT {by}, run AS i, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {name}r{h})")
    return ",\n".join(out)


def _path_sql(name: str, by: str, levels: int, first: str, tag: str) -> str:
    """Follow {first} (place, folded, proof, ...) up the levels."""
    out, before = [], first
    for h in range(levels):
        pos = f"p.place // {16**h} % 16"
        out.append(
            f"{tag}{h} AS (SELECT p.* REPLACE (CASE WHEN r.n > 1 THEN sha256(array_to_string(r.ds[1:{pos}], '') || p.folded || array_to_string(r.ds[{pos} + 2:], '')) ELSE p.folded END AS folded, "
            f"CASE WHEN r.n > 1 THEN p.proof || array_to_string(r.ds[1:{pos}], '') || array_to_string(r.ds[{pos} + 2:], '') ELSE p.proof END AS proof) "
            f"FROM {before} p JOIN {name}r{h} r ON p.{by} IS NOT DISTINCT FROM r.{by} AND p.place // {16 ** (h + 1)} = r.run)"
        )
        before = f"{tag}{h}"
    return ",\n".join(out)


def _field_sql(col: str) -> str:
    return f"coalesce(strlen({col}::varchar) || ':' || {col}::varchar, '-')"


_FIELDS = " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = """xor(list_reduce([4294967295::ubigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint),
    lambda r, c: list_reduce([xor(r, c)] || list_transform(range(8), lambda k: 0::ubigint), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::ubigint) ELSE x // 2 END)), 4294967295::ubigint)"""

#: Trees of up to 16 ** 6 rows, and as many trees as 16 ** 4.
MANIFEST_SQL = f"""
WITH leaves AS (
  SELECT doc_id, source, sha256({_FIELDS} || {_field_sql('text')}) AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({_FIELDS} || {_field_sql(_LOWER)}) END AS tampered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
s0 AS (SELECT source, place AS i, leaf AS d FROM placed),
{_tree_sql('s', 'source', 6)},
subroots AS (SELECT source, d AS subroot, 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM s6),
t0 AS (SELECT one, place AS i, subroot AS d FROM subroots),
{_tree_sql('t', 'one', 4)},
p AS (SELECT doc_id, source, leaf, place, coalesce(tampered, leaf) AS folded, '' AS proof FROM placed),
{_path_sql('s', 'source', 6, 'p', 'up')},
q AS (SELECT u.doc_id, u.leaf, u.folded, u.proof, s.subroot, s.place, s.one FROM up5 u JOIN subroots s ON u.source IS NOT DISTINCT FROM s.source),
{_path_sql('t', 'one', 4, 'q', 'top')}
SELECT x.doc_id, x.leaf, x.subroot, r.d AS root, sha256(x.proof) AS proof_sha256, x.folded AS folded_root, x.folded = r.d AS verified
FROM top3 x JOIN t4 r ON x.one = r.one
"""
