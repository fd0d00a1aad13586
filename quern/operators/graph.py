"""Graph measures on edge tables (u, v, w), u < v."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import partitions, write_table
from . import order
from .components import SMALL, connected_components

#: Rows of members that one task groups; edges of a group in which triangles are
#: found, wedges that it looks at in one go, and edges that are packed together.
GROUPED_ROWS, TASK_EDGES, TASK_WEDGES, PACKED_EDGES = 400_000, 2_000_000, 1_000_000, 1_000_000


def canonical(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Undirected edges once each, without loops."""
    rest = [c for c in edges.columns if c not in (u, v)]
    out = edges.where(F.col(u) != F.col(v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), *rest)
    return out.dropDuplicates(["u", "v"])


def ends(edges: DataFrame) -> DataFrame:
    """(node, other, ...) for both ends of every edge."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("other"), *rest).unionAll(
        edges.select(F.col("v").alias("node"), F.col("u").alias("other"), *rest)
    )


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array("u", "v")).alias("node"))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c, each once; see `_in_thirds`."""
    kind = edges.schema["u"].dataType.simpleString()

    def found(third: _Third) -> pa.Table:
        return pa.concat_tables(pa.table({n: third.ids.take(pa.array(x)) for n, x in zip("abc", corners, strict=True)}) for corners, _ in third.triangles())

    return _in_thirds(edges.select("u", "v"), found, f"a {kind}, b {kind}, c {kind}")


class _Third:
    """The edges among three colours: ids in order, places u and v of the ends
    of each edge, by u and v, its sign, and its key: the colour of u, times the
    colours, and that of v."""

    def __init__(self, group: pa.Table, colours: int, wedges: int):
        rows, key = unpacked(group)
        both = pa.chunked_array([*rows["u"].chunks, *rows["v"].chunks]).combine_chunks()
        ids = both.unique()
        self.ids = ids.take(pc.sort_indices(ids))
        at = pc.index_in(both, self.ids).to_numpy().astype(np.int64)
        n = len(self.ids)
        self.code, first = np.unique(at[: len(key)] * n + at[len(key) :], return_index=True)
        self.u, self.v, self.key, self.signs = self.code // n, self.code % n, key[first], rows["sign"].to_numpy()[first] if "sign" in rows.column_names else None
        self.hue = np.zeros(n, np.int64)
        self.hue[self.u], self.hue[self.v] = self.key // colours, self.key % colours
        third = group["third"][0].as_py()
        self.want, self.wedges = [third % colours, third // colours % colours, third // colours**2], wedges

    def triangles(self) -> Iterator[tuple[tuple, tuple]]:
        """Places of the three corners, and of the edges ab, ac and bc, of the
        triangles of these colours, some at a time."""
        n, u, v, code = len(self.ids), self.u, self.v, self.code
        deg = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
        low = (deg[u] < deg[v]) | ((deg[u] == deg[v]) & (u < v))
        x, y = np.where(low, u, v), np.where(low, v, u)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        end = np.cumsum(np.bincount(x, minlength=n))[x]
        many = end - np.arange(len(x)) - 1  # an edge with each later one of its node
        upto = np.concatenate([[0], np.cumsum(many)])
        lo = 0
        while lo < len(x):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + self.wedges, "right")) - 1)
            one = np.repeat(np.arange(lo, hi), many[lo:hi])
            two = one + 1 + np.arange(len(one)) - np.repeat(upto[lo:hi] - upto[lo], many[lo:hi])
            p, q = y[one], y[two]  # p < q
            near = np.searchsorted(code, p * n + q)
            hit = near < len(code)
            hit[hit] = code[near[hit]] == (p * n + q)[hit]
            t = np.sort(np.stack([x[one][hit], p[hit], q[hit]], axis=1), axis=1)
            t = t[(np.sort(self.hue[t], axis=1) == self.want).all(axis=1)]
            a, b, c = t.T
            yield (a, b, c), tuple(np.searchsorted(code, i * n + j) for i, j in ((a, b), (a, c), (b, c)))
            lo = hi


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(rows)
    return sink.getvalue().to_pybytes()


def packed_edges(e: DataFrame) -> DataFrame:
    """(key, edges): the rows (u, v, key, ...) of each key in order of u and v,
    compressed, some PACKED_EDGES of a task at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("key", "u", "v")])
            keys, first = np.unique(rows["key"].to_numpy(), return_index=True)
            for k, lo, hi in zip(keys.tolist(), first.tolist(), [*first[1:].tolist(), rows.num_rows], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(rows.slice(lo, hi - lo).drop_columns("key"))], pa.binary())], ["key", "edges"])

        held = []
        for b in batches:
            held += [b] * (b.num_rows > 0)
            if sum(h.num_rows for h in held) >= PACKED_EDGES:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    return e.mapInArrow(pack, "key int, edges binary")


def unpacked(group: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows of packed edges and the key of each."""
    parts = [pa.ipc.open_stream(x).read_all() for x in group["edges"].to_pylist()]
    return pa.concat_tables(parts), np.repeat(group["key"].to_numpy(), [t.num_rows for t in parts])


def _in_thirds(edges: DataFrame, found: Callable[[_Third], pa.Table], schema: str) -> DataFrame:
    """What `found` makes of the triangles of edges (u, v), u < v, and their sign.

    Nodes have one of `colours` by a hash; a triangle is found where its three
    colours meet, so an edge is sent once for each colour and neither wedges
    nor triangles are shuffled. Edges of two colours are sent in order and
    compressed, some PACKED_EDGES of a task at a time. The colours are as many
    as keep about TASK_EDGES edges in a group. There edges are pointed from the
    end of lower degree (ties by id), so a hub has few outgoing ones, and wedges
    are closed TASK_WEDGES at a time."""
    colours = max(1, math.ceil(3 * math.sqrt(edges.count() / TASK_EDGES)))
    hue = lambda c: F.pmod(F.xxhash64(c), F.lit(colours)).cast("int")
    sign = [F.signum("sign").cast("byte").alias("sign")] * ("sign" in edges.columns)
    e = edges.select("u", "v", *sign, (hue("u") * colours + hue("v")).alias("key"))

    x = F.explode(F.sequence(F.lit(0), F.lit(colours - 1)))
    sent = packed_edges(e).withColumn("x", x)
    hu, hv = F.floor(F.col("key") / colours).cast("int"), F.col("key") % colours
    low, high = F.least(hu, hv, "x"), F.greatest(hu, hv, "x")
    sent = sent.withColumn("third", (low + colours * (hu + hv + F.col("x") - low - high) + colours**2 * high).cast("int"))
    return sent.groupBy("third").applyInArrow(lambda group: found(_Third(group, colours, TASK_WEDGES)), schema)


def _on_edges(edges: DataFrame) -> DataFrame:
    """(u, v, t): edges, u < v, with the number of their triangles. A group of
    edges gives the counts of all edges between two colours as one row, in the
    order of u and v, and that with the third colour 0 their ends."""
    kind = edges.schema["u"].dataType.simpleString()

    def found(third: _Third) -> pa.Table:
        t = np.zeros(len(third.code), np.int64)
        for _, sides in third.triangles():
            t += np.bincount(np.concatenate(sides), minlength=len(t))
        rows = []
        for k in np.unique(third.key).tolist():
            own = np.flatnonzero(third.key == k)
            cols = {"t": pa.array(t[own])}
            if _rest(third.want, third.hue[[third.u[own[0]], third.v[own[0]]]].tolist()) == 0:
                cols |= {c: third.ids.take(pa.array(getattr(third, c)[own])) for c in ("u", "v")}
            rows.append((k, _packed(pa.table(cols))))
        return pa.table([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["key", "counts"])

    def total(group: pa.Table) -> pa.Table:
        t, ends = 0, None
        for x in group["counts"].to_pylist():
            part = pa.ipc.open_stream(x).read_all()
            t = t + part["t"].to_numpy()
            ends = part if "u" in part.column_names else ends
        return pa.table([ends["u"], ends["v"], pa.array(t)], ["u", "v", "t"])

    counts = _in_thirds(edges.select("u", "v"), found, "key int, counts binary")
    return counts.groupBy("key").applyInArrow(total, f"u {kind}, v {kind}, t long")


def _rest(three: list[int], two: list[int]) -> int:
    """The colour that is left of three without two of them."""
    left = list(three)
    for c in two:
        left.remove(c)
    return left[0]


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, clustering): 0 below degree 2."""
    own = ends(_on_edges(edges)).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), (F.sum("t") / 2).cast("long").alias("triangles"))  # each is on two edges of a corner
    possible = F.col("degree") * (F.col("degree") - 1) / 2
    return own.withColumn("clustering", F.when(F.col("degree") < 2, 0.0).otherwise(F.col("triangles") / possible))


def forman(edges: DataFrame) -> DataFrame:
    """(u, v, curvature): 4 - deg u - deg v + 3 * triangles on the edge."""
    deg = degrees(edges)
    out = _on_edges(edges).join(deg.withColumnsRenamed({"node": "u", "degree": "du"}), "u").join(deg.withColumnsRenamed({"node": "v", "degree": "dv"}), "v")
    return out.select("u", "v", (4 - F.col("du") - F.col("dv") + 3 * F.col("t")).cast("long").alias("curvature"))


def bridges(edges: DataFrame, top_k: int) -> DataFrame:
    """The most negative edges: curvature not above 0, else the least ones."""
    c = write_table(forman(edges), "forman")
    low = F.broadcast(c.agg(F.min("curvature").alias("least")))
    kept = c.crossJoin(low).where((F.col("curvature") <= 0) | ((F.col("least") > 0) & (F.col("curvature") == F.col("least"))))
    return kept.select("u", "v", "curvature").orderBy("curvature", "u", "v").limit(top_k)


def frustrated(edges: DataFrame) -> DataFrame:
    """(a, b, c, frustrated) of the triangles of signed edges (u, v, sign):
    an odd number of negative edges."""
    kind = edges.schema["u"].dataType.simpleString()

    def found(third: _Third) -> pa.Table:
        def part(corners: tuple, sides: tuple) -> pa.Table:
            own = {n: third.ids.take(pa.array(x)) for n, x in zip("abc", corners, strict=True)}
            return pa.table({**own, "frustrated": np.prod([third.signs[x] for x in sides], axis=0) < 0})

        return pa.concat_tables(part(*t) for t in third.triangles())

    return _in_thirds(edges.select("u", "v", "sign"), found, f"a {kind}, b {kind}, c {kind}, frustrated boolean")


def clusters(edges: DataFrame, nodes: DataFrame | None = None, min_size: int = 2, key: str = "id") -> DataFrame:
    """(component, size, members) of the components, largest first. A giant
    component's members are a long list: take `connected_components` itself
    where sizes are not known to be small."""
    own = connected_components(edges, "u", "v")
    if nodes is not None:
        ids = nodes.select(F.col(key).alias("id"))
        own = ids.join(own, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    out = own.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("id")).alias("members"))
    return out.where(F.col("size") >= min_size).orderBy(F.desc("size"), "component")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v, w): the maximum spanning forest, ties to the smaller (u, v).

    Boruvka rounds: every component picks its heaviest outgoing edge (an
    aggregation with map-side combine), the picked edges join components, and
    edges inside a component go. At most log2(n) rounds, and the last few
    edges in one task; nothing but their number comes to the driver."""
    left = write_table(edges.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), "forest")
    chosen = None
    while n := left.count():
        if n <= SMALL:
            own = write_table(_forest_of_few(left), "picked")
            return own if chosen is None else chosen.unionAll(own)
        # largest weight first, then the smaller pair: ranks make that a max
        key = F.struct((-F.col("w")).alias("w"), "u", "v")
        sides = left.select(F.col("cu").alias("c"), key.alias("k")).unionAll(left.select(F.col("cv").alias("c"), key.alias("k")))
        picked = sides.groupBy("c").agg(F.min("k").alias("k")).select("k.u", "k.v", (-F.col("k.w")).alias("w")).distinct()
        picked = write_table(picked.join(left.select("u", "v", "cu", "cv"), ["u", "v"]), "picked")
        own = picked.select("u", "v", "w")
        chosen = own if chosen is None else chosen.unionAll(own)
        comp = write_table(connected_components(picked, "cu", "cv"), "merged")
        x = comp.select(F.col("id").alias("cu"), F.col("component").alias("x"))
        y = comp.select(F.col("id").alias("cv"), F.col("component").alias("y"))
        left = left.join(x, "cu", "left").join(y, "cv", "left")
        left = left.select("u", "v", "w", F.coalesce("x", "cu").alias("cu"), F.coalesce("y", "cv").alias("cv")).where("cu <> cv")
        left = write_table(left, "forest")
    return chosen if chosen is not None else edges.select("u", "v", "w").limit(0)


def _forest_of_few(left: DataFrame) -> DataFrame:
    """The forest of at most SMALL edges (u, v, w, cu, cv) between components,
    heaviest first, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame(columns=["u", "v", "w", "cu", "cv"])])
        rows = rows.sort_values(["w", "u", "v"], ascending=[False, True, True])
        up: dict = {}

        def root(x):
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        kept = []
        for a, b in zip(rows["cu"], rows["cv"], strict=True):
            a, b = root(a), root(b)
            kept.append(a != b)
            up[a] = b
        yield rows[np.array(kept, bool)][["u", "v", "w"]]

    return left.coalesce(1).mapInPandas(run, left.select("u", "v", "w").schema)


def sigma_profile(edges: DataFrame, grid: list[float]) -> DataFrame:
    """(sigma, id, component) for each grid value: which nodes connect at a
    floor of sigma. Components at a lower floor come from the forest alone,
    which keeps all connectivity at every floor in n - 1 edges."""
    forest = write_table(spanning_forest(edges), "mst")
    out = None
    for s in grid:
        part = connected_components(forest.where(F.col("w") >= s), "u", "v").select(F.lit(float(s)).alias("sigma"), "id", "component")
        out = part if out is None else out.unionAll(part)
    return out


def pair_sigma(edges: DataFrame, pairs: DataFrame, grid: list[float]) -> DataFrame:
    """pairs (a, b) with sigma_star: the largest grid floor at which the two
    are connected, null if none."""
    p = sigma_profile(edges, grid)
    a = p.select("sigma", F.col("id").alias("a"), F.col("component").alias("ca"))
    b = p.select("sigma", F.col("id").alias("b"), F.col("component").alias("cb"))
    joined = pairs.select("a", "b").join(a, "a").join(b, ["sigma", "b"]).where("ca = cb").groupBy("a", "b").agg(F.max("sigma").alias("sigma_star"))
    return pairs.select("a", "b").join(joined, ["a", "b"], "left")


def conductance(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, conductance) of each community: cut weight over the smaller
    volume; 0 where a volume is 0."""
    lu = labels.select(F.col("id").alias("u"), F.col("label").alias("lu"))
    lv = labels.select(F.col("id").alias("v"), F.col("label").alias("lv"))
    e = edges.join(lu, "u").join(lv, "v")
    total = F.broadcast(e.agg((F.sum("w") * 2).alias("total")))
    side = e.select(F.col("lu").alias("label"), "w", (F.col("lu") != F.col("lv")).alias("cut")).unionAll(e.select(F.col("lv").alias("label"), "w", (F.col("lu") != F.col("lv")).alias("cut")))
    per = side.groupBy("label").agg(F.sum("w").alias("volume"), F.sum(F.when(F.col("cut"), F.col("w")).otherwise(0.0)).alias("boundary"))
    per = labels.select("label").distinct().join(per, "label", "left").crossJoin(total)
    small = F.least(F.coalesce("volume", F.lit(0.0)), F.col("total") - F.coalesce("volume", F.lit(0.0)))
    return per.select("label", F.when(small > 0, F.col("boundary") / small).otherwise(0.0).alias("conductance"))


def min_conductance(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The worst community's conductance; 1 without any community."""
    return conductance(edges, labels).agg(F.coalesce(F.min("conductance"), F.lit(1.0)).alias("min_conductance"))


def compose(classes: dict[str, DataFrame], nodes: DataFrame | None = None, sigma: float | None = None) -> DataFrame:
    """Edges of several classes flattened: the largest weight of a pair and
    the classes that have it. Loops and ends that are no nodes are refused."""
    out = None
    for name, e in sorted(classes.items()):
        part = e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w", F.lit(name).alias("class"))
        if sigma is not None and name == "sim":
            part = part.where(F.col("w") >= sigma)
        out = part if out is None else out.unionAll(part)
    if not out.where("u = v").isEmpty():
        raise ValueError("an edge joins a node to itself")
    if nodes is not None:
        known = nodes.select(F.col("id").alias("__n"))
        if not ends(out.select("u", "v")).join(known, F.col("node") == F.col("__n"), "left_anti").isEmpty():
            raise ValueError("an edge has an end that is no node")
    return out.groupBy("u", "v").agg(F.max("w").alias("w"), F.array_sort(F.collect_set("class")).alias("classes"))


def laplacian(edges: DataFrame) -> DataFrame:
    """(i, j, x): the entries of D - A."""
    e = ends(edges.select("u", "v", "w"))
    diag = e.groupBy("node").agg(F.sum("w").alias("x")).select(F.col("node").alias("i"), F.col("node").alias("j"), "x")
    return diag.unionAll(e.select(F.col("node").alias("i"), F.col("other").alias("j"), (-F.col("w")).alias("x")))


def laplacian_sym(edges: DataFrame) -> DataFrame:
    """(i, j, x): the entries of I - D^-1/2 A D^-1/2."""
    e = ends(edges.select("u", "v", "w"))
    d = e.groupBy("node").agg(F.sum("w").alias("d"))
    off = e.join(d, "node").join(d.withColumnsRenamed({"node": "other", "d": "e"}), "other")
    off = off.select(F.col("node").alias("i"), F.col("other").alias("j"), (-F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("x"))
    return d.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("x")).unionAll(off)


def signed_laplacian(edges: DataFrame) -> DataFrame:
    """(i, j, x) of signed edges: absolute degrees minus signed weights."""
    e = ends(edges.select("u", "v", (F.col("w") * F.col("sign")).alias("w")))
    diag = e.groupBy("node").agg(F.sum(F.abs("w")).alias("x")).select(F.col("node").alias("i"), F.col("node").alias("j"), "x")
    return diag.unionAll(e.select(F.col("node").alias("i"), F.col("other").alias("j"), (-F.col("w")).alias("x")))


def within(edges: DataFrame, start: list, depth: int) -> DataFrame:
    """(node, hops) reached from the start nodes in at most `depth` steps in
    either direction, themselves left out."""
    spark = edges.sparkSession
    e = write_table(ends(canonical(edges.select("u", "v"))), "walk")
    kind = e.schema["node"].dataType.simpleString()
    seen = spark.createDataFrame([(s, 0) for s in start], f"node {kind}, hops int")
    frontier = seen
    for hop in range(1, depth + 1):
        step = e.join(frontier.select("node"), "node").select(F.col("other").alias("node")).distinct()
        frontier = write_table(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen.where("hops > 0")


def loops(arcs: DataFrame, max_len: int = 12) -> DataFrame:
    """(nodes, witness): elementary cycles of at most max_len nodes, once
    each, from their least node; two-node cycles count, loops do not. Paths
    are grown by joins from least nodes only, within their component."""
    a = write_table(arcs.where("source <> target").select("source", "target", F.col("witness")).dropDuplicates(["source", "target"]), "arcs")
    paths = a.where("source < target").select(F.array("source").alias("nodes"), F.col("target").alias("last"), F.array("witness").alias("witness"))
    out = None
    for _ in range(2, max_len + 1):
        paths = paths.select(F.concat("nodes", F.array("last")).alias("nodes"), "last", "witness")
        step = paths.join(a.withColumnRenamed("witness", "__w"), F.col("last") == F.col("source"))
        step = step.select("nodes", F.col("target").alias("last"), F.concat("witness", F.array("__w")).alias("witness"))
        step = write_table(step.where((F.col("last") >= F.get("nodes", F.lit(0)))), "paths")
        closed = step.where(F.col("last") == F.get("nodes", F.lit(0))).select("nodes", "witness")
        out = closed if out is None else out.unionAll(closed)
        paths = step.where(~F.array_contains("nodes", F.col("last")))
        if paths.isEmpty():
            break
    return out


def simple_paths(arcs: DataFrame, max_len: int) -> DataFrame:
    """(source, sink, nodes, witness): directed paths of at most max_len arcs
    that pass no node twice, grown by joins. Their number can rise steeply
    with max_len: for sparse relations such as revisions."""
    a = write_table(arcs.where("source <> target").groupBy("source", "target").agg(F.min("witness").alias("witness")), "arcs")
    paths = a.select("source", F.col("target").alias("sink"), F.array("source", "target").alias("nodes"), F.array("witness").alias("witness"))
    out = paths
    for _ in range(2, max_len + 1):
        step = a.select(F.col("source").alias("sink"), F.col("target").alias("__t"), F.col("witness").alias("__w"))
        paths = paths.join(step, "sink").where(~F.array_contains("nodes", F.col("__t")))
        paths = paths.select("source", F.col("__t").alias("sink"), F.array_append("nodes", F.col("__t")).alias("nodes"), F.array_append("witness", F.col("__w")).alias("witness"))
        paths = write_table(paths, "paths")
        if paths.isEmpty():
            break
        out = out.unionAll(paths)
    return out


def revision_asymmetries(arcs: DataFrame, max_len: int = 12) -> DataFrame:
    """(source, sink, short_path, long_path, witness, gap): two ways from one
    node to another of different length that share no node between; of each
    source and sink the pair of the largest gap, ties to the first in order of
    length and nodes."""
    return widest_asymmetries(simple_paths(arcs, max_len))


def widest_asymmetries(paths: DataFrame) -> DataFrame:
    """The pairs of `revision_asymmetries` among these paths."""
    p = write_table(paths.select("source", "sink", "nodes", "witness"), "paths")
    side = lambda n: p.select("source", "sink", F.struct(F.size("nodes").alias("len"), "nodes", "witness").alias(n))
    inner = lambda c: F.slice(f"{c}.nodes", F.lit(2), F.greatest(F.lit(0), F.col(f"{c}.len") - 2))
    pair = side("a").join(side("b"), ["source", "sink"]).where(F.col("a.len") < F.col("b.len")).where(~F.arrays_overlap(inner("a"), inner("b")))
    best = pair.groupBy("source", "sink").agg(F.min(F.struct((F.col("a.len") - F.col("b.len")).alias("gap"), "a", "b")).alias("m"))
    return best.select(
        "source", "sink", F.col("m.a.nodes").alias("short_path"), F.col("m.b.nodes").alias("long_path"), F.concat("m.a.witness", "m.b.witness").alias("witness"), (-F.col("m.gap")).alias("gap")
    )


def reach_backs(arcs: DataFrame, authorship: DataFrame) -> DataFrame:
    """Citations whose cited work ranks after the citing one: (citing, cited,
    witness, evidence); an arc without both records is none."""
    a = authorship.select(F.col("ref").alias("source"), F.col("rank").alias("rs"), F.col("evidence").alias("es"))
    b = authorship.select(F.col("ref").alias("target"), F.col("rank").alias("rt"), F.col("evidence").alias("et"))
    hit = arcs.where("kind = 'citation'").join(a, "source").join(b, "target").where("rt > rs")
    return hit.select(F.col("source").alias("citing"), F.col("target").alias("cited"), "witness", F.concat("es", "et").alias("evidence"))


def coproduction(members: DataFrame, group: str, item: str) -> DataFrame:
    """(u, v, w): items that occur in one group, with the number of groups.
    Groups are joined on their key; one of g items gives g * (g - 1) / 2 rows,
    so groups must be small by nature (orders, sessions)."""
    m = members.select(group, item)
    # as many tasks as rows ask for, so that none holds more when there are more
    n = max(partitions(m.sparkSession), -(-m.count() // GROUPED_ROWS))
    m = m.repartition(n, group).dropDuplicates([group, item])
    pair = m.withColumnRenamed(item, "u").join(m.withColumnRenamed(item, "v").hint("merge"), group).where("u < v").select("u", "v")
    return pair.repartition(n, "u", "v").groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("w"))


def common_change(a: DataFrame, b: DataFrame) -> DataFrame:
    """(u, v, dw) on the edges that two snapshots share."""
    return a.select("u", "v", F.col("w").alias("wa")).join(b.select("u", "v", F.col("w").alias("wb")), ["u", "v"]).select("u", "v", (F.col("wb") - F.col("wa")).alias("dw"))


def severed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of snapshot a, both ends in b too, that b has not."""
    nodes = ends(b.select("u", "v")).select(F.col("node").alias("n")).distinct()
    gone = a.select("u", "v").join(b.select("u", "v"), ["u", "v"], "left_anti")
    gone = gone.join(nodes, F.col("u") == F.col("n"), "left_semi")
    return gone.join(nodes, F.col("v") == F.col("n"), "left_semi")


def longest_chain(arcs: DataFrame) -> DataFrame:
    """(node, level) of an acyclic relation (source, target): the number of
    nodes on the longest chain that ends there; see `order.levels`."""
    return order.levels(arcs)


def closure(arcs: DataFrame, most: int = 64) -> DataFrame:
    """(source, target, hops): the transitive closure with the fewest hops,
    by doubling: paths of twice the length in each round. Pairs are bounded by
    what is reachable; use it on strata, not on whole corpora."""
    known = write_table(arcs.select("source", "target").where("source <> target").distinct().withColumn("hops", F.lit(1)), "closure")
    n = known.count()
    for _ in range(most):
        step = known.withColumnsRenamed({"target": "mid", "hops": "h1"}).join(known.withColumnsRenamed({"source": "mid", "hops": "h2"}), "mid")
        more = known.unionAll(step.select("source", "target", (F.col("h1") + F.col("h2")).alias("hops")))
        known = write_table(more.groupBy("source", "target").agg(F.min("hops").alias("hops")), "closure")
        m, n = n, known.agg(F.count(F.lit(1)), F.sum("hops")).first()
        if m == n:
            return known
    raise ValueError("the closure did not settle")


def class_census(classes: dict[str, DataFrame]) -> DataFrame:
    """(a, b, nodes_a, nodes_b, shared, jaccard) for each pair of edge
    classes: how far they speak of the same nodes."""
    marks = None
    for name, e in sorted(classes.items()):
        part = ends(e.select("u", "v")).select("node", F.lit(name).alias("class")).distinct()
        marks = part if marks is None else marks.unionAll(part)
    per = marks.groupBy("node").agg(F.collect_set("class").alias("s"))  # as many as there are classes
    names = sorted(classes)
    has = lambda n: F.array_contains("s", n)
    aggs = [F.count_if(has(n)).alias(f"n_{i}") for i, n in enumerate(names)]
    combos = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    aggs += [F.count_if(has(names[i]) & has(names[j])).alias(f"b_{i}_{j}") for i, j in combos]
    row = per.agg(*aggs)
    entries = [F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"n_{i}").alias("nodes_a"), F.col(f"n_{j}").alias("nodes_b"), F.col(f"b_{i}_{j}").alias("shared")) for i, j in combos]
    out = row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    union = F.col("nodes_a") + F.col("nodes_b") - F.col("shared")
    return out.withColumn("jaccard", F.when(union > 0, F.col("shared") / union).otherwise(0.0))
