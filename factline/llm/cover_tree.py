"""Embedding near duplicates: dual traversal of cover trees.

Vectors of one label and dimension are dealt to cells around pivots, the top level of the tree; a
cell has a covering radius. Cells, cut into blocks of bounded size, get nested levels of centres
with halving radii. Pairs of cells, then pairs of nodes, are pruned when their centres are farther
apart than both covering radii and the distance of the threshold together, so pairs found are exactly
those with cosine >= 0.93. Vectors move twice, to their equals and to their block. Pairs of blocks are
read from the written blocks, a partition beside a partition, so nothing that is made grows with their
number. Links are counted where they are found; only sums by vector and one edge a vector leave a
task, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.llm import common as K
from factline.sources import scratch

THRESHOLD = 0.93
BLOCK = 512
PIVOTS = 64
#: Rounding of double distances; far above it, and without effect on results (cosines are checked exactly).
SLACK = 1e-7
#: Blocks whose trees a task remembers, by their bytes, and sums by vector that it gathers before it adds them up.
TREE_BYTES, SUMS = 64_000_000, 1_000_000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


class Tree:
    """Nodes of a block: a centre, a covering radius and children; a leaf holds equal vectors' one row."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.root = self._node(np.arange(len(x)), 0.0)

    def _node(self, rows: np.ndarray, above: float) -> int:
        at = len(self.centre)
        d = distances(self.x[rows], self.x[rows[:1]])[:, 0]
        self.centre.append(int(rows[0]))
        self.radius.append(float(d.max()))
        self.children.append(np.zeros(0, np.int64))
        if len(rows) > 1:
            # Half of what covers the rows; rows that no halving separates become children of their own.
            half, kids = self.radius[at] / 2, []
            if half <= SLACK:
                kids = [self._node(rows[i : i + 1], half) for i in range(len(rows))]
            else:
                left = rows
                while len(left):
                    near = distances(self.x[left], self.x[left[:1]])[:, 0] <= half
                    near[0] = True
                    kids.append(self._node(left[near], half))
                    left = left[~near]
            self.children[at] = np.array(kids)
        return at

    def done(self) -> Tree:
        self.c, self.r = np.array(self.centre), np.array(self.radius)
        return self


def dual(a: Tree, b: Tree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of a, j of b) whose cosine reaches the threshold, by descending both trees together."""
    reach = np.sqrt(max(2 - 2 * threshold, 0)) + SLACK
    stack = [(np.array([a.root]), np.array([b.root]))]
    out_i, out_j = [], []
    while stack:
        p, q = stack.pop()
        near = distances(a.x[a.c[p]], b.x[b.c[q]]) <= reach + a.r[p][:, None] + b.r[q][None, :]
        i, j = np.nonzero(near)
        pi, qj = p[i], q[j]
        leaf_a = np.array([not len(a.children[n]) for n in pi], bool)
        leaf_b = np.array([not len(b.children[n]) for n in qj], bool)
        both = leaf_a & leaf_b
        out_i.append(a.c[pi[both]])
        out_j.append(b.c[qj[both]])
        for n, m, la, lb in zip(pi[~both], qj[~both], leaf_a[~both], leaf_b[~both]):
            stack.append((a.children[n] if not la else np.array([n]), b.children[m] if not lb else np.array([m])))
    return np.concatenate(out_i).astype(np.int64), np.concatenate(out_j).astype(np.int64)


def linked(raw_a: np.ndarray, raw_b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """The exact check, in double precision and in pieces of bounded size."""
    na, nb = np.linalg.norm(raw_a, axis=1), np.linalg.norm(raw_b, axis=1)
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 100_000):
        x, y = i[s : s + 100_000], j[s : s + 100_000]
        out[s : s + 100_000] = np.einsum("ij,ij->i", raw_a[x], raw_b[y]) / (na[x] * nb[y]) >= threshold
    return out


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's component in a graph of n rows and edges (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def summed(node: np.ndarray, links: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row a node: its links together, and one node of its component by the edges (node, root)."""
    ids, at = np.unique(np.concatenate([node, root]), return_inverse=True)
    count = np.bincount(at[: len(node)], links, len(ids))
    label = joined(len(ids), at[: len(node)], at[len(node) :])
    hit = np.flatnonzero(count)
    return ids[hit], count[hit].astype(np.int64), ids[label[hit]]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding, label).

    Only rows of one label and dimension are compared. Rows whose label or embedding is null, empty,
    zero or holds null or non-finite components link with nothing. Repeated rows and equal
    vectors link with each other; they are one node with a weight. Components take the least vec_id,
    and a null vec_id is never the least. Other columns are ignored.
    """
    # Equal vectors get one node; ids of the input are kept by node.
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("own"), e.alias("e"))
    fine = F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)
    fine = fine & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = rows.withColumn("node", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("label", "e")))
    ids = scratch.written(rows.select("vec_id", "node"), "ids")
    # Floats move as floats: as doubles they are the same numbers in twice the bytes.
    floats = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = np.float32 if floats else np.float64
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("own" if floats else "e").alias("e"), F.count("*").alias("weight")
    )
    nodes = nodes.select("node", F.concat_ws(":", "label", F.size("e")).alias("grp"), F.size("e").alias("dim"), "weight", "e")

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (grp, dim), part in pdf.groupby(["grp", "dim"]):
                at, weight = part["node"].to_numpy(np.int64), part["weight"].to_numpy(np.int64)
                x = np.concatenate(part["e"].to_list()).astype(kind)
                out.append((grp, dim, len(part), at.min(), at.tobytes(), weight.tobytes(), x.tobytes()))
            yield pd.DataFrame(out, columns=["grp", "dim", "n", "least", "nodes", "weights", "x"])

    bundles = nodes.mapInPandas(bundle, "grp string, dim int, n long, least long, nodes binary, weights binary, x binary")
    bundles = scratch.written(bundles, "bundles")
    pivots = scratch.written(chosen(bundles, kind), "pivots")
    groups = scratch.written(grouped(bundles, pivots, kind, threshold), "groups")
    blocks = scratch.written(blocked(bundles, groups, kind), "blocks")

    own = ["grp", "cell", "part", "nodes", "weights", "x"]
    alone = blocks.select("dim", *[F.col(c).alias(f"{c}_{side}") for side in "ab" for c in own])
    many = blocks.where("not only")
    a = many.join(groups.select("grp", "near"), "grp").select("dim", F.get("near", F.col("cell")).alias("near"), *[F.col(c).alias(f"{c}_a") for c in own])
    # Every partition of blocks is read beside every other: neither side moves, however many pairs there are. Of groups that
    # are one block each only that block is looked at, so many small groups make no pairs to pass over.
    b = many.select(*[F.col(c).alias(f"{c}_b") for c in own]).hint("shuffle_replicate_nl")
    once = (F.col("cell_a") < F.col("cell_b")) | ((F.col("cell_a") == F.col("cell_b")) & (F.col("part_a") < F.col("part_b")))
    pairs = a.join(b, (F.col("grp_a") == F.col("grp_b")) & F.array_contains("near", F.col("cell_b")) & once).drop("near")
    work = alone.unionByName(pairs).drop("grp_b")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[tuple, tuple] = {}
        found, size = [], 0

        def block(key: tuple, nodes: bytes, weights: bytes, x: bytes, dim: int) -> tuple:
            """Its nodes, weights, vectors and tree; the last ones asked for are remembered."""
            known = trees.pop(key, None)
            if known is None:
                raw = matrix([x], dim, kind)
                known = np.frombuffer(nodes, np.int64), np.frombuffer(weights, np.int64), raw, Tree(unit(raw)).done()
            trees[key] = known
            while len(trees) > 2 and sum(2 * t[2].nbytes for t in trees.values()) > TREE_BYTES:
                trees.pop(next(iter(trees)))
            return known

        for pdf in batches:
            for r in pdf.itertuples():
                key_a, key_b = (r.grp_a, r.cell_a, r.part_a), (r.grp_a, r.cell_b, r.part_b)
                na, wa, xa, ta = block(key_a, r.nodes_a, r.weights_a, r.x_a, r.dim)
                nb, wb, xb, tb = block(key_b, r.nodes_b, r.weights_b, r.x_b, r.dim)
                same = key_a == key_b
                i, j = dual(ta, tb, threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                ok = linked(xa, xb, i, j, threshold)
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                ids_, at = (na, j) if same else (np.concatenate([na, nb]), j + len(na))
                count = np.bincount(i, wb[j], len(ids_)) + np.bincount(at, wa[i], len(ids_))
                root = joined(len(ids_), i, at)
                hit = np.flatnonzero(count)
                found.append((ids_[hit], count[hit], ids_[root[hit]]))
                size += len(hit)
                if size > SUMS:
                    # A task meets the nodes of two partitions, so this bounds what it holds.
                    found = [summed(*map(np.concatenate, zip(*found)))]
                    size = 0
        if found:
            node, links, root = summed(*map(np.concatenate, zip(*found)))
            yield pd.DataFrame({"node": node, "links": links, "root": root})

    found = scratch.written(work.mapInPandas(search, "node long, links long, root long"), "links")
    labels = K.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    weight = ids.where("node is not null").groupBy("node").agg(F.count("*").alias("weight"))
    per_node = weight.join(links, "node", "left").join(labels, "node", "left")
    per_node = per_node.select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    own = ids.join(per_node, "node", "left")
    least = own.where("comp is not null").groupBy("comp").agg(F.min("vec_id").alias("least"))
    out = own.join(least, "comp", "left").withColumn("component_id", F.coalesce("least", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def matrix(blobs, dim: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(-1, dim).astype(np.float64, copy=False)


def placed(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of every vector, and how far it is."""
    d = distances(unit(x), pivots)
    cell = d.argmin(axis=1)
    return cell, d[np.arange(len(x)), cell]


def chosen(bundles: DataFrame, kind: type) -> DataFrame:
    """The pivots of every group (grp, pivots).

    A group has a pivot for every 2 * BLOCK nodes, PIVOTS at most: those of a farthest-first walk
    over about 4 * PIVOTS of its nodes, chosen by their hash, that meet in one task. Which pivots are chosen
    affects speed only.
    """
    counts = scratch.written(bundles.groupBy("grp").agg(F.sum("n").alias("total"), F.min("least").alias("first")), "counts")

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                at = np.frombuffer(r.nodes, np.int64)
                some = np.flatnonzero((at % max(r.total // (4 * PIVOTS), 1) == 0) | (at == r.first))
                if len(some):
                    out.append((r.grp, r.dim, min(PIVOTS, -(-r.total // (2 * BLOCK))), matrix([r.x], r.dim, kind)[some].tobytes()))
            yield pd.DataFrame(out, columns=["grp", "dim", "k", "x"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        u, k = unit(matrix(pdf["x"], int(pdf["dim"].iloc[0]))), int(pdf["k"].iloc[0])
        taken, far = [0], distances(u, u[:1])[:, 0]
        while len(taken) < min(k, len(u)):
            taken.append(int(far.argmax()))
            far = np.minimum(far, distances(u, u[taken[-1:]])[:, 0])
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "pivots": [u[taken].tobytes()]})

    share = bundles.join(counts, "grp").mapInPandas(pick, "grp string, dim int, k long, x binary")
    return share.groupBy("grp").applyInPandas(walk, "grp string, pivots binary")


def grouped(bundles: DataFrame, pivots: DataFrame, kind: type, threshold: float) -> DataFrame:
    """A row a group (grp, pivots, parts, near): into how many blocks each cell is cut, and the cells from its own
    on that the covering radii don't rule out. A group has PIVOTS cells at most."""
    reach = float(np.sqrt(max(2 - 2 * threshold, 0)) + SLACK)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                cell, far = placed(matrix([r.x], r.dim, kind), matrix([r.pivots], r.dim))
                one = pd.DataFrame({"cell": cell, "far": far}).groupby("cell")["far"].agg(["size", "max"])
                out += [(r.grp, r.dim, c, n, m) for c, n, m in one.itertuples()]
            yield pd.DataFrame(out, columns=["grp", "dim", "cell", "n", "radius"])

    def near(key: tuple, sizes: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        p = matrix(own["pivots"], int(sizes["dim"].iloc[0]))
        parts, radius = np.zeros(len(p), np.int64), np.full(len(p), -np.inf)
        parts[sizes["cell"]], radius[sizes["cell"]] = -(-sizes["n"] // BLOCK), sizes["radius"]
        ok = (distances(p, p) <= reach + radius[:, None] + radius[None, :]) & (parts > 0)
        some = [np.flatnonzero(row[c:]) + c for c, row in enumerate(ok)]
        return pd.DataFrame({"grp": [key[0]], "pivots": [own["pivots"].iloc[0]], "parts": [parts], "near": [some]})

    sizes = bundles.join(pivots, "grp").mapInPandas(measure, "grp string, dim int, cell int, n long, radius double")
    sizes = sizes.groupBy("grp", "dim", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    return sizes.groupBy("grp").cogroup(pivots.groupBy("grp")).applyInPandas(near, "grp string, pivots binary, parts array<long>, near array<array<int>>")


def blocked(bundles: DataFrame, groups: DataFrame, kind: type) -> DataFrame:
    """Every node in a block of its cell: (grp, cell, part, dim, only, nodes, weights, x), a row a block of about BLOCK nodes;
    `only` if its group has no other."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                nodes, weights, x = np.frombuffer(r.nodes, np.int64), np.frombuffer(r.weights, np.int64), matrix([r.x], r.dim, kind)
                cell, _ = placed(x, matrix([r.pivots], r.dim))
                part = (K.mix(nodes.view(np.uint64)) % np.asarray(r.parts)[cell].astype(np.uint64)).astype(np.int64)
                order = np.lexsort((part, cell))
                cuts = np.flatnonzero(np.diff(cell[order]) | np.diff(part[order])) + 1
                for at in np.split(order, cuts):
                    out.append((r.grp, cell[at[0]], part[at[0]], r.dim, sum(r.parts) == 1, nodes[at].tobytes(), weights[at].tobytes(), x[at].astype(kind).tobytes()))
            yield pd.DataFrame(out, columns=["grp", "cell", "part", "dim", "only", "nodes", "weights", "x"])

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one = {c: [b"".join(pdf[c])] for c in ("nodes", "weights", "x")}
        return pd.DataFrame({"grp": key[0], "cell": key[1], "part": key[2], "dim": pdf["dim"].iloc[:1].to_list(), "only": pdf["only"].iloc[:1].to_list()} | one)

    schema = "grp string, cell int, part long, dim int, only boolean, nodes binary, weights binary, x binary"
    laid = bundles.join(groups, "grp").mapInPandas(assign, schema)
    return laid.groupBy("grp", "cell", "part").applyInPandas(gather, schema)
