"""Near-duplicate embeddings by a forest of random-projection trees.

A tree splits a cell of vectors at the median of their projections on a random direction,
again and again. Vectors close to a split go to both sides; how close depends on how far
linked vectors can be apart, however tight the cell is. Vectors are compared with all others
of their leaf, in double precision, and links from all trees are united.

Equal vectors are one class from the start. A cell's splits are fitted on a bounded sample
of its own vectors and applied to all of them; cells that are still large are split again
from new samples. A cell is not split where a good part of its sampled pairs are links, as it
would be parted through the middle of a group; like one that is large after the last round
it is compared in blocks, so no link inside it is lost and the work goes by its links.

Two vectors may meet in several leaves. Each carries the list of its leaves, and a pair
counts in the smallest common one only; so links are counted without a table of pairs, and
leaves pass on a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetide.llm.components import connected
from casetide.runtime import materialize, release

COSINE = 0.95
TREES = 6
#: Splits of a cell per round, at most: it falls into 2 ** LEVELS cells.
LEVELS = 8
ROUNDS = 5
#: Vectors that a cell's splits are fitted on.
SAMPLE = 2_048
#: Rows of a cell that are sent down its splits at once.
PART_ROWS = 16_384
#: Vectors that are compared with each other at once.
LEAF_ROWS = 1_024
#: Share of a cell's spread within which a vector goes to both sides of a split.
SPILL = 0.06
#: Distance of unit vectors that are just linked.
CHORD = math.sqrt(2 - 2 * COSINE)
#: Share of linked pairs from which on a cell is compared as a whole.
TIGHT = 0.25
_SEED = 11


def classes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Distinct usable vectors: ``cls`` (smallest id), ``v`` and ``copies``.

    Vectors that are null, empty, all zero or hold null or non-finite components, and rows
    without an id, are not among them. A direct comparison of arrays decides what is equal.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = finite & F.exists("v", lambda x: x != 0) & F.col("v").isNotNull() & F.col("id").isNotNull()
    return rows.where(usable).groupBy("v").agg(F.min("id").alias("cls"), F.count("*").alias("copies"))


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), float)
    x /= np.abs(x).max(axis=1, keepdims=True)  # large components must not overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _direction(cell: int, node: int, size: int) -> np.ndarray:
    found = np.random.default_rng([_SEED, cell & (2**63 - 1), node]).standard_normal(size)
    return found / np.linalg.norm(found)


_ALIKE = (math.inf, 1.0)


def _alike(x: np.ndarray) -> bool:
    """Whether a good part of the pairs of some vectors are links."""
    if len(x) < 16:
        return False
    return np.mean([(x * np.roll(x, k, axis=0)).sum(axis=1) >= COSINE for k in (1, 2, 3, 5)]) >= TIGHT


def _leaves(x: np.ndarray, cell: int, levels: int, splits: dict[int, tuple[float, float]] | None = None):
    """Send the rows of ``x`` down one tree. Without splits they are fitted on the way.

    Nodes are numbered as in a heap. Gives the splits, and row and leaf number of every end.
    A node that is not split has an infinite split point and all rows on the left; its margin
    is 1 if its vectors are too much alike, and 0 if only the direction is of no use.
    """
    fitted = splits is None
    splits = {} if fitted else splits
    at = [(1, np.arange(len(x)))]
    for _ in range(levels):
        below = []
        for node, rows in at:
            along = x[rows] @ _direction(cell, node, x.shape[1])
            if fitted:
                low, mid, high = np.quantile(along, (0.1, 0.5, 0.9)) if len(rows) else (0.0, 0.0, 0.0)
                margin = max(SPILL * (high - low), 0.5 * CHORD / math.sqrt(x.shape[1]))
                if splits.get(node // 2) == _ALIKE and node % 2 == 0 or _alike(x[rows]):
                    splits[node] = _ALIKE
                elif high - low < 4 * margin:
                    splits[node] = (math.inf, 0.0)
                else:
                    splits[node] = (float(mid), float(margin))
            mid, margin = splits[node]
            below.append((2 * node, rows[along <= mid + margin]))
            below.append((2 * node + 1, rows[along > mid - margin]))
        at = below
    return splits, at


def _fit(leaf_rows: int, most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iloc[0])
        # As many halvings, with some room for spill, as bring the cell down to a leaf.
        levels = min(most, max(1, math.ceil(math.log2(1.5 * pdf["size"].iloc[0] / leaf_rows))))
        # Ties of the sampling order must not matter.
        splits, _ = _leaves(_unit(pdf.sort_values("cls")["v"]), cell, levels)
        return pd.DataFrame({"cell": [cell], "splits": [[y for n in range(1, 1 << levels) for y in splits[n]]]})

    return run


def _assign(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """Send some rows of one cell, of which there are many, down the splits of the cell."""
    if not len(rows) or not len(model):
        return pd.DataFrame({"cls": [], "parent": [], "leaf": []})
    cell, flat = int(model["cell"].iloc[0]), model["splits"].iloc[0]
    levels = (len(flat) // 2).bit_length()
    splits = {n: (flat[2 * n - 2], flat[2 * n - 1]) for n in range(1, 1 << levels)}
    ids = rows["cls"].to_numpy()
    ends = _leaves(_unit(rows["v"]), cell, levels, splits)[1]
    return pd.DataFrame({
        "cls": np.concatenate([ids[at] for _, at in ends]), "parent": cell,
        "leaf": np.repeat([leaf for leaf, _ in ends], [len(at) for _, at in ends]),
    })


def leaves(distinct: DataFrame, trees: int = TREES, leaf_rows: int = LEAF_ROWS, levels: int = LEVELS, rounds: int = ROUNDS, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> DataFrame:
    """``cls`` and ``cell`` of every vector in every leaf that it belongs to."""
    roots = F.explode(F.transform(F.sequence(F.lit(1), F.lit(trees)), lambda t: F.xxhash64(t)))
    cells = distinct.select("cls", roots.alias("cell"))
    done = None
    for _ in range(rounds):
        sizes = cells.groupBy("cell").agg(F.count("*").alias("size"))
        large = materialize(sizes.where(F.col("size") > leaf_rows), "large-cells")
        small = cells.join(large, "cell", "left_anti").select("cls", "cell")
        done = small if done is None else done.union(small)
        if large.isEmpty():
            return done
        split = cells.join(large, "cell")
        # The smallest hashes of a cell are sorted, of those that are small enough; by chance these
        # are eight times as many as wanted, so there are enough.
        order = F.xxhash64("cls", "cell")
        low = order <= F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(8.0 * max(sample, 64)) / F.col("size"))
        nth = F.row_number().over(Window.partitionBy("cell").orderBy(order, "cls"))
        chosen = split.where(low).withColumn("nth", nth).where(F.col("nth") <= sample).select("cell", "size", "cls")
        chosen = chosen.join(distinct.select("cls", "v"), "cls")
        model = materialize(chosen.groupBy("cell").applyInPandas(_fit(leaf_rows, levels), "cell long, splits array<double>"), "splits")
        # Cells that are not to be split at all are leaves.
        alike = (F.col("splits")[0] == F.lit(math.inf)) & (F.col("splits")[1] == 1)
        done = done.union(cells.join(model.where(alike), "cell", "left_semi").select("cls", "cell"))
        # Rows of a cell go together, in parts, so that its directions are made once for many of
        # them and its splits are not carried by each.
        parts = F.ceil(F.col("size") / part_rows).cast("int")
        model = model.where(~alike).join(large, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        part = F.pmod(F.xxhash64("cell", "cls"), parts).cast("int").alias("part")
        parted = split.join(model.select("cell"), "cell", "left_semi").select("cell", part, "cls").join(distinct.select("cls", "v"), "cls")
        both = parted.groupBy("cell", "part").cogroup(model.select("cell", "part", "splits").groupBy("cell", "part"))
        below = both.applyInPandas(_assign, "cls long, parent long, leaf long")
        cells = materialize(below.select("cls", F.xxhash64("parent", "leaf").alias("cell")).distinct(), "cells")
        release(distinct.sparkSession, 2.0)
    last = cells.select("cls", "cell")
    return last if done is None else done.union(last)


def _compare(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iloc[0])
        pdf = pdf.sort_values("cls", kind="stable")
        left, right = (pdf[pdf["side"] == s] for s in (0, 1))
        own = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        right = left if own else right
        if not len(left) or not len(right):
            return pd.DataFrame({"kind": [], "cls": [], "other": [], "n": []})
        a, b = _unit(left["v"]), _unit(right["v"])
        i, j = np.nonzero(a @ b.T >= cosine)
        if own:
            i, j = i[i < j], j[i < j]
        homes = [left["homes"].tolist(), right["homes"].tolist()]
        # A pair counts in the smallest of the leaves that both are in.
        width = max((len(h) for side in homes for h in side), default=1)
        pad = [np.array([[*h, *[h[-1]] * (width - len(h))] for h in side]) for side in homes]
        first = np.ones(len(i), bool)
        for at in range(0, len(i), 50_000):
            x, y = pad[0][i[at : at + 50_000]], pad[1][j[at : at + 50_000]]
            common = np.full(len(x), np.iinfo(np.int64).max)
            for c in range(width):
                shared = (x[:, c : c + 1] == y).any(axis=1)
                common = np.where(shared, np.minimum(common, x[:, c]), common)
            first[at : at + 50_000] = common == cell
        ids = [left["cls"].to_numpy(), right["cls"].to_numpy()]
        copies = [left["copies"].to_numpy(), right["copies"].to_numpy()]
        i, j = i[first], j[first]
        links = pd.DataFrame({
            "cls": np.concatenate((ids[0][i], ids[1][j])),
            "n": np.concatenate((copies[1][j], copies[0][i])),
        })
        counts = links.groupby("cls", as_index=False)["n"].sum().assign(other=-1)
        return pd.concat((counts.assign(kind=0), _spanning(ids[0][i], ids[1][j])))[["kind", "cls", "other", "n"]]

    return run


def _spanning(x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """A spanning forest of links as rows ``cls``, ``other``."""
    nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    i, j, root = at[: len(x)], at[len(x) :], np.arange(len(nodes))
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(root, root[root]):
            root = root[root]
    rest = root != np.arange(len(nodes))
    return pd.DataFrame({"kind": 1, "cls": nodes[rest], "other": nodes[root[rest]], "n": 0})


def compared(distinct: DataFrame, members: DataFrame, leaf_rows: int = LEAF_ROWS, cosine: float = COSINE) -> DataFrame:
    """What the leaves find: counts of linked vectors (kind 0) and linking edges (kind 1)."""
    homes = members.groupBy("cls").agg(F.sort_array(F.collect_set("cell")).alias("homes"))
    rows = members.join(distinct.join(homes, "cls"), "cls")
    sizes = members.groupBy("cell").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / leaf_rows).cast("int")
    rows = rows.join(sizes.withColumn("blocks", blocks).drop("size"), "cell")
    # Block b of a large leaf meets every block from its own on, and is met by those before.
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("with", other)
    rows = rows.withColumns({
        "lo": F.least("block", "with"), "hi": F.greatest("block", "with"),
        "side": F.when(F.col("block") > F.col("with"), 1).otherwise(0),
    })
    wanted = rows.select("cell", "lo", "hi", "side", "cls", "v", "copies", "homes")
    return wanted.groupBy("cell", "lo", "hi").applyInPandas(_compare(cosine), "kind int, cls long, other long, n long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS, **fit: int) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Links are pairs found with a cosine of 0.95 or more; vectors that are null, empty, zero
    or hold null or non-finite components have none, like vectors of another length than
    the rest. Repeated rows and equal vectors count as vectors of their own. Rows without an
    id link with nothing and belong to no component. An empty table gives no rows.
    """
    distinct = materialize(classes(vectors, key, vector), "vectors")
    found = []
    for (size,) in distinct.select(F.size("v")).distinct().collect():  # one length, as a rule
        same = distinct.where(F.size("v") == size)
        found.append(compared(same, materialize(leaves(same, trees, leaf_rows, **fit), "leaves"), leaf_rows))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    if not found:
        alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    every = materialize(every, "leaf-links")
    roots = connected(every.where("kind = 1"), "cls", "other")
    counts = every.where("kind = 0").groupBy("cls").agg(F.sum("n").alias("n"))
    known = distinct.join(counts, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left")
    known = known.select(
        F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "cls").alias("root")
    )
    out = rows.join(known, (F.col("v") == F.col("_v")) & F.col("vec_id").isNotNull(), "left")
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
