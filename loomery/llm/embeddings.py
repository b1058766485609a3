"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c are at squared distance 2 - 2c. Vectors are rotated to their principal
axes and split into blocks; of a pair within squared distance D, at least one block of k of n
dimensions lies within D * k / n. Each block is range-joined on a grid over its leading dimensions:
only the block's coordinates are shipped there, and what comes back are the vectors that have a
partner in reach, never the pairs. These alone are sent out whole, and every candidate of the union
is verified by its exact cosine in double precision. A pair is counted once: in the first block
whose budget it meets. Only counts and a forest of links leave a task.
"""

from __future__ import annotations

from itertools import product
from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnionFind, components, materialize, spread_join

COSINE = 0.93
BLOCKS = 4
#: Vectors of a grid cell that meet in one task: two chunks of this size.
CHUNK = 8192
#: Grid dimensions at most; each makes three times as many neighbouring cells.
MOST_GRID = 3
#: What it costs to send a vector's block once, in compared pairs.
SEND_COST = 3000
#: Coordinates are shipped as 32-bit floats; budgets are widened by more than their rounding.
SLACK = 1e-5


def _moments(batches):
    """Per task and dimension count: sums of outer products of unit vectors."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for pdf in batches:
        for dim, raw in pdf["v"].groupby(pdf["v"].map(len)):
            x = unit(raw)
            n, s = sums.get(dim, (0, 0.0))
            sums[dim] = (n + len(x), s + x.T @ x)
    for dim, (n, s) in sums.items():
        yield pd.DataFrame({"dim": np.int32([dim]), "n": [n], "s": [s.tobytes()]})


def _sum_moments(pdf):
    s = np.sum([np.frombuffer(b, np.float64) for b in pdf["s"]], axis=0)
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "n": [pdf["n"].sum()], "s": [s.tobytes()]})


def rotation(moments: np.ndarray) -> np.ndarray:
    """Columns are principal axes, the widest first, dealt to the blocks in turn so that each
    block starts with its widest."""
    _, axes = np.linalg.eigh(moments)
    return axes[:, ::-1]


def block_axes(dim: int, blocks: int) -> list[np.ndarray]:
    """The rotated dimensions of each block."""
    blocks = max(1, min(blocks, dim))
    return [np.arange(k, dim, blocks) for k in range(blocks)]


def wide(raw) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in raw])


def unit(raw) -> np.ndarray:
    x = wide(raw)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def grid_dims(n: int, spread: np.ndarray, width: float) -> int:
    """Grid dimensions for ``n`` vectors of a label, whose leading axes have the standard deviations
    ``spread``: those of the least estimated cost of sending (a vector goes to half of its
    neighbouring cells) and comparing (pairs of neighbouring cells)."""
    share = [erf(1.5 * width / max(2 * s, 1e-9)) for s in spread[:MOST_GRID]]
    cost = [n * (3**g + 1) / 2 * SEND_COST + n * n / 2 * np.prod(share[:g]) for g in range(len(share) + 1)]
    return int(np.argmin(cost))


class Grid:
    """The blocks of the rotated vectors, and the cells of each block."""

    def __init__(self, turn: dict[int, np.ndarray], threshold: float, blocks: int, dims: int):
        self.turn, self.reach, self.blocks, self.dims = turn, 2 - 2 * threshold, blocks, dims
        self.half = [d for d in product((-1, 0, 1), repeat=dims) if d > (0,) * dims]

    def rotated(self, raw) -> np.ndarray:
        """Rotated unit vectors, rounded to 32 bits, so that a pair's block distances are the same
        wherever they are computed."""
        x = unit(raw)
        return (x @ self.turn.get(x.shape[1], np.eye(x.shape[1]))).astype(np.float32)

    def budget(self, dim: int, block: int) -> float:
        return self.reach * len(block_axes(dim, self.blocks)[block]) / dim * (1 + SLACK) + SLACK

    def cells(self, x: np.ndarray, block: int):
        """Cell keys of each vector in a block: its own, then the half of the neighbouring cells."""
        dim = x.shape[1]
        lead = x[:, block_axes(dim, self.blocks)[block][: self.dims]].astype(np.float64)
        cell = np.floor(lead / np.sqrt(self.budget(dim, block))).astype(np.int64)
        cell = np.pad(cell, ((0, 0), (0, self.dims - cell.shape[1])))
        for shift in [(0,) * self.dims, *self.half]:
            key = np.zeros(len(x), np.int64)
            for k in range(self.dims):
                key = (key << 20) + cell[:, k] + shift[k] + (1 << 19)
            yield key


def _by_length(pdf: pd.DataFrame):
    return pdf.groupby(pdf["v"].map(len))


def _cell_sizes(grid: Grid):
    """Per batch: rows of each cell, and those that are its own."""

    def of(batches):
        for pdf in batches:
            for dim, part in _by_length(pdf):
                x, label = grid.rotated(part["v"]), part["label"].to_numpy()
                for block in range(len(block_axes(dim, grid.blocks))):
                    for k, key in enumerate(grid.cells(x, block)):
                        n = pd.DataFrame({"label": label, "cell": key}).groupby(["label", "cell"]).size().reset_index(name="rows")
                        yield n.assign(dim=np.int32(dim), block=np.int32(block), mine=n["rows"] if k == 0 else np.int64(0))

    return of


def _entries(grid: Grid):
    """Each vector's block coordinates in its own cell of every block, and in the half of the
    neighbouring cells."""

    def of(batches):
        for pdf in batches:
            for dim, part in _by_length(pdf):
                x, label, cid = grid.rotated(part["v"]), part["label"].to_numpy(), part["cid"].to_numpy()
                for block, axes in enumerate(block_axes(dim, grid.blocks)):
                    held = [r.tobytes() for r in np.ascontiguousarray(x[:, axes])]
                    for k, key in enumerate(grid.cells(x, block)):
                        yield pd.DataFrame({"label": label, "dim": np.int32(dim), "block": np.int32(block), "cell": key, "own": k == 0, "cid": cid, "part": held})

    return of


def _near(x: np.ndarray, budget: float, own: np.ndarray, chunk: np.ndarray, lo: int, hi: int):
    """Pairs of a chunk pair within a block's budget, in runs of rows: one of the cell's own vectors,
    and a later own one or any of a neighbouring cell. Own rows come first."""
    x = x.astype(np.float64)
    square, rows = (x * x).sum(axis=1), int(own.sum())
    for at in range(0, rows, 512):
        to = min(at + 512, rows)
        i, j = np.nonzero(square[at:to, None] + square[None, :] - 2 * x[at:to] @ x.T <= budget + SLACK)
        i += at
        a, b = chunk[i], chunk[j]
        fits = np.where(own[j], j > i, True) & (np.minimum(a, b) == lo) & (np.maximum(a, b) == hi)
        yield i[fits], j[fits]


_KEY = ["label", "dim", "block", "cell", "lo", "hi"]
_KEY_TYPES = "label string, dim int, block int, cell long, lo int, hi int"


def _own_first(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["own", "chunk", "cid"], ascending=[False, True, True], kind="stable")


def _with_partner(grid: Grid):
    """Of one pair of chunks of a cell: the rows that have a partner within the block's budget."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _own_first(pdf)
        dim, block, lo, hi = (int(pdf[c].iloc[0]) for c in ("dim", "block", "lo", "hi"))
        x = np.stack([np.frombuffer(b, np.float32) for b in pdf["part"]])
        some = np.zeros(len(pdf), bool)
        for i, j in _near(x, grid.budget(dim, block), pdf["own"].to_numpy(bool), pdf["chunk"].to_numpy(), lo, hi):
            some[i] = some[j] = True
        return pdf.loc[some, [*_KEY, "own", "chunk", "cid"]]

    return of


def _verify(grid: Grid, threshold: float):
    """Verified pairs of one pair of chunks of a cell: link counts by class, and a forest of links."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _own_first(pdf)
        dim, block, lo, hi = (int(pdf[c].iloc[0]) for c in ("dim", "block", "lo", "hi"))
        raw, x = wide(pdf["v"]), grid.rotated(pdf["v"])
        norm = np.sqrt((raw * raw).sum(axis=1))
        parts = [np.ascontiguousarray(x[:, axes]) for axes in block_axes(dim, grid.blocks)[: block + 1]]
        cid, n = pdf["cid"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        counts, links, edges = np.zeros(len(cid), np.int64), UnionFind(), []
        for i, j in _near(parts[block], grid.budget(dim, block), pdf["own"].to_numpy(bool), pdf["chunk"].to_numpy(), lo, hi):
            for s in range(0, len(i), 65_536):
                p, q = i[s : s + 65_536], j[s : s + 65_536]
                linked = (raw[p] * raw[q]).sum(axis=1) / (norm[p] * norm[q]) >= threshold
                p, q = p[linked], q[linked]
                near = [((y[p].astype(np.float64) - y[q]) ** 2).sum(axis=1) <= grid.budget(dim, k) for k, y in enumerate(parts)]
                first = near[block]
                for earlier in near[:block]:
                    first = first & ~earlier
                p, q = p[first], q[first]
                counts += np.bincount(p, n[q], len(cid)).astype(np.int64) + np.bincount(q, n[p], len(cid)).astype(np.int64)
                for c, d in zip(cid[p].tolist(), cid[q].tolist()):
                    if links.link(c, d):
                        edges.append((c, d))
        some = counts > 0
        found = pd.DataFrame({"a": cid[some], "b": np.int64(-1), "n": counts[some]})
        return pd.concat([found, pd.DataFrame(edges, columns=["a", "b"], dtype="int64").assign(n=np.int64(0))])

    return of


def _vectors(rows: DataFrame, vector_col: str, id_col: str, label_col: str) -> DataFrame:
    """``vec_id``, ``label``, and ``v``: the vector as it is compared, null where it links with nothing."""
    kind = dict(rows.dtypes)[vector_col]
    single = kind == "array<float>"
    # Adding 0.0 makes -0.0 into 0.0, as grouping does, so that equal vectors have equal hashes too.
    zero = F.lit(0.0).cast("float" if single else "double")
    plain = F.col(vector_col) if single else F.transform(F.col(vector_col), lambda v: v.cast("double"))
    named = F.col(label_col) + 0.0 if dict(rows.dtypes)[label_col] in ("float", "double") else F.col(label_col)  # -0.0 is 0.0
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), named.cast("string").alias("label"), F.transform(plain, lambda v: v + zero).alias("v"))
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("v", lambda v: v != 0)
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = rows.select("vec_id", "label", F.when(fit, F.col("v")).alias("v"))
    if single:  # squares of floats never leave the doubles' range
        return rows
    # Components whose squares leave the doubles' range: the vector is scaled by its largest one
    # (first by 2**600, so that the smallest doubles are divided exactly), which keeps its cosines.
    # The second addition of 0.0 is for negative components that become -0.0.
    most = F.array_max(F.transform("v", lambda v: F.abs(v)))
    up = F.when(most < 1e-150, F.lit(2.0**600)).otherwise(F.lit(1.0))
    rows = rows.withColumn("most", most * up).withColumn("up", up)
    scaled = F.transform("v", lambda v: v * F.col("up") / F.col("most") + F.lit(0.0))
    return rows.select("vec_id", "label", F.when((F.col("most") >= 1e150) | (F.col("up") > 1), scaled).otherwise(F.col("v")).alias("v"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row.

    Rows link when their labels are equal and not null, their vectors have one length, and their
    cosine is at least ``threshold``. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, and neither do rows of a null id; these have no links and are
    kept. Equal vectors of a label are one class with a count, so copies never meet as pairs;
    repeated ids are rows of their own. Labels may be of any type that has a text form. Other columns are not carried; an empty table gives an
    empty result.
    """
    rows = _vectors(vectors, vector_col, id_col, label_col)
    # A class is found again by two 64-bit hashes of its label and vector, where no two classes share them.
    hashes = [F.xxhash64("label", "v").alias("h"), F.xxhash64(F.lit("second"), "v", "label").alias("g")]
    classes = rows.where(F.col("v").isNotNull()).groupBy("label", "v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n"))
    classes = materialize(classes.select("label", "v", "cls", "n", *hashes).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    sums = classes.select("v").mapInPandas(_moments, "dim int, n long, s binary").groupBy("dim").applyInPandas(_sum_moments, "dim int, n long, s binary")
    turn, spread, common = {}, np.zeros(0), 1
    for r in sums.orderBy(F.desc("n"), "dim").limit(4).collect():
        moments = np.frombuffer(r["s"], np.float64).reshape(r["dim"], r["dim"])
        turn[r["dim"]] = rotation(moments)
        if not len(spread):
            spread, common = np.sqrt(np.maximum(np.linalg.eigvalsh(moments / r["n"])[::-1], 0)), r["dim"]
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    width = np.sqrt((2 - 2 * threshold) / min(blocks, common))
    grid = Grid(turn, threshold, blocks, grid_dims(largest, spread[:: min(blocks, common)], width))

    cell = ["label", "dim", "block", "cell"]
    sizes = classes.select("label", "v").mapInPandas(_cell_sizes(grid), "label string, cell long, rows long, dim int, block int, mine long")
    sizes = sizes.groupBy(*cell).agg(F.sum("rows").alias("rows"), F.sum("mine").alias("mine")).where((F.col("rows") > 1) & (F.col("mine") > 0))
    sizes = materialize(sizes.withColumn("chunks", F.ceil(F.col("rows") / CHUNK).cast("int")).select(*cell, "rows", "chunks"), "vector-cells")
    entries = classes.select("label", "cid", "v").mapInPandas(_entries(grid), "label string, dim int, block int, cell long, own boolean, cid long, part binary")
    sized = spread_join(entries, sizes, cell, "rows")
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sized = sized.select(*cell, F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "own", "chunk", "cid", "part")
    candidates = sized.groupBy(*_KEY).applyInPandas(_with_partner(grid), f"{_KEY_TYPES}, own boolean, chunk int, cid long")
    whole = materialize(candidates, "vector-candidates").join(classes.select("cid", "n", "v"), "cid")
    found = materialize(whole.groupBy(*_KEY).applyInPandas(_verify(grid, threshold), "a long, b long, n long"), "vector-links")

    linked = components(found.where("b >= 0").select("a", "b"), "vector-components")
    counts = found.where("b < 0").groupBy("a").agg(F.sum("n").alias("others"))
    named = classes.select("label", "h", "g", "cls", "n", "cid").join(counts, F.col("cid") == F.col("a"), "left").drop("a")
    named = materialize(named.join(linked, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid")).drop("node"), "vector-roots")
    smallest = named.groupBy("root").agg(F.min("cls").alias("component_id"), F.count("*").alias("of_root"))
    named = spread_join(named, smallest, ["root"], "of_root").select("label", "h", "g", "cid", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")

    hashed = rows.select("vec_id", "label", *hashes, F.col("v").isNotNull().alias("fit"))
    key = ["label", "h", "g"]
    if not classes.groupBy(*key).count().where("count > 1").isEmpty():  # then vectors themselves are the key
        hashed, named, key = rows.withColumn("fit", F.col("v").isNotNull()), named.join(classes.select("cid", "v"), "cid"), ["label", "v"]
    bare = hashed.where(~F.col("fit")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = spread_join(hashed.where("fit"), named, key, "n").select("vec_id", "n_links", "component_id").unionByName(bare)
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
