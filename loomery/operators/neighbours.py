"""Exact pairs of near vectors, and keeper-first groups of them.

Unit vectors of cosine c are at squared distance 2 - 2c. Dimensions are cut into blocks, and a block
of a vector is named by the side of the mean on which each component lies. Of a pair within squared
distance D, some block of k dimensions is within D / blocks; where the two names of that block differ,
both components of each differing dimension are at least as far apart as each is from the mean, so
for one of the two vectors the squared distances of those components from the mean sum to no more
than D / blocks / 2. Each vector therefore enters every block under its own name and asks under
all names that its own components allow within that sum: two vectors meet by an equi-join, and no
link is lost. How many names that is depends on the threshold, so plans are compared by cost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.operators import vectors as plain

#: Names that a block may ask under; vectors that would ask under more meet all others in blocks.
MOST_NAMES = 8192
#: Rows of a name that meet in one task, on each side.
CHUNK = 1024
#: What plans are compared by: bytes of a row besides its components, the vectors judged, and nanoseconds
#: of a byte sent, of two names that meet, and of a product within a block.
ROW_BYTES, JUDGED, PER_BYTE, PER_MEETING, PER_PRODUCT = 60, 100, 10, 400, 0.15
#: Widens every budget by more than the rounding of doubles.
SLACK = 1e-9
#: Undecided links that are few enough to be walked in one task.
LAST_LINKS = 100_000


def classes(vectors: DataFrame, *scope: str) -> DataFrame:
    """Vectors that may link, as unit vectors ``u``, equal ones of a scope as one row: ``cls`` (least
    id), ``n`` (rows) and the scope. Null and zero vectors and those that hold null or non-finite
    components are left out; null scopes are equal."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(v, lambda x: x + F.lit(0.0)).alias("v"), *scope)
    held = rows.groupBy("v", *scope).agg(F.min("vec_id").alias("cls"), F.count("*").alias("n"))
    return held.withColumn("norm", norm).select("cls", "n", F.transform("v", lambda x: x / F.col("norm")).alias("u"), *scope)


def _means(batches):
    """Per task and length: sums of the components."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        length = pa.compute.list_value_length(b.column("u")).to_numpy()
        for dim in np.unique(length).tolist():
            x = b.column("u").filter(pa.array(length == dim)).flatten().to_numpy().reshape(-1, dim)
            sums[dim] = sums.get(dim, 0) + np.vstack([x.sum(axis=0), np.full(dim, len(x))])
    for dim, (s, n) in sums.items():
        yield pa.RecordBatch.from_pydict({"dim": np.full(dim, dim, np.int32), "k": np.arange(dim, dtype=np.int32), "s": s, "n": n.astype(np.int64)})


def blocks_of(dim: int, blocks: int) -> list[np.ndarray]:
    """Dimensions of each block; a name has 62 bits at most."""
    return np.array_split(np.arange(dim), max(min(blocks, dim), -(-dim // 62)))


def names(gap: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distances from the mean (row by dimension): each row's own name; then rows and names of
    all that they ask under. Rows with more than MOST_NAMES ask under none."""
    bit = np.int64(1) << np.arange(gap.shape[1])
    own = ((gap > 0) * bit).sum(axis=1)
    cost = gap * gap
    order = np.argsort(cost, axis=1)
    at, mask, spent = np.arange(len(gap)), np.zeros(len(gap), np.int64), np.zeros(len(gap))
    for k in range(gap.shape[1]):  # dimensions from the nearest to the mean on
        turn = order[at, k]
        total = spent + cost[at, turn]
        more = total <= budget
        at, mask, spent = np.concatenate([at, at[more]]), np.concatenate([mask, mask[more] | bit[turn[more]]]), np.concatenate([spent, total[more]])
        many = np.bincount(at, minlength=len(gap)) > MOST_NAMES
        if many.any():
            keep = ~many[at]
            at, mask, spent = at[keep], mask[keep], spent[keep]
    return own, at, own[at] ^ mask


def _entries(mean: dict[int, np.ndarray], blocks: int, reach: float):
    """Of each vector and block: its own name, and all names that it asks under (block -1: it meets all)."""

    def of(batches):
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                length = pa.compute.list_value_length(b.column("u")).to_numpy()
                for dim in np.unique(length).tolist():
                    own = b.filter(pa.array(length == dim))
                    x = own.column("u").flatten().to_numpy().reshape(-1, dim)
                    parts = blocks_of(dim, blocks)
                    found = [names(x[:, axes] - mean[dim][axes], budget_of(reach, parts)) for axes in parts]
                    flat = np.any([np.bincount(asks, minlength=len(x)) == 0 for _, asks, _ in found], axis=0)
                    for k, (axes, (name, asks, asked)) in enumerate(zip(parts, found)):
                        asked, asks = asked[~flat[asks]], asks[~flat[asks]]
                        asked = asked[np.argsort(asks, kind="stable")]
                        ends = np.cumsum(np.bincount(asks, minlength=len(x))[~flat])
                        n = len(ends)
                        yield pa.RecordBatch.from_pydict({
                            "cls": own.column("cls").filter(pa.array(~flat)), "scope": own.column("scope").filter(pa.array(~flat)), "dim": np.full(n, dim, np.int32), "block": np.full(n, k, np.int32), "name": name[~flat],
                            "asks": pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), asked), "part": pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(axes), x[~flat][:, axes].ravel()),
                        })
                    n = int(flat.sum())
                    none = lambda kind: pa.array([None] * n, pa.list_(kind))  # noqa: E731, B023
                    yield pa.RecordBatch.from_pydict({"cls": own.column("cls").filter(pa.array(flat)), "scope": own.column("scope").filter(pa.array(flat)), "dim": np.full(n, dim, np.int32), "block": np.full(n, -1, np.int32), "name": np.zeros(n, np.int64), "asks": none(pa.int64()), "part": none(pa.float64())})

    return of


def budget_of(reach: float, parts: list) -> float:
    """What a vector may spend on differing sides in a block."""
    return reach / len(parts) / 2 * (1 + SLACK) + SLACK


def best_blocks(sample: list, mean: dict[int, np.ndarray], rows: int, reach: float) -> int:
    """Into how many blocks names should cut vectors so that sending and comparing cost least, judged by
    a sample of unit vectors; 0 if multiplying all of them costs less. All find the same pairs.

    Fewer blocks tell vectors better apart, but ask under more names. Costs are nanoseconds of a task.
    """
    cost = {0: sum(plain.blocks_for(rows) * (ROW_BYTES + 8 * len(u)) * PER_BYTE + rows * len(u) * PER_PRODUCT for u in sample)}
    for blocks in range(2, 13):
        cost[blocks] = 0.0
        for u in sample:
            parts = blocks_of(len(u), blocks)
            for axes in parts:
                asks = len(names(np.array(u)[None, axes] - mean[len(u)][axes], budget_of(reach, parts))[1])
                asks = asks or rows  # such a vector meets all others
                cost[blocks] += asks * (ROW_BYTES + 8 * len(axes)) * PER_BYTE + 2 * asks * rows / 2.0 ** len(axes) * PER_MEETING
            if cost[blocks] > min(cost.values()):
                break
    return min(cost, key=cost.get)


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def meeting(named: DataFrame, key: list[str], held: str) -> DataFrame:
    """Owners (``x``, ``px``) and askers (``y``, ``py``) of equal ``key``: rows of ``named`` by ``own``,
    with ``cls`` and the column ``held``. Keys of many rows are dealt to chunks on both sides, so that
    no task compares more than CHUNK rows with CHUNK of a key; neither side is sent through the driver, however small
    its files are."""
    sizes = named.groupBy(*key).agg(F.ceil(F.count_if("own") / CHUNK).cast("int").alias("owners"), F.ceil(F.count_if(~F.col("own")) / CHUNK).cast("int").alias("askers"))
    hot = F.broadcast(sizes.where("owners > 0 AND askers > 0 AND owners + askers > 2"))  # one key of CHUNK rows at most
    cold = named.join(hot, key, "left_anti").withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    side = lambda n: F.array(F.pmod(F.xxhash64("cls"), F.col(n)).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    split = named.join(hot, key)
    split = split.withColumn("lo", F.explode(F.when(F.col("own"), side("owners")).otherwise(each("owners"))))
    split = split.withColumn("hi", F.explode(F.when(F.col("own"), each("askers")).otherwise(side("askers")))).select(*cold.columns)
    dealt, at = cold.unionByName(split), [*key, "lo", "hi"]
    own = dealt.where("own").select(*at, F.col("cls").alias("x"), F.col(held).alias("px"))
    return own.hint("merge").join(dealt.where("NOT own").select(*at, F.col("cls").alias("y"), F.col(held).alias("py")), at)


def near_pairs(found: DataFrame, threshold: float, *scope: str, blocks: int | None = None) -> DataFrame:
    """Pairs ``a`` < ``b`` (``cls``) of ``classes`` of one scope and length with cosine at least
    ``threshold``, and their ``similarity``. Exact; ``spark.checkpoint.dir`` must be set. ``found`` is read
    several times, so it should be stored. Where names would cost more than multiplying all vectors
    (``vectors.block_pairs``), that is done; ``blocks`` sets what ``best_blocks`` would choose.

    Only a block's components travel with its name; pairs beyond the block's budget end there, and
    whole vectors meet for the few that are left. Vectors that lie too near the mean for names
    meet all others in blocks, as ``vectors.pairs_with`` has it.
    """
    found = found.withColumn("scope", F.xxhash64(F.lit(0), *scope))
    rows, reach = 0, 2 - 2 * threshold
    mean: dict[int, np.ndarray] = {}
    sums = found.select("u").mapInArrow(_means, "dim int, k int, s double, n long").groupBy("dim", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    for r in sums.collect():  # one row for each dimension
        mean.setdefault(r["dim"], np.zeros(r["dim"]))[r["k"]] = r["s"] / r["n"]
        rows += r["n"] if r["k"] == 0 else 0
    if blocks is None:
        blocks = best_blocks([r["u"] for r in found.select("u").limit(JUDGED).collect()], mean, rows, reach)
    if not blocks:
        return plain.block_pairs(found.select(F.col("cls").alias("vec_id"), "u", "scope"), threshold)
    schema = "cls long, scope long, dim int, block int, name long, asks array<long>, part array<double>"
    entries = found.select("cls", "scope", "u").mapInArrow(_entries(mean, blocks, reach), schema).checkpoint()

    key = ["scope", "dim", "block", "name"]
    held = entries.where("block >= 0")
    named = held.select(*key, "cls", "part", F.lit(True).alias("own")).unionByName(held.select("scope", "dim", "block", F.explode("asks").alias("name"), "cls", "part", F.lit(False).alias("own")))
    met = meeting(named, key, "part").where("x <> y")
    limit = F.lit(None).cast("double")
    for d in mean:
        limit = F.when(F.col("dim") == d, 2 * budget_of(reach, blocks_of(d, blocks))).otherwise(limit)
    near = met.where(_distance("px", "py") <= limit).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    of = lambda n, u: found.select(F.col("cls").alias(n), F.col("u").alias(u), F.col("scope").alias(f"s{n}"))
    both = near.join(of("a", "ua"), "a").join(of("b", "ub"), "b").where("sa = sb AND size(ua) = size(ub)")
    dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    out = both.select("a", "b", dot.alias("similarity")).where(F.col("similarity") >= threshold)
    flat = entries.where("block < 0").select(F.col("cls").alias("f"))
    if not flat.isEmpty():
        out = out.union(plain.pairs_with(found.select(F.col("cls").alias("vec_id"), "u", "scope"), flat, threshold))
    return out


def _walk(links):
    """Losers among the last undecided links, in the order of the ranks."""
    rows = [(tuple(ka), a, b) for pdf in links for ka, a, b in zip(pdf["ka"].tolist(), pdf["a"].tolist(), pdf["b"].tolist())]
    beside: dict = {}
    for _, a, b in rows:
        beside.setdefault(a, []).append(b)
    kept, lost = set(), set()
    for _, a in sorted({(k, a) for k, a, _ in rows}):
        if a not in lost:
            kept.add(a)
            lost.update(b for b in beside[a] if b not in kept)
    yield pd.DataFrame({"x": np.array(sorted(lost), np.int64)})


def keepers(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """Each loser with its keeper (``id``, ``keeper``): in the order of the ranks, every node that is
    left is kept and takes all its neighbours that are left. Groups are never transitive.

    ``pairs`` has ``a``, ``b``; ``ranks`` has ``id`` and ``rank``, an array<double>; the smallest is the best,
    and of equal ones that of the smaller id. In rounds, nodes that outrank all their
    undecided neighbours are kept at once and those neighbours are lost; when few links are left, one
    task walks them. What is never lost is kept, and a loser's keeper is the best kept neighbour, as
    that one came first. Each round is written to ``spark.checkpoint.dir`` and makes the table smaller.
    """
    both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    of = lambda n, k: ranks.select(F.col("id").alias(n), F.col("rank").alias(k))
    links = both.join(of("a", "ka"), "a").join(of("b", "kb"), "b").checkpoint()
    left, lost = links, links.where("false").select(F.col("b").alias("x"))
    while n := left.count():
        if n <= LAST_LINKS:
            lost = lost.union(left.select("ka", "a", "b").coalesce(1).mapInPandas(_walk, "x long"))
            break
        at = lambda k, i: F.struct(F.col(k).alias("k"), F.col(i).alias("i"))
        best = left.groupBy("a").agg(F.first(at("ka", "a")).alias("own"), F.min(at("kb", "b")).alias("other")).where("own < other").select(F.col("a").alias("x"))
        best = best.checkpoint()
        beaten = left.join(best, F.col("a") == F.col("x"), "left_semi").select(F.col("b").alias("x")).distinct().checkpoint()
        lost, gone = lost.union(beaten), best.union(beaten)
        left = left.join(gone, F.col("a") == F.col("x"), "left_anti").join(gone, F.col("b") == F.col("x"), "left_anti").checkpoint()
    lost = lost.checkpoint()
    held = links.join(lost, F.col("b") == F.col("x"), "left_semi").join(lost, F.col("a") == F.col("x"), "left_anti")
    return held.groupBy(F.col("b").alias("id")).agg(F.min_by("a", F.struct("ka", "a")).alias("keeper"))


def _halves(c: str) -> tuple[Column, Column]:
    """A long as two doubles in its order, so that none is rounded."""
    return F.shiftright(c, 32).cast("double"), F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")


def duplicate_groups(vectors: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """Losers of ``vectors`` with their keepers and similarity (``id``, ``keeper``, ``similarity``).

    A keeper has the most stars, then the highest score, most pixels, largest file and least id;
    ``facts`` has ``id``, ``user_rating``, ``aesthetic_score``, ``width``, ``height``, ``file_size``
    (nulls count as 0) and rows without facts take no part. Copies of a vector have the same
    neighbours, so they are walked as one node of their best member's rank, and the rest follow it.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    facts = facts.withColumn("id", F.col("id").cast("long"))
    rank = F.array(-zero("user_rating"), -zero("aesthetic_score"), -zero("width") * zero("height"), -zero("file_size"), *_halves("id"))
    known = vectors.join(facts.select("id", rank.alias("rank")), F.col("vec_id") == F.col("id")).drop("id")
    found = classes(known.select("vec_id", "embedding")).checkpoint()
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    member = known.select("vec_id", "rank", v.alias("v")).where(F.col("v").isNotNull())
    named = member.groupBy("v").agg(F.min("vec_id").alias("cls"), F.min_by("vec_id", "rank").alias("best"), F.min("rank").alias("rank"), F.count("*").alias("n"))
    named = named.join(found.select("cls"), "cls", "left_semi").checkpoint()
    pairs = near_pairs(found, threshold).checkpoint()
    lost = keepers(pairs, named.select(F.col("cls").alias("id"), "rank"))
    near = pairs.select("a", "b", "similarity").union(pairs.select("b", "a", "similarity"))
    lost = lost.join(near, (F.col("id") == F.col("a")) & (F.col("keeper") == F.col("b"))).select(F.col("id").alias("cls"), F.col("keeper").alias("by"), "similarity")
    to = named.select(F.col("cls").alias("by"), F.col("best").alias("keeper"))
    of_class = named.select("v", "cls", "best").join(lost.join(to, "by").select("cls", "keeper", "similarity"), "cls", "left")
    out = member.join(of_class, "v").select(F.col("vec_id").alias("id"), F.coalesce("keeper", "best").alias("keeper"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    return out.where("id <> keeper")


def hash_pairs(rows: DataFrame, most: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of different 64-bit hashes (column ``h``) within ``most`` bits: equal in one of
    ``most`` + 1 bands at least, then verified. Equal hashes are one row first; a band's value that
    many hashes share is dealt to chunks."""
    width, bands = 64 // (most + 1), most + 1
    cut = lambda k: F.shiftrightunsigned("h", k * width).bitwiseAND(F.lit((1 << width) - 1 if k < most else (1 << min(63, 64 - k * width)) - 1).cast("long"))
    banded = rows.where("h IS NOT NULL").select("h").distinct().select(F.col("h").alias("cls"), "h", F.posexplode(F.array(*(cut(k) for k in range(bands)))).alias("band", "value"))
    both = banded.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False))))
    met = meeting(both, ["band", "value"], "h").where((F.col("px") < F.col("py")) & (F.bit_count(F.col("px").bitwiseXOR(F.col("py"))) <= most))
    return met.select(F.col("px").alias("a"), F.col("py").alias("b")).distinct()


def hash_groups(rows: DataFrame, most: int) -> DataFrame:
    """Rows (``id``, ``h``) that an earlier row's cluster takes, and that row (``id``, ``keeper``): in the
    order of ids, a row that is left takes all later rows that are left and within ``most`` bits.

    Rows of one hash have the same neighbours and follow the first of them. Null hashes take no part.
    """
    if most < 0:
        return rows.where("false").select("id", F.col("id").alias("keeper"))
    held = rows.where("h IS NOT NULL").groupBy("h").agg(F.min("id").alias("best")).checkpoint()
    pairs = hash_pairs(held, most)
    lost = keepers(pairs, held.select(F.col("h").alias("id"), F.array(*_halves("best")).alias("rank")))
    to = held.select(F.col("h").alias("keeper"), F.col("best").alias("to"))
    named = held.join(lost.join(to, "keeper").select(F.col("id").alias("h"), "to"), "h", "left")
    out = rows.hint("merge").join(named, "h").select("id", F.coalesce("to", "best").alias("keeper"))
    return out.where("id <> keeper")


def summary(vectors: DataFrame, groups: DataFrame, facts: DataFrame) -> DataFrame:
    """One row of a duplicate scan: vectors, groups, losers, and the bytes of the losers' files."""
    sized = groups.join(facts.select("id", "file_size"), "id")
    lost = sized.agg(F.count_distinct("keeper").alias("groups"), F.count("*").alias("redundant"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("reclaimable_bytes"))
    return vectors.agg(F.count("embedding").alias("embedded")).join(F.broadcast(lost))  # one row each
