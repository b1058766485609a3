"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Fingerprints of 64 bits are linked when at most ``max_bits`` bits differ. The bits are grouped
into partitions so that correlated bits share one; each fingerprint gets its own thresholds
t_1..t_m with t_1+..+t_m = max_bits - m + 1 (-1: skip that partition), for which the principle
guarantees that any fingerprint within ``max_bits`` lies within t_i in some partition i. A dynamic
program picks the thresholds with the fewest estimated candidates, then the values within t_i are
probed in an index of all fingerprints, and candidates are verified by their exact distance.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import UnionFind, components, materialize, null_as_empty, spread_join

SEED = 42
#: An index entry with more fingerprints than this is dealt with as a block, not as pairs.
HOT_BUCKET = 48
#: What a probe costs (made, shuffled, sorted) for each candidate that is compared where it lies.
PROBE_COST = 16
#: Fingerprints of a hot entry that meet in one task: two chunks.
CHUNK = 4096
#: Values per partition whose counts the estimates know exactly.
HEAVY_VALUES = 256


def fingerprint(text: str, shingle: int = 4) -> int:
    """The SimHash of one text, as an unsigned number.

    A-Z is lower-cased, words are runs of anything but ASCII white space; a text of fewer words
    than a shingle is one shingle, one without words gives 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        view = memoryview(joined)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(view[s:e], SEED) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.array(hashes[at : at + 8192], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint_udf(shingle: int = 4):
    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in null_as_empty(texts)], dtype=np.uint64).astype(np.int64))

    return of


def _bit_counts(batches):
    """Per task: how often two bits are set together (64 x 64; the diagonal counts single bits)."""
    total, n = np.zeros((64, 64)), 0
    for pdf in batches:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        bits = ((fp[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
        total += bits.T @ bits
        n += len(fp)
    yield pd.DataFrame({"cell": np.arange(64 * 64 + 1), "n": np.append(total.ravel(), n).astype(np.int64)})


def bit_groups(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The 64 bits in ``m`` groups of nearly equal width, correlated bits together.

    Greedy: a group starts with the free bit that correlates most with others and takes the free
    bit of the largest summed absolute correlation with its members until it is full.
    """
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, groups = list(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def ball(width: int, t: int) -> int:
    """Values within ``t`` bits of a value of ``width`` bits."""
    return sum(comb(width, k) for k in range(t + 1)) if t >= 0 else 0


def masks(width: int, t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for k in range(t + 1) for bits in combinations(range(width), k)], dtype=np.uint64).view(np.int64)


def choose_m(n: int, max_bits: int) -> int:
    """The number of partitions with the fewest estimated probes and candidates for ``n`` fingerprints."""

    def cost(m):
        low, more = divmod(max_bits - m + 1, m)
        width = 64 // m
        return sum(ball(width, low + (k < more)) * (PROBE_COST + n / 2**width) for k in range(m))

    return min(range(1, max_bits + 2), key=cost)


def part_values(fp: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of one group of unsigned fingerprints, as numbers."""
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(group):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def allocate(values: list[np.ndarray], widths: list[int], n: int, heavy: list[tuple[np.ndarray, np.ndarray]], max_bits: int) -> np.ndarray:
    """Thresholds for each fingerprint and partition, by dynamic programming.

    The cost of threshold t in a partition: ``PROBE_COST`` for each probed value, plus the estimated
    candidates: an even spread of all fingerprints, and the counts of heavy values within t.
    """
    m, rows = len(values), len(values[0])
    top = max_bits - m + 1
    choices = range(-1, max_bits + 1)
    best, pick = {0: np.zeros(rows)}, []
    for v, width, (known, counts) in zip(values, widths, heavy):
        near = np.bitwise_count(v[:, None] ^ known[None, :]) if len(known) else np.zeros((rows, 0), np.uint8)
        costs = {-1: np.zeros(rows)} | {t: ball(width, t) * (PROBE_COST + n / 2**width) + (near <= t) @ counts for t in choices if t >= 0}
        after, chosen = {}, {}
        for s, cost in best.items():
            for t in choices:
                c = cost + costs[t]
                if s + t not in after:
                    after[s + t], chosen[s + t] = c, np.full(rows, t)
                else:
                    less = c < after[s + t]
                    after[s + t] = np.where(less, c, after[s + t])
                    chosen[s + t] = np.where(less, t, chosen[s + t])
        best = after
        pick.append(chosen)
    out, s = np.zeros((rows, m), np.int64), np.full(rows, top)
    for k in range(m - 1, -1, -1):
        for level, chosen in pick[k].items():
            at = s == level
            out[at, k] = chosen[at]
        s = s - out[:, k]
    return out


def _entries(groups, n, heavy, max_bits):
    """Index entries (probe false) and probes (true) of each fingerprint."""
    widths = [len(g) for g in groups]
    near = {(w, t): masks(w, t) for w in set(widths) for t in range(max_bits + 1) if ball(w, t) < 200_000}

    def of(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                signed = pdf["fp"].to_numpy(np.int64)[at : at + 4096]
                fp = signed.view(np.uint64)
                values = [part_values(fp, g) for g in groups]
                limits = allocate(values, widths, n, heavy, max_bits)
                for part, (v, width) in enumerate(zip(values, widths)):
                    yield pd.DataFrame({"part": np.full(len(fp), part, np.int32), "value": v, "fp": signed, "probe": False})
                    for t in range(max_bits + 1):
                        rows = np.flatnonzero(limits[:, part] == t)
                        flips = near[(width, t)] if (width, t) in near else masks(width, t)
                        step = max(1, 200_000 // len(flips))
                        for i in range(0, len(rows), step):
                            own = rows[i : i + step]
                            yield pd.DataFrame({"part": np.int32(part), "value": (v[own][:, None] ^ flips[None, :]).ravel(), "fp": np.repeat(signed[own], len(flips)), "probe": True})

    return of


def link_block(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among fingerprints of one block: a forest, never all pairs.

    Fingerprints gather around leaders within ``max_bits``. A leader alone can be linked only to
    members of a leader within twice that, and members of two leaders only if these are within
    three times that; they are compared only while the two are not connected yet. Leaders are
    never linked to each other, so two leaders alone need no look.
    """
    fp = np.unique(fp.view(np.uint64))
    links, alone, leaders, members = UnionFind(), [], [], []
    edges: list[tuple[int, int]] = []

    def join(x: int, y: int) -> None:
        if links.link(x, y):
            edges.append((x, y))

    left = np.arange(len(fp))
    while len(left):
        d = np.bitwise_count(fp[left] ^ fp[left[0]])
        own = left[d <= max_bits]
        if len(own) == 1:
            alone.append(int(own[0]))
        else:
            for x in own[1:].tolist():
                join(int(own[0]), x)
            leaders.append(int(own[0]))
            members.append(own)
        left = left[d > max_bits]
    single, heads = np.array(alone, np.int64), fp[np.array(leaders, np.int64)]
    for i, own in enumerate(members):
        close = single[np.bitwise_count(fp[single] ^ heads[i]) <= 2 * max_bits]
        for at in range(0, len(own), 512):
            near = np.bitwise_count(fp[own[at : at + 512], None] ^ fp[close][None, :]) <= max_bits
            for k in np.flatnonzero(near.any(axis=0)).tolist():
                join(int(own[at + near[:, k].argmax()]), int(close[k]))
        for j in (np.flatnonzero(np.bitwise_count(heads[i + 1 :] ^ heads[i]) <= 3 * max_bits) + i + 1).tolist():
            if links.root(leaders[i]) == links.root(leaders[j]):
                continue
            for at in range(0, len(own), 512):
                hit = np.argwhere(np.bitwise_count(fp[own[at : at + 512], None] ^ fp[members[j]][None, :]) <= max_bits)
                if len(hit):
                    join(int(own[at + hit[0][0]]), int(members[j][hit[0][1]]))
                    break
    return [(int(fp[x].astype(np.int64)), int(fp[y].astype(np.int64))) for x, y in edges]


def near_links(unique: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links ``a``-``b`` between the distinct fingerprints ``fp`` (longs) of ``unique``; whatever is
    connected by distances of at most ``max_bits`` is connected by them."""
    counts = unique.select("fp").mapInPandas(_bit_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(64 * 64 + 1)
    for cell, n in counts:
        sums[cell] = n
    n = int(sums[-1])
    m = choose_m(n, max_bits)
    groups = bit_groups(sums[:-1].reshape(64, 64), n, m)
    bits = F.col("fp")
    value = lambda g: sum(((F.shiftrightunsigned(bits, b).bitwiseAND(F.lit(1).cast("long"))) * F.lit((1 << k) - (1 << 64 if k == 63 else 0)) for k, b in enumerate(g)), F.lit(0).cast("long"))
    index = unique.select(F.explode(F.array(*(F.struct(F.lit(k).alias("part"), value(g).alias("value")) for k, g in enumerate(groups)))).alias("e")).select("e.*")
    hot = materialize(index.groupBy("part", "value").count().where(F.col("count") > HOT_BUCKET), "hot-values")
    heavy = []
    for k in range(m):
        top = hot.where(F.col("part") == k).orderBy(F.desc("count"), "value").limit(HEAVY_VALUES).collect()
        heavy.append((np.array([r["value"] for r in top], np.int64), np.array([r["count"] for r in top], np.float64)))
    entries = unique.select("fp").mapInPandas(_entries(groups, n, heavy, max_bits), "part int, value long, fp long, probe boolean")
    few = hot.limit(20_001).count() <= 20_000  # by row count: at most 20,000 keys of 12 bytes are sent to all
    keys = F.broadcast(hot.select("part", "value")) if few else hot.select("part", "value")
    cold = entries.join(keys, ["part", "value"], "left_anti")
    pairs = cold.where("probe").select("part", "value", F.col("fp").alias("a")).join(cold.where("not probe").select("part", "value", F.col("fp").alias("b")), ["part", "value"])
    found = pairs.where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    sized = hot.withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int")).select("part", "value", "chunks")
    inside = entries.join(F.broadcast(sized) if few else sized, ["part", "value"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    inside = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    inside = inside.select("part", "value", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    # Blocks cost by the square of their rows, so they are dealt by their number, not by bytes.
    blocks = sized.agg(F.sum(F.col("chunks") * (F.col("chunks") + 1) / 2)).first()[0] or 0
    tasks = max(int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(blocks) // 16)
    inside = inside.repartition(tasks, "part", "value", "lo", "hi")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(link_block(pdf["fp"].to_numpy(np.int64), max_bits), columns=["a", "b"], dtype="int64")

    return found.union(inside.groupBy("part", "value", "lo", "hi").applyInPandas(block, "a long, b long"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, max_bits: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id``, ``fp``), and distinct fingerprints with their smallest id (``least``), the
    rows that have them (``n``) and the root of their group."""
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(shingle)(F.col(text_col)).alias("fp")), "fingerprints")
    unique = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "unique-fingerprints")
    linked = components(near_links(unique, max_bits), "simhash-links")
    rooted = unique.join(linked, unique["fp"] == linked["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    return rows, materialize(rooted, "rooted-fingerprints")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4, shingle: int = 4) -> DataFrame:
    """Fingerprint and group of every row: ``id_col``, ``fp`` (long), ``component_id``.

    ``component_id`` is the smallest id that links reach, itself included (null only if no row of
    the group has an id). Null and empty texts, and texts without words, have fingerprint 0 and
    link with each other. Repeated rows each get a row; other columns are not carried. An empty
    table gives an empty result.
    """
    rows, rooted = _grouped(docs, id_col, text_col, max_bits, shingle)
    sizes = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    named = spread_join(rooted, sizes, ["root"], "fps").select("fp", "n", "component_id")
    return spread_join(rows, named, ["fp"], "n").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4, shingle: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id.

    Rows without an id are kept only if their group has none with an id. If several rows of a group
    have its smallest id (or none has one), the one of the smallest fingerprint stays, and of equal
    fingerprints the one of the smallest text (nulls first). Rows that repeat an id in different
    groups stay in each. All columns are kept; an empty table gives an empty result.
    """
    rows, rooted = _grouped(docs, id_col, text_col, max_bits, shingle)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("without"), "least", "fp")).alias("w"))
    winners = materialize(first.select(F.col("w.least").alias("doc_id"), F.col("w.fp").alias("fp")), "winners")
    with_id = winners.where(F.col("doc_id").isNotNull())
    # Ids of winners grow with the corpus, so they are never sent to all: texts are dealt by id once,
    # at every size, and looked up in their task's winners without being sorted.
    kept = docs.join(with_id.select(F.col("doc_id").alias(id_col)).distinct().hint("shuffle_hash"), id_col, "left_semi").select(*docs.columns)

    def one_each(some: DataFrame, chosen: DataFrame) -> DataFrame:
        packed = some.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), fingerprint_udf(shingle)(F.col(text_col)).alias("fp"))
        single = packed.groupBy("doc_id", "fp").agg(F.min_by("row", F.struct(F.col(f"row.`{text_col}`"))).alias("row"))
        here = chosen.select(F.col("doc_id").alias("d"), F.col("fp").alias("f"))
        return single.join(here, single["doc_id"].eqNullSafe(here["d"]) & (single["fp"] == here["f"]), "left_semi").select("row.*")

    repeated = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():  # an id alone doesn't name a row: fingerprints tell the winners apart
        kept = one_each(kept, with_id)
    without = winners.where(F.col("doc_id").isNull())
    if not without.isEmpty():
        kept = kept.unionByName(one_each(docs.where(F.col(id_col).isNull()), without))
    return kept


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicate_groups(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
