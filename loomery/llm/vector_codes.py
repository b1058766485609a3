"""Vector code compression: product quantisation trained by an RDD tree aggregation.

Quantised vectors are stored once as columnar blocks: one row of integers for each dimension. In
each round a task measures every part of its blocks against that part's codebook, dimension by
dimension, and adds the vectors to int64 tensors of sums and counts with ``np.add.at``; the tensors
of all tasks merge through a reduction tree, so the driver meets a few of them, whatever the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join
from .quantised import matrix, quantised

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors of a block, and of the piece of it that is measured at once.
BLOCK = 2048
PIECE = 256


def part_blocks(parts: int):
    """Per batch: blocks of vectors of one length, a row for each dimension; a length that isn't a
    multiple of ``parts`` is filled up with zeros, which are no distance apart."""

    def of(batches):
        for b in batches:
            length = b.column("dim").to_numpy()
            for dim in np.unique(length).tolist():
                x = matrix(b.column("q").filter(pa.array(length == dim)), dim)
                x = np.pad(x, ((0, 0), (0, -dim % parts))).astype(np.int32)
                for at in range(0, len(x), BLOCK):
                    piece = np.ascontiguousarray(x[at : at + BLOCK].T)
                    yield pa.RecordBatch.from_pydict({"dim": np.int32([dim]), "n": np.int32([piece.shape[1]]), "block": pa.array([piece.tobytes()], pa.binary())})

    return of


def nearest(block: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each column of ``block`` the nearest of ``entries`` (dimension by entry), the lower index
    at ties, and its squared distance; exact."""
    most = int(np.abs(block).max(initial=0)) + int(np.abs(entries).max(initial=0))
    kind = np.int32 if most * most * max(1, len(block)) < 1 << 31 else np.int64
    block, entries = block.astype(kind), entries.astype(kind)
    index, error = np.empty(block.shape[1], np.int64), np.empty(block.shape[1], np.int64)
    for at in range(0, block.shape[1], PIECE):
        piece = block[:, at : at + PIECE]
        total = np.zeros((piece.shape[1], entries.shape[1]), kind)
        step = np.empty_like(total)
        for x, c in zip(piece, entries):
            np.subtract(x[:, None], c, out=step)
            np.multiply(step, step, out=step)
            total += step
        index[at : at + PIECE] = best = total.argmin(axis=1)
        error[at : at + PIECE] = total[np.arange(len(best)), best]
    return index, error


def _add(books: dict[int, np.ndarray]):
    """Adds a stored block to the tensors: by length, sums (part, dimension, entry) and counts."""

    def of(held, row):
        dim, n, raw = row
        book = books[dim]  # part, dimension, entry
        parts, width, entries = book.shape
        block = np.frombuffer(raw, np.int32).reshape(parts, width, n)
        held = {} if held is None else held
        if dim not in held:
            held[dim] = np.zeros(book.shape, np.int64), np.zeros((parts, entries), np.int64)
        sums, counts = held[dim]
        for p in range(parts):
            index, _ = nearest(block[p], book[p])
            np.add.at(counts[p], index, 1)
            for d in range(width):
                np.add.at(sums[p, d], index, block[p, d].astype(np.int64))
        return held

    return of


def _merge(a, b):
    if a is None or b is None:
        return b if a is None else a
    for dim, (sums, counts) in b.items():
        if dim in a:
            a[dim][0].__iadd__(sums), a[dim][1].__iadd__(counts)
        else:
            a[dim] = sums, counts
    return a


def first_books(rows: DataFrame, parts: int, entries: int) -> dict[int, np.ndarray]:
    """By length: the parts of the vectors of the smallest ids (part, dimension, entry)."""
    books = {}
    for dim in sorted(r["dim"] for r in rows.select("dim").distinct().collect()):  # lengths in use
        first = rows.where(F.col("dim") == dim).orderBy(F.asc_nulls_last("id"), "q").select("q").limit(entries).collect()
        x = np.array([r["q"] for r in first], np.int64).reshape(len(first), dim)
        x = np.pad(x, ((0, 0), (0, -dim % parts)))
        books[dim] = np.ascontiguousarray(x.T).reshape(parts, x.shape[1] // parts, len(first))
    return books


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Codebooks by length (part, dimension, entry) of ``rows`` (``id``, ``dim``, ``q``)."""
    books = first_books(rows, parts, entries)
    if not books:
        return books
    stored = materialize(rows.select("dim", "q").mapInArrow(part_blocks(parts), "dim int, n int, block binary"), "part-blocks")
    blocks = stored.rdd.map(tuple)
    for _ in range(rounds):
        for dim, (sums, counts) in blocks.treeAggregate(None, _add(books), _merge).items():
            used = counts[:, None, :] > 0
            books[dim] = np.where(used, sums // np.maximum(counts, 1)[:, None, :], books[dim])
    return books


def _encode(books: dict[int, np.ndarray], digests: dict[int, str]):
    def of(batches):
        for b in batches:
            length = b.column("dim").to_numpy()
            code, error = np.empty(len(length), object), np.zeros(len(length), np.int64)
            for dim in np.unique(length).tolist():
                at, book = np.flatnonzero(length == dim), books[dim]
                x = np.pad(matrix(b.column("q").take(pa.array(at)), dim), ((0, 0), (0, -dim % len(book))))
                found = [nearest(part, book[p]) for p, part in enumerate(np.ascontiguousarray(x.T).reshape(len(book), -1, len(x)))]
                raw = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
                code[at], error[at] = [r.tobytes().hex() for r in raw], sum(e for _, e in found)
            held = {c: b.column(c) for c in b.schema.names if c not in ("q", "dim")}
            yield pa.RecordBatch.from_pydict({**held, "code": pa.array(code, pa.string()), "error": error, "books": pa.array([digests[d] for d in length.tolist()], pa.string())})

    return of


def digest(book: np.ndarray) -> str:
    """Sha256 of all integers of a codebook by part, entry and place in the part."""
    return hashlib.sha256(",".join(map(str, book.transpose(0, 2, 1).ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error``, ``codebooks_sha256`` of every vector that is
    not null and holds no null or non-finite component; other rows have no result.

    All sums, means and distances are integers and exact; ties go to the lower index, entries that
    nothing is nearest to stay. Repeated rows count as often as they occur; of equal ids the smaller
    vector is the first start, null ids are the last. Fewer vectors than ``entries`` make as many
    entries. Vectors of each length have codebooks of their own. Null labels are one label, labels
    may be of any type that has a text form. An empty table gives an empty result; other columns are
    not carried. A component of 2**17 or more in size is an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index is one byte")
    label = F.col(label_col)
    rows = quantised(vectors, id_col, vector_col, F.size(vector_col).alias("dim"), F.coalesce(label.cast("string"), F.lit("")).alias("label"), label.isNull().alias("bare"))
    books = train(rows, parts, entries, rounds)
    coded = rows.mapInArrow(_encode(books, {d: digest(b) for d, b in books.items()}), "id long, label string, bare boolean, code string, error long, books string")
    coded = materialize(coded, "vector-codes")
    sums = coded.groupBy("label", "bare").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = spread_join(coded, sums, ["label", "bare"], "n")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.col("books").alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
