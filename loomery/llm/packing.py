"""Packing of tokenized documents into fixed-length sequences by first-fit decreasing.

Documents are tokenized once, where they lie, and cut into pieces of at most ``capacity`` tokens;
full pieces are sequences of their own and are never shuffled. The rest goes to randomised groups of
a bounded expected number of tokens, and in each group a tournament tree over the bins' free room finds the first bin that fits a
piece in logarithmic time. As pieces may be cut, the room that is left in full-looking bins is then
filled from the emptiest ones, so that a group pads one sequence at most.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, null_as_empty, null_id, whole_id

CAPACITY = 2048
END_ID = 1
#: Expected tokens in a group of pieces that aren't full.
GROUP_TOKENS = 1 << 21
#: Fixed value: the pattern that cuts a text before byte-level merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as bytes of little-endian unsigned 32-bit numbers.

    The merges run on the vocabulary read from the tokenizer's file; its special tokens are found
    in texts as the tokenizer itself finds them. Texts that tiktoken's regex gives up on (white
    space of about a million characters on end) go to the tokenizer itself, which gives the same ids.
    """

    def __init__(self, tokenizer_file: str | None = None):
        import tiktoken

        self.file, self.whole = tokenizer_file or _default_tokenizer(), None
        with open(self.file, encoding="utf-8") as f:
            held = json.load(f)
        byte_of = {c: b for b, c in byte_characters().items()}
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in held["model"]["vocab"].items() if piece not in special}
        self.special = special
        self.encoding = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._encode(t).astype("<u4", copy=False).tobytes() for t in texts]

    def _encode(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the regex ran out of its stack
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.file)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if it
    is visible, else the next unused one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Tournament:
    """The free room of bins in a complete binary tree; each node has the most of its two."""

    def __init__(self, bins: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.most = [0] * (2 * self.size)

    def put(self, i: int, room: int) -> None:
        most = self.most
        i += self.size
        most[i] = room
        while i > 1:
            i >>= 1
            best = max(most[2 * i], most[2 * i + 1])
            if most[i] == best:
                break
            most[i] = best

    def first(self, need: int) -> int:
        """The first bin with that much room, or -1."""
        most = self.most
        if most[1] < need:
            return -1
        i = 1
        while i < self.size:
            i *= 2
            if most[i] < need:
                i += 1
        return i - self.size


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers; pieces in order of falling length, ties by number."""
    tree, bins, room = Tournament(len(lengths)), [], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = tree.first(lengths[k])
        if at < 0:
            at = len(bins)
            bins.append([])
            room.append(capacity)
        bins[at].append(k)
        room[at] -= lengths[k]
        tree.put(at, room[at])
    return bins


def pack(pieces: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of cuts (piece, from, to) for pieces (number, from, to) of at most ``capacity``.

    After first-fit decreasing, the fullest bins' room is filled by cuts from the emptiest bins.
    """
    bins = [[pieces[k] for k in b] for b in first_fit_decreasing([e - s for _, s, e in pieces], capacity)]
    fill = [sum(e - s for _, s, e in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-fill[i], i))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, source = order[lo], order[hi]
        room = capacity - fill[to]
        if room == 0:
            lo += 1
            continue
        if not bins[source]:
            hi -= 1
            continue
        n, s, e = bins[source].pop()
        cut = min(room, e - s)
        bins[to].append((n, s, s + cut))
        if s + cut < e:
            bins[source].append((n, s + cut, e))
        fill[to] += cut
        fill[source] -= cut
    return [b for b in bins if b]


_PIECE = "doc_id long, absent boolean, doc_tokens long, start long, length long, ids binary, lot long"
_OUT = "doc_id long, absent boolean, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _cut(capacity: int, tokenizer_file: str | None, seed: int):
    """Per task: each document's ids and its pieces, each with a random number for its group."""
    from pyspark import TaskContext

    encoder = None
    end = np.array([END_ID], dtype="<u4").tobytes()

    def of(batches):
        nonlocal encoder
        encoder = encoder or Encoder(tokenizer_file)
        draw = np.random.default_rng((seed, TaskContext.get().partitionId()))
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                rows = []
                for doc_id, absent, ids in zip(part["doc_id"], part["absent"], encoder.encode(null_as_empty(part["text"]))):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        rows.append((doc_id, absent, n, start, min(capacity, n - start), ids[4 * start : 4 * (start + capacity)]))
                out = pd.DataFrame(rows, columns=["doc_id", "absent", "doc_tokens", "start", "length", "ids"])
                yield out.assign(lot=draw.integers(0, 1 << 62, len(out)))

    return of


def _pack_group(capacity: int):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "lot"], kind="stable")
        ids, starts, lengths = pdf["ids"].tolist(), pdf["start"].tolist(), pdf["length"].tolist()
        docs, absent, totals = pdf["doc_id"].tolist(), pdf["absent"].tolist(), pdf["doc_tokens"].tolist()
        base = int(pdf["grp"].iloc[0]) << 32
        rows = []
        for sequence, cuts in enumerate(pack([(k, 0, n) for k, n in enumerate(lengths)], capacity)):
            offset = 0
            for k, s, e in cuts:
                rows.append((docs[k], absent[k], starts[k] + s, e - s, ids[k][4 * s : 4 * e], totals[k], base + sequence, offset))
                offset += e - s
        return pd.DataFrame(rows, columns=["doc_id", "absent", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return of


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_file: str | None = None, group_tokens: int = GROUP_TOKENS, seed: int = 17) -> DataFrame:
    """The pieces of every row of ``docs`` with their ids: ``doc_id``, ``start``, ``length``,
    ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    Null and empty texts are the end token alone. Rows are cut independently, so repeated rows and
    ids, and null ids, are packed like any other. Other columns are not carried. An empty table
    gives no sequences. Groups hold ``group_tokens`` tokens on average, whatever the input.
    """
    rows = docs.select(*whole_id(id_col), F.col(text_col).alias("text"))
    pieces = materialize(rows.mapInPandas(_cut(capacity, tokenizer_file, seed), _PIECE), "pieces")
    full, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    groups = max(1, -(-(rest.agg(F.sum("length")).first()[0] or 0) // group_tokens))
    grouped = rest.withColumn("grp", F.col("lot") % groups).groupBy("grp").applyInPandas(_pack_group(capacity), _OUT)
    # Sequences of groups are numbered from 0, those of full pieces from 2**62 by their place in the table.
    own = F.monotonically_increasing_id() + F.lit(1 << 62)
    alone = full.select("doc_id", "absent", "start", "length", "ids", "doc_tokens", own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(grouped).select(null_id(), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def digests(sequences: DataFrame) -> DataFrame:
    """Pieces with the crc32 of their ids instead of the ids."""
    return sequences.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(packed(spark.read.parquet(f"{sf_dir}/documents.parquet")))
