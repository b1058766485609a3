"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

No piece spans the start of a word, so the lattice of a text is the chain of its words' lattices.
For a batch of texts the lattices of all distinct words are built and filtered forwards at once;
then every word of every text draws its pieces backwards from its end. The draws are hashes of the
row's key and the place in the text, so a row has one segmentation however the table is split.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_id, whole_id

#: UTF-8 characters of text whose lattices are built at once.
BATCH_CHARS = 3_000_000
#: Weight of a byte piece, as the rank of a piece that is seldom seen.
BYTE_RANK = 64_000
#: Keeps the forward sums near 1; a factor for each character leaves every probability as it is.
PER_CHAR = 12.0
#: Codes from here on stand for a character that has no piece and is spelt in bytes.
SPELT = 1 << 20
_WORD = re.compile(r" *[^ ]+| +")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HASH = np.uint64(0x100000001B3)
_ALL_BITS = (1 << 64) - 1


def _default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def draws(keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) from hashed keys."""
    z = keys + np.uint64(int(_MIX) * (step + 1) & _ALL_BITS)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class HashTable:
    """Numbers by 64-bit key, for whole arrays of keys: a few tables, each for what clashed before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.tables = keys, values, []
        left, k = np.arange(len(keys)), 0
        while len(left):
            bits = max(8, int(2 * len(left)).bit_length() + 3)
            mult = np.uint64((0x9E3779B97F4A7C15 + 2 * k * 0x51ED27) | 1)
            slot = self._slot(keys[left], mult, bits)
            table = np.full(1 << bits, -1, np.int32)
            table[slot[::-1]] = left[::-1]
            self.tables.append((mult, bits, table))
            left, k = left[table[slot] != left], k + 1

    @staticmethod
    def _slot(keys, mult, bits):
        return ((keys ^ (keys >> np.uint64(29))) * mult) >> np.uint64(64 - bits)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -2."""
        out = np.full(len(keys), -2, np.int64)
        left = np.arange(len(keys))
        for mult, bits, table in self.tables:
            at = table[self._slot(keys[left], mult, bits)]
            hit = (at >= 0) & (self.keys[at] == keys[left])
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit]
        return out


class Segmenter:
    """Encodes and decodes with a SentencePiece model's vocabulary.

    The model's scores are merge ranks, not log probabilities; a piece of rank r gets the weight
    r ** -``alpha`` (a larger ``alpha`` samples closer to the best segmentation).
    """

    def __init__(self, model_file: str | None = None, alpha: float = 1.0, seed: int = 11):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file or _default_model())
        self.seed = np.uint64(seed)
        n = model.get_piece_size()
        self.byte_id = [0] * 256
        self.raw = [b""] * n
        self.weight = np.zeros(n)
        text: dict[str, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain = piece.replace("▁", " ")
                text[plain] = i
                self.raw[i] = plain.encode()
                self.weight[i] = min(max(-model.get_score(i), 1.0), BYTE_RANK / 2) ** -alpha
        self.byte_weight = BYTE_RANK**-alpha
        self.longest = max(map(len, text))
        table: dict[int, int] = {}
        for plain in text:
            for k in range(1, len(plain)):
                table.setdefault(self._hash(plain[:k]), -1)
        for plain, i in text.items():
            table[self._hash(plain)] = i
        self.table = HashTable(np.fromiter(table, np.uint64, len(table)), np.fromiter(table.values(), np.int64, len(table)))

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_HASH) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def lattice(self, words: list[str]):
        """Edges of the words' lattices, by end node: start node, code, and the keys and log
        probabilities of a backward draw. Node numbers run over all words; a word of n characters
        has n + 1 nodes. Also the first edge into each node, and the first and last node of each
        word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        cps = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), lengths)
        begin = np.cumsum(lengths) - lengths
        place = np.arange(len(cps)) - begin[word]
        room = lengths[word] - place
        node = np.arange(len(cps)) + word
        at, h = np.arange(len(cps)), np.zeros(len(cps), np.uint64)
        src, size, code, weight = [], [], [], []
        for n in range(1, self.longest + 1):
            h = h * _HASH + cps[at + n - 1].astype(np.uint64) + np.uint64(1)
            value = self.table.get(h)
            whole = value >= 0
            src.append(at[whole])
            size.append(np.full(int(whole.sum()), n))
            code.append(value[whole])
            weight.append(self.weight[value[whole]] * PER_CHAR**n)
            if n == 1:
                bare = at[~whole]
                src.append(bare)
                size.append(np.ones(len(bare), np.int64))
                code.append(SPELT + cps[bare].astype(np.int64))
                width = 1 + (cps[bare] > 0x7F) + (cps[bare] > 0x7FF).astype(np.int64) + (cps[bare] > 0xFFFF)
                weight.append(np.maximum(self.byte_weight**width, 1e-18) * PER_CHAR)
            go = (value > -2) & (room[at] > n)
            at, h = at[go], h[go]
            if not len(at):
                break
        s, size, code, weight = map(np.concatenate, (src, size, code, weight))
        # By end node first; edges of a node stay in order of size. Then places in turn.
        order = np.argsort((node[s] + size).astype(np.int32), kind="stable")
        s, size, code, weight = s[order], size[order], code[order], weight[order]
        end_place, end, s = place[s] + size, node[s] + size, node[s]
        longest = int(lengths.max(initial=0))
        by_place = np.argsort(end_place.astype(np.uint16 if longest < 1 << 16 else np.int64), kind="stable")
        nodes = len(cps) + len(words)
        first = begin + np.arange(len(words))
        alpha = np.zeros(nodes)
        alpha[first] = 1.0
        chance = np.zeros(len(s))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(end_place, minlength=longest + 1)[1:])])
        for p, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:]), start=1):
            own = by_place[lo:hi]
            got, into = alpha[s[own]] * weight[own], end[own]
            heads = np.flatnonzero(np.diff(into, prepend=-1))
            sums = np.add.reduceat(got, heads)
            chance[own] = got / np.repeat(sums, np.diff(np.append(heads, hi - lo)))
            alpha[into[heads]] = sums
            if p % self.longest == 0:
                longer = first[lengths > p]
                if len(longer):
                    window = longer[:, None] + np.arange(p - self.longest + 1, p + 1)
                    alpha[window] /= alpha[window].max(axis=1, keepdims=True)
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        sums = np.cumsum(chance)
        before = np.repeat(np.concatenate([[0.0], sums])[heads], np.diff(np.append(heads, len(end))))
        key = end + np.minimum(sums - before, 1.0)
        key[np.append(heads[1:], len(end)) - 1] += 2.0  # above any draw, however it is rounded
        lead = np.zeros(nodes, np.int32)
        lead[end[heads]] = heads
        return s, code, key, np.log(np.maximum(chance, 1e-300)), lead, first, first + lengths

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Sampled ids of each text, and the log probability of each sample."""
        split = [_WORD.findall(" " + t) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        if not counts.sum():
            return [np.zeros(0, np.int64) for _ in texts], np.zeros(len(texts))
        number: dict[str, int] = {}
        for words in split:
            for w in words:
                if w not in number:
                    number[w] = len(number)
        which = np.concatenate([np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in split])
        src, code, key, log_chance, lead, first, last = self.lattice(list(number))
        owner = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        seeds = draws_key(keys, self.seed)[owner] + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        active, now, stop = np.arange(len(which)), last[which], first[which]
        steps, total = [], np.zeros(len(texts))
        taken = np.zeros(len(which), np.int64)
        while len(active):
            e, drawn = lead[now], now + draws(seeds[active], len(steps))
            later = np.flatnonzero(key[e] <= drawn)
            while len(later):
                e[later] += 1
                later = later[key[e[later]] <= drawn[later]]
            steps.append((active, code[e]))
            total += np.bincount(owner[active], log_chance[e], len(texts))
            taken[active] += 1
            now = src[e]
            go = now > stop[active]
            active, now = active[go], now[go]
        ends = np.cumsum(taken)
        out = np.empty(ends[-1], np.int64)
        for k, (rows, codes) in enumerate(steps):
            out[ends[rows] - 1 - k] = codes
        borders = np.concatenate([[0], np.cumsum(np.bincount(owner, taken, len(texts)).astype(np.int64))])
        return [self._spell(out[a:b]) for a, b in zip(borders[:-1], borders[1:])], total

    def _spell(self, codes: np.ndarray) -> np.ndarray:
        """Characters without a piece, in bytes."""
        bare = np.flatnonzero(codes >= SPELT)
        if not len(bare):
            return codes
        spelt = [[self.byte_id[b] for b in chr(c - SPELT).encode("utf-8", "surrogatepass")] for c in codes[bare].tolist()]
        widths = np.ones(len(codes), np.int64)
        widths[bare] = [len(x) for x in spelt]
        out = np.repeat(codes, widths)
        where = np.repeat(np.isin(np.arange(len(codes)), bare, assume_unique=True), widths)
        out[where] = [i for x in spelt for i in x]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of any segmentation: the pieces' bytes in order, less the first space."""
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()])[1:].decode("utf-8", "surrogatepass")


def draws_key(keys: np.ndarray, seed: np.uint64) -> np.ndarray:
    z = (keys.astype(np.int64).view(np.uint64) ^ np.uint64(int(seed) * int(_MIX) & _ALL_BITS)) * np.uint64(0xFF51AFD7ED558CCD)
    return z ^ (z >> np.uint64(33))


def _encode(model_file: str | None, alpha: float, seed: int, check: bool):
    segmenter = None

    def of(batches):
        nonlocal segmenter
        segmenter = segmenter or Segmenter(model_file, alpha, seed)
        for pdf in batches:
            texts = ["" if t is None or t != t else t for t in pdf["text"]]
            keys = pdf["doc_id"].to_numpy(np.int64)
            sizes = np.cumsum([len(t) for t in texts])
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes // BATCH_CHARS)) + 1):
                if not len(part):
                    continue
                own = [texts[i] for i in part]
                ids, chance = segmenter.encode(own, keys[part])
                out = pdf.iloc[part][["doc_id", "absent"]].copy()
                out["ids"] = [x.astype("<u4").tobytes() for x in ids]
                out["log_prob"] = chance
                out["lossless"] = [segmenter.decode(x) == t for x, t in zip(ids, own)] if check else None
                yield out

    return of


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None, alpha: float = 1.0, seed: int = 11, check: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit), ``log_prob`` and, if ``check``, whether
    decoding gives the text back (``lossless``) for every row.

    Null and empty texts have no pieces. A null id samples as id 0; rows that repeat an id and a
    text have equal samples. Other columns are not carried. An empty table gives an empty result.
    """
    rows = docs.select(*whole_id(id_col), F.col(text_col).alias("text"))
    found = rows.mapInPandas(_encode(model_file, alpha, seed, check), "doc_id long, absent boolean, ids binary, log_prob double, lossless boolean")
    return found.select(null_id(), "ids", "log_prob", "lossless")


def decoded(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of encoded rows."""
    segmenter = None

    def of(batches):
        nonlocal segmenter
        segmenter = segmenter or Segmenter(model_file)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "absent": pdf["absent"], "text": [segmenter.decode(np.frombuffer(b, "<u4")) for b in pdf["ids"]]})

    return encoded.select(*whole_id("doc_id"), "ids").mapInPandas(of, "doc_id long, absent boolean, text string").select(null_id(), "text")


def query(spark, sf_dir: str) -> DataFrame:
    found = sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), check=True)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "log_prob", "lossless")
