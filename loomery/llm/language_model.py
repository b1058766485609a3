"""A hidden Markov language model over words, trained by Baum-Welch.

A latent state emits a word class (the ends of the word, hashed to a fixed number of classes), and
a class emits the word by its corpus count: P(w | s) = P(class(w) | s) * (c(w) + 1) / (C + V + 1),
with C and V the class's tokens and distinct words in training. So the state tables have a fixed
size, and the word table grows with the corpus and stays distributed. Texts are split into words
once: a task makes blocks of its texts, numbers a block's words, and from then on texts are arrays of
such numbers and of classes. The expected counts of an iteration are summed across partitions; scoring
runs the scaled forward recursion over whole texts.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc32, materialize, null_id, spread_join, whole_id

STATES = 6
CLASSES = 4096
ITERATIONS = 3
#: Tokens of a training run; a longer text is several runs, the later of which begin in the states
#: that the model is in on average, and don't count as starts.
SEQUENCE = 512
#: A block takes texts until it has so many UTF-8 bytes; its words and their counts meet in one task.
BLOCK_BYTES = 16 << 20
#: Scoring deals the blocks to four times as many tasks, for an even spread, and to so many at most.
MOST_TASKS = 50_000
END = b""
LOG10 = np.log(10)


def tokens(text: bytes) -> list[bytes]:
    """Words of UTF-8 bytes (A-Z lower-cased, split at ASCII white space), then the end."""
    out = text.lower().split()
    out.append(END)
    return out


def end_classes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Class of each word ``raw[start:stop]`` of lower-cased bytes: 0 for an empty word (the end),
    else the hash of its first two and last three bytes (of up to five bytes: of all of them),
    from 1 to CLASSES - 1."""
    length = stops - starts
    key = np.minimum(length, 6).astype(np.uint64)
    top = max(len(raw) - 1, 0)
    for k, at in enumerate((starts, starts + 1, stops - 3, stops - 2, stops - 1)):
        inside = (at >= starts) & (at < stops)
        byte = raw[np.clip(at, 0, top)] if len(raw) else np.zeros(len(at), np.uint8)
        key |= np.where(inside, byte, 0).astype(np.uint64) << np.uint64(8 * (k + 1))
    key = (key ^ (key >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (key >> np.uint64(40)) % np.uint64(CLASSES - 1) + np.uint64(1)
    return np.where(length > 0, mixed, 0).astype(np.int32)


def word_classes(words: list[bytes]) -> np.ndarray:
    """Classes of words that are lower-cased already."""
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return end_classes(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], stops[:-1]]).astype(np.int64), stops)


@dataclass
class Parameters:
    """Start (K), transitions (K x K) and emissions (K x M) of a hidden Markov model."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def initial(base: np.ndarray, seed: int = 7) -> Parameters:
    """States that start near the class distribution ``base``, told apart by seeded noise."""
    draw = np.random.default_rng(seed)
    k = STATES
    emit = base[None, :] * draw.uniform(0.2, 1.8, (k, len(base)))
    emit[:, 0] = base[0]
    move = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1))
    return Parameters(np.full(k, 1 / k), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _by_length(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length, their lengths, and how many are longer than each step."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    active = np.searchsorted(-sorted_lengths, -np.arange(1, sorted_lengths[0] + 1), side="right")
    return order, sorted_lengths, active


def log_likelihoods(sequences: list[np.ndarray], p: Parameters) -> np.ndarray:
    """Natural log probability of each class sequence, by the scaled forward recursion.

    All sequences advance together; at each step their states are scaled to sum to one, and the
    logs of the scales add up to the likelihood.
    """
    order, _, active = _by_length(sequences)
    emit = np.ascontiguousarray(p.emit.T)
    total = np.zeros(len(sequences))
    padded = np.concatenate([sequences[i] for i in order])
    starts = np.concatenate([[0], np.cumsum([len(sequences[i]) for i in order])[:-1]])
    alpha = None
    for t, n in enumerate(active):
        b = emit[padded[starts[:n] + t]]
        alpha = (p.start[None, :] if t == 0 else alpha[:n] @ p.move) * b
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        total[:n] += np.log(scale)
    out = np.zeros(len(sequences))
    out[order] = total
    return out


def lasting(move: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The states that a chain is in on average, far from its start."""
    share = np.full(len(move), 1 / len(move))
    for _ in range(rounds):
        share = share @ move
    return share / share.sum()


def expected_counts(sequences: list[np.ndarray], p: Parameters, starts_text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, moves and emissions, and the log likelihood. Only sequences that
    start a text (all, by default) begin in the start states and count as starts."""
    order, lengths, active = _by_length(sequences)
    opens = np.ones(len(sequences), bool) if starts_text is None else np.asarray(starts_text, bool)
    opens = opens[order]
    begin = np.where(opens[:, None], p.start[None, :], lasting(p.move)[None, :])
    emit = np.ascontiguousarray(p.emit.T)
    padded = np.concatenate([sequences[i] for i in order])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    k, steps = len(p.start), len(active)
    alphas, scales, at = [], [], []
    for t, n in enumerate(active):
        classes = padded[starts[:n] + t]
        alpha = (begin if t == 0 else alphas[-1][:n] @ p.move) * emit[classes]
        scale = alpha.sum(axis=1)
        alphas.append(alpha / scale[:, None])
        scales.append(scale)
        at.append(classes)
    begun, moved, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((len(emit), k))
    beta = np.zeros((0, k))
    for t in range(steps - 1, -1, -1):
        n = active[t]
        beta = np.concatenate([beta, np.ones((n - len(beta), k))])
        gamma = alphas[t] * beta
        np.add.at(emitted, at[t], gamma) if n < 64 else _add(emitted, at[t], gamma)
        ahead = emit[at[t]] * beta / scales[t][:, None]
        if t:
            moved += alphas[t - 1][:n].T @ ahead
            beta = ahead @ p.move.T
        else:
            begun += gamma[opens].sum(axis=0)
    return begun, moved * p.move, emitted.T, float(sum(np.log(s).sum() for s in scales))


def _add(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    for k in range(into.shape[1]):
        into[:, k] += np.bincount(rows, values[:, k], len(into))


def _slices(kind: str, values: np.ndarray):
    """A table of numbers as rows of a bounded size."""
    flat = np.ascontiguousarray(values, np.float64).ravel()
    return [(f"{kind}{k}", flat[k * 4096 : (k + 1) * 4096].tobytes()) for k in range(-(-len(flat) // 4096))]


def _sum_slices(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(b, np.float64) for b in pdf["sums"]], axis=0)
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "sums": [total.tobytes()]})


def _summed(stats: DataFrame) -> dict[str, np.ndarray]:
    """Slices of all partitions, added up: as many rows as one partition has, whatever the input."""
    rows = stats.groupBy("part").applyInPandas(_sum_slices, "part string, sums binary").collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["part"][0], []).append((int(r["part"][1:]), np.frombuffer(r["sums"], np.float64)))
    return {k: np.concatenate([x for _, x in sorted(v, key=lambda y: y[0])]) for k, v in out.items()}


def train(texts: DataFrame, base: np.ndarray, iterations: int = ITERATIONS) -> Parameters:
    """Baum-Welch over all ``texts`` (column ``classes``: 16-bit classes of a text's tokens), from
    ``base`` class probabilities."""
    p = initial(base)
    for _ in range(iterations):
        now = p

        def step(batches):
            sums = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))]
            for pdf in batches:
                held = pdf["classes"].tolist()
                for part in (held[i : i + 512] for i in range(0, len(held), 512)):
                    whole = [np.frombuffer(b, "<u2").astype(np.int32) for b in part]
                    cut = [(s[i : i + SEQUENCE], i == 0) for s in whole for i in range(0, len(s), SEQUENCE)]
                    for total, more in zip(sums, expected_counts([c for c, _ in cut], now, [first for _, first in cut])):
                        total += more
            yield pd.DataFrame([r for kind, s in zip("sme", sums) for r in _slices(kind, s)], columns=["part", "sums"])

        sums = _summed(texts.mapInPandas(step, "part string, sums binary"))
        if "s" not in sums or sums["s"].sum() == 0:
            return p
        norm = lambda x: x / x.sum(axis=-1, keepdims=True)
        emit = sums["e"].reshape(STATES, CLASSES) + 0.5 * STATES * base[None, :]
        p = Parameters(norm(sums["s"] + 0.1), norm(sums["m"].reshape(STATES, STATES) + 0.1), norm(emit))
    return p


def learns(column: str = "doc_id"):
    return F.pmod(id_crc32(column), F.lit(7)) != 2


_BLOCK = "block long, doc_id long, absent boolean, learnt boolean, numbers binary, classes binary, word binary, number int, class int, n long"
_TEXT_ROWS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("absent", pa.bool_()), ("learnt", pa.bool_()), ("numbers", pa.binary()), ("classes", pa.binary())])
_WORD_ROWS = pa.schema([("block", pa.int64()), ("word", pa.binary()), ("number", pa.int32()), ("class", pa.int32()), ("n", pa.int64())])
_ROWS = pa.unify_schemas([_TEXT_ROWS, _WORD_ROWS])


def _in_halves(numbers: np.ndarray) -> bytes:
    """The low 16 bits of all numbers, then the high ones, which are mostly 0 and pack well."""
    return (numbers & 0xFFFF).astype("<u2").tobytes() + (numbers >> 16).astype("<u2").tobytes()


def _of_halves(held: bytes) -> np.ndarray:
    low, high = np.frombuffer(held, "<u2").reshape(2, -1).astype(np.int64)
    return low | high << 16


def _filled(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A batch of all columns, null where ``schema`` has none."""
    held = {f.name: pa.array(c, f.type) for f, c in zip(schema, columns)}
    size = len(columns[0])
    return pa.RecordBatch.from_arrays([held.get(f.name, pa.nulls(size, f.type)) for f in _ROWS], schema=_ROWS)


def _numbered(block: int, number: dict, held: list):
    """A block: a row for each text, with the numbers of its words, and, where it is learnt from, their
    classes; and a row for each distinct word, with its class and its count in training texts."""
    words = list(number)
    classes = word_classes(words)
    learnt = [numbers for _, _, known, numbers in held if known]
    n = np.bincount(np.concatenate(learnt), minlength=len(words)) if learnt else np.zeros(len(words), np.int64)
    of = classes.astype("<u2")
    ids, absent, known, numbers = zip(*held)
    yield _filled(_TEXT_ROWS, [[block] * len(held), ids, absent, known, [_in_halves(x) for x in numbers], [of[x].tobytes() if k else None for x, k in zip(numbers, known)]])
    yield _filled(_WORD_ROWS, [np.full(len(words), block), words, np.arange(len(words), dtype=np.int32), classes, n])


def _blocks(batches):
    """The blocks of one task; a block's name is made of the task's number and the block's own."""
    block, size, number, held = TaskContext.get().partitionId() << 32, 0, defaultdict(count().__next__), []
    for batch in batches:
        for doc_id, absent, learnt, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "absent", "learnt", "text"))):
            words = tokens(text)
            held.append((doc_id, absent, learnt, np.fromiter(map(number.__getitem__, words), np.int64, len(words))))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield from _numbered(block, number, held)
                block, size, number, held = block + 1, 0, defaultdict(count().__next__), []
    if held:
        yield from _numbered(block, number, held)


def _score_block(p: Parameters, floor: np.ndarray, total: int, distinct: int):
    """Scores of a block's texts, given the counts and classes of its words.

    ``floor``: log10 of each class's denominator.
    """
    base_floor = np.log10(total + distinct + 1)

    def of(texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        counts = counts.sort_values("number")
        c, classes = counts["c"].to_numpy(np.int64), counts["class"].to_numpy(np.int64)
        plus, known = np.log10(c + 1.0), c > 0
        rows = []
        for at in range(0, len(texts), 2048):
            part = texts.iloc[at : at + 2048]
            ids = [_of_halves(b) for b in part["numbers"]]
            hidden = log_likelihoods([classes[i] for i in ids], p) / LOG10
            for doc_id, absent, learnt, i, h in zip(part["doc_id"], part["absent"], part["learnt"], ids, hidden):
                words = plus[i].sum()
                rows.append((doc_id, absent, not learnt, len(i), int(known[i].sum()), total, words - len(i) * base_floor, h + words - floor[classes[i]].sum()))
        return pd.DataFrame(rows, columns=["doc_id", "absent", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return of


_SCORES = "doc_id long, absent boolean, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", iterations: int = ITERATIONS) -> DataFrame:
    """Base and model log10 probabilities of every row.

    Null and empty texts are the end alone. Rows of a null id are learnt from. Repeated rows count
    and are scored one by one; other columns are not carried. Without training texts, every word
    is unknown and N and V are 0; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(*whole_id(id_col), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"), learns(id_col).alias("learnt"))
    table = materialize(rows.mapInArrow(_blocks, _BLOCK), "language-model-blocks")
    dictionary = table.where("word IS NOT NULL")
    counts = dictionary.groupBy("word").agg(F.max("class").alias("class"), F.sum("n").alias("c"), F.count("*").alias("blocks"))
    counts = materialize(counts, "language-model-counts")
    sums = counts.groupBy("class").agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v"), F.max("blocks").alias("blocks")).collect()
    c, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        c[r["class"]], v[r["class"]] = r["c"], r["v"]
    total, distinct = int(c.sum()), int(v.sum())
    p = train(table.where("classes IS NOT NULL").select("classes"), (c + 0.5) / (c + 0.5).sum(), iterations)
    of_block = spread_join(dictionary.select(F.col("block").alias("of"), "word", "number"), counts, ["word"], "blocks").select("of", "number", "class", "c")
    blocks = max((r["blocks"] for r in sums), default=0)  # the end is a word of every block
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, 4 * blocks))
    texts = table.where("word IS NULL").select("block", "doc_id", "absent", "learnt", "numbers").repartition(tasks, "block")
    scored = texts.groupBy("block").cogroup(of_block.repartition(tasks, "of").groupBy("of"))
    scored = scored.applyInPandas(_score_block(p, np.log10(c + v + 1), total, distinct), _SCORES)
    return scored.select(null_id(), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
