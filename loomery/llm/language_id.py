"""Language identification by error-correcting output codes.

Every language has a codeword; each of its bits is predicted by a binary classifier over character
n-grams, whose weights are the log ratios of an n-gram's share in the languages of bit 1 to that in
the languages of bit 0. N-grams are counted over all learnt texts, a text's n-grams weigh one over
their number and a text one over the texts of its language, so neither long texts nor frequent
languages lead. A second pass scores all texts; the scores of learnt ones calibrate each bit. A
text's language is that of the codeword of the least loss, where a bit's loss weighs by how well the
bit is told apart; a second codeword that is nearly as close flags the text as ambiguous.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc32, materialize, null_as_empty

ORDERS = (1, 2, 3, 4)
BITS = 15
BUCKETS = 1 << BITS
#: Buckets of a row when counts are brought to the driver: languages * BUCKETS * 8 bytes in all.
SLICE = 1 << 11
#: What the n-grams of one language weigh together.
MASS = 1 << 56
#: Share of a language that an unseen n-gram is taken to have.
UNSEEN = 1e-5
#: Up to so many languages the codewords have all bits that tell any two groups of them apart.
EXHAUSTIVE = 5
#: A text is ambiguous where its second language is less than so much less likely than its first.
MARGIN = 0.2
#: Log odds of a bit, at most, for a text that scores as the mean of its side does.
SURE = 6.0
NONE = "und"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The words of letters of the lower-cased text, each between blanks; empty without a letter."""
    words = _OTHER.sub(" ", text.lower()).strip()
    return f" {words} " if any(map(str.isalpha, words)) else ""


def gram_buckets(words: str) -> np.ndarray:
    """Hashed buckets of the n-grams of ``letters``, one for each place."""
    c = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), np.uint32)
    h, out = np.zeros(len(c) + 1, np.uint32), []
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)) >> np.uint32(32 - BITS))
    return np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)


def codewords(k: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of ``k`` languages; no two bits are equal or opposite.

    Few languages get every bit that splits them; more get about ten bits for each doubling of their
    number, of several drawn codes the one whose closest codewords are the farthest apart.
    """
    if k < 2:
        return np.ones((k, 0), np.int64)
    if k <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (k - 1))
        return np.where(splits[None, :] >> np.arange(k)[:, None] & 1, 1, -1)
    draw, best, far = np.random.default_rng(k), None, -1
    bits = int(np.ceil(10 * np.log2(k)))
    for _ in range(20):
        code = np.unique(np.where(draw.random((k, 2 * bits)) < 0.5, 1, -1) * 1, axis=1)
        code = code * code[:1]  # the first language has +1 throughout, so no bit opposes another
        code = np.unique(code[:, (code != code[:1]).any(axis=0)], axis=1)
        code = code[:, draw.permutation(code.shape[1])[:bits]]
        apart = (code.shape[1] - code @ code.T) // 2 + np.eye(k, dtype=np.int64) * code.shape[1]
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Classifiers:
    """The learnt languages, their codewords, and the weight of each bucket for each bit."""

    names: list[str]
    code: np.ndarray
    weight: np.ndarray

    def bits(self, words: str) -> np.ndarray:
        """Mean weight of the text's n-grams for each bit."""
        found = gram_buckets(words)
        total = np.zeros(self.weight.shape[1])
        for at in range(0, len(found), 1 << 16):
            total += self.weight[found[at : at + (1 << 16)]].sum(axis=0)
        return total / max(1, len(found))


@dataclass
class Decoder:
    """Scale, middle and importance of each bit, and the codewords."""

    names: list[str]
    code: np.ndarray
    scale: np.ndarray
    middle: np.ndarray
    importance: np.ndarray

    def decode(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of bit scores: the language's number, its probability, and ambiguity."""
        z = (bits - self.middle) * self.scale
        loss = np.logaddexp(0, -z[:, None, :] * self.code) * self.importance  # row, language, bit
        loss = loss.sum(axis=2) / max(self.importance.sum(), 1e-9) * np.log2(max(2, len(self.names)))
        chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
        chance /= chance.sum(axis=1, keepdims=True)
        first = chance.argmax(axis=1)
        ranked = np.sort(chance, axis=1)
        close = ranked[:, -1] - ranked[:, -2] < MARGIN if len(self.names) > 1 else np.zeros(len(bits), bool)
        return first, chance[np.arange(len(bits)), first], close


def _counts(number: dict[str, int], texts: dict[str, int]):
    """Per task: what each bucket weighs in each language."""

    def of(batches):
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for text, lang in zip(null_as_empty(pdf["text"]), pdf["lang"]):
                found = gram_buckets(letters(text))
                if len(found):
                    sums = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    sums += np.bincount(found, minlength=BUCKETS) * max(1, MASS // (texts[lang] * len(found)))
        for lang, sums in held.items():
            some = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": np.int32(number[lang]), "bucket": some.astype(np.int32), "mass": sums[some]})

    return of


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """One slice of a language's counts."""
    out = np.zeros(SLICE, np.int64)
    out[pdf["bucket"].to_numpy() % SLICE] = pdf["mass"]
    return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "slice": pdf["bucket"].iloc[:1] // SLICE, "masses": [out.tobytes()]})


def train(learnt: DataFrame) -> Classifiers:
    """Binary classifiers from ``text`` and ``lang`` (both not null) of all rows of ``learnt``."""
    texts = {r["lang"]: r["count"] for r in learnt.groupBy("lang").count().collect()}  # one row for each language
    names = sorted(texts)
    number = {lang: k for k, lang in enumerate(names)}
    code = codewords(len(names))
    counted = learnt.select("text", "lang").mapInPandas(_counts(number, texts), "lang int, bucket int, mass long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("mass").alias("mass"))
    mass = np.zeros((len(names), BUCKETS), np.int64)
    for r in summed.groupBy("lang", F.floor(F.col("bucket") / SLICE)).applyInPandas(_packed, "lang int, slice int, masses binary").collect():  # languages * BUCKETS longs
        mass[r["lang"], r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["masses"], np.int64)
    share = mass / np.maximum(mass.sum(axis=1, dtype=np.float64), 1.0)[:, None]
    weight = np.zeros((BUCKETS, code.shape[1]))
    for j, bit in enumerate(code.T):
        weight[:, j] = np.log((share[bit > 0].mean(axis=0) + UNSEEN) / (share[bit < 0].mean(axis=0) + UNSEEN))
    return Classifiers(names, code, weight)


def calibrated(model: Classifiers, moments: list) -> Decoder:
    """The decoder from ``moments``: rows of ``lang``, and mean and variance of each bit's score."""
    k, n_bits = model.code.shape
    middle, scale, importance = np.zeros(n_bits), np.ones(n_bits), np.ones(n_bits)
    seen = {r["lang"]: (np.array(r["mean"]), np.array(r["var"])) for r in moments}
    for j in range(n_bits):
        side = []
        for sign in (1, -1):
            own = [seen[lang] for i, lang in enumerate(model.names) if model.code[i, j] == sign and lang in seen]
            if own:
                mean = np.mean([m[j] for m, _ in own])
                side.append((mean, np.mean([v[j] + (m[j] - mean) ** 2 for m, v in own])))
        if len(side) == 2:
            (high, v_high), (low, v_low) = side
            var = max((v_high + v_low) / 2, 1e-6)
            apart = max(high - low, 1e-3)
            middle[j], scale[j] = (high + low) / 2, min(apart / var, 2 * SURE / apart)
            error = NormalDist().cdf(-max(high - low, 0.0) / (np.sqrt(v_high) + np.sqrt(v_low) + 1e-9))
            importance[j] = np.log((1 - error) / max(error, 1e-3))
    return Decoder(model.names, model.code, scale, middle, np.maximum(importance, 0.1))


def _bit_scores(model: Classifiers):
    def of(texts: pd.Series) -> pd.Series:
        words = [letters(t) for t in null_as_empty(texts)]
        return pd.Series([model.bits(w) if w else None for w in words], dtype=object)

    return F.pandas_udf(of, "array<double>")


def _decoded(decoder: Decoder):
    names = np.array([*decoder.names, NONE], object)

    def of(bits: pd.Series) -> pd.DataFrame:
        told = bits.notna().to_numpy() & (len(decoder.names) > 0)
        first, score, close = np.full(len(bits), len(decoder.names)), np.zeros(len(bits)), np.zeros(len(bits), bool)
        if told.any():
            first[told], score[told], close[told] = decoder.decode(np.stack(bits[told].to_numpy()).reshape(told.sum(), -1))
        return pd.DataFrame({"lang_pred": names[first], "score": score, "ambiguous": close})

    return F.pandas_udf(of, "lang_pred string, score double, ambiguous boolean")


def held_out(column: str = "doc_id") -> Column:
    return F.pmod(id_crc32(column), F.lit(4)) == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``ambiguous`` of every row.

    Learns from rows that are not held out and have a text and a ``lang``; all of them count, none
    is sampled. A null text, one without a letter, and any text where nothing could be learnt is
    ``und`` with score 0 and not ambiguous. One learnt language is predicted for all texts of
    letters. Ties go to the language that is first by name. Rows of a null id are predicted and
    learnt from (their remainder is 0); repeated rows count as often as they occur and each get a
    row. Other columns are neither read nor carried; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("held_out", held_out())
    learns = ~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()
    model = train(rows.where(learns).select("text", "lang"))
    scored = rows.select("doc_id", "held_out", F.when(learns, F.col("lang")).alias("lang"), _bit_scores(model)("text").alias("bits"))
    scored = materialize(scored, "language-bits")
    n_bits = model.code.shape[1]
    of = lambda f: F.array(*(F.round(f(F.get("bits", j)), 9) for j in range(n_bits)))
    told = scored.where("lang IS NOT NULL AND bits IS NOT NULL")
    moments = told.groupBy("lang").agg(of(F.avg).alias("mean"), of(F.var_pop).alias("var")).collect() if n_bits else []  # one row for each language
    found = scored.select("doc_id", "held_out", _decoded(calibrated(model, moments))("bits").alias("d"))
    return found.select(F.col("doc_id").alias(id_col), "held_out", "d.*")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
