"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each text: its measurements are stored, and one bit is set in
``failed`` for each rule that it breaks. A policy is a versioned mask of the bits that reject;
policies and ablations work on the stored bits and never read the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The white space between words, and the symbols that are counted.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger: set where ``fails`` (SQL over the measurements) is true."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_phrases", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "n_words > 0 AND 10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "n_lines > 0 AND 2 * n_dup_lines > n_lines"),
    Rule("short_words", 4, "n_words > 0 AND word_chars < 2 * n_words"),
    Rule("long_words", 5, "n_words > 0 AND word_chars > 15 * n_words"),
)
BASE_RULES = ("few_words", "repeated_phrases")

#: Versioned policies: the rules whose failure rejects a text.
POLICIES = {
    "v1": BASE_RULES,
    "v2": tuple(r.name for r in RULES),
}


def mask(names) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def measurements(text: Column) -> list[tuple[str, dict[str, Column]]]:
    """Columns to add one step after the other; the last step has the measurements.

    Repeated words: the hash of each window of three words is sorted together with its place, so
    that equal windows always stand side by side; the places of windows that have an equal
    neighbour cover three words each. Sorting takes plain longs of 40 leading bits of hash over 24
    bits of place; where two windows share those bits and differ, or the places need more bits,
    structs of the whole hash and the place are sorted in the same way.
    """
    at = lambda i: F.element_at(F.col("__w"), i)
    pick = lambda a, i: F.get(F.col(a), i)
    low = (1 << 24) - 1
    lead = lambda x: F.shiftright(x, 24)
    spot = lambda x: x.bitwiseAND(F.lit(low).cast("long")).cast("int")
    equal = lambda k, j: lead(pick("__s", k)) == lead(pick("__s", j))
    clash = F.exists(F.sequence(F.lit(1), F.size("__s") - 1), lambda k: equal(k, k - 1) & (pick("__h", spot(pick("__s", k))) != pick("__h", spot(pick("__s", k - 1)))))
    whole = F.sort_array(F.transform(F.col("__h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, k: ((k > 0) & F.coalesce(pick(a, k - 1)["h"] == pick(a, k)["h"], F.lit(False))) | F.coalesce(pick(a, k + 1)["h"] == pick(a, k)["h"], F.lit(False))
    beside = lambda k: ((k > 0) & F.coalesce(equal(k, k - 1), F.lit(False))) | F.coalesce(equal(k, k + 1), F.lit(False))
    by_lead = F.transform(F.filter(F.col("__s"), lambda x, k: beside(k)), spot)
    by_hash = F.transform(F.filter(F.col("__x"), lambda x, k: same("__x", k)), lambda x: x["i"])
    none = F.array().cast("array<bigint>")
    return [
        ("words", {"__t": F.coalesce(text, F.lit(""))}),
        ("split", {"__w": _words(F.col("__t")), "__l": F.filter(F.split(F.col("__t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))}),
        ("counts", {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.char_length(F.translate(F.col("__t"), SPACE, "")).cast("long"),
            "n_symbols": (F.char_length(F.col("__t")) - F.char_length(F.translate(F.col("__t"), SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "__h": F.when(F.size("__w") < 3, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - 2, F.lit(1))), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))),
        }),
        ("sorted", {"__s": F.when(F.size("__h") <= low, F.sort_array(F.transform(F.col("__h"), lambda h, i: h.bitwiseAND(F.lit(~low).cast("long")).bitwiseOR(i.cast("long"))))).otherwise(none)}),
        ("whole", {"__x": F.when((F.size("__h") > low) | ((F.size("__s") > 1) & clash), whole)}),
        ("found", {"__p": F.sort_array(F.when(F.col("__x").isNull(), by_lead).otherwise(by_hash))}),
        ("done", {"n_repeat_words": F.when(F.size("__p") == 0, F.lit(0).cast("long")).otherwise(
            F.aggregate(F.transform(F.col("__p"), lambda p, i: F.coalesce(F.least(F.get(F.col("__p"), i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x))}),
    ]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (under the struct ``row``), the measurements, and the failure bits
    ``failed`` (long) of every row.

    A null text has no words: only ``few_words`` fails. Repeated rows each have an entry; columns
    of any other name cannot clash, as the row is carried as a struct. An empty table gives an
    empty ledger. Filters on the ledger stay above it, as no filter passes a generated row: pushed
    into the measurements, one would repeat them all in its condition.
    """
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(text_col).alias("__text"))
    for _, columns in measurements(F.col("__text")):
        out = out.select(*(c for c in out.columns if c != "__text"), *(e.alias(n) for n, e in columns.items()))
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    entry = F.struct("row", *MEASURES, failed.cast("long").alias("failed"))
    return out.select(F.explode(F.array(entry)).alias("entry")).select("entry.*")


def stored(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ledger, written once: policies and ablations read its bits and never a text."""
    return materialize(ledger(docs, keep, text_col), "quality-ledger")


def apply_policy(entries: DataFrame, version: str = "v2") -> DataFrame:
    """``entries`` with ``kept``: no rule of the policy fails."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(entries: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail nothing else (kept if it were
    dropped), and over all rows the union of bits, from the stored bits alone."""
    whole = mask(POLICIES[version])
    failed = F.col("failed").bitwiseAND(F.lit(whole))
    patterns = entries.groupBy(failed.alias("pattern")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[version]]
    rows = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules))).alias("r")
    spread = patterns.select("pattern", "n", rows).select("pattern", "n", "r.rule", "r.bit")
    return spread.groupBy("rule").agg(
        F.sum(F.when(F.col("pattern").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("pattern") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.bit_or("pattern").alias("seen"),
    )


def keep_good(docs: DataFrame, version: str = "v2", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the policy rejects; all columns stay as they are.

    Null and empty texts have no words and are rejected (few words). Rows are judged one by one, so
    repeated rows stay or go together; an empty table gives an empty result.
    """
    return apply_policy(stored(docs, docs.columns, text_col), version).where("kept").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    entries = apply_policy(stored(docs, ["doc_id"]))
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE_RULES))) != 0
    return entries.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "n_lines", "failed")
