"""Dataset reports: vocabulary, consistency, co-occurrence, audits, leaks and implied tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.functions import text

#: Rating words, the mildest first.
RATINGS = ("general", "sensitive", "questionable", "explicit")


def vocabulary(docs: DataFrame, tokens: Column) -> DataFrame:
    """Documents that hold each token, and the least id of them as a sample."""
    return docs.select("doc_id", F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("sample"))


def co_occurrence(tags: DataFrame, least: float, least_count: int = 3, most: int = 150) -> DataFrame:
    """Pairs of frequent tags by Jaccard index. Only the ``most`` frequent tags are paired (the
    report's own bound), inside each item: its tags as one array, so pairs are few."""
    tags = tags.select("item_id", "tag").distinct()
    counts = tags.groupBy("tag").agg(F.count("item_id").alias("n")).where(F.col("n") >= least_count).orderBy(F.desc("n"), "tag").limit(most)
    held = tags.join(F.broadcast(counts.select("tag")), "tag").groupBy("item_id").agg(F.sort_array(F.collect_list("tag")).alias("t"))  # at most `most` tags are sent
    pairs = held.select(F.explode(F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    together = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("ab"))
    na, nb = counts.select(F.col("tag").alias("a"), F.col("n").alias("na")), counts.select(F.col("tag").alias("b"), F.col("n").alias("nb"))
    scored = together.join(F.broadcast(na), "a").join(F.broadcast(nb), "b")
    return scored.withColumn("jaccard", F.round(F.col("ab") / (F.col("na") + F.col("nb") - F.col("ab")), 6)).where(F.col("jaccard") >= least).select("a", "b", "ab", "jaccard")


def spelling_variants(tags: DataFrame) -> DataFrame:
    """Tags that differ only in case, underscores or spaces."""
    return tags.groupBy(text.normalize_token(F.col("tag")).alias("folded")).agg(F.count_distinct("tag").alias("spellings"), F.min("tag").alias("first"), F.count("*").alias("n")).where("spellings > 1")


def trait_candidates(tags: DataFrame, ratio: float) -> DataFrame:
    """Tags on at least ``ratio`` of all items (rounded half up), one vote of each item."""
    total = tags.agg(F.count_distinct("item_id").alias("total"))
    counts = tags.groupBy("tag").agg(F.count_distinct("item_id").alias("n"))
    return counts.join(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(1), F.floor(F.lit(ratio) * F.col("total") + 0.5))).select("tag", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


def flags(items: DataFrame, tags: DataFrame, low_score: float, least_side: int) -> DataFrame:
    """Audit flags of each item as one comma-joined string, in fixed order; items without any drop out."""
    tagged = tags.select(F.col("item_id").alias("id")).distinct().withColumn("has_tags", F.lit(True))
    small = (F.col("width") < least_side) | (F.col("height") < least_side)
    named = (("low_quality", F.col("aesthetic_score") < low_score), ("untagged", F.col("has_tags").isNull()), ("small", small), ("unreadable", F.coalesce("is_readable", F.lit(1)) == 0))
    out = F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named))), ",")
    return items.join(tagged, "id", "left").select("id", out.alias("flags")).where("flags <> ''")


def caption_codes(c: Column, trigger: str) -> Column:
    """Problems of a caption: empty, several lines, no trigger word, several rating words, and a
    bracket or parenthesis without its partner."""
    t = F.coalesce(c, F.lit(""))
    count = lambda ch: F.char_length(t) - F.char_length(F.replace(t, F.lit(ch), F.lit("")))
    ratings = F.size(F.array_distinct(F.filter(F.transform(F.split(F.lower(t), "[,\n]"), lambda w: F.trim(w)), lambda w: w.isin(*RATINGS))))
    named = (
        ("empty", F.trim(t) == ""), ("multiline", F.trim(t).contains("\n")), ("missing_trigger", ~F.lower(t).contains(trigger.lower())),
        ("conflicting_rating", ratings > 1), ("unpaired", (count("(") != count(")")) | (count("[") != count("]"))),
    )
    return F.array_compact(F.array(*(F.when(x, F.lit(n)) for n, x in named)))


def validation(rows: DataFrame, caption: str, trigger: str) -> DataFrame:
    """Captions with each problem, and the three least ids that have it as examples (Spark cuts them
    to three in each task before they meet)."""
    found = rows.select("id", F.explode(caption_codes(F.col(caption), trigger)).alias("code"))
    first = lambda i: F.min(F.when(F.col("place") == i, F.col("id")))
    w = Window.partitionBy("code").orderBy("id")
    counts = found.groupBy("code").agg(F.count("*").alias("n"))
    least = found.withColumn("place", F.row_number().over(w)).where("place <= 3")
    examples = least.groupBy("code").agg(F.concat_ws(",", *(first(k).cast("string") for k in (1, 2, 3))).alias("examples"))
    return counts.join(examples, "code")


def leaks(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with each black-listed term on word borders; the terms are a constant of the plan.
    A text is brought to words once, for all terms."""
    hits = F.filter(F.array(*map(F.lit, terms)), lambda t: text.holds_term(F.col("line"), t))
    return docs.select("doc_id", text.word_line(F.col("text")).alias("line")).select("doc_id", F.explode(hits).alias("term"))


def closure(edges: DataFrame, max_rounds: int = 20) -> DataFrame:
    """All ancestors of each child of ``child``-``parent`` edges, by doubling; loops are dropped.
    Rounds are cut by ``checkpoint``, so ``spark.checkpoint.dir`` must be set. Chains of over
    2 ** ``max_rounds`` edges are an error, never a part of the result."""
    now = edges.where("child <> parent").select("child", "parent").distinct()
    n = now.count()
    for _ in range(max_rounds):
        step = now.alias("x").join(now.alias("y"), F.col("x.parent") == F.col("y.child")).select(F.col("x.child").alias("child"), F.col("y.parent").alias("parent"))
        now = now.union(step.where("child <> parent")).distinct().checkpoint()
        if (after := now.count()) == n:
            return now
        n = after
    raise RuntimeError("the closure did not settle")


def without_implied(tags: DataFrame, implied: DataFrame) -> DataFrame:
    """Tags less those that another tag of the same item implies (``implied`` is a closure)."""
    covered = tags.join(implied, tags["tag"] == implied["child"]).select("item_id", F.col("parent").alias("tag")).distinct()
    return tags.join(covered, ["item_id", "tag"], "left_anti")


def buckets(resolution: int = 1024, step: int = 64, least: int = 512, most: int = 2048) -> list[tuple[int, int]]:
    """Training sizes on a grid whose area is at most that of the resolution's square, widest last."""
    area = resolution * resolution
    return [(w, h) for w in range(least, most + 1, step) if (h := min(most, area // w // step * step)) >= least]


def bucket_plan(items: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """The bucket nearest in aspect to each item, by exact cross-multiplication; ties go to the first."""
    options = F.array(*(F.struct((F.abs(F.col("width") * h - F.col("height") * w) / F.lit(h)).alias("d"), F.lit(k).alias("k"), F.lit(w).alias("w"), F.lit(h).alias("h")) for k, (w, h) in enumerate(sizes)))
    best = F.array_min(options)
    return items.select("id", best["w"].alias("bucket_width"), best["h"].alias("bucket_height"))


def manifest(rows: DataFrame) -> DataFrame:
    """Counts, and the sums of the two halves of each row's MD5 digest over id, path and size: one
    fingerprint of all rows, whatever their order."""
    own = F.md5(F.concat_ws("|", F.col("id").cast("string"), "path", F.col("file_size").cast("string")))
    half = lambda k: F.sum(F.conv(F.substring(own, k, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("prompt", F.lit(""))) == "").alias("empty"), F.sum("file_size").alias("bytes"), F.concat_ws("-", half(1), half(13)).alias("digest"))


def verify(manifest_rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Differences of a manifest and a listing (both ``path``, ``size``): missing, unexpected, size."""
    both = manifest_rows.select("path", F.col("size").alias("expected")).join(listing.select("path", F.col("size").alias("observed")), "path", "full_outer")
    code = F.when(F.col("observed").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") != F.col("observed"), "size")
    return both.withColumn("code", code).where("code IS NOT NULL")
