"""Library upkeep: lookups, imports, reconnection, workspaces, revisions, collections and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.functions import text

#: Seconds that a file's time may be off and still be the same.
TIME_TOLERANCE = 2
#: Most ids in a list where lists meet lists, and the tasks over which their pairs are dealt.
LIST, TASKS = 256, 96


def by_path(items: DataFrame, path: str) -> DataFrame:
    """Items of a path in any spelling of it."""
    return items.where(text.path_key(F.col("path")) == text.path_key(F.lit(path)))


def _id_lists(rows: DataFrame, name: str) -> DataFrame:
    """The ids of each stem and ending in lists of at most ``LIST``; null ids too."""
    part = F.floor((F.row_number().over(Window.partitionBy("stem", "ending").orderBy("id")) - 1) / LIST)
    nulls = F.array_repeat(F.lit(None).cast(rows.schema["id"].dataType), F.count_if(F.col("id").isNull()).cast("int"))
    return rows.withColumn("part", part).groupBy("stem", "ending", "part").agg(F.concat(F.collect_list("id"), nulls).alias(name)).drop("part")


def variant_pairs(items: DataFrame, suffix: str) -> DataFrame:
    """Each item whose stem lacks ``suffix`` with the items of the same folder, stem and ending that
    have it (``other``); null where there is none.

    Lists of ids meet, and their pairs are dealt over tasks before they are made, so that the pairs of
    a crowded path aren't one task's work and a row holds those of two lists at most."""
    stem, ending = F.regexp_replace("path", r"\.[^./]*$", ""), F.regexp_extract("path", r"(\.[^./]*)$", 1)
    rows = items.select("id", stem.alias("stem"), ending.alias("ending"))
    marked = F.col("stem").endswith(suffix)
    plain = F.expr(f"substring(stem, 1, length(stem) - {len(suffix)})")
    others = _id_lists(rows.where(marked).select("id", plain.alias("stem"), "ending"), "others")
    met = _id_lists(rows.where(~marked), "ids").join(others, ["stem", "ending"], "left").repartition(TASKS)
    return met.select("stem", "ending", F.explode("ids").alias("id"), "others").select("stem", "ending", "id", F.explode_outer("others").alias("other"))


def tags_of(tags: DataFrame, item: int) -> DataFrame:
    """An item's tags, the most confident first; ties by tag."""
    return tags.where(F.col("item_id") == item).orderBy(F.desc("confidence"), "tag")


def import_tags(index: DataFrame, tags: DataFrame, incoming: DataFrame, overwrite: bool = False) -> DataFrame:
    """``tags`` with those of ``incoming`` (``path``, ``tag``, ``confidence``) for the items that it
    names by path, or else by a file name that only one item has. Items that have tags are left out
    unless ``overwrite``, which replaces theirs."""
    name = F.regexp_replace("path", r"^.*/", "")
    wanted = incoming.select("path").distinct()
    exact = wanted.join(index.select("path", F.col("id").alias("item_id")), "path")
    single = index.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("item_id")).where("n = 1")
    rest = wanted.join(exact.select("path"), "path", "left_anti").withColumn("name", name).join(single, "name")
    found = exact.select("path", "item_id").unionByName(rest.select("path", "item_id"))
    if not overwrite:
        found = found.join(tags.select("item_id").distinct(), "item_id", "left_anti")
    fresh = incoming.join(found, "path").groupBy("item_id", F.lower("tag").alias("low")).agg(F.max_by("tag", F.struct("confidence", "tag")).alias("tag"), F.max("confidence").alias("confidence"))
    kept = tags.join(fresh.select("item_id").distinct(), "item_id", "left_anti") if overwrite else tags
    return kept.select("item_id", "tag", "confidence").unionByName(fresh.select("item_id", "tag", "confidence"))


def replace_rows(tags: DataFrame, fresh: DataFrame, scope: str = "pipeline") -> DataFrame:
    """``tags`` with the rows of the items of ``fresh`` replaced: all of them, or (``pipeline``) all
    but the manual ones. One row stays for each item and tag without regard to case: a manual one
    first, then the most confident, then the least spelling."""
    ids = fresh.select("item_id").distinct()
    hit = tags.join(ids, "item_id", "left_semi")
    kept = hit.where("source = 'manual'") if scope == "pipeline" else hit.where("false")
    columns = ["item_id", "tag", "confidence", "source"]
    both = kept.select(*columns).unionByName(fresh.select(*columns))
    w = Window.partitionBy("item_id", F.lower("tag")).orderBy(F.col("source") != "manual", F.desc("confidence"), "tag")
    single = both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return tags.join(ids, "item_id", "left_anti").select(*columns).unionByName(single)


def sidecar_tags(captions: DataFrame) -> DataFrame:
    """Tags of captions (``id``, ``caption``), cut at lines and commas, in order (``pos`` from 0); the
    first spelling of each stays."""
    cut = captions.select("id", F.posexplode(F.transform(F.split(F.coalesce("caption", F.lit("")), "[,\n]"), lambda t: F.trim(t))).alias("at", "tag")).where("tag <> ''")
    first = cut.groupBy("id", F.lower("tag").alias("low")).agg(F.min(F.struct("at", "tag")).alias("f"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("f.at")) - 1
    return first.select("id", F.col("f.tag").alias("tag"), place.alias("pos"))


def mark_unreadable(items: DataFrame, failures: DataFrame) -> DataFrame:
    """``items`` with those of ``failures`` (``id``, ``error``) unreadable, their error kept and a pending
    status made an error."""
    joined = items.join(failures.select("id", "error"), "id", "left")
    failed = F.col("error").isNotNull()
    status = F.when(failed & (F.lower("metadata_status") == "pending"), "error").otherwise(F.col("metadata_status"))
    return joined.withColumn("is_readable", F.when(failed, 0).otherwise(F.col("is_readable"))).withColumn("metadata_status", status)


def rating_duplicates(tags: DataFrame, ratings: list[str]) -> DataFrame:
    """``tags`` with one rating row for each item: the most confident; ties go to the severest (the
    last of ``ratings``), then to the least position."""
    rank = F.array_position(F.array(*map(F.lit, ratings)), F.col("tag"))
    rated = F.col("tag").isin(*ratings)
    w = Window.partitionBy("item_id").orderBy(F.desc("confidence"), rank.desc(), "pos")
    best = tags.where(rated).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return tags.where(~rated).unionByName(best)


def reconnect(missing: DataFrame, found: DataFrame) -> DataFrame:
    """Files that were found (``path``, ``name``, ``size``, ``seconds``, ``fingerprint``) with the lost item
    (``id``, ``name``, ``size``, ``seconds``, ``fingerprint``) that each one is, and how it was told.

    Name and size must agree (an unknown size agrees with any); of such candidates the only one of
    the same time is it (``stat``); else the only one of the same fingerprint among those that have
    one (``fingerprint``); else the only one of neither time nor fingerprint (``name_size``). Several
    at a step are ``ambiguous``, and none at all ``none``. An item goes to the first path that takes
    it; later ones are ``used``.

    Nothing is paired: lost items are counted by what a step compares, and a file asks for those counts.
    """
    lost = missing.select("id", "name", F.col("size").alias("s"), F.col("seconds").alias("t"), F.col("fingerprint").alias("f"))
    asks = found.withColumn("s", F.explode(F.array_distinct(F.array(F.col("size"), F.lit(None)))))
    slot = lambda c: F.floor(F.col(c) / TIME_TOLERANCE)
    counted = lambda rows, *by: rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    meet = lambda x, y, *by: x.alias("x").join(y.alias("y"), [F.col("x.name") == F.col("y.name"), F.col("x.s").eqNullSafe(F.col("y.s")), *(F.col(f"x.{a}") == F.col(f"y.{b}") for a, b in by)])
    times = counted(lost.where("t IS NOT NULL"), "name", "s", "t").withColumn("slot", slot("t"))
    near = asks.withColumn("slot", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: slot("seconds") + k)))
    hits = {
        "stat": meet(near, times, ("slot", "slot")).where(F.abs(F.col("seconds") - F.col("t")) <= TIME_TOLERANCE),
        "fingerprint": meet(asks, counted(lost, "name", "s", "f"), ("fingerprint", "f")),  # where none is of the same time
        "name_size": meet(asks, counted(lost.where("t IS NULL AND f IS NULL AND id IS NOT NULL"), "name", "s")),
    }
    every = found.select("path", F.lit("").alias("step"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("id"))
    for k, rows in hits.items():
        every = every.union(rows.select("path", F.lit(k), "n", F.col("id").cast("long")))
    of = lambda k, c: F.when(F.col("step") == k, F.col(c))
    steps = every.groupBy("path").agg(*(F.coalesce(F.sum(of(k, "n")), F.lit(0)).alias(f"n_{k}") for k in hits), *(F.min(of(k, "id")).alias(k) for k in hits))
    how, which = F.when(F.lit(False), ""), F.when(F.lit(False), F.lit(0).cast("long"))
    for k in hits:
        how = how.when(F.col(f"n_{k}") == 1, k).when(F.col(f"n_{k}") > 1, "ambiguous")
        which = which.when(F.col(f"n_{k}") == 1, F.col(k)).when(F.col(f"n_{k}") > 1, F.lit(None).cast("long"))
    told = steps.select("path", how.otherwise("none").alias("how"), which.alias("id"))
    turn = F.row_number().over(Window.partitionBy("id", F.when(F.col("id").isNull(), F.col("path"))).orderBy("path"))  # files of no item don't meet
    return told.withColumn("turn", F.when(F.col("id").isNotNull(), turn)).select("path", F.when(F.col("turn") > 1, "used").otherwise(F.col("how")).alias("how"), F.when(F.coalesce(F.col("turn"), F.lit(1)) == 1, F.col("id")).alias("id"))


def resolve_folder(items: DataFrame, names: DataFrame) -> DataFrame:
    """Folders that hold dropped file names (``name``): how many of them each has, the most first."""
    held = items.select(text.folder_of(F.col("path")).alias("folder"), F.lower(F.regexp_replace("path", r"^.*/", "")).alias("name"))
    return held.join(names.select(F.lower("name").alias("name")).distinct(), "name", "left_semi").groupBy("folder").agg(F.count_distinct("name").alias("votes"))


def heads(revisions: DataFrame, after: int, limit: int) -> DataFrame:
    """A page of subjects over ``after`` with the content of their highest generation."""
    best = revisions.where(F.col("subject") > after).groupBy("subject").agg(F.max("generation").alias("generation"), F.max_by("content", "generation").alias("content"))
    return best.orderBy("subject").limit(limit)


def append_revisions(revisions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome of each new revision (``subject``, ``expected``, ``content``): ``appended`` with the next
    generation if the subject's head is still the expected one (0: none yet), else ``conflict``. Of
    several for a subject the least content is appended; the others conflict."""
    now = revisions.groupBy("subject").agg(F.max("generation").alias("head"))
    first = F.row_number().over(Window.partitionBy("subject").orderBy("content"))
    tried = incoming.join(now, "subject", "left").withColumn("head", F.coalesce("head", F.lit(0)))
    fits = F.col("head") == F.col("expected")
    tried = tried.withColumn("turn", F.when(fits, first))
    first_fit = F.min("turn").over(Window.partitionBy("subject"))
    ok = fits & (F.col("turn") == first_fit)
    return tried.select("subject", "content", F.when(F.coalesce(ok, F.lit(False)), "appended").otherwise("conflict").alias("state"), F.when(ok, F.col("head") + 1).alias("generation"))


def claim_paths(items: DataFrame, paths: DataFrame, library: str) -> DataFrame:
    """``items`` with those of ``paths`` moved to a library (``moved``: they weren't in it yet)."""
    wanted = paths.select(text.path_key(F.col("path")).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    joined = items.withColumn("__key", text.path_key(F.col("path"))).join(wanted, "__key", "left")
    moved = F.coalesce("__hit", F.lit(False)) & ~F.col("library_id").eqNullSafe(F.lit(library))
    return joined.withColumn("moved", moved).withColumn("library_id", F.when(F.col("moved"), F.lit(library)).otherwise(F.col("library_id"))).drop("__key", "__hit")


def membership(members: DataFrame, ids: DataFrame, collection: int, add: bool = True) -> DataFrame:
    """``members`` (``collection``, ``id``) with ``ids`` added to or removed from a collection, each once."""
    own = ids.select(F.lit(collection).cast("long").alias("collection"), "id").distinct()
    return members.union(own).distinct() if add else members.join(own, ["collection", "id"], "left_anti")


def _contains(part: str):
    return lambda t: t.contains(part)


def exclusion_targets(tags: DataFrame, rules: list[dict]) -> DataFrame:
    """Of each item the targets of the rules whose conditions all hold: ``present`` is a part of one of
    its tags, ``absent`` of none. Rules are a constant list (``conditions`` of (tag, kind), ``targets``)."""
    key = lambda t: t.lower().replace(" ", "_")
    held = tags.groupBy("item_id").agg(F.collect_set(F.translate(F.lower("tag"), " ", "_")).alias("t"))
    out = []
    for rule in rules:
        holds = F.lit(True)
        for tag, kind in rule["conditions"]:
            some = F.exists("t", _contains(key(tag)))
            holds = holds & (some if kind == "present" else ~some)
        out.append(F.when(holds, F.array(*(F.lit(key(t)) for t in rule["targets"]))).otherwise(F.array().cast("array<string>")))
    return held.select("item_id", F.explode(F.array_distinct(F.flatten(F.array(*out)))).alias("target"))


def with_overrides(counts: DataFrame, category: Column, overrides: DataFrame) -> DataFrame:
    """``category`` of each tag: the user's (``overrides``: ``tag``, ``category``) before the classifier's."""
    own = overrides.select(F.lower("tag").alias("__key"), F.col("category").alias("__own"))
    return counts.join(own, F.lower("tag") == F.col("__key"), "left").withColumn("category", F.coalesce("__own", category)).drop("__key", "__own")


def category_pools(counts: DataFrame, least: int, most: int) -> DataFrame:
    """The ``most`` frequent tags of each category that occur ``least`` times, with their place."""
    w = Window.partitionBy("category").orderBy(F.desc("n"), "tag")
    return counts.where(F.col("n") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def last_decisions(actions: DataFrame) -> DataFrame:
    """Each item's last decision (``id``, ``seq``, ``action``)."""
    return actions.groupBy("id").agg(F.max_by("action", "seq").alias("action"))


def suggestions(held: DataFrame, vocabulary: DataFrame, needle: str, limit: int) -> DataFrame:
    """Tags for a typed beginning: the library's by exact match, start, then part; then the
    vocabulary's in the same way. A tag stands once, in its first bucket; more frequent ones first."""
    q = needle.lower().replace("_", " ")

    def ranked(frame: DataFrame, base: int) -> DataFrame:
        t = text.normalize_token(F.col("tag"))
        rank = F.when(t == q, base).when(t.startswith(q), base + 1).when(t.contains(q), base + 2)
        return frame.select(t.alias("tag"), "n", rank.alias("bucket")).where("bucket IS NOT NULL")

    both = ranked(held, 0).unionByName(ranked(vocabulary, 3))
    best = both.groupBy("tag").agg(F.min(F.struct("bucket", (-F.col("n")).alias("minus"))).alias("b"))
    return best.select("tag", F.col("b.bucket").alias("bucket"), (-F.col("b.minus")).alias("n")).orderBy("bucket", F.desc("n"), "tag").limit(limit)


def newest_operations(journal: DataFrame, keep: int, most_items: int) -> DataFrame:
    """The ``keep`` newest operations (``op``, ``items``), and whether each can be undone: its journal
    holds at most ``most_items`` items."""
    return journal.orderBy(F.desc("op")).limit(keep).withColumn("can_undo", F.col("items") <= most_items)


def scan_guard(index: DataFrame, events: DataFrame) -> DataFrame:
    """``index`` (``path``, ``size``, ``status``) after scan events (``path``, ``moment``, ``kind``, ``size``): a pending
    placeholder never takes the new size, a finished parse does; the last finished one wins, and a
    path of placeholders alone keeps what it had. ``changed``: its derived data no longer hold."""
    done = events.where("kind = 'parsed'").groupBy("path").agg(F.max_by("size", "moment").alias("new_size"))
    waiting = events.groupBy("path").agg(F.max(F.when(F.col("kind") == "pending", F.col("moment"))).alias("p"), F.max(F.when(F.col("kind") == "parsed", F.col("moment"))).alias("d"))
    out = index.join(done, "path", "left").join(waiting, "path", "left")
    status = F.when(F.col("p").isNotNull() & (F.col("d").isNull() | (F.col("p") > F.col("d"))), "pending").when(F.col("d").isNotNull(), "complete").otherwise(F.col("status"))
    changed = F.coalesce(F.col("new_size") != F.col("size"), F.lit(False))
    return out.select("path", F.coalesce("new_size", "size").alias("size"), status.alias("status"), changed.alias("changed"))
