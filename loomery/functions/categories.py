"""Tag categories: an ordered ladder of short rules, after the vocabularies that a user hands in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ladder, in this order. A rule holds if the tag (lower case, underscores) is one of
#: the words (``is``), starts or ends with one, has one as a token between underscores, or holds one.
LADDER = (
    ("rating", "is", ("general", "sensitive", "questionable", "explicit", "safe", "nsfw", "sfw")),
    ("rating", "starts", ("rating:",)),
    ("quality", "starts", ("score:", "score_")),
    ("quality", "is", (
        "masterpiece", "best_quality", "high_quality", "very_aesthetic", "amazing_quality", "absurdres", "highres", "incredibly_absurdres", "newest", "year_2024", "year_2025",
        "year_2026", "very_awa", "huge_filesize", "ultra-detailed", "high_resolution", "bad_anatomy",
    )),
    ("character", "is", (
        "1girl", "2girls", "3girls", "4girls", "5girls", "6+girls", "multiple_girls", "1boy", "2boys", "3boys", "4boys", "5boys", "6+boys", "multiple_boys", "solo", "duo", "trio",
        "group", "crowd", "1other", "androgynous", "male_focus", "female_focus",
    )),
    ("character", "matches", (r"^\d+\+?(girls|boys|others)$|^multiple_(.*_)?(girls|boys|others)(_|$)",)),
    ("meta", "is", (
        "comic", "4koma", "multiple_views", "tall_image", "wide_image", "portrait", "landscape", "signature", "artist_name", "twitter_username", "pixiv_username", "watermark",
        "username", "web_address", "url", "english_text", "japanese_text", "chinese_text", "korean_text", "text_focus", "speech_bubble", "thought_bubble", "spoken_heart",
        "spoken_ellipsis", "character_name", "copyright_name", "dated", "commission", "character_sheet", "reference_sheet", "concept_art", "check_translation", "translated",
        "partially_translated", "commentary", "commentary_request", "paid_reward_available", "cover", "cover_page", "novel_cover", "album_cover", "silent_comic", "too_many",
        "company_name", "circle_name", "content_rating", "roman_numeral", "bad_end", "tally", "take_your_pick", "side-by-side", "trefoil",
    )),
    ("angle", "is", (
        "from_above", "from_below", "from_side", "from_behind", "dutch_angle", "pov", "first-person_view", "close-up", "upper_body", "lower_body", "full_body", "cowboy_shot",
        "medium_shot", "bird's-eye_view", "worm's-eye_view", "dynamic_angle", "foreshortening", "fisheye", "face_focus", "ass_focus", "breast_focus", "feet_focus", "navel_focus",
        "hand_focus", "profile", "back", "pantyshot",
    )),
    ("artist", "starts", ("artist:", "artist_", "@")),
    ("meta", "matches", (r"^(year|era)_\d{4}$|^(18|19|20)\d{2}$|^\d+koma$",)),
    ("meta", "token", ("year", "version", "resolution", "filesize", "ratio")),
    ("angle", "ends", ("_focus", "_view", "_shot")),
    ("angle", "starts", ("from_", "pov_")),
    ("angle", "is", ("straight-on", "straight_on")),
    ("background", "ends", ("_background",)),
    ("style", "ends", ("style", "_(medium)", "_coloring")),
    ("style", "holds", ("lineart", "render", "style_parody")),
    ("expression", "matches", (r"^(\?|\.\.\.|:[a-z<>()]+|[^a-z0-9]+)$",)),
    ("expression", "token", ("smile", "blush", "wink", "grin", "laughing", "crying", "expressionless", "seductive", "embarrassed", "surprised", "mouth", "looking")),
    ("pose", "token", (
        "standing", "sitting", "kneeling", "lying", "leaning", "pose", "stretching", "jumping", "walking", "running", "hugging", "dancing", "squatting", "crouching", "floating",
        "tilt", "bent", "crossed",
    )),
    ("pose", "starts", ("hand_on_", "hands_on_", "own_hands_", "clenched_hand", "facing_")),
    ("pose", "ends", ("_pull", "_raised", "_v")),
    ("background", "token", (
        "outdoors", "indoors", "beach", "ocean", "sea", "sky", "forest", "night", "day", "sunset", "sunrise", "room", "bedroom", "bathroom", "classroom", "city", "street", "park",
        "garden", "field", "building", "tree", "road", "wall", "scenery", "nature",
    )),
    ("body", "token", (
        "hair", "eyes", "breasts", "chest", "thighs", "legs", "skin", "ears", "tail", "tails", "wings", "horns", "horn", "halo", "fangs", "teeth", "navel", "belly", "feet",
        "armpits", "eyebrows", "pupils", "sclera", "nose", "claws", "feathers", "beard", "bangs",
    )),
    ("body", "ends", ("_twintails", "_drills", "_tail", "_eye")),
    ("action", "token", ("holding", "grabbing", "touching", "kissing", "licking", "biting", "reading", "writing", "drinking", "eating", "swimming", "kiss")),
    ("outfit", "ends", ("_print", "_trim")),
    ("outfit", "holds", (
        "dress", "skirt", "shirt", "jacket", "coat", "uniform", "kimono", "swimsuit", "bikini", "gloves", "boots", "shoes", "socks", "thighhighs", "pantyhose", "ribbon", "necktie",
        "scarf", "armor", "hoodie", "sweater",
    )),
    ("character", "matches", (r"(girl|boy|woman|man|male|female)s?$",)),
    ("meta", "starts", ("no_", "non-")),
    ("meta", "ends", ("_request",)),
)


def _holds(t: Column, kind: str, words: tuple[str, ...]) -> Column:
    if kind == "is":
        return t.isin(*words)
    if kind == "token":
        return F.arrays_overlap(F.split(t, r"[_\-\s]+"), F.array(*map(F.lit, words)))
    test = {"starts": t.startswith, "ends": t.endswith, "holds": t.contains, "matches": t.rlike}[kind]
    out = F.lit(False)
    for w in words:
        out = out | test(w)
    return out


def _key(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), " ", "_")


def by_words(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct ``tags`` (column ``tag``) with the ``word`` of the ``vocabulary`` (``word``, ``category``) that tells
    their category, and that ``category``: the whole tag, else the longest run of its last words that is
    in the vocabulary (what a tag is), else the longest run of its first words; null without any.

    A tag has as many runs as it has words twice over; they are joined by value, so the vocabulary
    may be of any size. Of several rows for a word the least category counts. Case, and blanks for
    underscores, don't matter; null tags are left out.
    """
    known = vocabulary.where("word IS NOT NULL AND category IS NOT NULL").groupBy(_key(F.col("word")).alias("word")).agg(F.min("category").alias("category"))
    every = tags.where("tag IS NOT NULL").select("tag").distinct().withColumn("words", F.filter(F.split(_key(F.col("tag")), "_+"), lambda w: w != ""))
    every = every.withColumn("n", F.size("words"))
    run = lambda at, k, turn: F.struct(F.array_join(F.slice(F.col("words"), at, k), "_").alias("word"), turn.alias("turn"))
    lengths = F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)))
    last = F.transform(lengths, lambda k: run(F.col("n") - k + 1, k, F.col("n") - k))
    first = F.transform(F.filter(lengths, lambda k: k < F.col("n")), lambda k: run(F.lit(1), k, 2 * F.col("n") - k))
    runs = every.where("n > 0").select("tag", F.explode(F.concat(last, first)).alias("r")).select("tag", "r.word", "r.turn")
    best = runs.join(known, "word").groupBy("tag").agg(F.min_by(F.struct("word", "category"), "turn").alias("b"))
    return every.select("tag").join(best, "tag", "left").select("tag", "b.word", "b.category")


def by_rule(tag: Column) -> Column:
    """The category of the first rule of the ladder that holds; unknown without any, null of null."""
    t = F.translate(F.lower(F.trim(tag)), " ", "_")
    out = F.when(t.isNull(), F.lit(None).cast("string"))
    for category, kind, words in LADDER:
        out = out.when(_holds(t, kind, words), category)
    return out.otherwise("unknown")


def categorized(tags: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``tags`` (column ``tag``) with their ``category``: what the ``vocabulary`` (``tag``, ``category``)
    says, else the ladder. The vocabulary is joined by value, so it may be of any size; of several
    rows for a tag the least category counts."""
    rule = by_rule(F.col("tag"))
    if vocabulary is None:
        return tags.withColumn("category", rule)
    known = vocabulary.groupBy(F.translate(F.lower(F.trim("tag")), " ", "_").alias("__key")).agg(F.min("category").alias("__known"))
    joined = tags.withColumn("__key", F.translate(F.lower(F.trim("tag")), " ", "_")).join(known, "__key", "left")
    return joined.withColumn("category", F.coalesce("__known", rule)).drop("__key", "__known")


def in_turn(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct ``tags`` (column ``tag``) with their ``category`` and what told it (``by``): the whole tag in the
    ``vocabulary`` (``word``, ``category``), else the first rule of the ladder that holds, else the longest run
    of its words in the vocabulary, else unknown. Null tags are left out."""
    found = by_words(tags, vocabulary)
    whole = F.coalesce(F.col("word") == F.array_join(F.filter(F.split(_key(F.col("tag")), "_+"), lambda w: w != ""), "_"), F.lit(False))

    def settled(rule: Column) -> Column:
        ruled, run = rule != "unknown", F.col("category").isNotNull()
        told = F.when(whole, "word").when(ruled, "rule").when(run, "words").otherwise("none")
        category = F.when(~whole & ruled, rule).when(run, F.col("category")).otherwise("unknown")
        return F.struct(category.alias("category"), told.alias("by"))

    # The rules are asked once for a tag: what follows from them is a row of its own.
    return found.select("tag", F.inline(F.transform(F.array(by_rule(F.col("tag"))), settled)))
