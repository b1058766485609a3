"""Text functions on prompts, tags, names and captions: native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Model file endings, rating words and the quality ladder.
MODEL_ENDINGS = r"(?i)\.(safetensors|ckpt|pt|pth|bin|onnx|gguf)$"
QUALITY = ((7, "masterpiece, best quality"), (6, "best quality"), (5, "good quality"), (4, ""), (3, "low quality"))
#: What ends or is a trait of each family, and what only looks like one.
NO_TRAITS = (
    "adjusting hair", "hand in hair", "hand in own hair", "playing with own hair", "wet hair", "hair ornament", "hair flower", "hair ribbon", "hair bow", "hair bobbles",
    "hairband", "hairclip", "hair tie", "hair scrunchie", "closed eyes", "half-closed eyes", "rolling eyes", "crossed eyes", "shiny skin",
)
HAIR = (
    "twintails", "ponytail", "braid", "ahoge", "bangs", "blunt bangs", "parted bangs", "swept bangs", "asymmetrical bangs", "hair between eyes", "hair over one eye",
    "hair intakes", "sidelocks", "hime cut", "bob cut", "pixie cut", "hair bun", "double bun", "single hair bun", "low twintails", "short twintails", "side ponytail",
    "high ponytail", "low ponytail", "braided ponytail", "twin braids", "side braid", "single braid", "french braid", "crown braid", "half updo", "hair flaps",
)
EYES = ("heterochromia", "tsurime", "tareme", "long eyelashes", "thick eyebrows")
SKIN = ("dark-skinned female", "dark-skinned male", "tan", "tanlines")
BODY = (
    "flat chest", "small breasts", "medium breasts", "large breasts", "huge breasts", "gigantic breasts", "animal ears", "animal ear fluff", "tail", "horns", "halo", "fang",
    "fangs", "skin fang", "mole", "freckles", "scar", "muscular", "muscular female", "muscular male", "abs", "thick thighs", "wide hips", "petite", "elf", "dark elf",
    "forehead", "wings",
)
BODY_ENDS = r" (ears|tail|horns|horn|wings)$"
BODY_STARTS = r"^(mole|scar) "


def folded(c: Column) -> Column:
    """Lower case, underscores as spaces."""
    return F.translate(F.lower(c), "_", " ")


def python_token(token: str) -> str:
    """``normalize_token`` of a constant."""
    return token.lower().replace("_", " ").strip()


def normalize_token(c: Column) -> Column:
    return F.trim(folded(c))


def prompt_tokens(c: Column) -> Column:
    """Distinct tokens of a prompt in order: angle-bracket tags dropped, split at commas, brackets
    and weights stripped, single letters dropped. A null prompt has none."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^<>]*>", "")
    bare = lambda t: normalize_token(F.regexp_replace(F.regexp_replace(F.trim(t), r"^[(\[{\s]+|[)\]}\s]+$", ""), r":\s*-?[0-9]+(\.[0-9]+)?$", ""))
    return F.array_distinct(F.filter(F.transform(F.split(plain, ","), bare), lambda t: F.char_length(t) > 1))


def lora_name(c: Column) -> Column:
    """The name without numeric weight, folders and model ending, in lower case."""
    name = F.regexp_replace(F.trim(c), r":-?[0-9]+(\.[0-9]+)?$", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), MODEL_ENDINGS, "")))


def lora_names(prompt: Column) -> Column:
    """Names in ``<lora:name:weight>`` tags of a prompt, each once, longer than two letters."""
    found = F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit(r"<lora:([^:>]+)"), 1)
    return F.array_distinct(F.filter(F.transform(found, lora_name), lambda n: F.char_length(n) > 2))


def checkpoint_name(c: Column) -> Column:
    """Basename without a `` [hash]`` and the model ending; runs of spaces become one."""
    name = F.regexp_replace(F.regexp_replace(F.trim(c), r"^.*[/\\]", ""), r"\s*\[[0-9A-Fa-f]+\]$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(name, MODEL_ENDINGS, ""), r"\s+", " "))


def checkpoint_key(name: str) -> str:
    """Identity key of a constant checkpoint name."""
    name = re.sub(r"\s*\[[0-9A-Fa-f]+\]$", "", re.sub(r"^.*[/\\]", "", name.strip()))
    return re.sub(r"\s+", " ", re.sub(MODEL_ENDINGS, "", name)).strip().lower()


def path_key(c: Column) -> Column:
    """One spelling of a path: forward slashes, drive letters as mounts, no slash at the end."""
    slashed = F.regexp_replace(F.translate(F.trim(c), "\\", "/"), r"/+", "/")
    drive = F.regexp_extract(slashed, r"^([A-Za-z]):/", 1)
    mounted = F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.substring(slashed, F.lit(3), F.char_length(slashed)))).otherwise(slashed)
    return F.when(mounted == "/", mounted).otherwise(F.regexp_replace(mounted, r"/$", ""))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"/[^/]*$", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def trait_family(tag: Column) -> Column:
    """hair, eyes, skin or body of a tag of a lasting trait, else null."""
    t = normalize_token(tag)
    return (
        F.when(t.isin(*NO_TRAITS), F.lit(None).cast("string"))
        .when(t.endswith(" hair") | t.isin(*HAIR), "hair")
        .when(t.endswith(" eyes") | t.endswith(" pupils") | t.isin(*EYES), "eyes")
        .when(t.endswith(" skin") | t.isin(*SKIN), "skin")
        .when(t.isin(*BODY) | t.rlike(BODY_ENDS) | t.rlike(BODY_STARTS), "body")
    )


def quality_word(score: Column) -> Column:
    """The quality bucket of an aesthetic score; null of a null score."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, word in QUALITY:
        out = out.when(score >= least, word)
    return out.otherwise("worst quality")


def underscored(tag: Column) -> Column:
    """Underscores as spaces, but for ``score_`` prefixes and emoticons (no two letters in a row)."""
    return F.when(tag.startswith("score_") | ~tag.rlike("[A-Za-z]{2}"), tag).otherwise(F.translate(tag, "_", " "))


def word_line(text: Column) -> Column:
    """The words of a text, each between single spaces, underscores counted as spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def holds_term(line: Column, term: Column) -> Column:
    """Whether a term stands in a ``word_line`` on word borders."""
    return line.contains(word_line(term))


def processed_tags(tags: Column, blacklist=(), replace: dict | None = None, limit: int | None = None, append=()) -> Column:
    """Blacklist, replace, blacklist again, cut to ``limit``, append; tags are distinct."""
    banned = F.array(*map(F.lit, sorted({python_token(t) for t in blacklist}))).cast("array<string>")
    allowed = lambda a: F.filter(a, lambda t: ~F.array_contains(banned, normalize_token(t)))

    def swap(t):
        out = F.when(F.lit(False), t)
        for old, new in (replace or {}).items():
            out = out.when(normalize_token(t) == python_token(old), F.lit(new))
        return out.otherwise(t)

    out = F.array_distinct(allowed(F.transform(allowed(tags), swap)))
    out = F.slice(out, 1, limit) if limit else out
    return F.array_union(out, F.array(*map(F.lit, append)).cast("array<string>"))


def caption(trigger: str, tags: Column, prose: Column) -> Column:
    """The trigger word (once), the tags, then the prose as a sentence of its own."""
    words = F.array_distinct(F.concat(F.array(F.lit(trigger)), tags))
    listed = F.array_join(words, ", ")
    said = one_line(F.coalesce(prose, F.lit("")))
    return F.when(said == "", listed).otherwise(F.concat(listed, F.lit(". "), said))


def parameter(text: Column, name: str) -> Column:
    """``name: value`` in a generation parameter text; values may be quoted."""
    quoted = F.regexp_extract(text, rf'(?:^|[,\n]\s*){re.escape(name)}:\s*"([^"]*)"', 1)
    plain = F.regexp_extract(text, rf"(?:^|[,\n]\s*){re.escape(name)}:\s*([^,\n\"]+)", 1)
    return F.when(quoted != "", quoted).when(plain != "", F.trim(plain))
