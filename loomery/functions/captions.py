"""Caption functions: rating and noise words, templates, transforms, names and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_token, one_line, underscored

#: Words and patterns that a caption never needs.
NOISE = ("masterpiece", "best quality", "high quality", "normal quality", "low quality", "worst quality", "highres", "absurdres", "safe", "sensitive", "nsfw", "explicit", "newest", "recent", "oldest")
SCORE_WORD, YEAR_WORD = r"^score[ _]\d+(_up)?$", r"^(?:year\s*)?\d{4}$"
#: Spellings of ratings.
RATING_WORDS = {"g": "general", "general": "general", "safe": "general", "s": "sensitive", "sensitive": "sensitive", "q": "questionable", "questionable": "questionable", "e": "explicit", "explicit": "explicit"}
#: Orientations of a picture that lies on its side, and the end of a list of phrases.
TURNED, MOST_PHRASES = (5, 6, 7, 8), 80


def rating_word(c: Column) -> Column:
    """The rating that a word spells, after an optional ``rating:``; null if none."""
    t = F.regexp_replace(normalize_token(c), r"^rating:\s*", "")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for word, name in RATING_WORDS.items():
        out = out.when(t == word, F.lit(name))
    return out


def is_noise(c: Column) -> Column:
    """Whether a tag tells nothing: blank, a quality, safety or time word, a score or a year."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (t == "") | F.translate(t, "_", " ").isin(*NOISE) | t.rlike(SCORE_WORD) | t.rlike(YEAR_WORD)


def without_noise(tags: Column) -> Column:
    """``kept`` tags and how many were ``stripped``."""
    kept = F.filter(tags, lambda t: ~is_noise(t))
    return F.struct(kept.alias("kept"), (F.size(tags) - F.size(kept)).alias("stripped"))


def transformed(caption: Column, remove=(), prepend=(), append=()) -> Column:
    """A comma-separated caption less some tokens, with others before and after it; each token once."""
    tokens = F.filter(F.transform(F.split(F.coalesce(caption, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    gone = [r.lower().replace("_", " ").strip() for r in remove]
    kept = F.filter(tokens, lambda t: ~normalize_token(t).isin(*gone)) if gone else tokens
    strings = lambda words: F.array(*map(F.lit, words)).cast("array<string>")
    every = F.concat(strings(prepend), kept, strings(append))
    first = lambda t, i: ~F.exists(F.slice(every, 1, i), lambda u: normalize_token(u) == normalize_token(t))
    return F.array_join(F.filter(every, first), ", ")


def with_prose(tags: Column, kind: str, prose: Column) -> Column:
    """Tags, prose (``nl``; the tags where there is none) or ``both``, the prose on one line."""
    listed, said = F.trim(F.coalesce(tags, F.lit(""))), one_line(F.coalesce(prose, F.lit("")))
    if kind == "nl":
        return F.when(said == "", listed).otherwise(said)
    return F.concat_ws(", ", F.when(listed != "", listed), F.when(said != "", said)) if kind == "both" else tags


def rendered(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` of a constant template replaced by columns (a null is empty); blank parts between
    commas drop out, and runs of spaces become one."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(values[name].cast("string"), F.lit("")) if name in values else F.lit("")]
    whole = F.concat(*parts, F.lit(rest))
    kept = F.filter(F.transform(F.split(whole, ","), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return F.array_join(kept, ", ")


def suppression(traits: Column) -> Column:
    """A sentence that bans up to 80 distinct phrases; empty without any."""
    phrases = F.array_distinct(F.filter(F.transform(traits, normalize_token), lambda t: t != ""))
    listed = F.array_join(F.slice(phrases, 1, MOST_PHRASES), ", ")
    return F.when(F.size(phrases) == 0, "").otherwise(F.concat(F.lit("Never mention: "), listed, F.lit(".")))


def file_stem(pattern: str, values: dict[str, Column], index: Column) -> Column:
    """A file name from a pattern of ``{name}`` and ``{index:04}``; unsafe characters become ``_``."""
    parts, rest = [], pattern
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        name, _, width = name.partition(":")
        parts.append(F.lit(before))
        if name == "index":
            plain = index.cast("string")
            parts.append(F.when(F.char_length(plain) < int(width or 0), F.lpad(plain, int(width or 1), "0")).otherwise(plain))
        else:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.trim(F.regexp_replace(F.concat(*parts, F.lit(rest)), r'[<>:"/\\|?*]', "_"))


def upright_size(width: Column, height: Column, orientation: Column) -> Column:
    """Width and height as seen after the orientation (1 to 8); null where one of them is invalid."""
    valid = (width > 0) & (height > 0) & orientation.between(1, 8)
    turned = orientation.isin(*TURNED)
    return F.when(valid, F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height")))


def parameters_text(prompt: Column, negative: Column, values: dict[str, Column]) -> Column:
    """Prompt, negative prompt, and ``Label: value`` pairs in the given order; blanks drop out."""
    some = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    pairs = F.concat_ws(", ", *(F.when(some(c) != "", F.concat(F.lit(f"{label}: "), some(c))) for label, c in values.items()))
    return F.concat_ws("\n", F.when(some(prompt) != "", some(prompt)), F.when(some(negative) != "", F.concat(F.lit("Negative prompt: "), some(negative))), F.when(pairs != "", pairs))


def parts(caption: Column) -> Column:
    """Array of the comma-separated tokens of a caption, lines as spaces, blanks out."""
    cut = F.transform(F.split(F.coalesce(caption, F.lit("")), ","), one_line)
    return F.filter(cut, lambda t: t != "")


def joined(*pieces: Column) -> Column:
    """Arrays of tokens as one caption: each token once, whatever its case, in its first spelling."""
    every = F.filter(F.transform(F.flatten(F.array(*pieces)), lambda t: F.regexp_replace(one_line(t), "^,+|,+$", "")), lambda t: t != "")
    return F.array_join(F.filter(every, lambda t, i: ~F.exists(F.slice(every, F.lit(1), i), lambda u: F.lower(u) == F.lower(t))), ", ")


def sidecar(mode: str, item: dict[str, Column], tags: Column, prefix: str = "", blacklist=(), template: str = "") -> Column:
    """The caption of an item in one of twelve modes. ``item`` names its ``id``, ``prompt``, ``negative``, ``caption``,
    ``prose`` and ``values`` (label to column); black-listed tokens drop out of tags and captions, and tag modes
    have spaces for underscores."""
    banned = sorted({" ".join(b.lower().split()) for b in blacklist})
    allowed = lambda a: F.filter(a, lambda t: ~F.lower(t).isin(*banned)) if banned else a
    some = lambda name: F.trim(F.coalesce(item[name], F.lit("")))
    prompt, negative, caption = some("prompt"), some("negative"), some("caption")
    prose = F.when(some("prose") != "", some("prose")).otherwise(caption)
    shown = F.transform(allowed(tags), underscored)
    head = F.array(F.lit(prefix))
    said = lambda c: allowed(parts(c)) if banned else F.filter(F.array(one_line(c)), lambda t: t != "")
    if mode in ("prompt", "negative"):
        return prompt if mode == "prompt" else negative
    if mode == "prompt_negative":
        return F.concat_ws("\n", F.when(prompt != "", prompt), F.when(negative != "", F.concat(F.lit("Negative prompt: "), negative)))
    if mode == "a1111":
        return parameters_text(prompt, negative, item["values"])
    if mode == "template":
        return rendered(template, {**item, "tags": F.array_join(shown, ", ")})
    if mode == "json":
        return F.to_json(F.struct(item["id"].alias("id"), prompt.alias("prompt"), negative.alias("negative_prompt"), caption.alias("ai_caption"), allowed(tags).alias("tags")))
    if mode == "prompt_nl":
        return F.array_join(F.filter(F.concat(head, said(prompt), said(prose)), lambda t: t != ""), "\n")
    pieces = {"tags": [shown], "caption_tags": [head, said(caption), shown], "caption_merged": [head, said(caption), said(prompt), shown], "nl_caption": [head, said(prose)], "tags_nl": [head, shown, said(prose)]}
    return joined(*pieces[mode])


MODES = ("tags", "prompt", "negative", "prompt_negative", "a1111", "caption_tags", "caption_merged", "nl_caption", "tags_nl", "prompt_nl", "template", "json")


def assembled(trigger: str, character: Column, general: Column, prose: Column) -> Column:
    """Trigger (unless a tag is it), character tags, general tags without noise, then prose."""
    plain = lambda a: without_noise(F.transform(F.filter(a, lambda t: t != ""), normalize_token))["kept"]
    listed = F.array_distinct(F.concat(plain(character), plain(general)))
    word = trigger.strip().lower()
    headed = F.when(F.array_contains(listed, word) | F.lit(word == ""), listed).otherwise(F.concat(F.array(F.lit(word)), listed))
    tags, said = F.array_join(headed, ", "), F.trim(F.coalesce(prose, F.lit("")))
    return F.concat_ws(", ", F.when(tags != "", tags), F.when(said != "", said))
