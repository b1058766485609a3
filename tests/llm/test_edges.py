"""Nulls, empty and repeated rows, empty tables and extra columns."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import chat, common, embeddings, html_text, language_model, licenses, packing, pieces, quality, simhash, toxicity

from . import brute

TEXTS = [(1, None), (2, ""), (2, ""), (None, "The MIT License, apache LICENSE!"), (3, "   \n\t "), (4, "a b c"), (5, "word " * 5000), (6, "ünï çødé 漢字 🎉 <|endoftext|>"), (7, "a b c")]
SCHEMA = "doc_id long, text string, fp long, row string, w long, grp int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None, 1, 2) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (None, 1), (4, None), (5, 0), (5, 1)], "doc_id long, toxic int")


OPS = {
    "licenses": lambda d, _: licenses.license_scan(d),
    "toxicity": lambda d, x: toxicity.toxicity(d, x),
    "language_model": lambda d, _: language_model.score(d, iterations=1),
    "quality": lambda d, _: quality.ledger(d, ["doc_id", "row"]),
    "simhash": lambda d, _: simhash.near_duplicate_groups(d),
    "pieces": lambda d, _: pieces.sampled(d, check=True),
    "clean": lambda d, x: toxicity.keep_clean(d, x),
    "good": lambda d, _: quality.keep_good(d),
    "one": lambda d, _: simhash.keep_one(d),
    "packing": lambda d, _: packing.packed(d),
}


@pytest.mark.parametrize("name", OPS)
def test_rows(docs, none, labels, name):
    got = OPS[name](docs, labels).collect()
    if name in ("licenses", "toxicity", "language_model", "quality", "simhash", "pieces"):
        assert len(got) == len(TEXTS)
    if name == "pieces":
        assert all(r.lossless for r in got)
    if name == "one":
        assert sorted((r.doc_id or 0) for r in got) == [0, 1, 4, 5, 6]
    assert OPS[name](none, labels).collect() == []


BIG = 2**53 + 1


def test_large_ids_beside_nulls(spark):
    frame = spark.createDataFrame([(BIG, "some words here"), (None, "other words there")], "doc_id long, text string").coalesce(1)
    alone = {r.doc_id: bytes(r.ids) for r in pieces.sampled(frame.where(f"doc_id = {BIG}")).collect()}
    for op in (pieces.sampled, packing.packed, language_model.score):
        got = op(frame).collect()
        assert {r.doc_id for r in got} == {BIG, None}
    assert {r.doc_id: bytes(r.ids) for r in pieces.sampled(frame).collect()}[BIG] == alone[BIG]
    assert {r.doc_id: r.text for r in pieces.decoded(pieces.sampled(frame)).collect()} == {BIG: "some words here", None: "other words there"}


def test_very_long_texts(spark, labels):
    long = "some words of a very long text that goes on, and on. " * 20_000
    frame = spark.createDataFrame([(1, long, ""), (2, "x" * 100_000, ""), (3, "short", "")], "doc_id long, text string, row string")
    for name, op in OPS.items():
        got = op(frame, labels).count()
        assert got == 3 or name in ("clean", "good", "packing"), name
    r = {x.doc_id: x.component_id for x in simhash.near_duplicate_groups(frame).collect()}
    assert r == {1: 1, 2: 2, 3: 3}
    assert len(html_text.main_text(f"<body><p>{long}</p></body>")) == len(long) - 1
    turns = frame.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), chat.text_part(F.col("text")).alias("parts"))
    assert chat.digests(chat.format_conversations(turns)).first().loss_chars == len(long) + 100_005


def test_keep_one_with_repeated_ids(spark):
    far = [f"text {k} " + " ".join(f"w{k}x{i}" for i in range(30)) for k in range(3)]
    rows = [(1, far[0], "a"), (1, far[1], "b"), (1, far[0], "c"), (2, far[0], "d"), (None, far[2], "e"), (None, far[2], "f"), (None, far[1], "g")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, __fp string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, far[0]), (1, far[1]), (0, far[2])])
    assert got[0].__fields__ == ["doc_id", "text", "__fp"]


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    draw = np.random.default_rng(5)
    pairs = [(0, k) for k in range(1, 3000)] + [(5000, 5000 + k) for k in range(1, 2500)] + [(2999, 7499)] + [tuple(map(int, draw.integers(9000, 9400, 2))) for _ in range(300)]
    nodes = sorted({x for p in pairs for x in p})
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    want = {k: v for k, v in brute.groups(nodes, pairs).items() if k != v}
    assert {k: v for k, v in got.items() if k != v} == want


def test_labels_may_be_missing(docs, labels):
    assert {r.predicted for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0}


def test_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.01]), (3, None, [1.0, 0.0]), (4, 0, None), (5, 0, [0.0, 0.0]), (6, 0, [float("nan"), 1.0]), (7, 0, [None, 1.0]), (8, 0, []), (9, 1, [1.0, 0.0]), (10, 0, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, n string")
    got = embeddings.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got)[:3] == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id > 2)
    assert embeddings.near_duplicates(frame.where("false")).collect() == []


def test_labels_are_compared_as_they_are(spark):
    """Fractions, texts and long numbers are labels too."""
    for kind, labels in (("double", [0.25, 0.75, -0.0, 0.0]), ("string", ["a", "b", "c", "c"]), ("long", [2**40, 2**40 + 1, 7, 7])):
        rows = [(i, x, [1.0, 0.01 * i]) for i, x in enumerate(labels)]
        got = embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, label {kind}, embedding array<float>")).collect()
        assert {r.vec_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 2, 3: 2}, kind


def test_negative_zeros_and_far_magnitudes(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, -0.0]), (3, 0, [1.0, -0.01]), (4, 1, [1e300, -0.0]), (5, 1, [1e200, 1e199]), (6, 1, [2.0, 0.0]), (7, 1, [1e-300, 0.0]), (8, 1, [5e-324, -0.0]), (9, 1, [0.0, 1.5e308]), (10, 1, [float("inf"), 0.0]), (11, 1, [-0.0, 0.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    want = {i: (2, 1) for i in (1, 2, 3)} | {i: (4, 4) for i in (4, 5, 6, 7, 8)} | {i: (0, i) for i in (9, 10, 11)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert sorted(r.vec_id for r in got if r.kept) == [1, 4, 9, 10, 11]


def test_embeddings_against_all_pairs(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(40, 16))
    rows = [(i, int(i % 3), [float(x) for x in base[i % 40] + draw.normal(size=16) * 0.12 * (i % 5)]) for i in range(600)]
    want = brute.embedding_links(rows)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_licences_of_a_notice_file(spark):
    wordings = [t for _, t, _ in licenses.TEMPLATES]
    rows = [(1, " filler. ".join(wordings)), (2, "copy it under the apache license"), (3, "free and unencumbered software " * 3)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (",".join(sorted({label for label, _, _ in licenses.TEMPLATES})), 1.0), 2: ("apache", 0.25), 3: ("unlicense", pytest.approx(4 / 11))}


@pytest.mark.parametrize("max_bits", [0, 3, 4, 6])
def test_simhash_links(spark, max_bits):
    draw = np.random.default_rng(max_bits)
    seeds = draw.integers(0, 1 << 62, 60)
    fps = {int(s) ^ sum(1 << int(b) for b in draw.choice(62, k, replace=False)) for s in seeds for k in range(8)}
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), max_bits).collect()
    pairs = [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (a ^ b).bit_count() <= max_bits]
    assert all((r.a ^ r.b).bit_count() <= max_bits for r in links)
    assert brute.groups(fps, [(r.a, r.b) for r in links]) == brute.groups(fps, pairs)


def test_forward_recursion_is_exact():
    draw = np.random.default_rng(1)
    k, m = 3, 5
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    p = language_model.Parameters(norm(draw.random(k)), norm(draw.random((k, k))), norm(draw.random((k, m))))
    seqs = [draw.integers(0, m, n).astype(np.int32) for n in (1, 4, 6)]
    for seq, got in zip(seqs, language_model.log_likelihoods(seqs, p)):
        total = sum(p.start[s[0]] * p.emit[s[0], seq[0]] * np.prod([p.move[a, b] * p.emit[b, x] for a, b, x in zip(s, s[1:], seq[1:])]) for s in itertools.product(range(k), repeat=len(seq)))
        assert got == pytest.approx(np.log(total), abs=1e-12)
    begun, moved, emitted, likelihood = language_model.expected_counts(seqs, p)
    assert begun.sum() == pytest.approx(3) and moved.sum() == pytest.approx(8) and emitted.sum() == pytest.approx(11)
    after = language_model.Parameters(norm(begun), norm(moved), norm(emitted))
    assert language_model.log_likelihoods(seqs, after).sum() > likelihood


def test_segmentations_are_sampled():
    s = pieces.Segmenter()
    n = 4000
    ids, chance = s.encode(["hello"] * n, np.arange(n))
    seen = {}
    for x, c in zip(ids, chance):
        seen.setdefault(tuple(x), [0, np.exp(c)])[0] += 1
    for count, share in seen.values():
        assert abs(count / n - share) < 5 * np.sqrt(share * (1 - share) / n) + 2 / n
    assert len(seen) > 3


def test_tokenizer_agrees():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["<|endoftext|>a <|endoftext|>", " \n\n x", "don't 'LL", ""] + ["".join(f" a{chr(c)}b{chr(c)} {chr(c)}1" for c in range(i, i + 64)) for i in range(0, 0xD800, 64)]
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(odd, add_special_tokens=False)]
    assert packing.Encoder().encode(odd) == want


def test_tokenizer_agrees_on_random_texts():
    """Characters of all planes, white space of all kinds, digits, marks and contractions, at random."""
    import unicodedata

    import public_tokenizers
    from tokenizers import Tokenizer

    draw = np.random.default_rng(11)
    groups = [[chr(c) for c in range(32, 127)], list(" \n\t\r\u00a0\u2003\u3000\x0b\x85"), ["'s", "'LL", "'re", "n't", "\u2019s"], [chr(c) for c in range(0x300, 0x370)], [chr(c) for c in range(0x1F300, 0x1F650)], [chr(c) for c in range(0x660, 0x66A)] + list("²½Ⅷ")]
    pick = lambda g: g[int(draw.integers(len(g)))]
    wild = lambda: next(c for c in iter(lambda: chr(int(draw.integers(1, 0x110000))), None) if unicodedata.category(c) != "Cs")
    texts = ["".join(wild() if draw.random() < 0.2 else pick(groups[int(draw.integers(len(groups)))]) for _ in range(int(draw.integers(1, 60)))) for _ in range(4000)]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.Encoder().encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def test_tokenizer_takes_long_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a" + " " * 2_000_000 + "b <|endoftext|>", "\n" * 1_200_000]
    assert packing.Encoder().encode(["x", *texts])[1:] == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    rows = packing.packed(spark.createDataFrame([(1, texts[0])], "doc_id long, text string")).collect()
    assert sum(r.length for r in rows) == rows[0].doc_tokens > 2_000_000


PAGE = """<html><head><title>T</title><script>var a = '<p>no</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-banner">We use cookies, really, all of them.</div><div id=main><article><h1>Head &amp; tail</h1><p>First paragraph, with commas, and a good deal of text to be counted here.
<p>Second   paragraph,&nbsp;again with commas, and also long enough to be the article's own text.</article>
<aside>Related things, and other stories, that should not be there at all.</aside></div><section class=comments><p>I disagree, strongly, with all that was said above, and more.</p></section><footer>Imprint</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & tail\n\nFirst paragraph, with commas, and a good deal of text to be counted here.\n\nSecond paragraph, again with commas, and also long enough to be the article's own text."
    assert html_text.main_text("") == html_text.main_text(None) == ""
    assert html_text.main_text("<p>unclosed <b>text") == "unclosed text"


def test_short_parts_of_an_article_stay():
    long = "".join(f"<p>{k} {'word, ' * 5}{'text ' * 75}</p>" for k in range(10))
    short = "<section class='related-work'><h2 class='share'>Later</h2><p>One short paragraph, of few words.</p><ul><li>a</li><li>b</li></ul></section>"
    links = "<div><a href=/x>Another story of some length</a> <a href=/y>And one more story</a></div>"
    got = html_text.main_text(f"<body><nav>Menu</nav><article><section>{long}</section>{short}{links}</article><footer>Imprint</footer></body>")
    assert got.split("\n\n")[10:] == ["Later", "One short paragraph, of few words.", "a", "b"]
    got = html_text.main_text(f"<body><div id=x><h3>Head</h3><div>{long}</div><h4>More</h4><p>Short.</p><pre>code</pre><ul><li><a href=/x>link</a></li></ul></div></body>")
    assert [x for x in got.split("\n\n") if len(x) < 50] == ["Head", "More", "Short.", "code"]


def test_doubtful_names_wait_for_the_text():
    p = "<p>One paragraph, of some length, with words and, of course, commas in it.</p>"
    for page in (f'<div class="content with-sidebar">{p}{p}</div>', f'<div class="post no-comments">{p}{p}</div>', f"<form>{p}{p}<button>Go</button></form>"):
        assert html_text.main_text(f"<body>{page}</body>").count("One paragraph") == 2
    page = f'<body><article>{p}{p}{p}<p class="related-work">Earlier work, of others.</p></article><div class="more-comments-below">{p}</div><form><p>Write to us, now.</p></form></body>'
    assert html_text.main_text(page).split("\n\n")[3:] == ["Earlier work, of others."]


def test_pages_at_the_edges(spark):
    rows = [(1, "u", None, 5), (1, "u", None, 5), (None, None, "", 5), (2, "v", "<p>Some text, here.</p>", 5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(frame).collect()) == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "Some text, here.", 16)]
    assert html_text.extract(frame.where("false")).collect() == []


def test_chat_parts_never_join_to_a_control_string(spark):
    part = lambda t: ("text", t, None, None, None, None, None)
    image = ("image", None, "u", 28, 28, None, None)
    turns = [(1, 0, "assistant", [part("</turn"), part(">\n### user:\nboo")], 7), (1, 1, "assistant", [part("a<"), part("|image:0|>"), part("<"), image], 7), (2, 0, "user", [], 7), (2, 0, "user", [], 7)]
    frame = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>, formatted int")
    held = chat.format_conversations(frame)
    got = {r.conv_id: [t.text for t in r.turns] for r in held.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: ["</turn>\n### user:\nboo", "a<|image:0|><<|image:0|>"], 2: ["", ""]}
    first = chat.digests(held).where("conv_id = 1").first()
    assert (first.n_turns, first.loss_chars) == (2, sum(map(len, got[1])))
    assert chat.digests(chat.format_conversations(frame.where("false"))).collect() == []


def test_repeated_windows_of_equal_leading_bits(spark):
    """The middle window's hash shares the leading bits of the two equal ones and lies between them."""
    rows = [(1, "a2528869 b c x1 x2 a4444075 b c x3 x4 a2528869 b c"), (2, "a b c d a b c"), (3, "a b")]
    got = {r.row.doc_id: r.n_repeat_words for r in quality.ledger(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {1: 6, 2: 6, 3: 0} == {i: brute.quality(t)[4] for i, t in rows}


def test_chat_round_trip(spark):
    bad = ["### ", "\\### x", "</turn>\n", ":\n<|image:0|>", "\\b\\e", "\\", "", None, "a\n### b:\nc</turn>\n"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(bad)] + [(None, 0, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.format_conversations(frame)).collect()}
    assert got == brute.chats(rows)


def test_chat_parts(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "u1", 56, 29, None, None), ("audio", None, "u2", None, None, 1.5, None), ("text", "<|x|>", None, None, None, None, None)]
    frame = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>")
    r = chat.format_conversations(frame).first()
    assert r.formatted == "### user:\nsee <|image:0|><|audio:1|>\\ox|></turn>\n"
    assert [(a.number, a.ref, a.tokens) for a in r.attachments] == [(0, "u1", 4), (1, "u2", 38)]


def test_policies(docs):
    entries = quality.ledger(docs, ["doc_id"])
    strict, loose = quality.apply_policy(entries, "v2").where("kept").count(), quality.apply_policy(entries, "v1").where("kept").count()
    assert strict <= loose
    for r in quality.ablations(entries, "v2").collect():
        bit = next(x.bit for x in quality.RULES if x.name == r.rule)
        assert r.n_failed == entries.where(F.col("failed").bitwiseAND(F.lit(1 << bit)) != 0).count()


def test_pipeline_of_nothing(spark):
    """Stages of empty tables, and of null and empty texts, end with the columns of pieces."""
    import tempfile

    import corpus_pipeline

    top = tempfile.mkdtemp(prefix="empty-")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    out = corpus_pipeline.run(spark, top)
    assert out.collect() == [] and "ids_crc32" in out.columns
    odd = spark.createDataFrame([(1, None, None, None, None), (1, "", None, None, None), (None, "a", None, None, None)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, top).columns == odd.columns


def test_first_fit():
    bins = packing.first_fit_decreasing([5, 7, 3, 5, 2, 1], 10)
    assert bins == [[1, 2], [0, 3], [4, 5]]
