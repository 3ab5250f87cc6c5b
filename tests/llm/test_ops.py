import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from esig.llm import ann, bpe, html_text, line_dedup, mixing, near_dedup, pii, quality_model, quality_rules, queries, sharding, util

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# 1 -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("leaf", [1, 5, 64])
def test_bpe_tree_equals_the_library(encoding, leaf):
    ranks, enc = encoding
    codec, rng = bpe.TreeCodec(ranks, leaf, first_window=2, run_window=16), random.Random(leaf)
    pools = ["ab 1'st!\né中 \t", "abcdefghijklmnopqrstuvwxyz", "a", "中文字の国", "0123456789", " \n\t", "'s't re"]
    for _ in range(400):
        text = "".join(rng.choice(rng.choice(pools)) if rng.random() < 0.2 else rng.choice(pools[_ % 7]) for _i in range(rng.randrange(0, 300)))
        ids = codec.encode(text)
        assert ids == enc.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_query(docs, rows, none, encoding):
    enc = encoding[1]
    got = {r.doc_id: r for r in bpe.bpe_digest(docs, RANKS, leaf_chars=50).collect()}
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i].decoded_sha256 == brute.sha(t or "")
    assert bpe.bpe_digest(none, RANKS).count() == 0
    both = bpe.decode_bpe(bpe.encode_bpe(docs, RANKS, exact="exact"), RANKS).select("text", "decoded", "exact").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.exact for r in both)


def test_bpe_long_texts_and_repeated_rows(spark, encoding):
    """Texts beyond the default leaf, so that joins happen at it."""
    enc, rng = encoding[1], random.Random(12)
    words = ["the", "Grüße", "don't", "42", "…", "中文", "x" * 300, "\n\n", "  "]
    texts = [" ".join(rng.choice(words) for _ in range(4000)), "a" * 9000, "".join(rng.choice("ab ") for _ in range(9000))]
    df = spark.createDataFrame([(7, t) for t in texts] + [(7, texts[0])], "doc_id bigint, text string")
    want = sorted((len(i), hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest(), brute.sha(t)) for t in [*texts, texts[0]] for i in [enc.encode_ordinary(t)])
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digest(df, RANKS).collect()) == want


# 2 -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("batches,fanout", [(1, 4), (4, 2), (6, 3)])
def test_line_dedup(docs, rows, batches, fanout):
    want = brute.line_dedup([r[:2] for r in rows])
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs, batches=batches, fanout=fanout).collect()}
    assert got == want
    assert any(x[1] for x in want.values())


def test_line_dedup_edges(spark, none):
    assert line_dedup.dedup_lines(none).count() == 0
    line = "A line that is long enough to count"
    df = spark.createDataFrame([(None, line), (1, line), (2, line), (2, line), (3, f"{line}\n{line}\nx")], "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0), r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(0, 1, ""), (1, 1, ""), (2, 1, ""), (2, 1, ""), (3, 0, f"{line}\n{line}\nx")]


# 3 -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, rows, percent):
    link, want = (percent, 100), brute.near_dups([r[:2] for r in rows], percent)
    docs = docs.withColumns({"_d": F.lit(1), "_t": F.lit(None), "row": F.lit("x")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, link).collect()}
    assert got == want
    kept = near_dedup.keep_one(docs, link)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in want.items() if x[1] == i)


def test_near_duplicates_chain_and_edges(spark, none):
    assert near_dedup.near_duplicates(none).count() == 0
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(words)]
    for _ in range(60):  # a chain: neighbours are alike, the ends are not
        for p in rng.sample(range(400), 3):
            words[p] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    data = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, texts[5].upper()), (102, texts[5].upper())]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string"), (85, 100)).collect()}
    want = {i: x[1] for i, x in brute.near_dups([d for d in data if d[0] < 102 or d[0] == 102], 85).items()}
    assert got == want


@pytest.mark.parametrize("s", [0.8, 0.85])
def test_posterior_bounds_keep_true_pairs(s):
    for n, least in near_dedup.posterior_bounds(s):
        tail = sum(math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m) for m in range(least))
        assert tail < near_dedup.MISS


# 4 -----------------------------------------------------------------------------------------------------------------
def test_mixing(docs, rows, none):
    assert mixing.plan_mix(none).count() == 0
    plan = mixing.plan_mix(docs).collect()
    size, target, taken = defaultdict(int), {}, Counter()
    for r in plan:
        size[r.source] += r.size
        target[r.source] = r.target
        taken[r.source] += r.copies * r.size
        assert r.copies <= 3
    assert {r.doc_id: r.size for r in plan} == {i: len(brute.WORD.findall(t or "")) for i, t, *_ in rows}
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    left, weights, capped = sum(size.values()), dict(zip(order, [5, 2, 1, 5], strict=False)), {}
    while True:  # share by weight, stop at the cap, share the excess again
        share = {s: (left - sum(capped.values())) * weights[s] / sum(w for x, w in weights.items() if x not in capped) for s in order if s not in capped}
        over = [s for s, v in share.items() if v > 3 * size[s]]
        if not over:
            break
        capped |= {s: 3 * size[s] for s in over}
    for s in order:
        assert target[s] == pytest.approx({**share, **capped}[s])
        assert abs(taken[s] - target[s]) <= 3 * max(r.size for r in plan if r.source == s)
    again = {(r.doc_id, r.copies) for r in mixing.plan_mix(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.copies) for r in plan}
    clash = docs.withColumns({c: F.lit("x") for c in ("_d", "_s", "_z", "_copies", "_rows", "row", "col", "copies")})
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert copies == Counter({r.doc_id: r.copies for r in plan if r.copies})


# 5 -----------------------------------------------------------------------------------------------------------------
def test_base_spans(spark, rows):
    rng = random.Random(5)
    bits = ["1", "23", "255", "256", ".", "@", "a", "b.c", "-", " ", "+", "+1 ", "(", "4111 1111 1111 1111", "\n", "é", "a@b.co", "1.2.3.4", "x_y", "%", "﷐", "4417744280351547"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(600)]
    texts += [None, "", "1" * 20000, "a" * 20000, "+1" + "(" * 20000, "1 " * 10000, "a@" * 9000, "a@b.co 1.2.3.4 +1 555 010 2222 " * 700, "1." * 9000, *[r[1] for r in rows]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.s for r in pii.base_spans(df).select("doc_id", pii.span_text(F.col("base")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_spans(t)), t[:200]


def test_pii_query_counts_each_kind(spark, tmp_path):
    texts = ["a@b.c", "10.0.0.7 and 10.0.0.8 by x@y.org", "4111 1111 1111 1111 4111-1111-1111-1111\nz@y.org", "+1 (555) 010-2345 or +1 (555) 010-2346, 10.0.0.7", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_pii(spark, str(tmp_path)).collect()
    for r in got:
        want = brute.base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in pii.KINDS]
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
    assert len(got) == len(texts)


def test_contexts_find_unseen_identifiers(spark, none):
    assert pii.find_personal_data(none).count() == 0
    seen = [(i, f"Please pay from card number {c} today.") for i, c in enumerate(["4417744280351547", "4111111111111111", "5500005555555559"] * 12)]
    rows = [*seen, (100, "Please pay from card number 1234567890123 today."), (101, "There were 1234567890123 stars."), (102, None)]
    got = {r.doc_id: (len(r.base), [(s.start, s.end, s.k) for s in r.added]) for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100] == (0, [(28, 41, 2)])
    assert got[101] == got[102] == (0, [])
    assert all(got[i] == (1, []) for i, _ in seen)


def test_pii_repeated_rows_get_equal_spans(spark):
    text = "Write to anna.berg@mail.example.org or call +1 (555) 010-2345 from 10.0.0.7."
    df = spark.createDataFrame([(1, text)] * 3 + [(1, text + " Again: 10.0.0.8."), (2, text), (None, text)], "doc_id bigint, text string")
    got = pii.find_personal_data(df).select("doc_id", pii.span_text(F.col("base")).alias("s"), pii.span_text(F.col("added")).alias("a")).collect()
    assert len(got) == 6 and len({(r.s, r.a) for r in got}) == 2
    assert sorted(r.s.count("ip:") for r in got) == [1, 1, 1, 1, 1, 2]


def test_hidden_seeds_come_back(spark):
    rng = random.Random(3)
    rows = [(i, f"{rng.choice(['see', 'by', 'at'])} a{rng.randrange(10**6)}@mail.example.org {rng.choice(['or', 'and', 'if'])}\n10.{rng.randrange(256)}.{rng.randrange(256)}.7 was up") for i in range(300)]
    got = {r.k: r for r in pii.hidden_seeds(spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string")).collect()}
    assert all(got[k].n_hidden > 10 and got[k].n_found == got[k].n_hidden and got[k].n_wrong == 0 for k in (0, 1))
    words = pii.base_spans(spark.createDataFrame([(1, "one  two\t1234 six\n 99887 x")], "doc_id bigint, text string")).first().words
    assert [(w.txt, w.ctx, w.nxt) for w in words] == [("1234", "one two", "six"), ("99887", "\nsix", "x")]


# 6 -----------------------------------------------------------------------------------------------------------------
def test_quality_rules(docs, rows, labels, none):
    assert quality_rules.apply_rules(none, labels).count() == 0
    rng = random.Random(2)
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, labels).collect()}
    for i, t, *_ in rows:
        r, want = got[i], brute.quality_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and (r.score or 0.0) >= quality_rules.THRESHOLD)
    texts = [" ".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(0, 60))) for _ in range(80)] + ["x\nx\n \n \nx", "##\n##"]
    df = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in quality_rules.base_rules(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality_base(texts[r.doc_id])


def test_quality_rules_without_trusted_labels(docs, rows, labels):
    """Nothing to compare with: the base rules alone decide."""
    for none_trusted in (labels.limit(0), labels.where("quality = 0"), labels.withColumn("doc_id", F.col("doc_id") + 100_000)):
        got = quality_rules.apply_rules(docs, none_trusted).collect()
        assert len(got) == len(rows) and all(r.kept == (not r.base_failed) for r in got) and any(r.kept for r in got)


def test_quality_rules_long_and_repeated_texts(spark):
    rng = random.Random(6)
    long = "\n".join(" ".join(f"w{rng.randrange(3000)}" for _ in range(40)) for _ in range(1500))
    same = " ".join(f"v{k % 61}" for k in range(70))
    texts = [long, long, same, same, same, "x" * 500_000, "a b c " * 20_000]
    df = spark.createDataFrame([(k % 4 if t == same else k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = quality_rules.apply_rules(df, spark.createDataFrame([(0, 1), (2, 1)], "doc_id bigint, quality int")).collect()
    assert len(got) == len(texts)
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(brute.quality_base(t) for t in texts)
    assert len({(r.n_words, r.score, r.kept) for r in got}) == len(set(texts))


def test_quality_score_is_the_mean_log_ratio(spark):
    rng = random.Random(8)
    good = [(i, " ".join(rng.choice(["river", "stone", "tree", "cloud", "and", "the"]) for _ in range(80))) for i in range(60)]
    bad = [(100 + i, " ".join(rng.choice(["win$$$", "now###", "the&&&"]) for _ in range(80))) for i in range(20)]
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    known = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, quality int")
    weights = {r.b: r.w for r in quality_rules.fit_weights(df, known).collect()}
    grams = defaultdict(list)
    for r in quality_rules.ngrams(df).collect():
        grams[r.doc_id] += [weights[r.b1], weights[r.b2], weights[r.b3]]
    score = {r.doc_id: r.score for r in quality_rules.apply_rules(df, known).collect()}
    assert all(score[i] == pytest.approx(np.mean(w), abs=1e-8) for i, w in grams.items())
    assert min(score[i] for i, _ in good) > max(score[i] for i, _ in bad)


def test_quality_target_counts_every_trusted_document(spark):
    """Where all documents are trusted, target and raw are the same."""
    n = F.col("id")
    texts = F.concat_ws(" ", F.concat(F.lit("w"), n % 7919), F.concat(F.lit("v"), n % 101))
    df = spark.range(25_000).select(n.alias("doc_id"), texts.alias("text"))
    weights = quality_rules.fit_weights(df, df.select("doc_id", F.lit(1).alias("quality"))).collect()
    assert len(weights) > 1000 and all(r.w == 0.0 for r in weights)
    lost = df.unionByName(df.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    weights = quality_rules.fit_weights(lost, df.select("doc_id", F.lit(1).alias("quality"))).agg(F.max(F.abs("w"))).first()[0]
    assert 0 < weights < 1


# 7 -----------------------------------------------------------------------------------------------------------------
def test_quality_model(spark, none, labels):
    rng = random.Random(6)
    text = lambda y: " ".join(rng.choice(["river", "stone", "tree", "cloud"] if y else ["river$$$", "stone###", "tree&&&"]) for _ in range(40))
    rows = [(i, text(i % 3 > 0)) for i in range(400)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality_model.score(df.withColumn("score", F.lit("old")), known).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in range(400) if got[i].held_out] == held
    assert np.mean([got[i].predicted == (i % 3 > 0) for i in held]) > 0.97
    assert got[1000].score == got[1001].score
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    again = {r.doc_id: r.score for r in quality_model.score(df.repartition(3), known).collect()}
    assert again == {i: r.score for i, r in got.items()}
    assert quality_model.score(none, labels).count() == 0
    assert {r.score for r in quality_model.score(df, known.where("quality = 2")).collect()} == {0.5}


def test_quality_model_repeated_rows_and_two_texts_of_one_label(spark, docs, labels):
    rows = docs.select("doc_id", "text").where("doc_id < 60")
    twice = rows.unionByName(rows).unionByName(rows.withColumn("text", F.lit("another text under the same id")))
    got = {}
    for r in quality_model.score(twice, labels).collect():
        got.setdefault(r.doc_id, []).append((r.held_out, round(r.score, 12), r.predicted))
    assert len(got) == 60 and all(len(v) == 3 and len(set(v)) <= 2 for v in got.values())
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for v in got.values() for _, s, p in v)


def test_word_vectors_and_pooling_equal_plain_ones(spark):
    rng, Q = random.Random(15), quality_model
    texts = [" ".join(rng.choice(["ab", "cde", "f", "ab", "é"]) for _ in range(rng.randrange(0, 30))) for _ in range(40)] + [None, "", "one", "long word " * 3000, "one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    bucket = lambda w: int(Q._terms([w])[0][0])
    total = np.zeros((Q.BUCKETS, Q.DIM))
    for t in texts:
        ws = [bucket(w) for w in (t or "").split()]
        for i, a in enumerate(ws):
            for c in ws[max(0, i - Q.WINDOW) : i] + ws[i + 1 : i + 1 + Q.WINDOW]:
                total[a] += Q._INDEX[c]
    unit = total / np.maximum(np.sqrt((total**2).sum(axis=1, keepdims=True)), 1e-12)
    got = Q.word_vectors(df)
    assert np.allclose(got, unit, atol=1e-6)
    for t, row in zip(texts, Q.pooled(texts, got), strict=True):
        ws = (t or "").split()
        if not ws:
            assert not row.any()
            continue
        assert np.allclose(row[: Q.DIM], np.mean([unit[bucket(w)] for w in ws], axis=0), atol=1e-6)
        assert np.allclose(row[Q.DIM : 2 * Q.DIM], np.mean([Q._INDEX[bucket(w)] for w in ws], axis=0), atol=1e-6)
        assert row[-2] == pytest.approx(np.mean([a == b for a, b in zip(ws, [*ws[1:], None], strict=True)])) and row[-1] == pytest.approx(math.log1p(len(ws)))


# 8 -----------------------------------------------------------------------------------------------------------------
PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><div class="top-menu"><a href=x>Home</a> <a>News</a></div>
<article><h1>A &amp; B</h1><p>First&nbsp;paragraph,  with   <b>bold</b>
text.<p>Second one &lt;here&gt;. <!-- gone --><div class="comments"><p>I liked this very much, thank you.</p></div></article>
<form><p>Your name please, and your address.</p></form><footer>Written in May.</footer></body></html>"""


def test_html(spark):
    pages = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "just text"), (5, "u", "<p>unclosed <b>x<"), (1, "u", PAGE), (6, "u", "<div>" * 3000 + "x")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract_text(df).collect()]
    want = "A & B\nFirst paragraph, with bold text.\nSecond one <here>."
    assert sorted(got)[:2] == [(1, want, len(want))] * 2
    assert (2, "", 0) in got and (3, "", 0) in got and (4, "just text", 9) in got
    assert html_text.extract_text(df.where("page_id > 9")).count() == 0


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><p>one</p><video-player id=x></video-player><p>two</p></article>", ["one", "two"]),
        ("<p>one <svg class=i/> two</p><p>three</p>", ["one two", "three"]),
        ("<p>one <svg class=i> two</p><p>three</p>", ["one", "three"]),
        ("<div><p>one</p><button>Buy</div><p>two</p>", ["one", "two"]),
        ("<p>one <span><select><option>x</span> two</p><object>", ["one two"]),
        ("<p>one <math/> two<audio src=x><p>three", ["one two", "three"]),
        ("<p>one <svg><title/><g/><text>x</text></svg> two</p>", ["one two"]),
        ("<p>one <button>x<div>y</div></button> two</p>", ["one two"]),
        ("<p>one</p><script>var x = '<p>y</p>'", ["one"]),
    ],
)
def test_html_skips_end(page, want):
    assert [t for _, t in html_text.parse(page)[1]] == want


@pytest.fixture(scope="module")
def model():
    """The model that the query trains, on pages of the given table."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    return html_text.train([r["html"] for r in pages[: html_text.FIT_PAGES]])


SAID = "The council met on Monday to talk about the bridge, and most of the members agreed to it."
MORE = "Work will begin in the spring if the money comes in time. It should take about two years."
NAV = "<nav><ul><li><a>Home</a></li><li><a>World</a></li></ul></nav>"
FOOT = "<footer>All rights reserved. <a>Imprint</a></footer>"


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article><h1>T</h1><div>{SAID}</div><div>{MORE}</div></article>", ["T", SAID, MORE]),
        (f"<body>{NAV}<main><h1>T</h1><div>{SAID}</div><div>{MORE}</div></main>{FOOT}</body>", ["T", SAID, MORE]),
        (f"<body>{NAV}<article><p>{SAID}</p><ul><li><a>Town council</a></li><li><a>Daily news</a></li></ul></article>{FOOT}</body>", [SAID, "Town council", "Daily news"]),
        (f"<body><table><tr><td><a>Home</a> <a>News</a> <a>More</a></td><td><h1>T</h1><p>{SAID}</p><p>{MORE}</p></td></tr></table></body>", ["T", SAID, MORE]),
        (f"<table><tr><td>{SAID}</td></tr><tr><td>{MORE}</td></tr></table>", [SAID, MORE]),
        (f"<body><div>{SAID}</div><div>{MORE}</div></body>", [SAID, MORE]),
        (f"<body>{NAV}<div>{SAID}</div><div>{MORE}</div>{FOOT}</body>", [SAID, MORE]),
        (f'<body>{NAV}<div class="content"><h1>T</h1><p>{SAID}</p><div class="sidebar"><h3>Most read</h3><p>{MORE}</p></div><p>{MORE}</p></div>{FOOT}</body>', ["T", SAID, MORE]),
        (f'<body>{NAV}<article><h1>T</h1><p>{SAID}</p></article><section id="comments"><h2>Comments</h2><article><p>{MORE}</p></article><article><p>{MORE}</p></article></section>{FOOT}</body>', ["T", SAID]),
        (f'<body>{NAV}<main><article><h1>T</h1><p>{SAID}</p></article><section id="comments"><article><p>{MORE}</p></article></section></main>{FOOT}</body>', ["T", SAID]),
        (f"<body><h1>Title</h1>{SAID}<br><br>Second part.<hr>{MORE}</body>", ["Title", f"{SAID} Second part.", MORE]),
        (f'<body>{NAV}<article><h1>T</h1><p>{SAID}</p><div class="ad">Buy warm boots now.</div><p>{MORE}</p></article>{FOOT}</body>', ["T", SAID, MORE]),
        (f"<body><div><a>Home</a> <a>News</a> <a>About</a></div><div><div>{SAID}</div><div>{MORE}</div></div><div><a>Imprint</a></div></body>", [SAID, MORE]),
        (f"<article><h1>T</h1><p>{SAID}</p><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><p>{MORE}</p></article>", ["T", SAID, "A", "B", "1", "2", MORE]),
        (f"<body><nav><a>Home</a></nav>{SAID}<footer>Imprint</footer></body>", [SAID]),
        ("just text", ["just text"]),
        ("<p>Short.</p>", ["Short."]),
    ],
)
def test_html_layouts(model, page, want):
    assert model.text(page).split("\n") == want


def test_html_article_of_many_short_blocks(model):
    """However many like blocks an article has, they don't outvote it."""
    for item in ("<p>A line of the long story is here.</p>", "<li>item one</li>", "<p>Yes.</p>", "<div>Yes.</div>"):
        for n in (1, 10, 50, 500, 20_000):
            page = f"<body><nav><a>Home</a></nav><article><h1>Title of it</h1>{item * n}</article><footer>F</footer></body>"
            assert model.text(page).count("\n") == n, (item, n)


def test_html_given_pages_come_out_whole(model):
    """Pages that weren't trained on: their articles cut out by markup, and the same without names and telling elements."""
    import pyarrow.parquet as pq

    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()][html_text.FIT_PAGES :]
    want = []
    for p in pages:
        nodes, pieces = html_text.parse(p)
        states = html_text.labels_by_markup(nodes)
        want.append("\n".join(t for i, t in pieces if states[i] == html_text.CONTENT))
    assert model.texts(pages) == want
    bare = model.texts([html_text.stripped(p) for p in pages])
    assert sum(a == b for a, b in zip(bare, want, strict=True)) >= 0.97 * len(want)


def test_html_composed_layouts_held_out(model):
    rng = random.Random(4321)
    hit = found = wanted = 0
    for _ in range(150):
        nodes, pieces = html_text.parse(html_text.compose(rng))
        states, forest = html_text.labels_given(nodes), html_text.Forest([nodes])
        p = forest.marginals(model.weights, model.edges)[0][:, html_text.CONTENT]
        for i, _t in pieces:
            hit += p[i] > 0.5 and states[i] == html_text.CONTENT
            found += p[i] > 0.5
            wanted += states[i] == html_text.CONTENT
    assert hit >= 0.95 * wanted and hit >= 0.95 * found


def test_html_repeated_and_long_pages(spark):
    long = f"<article>{'<p>A line of the long story is here.</p>' * 20_000}</article>"
    df = spark.createDataFrame([(1, "u", PAGE)] * 40 + [(2, "u", long)], "page_id bigint, url string, html string")
    got = {(r.page_id, r.n_chars) for r in html_text.extract_text(df).collect()}
    assert len(got) == 2 and (2, 20_000 * 34 - 1) in got


def test_marginals_equal_enumeration(model):
    """All states of small trees, one by one."""
    import itertools

    for page in ("<article><p>a b c.</p><div class=ad>x</div></article>", "<div><p>one</p></div><nav><a>x</a></nav>"):
        nodes = html_text.parse(page)[0][:8]
        forest = html_text.Forest([nodes])
        own = model.weights[forest.rows].sum(axis=1)
        mass = np.zeros((len(nodes), 3))
        for states in itertools.product(range(3), repeat=len(nodes) - 1):
            y = (html_text.MIXED, *states)
            w = math.exp(sum(own[i, y[i]] + model.edges[n.kind, y[n.parent], y[i]] for i, n in enumerate(nodes) if i))
            for i, k in enumerate(y):
                mass[i, k] += w
        got, joint = forest.marginals(model.weights, model.edges)
        assert np.allclose(got, mass / mass.sum(axis=1, keepdims=True), atol=1e-9)
        assert np.allclose(joint[1:].sum(axis=1), got[1:], atol=1e-9)


# 9 -----------------------------------------------------------------------------------------------------------------
def test_sharding(docs, rows, none):
    assert sharding.shard(none).count() == 0
    text = {r[0]: r[1] or "" for r in rows}
    for shards in (1, 7, 40):
        got = sharding.shard(docs, shards).collect()
        assert sorted(r.doc_id for r in got) == sorted(text)
        slots = defaultdict(list)
        for r in got:
            assert (r["size"], r.text_crc32) == (len(text[r.doc_id].encode()) + 16, zlib.crc32(text[r.doc_id].encode()))
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == shards


def test_sharding_repeated_rows_long_texts_and_reruns(spark):
    rows = [(1, "x")] * 50 + [(None, None)] * 30 + [(2, "long " * 60_000)] + [(i, f"t{i}") for i in range(3, 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    first = [tuple(r) for r in sharding.shard(df, 7).collect()]
    assert len(first) == len(rows) and Counter(r[0] for r in first) == Counter(r[0] for r in rows)
    assert sorted(first, key=repr) == sorted((tuple(r) for r in sharding.shard(df, 7).collect()), key=repr)
    count = Counter(r[3] for r in first)
    assert max(count.values()) - min(count.values()) <= 1
    assert sorted((r[3], r[4]) for r in first) == [(s, i) for s in sorted(count) for i in range(count[s])]


def test_hypergeometric_moments():
    rng = np.random.default_rng(1)
    x = [sharding.hypergeometric(rng, 3000, 7000, 500) for _ in range(4000)]
    assert np.mean(x) == pytest.approx(150, abs=1)
    assert np.var(x) == pytest.approx(500 * 0.3 * 0.7 * 9500 / 9999, rel=0.1)
    m = np.array(sharding.communication_matrix([5, 0, 17, 100], 6, 3))
    assert m.sum(axis=1).tolist() == [5, 0, 17, 100] and sorted(m.sum(axis=0)) == [20, 20, 20, 20, 21, 21]


# 10 ----------------------------------------------------------------------------------------------------------------
def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[500] = x[300] = x[200]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1100, [0.0] * 16), (1200, [math.nan] * 16), (1300, [None] * 16), (1400, [1.0] * 5), (1500, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).repartition(4)
    got = defaultdict(list)
    for r in ann.nearest(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    d = x.astype(np.float64)
    assert sorted(got) == list(range(0, 900, 100))
    for q, hits in got.items():
        far = np.sqrt(((d - d[q]) ** 2).sum(axis=1))
        want = sorted((far[i], i) for i in range(900) if i != q)[:10]
        assert [h[1] for h in sorted(hits)] == [w[1] for w in want]
        assert np.allclose([h[2] for h in sorted(hits)], [w[0] for w in want], rtol=1e-14)
    assert ann.nearest(df.where("vec_id >= 1000")).count() == 0
    few = ann.nearest(df.where("vec_id IN (0, 1, 2)")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_nearest_with_copies_many_blocks_and_repeated_ids(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 150), ("BLOCK_QUERIES", 8), ("HOME_ROWS", 30), ("FIT_ROWS", 300)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 8))
    x[::3] = x[0]  # a third of all rows are one vector
    x[7] = 1e12
    x[1::50] *= 1e-9
    ids = list(range(1200))
    ids[5] = ids[6] = ids[9] = 100  # rows of one id: each a candidate, none meets its own id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>").repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect())
    want = []
    for q in {i for i in ids if i % 100 == 0}:
        hits = sorted((np.sqrt(((x[c] - x[a]) ** 2).sum()), ids[c]) for a in range(1200) if ids[a] == q for c in range(1200) if ids[c] != q)[:10]
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(hits)]
    want.sort()
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    found = ann.search_stages(df, 10, 100)
    assert found["pairs"].count() < found["asked"].count() * 1200 // 2


def test_line_runs_are_merged_in_order(docs, monkeypatch):
    """Merge joins read the runs as they lie: only the batch is exchanged and sorted. Runs are compacted along the way."""
    plans, counts, written = [], [], line_dedup.LineRuns._written

    def spy(self, rows, level):
        with line_dedup.bucket_order(self.spark):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        counts.append(self.compactions)
        return written(self, rows, level)

    monkeypatch.setattr(line_dedup.LineRuns, "_written", spy)
    line_dedup.dedup_lines(docs).count()
    joins = [p for p in plans if "LeftAnti" in p]
    assert joins and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p and p.count("Exchange") <= 1 and p.count("Sort [") <= 1 for p in joins)
    assert max(counts) >= 2


# helpers -----------------------------------------------------------------------------------------------------------
def test_sieve_loses_nothing(spark):
    rows = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    by = util.sieve(rows.where("id % 40 = 0"), F.col("h"))
    got = util.sift(rows, F.col("h"), by).where("maybe").select("id").collect()
    assert {r.id for r in got} >= set(range(0, 20_000, 40)) and len(got) < 600
    assert util.sift(rows, F.col("h"), util.sieve(rows.where("false"), F.col("h"))).where("maybe").count() == 0
