"""Personal data: exact base patterns, and bootstrapped contexts that find further identifiers. DataFrame functions only.

Base entities are seeds. The words before and after an entity, its shape, and whether it opens a line make its lexical
patterns; patterns and entity strings form a bipartite graph. Scores go back and forth: a pattern is worth the share of its instances that are known to be of a
kind, an instance the chance that at least one of its patterns is right. Patterns of high confidence and support
mark identifier-shaped words that no base pattern covers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import BLANKS, salted_join, stage_table

#: The kinds in their order and their patterns. A match can begin only where the one before ended or
#: where a run of its first characters begins, which changes no match but keeps the search linear; the repeats are
#: possessive where nothing after them could take a character back.
KINDS = ("email", "ip", "card", "phone")
_MAIL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match of the kind passes.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: Identifier-shaped words: with a digit or an at sign, without punctuation around.
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
OPEN, CLOSE = "﷐", "﷑"
ROUNDS = 3
MIN_CONFIDENCE, MIN_SUPPORT = 0.9, 20
#: Parts of a text whose lengths are summed together.
SUM_BLOCK = 256
SPAN = "struct<start:int,end:int,txt:string,ctx:string,nxt:string>"
#: The words before a span are looked for within so many blanks.
GAPS = 8


def _parts(work: Column, pattern: str, gate: Column) -> Column:
    """The text cut before each match, each match closed by a mark; null if the gate shows that there is none."""
    return F.when(gate, F.split(F.regexp_replace(work, f"({pattern})", f"{OPEN}$1{CLOSE}"), OPEN))


def _sums(values: Column) -> Column:
    """0 and the running sums of an array."""
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _ends(parts: Column) -> Column:
    """Running lengths of the parts, summed in blocks: appending to one array would cost the square of its length."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / SUM_BLOCK).cast("int")), lambda b: F.slice(parts, b * SUM_BLOCK + 1, SUM_BLOCK))
    inner = F.transform(blocks, lambda block: _sums(F.transform(block, F.char_length)))

    def joined(sums: Column) -> Column:
        before = _sums(F.transform(sums, lambda s: F.element_at(s, -1)))
        every = F.transform(F.array(before), lambda at: F.flatten(F.transform(sums, lambda s, b: F.transform(F.slice(s, 2, SUM_BLOCK), lambda x: x + F.get(at, b)))))
        return F.concat(F.array(F.lit(0)), F.element_at(every, 1))

    return F.element_at(F.transform(F.array(inner), joined), 1)


def _spans(parts: Column) -> Column:
    """Matches of the cut text with code point offsets, the two words before them and the one after, in lower case. A match
    that opens a line has a line feed before its words; neither side looks beyond the neighbouring match."""
    ends = _ends(parts)
    flat = lambda c: F.translate(F.lower(c), BLANKS, " " * len(BLANKS))

    def one(i: Column, at: Column) -> Column:
        txt = F.substring_index(F.get(parts, i), CLOSE, 1)
        start = F.get(at, i) - (i - 1)
        tail = F.substring_index(F.get(parts, i - 1), CLOSE, -1)
        words = F.filter(F.split(F.substring_index(F.rtrim(flat(tail)), " ", -GAPS), " "), lambda w: w != "")
        opens = (F.btrim(F.substring_index(tail, "\n", -1), F.lit(BLANKS)) == "") & ((i == 1) | tail.contains("\n"))
        ctx = F.concat(F.when(opens, "\n").otherwise(""), F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), " "))
        nxt = F.substring_index(F.ltrim(flat(F.substring_index(F.get(parts, i), CLOSE, -1))), " ", 1)
        return F.struct(start.alias("start"), (start + F.char_length(txt)).alias("end"), txt.alias("txt"), ctx.alias("ctx"), nxt.alias("nxt"))

    found = F.transform(F.transform(F.array(ends), lambda at: F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: one(i, at))), lambda x: x)
    return F.when(F.size(parts) > 1, F.element_at(found, 1)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _holds(kind: str, txt: Column) -> Column:
    """Whether a match of the kind's pattern passes its further test."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(txt, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(txt, "[^0-9]", "")
    if kind == "card":
        return F.char_length(digits).between(14, 19) & _luhn(digits)
    return F.char_length(digits).between(10, 15)


def _shaped(kind: int, txt: Column) -> Column:
    """Whether a word could be an identifier of the kind in an unseen form."""
    digits = F.char_length(F.regexp_replace(txt, "[^0-9]", ""))
    return {0: txt.contains("@"), 1: txt.rlike(r"^[0-9A-Fa-f:.]+$") & (digits >= 4) & txt.rlike("[.:].*[.:]"), 2: digits >= 12, 3: digits.between(7, 15) & ~txt.rlike("[A-Za-z@]")}[kind]


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, at (a row number), base and words for every row: arrays of spans with start, k (kind), end, txt, ctx.

    ``base`` holds the kinds' matches that pass their tests, sorted; ``words`` the identifier-shaped words that
    overlap none of them, without k.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    work = F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, "��")).otherwise(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("at"), work.alias("work"))
    rows = rows.select("*", F.col("work").rlike("[0-9]").alias("digit"), F.col("work").contains("@").alias("mail"))
    gate = {k: F.col("mail") if k == "email" else F.col("digit") & F.col("work").rlike(GATES[k]) for k in KINDS}
    gate["word"] = F.col("digit") | F.col("mail")
    rows = rows.select("doc_id", "at", *[_parts(F.col("work"), PATTERNS.get(k, WORD), g).alias(k) for k, g in gate.items()])
    rows = rows.select("doc_id", "at", *[_spans(F.col(k)).alias(k) for k in gate])
    empty = F.array().cast("array<struct<start:int,k:int,end:int,txt:string,ctx:string,nxt:string>>")

    def passed(n: int, kind: str) -> Column:
        good = F.filter(F.col(kind), lambda s: _holds(kind, s["txt"]))
        return F.coalesce(F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("k"), s["end"].alias("end"), s["txt"].alias("txt"), s["ctx"].alias("ctx"), s["nxt"].alias("nxt"))), empty)

    some = reduce(lambda a, b: a | b, [F.size(k) > 0 for k in KINDS])
    base = F.when(some, F.sort_array(F.concat(*[passed(n, k) for n, k in enumerate(KINDS)]))).otherwise(empty)
    rows = rows.select("doc_id", "at", base.alias("base"), "word")

    def trimmed(s: Column) -> Column:
        lead = F.char_length(F.regexp_extract(s["txt"], r"^[\"'(\[{<,;:!?]*", 0))
        core = F.regexp_replace(F.regexp_replace(s["txt"], r"^[\"'(\[{<,;:!?]+", ""), r"[\"')\]}>,.;:!?]+$", "")
        return F.struct((s["start"] + lead).alias("start"), (s["start"] + lead + F.char_length(core)).alias("end"), core.alias("txt"), s["ctx"].alias("ctx"), s["nxt"].alias("nxt"))

    free = F.filter(F.col("word"), lambda w: ~F.exists(F.col("base"), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    free = F.filter(F.transform(free, trimmed), lambda w: w["txt"].contains("@") | (F.char_length(F.regexp_replace(w["txt"], "[^0-9]", "")) >= 4))
    return rows.select("doc_id", "at", "base", F.coalesce(free, F.array().cast(f"array<{SPAN}>")).alias("words"))


def _contexts(s: Column) -> Column:
    """The patterns of a span: the two words before it, the nearer one, the word after it, both sides, and its shape
    (digits as 9, runs of letters as a) alone, with the word before, at the start of a line, and with runs of digits as
    one where signs stand between them."""
    words, opens = F.replace(s["ctx"], F.lit("\n"), F.lit("")), s["ctx"].startswith("\n")
    near = F.substring_index(words, " ", -1)
    shape = F.regexp_replace(F.regexp_replace(s["txt"], "[0-9]", "9"), "[A-Za-z]+", "a")
    before = F.when(words != "", F.array(F.concat(F.lit("2 "), words), F.concat(F.lit("1 "), near), F.concat_ws(" ", F.lit("s"), near, shape)))
    after = F.when(s["nxt"] != "", F.array(F.concat(F.lit("r "), s["nxt"]), F.concat_ws(" ", F.lit("b"), near, s["nxt"])))
    line = F.when(opens, F.array(F.concat(F.lit("l "), shape)))
    rough = F.regexp_replace(shape, "9+", "9")
    rough = F.when(rough.rlike("[^9a]"), F.array(F.concat(F.lit("c "), rough)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("s "), shape)), *[F.coalesce(x, none) for x in (before, after, line, rough)]))


def _instances(found: DataFrame) -> DataFrame:
    """k (null for a word of no known kind), inst and pattern of every span of ``base_spans``."""
    seeds = found.select(F.explode("base").alias("s")).select(F.col("s.k").alias("k"), F.lower("s.txt").alias("inst"), _contexts(F.col("s")).alias("p"))
    words = found.select(F.explode("words").alias("s")).select(F.lit(None).cast("int").alias("k"), F.lower("s.txt").alias("inst"), _contexts(F.col("s")).alias("p"))
    return seeds.unionByName(words).select("k", "inst", F.explode("p").alias("pattern"))


def learn_patterns(found: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """pattern, k, confidence of the contexts that mark a kind, from the spans of ``base_spans``.

    A pattern's confidence is the sum of its instances' scores over their number plus two. Seeds score 1; other
    instances score the chance that one of their patterns is right, which later rounds pass on to further patterns.
    """
    return _learn(_instances(found), rounds, min_confidence, min_support)


def _learn(instances: DataFrame, rounds: int, min_confidence: float, min_support: int) -> DataFrame:
    edges = stage_table(instances.groupBy("pattern", "inst", "k").agg(F.count("*").alias("n")), "pii-edges")
    sizes = stage_table(edges.groupBy("pattern").agg(F.sum("n").alias("all")).where(F.col("all") >= min_support), "pii-sizes")
    edges = stage_table(salted_join(edges, sizes, ["pattern"], F.xxhash64("inst")), "pii-edges")  # a rare pattern can't be used
    known = edges.where("k IS NOT NULL").select("inst", "k").distinct().withColumn("score", F.lit(1.0))
    scores, patterns = known, None
    for _ in range(rounds):
        hits = salted_join(edges.select("pattern", "inst", "n"), scores, ["inst"], F.xxhash64("pattern")).groupBy("pattern", "k").agg(F.sum(F.col("n") * F.col("score")).alias("hit"))
        patterns = hits.join(sizes, "pattern").select("pattern", "k", (F.col("hit") / (F.col("all") + 2)).alias("confidence")).where(F.col("confidence") >= min_confidence)
        patterns = stage_table(patterns, "pii-patterns")
        met = salted_join(edges.select("pattern", "inst"), patterns.withColumnRenamed("k", "to"), ["pattern"], F.xxhash64("inst"))
        spread = met.groupBy("inst", F.col("to").alias("k")).agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score"))
        scores = known.unionByName(spread).groupBy("inst", "k").agg(F.max("score").alias("score"))
    return patterns


def _fitting() -> Column:
    """Whether a word txt could be an identifier of the kind k."""
    return reduce(lambda a, b: a | b, [(F.col("k") == n) & _shaped(n, F.col("txt")) for n in range(len(KINDS))])


def hidden_seeds(docs: DataFrame, modulus: int = 10, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """k, n_hidden, n_found, n_wrong: a check of the learned patterns on ``docs``.

    Of the different base entities one in ``modulus``, by a hash of their text, loses its kind before patterns are learned.
    n_found counts those of n_hidden spans that the patterns then give the kind back to, n_wrong those that get another.
    """
    found = stage_table(base_spans(docs), "pii-spans")
    seeds = found.select(F.explode("base").alias("s")).select(F.col("s.k").alias("real"), F.col("s.txt").alias("txt"), F.lower("s.txt").alias("inst"), _contexts(F.col("s")).alias("p"))
    hide = F.pmod(F.xxhash64("inst"), F.lit(modulus)) == 0
    seeds = stage_table(seeds.select("*", F.when(~hide, F.col("real")).alias("k"), F.monotonically_increasing_id().alias("at")), "pii-seeds")
    words = found.select(F.explode("words").alias("s")).select(F.lit(None).cast("int").alias("k"), F.lower("s.txt").alias("inst"), F.explode(_contexts(F.col("s"))).alias("pattern"))
    patterns = _learn(seeds.select("k", "inst", F.explode("p").alias("pattern")).unionByName(words), rounds, min_confidence, min_support)
    hidden = seeds.where("k IS NULL").select("at", "real", "txt", F.explode("p").alias("pattern"))
    best = salted_join(hidden, patterns, ["pattern"], F.xxhash64("at")).where(_fitting()).groupBy("at").agg(F.max(F.struct("confidence", -F.col("k"), F.col("k").alias("kind")))["kind"].alias("kind"))
    judged = seeds.where("k IS NULL").select("at", F.col("real").alias("k")).join(best, "at", "left")
    hit = F.coalesce(F.col("kind") == F.col("k"), F.lit(False))
    return judged.groupBy("k").agg(F.count("*").alias("n_hidden"), F.sum(hit.cast("long")).alias("n_found"), F.sum((F.col("kind").isNotNull() & ~hit).cast("long")).alias("n_wrong"))


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """doc_id, base and added for every row of ``docs`` (doc_id, text): sorted arrays of spans (start, k, end).

    Offsets count code points, ends are exclusive, k is the index into KINDS. Null and empty texts have no spans.
    Repeated rows each get the same spans. Other columns are not read.
    """
    found = stage_table(base_spans(docs), "pii-spans")
    patterns = learn_patterns(found, rounds, min_confidence, min_support)
    words = found.select("at", F.explode("words").alias("w")).select("at", "w.start", "w.end", "w.txt", F.explode(_contexts(F.col("w"))).alias("pattern"))
    hits = salted_join(words, patterns, ["pattern"], F.xxhash64("at", "start")).where(_fitting())
    best = hits.groupBy("at", "start", "end").agg(F.max(F.struct("confidence", -F.col("k"), F.col("k").alias("kind"))).alias("m"))
    added = best.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("start", F.col("m.kind").alias("k"), "end"))).alias("added"))
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    out = found.select("doc_id", "at", bare.alias("base")).join(added, "at", "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<start:int,k:int,end:int>>")).alias("added"))


def count_kind(spans: str, kind: int) -> Column:
    """How many of the spans are of the kind. The function given to ``filter`` takes one argument: a second one would be the index."""
    return F.size(F.filter(spans, lambda s: s["k"] == kind))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["k"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
