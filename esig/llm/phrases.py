"""Phrase collocations by tiles of pairs of ranked ids.

Words are numbered by falling frequency within their language, and a text is the row of its words' numbers. A phrase
of two words is a pair of numbers; a pair falls into a tile of ``TILE`` by ``TILE`` numbers. Tiles that many pairs
fall into, those of frequent words, are counted by their cell in a dense array; the pairs of all other tiles are
sorted and counted as coordinates. Frequent pairs are numbered by falling frequency again, and two neighbouring pairs
that overlap in a word are a phrase of three words: the same count on pairs of the new numbers, and so on. A phrase can
only be frequent if both phrases it overlaps from are, so every level loses no phrase.

Texts are cut into chunks of tokens of one language. A chunk has its own dictionary of what is in it (words, then
pairs), cut into bands by a hash of the entry. A band of all chunks is added up in one task, which knows the frequent
entries and the chunks that hold them; once these are numbered, only their numbers go back to the chunks. Entries travel
as packed arrays, in bands of bounded size: a frequent entry comes once from each chunk. No dictionary of the corpus is
broadcast or held by a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import stage_table

#: Tokens of a chunk, after which it is closed; the text that reaches it is whole.
CHUNK = 1 << 20
#: Numbers on a side of a tile, and the share of its cells from which pairs are counted densely.
TILE, DENSE = 256, 0.25
#: Bands at least, and what a band of words (in characters of text) and of phrases (in occurrences) is cut for.
BANDS, BAND_CHARS, BAND_PHRASES = 16, 1 << 26, 1 << 22
#: Groups in which candidates are ranked before the language is.
RANK_GROUPS = 64
#: Bytes that end a piece of a text; no UTF-8 text holds the byte that stands for them.
ENDS, END = b".,;:!?\n\x0b\x0c\r", b"\xff"
_TO_END = bytes.maketrans(ENDS, END * len(ENDS))
#: A chunk is a row of band -1 with its codes (places in its dictionary, -1 between pieces) and the size of that, and one
#: row for each band with the band's entries: their keys, how often each occurs, and its place.
PIECES = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("band", pa.int32()), ("codes", pa.binary()), ("size", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])
PIECES_SQL = "chunk bigint, lang string, band int, codes binary, size int, keys binary, counts binary, places binary"


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, low ones first, behind one byte with their number; empty planes compress to nothing."""
    width = 4 if not len(x) or -(1 << 31) <= x.min() and x.max() < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1).T).view(f"<i{b[0]}").ravel().astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted numbers by their steps, or words by the line ends that no word holds."""
    return "\n".join(keys).encode() if keys.dtype == object else pack(np.diff(keys, prepend=0))


def unpack_keys(b: bytes, words: bool) -> np.ndarray:
    return np.array(b.decode().split("\n") if b else [], dtype=object) if words else np.cumsum(unpack(b))


def in_pieces(chunk: int, lang: str, codes: np.ndarray, keys: np.ndarray, counts: np.ndarray, bands: int) -> pa.RecordBatch:
    """The rows of a chunk."""
    rows = [(chunk, lang, -1, pack(codes), len(keys), None, None, None)]
    band = pd.util.hash_array(keys, categorize=False) % np.uint64(bands)
    order = np.argsort(band, kind="stable") if keys.dtype == object else np.lexsort((keys, band))
    for at in np.split(order, np.cumsum(np.bincount(band.astype(np.int64), minlength=bands))[:-1]):
        if len(at):
            rows.append((chunk, lang, int(band[at[0]]), None, None, pack_keys(keys[at]), pack(counts[at]), pack(at)))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, and ``END`` wherever a piece ends."""
    return (text or "").encode().lower().translate(_TO_END).replace(END, b" " + END + b" ").split()


def count_pairs(one: np.ndarray, two: np.ndarray, tile: int = TILE, dense: float = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs as keys (one << 32 | two), how often each occurs, and the place of each given pair among them."""
    keys = one.astype(np.int64) << 32 | two
    if not len(keys):
        return keys, keys, keys
    home = (one // tile).astype(np.int64) << 32 | (two // tile)
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(home[order]) != 0, True])
    crowded = np.diff(cuts) >= dense * tile * tile
    at, found, times, n = np.empty(len(keys), np.int64), [], [], 0
    for k in np.flatnonzero(crowded):
        here = order[cuts[k] : cuts[k + 1]]
        cell = one[here] % tile * tile + two[here] % tile
        hits = np.bincount(cell, minlength=tile * tile)
        full = np.flatnonzero(hits)
        place = np.empty(tile * tile, np.int64)
        place[full] = np.arange(n, n + len(full))
        at[here] = place[cell]
        row, col = (int(x) * tile for x in divmod(int(home[here[0]]), 1 << 32))
        found.append((row + full // tile) << 32 | (col + full % tile))
        times.append(hits[full])
        n += len(full)
    rest = order[np.repeat(~crowded, np.diff(cuts))]
    sparse, inverse, hits = np.unique(keys[rest], return_inverse=True, return_counts=True)
    at[rest] = inverse + n
    return np.concatenate([*found, sparse]), np.concatenate([*times, hits]).astype(np.int64), at


def neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, keys, counts) of the pairs of neighbours in ``ids``, where -1 is a gap; runs of gaps become one."""
    whole = (ids[:-1] >= 0) & (ids[1:] >= 0)
    keys, times, at = count_pairs(ids[:-1][whole], ids[1:][whole])
    codes = np.full(len(whole), -1, np.int64)
    codes[whole] = at
    stay = whole | np.r_[False, whole[:-1]]
    return codes[stay].astype(np.int32), keys, times


def cut_chunks(docs: DataFrame, bands: int, size: int = CHUNK) -> DataFrame:
    """The pieces of the chunks of ``docs`` (lang, text); keys are words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = count(), TaskContext.get().partitionId() << 33
        books: dict[str, defaultdict] = {}
        codes: dict[str, list[np.ndarray]] = defaultdict(list)
        held: dict[str, int] = defaultdict(int)

        def close(lang: str) -> pa.RecordBatch:
            every = np.concatenate(codes.pop(lang))
            book = books.pop(lang)
            del held[lang]
            end = book.pop(END)
            every[every == end] = -1
            every = np.where(every > end, every - 1, every)
            times = np.bincount(every[every >= 0], minlength=len(book))
            return in_pieces(part + next(number), lang, every, np.array([w.decode() for w in book], dtype=object), times, bands)

        for b in batches:
            for i in range(b.num_rows):
                lang, words = b.column(0)[i].as_py(), tokens(b.column(1)[i].as_py())
                if lang not in books:
                    books[lang] = defaultdict(count().__next__)
                book = books[lang]
                words.append(END)
                codes[lang].append(np.fromiter(map(book.__getitem__, words), np.int32, len(words)))
                held[lang] += len(words)
                if held[lang] >= size:
                    yield close(lang)
                elif sum(held.values()) >= 3 * size:
                    yield close(max(held, key=held.__getitem__))
        for lang in sorted(codes):
            yield close(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES_SQL)


MERGED = pa.schema([("lang", pa.string()), ("band", pa.int32()), ("total", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("chunks", pa.binary()), ("owners", pa.binary()), ("places", pa.binary())])


def merge_bands(pieces: DataFrame, least: int, words: bool) -> DataFrame:
    """One row per language and band: total (all occurrences), keys and counts of the entries that occur ``least`` times or
    more, and the chunks that hold these, each with the entry it holds (owners) and the place in its dictionary."""

    def run(key: tuple, g: pa.Table) -> pa.Table:
        keys = [unpack_keys(b, words) for b in g["keys"].to_pylist()]
        sizes = [len(k) for k in keys]
        n, places = (np.concatenate([unpack(b) for b in g[c].to_pylist()]) for c in ("counts", "places"))
        which, every = pd.factorize(np.concatenate(keys), sort=not words)
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, which, n)
        stay = sums >= least
        number = np.cumsum(stay) - 1
        live = stay[which]
        data = [key[0].as_py(), key[1].as_py(), int(n.sum()), pack_keys(every[stay]), pack(sums[stay]), pack(np.repeat(g["chunk"].to_numpy(), sizes)[live]), pack(number[which[live]]), pack(places[live])]
        return pa.table([pa.array([x], f.type) for x, f in zip(data, MERGED, strict=True)], schema=MERGED)

    rows = pieces.where("band >= 0").select("lang", "band", "chunk", "keys", "counts", "places")
    return rows.groupBy("lang", "band").applyInArrow(run, "lang string, band int, total bigint, keys binary, counts binary, chunks binary, owners binary, places binary")


def frequent_entries(merged: DataFrame, words: bool) -> DataFrame:
    """lang, band, key, n of the frequent entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, band, keys, counts in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                key, n = unpack_keys(keys, words), unpack(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([band] * len(n), pa.int32()), pa.array(key, pa.string() if words else pa.int64()), pa.array(n)], names=["lang", "band", "key", "n"])

    return merged.select("lang", "band", "keys", "counts").mapInArrow(run, f"lang string, band int, key {'string' if words else 'bigint'}, n bigint")


def next_chunks(pieces: DataFrame, merged: DataFrame, ranks: DataFrame, words: bool, bands: int) -> DataFrame:
    """The pieces one level up: what is in ``ranks`` (lang, band, key, id) is replaced by its number, neighbours become pairs."""
    KNOWN = pa.schema([("chunk", pa.int64()), ("places", pa.binary()), ("ids", pa.binary())])

    def give(m: pa.Table, r: pa.Table) -> pa.Table:
        """The numbers of a band's entries to the chunks that hold them."""
        if not m.num_rows or not r.num_rows:
            return KNOWN.empty_table()
        row = m.slice(0, 1).to_pylist()[0]
        ids = pd.Series(r["id"].to_numpy(), index=pd.Index(r["key"].to_pandas())).reindex(unpack_keys(row["keys"], words)).to_numpy().astype(np.int64)
        chunks, owners, places = (unpack(row[c]) for c in ("chunks", "owners", "places"))
        order = np.argsort(chunks, kind="stable")
        cuts = np.flatnonzero(np.diff(chunks[order])) + 1
        parts = [at for at in np.split(order, cuts) if len(at)]
        return pa.table([pa.array(c, f.type) for c, f in zip(([int(chunks[at[0]]) for at in parts], [pack(places[at]) for at in parts], [pack(ids[owners[at]]) for at in parts]), KNOWN, strict=True)], schema=KNOWN)

    known = merged.groupBy("lang", "band").cogroup(ranks.select("lang", "band", "key", "id").groupBy("lang", "band")).applyInArrow(give, "chunk bigint, places binary, ids binary")
    known = known.groupBy("chunk").agg(F.collect_list(F.struct("places", "ids")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                table = np.full(b.column(3)[i].as_py() + 1, -1, np.int64)  # its last place stands for gaps
                for k in b.column(4)[i].as_py():
                    table[unpack(k["places"])] = unpack(k["ids"])
                codes, keys, times = neighbours(table[unpack(b.column(2)[i].as_py())])
                if len(keys):
                    yield in_pieces(b.column(0)[i].as_py(), b.column(1)[i].as_py(), codes, keys, times, bands)

    both = pieces.where("band = -1").select("chunk", "lang", "codes", "size").join(known, "chunk")
    return both.mapInArrow(run, PIECES_SQL)


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (lang, band, key, n) with id, their place by falling n and then key within the language, from 0.

    Rows are dealt out in this order and numbered in their task; the number of rows in the tasks before is added.
    """
    sort = [F.col("lang"), F.col("n").desc(), F.col("key")]
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            place = []
            for lang in b.column(0).to_pylist():
                last, n = lang, n + 1 if lang == last else 0
                place.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], names=[*b.schema.names, "place"])

    kind = dict(rows.dtypes)["key"]
    placed = stage_table(dealt.select("lang", "band", "key", "n", "part").mapInArrow(run, f"lang string, band int, key {kind}, n bigint, part int, place bigint"), "phrase-ranks")
    parts = placed.groupBy("lang", "part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("part")) - F.col("size")
    return placed.join(parts.select("lang", "part", before.alias("before")), ["lang", "part"]).select("lang", "band", "key", "n", (F.col("before") + F.col("place")).alias("id"))


def frequent_phrases(docs: DataFrame, min_count: int = 100, max_words: int = 5, chunk: int = CHUNK) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with all words of each language, and one table for each number of words up to ``max_words``.

    These hold the phrases that occur ``min_count`` times or more: lang, id, words, n, starts (occurrences of its first 1,
    2, ... words) and ends (those of its last 1, 2, ... words), and from two words on one and two, the ids of the phrases
    without its last and without its first word.
    """
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    pieces, levels, sizes = stage_table(cut_chunks(docs, max(BANDS, chars // BAND_CHARS), chunk), "phrase-pieces"), [], None
    for k in range(1, max_words + 1):
        merged = stage_table(merge_bands(pieces, min_count, k == 1), f"phrase-bands-{k}")
        if k == 1:
            sizes = stage_table(merged.groupBy("lang").agg(F.sum("total").alias("size")), "phrase-sizes")
        ranks = stage_table(ranked(stage_table(frequent_entries(merged, k == 1), "phrase-frequent")), f"phrase-ids-{k}")
        if k == 1:
            level = ranks.select("lang", "id", F.array("key").alias("words"), "n", F.array("n").alias("starts"), F.array("n").alias("ends"))
        else:
            one = levels[-1].select("lang", F.col("id").alias("one"), F.col("words").alias("w1"), "starts", F.col("n").alias("n1"))
            two = levels[-1].select("lang", F.col("id").alias("two"), F.element_at("words", -1).alias("w2"), "ends", F.col("n").alias("n2"))
            pairs = ranks.select("lang", "id", F.shiftright("key", 32).alias("one"), F.col("key").bitwiseAND((1 << 32) - 1).alias("two"), "n")
            grow = lambda c, x: F.concat(c, F.array(x))
            level = pairs.join(one, ["lang", "one"]).join(two, ["lang", "two"])
            level = level.select("lang", "id", grow("w1", "w2").alias("words"), "n", grow("starts", "n").alias("starts"), grow("ends", "n").alias("ends"), "one", "two", "n1", "n2")
        levels.append(stage_table(level, f"phrase-level-{k}"))
        if k < max_words:
            live = ranks.agg(F.sum("n")).first()[0] or 0
            pieces = stage_table(next_chunks(pieces, merged, ranks, k == 1, max(BANDS, live // BAND_PHRASES)), f"phrase-pieces-{k + 1}")
    return sizes, levels


def collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language of ``docs`` (lang, text) by score.

    Texts have A-Z lower-cased and are split into pieces at ``[.,;:!?]`` and line ends, and these into words at spaces
    and tabs. Candidates are phrases of 2 to ``max_words`` words that occur a >= ``min_count`` times within pieces. Of all
    cuts into a first part and a rest, which occur l and r times, the one with the smallest floor(1000 * a * n / (l * r))
    counts, the earliest on a tie; n is the number of words of the language. A candidate inside a longer one that occurs
    as often is dropped. Ties in score go to the larger a, then by the bytes of the phrase.

    A null lang is ``und``; null and empty texts have no words. Repeated rows count again. Other columns aren't read.
    Counts are exact longs and products exact decimals.
    """
    sizes, levels = frequent_phrases(docs, min_count, max_words, chunk)
    found = []
    for k in range(1, len(levels)):
        rows = levels[k]
        if k + 1 < len(levels):
            longer = levels[k + 1]
            inside = longer.where("n = n1").select("lang", F.col("one").alias("id")).unionByName(longer.where("n = n2").select("lang", F.col("two").alias("id")))
            rows = rows.join(inside, ["lang", "id"], "left_anti")
        found.append(rows.select("lang", F.concat_ws(" ", "words").alias("phrase"), F.col("n").alias("a"), "starts", "ends"))
    rows = reduce(DataFrame.unionByName, found).join(sizes.withColumnRenamed("size", "n"), "lang")
    rows = rows.select("lang", "phrase", "a", "n", F.expr(LOWEST_CUT).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    for group in (F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS)), F.lit(0)):  # first within groups, so that no task ranks all candidates of a language
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", group).orderBy(*best))).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The smallest score of all cuts of a phrase, the earliest on a tie, in decimals of 38 digits.
LOWEST_CUT = """array_min(transform(sequence(1, size(starts) - 1), k -> named_struct(
  'score', CAST(1000 AS DECIMAL(38, 0)) * a * n div (CAST(starts[k - 1] AS DECIMAL(38, 0)) * ends[size(ends) - k - 1]),
  'k', k, 'l', starts[k - 1], 'r', ends[size(ends) - k - 1])))"""

PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, row_number() OVER () AS d, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, d, unnest(w) AS w, unnest(range(len(w))) AS p FROM lists),
sizes AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
ahead AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5 FROM words WINDOW o AS (PARTITION BY lang, d ORDER BY p)),
f AS (
  SELECT lang, [w1] AS w, count(*) AS f FROM ahead GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2], count(*) FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM ahead WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5], count(*) FROM ahead WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
inside AS (
  SELECT DISTINCT s.lang, s.w FROM f b, unnest(range(1, len(b.w) + 1)) AS x(i), unnest(range(1, len(b.w) + 1)) AS y(j), f s
  WHERE s.lang = b.lang AND s.w = b.w[i:j] AND j - i + 1 < len(b.w) AND 100 * b.f >= 100 * s.f),
cuts AS (
  SELECT c.lang, c.w, c.f AS a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM f c ANTI JOIN inside i ON i.lang = c.lang AND i.w = c.w JOIN sizes USING (lang), unnest(range(1, len(c.w))) AS t(k)
  JOIN f l ON l.lang = c.lang AND l.w = c.w[1:k] JOIN f r ON r.lang = c.lang AND r.w = c.w[k + 1:]),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, k) AS o FROM cuts),
ranked AS (SELECT *, array_to_string(w, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank FROM low WHERE o = 1)
SELECT lang, rank::INTEGER AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
