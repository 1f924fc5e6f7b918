"""Phrase collocations by SON partitioning (operator 12).

A phrase of 2 to 4 words counts as often as it occurs inside pieces, per language.  SON mines in two steps:

1. The documents fall into shards.  A shard that holds the share x of a language's words is mined
   completely at the support ``x * SUPPORT``, rounded up: were a phrase below that in every shard, it
   would be below ``SUPPORT`` in all.  Words and pairs of a shard are counted first, then longer
   phrases all of whose pairs are frequent in the shard.
2. The union of the locally frequent phrases is counted once more over all shards, by their
   text, exactly; those below ``SUPPORT`` go.

Tasks count the phrases of a lot of words by 64-bit names before Spark adds them up, so a hot
text or word sends one row per lot.  Names only choose candidates: sets of them travel as Bloom
filters of a fixed size (``FILTER_BITS``), whose errors let more phrases through and never fewer, and two
phrases of one name would only be counted together in step 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.repeats import BASE, powers
from canvass.llm.shared import prepare, stored
from canvass.llm.windows import LEFT, RIGHT, U, mix, paired

LONGEST, SUPPORT, TOP = 4, 30, 2000
#: A longer phrase that has this percentage of a candidate's occurrences makes the candidate go.
HELD_PERCENT = 80
SCALE = 2_000_000
SHARDS = 8
#: Bytes of text whose phrases a task counts at once.
LOT = 4 << 20
FILTER_BITS, BITMAP = 27, 1 << 15
#: A name sets the bits that two ranges of its own bits number.
SHIFTS = (64 - FILTER_BITS, 64 - 2 * FILTER_BITS)
#: Rows of (language, shard) that are sent to all tasks; more are joined by Spark's own choice.
SMALL = 1 << 16
COUNTED = pa.schema([("level", pa.int8()), ("grp", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])
COUNTED_SQL = "level tinyint, grp long, key long, n long"
PHRASES = pa.schema([("lang", pa.string()), ("size", pa.int8()), ("phrase", pa.string()), ("n", pa.int64())])
PHRASES_SQL = "lang string, size tinyint, phrase string, n long"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
# What parts words, and what parts pieces.
BLANK, STOP = b" \t", b".,;:!?\n\x0b\x0c\r"
SCATTER = mix(np.arange(256, dtype=U) * LEFT + RIGHT)
#: Bytes hashed at once.
HASHED = 1 << 19
KIND = np.zeros(256, np.uint8)
KIND[list(BLANK)] = 1
KIND[list(STOP)] = 2


def hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A name of each word, whatever its place: differences of a running polynomial, over a block of the text at a time."""
    out, i = np.zeros(len(start), U), 0
    while i < len(start):
        first = start[i]
        j = max(i + 1, np.searchsorted(end, first + HASHED, side="right"))
        total = np.zeros(end[j - 1] - first + 1, U)
        np.cumsum(SCATTER[text[first:end[j - 1]]] * powers(BASE, len(total) - 1), out=total[1:])
        back = powers(pow(BASE, -1, 1 << 64), len(total))
        low, high = start[i:j] - first, end[i:j] - first
        out[i:j] = mix((total[high] - total[low]) * back[low] + (high - low).astype(U) * LEFT)
        i = j
    return out


class Lot:
    """The words of some texts: their names, places, pieces and texts; each text has a language's name and a group's."""

    def __init__(self, texts: list[bytes], langs: list[int], groups: list[int]):
        self.joined = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = KIND[self.joined]
        gap = kind > 0
        before = np.append(True, gap[:-1])
        self.start, self.end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        self.words = hashes(self.joined, self.start, self.end)
        self.piece = np.cumsum(kind == 2)[self.start]
        edge = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.start, edge)))
        self.lang, self.group = (np.array(x, np.int64).view(U)[self.text] for x in (langs, groups))

    def names(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the phrases of this many words within pieces, and their names, which hold the language."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        name = self.words
        for k in range(1, size):
            name = paired(name[:n], self.words[k:k + n])
        at = np.flatnonzero(self.piece[:n] == self.piece[size - 1:])
        return at, mix(name[at] ^ (self.lang[at] * RIGHT + U(size)))

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        """The texts of phrases, their words parted by one space."""
        whole, low, high = self.joined.tobytes(), self.start[at], self.end[at + size - 1]
        found = [whole[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True)]
        # places where two words are parted by anything else
        odd = np.append(0, np.cumsum((self.start[1:] - self.end[:-1] != 1) | (self.joined[self.end[:-1]] != 32)))
        for k in np.flatnonzero(odd[at + size - 1] > odd[at]).tolist():
            found[k] = re.sub(b"[ \t]+", b" ", found[k])
        return pa.array(found, pa.binary()).cast(pa.string())


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list, list, list]]:
    """Texts of about ``LOT`` bytes, with their language, its name and their group; longer texts are cut where a piece ends."""
    rows, size = [], 0
    for batch in batches:
        for text, *tags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rest = text.encode()
            while rest:
                part, rest = cut(rest)
                rows.append((part, *tags))
                size += len(part)
                if size >= LOT:
                    yield tuple(map(list, zip(*rows, strict=True)))
                    rows, size = [], 0
    if rows:
        yield tuple(map(list, zip(*rows, strict=True)))


def cut(text: bytes) -> tuple[bytes, bytes]:
    if len(text) <= LOT:
        return text, b""
    found = max(text.rfind(bytes([s]), 0, LOT) for s in STOP)
    if found < 0:  # one piece longer than a lot stays whole
        later = re.compile(b"[" + re.escape(STOP) + b"]").search(text, LOT)
        found = later.start() if later else len(text) - 1
    return text[:found + 1], text[found + 1:]


def has(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which names the filter lets through."""
    found = np.ones(len(names), bool)
    for shift in SHIFTS:
        place = (names >> U(shift)) & U((1 << FILTER_BITS) - 1)
        found &= (bits[place >> U(3)] >> (place & U(7)).astype(np.uint8)) & 1 == 1
    return found


def filter_of(keys: DataFrame) -> np.ndarray:
    """The filter of the names in ``key``: Spark sets the bits, and only bitmaps of a fixed size reach the driver."""
    places = F.array(*(F.shiftrightunsigned("key", s).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1 for s in SHIFTS))
    maps = keys.select(F.explode(places).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    whole, size = bytearray(1 << (FILTER_BITS - 3)), BITMAP // 8
    for row in maps.toLocalIterator():  # at most 2**FILTER_BITS / BITMAP rows
        whole[(row["bucket"] - 1) * size:row["bucket"] * size] = row["bits"]
    return np.frombuffer(bytes(whole), np.uint8)


def counted(level: int, name: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    """How often each phrase of a lot occurs in each group."""
    _, first, n = np.unique(name ^ mix(group), return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(n), level, np.int8)), pa.array(group[first].view(np.int64)), pa.array(name[first].view(np.int64)),
        pa.array(n.astype(np.int64))], schema=COUNTED)


def mined(rows: DataFrame, offered: Callable[[Lot], Iterator[tuple[int, np.ndarray, np.ndarray]]], limits: DataFrame) -> DataFrame:
    """(level, grp, key) of the phrases that reach their group's support; ``offered`` gives those of a lot: size, starts and names."""

    def run(batches):
        for texts, _, langs, groups in lots(batches):
            lot = Lot(texts, langs, groups)
            for size, at, name in offered(lot):
                yield counted(size, name, lot.group[at])

    sums = rows.select("text", "lang", "name", "grp").mapInArrow(run, COUNTED_SQL).groupBy("level", "grp", "key").agg(F.sum("n").alias("n"))
    return sums.join(limits, "grp").filter(F.col("n") >= F.col("least")).select("level", "grp", "key")


def shard_of_file() -> Column:
    """Documents of one file are of one shard, so what a task reads is counted together."""
    return F.pmod(F.xxhash64(F.input_file_name()), F.lit(SHARDS))


def frequent(docs: DataFrame, support: int = SUPPORT, shard: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all words and phrases that occur ``support`` times in ``docs``, and (lang, n)."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit("und")).alias("lang"),
                       (shard_of_file() if shard is None else shard).alias("shard"))
    rows = rows.select("text", "lang", F.xxhash64("lang").alias("name"), F.xxhash64("lang", "shard").alias("grp"))
    words = F.size(F.filter(F.split("text", r"[\x20\x09.,;:!?\x0A-\x0D]+"), lambda w: w != "")).cast("long")
    totals = stored(rows.groupBy("lang", "grp").agg(F.sum(words).alias("words")), "totals")
    sums = totals.groupBy("lang").agg(F.sum("words").alias("n")).filter("n > 0")
    share = totals.join(sums, "lang").select("grp", F.col("words").cast("decimal(38,0)").alias("words"), F.col("n").cast("decimal(38,0)").alias("n"))
    limits = share.groupBy("grp").agg(F.min(F.expr(f"(words * {support} + n - 1) DIV n")).alias("least"))
    if totals.count() <= SMALL:
        limits = F.broadcast(limits)

    def short(lot):
        for size in (1, 2):
            yield size, *lot.names(size)

    first = stored(mined(rows, short, limits), "pairs")
    of_group = first.filter("level = 2").select(F.col("key").bitwiseXOR(F.col("grp")).alias("key"))
    pairs = spark.sparkContext.broadcast(filter_of(of_group))  # of a fixed size

    def longer(lot):
        at, name = lot.names(2)
        known = np.zeros(len(lot.words) + LONGEST, bool)
        known[at] = has(pairs.value, name ^ lot.group[at])
        for size in range(3, LONGEST + 1):
            at, name = lot.names(size)
            fit = reduce(np.logical_and, [known[at + k] for k in range(size - 1)])
            yield size, at[fit], name[fit]

    second = stored(mined(rows, longer, limits), "longer")
    union = spark.sparkContext.broadcast(filter_of(first.select("key").unionByName(second.select("key"))))  # of a fixed size

    def exact(batches):
        for texts, tags, langs, groups in lots(batches):
            lot = Lot(texts, langs, groups)
            for size in range(1, LONGEST + 1):
                at, name = lot.names(size)
                keep = has(union.value, name)
                _, where, n = np.unique(name[keep], return_index=True, return_counts=True)
                starts = at[keep][where]
                yield pa.RecordBatch.from_arrays([
                    pa.array(tags, pa.string()).take(pa.array(lot.text[starts])), pa.array(np.full(len(n), size, np.int8)),
                    lot.phrases(starts, size), pa.array(n.astype(np.int64))], schema=PHRASES)

    found = rows.mapInArrow(exact, PHRASES_SQL).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f"))
    return stored(found.filter(F.col("f") >= support), "phrases"), sums


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of the lowest-scoring cut of each phrase of two words or more."""
    parts = F.split("phrase", " ")
    cuts = phrases.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), parts.alias("words"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    joined = lambda first, many: F.array_join(F.slice("words", first, many), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"),
                       joined(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * {SCALE}) DIV (CAST(l AS DECIMAL(20,0)) + r)").alias("score")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def within_longer(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the most frequent phrase that holds each phrase's words and more."""
    longer = phrases.filter("size > 2").withColumn("words", F.split("phrase", " "))
    inner = F.expr("""flatten(transform(sequence(2, size - 1), many -> transform(
        sequence(1, size - many + 1), first -> array_join(slice(words, first, many), ' '))))""")
    return longer.select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, shard: Column | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases.

    Texts are lower-cased from A to Z only and cut into pieces and words; NULL texts are empty, rows without lang
    are of the language ``und``.  Ties of score and count are ranked by phrase, in byte order.  Repeated rows
    count each; further columns are ignored; a text longer than a lot is cut where pieces end.
    ``shard`` tells the shard of a row; by default a file's rows are of one.
    """
    phrases, sums = frequent(docs, support, shard)
    held = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * HELD_PERCENT
    kept = scored(phrases).join(within_longer(phrases), ["lang", "phrase"], "left").filter(~F.coalesce(held, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
