"""Benchmark decontamination by pieces and edit distance (operator 10).

An item that occurs with at most ``e`` edits, cut into ``e + 1`` pieces, has one piece left
unhurt.  All pieces of a block of items are looked for at once in each text, and around each
hit Myers' bit-parallel algorithm finds the smallest edit distance of the whole item to any
part of the text.  Texts and items are compared in lower case with single blanks.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.ngrams import columns
from canvass.llm.shared import by_text, prepare

#: Edits allowed for each character of an item, and characters of items sent to tasks at once.
RATE, BLOCK = 0.08, 8 << 20
HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()),
                  ("first", pa.int64()), ("last", pa.int64())])
HITS_SQL = "doc_id long, item_id long, distance int, first long, last long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length and their places."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def smallest_distance(item: str, text: str) -> tuple[int, int]:
    """The smallest edit distance of ``item`` to a part of ``text``, and where that part ends."""
    bits = {}
    for k, c in enumerate(item):
        bits[c] = bits.get(c, 0) | 1 << k
    top, full = 1 << (len(item) - 1), (1 << len(item)) - 1
    up, down, now = full, 0, len(item)
    best, end = now, 0
    for k, c in enumerate(text, 1):
        match = bits.get(c, 0)
        cross = (((match & up) + up) ^ up) | match | down
        plus, minus = down | ~(cross | up) & full, up & cross
        if plus & top:
            now += 1
        elif minus & top:
            now -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~((match | down) | plus) & full, plus & (match | down)
        if now < best:
            best, end = now, k
    return best, end


class Items:
    """Automaton over the pieces of items (id, normal text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(i, t, int(len(t) * rate)) for i, t in items]
        places: dict[str, list] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for at, piece in pieces_of(text, errors):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def found_in(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, first, last) of the closest occurrence of each item in a normal text."""
        if not len(self.automaton):
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, at in where:
                starts.setdefault(n, set()).add(end - size + 1 - at)
        out = []
        for n, guesses in starts.items():
            item, pattern, errors = self.items[n]
            best = (errors + 1, 0, 0)
            for low, high in joined(sorted(guesses), 2 * errors + len(pattern)):
                low, high = max(0, low - errors), min(len(text), high + len(pattern) + errors)
                exact = text.find(pattern, low, high)
                if exact >= 0:
                    found = (0, exact, exact + len(pattern))
                else:
                    distance, end = smallest_distance(pattern, text[low:high])
                    # the same from the right gives where the closest part begins
                    back = smallest_distance(pattern[::-1], text[low:low + end][::-1])[1] if distance <= errors else 0
                    found = (distance, low + end - back, low + end)
                best = min(best, found)
            if best[0] <= errors:
                out.append((item, *best))
        return out


def joined(starts: list[int], near: int) -> list[tuple[int, int]]:
    """Ranges of guesses, joined where their windows overlap."""
    ranges: list[tuple[int, int]] = []
    for s in starts:
        if ranges and s - ranges[-1][1] <= near:
            ranges[-1] = ranges[-1][0], s
        else:
            ranges.append((s, s))
    return ranges


def hits_of(items: list[tuple[int, str]], rate: float):
    def run(batches):
        known = Items(items, rate)
        for batch in batches:
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            yield columns([(i, *hit) for i, t in zip(ids, texts, strict=True) for hit in known.found_in(normal(t))], HITS)

    return run


def item_blocks(benchmark: DataFrame, block: int) -> list[list[tuple[int, str]]]:
    """The items in normal form, in blocks of at most ``block`` characters (or one item)."""
    parts, size = [[]], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        text = normal(text)
        if text:
            if size + len(text) > block and parts[-1]:
                parts.append([])
                size = 0
            parts[-1].append((item, text))
            size += len(text)
    return parts


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, distance, first and last of each item that a text holds.

    The edits allowed are ``rate`` times the item's length, rounded down; first and last
    delimit the closest, then leftmost, occurrence in the text's normal form (lower case,
    single blanks).  Items go to the tasks in blocks of at most ``block`` characters (or one
    item), and the texts are read once for each block.  NULL or blank items and texts match
    nothing; repeated rows of ``docs`` give repeated hits, repeated items count once.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    found = [rows.mapInArrow(hits_of(part, rate), HITS_SQL) for part in item_blocks(benchmark, block)]
    return reduce(DataFrame.unionByName, found)


def without_benchmarks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; see ``benchmark_hits``."""
    for part in item_blocks(benchmark, block):
        def clean(part=part):
            known = Items(part, rate)
            return lambda texts: [not known.found_in(normal(t)) for t in texts]

        docs = by_text(docs, clean, pa.bool_(), "boolean").filter("value").select("row.*")
    return docs
