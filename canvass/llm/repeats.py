"""Windows of tokens that also occur earlier, over all documents, and what remains without them.

Sparse prefix doubling, with one sort for each round:

1. Every document is cut into segments (``windows.segments``): runs of windows around the piece
   they elect, one for about 17 bytes.  Spark sorts (name of the piece, name of the whole
   segment, document, place).  Within a name the sort shows which segments repeat an earlier
   one, and which pieces are unique: those are settled.  Different segments around an equal
   piece are unclear, but only if the longer names left or right of the piece agree too,
   and then only their windows on that side.
2. The windows of unclear segments get names of their full length, the pair of two overlapping
   names, and are sorted once more.

Segments that repeat within a task are settled there and sent once, so a passage that a third
of all documents share sends as many rows to its sorting task as there are tasks, not documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.shared import prepare, stored
from canvass.llm.windows import LEFT, RIGHT, U, mix, names, segments

#: Fields of a row's place, from the right: windows after the first one, the elected piece's distance
#: from the first, the tag; what is left above them is the first window's start.
SPAN_BITS, AT_BITS, TAG_BITS = 6, 6, 20
SETTLED = (1 << SPAN_BITS) - 1
AT, TAG, FIRST = SPAN_BITS, SPAN_BITS + AT_BITS, SPAN_BITS + AT_BITS + TAG_BITS
#: Bytes of text named at once, segments settled at once in a task, rows compared at once.
BLOCK, FLUSH, LOT = 1 << 20, 1 << 20, 1 << 16
COVERED, UNCLEAR, WIDE = 0, 1, 2


@dataclass(frozen=True)
class Rule:
    """What a window is, and which other places count as earlier."""

    tokens: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    width: int
    piece: int
    within: bool  # an earlier start in the same document counts too
    group: int = 1 << 18  # rows around one piece to compare; more are left wide, for the next round


ROWS = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])
FOUND = pa.schema([("doc", pa.int64()), ("tag", pa.int32()), ("state", pa.int8()), ("key", pa.int64()),
                   ("first", pa.int64()), ("last", pa.int64())])
ROWS_SQL = "key long, content long, doc long, place long"
FOUND_SQL = "doc long, tag int, state tinyint, key long, first long, last long"


def byte_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0xD6E8FEB86659FD93  # any odd number with mixed bits


def word_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between blanks, as differences of one running polynomial."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = SPACES[joined]
    before = np.append(True, blank[:-1])
    start, end = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    scatter = mix(np.arange(256, dtype=U) * LEFT + RIGHT)
    total = np.zeros(len(joined) + 1, U)
    np.cumsum(scatter[joined] * powers(BASE, len(joined)), out=total[1:])
    back = powers(pow(BASE, -1, 1 << 64), len(joined))
    hashes = mix((total[end] - total[start]) * back[start] + (end - start).astype(U) * LEFT)
    edge = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(start, edge))


def powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, U)
    steps[:1] = 1
    return np.cumprod(steps, dtype=U)


def merged(first: np.ndarray, last: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where runs of adjoining windows begin, in (owner, first) order."""
    opens = np.ones(len(first), bool)
    opens[1:] = (owner[1:] != owner[:-1]) | (first[1:] > last[:-1] + 1)
    return opens


def settle(doc, first, content, within) -> np.ndarray:
    """For rows sorted by content, document and start: which have an earlier equal one."""
    opens = np.ones(len(content), bool)
    opens[1:] = content[1:] != content[:-1]
    head = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))
    return ~opens if within else doc > doc[head]


def ship(doc, tag, first, last, at, key, content, within) -> Iterator[pa.RecordBatch]:
    """Rows of one flush: segments still open, and merged runs of those settled here."""
    order = np.lexsort((first, doc, content))
    done = np.zeros(len(order), bool)
    done[order] = settle(doc[order], first[order], content[order], within)
    open_ = ~done
    place = first << FIRST | tag << TAG | (at - first) << AT
    yield pa.RecordBatch.from_arrays([pa.array(x[open_].view(np.int64)) for x in (
        key, content, doc, place | (last - first))], schema=ROWS)
    if done.any():
        order = np.flatnonzero(done)
        order = order[np.lexsort((first[order], tag[order], doc[order]))]
        d, t, f, e = doc[order], tag[order], first[order], last[order]
        opens = np.flatnonzero(merged(f, e, d << TAG_BITS ^ t))
        closes = np.append(opens[1:], len(order)) - 1
        spread = names(d[opens].view(U), [1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (
            spread, e[closes] - f[opens], d[opens], f[opens] << FIRST | t[opens] << TAG | SETTLED)], schema=ROWS)


def blocks(batches, rule: Rule):
    """Documents by blocks of tokens: ids, tags, other columns, tokens and lengths."""
    for batch in batches:
        ids, tags, texts = (batch.column(k) for k in range(3))
        texts, rest = texts.cast(pa.large_binary()).to_pylist(), batch.slice(0)
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
                size += len(texts[j])
                j += 1
            tokens, lengths = rule.tokens(texts[i:j])
            yield (ids.slice(i, j - i).to_numpy(), tags.slice(i, j - i).to_numpy().astype(np.int64),
                   rest.slice(i, j - i), tokens, lengths)
            i = j


def flushed(parts, within: bool):
    """Gather rows of a task and ship them in bounded lots."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= FLUSH:
            yield from ship(*map(np.concatenate, zip(*held, strict=True)), within)
            held, size = [], 0
    if held:
        yield from ship(*map(np.concatenate, zip(*held, strict=True)), within)


def segment_rows(rule: Rule):
    def run(batches):
        def parts():
            for ids, tags, _, tokens, lengths in blocks(batches, rule):
                s = segments(tokens, lengths, rule.width, rule.piece)
                key = s.anchor >> U(16) << U(16) | s.prints
                yield ids[s.owner], tags[s.owner], s.first, s.last, s.place, key, s.content

        yield from flushed(parts(), rule.within)

    return run


def window_rows(rule: Rule):
    """Windows of unclear segments, named one by one."""

    def run(batches):
        def parts():
            for ids, tags, rest, tokens, lengths in blocks(batches, rule):
                begin = np.cumsum(lengths) - lengths
                runs = rest.column(3)
                owner = np.repeat(np.arange(len(ids)), runs.value_lengths().to_numpy())
                spans = runs.flatten()
                first, last = (spans.field(k).to_numpy() for k in range(2))
                size = last - first + rule.width
                step = max(1, FLUSH // max(1, int(size.max(initial=1))))
                for i in range(0, len(owner), step):
                    o, f, n = owner[i:i + step], first[i:i + step], size[i:i + step]
                    at = np.cumsum(n) - n
                    index = np.arange(n.sum()) + np.repeat(begin[o] + f - at, n)
                    full = names(tokens[index], [rule.width])[0]
                    inside = np.arange(len(full)) - np.repeat(at, n)[:len(full)]
                    good = inside <= np.repeat(n, n)[:len(full)] - rule.width
                    start = (inside + np.repeat(f, n)[:len(full)])[good]
                    name, o = full[good], np.repeat(o, n)[:len(full)][good]
                    yield ids[o], tags[o], start, start, start, name >> U(16) << U(16), name

        yield from flushed(parts(), rule.within)

    return run


def lots(batches):
    held, size = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy() for k in range(4)]))
        size += batch.num_rows
        if size >= LOT:
            yield np.concatenate(held, axis=1)
            held, size = [], 0
    if held:
        yield np.concatenate(held, axis=1)


def compared(rule: Rule):
    """The sorting task: settle equal segments, tell unclear ones."""
    half = (rule.width - rule.piece + 1) // 2

    def group(rows: np.ndarray, give_up: bool):
        key, content, doc, place = rows
        span = place & SETTLED
        sent = span == SETTLED
        first = place >> FIRST
        tag = (place >> TAG & ((1 << TAG_BITS) - 1)).astype(np.int32)
        last = first + np.where(sent, content, span)
        anchor = key >> 16
        # settled runs travel with random keys and must not look like contents
        opens = np.ones(len(key), bool)
        opens[1:] = (content[1:] != content[:-1]) | (anchor[1:] != anchor[:-1]) | sent[1:] | sent[:-1]
        head = np.maximum.accumulate(np.where(opens, np.arange(len(key)), 0))
        covered = sent | (~opens if rule.within else doc > doc[head])
        unclear = np.zeros(len(key), bool)
        if give_up:
            unclear = ~covered
        else:
            rep = np.flatnonzero(opens & ~sent)
            new = np.ones(len(rep), bool)
            new[1:] = anchor[rep][1:] != anchor[rep][:-1]
            g = np.cumsum(new) - 1
            several = np.flatnonzero(np.bincount(g, minlength=len(new))[g] > 1)
            right, left = np.zeros((2, len(key)), bool)
            for side, shift in ((right, 0), (left, 8)):
                mark = key[rep[several]] >> shift & 255
                pair = g[several] << 8 | mark
                _, back, many = np.unique(pair, return_inverse=True, return_counts=True)
                side[rep[several[(mark > 0) & (many[back] > 1)]]] = True
            right, left = right[head], left[head]
            unclear = (right | left) & ~covered
            # with one side only, windows that reach far to the other one cannot be shared
            elected = first + (place >> AT & ((1 << AT_BITS) - 1))
            last = np.where(unclear & ~right, np.minimum(last, elected - half), last)
            first = np.where(unclear & ~left, np.maximum(first, elected - (rule.width - rule.piece - half)), first)
        keep = covered | unclear
        state = np.where(covered, COVERED, WIDE if give_up else UNCLEAR).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, tag, state, anchor, first, last)], schema=FOUND)

    def run(batches):
        rest, wild = np.zeros((4, 0), np.int64), None
        for rows in lots(batches):
            rows = np.concatenate([rest, rows], axis=1)
            anchor = rows[0] >> 16
            if wild is not None:  # the rest of a group too large to compare
                cut = np.searchsorted(anchor != wild, True)
                yield group(rows[:, :cut], True)
                rows, anchor = rows[:, cut:], anchor[cut:]
                wild = wild if not len(anchor) else None
            if not len(anchor):
                rest = rows
                continue
            cut = len(anchor) - np.searchsorted((anchor != anchor[-1])[::-1], True)
            yield group(rows[:, :cut], False)
            rest = rows[:, cut:]
            if rest.shape[1] > rule.group:
                yield group(rest, True)
                wild, rest = anchor[-1], rest[:, :0]
        yield group(rest, False)

    return run


def same_windows(rule: Rule):
    """The last sorting task: settle equal windows, however many; a lot knows the name the one before ended in."""

    def run(batches):
        known, known_doc = None, 0
        for key, content, doc, place in lots(batches):
            sent = place & SETTLED == SETTLED
            first = place >> FIRST
            tag = (place >> TAG & ((1 << TAG_BITS) - 1)).astype(np.int32)
            last = first + np.where(sent, content, 0)
            anchor, covered = key >> 16, sent.copy()
            a, c, d = anchor[~sent], content[~sent], doc[~sent]
            if len(c):
                opens = np.ones(len(c), bool)
                opens[1:] = (c[1:] != c[:-1]) | (a[1:] != a[:-1])
                opens[0] = known != (a[0], c[0])
                head = np.maximum.accumulate(np.where(opens, np.arange(len(c)), -1))
                head_doc = np.where(head < 0, known_doc, d[head])
                covered[~sent] = ~opens if rule.within else d > head_doc
                known, known_doc = (a[-1], c[-1]), head_doc[-1]
            state = np.full(len(key), COVERED, np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(x[covered]) for x in (doc, tag, state, anchor, first, last)], schema=FOUND)

    return run


def sorted_rows(rows: DataFrame) -> DataFrame:
    anchor = F.shiftright("key", 16)
    return rows.repartition(anchor).sortWithinPartitions(anchor, "content", "doc", "place")


def runs_of(found: DataFrame, *more: str) -> DataFrame:
    """Runs of each document as one sorted array; a document bounds its own."""
    return found.groupBy("doc", "tag").agg(F.array_sort(F.collect_list(F.struct("first", "last", *more))).alias("runs"))


def with_text(docs: DataFrame, runs: DataFrame, how: str = "inner") -> DataFrame:
    return docs.alias("d").join(runs.alias("r"), F.expr("d.doc_id = r.doc AND d.tag = r.tag"), how).select("d.*", "r.runs")


def usable(docs: DataFrame, rule: Rule) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= rule.width)).select("doc_id", "tag", "text")


def once(docs: DataFrame) -> DataFrame:
    """doc_id, tag and text; of rows equal in them one.  Only texts that are repeated move."""
    same = ["doc_id", "tag", "h0", "h1"]
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "tag", "text", *(F.xxhash64(F.lit(k), "text").alias(f"h{k}") for k in range(2)))
    repeated = stored(rows.groupBy(*same).count().filter("count > 1").drop("count"), "repeated")
    if not repeated.limit(1).count():
        return docs
    first = rows.join(repeated, same, "left_semi").dropDuplicates(same)
    return rows.join(repeated, same, "left_anti").unionByName(first).select("doc_id", "tag", "text")


def segment_round(docs: DataFrame, rule: Rule) -> DataFrame:
    """The first sort: covered and unclear segments."""
    prepare(docs.sparkSession)
    rows = usable(docs, rule).mapInArrow(segment_rows(rule), ROWS_SQL)
    return stored(sorted_rows(rows).mapInArrow(compared(rule), FOUND_SQL), "segments")


def window_round(docs: DataFrame, rule: Rule, unclear: DataFrame) -> DataFrame:
    """The second sort: covered windows of unclear segments."""
    rows = with_text(usable(docs, rule), runs_of(unclear)).mapInArrow(window_rows(rule), ROWS_SQL)
    return stored(sorted_rows(rows).mapInArrow(same_windows(rule), FOUND_SQL), "windows")


def tagged(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """doc_id, text (NULL as empty), a tag of the text that tells rows of one id apart, and the
    columns to keep, as one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tag = (F.crc32(text.cast("binary")) % (1 << TAG_BITS)).cast("int")
    return docs.select(F.col("doc_id").cast("long"), tag.alias("tag"), text.alias("text"), *([F.struct(*keep).alias("kept_columns")] if keep else []))


def union_of(first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs [begin, end) of windows from first to last, sorted by first."""
    end = np.maximum.accumulate(last + width)
    opens = np.ones(len(first), bool)
    opens[1:] = first[1:] > end[:-1]
    begin = np.flatnonzero(opens)
    return first[begin], end[np.append(begin[1:], len(first)) - 1]
