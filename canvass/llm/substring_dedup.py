"""Removal of word passages that occur earlier (operator 3).

Documents are matched by suffix automata of reference shards.  A shard holds the segments of
all documents around one elected piece (``repeats``): only these can share a window, so a
document is streamed through the shards of its own pieces and not through all of them, which
would cost documents times shards.  In a shard the segments come in the order of their
documents; each is matched against the automaton of those before it, and windows of which the
matching statistic reaches the width are covered.  Segments equal as a whole, and pieces that
are unique or whose longer neighbourhoods differ, are settled by the sort before.  A shard
of more than ``SHARD`` segments that reaches beyond the rows compared at once is settled by
window names, which spread over all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.automaton import SuffixAutomaton
from canvass.llm.repeats import (
    COVERED, FOUND, FOUND_SQL, UNCLEAR, WIDE, Rule, blocks, once, runs_of, segment_round, tagged, union_of, usable,
    window_round, with_text, word_tokens,
)
from canvass.llm.shared import stored

WIDTH, PIECE, SHARD = 20, 6, 1 << 9
RULE = Rule(word_tokens, WIDTH, PIECE, within=True, group=SHARD)
SEGMENT = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()), ("first", pa.int64()),
                     ("words", pa.list_(pa.int64()))])
SEGMENT_SQL = "key long, doc long, tag int, first long, words array<long>"
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def segment_words(rule: Rule):
    """The words of each unclear segment, as hashes."""

    def run(batches):
        for ids, tags, rest, tokens, lengths in blocks(batches, rule):
            begin = np.cumsum(lengths) - lengths
            runs = rest.column("runs")
            owner = np.repeat(np.arange(len(ids)), runs.value_lengths().to_numpy())
            first, last, key = (runs.flatten().field(k).to_numpy() for k in range(3))
            size = last - first + rule.width
            at = np.cumsum(size) - size
            index = np.arange(size.sum()) + np.repeat(begin[owner] + first - at, size)
            words = pa.ListArray.from_arrays(pa.array(np.append(at, size.sum()), pa.int32()), pa.array(tokens[index].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[owner]), pa.array(tags[owner].astype(np.int32)),
                                              pa.array(first), words], schema=SEGMENT)

    return run


def matched(width: int):
    """Covered windows of the segments of each shard, which come sorted by document and start."""

    def run(batches):
        shard, known = None, SuffixAutomaton()
        for batch in batches:
            out = []
            for key, doc, tag, first, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != shard:
                    shard, known = key, SuffixAutomaton()
                ends = [i for i, n in enumerate(known.matching(words)) if n >= width]
                out += [(doc, tag, COVERED, key, first + i + 1 - width, first + i + 1 - width) for i in ends]
                if len(ends) <= len(words) - width:  # something new
                    known.add(words)
            columns = list(zip(*out, strict=True)) or [[]] * len(FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, FOUND, strict=True)], schema=FOUND)

    return run


def shard_round(docs: DataFrame, rule: Rule, unclear: DataFrame) -> DataFrame:
    rows = with_text(usable(docs, rule), runs_of(unclear, "key")).mapInArrow(segment_words(rule), SEGMENT_SQL)
    shards = rows.repartition("key").sortWithinPartitions("key", "doc", "tag", "first")
    return stored(shards.mapInArrow(matched(rule.width), FOUND_SQL), "matches")


def repeated_windows(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc, tag, runs): starts of the windows that also start earlier."""
    docs = once(docs)
    found = segment_round(docs, rule)
    covered = found.filter(F.col("state") == COVERED)
    covered = covered.unionByName(shard_round(docs, rule, found.filter(F.col("state") == UNCLEAR)))
    covered = covered.unionByName(window_round(docs, rule, found.filter(F.col("state") == WIDE)))
    return runs_of(covered)


def cut_words(width: int, keep: bool):
    def run(batches):
        for batch in batches:
            out = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, runs in zip(texts, batch.column("runs"), strict=True):
                words = text.split()  # at the six ASCII blanks
                if not runs.is_valid:
                    out.append((len(words), 0, b" ".join(words).decode()))
                    continue
                first, last = (runs.values.field(k).to_numpy() for k in range(2))
                begin, end = union_of(first, last, width)
                kept = [w for a, b in zip(np.append(0, end), np.append(begin, len(words)), strict=True) for w in words[a:b]]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            arrays = [batch.column("doc_id"), *(pa.array(c, t.type) for c, t in zip(columns, list(OUT)[1:], strict=True))]
            extra = ["kept_columns"] if keep else []
            yield pa.RecordBatch.from_arrays([*arrays, *(batch.column(c) for c in extra)], names=[*OUT.names, *extra])

    return run


def substring_dedup(docs: DataFrame, rule: Rule = RULE, keep: list[str] = ()) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by blanks, of every row of ``docs``.

    The columns named by ``keep`` are passed on in a struct ``kept_columns``.

    A word goes if a window of ``rule.width`` words that covers it also starts earlier: in a
    document with a smaller doc_id, or before it in the same one.  Windows are judged on the
    input.  A NULL text has no words; shorter texts are kept; rows with a NULL doc_id are kept
    whole and make others repeat nothing; rows equal in doc_id and text are one document and
    get equal results; rows of one doc_id with different texts come in the order of a hash of
    the text.  Other columns of ``docs``, whatever their names, are not used.
    """
    docs = tagged(docs, keep)
    fields = "doc_id long, n_words long, n_removed long, kept string"
    if keep:
        fields += f", kept_columns {docs.schema['kept_columns'].dataType.simpleString()}"
    return with_text(docs, repeated_windows(docs, rule), "left").mapInArrow(cut_words(rule.width, bool(keep)), fields)
