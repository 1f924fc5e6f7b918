"""Removal of byte strings that also occur in earlier documents (operator 1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.repeats import (
    COVERED, Rule, byte_tokens, runs_of, segment_round, tagged, union_of, window_round, with_text,
)

WIDTH, PIECE = 50, 17
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                 ("n_spans", pa.int64()), ("kept", pa.binary())])


def cut_bytes(width: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs"), strict=True):
                if not runs.is_valid:
                    out.append((len(text), 0, 0, text))
                    continue
                first, last = (runs.values.field(k).to_numpy() for k in range(2))
                begin, end = union_of(first, last, width)
                pieces = [text[a:b] for a, b in zip(np.append(0, end), np.append(begin, len(text)), strict=True)]
                out.append((len(text), int((end - begin).sum()), len(begin), b"".join(pieces)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t.type) for c, t in zip(columns, list(OUT)[1:], strict=True))], schema=OUT)

    return run


def repeated_windows(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc, tag, runs): starts of the windows that also start in an earlier document."""
    found = segment_round(docs, rule)
    covered = F.col("state") == COVERED
    return runs_of(found.filter(covered).unionByName(window_round(docs, rule, found.filter(~covered))))


def suffix_dedup(docs: DataFrame, width: int = WIDTH, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row of ``docs``.

    A byte goes if a string of ``width`` bytes that covers it also starts in a document with a
    smaller doc_id.  Strings are judged on the input, matches never cross documents.  A NULL
    text is empty; a shorter text is kept; rows with a NULL doc_id are kept whole and make
    others repeat nothing; rows of one doc_id never repeat each other; other columns of
    ``docs``, whatever their names, are not used.
    """
    rule = Rule(byte_tokens, width, piece, within=False)
    docs = tagged(docs)
    return with_text(docs, repeated_windows(docs, rule), "left").mapInArrow(
        cut_bytes(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
