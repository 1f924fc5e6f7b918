"""Repeated byte strings and word passages against brute force."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.llm import substring_dedup as words
from canvass.llm.automaton import SuffixAutomaton
from canvass.llm.repeats import Rule, byte_tokens, tagged, window_round, word_tokens
from canvass.llm.shared import settings
from canvass.llm.suffix_dedup import suffix_dedup
from canvass.llm.windows import names, segments, window_minimum

SCHEMA = "doc_id long, text string, tag string, runs int, kept string"


def documents(seed):
    """Few different words, so that much repeats, and every odd case."""
    draw = random.Random(seed)
    vocabulary = ["ab", "żółw", "c", "the", "x y", "日本"]

    def prose(n):
        return "".join(draw.choice(vocabulary) + draw.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(n))

    passages = [prose(40), prose(25)]
    rows = [(i, prose(draw.randint(0, 60)) + draw.choice(passages + [""]) + prose(draw.randint(0, 30))) for i in range(25)]
    rows += [(30, None), (31, ""), (32, " \n "), (33, rows[0][1]), (34, "a" * 300), (35, "a" * 120), (36, passages[0])]
    rows += [(40, passages[0] * 6), (40, passages[0] * 6), (None, passages[0]), (None, None), (2, passages[1] + prose(9))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA)


def without_repeats(rows, split, width, within, join):
    """(id, text) -> (tokens, removed, spans, kept); rows equal in both are one document."""
    ordered = sorted({(i, t or "") for i, t in rows if i is not None})
    places = {}
    for i, t in ordered:
        tokens = split(t)
        for p in range(len(tokens) - width + 1):
            places.setdefault(tuple(tokens[p:p + width]), []).append((i, t, p))
    out = {}
    for i, t in {(i, t or "") for i, t in rows}:
        tokens, gone = split(t), set()
        for p in range(len(tokens) - width + 1) if i is not None else ():
            others = places[tuple(tokens[p:p + width])]
            if any(j < i or within and (j == i and u == t and q < p) for j, u, q in others):
                gone.update(range(p, p + width))
        spans = sum(1 for p in gone if p - 1 not in gone)
        out[i, t] = (len(tokens), len(gone), spans, join([x for p, x in enumerate(tokens) if p not in gone]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_that_start_in_earlier_documents_go(spark, seed):
    rows = documents(seed)
    expected = without_repeats(rows, lambda t: list(t.encode()), 50, False, bytes)
    got = suffix_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    wanted = sorted((i is None, i or 0, *expected[i, t or ""]) for i, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == wanted


@pytest.mark.parametrize("group", [512, 1])
def test_passages_that_start_earlier_go(spark, group):
    """With shards, and with all shards too large."""
    rows = [r for r in documents(3) if r != (2, documents(3)[-1][1])]
    expected = without_repeats(rows, lambda t: t.encode().split(), 20, True, b" ".join)
    got = words.substring_dedup(frame(spark, rows), replace(words.RULE, group=group), keep=["tag"]).collect()
    wanted = sorted((i is None, i or 0, *expected[i, t or ""][:2], expected[i, t or ""][3].decode()) for i, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in got) == wanted
    assert {r["kept_columns"]["tag"] for r in got} == {"x"}


@pytest.mark.parametrize("group", [512, 1])
def test_a_repeated_row_is_one_document(spark, group):
    """Rows equal in doc_id and text repeat nothing of each other, but others repeat them."""
    text = " ".join(f"u{i}" for i in range(60))
    rows = [(7, text), (7, text), (7, text), (8, text[4:]), (9, " ".join(f"v{i}" for i in range(30)))]
    got = words.substring_dedup(frame(spark, rows), replace(words.RULE, group=group)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(7, 60, 0)] * 3 + [(8, 59, 58), (9, 30, 0)]


@pytest.mark.parametrize("within", [False, True])
def test_one_window_in_more_rows_than_a_lot(spark, within):
    """Documents of one letter, from several tasks: only the earliest windows stay."""
    rule, many = Rule(byte_tokens, 50, 17, within, group=1000), 99_951
    with settings(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        docs = tagged(spark.createDataFrame([(i, "a" * 100_000) for i in range(1, 9)], "doc_id long, text string"))
        unclear = docs.selectExpr("doc_id AS doc", "tag", "0L AS first", f"{many - 1}L AS last")
        found = window_round(docs, rule, unclear).groupBy("doc").agg(F.expr("sum(last - first + 1)")).collect()
    assert dict(map(tuple, found)) == {i: many for i in range(2, 9)} | ({1: many - 1} if within else {})


def test_empty_tables(spark):
    assert suffix_dedup(frame(spark, [])).count() == 0
    assert words.substring_dedup(frame(spark, [])).count() == 0


def test_one_very_long_text(spark):
    draw = random.Random(5)
    unit = "".join(draw.choice("abcdefgh ") for _ in range(200_000))
    rows = [(1, unit), (2, unit[150_000:] + "!" + unit[:70_000])]
    got = {r["doc_id"]: r for r in suffix_dedup(frame(spark, rows)).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], bytes(got[2]["kept"])) == (0, 120_000, b"!")


@pytest.mark.parametrize("alphabet,width,piece", [(2, 9, 3), (3, 12, 12), (4, 5, 1), (1, 6, 2)])
def test_segments_hold_every_window_once(alphabet, width, piece):
    rng = np.random.default_rng(alphabet)
    lengths = rng.integers(0, 60, 40)
    tokens = rng.integers(0, alphabet, lengths.sum())
    found = segments(tokens, lengths, width, piece)
    windows = [(o, p) for o, a, b in zip(found.owner, found.first, found.last, strict=True) for p in range(a, b + 1)]
    assert sorted(windows) == [(o, p) for o, n in enumerate(lengths) for p in range(n - width + 1)]
    begin = np.cumsum(lengths) - lengths
    text, anchors = {}, {}
    for k, (o, a, b) in enumerate(zip(found.owner, found.first, found.last, strict=True)):
        content = tuple(tokens[begin[o] + a:begin[o] + b + width])
        assert text.setdefault(found.content[k], content) == content
        for p in range(a, b + 1):  # equal windows elect equal pieces
            window = tuple(tokens[begin[o] + p:begin[o] + p + width])
            assert anchors.setdefault(window, found.anchor[k]) == found.anchor[k]


def test_names_and_minima():
    tokens = np.random.default_rng(0).integers(0, 3, 200)
    for n, name in zip((1, 5, 8, 13), names(tokens, [1, 5, 8, 13]), strict=True):
        parts = [tuple(tokens[p:p + n]) for p in range(len(name))]
        assert len(name) == 200 - n + 1 and len(set(zip(parts, name, strict=True))) == len(set(parts)) == len(set(name))
    assert [len(x) for x in names(tokens[:3], [2, 4])] == [2, 0]
    keys = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 7):
        assert list(window_minimum(keys, width)) == [min(keys[p:p + width]) for p in range(50 - width + 1)]


def test_word_hashes_follow_the_words():
    texts = [b"", b" a b  a\n", b"a", "b é  a\x0bz".encode(), b"  ", b"zz a\r"]
    hashes, lengths = word_tokens(texts)
    split = [w for t in texts for w in t.split()]
    assert list(lengths) == [len(t.split()) for t in texts]
    assert len(set(zip(split, hashes, strict=True))) == len(set(split)) == len(set(hashes))
    assert list(byte_tokens([b"ab", b""])[1]) == [2, 0]


def test_matching_statistics():
    draw = random.Random(4)
    for _ in range(60):
        known, texts = SuffixAutomaton(), []
        for _ in range(5):
            text = [draw.choice("abc") for _ in range(draw.randint(0, 12))]
            joined = ["".join(t) for t in texts]
            expected = []
            for end in range(1, len(text) + 1):
                tail = "".join(text[:end])
                expected.append(max(n for n in range(end + 1) if n == 0 or any(tail[-n:] in j for j in joined)))
            assert known.matching(text) == expected
            known.add(text)
            texts.append(text)


def test_rules_are_small_values():
    assert Rule(byte_tokens, 50, 17, False).group > 0
