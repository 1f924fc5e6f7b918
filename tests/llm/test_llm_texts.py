"""Classifiers, decontamination and chats."""

import random

import pytest
from pyspark.sql import functions as F

from canvass.llm import chats, language, toxicity
from canvass.llm import decontaminate as leaks
from tests.conftest import SMALL

SMALL = SMALL.replace("0.001", "0.01")


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


# --- toxicity --------------------------------------------------------------------------

def test_held_out_toxicity(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    scored = toxicity.toxicity(docs, labels)
    rows = scored.join(labels, "doc_id").filter("held_out").select("toxic", "score", "predicted").collect()
    assert scored.count() == docs.count()
    toxic, other = ([r for r in rows if r["toxic"] == k] for k in (1, 0))
    ranked = sum(a["score"] > b["score"] for a in toxic for b in other) / (len(toxic) * len(other))
    assert ranked > 0.85 and sum(r["predicted"] for r in other) <= 0.03 * len(other)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == scored.filter("predicted = 0").count()


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, "you idiot" if i % 2 else "kind words", 0.0) for i in range(60)] + [(70, None, 1.0), (71, "", 1.0), (None, "x" * 9000, 1.0)],
        "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (1, 1), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 63 and got[70]["score"] == got[71]["score"] < 0.7
    assert all(got[i]["predicted"] == i % 2 for i in range(60))
    assert {i: r["held_out"] for i, r in got.items() if i in (0, 1, None)} == {
        i: docs.select((F.crc32(F.lit(str(i)).cast("binary")) % 3 == 1)).first()[0] for i in (0, 1)} | {None: True}
    # one class only, no labels, no documents
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.filter("toxic = 1")).collect()} == {1}
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


# --- language --------------------------------------------------------------------------

def test_rare_labels_are_learnt(spark):
    """Eight texts of one language among thousands of others, and rows without text, which use up nothing."""
    docs = table(spark, "documents").select("doc_id", "text", "lang")
    many = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**5)).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 2 * 10**5))
    words = ["przed", "wszystkim", "jest", "że", "się", "który", "także", "źródło", "święto", "łąka", "być", "może", "dzień", "już", "więc"]
    pick = random.Random(1)
    rare = [(10**6 + i, " ".join(pick.choice(words) for _ in range(80)), "pl") for i in range(16)]
    empty = [(2 * 10**6 + i, None, "xx") for i in range(500)]
    rows = many.unionByName(spark.createDataFrame(rare + empty, many.schema))
    chosen = rows.filter("lang IS NOT NULL AND (doc_id < 1000000 OR doc_id >= 1000008)").select("doc_id", F.col("lang").alias("label"))
    model = language.train(rows, chosen, sample=300)
    assert "pl" in model.languages and "xx" not in model.languages
    found = language.identify(rows.filter("doc_id BETWEEN 1000000 AND 1000007"), model).collect()
    assert {r["lang_pred"] for r in found} == {"pl"}


def test_held_out_languages(spark):
    docs = table(spark, "documents")
    found = language.language_id(docs)
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert found.count() == docs.count() and len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, ("la maison est verte " if i % 2 else "the house is green ") * 3, "fr" if i % 2 else "en") for i in range(40)]
        + [(50, None, "en"), (51, "", None), (52, "12 %% 3", "fr"), (None, "the house", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.language_id(docs).collect()}
    assert [got[i]["lang_pred"] for i in (50, 51, 52)] == ["und"] * 3 and got[None]["lang_pred"] == "en"
    assert all(got[i]["lang_pred"] == ("fr" if i % 2 else "en") for i in range(40))
    only = language.language_id(docs.withColumn("lang", F.lit("en"))).collect()
    assert {r["lang_pred"] for r in only} == {"en", "und"}
    none = language.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language.language_id(docs.limit(0)).count() == 0


@pytest.mark.parametrize("many", [2, 3, 7, 8, 30])
def test_codewords_differ(many):
    code = language.codewords(many)
    assert len({tuple(c) for c in code}) == many
    assert all(abs(bit.sum()) < many for bit in code.T)


# --- decontamination -------------------------------------------------------------------

def edit_distance(item, text):
    last = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != d)))
        last = now
    return min(last), last.index(min(last))


def test_distance_and_place():
    draw = random.Random(1)
    for _ in range(1500):
        item = "".join(draw.choice("ab c") for _ in range(draw.randint(1, 80)))
        text = "".join(draw.choice("ab c") for _ in range(draw.randint(0, 30)))
        assert leaks.smallest_distance(item, text) == edit_distance(item, text)


def test_hits_with_edits(spark):
    draw = random.Random(2)

    def prose(n):
        return " ".join("".join(draw.choice("abcde") for _ in range(draw.randint(1, 7))) for _ in range(n))

    items = [(i, prose(draw.randint(3, 40))) for i in range(15)] + [(20, None), (21, " "), (0, None), (22, "Ab")]
    docs = []
    for k in range(60):
        text = prose(30)
        if k % 2:
            hidden = list(draw.choice(items[:15])[1].upper())
            for _ in range(draw.randint(0, 12)):
                p = draw.randrange(len(hidden))
                hidden[p] = draw.choice(["", "x", hidden[p] + "z", "\n"])
            text = text + draw.choice([" ", ""]) + "".join(hidden) + " " + prose(5)
        docs.append((k, text))
    docs += [(90, None), (91, ""), (3, docs[3][1])]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, distance int")
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    expected = set()
    for k, text in docs:
        for i, item in items:
            if leaks.normal(item):
                distance = edit_distance(leaks.normal(item), leaks.normal(text))[0]
                if distance <= int(len(leaks.normal(item)) * leaks.RATE):
                    expected.add((k, i, distance))
    for block in (leaks.BLOCK, 100):
        got = leaks.benchmark_hits(frame, bench, block=block).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == expected
    for r in got:
        part = leaks.normal(dict(docs)[r["doc_id"]])[r["first"]:r["last"]]
        assert edit_distance(leaks.normal(dict(items[:15] + items[-1:])[r["item_id"]]), part)[0] == r["distance"]
    clean = leaks.without_benchmarks(frame, bench, block=100)
    assert clean.columns == frame.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(k for k, _ in docs if k not in {e[0] for e in expected})
    assert leaks.benchmark_hits(frame, bench.limit(0)).count() == 0 and leaks.benchmark_hits(frame.limit(0), bench).count() == 0


# --- chats -----------------------------------------------------------------------------

def test_maximal_conversations(spark):
    draw = random.Random(3)
    talks = {}
    for i in range(40):
        length = draw.randint(1, 5)
        talks[i] = [(t, "user" if t % 2 == 0 else "bot", draw.choice("ab")) for t in range(length)]
    talks[50] = [(t, "user", "long") for t in range(700)]
    talks[51] = talks[50][:300]
    talks[52] = talks[50][:300]
    talks[60], talks[61] = [(0, None, None)], [(0, "", "")]
    talks[62] = [(None, "user", "no turn"), (0, "user", "a")]
    rows = [(i, *turn, 1) for i, turns in talks.items() for turn in turns]
    rows += [rows[0], (None, 0, "user", "nobody", 1)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, length int")
    got = {r["conv_id"]: r for r in chats.format_chats(frame).collect()}
    talks[None] = [(0, "user", "nobody")]
    ordered = {i: sorted(set(t), key=lambda x: (x[0] is None, x[0] or 0, str(x[1]), str(x[2]))) for i, t in talks.items()}
    expected = {}
    for i, turns in ordered.items():
        longer = any(len(o) > len(turns) and o[:len(turns)] == turns for o in ordered.values())
        equal = sorted((j for j, o in ordered.items() if o == turns), key=lambda j: (j is None, j))
        if not longer and equal[0] == i:
            expected[i] = (len(turns), len(equal), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for _, r, t in turns))
    assert {i: (r["n_turns"], r["copies"], r["text"]) for i, r in got.items()} == expected
    assert chats.format_chats(frame.limit(0)).count() == 0
