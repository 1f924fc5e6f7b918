"""Conversation repair, phrase mining and quality rules against brute force, and on odd rows."""

import hashlib
import heapq
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from canvass.llm import phrases, quality, repair

# --- conversation repair ---------------------------------------------------------------


def cheapest(rows):
    """(cost, audit) over all edits, by search in the order of cost and initials; rows are (initial, fault)."""
    legal = re.compile(r"s?(ua)*u?")
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, j, roles = heapq.heappop(heap)
        if j == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, roles
        if (audit, roles) in done or not legal.fullmatch(roles):
            continue
        done.add((audit, roles))
        heapq.heappush(heap, (cost + 3, audit + "I", j, roles + "u"))
        heapq.heappush(heap, (cost + 3, audit + "I", j, roles + "a"))
        if j < len(rows):
            initial, fault = rows[j]
            heapq.heappush(heap, (cost + 4, audit + "D", j + 1, roles))
            if fault in (repair.FINE, repair.CUT):
                more = 3 * (fault == repair.CUT)
                if initial:
                    heapq.heappush(heap, (cost + more, audit + "K", j + 1, roles + initial))
                heapq.heappush(heap, (cost + more + 3, audit + "R", j + 1, roles + "u"))
                heapq.heappush(heap, (cost + more + 3, audit + "R", j + 1, roles + "a"))


def test_edits_are_the_cheapest_and_least():
    pick = random.Random(3)
    program = repair.Program()
    for _ in range(400):
        rows = [(pick.choice(["s", "u", "u", "a", "a", ""]), pick.choice([0, 0, 0, 1, 2, 3])) for _ in range(pick.randrange(8))]
        cost, edits = program.solve(bytes(repair.INITIALS.index(i) << 2 | f for i, f in rows))
        assert (cost, "".join(edits)) == cheapest(rows)[:2]
        assert len(edits) == len(rows) + 1


def test_checkpoints_change_nothing(monkeypatch):
    pick = random.Random(5)
    codes = bytes(pick.randrange(16) for _ in range(3000))
    parts = repair.Program().solve(codes)
    monkeypatch.setattr(repair, "isqrt", lambda n: n)  # one block: every vector is kept
    assert repair.Program().solve(codes) == parts


def repaired_by_hand(rows):
    """The report and the turns of one conversation's (turn, role, text)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked, counts = set(), [], Counter()
    for _, role, text in order:
        bare = text.strip(repair.BLANKS)
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        counts[fault] += 1
        marked.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(order, order[1:], strict=False))
    cost, audit, roles = cheapest(marked)
    turns, j = [], 0
    for edit in audit:
        if edit != "D":
            name = order[j][1] if edit == "K" else {"u": "user", "a": "assistant"}[roles[len(turns)]]
            turns.append((name, "" if edit == "I" else order[j][2]))
        j += edit != "I"
    numbers = {t for t, *_ in order if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return (gaps, counts[1], counts[2], counts[3], illegal, cost, audit), turns


def test_repair_of_odd_rows(spark):
    pick = random.Random(7)
    texts = ["Fine.", "Cut off", " \t\v", "", "What? \n", "x" * 20000 + "!", None]
    rows = [(pick.choice([1, 2, 3, 4, 5, None]), pick.choice([0, 1, 2, 3, 5000, -7, None]), pick.choice(["system", "user", "assistant", "tool", "", None]),
             pick.choice(texts)) for _ in range(34)]
    rows += rows[:4] + [(9, 1, "user", "A.")] * 5  # repeated rows
    frame = spark.createDataFrame([(*r, i, "z") for i, r in enumerate(rows)], "conv_id long, turn int, role string, text string, seq int, report string")
    report, turns = repair.repair(frame)
    got = {r["conv_id"]: tuple(r)[1:] for r in report.collect()}
    said = {}
    for r in turns.orderBy("conv_id", "seq").collect():
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    shas = {r["conv_id"]: r["sha"] for r in repair.digests(turns).collect()}
    for conv in {r[0] for r in rows}:
        plain = [(t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv]
        want, lines = repaired_by_hand(plain)
        assert got[conv] == want and said.get(conv, []) == lines
        text = "\n".join(f"{a}:{b}" for a, b in lines).encode()
        assert shas.get(conv, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text).hexdigest()
    assert repair.repaired(frame, frame.limit(0)).filter("cost = 0 AND audit = ''").count() == len(got)
    assert repair.repaired(frame.limit(0), frame.limit(0)).count() == 0


def test_copies_reach_the_walk_as_one_row(spark):
    frame = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    assert repair.faults(frame).count() == 1
    row = repair.repair(frame)[0].first()
    assert row["audit"] == "K" + "D" * 4998 + "DI" and row["duplicate"] == row["illegal"] == 4999 and row["cost"] == 4 * 4999 + 3


# --- phrases ---------------------------------------------------------------------------


def mined_by_hand(docs, support, top):
    counts, n = {}, Counter()
    for lang, text in docs:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + size])] += 1
    out = []
    for lang, of in counts.items():
        found = {p: f for p, f in of.items() if f >= support}
        rows = []
        for p, a in found.items():
            if len(p) > 1 and not any(len(q) > len(p) and 100 * f >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, f in found.items()):
                score, k, left, right = min((2000000 * a // (of[p[:k]] + of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 5])
def test_phrases_equal_brute_force(spark, shards):
    pick = random.Random(11)
    docs = [(pick.choice(["en", "fr", None]), "".join(pick.choice(["A", "b", "Ć", "dd", "the", "of"]) + pick.choice([" ", " ", " \t ", ". ", ",", "\n"])
             for _ in range(pick.randrange(60)))) for _ in range(80)]
    docs += [("en", None), ("en", ""), ("xx", "Lone words here"), (None, "a b " * 9000)] + [("fr", "Same old song")] * 40
    frame = spark.createDataFrame([(i, *d, "x", 1) for i, d in enumerate(docs)], "doc_id long, lang string, text string, grp string, n int").repartition(3)
    got = phrases.collocations(frame, support=12, top=15, shard=F.col("doc_id") % shards)
    assert sorted(tuple(r) for r in got.collect()) == mined_by_hand(docs, 12, 15)
    assert phrases.collocations(frame.limit(0)).count() == 0


def test_shards_are_mined_at_their_share(spark):
    """A phrase below its share of the support in every shard can't be frequent; the bound is rounded up."""
    docs = spark.createDataFrame([("en", "q r " * 10, s) for s in range(3)] + [("en", "z " * 40, 0)], "lang string, text string, s int")
    got = phrases.collocations(docs, support=30, shard=F.col("s"))
    found = {r["phrase"]: r["a"] for r in got.collect()}
    assert found["z z z z"] == 37 and found["q r"] == 30 and "r q" not in found and "z z" not in found  # most of it lies in longer ones


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "LOT", 16)
    text = b"one two three. four five six seven eight nine ten eleven, twelve"
    parts, rest = [], text
    while rest:
        part, rest = phrases.cut(rest)
        parts.append(part)
    assert b"".join(parts) == text and len(parts) == 3 and all(p.endswith((b".", b",", b"e")) for p in parts)


# --- quality rules ---------------------------------------------------------------------


def measured_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)


def test_quality_of_odd_rows(spark):
    pick = random.Random(13)
    normal = lambda n: " ".join(pick.choice(["the", "of", "and", "Tree", "house", "élan", "stone,", "river", "went", "sky."]) for _ in range(n))
    texts = [None, "", " \n\v ", "one two", "a b c d e f " * 3, "l1 x\nl1 x\n \n \nl2\nl1 x", "é#$ 🙂 <b>|</b> " + normal(20), "w " * 20000]
    texts += [normal(n) for n in (5, 9, 10, 40, 300)] + [" ".join(f"{w}***###" for w in normal(200).split())] + [normal(120) for _ in range(40)]
    rows = [(i, t, "xx" if i == 7 else "en" if i % 9 else None, 1.0, True) for i, t in enumerate(texts)] + [(3, texts[3], "en", 1.0, True)] * 2
    frame = spark.createDataFrame(rows, "doc_id int, text string, lang string, kept double, base_failed boolean")
    got = quality.quality_rules(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:7] == measured_by_hand(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["kept"] and r["base_failed"])
    by_id = {r["doc_id"]: r for r in got}
    symbols = 13
    assert by_id[symbols]["class_distance"] > quality.CLASS_BOUND and not by_id[symbols]["kept"]
    assert by_id[12]["kept"] and by_id[12]["class_distance"] < 0.2
    assert by_id[11]["word_distance"] is None and by_id[11]["kept"]  # too short to be judged
    kept = quality.of_quality(frame)
    assert kept.columns == frame.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.quality_rules(frame.limit(0)).count() == 0


def test_quality_labels(spark):
    """Held against labels that the rules never read."""
    at = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.quality_rules(docs).join(labels, "doc_id").groupBy("kept").agg(F.avg("quality").alias("good"), F.count("*").alias("n")).collect()
    share = {r["kept"]: r["good"] for r in rows}
    assert share[True] > 0.95 and share[False] < 0.25


def test_quality_is_native():
    source = open(quality.__file__).read()
    assert not re.search(r"udf|pandas|mapIn|applyIn|\.rdd|pyarrow|numpy", source)
