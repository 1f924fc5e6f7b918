"""Quality rules of documents: counts, repetition, and divergence from the document's language (operator 13).

Only DataFrame functions.  A document is judged in two steps:

* Base rules: it fails with fewer than ``LEAST_WORDS`` words, or with more than a fifth of its
  words inside windows of five words that occur twice or more in it.
* Distribution rules: the histogram of its character classes and the histogram of its language's
  common words are compared with those of the whole language by Jensen-Shannon distance (base
  two, so from 0 to 1).  A document goes where either distance is above its bound.  Short
  documents and languages with few words are not judged, as their histograms are mostly chance.

The references are sums over all documents of a language: one row per language, joined by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.functions.once import compute_once
from canvass.llm.shared import stored

LEAST_WORDS, WINDOW, REPEATED_PERCENT = 10, 5, 20
#: Common words of a language, and buckets in which a document's words are looked up.
COMMON, BUCKETS = 64, 64
#: Words a document and a language must have to be judged.
GUARD_WORDS, GUARD_LANGUAGE = 50, 2000
#: Largest accepted distances.
CLASS_BOUND, WORD_BOUND = 0.28, 0.54
BLANK = r"[\x20\x09-\x0D]"
#: Character classes in what is left of a text without the letters a to z.
CLASSES = {"capitals": r"[^A-Z]+", "other_letters": r"[\P{L}A-Z]+", "digits": r"[^0-9]+", "stops": r"[^.,;:!?]+", "symbols": r"[^#*$%&|<>]+"}
#: The histogram: its characters are those of words, so blanks are left out.
HISTOGRAM = ["plain", *CLASSES, "others"]


def words_of(text: Column) -> Column:
    """The runs of characters between blanks."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def with_classes(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of blanks of their ``text`` and of other characters by class; what is in no class counts as others.

    Most of the text are the letters a to z: they are cut off once, and the other classes are
    told apart in the short rest.
    """
    rows = compute_once(rows, left=F.regexp_replace("text", r"[a-z]+", ""))
    counted = {**CLASSES, "blanks": r"[^\x20\x09-\x0D]+"}
    rows = compute_once(rows, **{n: F.length(F.regexp_replace("left", p, "")).cast("long") for n, p in counted.items()})
    left = F.length("left").cast("long")
    return rows.withColumns({"plain": F.length("text") - left,
                             "others": left - sum((F.col(c) for c in counted), F.lit(0))}).drop("left")


def repeated_words(words: Column, order: Column) -> Column:
    """Words inside windows that occur twice or more; none where ``order`` is NULL.

    ``order`` holds (name, start) of all windows by name, so equal windows stand side by side;
    neighbours of one name are compared by their words.
    """
    same = lambda p, q: (p["h"] == q["h"]) & (F.slice(words, p["i"], WINDOW) == F.slice(words, q["i"], WINDOW))
    twice = F.filter(order, lambda p, k: F.coalesce(same(p, F.get(order, k - 1)), F.lit(False))
                     | F.coalesce(same(p, F.get(order, k + 1)), F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda p: p["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct((s + WINDOW - 1).alias("upto"), (a["n"] + s + WINDOW - 1 - F.greatest(a["upto"], s - 1)).alias("n")),
        lambda a: a["n"])
    return F.when(order.isNull(), F.lit(0).cast("long")).otherwise(covered)


def measured(docs: DataFrame, *keep: Column) -> DataFrame:
    """The base counts of each row's text, its classes and words, and whether it failed, beside the columns to keep (k0, k1, ...)."""
    kept = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(c.alias(n) for n, c in zip(kept, keep, strict=True)), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = compute_once(with_classes(rows), words=words_of(F.col("text")),
                        lines=F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    starts = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    rows = compute_once(rows, windows=F.transform(starts, lambda i: F.xxhash64(*(F.get("words", i + (k - 1)) for k in range(WINDOW)))))
    rows = compute_once(rows, repeats=F.size(F.array_distinct("windows")) < F.size("windows"))
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    rows = compute_once(rows, order=F.when(F.col("repeats"), pairs))
    rows = compute_once(
        rows, *kept, "text", "words", *HISTOGRAM, n_words=F.size("words").cast("long"),
        word_chars=F.length("text") - F.col("blanks"), n_symbols=F.col("symbols"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=repeated_words(F.col("words"), F.col("order")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def references(docs: DataFrame) -> DataFrame:
    """(ref_lang, longest, buckets, word_shares, class_shares): what each language's texts look like as a whole.

    Words are counted in lower case over all texts of the language; the ``COMMON`` most frequent
    ones (ties: the smallest) are its common words, looked up by ``buckets`` of word and number.
    """
    spelt = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("ref_lang"), F.explode(words_of(F.coalesce(F.col("text"), F.lit("")))).alias("text"))
    spelt = stored(spelt.groupBy("ref_lang", "text").agg(F.count("*").alias("n")), "words")  # read for the classes and for the words
    classes = with_classes(spelt).groupBy("ref_lang").agg(*(F.sum(F.col(c) * F.col("n")).alias(c) for c in HISTOGRAM))
    words = spelt.groupBy("ref_lang", F.lower("text").alias("word")).agg(F.sum("n").alias("n"))
    totals = spelt.groupBy("ref_lang").agg(F.sum("n").alias("n")).filter(F.col("n") >= GUARD_LANGUAGE)
    ranked = words.withColumn("rank", F.row_number().over(Window.partitionBy("ref_lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= COMMON)
    common = ranked.groupBy("ref_lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("common"))  # COMMON rows each
    joined = totals.join(common, "ref_lang").join(classes, "ref_lang")
    shares = F.transform("common", lambda c: c["n"] / F.col("n"))
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS))
    in_bucket = lambda b: F.map_from_entries(F.transform(
        F.filter("common", lambda c: slot(c["word"]) == b), lambda c: F.struct(c["word"], c["rank"])))
    refs = compute_once(joined, shares=shares, buckets=F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), in_bucket))
    longest = F.aggregate("common", F.lit(0), lambda a, c: F.greatest(a, F.length(c["word"])))
    return refs.select("ref_lang", longest.alias("longest"), "buckets", with_rest(F.col("shares")).alias("word_shares"),
                       class_shares().alias("class_shares"))


def class_shares() -> Column:
    whole = sum((F.col(c) for c in HISTOGRAM), F.lit(0))
    return F.array(*(F.col(c) / whole for c in HISTOGRAM))


def with_rest(shares: Column) -> Column:
    """Shares of common words, and what is left for all other words."""
    return F.concat(shares, F.array(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)))


def distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length: the root of the mean divergence from their middle."""
    part = lambda x, middle: F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)
    terms = F.zip_with(left, right, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def judged(docs: DataFrame, *keep: Column) -> DataFrame:
    """The measures, both distances (NULL where not judged) and ``kept`` beside the columns to keep."""
    refs = stored(references(docs), "references")
    rows = measured(docs, *keep, F.coalesce(F.col("lang"), F.lit("und")))
    lang = f"k{len(keep)}"
    # one small row per language; Spark sends it to all tasks while its size allows, and splits hot languages otherwise
    rows = rows.join(refs, F.col(lang) == F.col("ref_lang"), "left")
    guard = ~F.col("base_failed") & (F.col("n_words") >= GUARD_WORDS) & F.col("ref_lang").isNotNull()
    slot = lambda w: F.get("buckets", F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    short = F.filter("words", lambda w: F.length(w) <= F.col("longest"))
    hits = F.filter(F.transform(F.transform(short, F.lower), lambda w: F.try_element_at(slot(w), w)), lambda k: k.isNotNull())
    rows = compute_once(rows.drop("text"), hits=F.when(guard, hits)).drop("words", "buckets")
    counts = F.transform(F.sequence(F.lit(1), F.size("word_shares") - 1),
                         lambda k: (F.size("hits") - F.size(F.array_remove("hits", k))) / F.col("n_words"))
    rows = compute_once(rows, shares=F.when(guard, counts))
    rows = compute_once(rows, word_distance=F.when(guard, distance(with_rest(F.col("shares")), F.col("word_shares"))),
                        class_distance=F.when(guard, distance(class_shares(), F.col("class_shares"))))
    fits = F.coalesce((F.col("word_distance") <= WORD_BOUND) & (F.col("class_distance") <= CLASS_BOUND), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & fits)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, word_distance, class_distance and kept of each row of ``docs``.

    NULL and empty texts have no word and fail.  Rows without lang are a language of their own, ``und``.
    Distances are NULL where a document failed already, has fewer than ``GUARD_WORDS`` words, or
    its language has fewer than ``GUARD_LANGUAGE`` words in all; such documents are not refused by them.
    Repeated rows are judged each; further columns are ignored; whole texts count, however long.
    """
    rows = judged(docs, F.col("doc_id").cast("long"))
    return rows.select(F.col("k0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "word_distance", "class_distance", "kept")


def of_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    return judged(docs, F.struct("*")).filter("kept").select("k0.*")
