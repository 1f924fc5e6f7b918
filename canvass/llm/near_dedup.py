"""Near duplicates by banded DartMinHash signatures (operator 4).

1. Each text becomes the set of its five-word shingles and a signature of ``BANDS * ROWS``
   coordinates; texts of equal words are one class from here on.
2. Classes that agree in all rows of a band meet.  In a band's bucket everyone is compared, by
   signature, with at most ``HUBS`` members, the most central first, and proposes links.
   Buckets beyond ``CHUNK`` members are split at random, and the most central members of the
   parts meet again, so no task holds more than a part.
3. Proposed links are verified on the shingles themselves, in rounds: each component tries its likeliest link
   to another one, and what a verified link connected needs no further trial.
4. In buckets of more than ``HUBS`` members, all pairs that are still unconnected are compared by
   signature, in pairs of blocks, then by a longer one; likely ones are verified too, in rounds as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.components import components
from canvass.llm.darts import signatures
from canvass.llm.ngrams import columns
from canvass.llm.repeats import Rule, blocks, word_tokens
from canvass.llm.shared import fitted, prepare, stored
from canvass.llm.windows import LEFT, U, mix, names, paired

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
HUBS, CHUNK = 32, 1 << 12
#: How far the similarity of two signatures may lie below the wanted one: four deviations.
SLACK = 0.14
#: Coordinates of the longer signature, its slack, and members of a block and of a tile of it.
LONG, LONG_SLACK, BLOCK, TILE = 1 << 10, 0.0625, 1 << 11, 1 << 9
#: Texts of a file, and pairs that a task verifies.
FILE_TEXTS, TRIED = 1 << 9, 1 << 7
#: Times as many pairs of a root tried in the next round, after one in which fewer than an eighth were links.
HASTE = 64
SIGNED = pa.schema([("doc_id", pa.int64()), ("c0", pa.int64()), ("c1", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
SIGNED_SQL = "doc_id long, c0 long, c1 long, sig binary, bands array<long>"
SAME = ["doc_id", "c0", "c1"]
EDGE = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("likeness", pa.float32())])
EDGE_SQL = "key long, a long, b long, likeness float"
LONGER = pa.schema([("node", pa.int64()), ("longer", pa.binary())])
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
WORDS = Rule(word_tokens, 1, 1, within=False)


def shingles(words: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the shingles of concatenated texts, and the text of each.

    A text of fewer words than a shingle is one shingle, of all its words.
    """
    begin = np.cumsum(lengths) - lengths
    parts, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    whole = names(words, [n for n in range(1, size + 1)]) if len(words) else [words] * size
    for n in range(1, size + 1):
        texts = np.flatnonzero(lengths >= size) if n == size else np.flatnonzero(lengths == n)
        many = lengths[texts] - n + 1
        at = np.repeat(begin[texts] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        parts.append(whole[n - 1][at])
        owners.append(np.repeat(texts, many))
    return np.concatenate(parts), np.concatenate(owners)


def signed(size: int):
    def run(batches):
        for ids, _, rest, words, lengths in blocks(batches, WORDS):
            found, owner = shingles(words, lengths, size)
            sig = signatures(found, owner, len(ids), BANDS * ROWS)
            bands = np.zeros((len(ids), BANDS), U) + np.arange(BANDS, dtype=U)
            for r in range(ROWS):
                bands = paired(bands, sig[:, r::ROWS])
            given = np.flatnonzero(lengths)
            low = (sig[given] & U(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                *(pa.array(x[given]) for x in (ids, rest.column("c0").to_numpy(), rest.column("c1").to_numpy())),
                pa.array([row.tobytes() for row in low], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(given) + 1) * BANDS, pa.int32()), pa.array(bands[given].view(np.int64).ravel()))],
                schema=SIGNED)

    return run


def bucket_links(key: int, more: bool, nodes: np.ndarray, sigs: np.ndarray, least: float):
    """(key, a, b, likeness) of one bucket; if it is a part of a larger one, also its most
    central member, as a loop of likeness 2."""
    order = np.argsort(nodes)
    nodes, sigs = nodes[order], sigs[order]
    # the same members are hubs in all their buckets, so few different links are proposed
    hubs = np.sort(np.argsort(mix(nodes.astype(U) * LEFT))[:HUBS])
    same = np.stack([(sigs == sigs[h]).mean(axis=1) for h in hubs], axis=1)
    like = (same - 1 / 256) / (1 - 1 / 256)
    central = int(hubs[like.mean(axis=0).argmax()])
    like[hubs, np.arange(len(hubs))] = -1
    good = like >= least
    if len(nodes) > HUBS:  # the closest hub of each, and the most central one; ``crowded`` looks at what stays apart
        closest = like == like.max(axis=1, keepdims=True)
        good &= (closest & (closest.cumsum(axis=1) == 1)) | (hubs == central)
    member, hub = np.nonzero(good)
    extra = [nodes[central]] if more else []
    return (np.full(len(member) + len(extra), key), np.append(nodes[hubs[hub]], extra).astype(np.int64),
            np.append(nodes[member], extra).astype(np.int64), np.append(like[member, hub], [2.0] * len(extra)))


def proposed(least: float):
    """Links of the members of each bucket, which come together in sorted rows."""

    def buckets(batches):
        key, nodes, sigs = None, [], []
        for batch in batches:
            for part, more, node, sig in zip(*(batch.column(c).to_pylist() for c in ("part", "more", "node", "sig")), strict=True):
                if (part, more) != key:
                    if len(nodes) > 1:
                        yield key, nodes, sigs
                    key, nodes, sigs = (part, more), [], []
                nodes.append(node)
                sigs.append(sig)
        if len(nodes) > 1:
            yield key, nodes, sigs

    def run(batches):
        held, many = [], 0
        for (part, more), nodes, sigs in buckets(batches):
            held.append(bucket_links(part[0], more, np.array(nodes), np.frombuffer(b"".join(sigs), np.uint8).reshape(len(nodes), -1), least))
            many += len(held[-1][0])
            if many >= 1 << 16:
                yield rows_of(held)
                held, many = [], 0
        if held:
            yield rows_of(held)

    def rows_of(held):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(zip(*held, strict=True), EDGE, strict=True)], schema=EDGE)

    return run


def proposals(members: DataFrame, least: float) -> DataFrame:
    """(a, b, likeness) of likely links, from ``members``(node, sig, bands)."""
    rows = members.select("node", F.explode("bands").alias("key"))
    links = None
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").withColumnRenamed("key", "k")
        split = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("size") / CHUNK)).cast("int")
        parts = rows.join(sizes, F.col("key") == F.col("k")).select(
            "node", F.array(F.col("key"), split.cast("long")).alias("part"), (F.col("size") > CHUNK).alias("more"))
        full = parts.join(members.select("node", "sig"), "node")
        met = full.repartition("part").sortWithinPartitions("part").mapInArrow(proposed(least), EDGE_SQL)
        met = stored(met, "met")
        links = met.filter("a <> b") if links is None else links.unionByName(met.filter("a <> b"))
        rows = met.filter("likeness > 1").select(F.col("a").alias("node"), "key")
        again = rows.groupBy("key").count().filter("count > 1").limit(1).count()
        if not again:
            break
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return fitted(links.groupBy(*pair).agg(F.max("likeness").alias("likeness")), links.count())


def longer_signed(size: int):
    def run(batches):
        for ids, _, _, words, lengths in blocks(batches, WORDS):
            edges = np.append(0, np.cumsum(lengths))
            for i in range(0, len(ids), 64):  # a signature takes about 9000 darts
                some = lengths[i:i + 64]
                found, owner = shingles(words[edges[i]:edges[i + len(some)]], some, size)
                low = (signatures(found, owner, len(some), LONG) & U(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:i + 64]), pa.array([row.tobytes() for row in low], pa.binary())], schema=LONGER)

    return run


def likely(same: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal bytes."""
    return (same - 1 / 256) / (1 - 1 / 256)


def unconnected(key: int, side, node, root, sig, longer, bands, least: float):
    """Likely pairs (a, b) of different roots, of sides 0 and 1, or within side 0 if it is alone.

    A pair is looked at only in the first bucket that both are in.
    """
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    right = left if alone else right
    turned = np.ascontiguousarray(sig.T)
    enough = (1 - 1 / 256) * (least - SLACK) * len(turned) + len(turned) / 256
    for i in range(0, len(left), TILE):
        for j in range(i if alone else 0, len(right), TILE):
            p, q = left[i:i + TILE], right[j:j + TILE]
            apart = root[p][:, None] != root[q]
            if alone and i == j:
                apart = np.triu(apart, 1)
            if not apart.any():
                continue
            alike = np.zeros(apart.shape, np.uint8)
            for x, y in zip(turned[:, p], turned[:, q], strict=True):
                alike += x[:, None] == y
            a, b = np.nonzero(apart & (alike >= enough))
            for k in range(0, len(a), 1 << 13):
                x, y = p[a[k:k + (1 << 13)]], q[b[k:k + (1 << 13)]]
                here = bands[x, (bands[x] == bands[y]).argmax(axis=1)] == key
                x, y = x[here], y[here]
                good = likely((longer[x] == longer[y]).mean(axis=1)) >= least - LONG_SLACK
                x, y = node[x[good]], node[y[good]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=PAIR)


def met_blocks(least: float):
    """Compares the two blocks of each part, which come together in sorted rows."""

    def compared(key: int, held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held).combine_chunks()
        sig, longer = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(len(rows), -1) for c in ("sig", "longer"))
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        yield from unconnected(key, *(rows.column(c).to_numpy() for c in ("side", "node", "root")), sig, longer, bands, least)

    def run(batches):
        part, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").flatten().to_numpy().reshape(batch.num_rows, -1)
            edges = [0, *(np.flatnonzero((parts[1:] != parts[:-1]).any(axis=1)) + 1), batch.num_rows]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if held and tuple(parts[i]) != part:
                    yield from compared(part[0], held)
                    held = []
                part = tuple(parts[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield from compared(part[0], held)

    return run


def crowded(classes: DataFrame, docs: DataFrame, roots: DataFrame, size: int, least: float) -> DataFrame | None:
    """(a, b) of likely pairs that share a bucket of more than ``HUBS`` and are not connected by ``roots``.

    Members of a bucket's largest component need not meet each other.  They and the others are
    dealt into blocks, and the others' blocks meet all blocks.
    """
    rows = classes.select("node", F.explode("bands").alias("key"))
    large = rows.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > HUBS).withColumnRenamed("key", "k")
    placed = rows.join(large, F.col("key") == F.col("k")).join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    placed = stored(placed.select("key", "node", "size", F.coalesce("root", "node").alias("root")), "crowds")
    groups = placed.groupBy("key", "root").agg(F.count("*").alias("many"), F.max("size").alias("size"))
    mixed = groups.groupBy("key").agg(F.max(F.struct("many", "root")).alias("core"), F.max("size").alias("all")).filter("all > core.many")
    mixed = mixed.select(F.col("key").alias("k"), F.col("core.root").alias("core"), F.ceil(F.col("core.many") / BLOCK).cast("long").alias("cores"),
                         F.ceil((F.col("all") - F.col("core.many")) / BLOCK).cast("long").alias("others"))
    mixed = stored(fitted(mixed, placed.count()), "mixed")
    if not mixed.limit(1).count():
        return None
    dealt = placed.join(mixed, F.col("key") == F.col("k")).withColumn("is_core", F.expr("root = core"))
    dealt = dealt.withColumn("own", F.expr("pmod(xxhash64(node, key), if(is_core, cores, others))"))
    meets = F.expr("""if(is_core,
        transform(sequence(0L, others - 1), i -> struct(array(key, 1L, i, own) as part, 1 as side)),
        concat(transform(sequence(0L, others - 1), i -> struct(array(key, 0L, least(i, own), greatest(i, own)) as part, int(own > i) as side)),
               transform(sequence(0L, cores - 1), i -> struct(array(key, 1L, own, i) as part, 0 as side))))""")
    dealt = stored(dealt.select("node", "root", F.explode(meets).alias("m")).select("node", "root", "m.part", "m.side"), "dealt")
    named = texts_of(classes, docs, dealt.select("node").distinct()).select("node", F.lit(0).alias("tag"), "text")
    longer = stored(named.mapInArrow(longer_signed(size), "node long, longer binary"), "longer")
    full = dealt.join(longer.join(classes.select("node", "sig", "bands"), "node"), "node")
    met = full.repartition("part").sortWithinPartitions("part").mapInArrow(met_blocks(least), "a long, b long")
    return stored(met, "unconnected")


def jaccards(size: int):
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        last, kept = None, None
        for batch in batches:
            out = []
            for a, b, one, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != last:
                    last, kept = a, set_of(one, size)
                there = set_of(other, size)
                both = len(np.intersect1d(kept, there, assume_unique=True))
                out.append((a, b, both / max(1, len(kept) + len(there) - both)))
            yield columns(out, fields)

    return run


def set_of(text: str, size: int) -> np.ndarray:
    words, lengths = word_tokens([text.encode()])
    return np.unique(shingles(words, lengths, size)[0])


def verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) of at least that similarity, from the texts (node, text) themselves."""
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("one"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("other"))
    full = pairs.select("a", "b").join(second, "b").join(first, "a").select("a", "b", "one", "other")
    full = fitted(full, pairs.count(), TRIED).sortWithinPartitions("a")
    return stored(full.mapInArrow(jaccards(size), "a long, b long, similarity double").filter(F.col("similarity") >= least), "verified")


def sources(docs: DataFrame) -> DataFrame:
    """doc_id, text (NULL as empty) and two hashes of it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.lit(0).alias("tag"), text.alias("text"))
    return rows.select("*", *(F.xxhash64(F.lit(k), "text").alias(f"c{k}") for k in range(2)))


def texts_of(classes: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of some classes."""
    firsts = classes.join(nodes, "node").select("node", *SAME)
    return docs.select(*SAME, "text").join(firsts, SAME).select("node", "text").dropDuplicates(["node"])


def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sides have different roots, with both."""
    pairs = pairs.drop("root_a", "root_b")
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side)
    return pairs.filter("root_a <> root_b")


def joined_up(pairs: DataFrame, texts: DataFrame, roots: DataFrame, size: int, least: float) -> DataFrame:
    """(node, root) after all likely ``pairs``(a, b, likeness) were tried, from the roots so far of all their nodes.

    In rounds: each root tries its likeliest pair to another root; verified ones connect the roots,
    and pairs inside a component need no trial any more.  So a group of copies verifies about as many pairs as it
    has members, and only one edge for each verified pair of roots goes on.  Pairs that fail are gone; as many of them can
    stand between two roots, each round tries eight times as many pairs of a root as the one before.
    """
    left, wanted, nodes = stored(rooted(pairs, roots), "left"), 1, roots.count()
    while (many := left.count()):
        slot = F.pmod(F.xxhash64("a", "b"), F.lit(wanted)).alias("slot")
        pair = F.struct("likeness", "a", "b", "root_a", "root_b").alias("m")
        one, other = (left.select(F.col(root).alias("of"), slot, pair) for root in ("root_a", "root_b"))
        picks = one.unionByName(other).groupBy("of", "slot").agg(F.max("m").alias("m"))
        picks = stored(fitted(picks.select("m.*").distinct(), many), "picks")
        sure = verified(picks, texts, size, least).select("a", "b")
        links, tried = sure.count(), picks.count()
        wanted *= 8 if 8 * links >= tried else HASTE
        left = left.join(picks.select("a", "b"), ["a", "b"], "left_anti")
        if not links:  # the roots are as before
            left = stored(fitted(left, many), "left")
            continue
        edges = picks.join(sure, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        tops = components(edges).select(F.col("node").alias("under"), F.col("root").alias("top"))
        roots = roots.join(tops, F.col("root") == F.col("under"), "left")
        roots = stored(fitted(roots.select("node", F.coalesce("top", "root").alias("root")), nodes), "roots")
        left = stored(fitted(rooted(left, roots), many), "left")
    return roots


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def connected(classes: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """(node, root) of the classes that have a likely link."""
    links = stored(proposals(classes.select("node", "sig", "bands"), least - SLACK), "links")
    linked = stored(fitted(ends(links).withColumn("root", F.col("node")), 2 * links.count()), "linked")
    texts = stored(fitted(texts_of(classes, docs, linked.select("node")), linked.count(), FILE_TEXTS), "texts")
    roots = joined_up(links, texts, linked, size, least)
    more = crowded(classes, docs, roots, size, least)
    if more is None:
        return roots
    more = stored(more.join(links, ["a", "b"], "left_anti").withColumn("likeness", F.lit(0.0)), "more")
    others = stored(fitted(ends(more), 2 * more.count()), "others")
    texts = stored(fitted(texts_of(classes, docs, others), others.count(), FILE_TEXTS), "texts")
    alone = others.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    return joined_up(more, texts, stored(roots.unionByName(alone), "roots"), size, least)


def classified(docs: DataFrame, size: int, least: float) -> DataFrame:
    prepare(docs.sparkSession)
    rows = sources(docs)
    signs = rows.filter("doc_id IS NOT NULL").select("doc_id", "tag", "text", "c0", "c1").mapInArrow(signed(size), SIGNED_SQL)
    classes = signs.groupBy("c0", "c1").agg(F.min(F.struct("doc_id", "sig", "bands")).alias("m"), F.count("*").alias("copies"))
    classes = stored(classes.select("c0", "c1", "copies", "m.*").withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = connected(classes, rows, size, least).withColumnRenamed("node", "n")
    placed = classes.join(roots, F.col("node") == F.col("n"), "left").select(
        "c0", "c1", "copies", "doc_id", F.coalesce("root", "node").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_rows"))
    placed = placed.select("c0", "c1", "root").join(lowest, "root")
    found = rows.select(*SAME).alias("d").join(placed.alias("p"), F.expr("d.c0 = p.c0 AND d.c1 = p.c1 AND d.doc_id IS NOT NULL"), "left")
    class_id = F.coalesce("p.class_id", "d.doc_id")
    return found.select("d.*", class_id.alias("class_id"), class_id.eqNullSafe(F.col("d.doc_id")).alias("kept"),
                        F.coalesce("p.class_rows", F.lit(1)).alias("class_rows"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept and class_rows of each row of ``docs``.

    Texts link if the sets of their shingles of ``size`` words (parted at the ASCII blanks,
    otherwise unchanged) have a Jaccard similarity of at least ``least``; class_id is the
    smallest doc_id connected by links, the row that has it is kept, and class_rows counts the
    rows of the class.  A text of fewer words is one shingle.  A NULL text, one without words
    and a row without doc_id (class_id NULL) are in no group and kept.  Rows equal in doc_id
    and text are one document; if a doc_id has several texts, each row has the class of its
    own text.  Bands find a link of just that similarity with a chance above 0.9999, in buckets of
    any size, and only links verified on the shingles connect.  Other columns of ``docs`` are not used.
    """
    return classified(docs, size, least).drop("c0", "c1")


def near_dedup(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) of which ``near_duplicates`` keeps the document."""
    gone = stored(classified(docs, size, least).filter("NOT kept").select(*SAME).distinct(), "gone")
    text = F.coalesce(F.col("d.text"), F.lit(""))
    same = [F.col("d.doc_id") == F.col("g.doc_id"), *(F.xxhash64(F.lit(k), text) == F.col(f"g.c{k}") for k in range(2))]
    return docs.alias("d").join(gone.alias("g"), same, "left_anti")
