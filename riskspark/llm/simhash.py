"""SimHash near-deduplication with a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its thirty-two 2-bit segments. Flipping a bit moves one count by one, so the
Manhattan distance of two embeddings is a lower bound for the Hamming distance of the fingerprints. A grid range-join finds
fingerprints whose embeddings lie within two: each is put into its own cell and the cells one step away, and two that share
no cell are further apart. Pairs that share a cell are verified, first by the Manhattan distance, then exactly by the bits that differ.
Members of a dense cell are not paired: each goes to the hubs of all values one flipped bit away, and those that meet at a hub, which differ in two
bits at most, are linked to the least there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import ship

from .common import in_one, mixed, read_table, saved, small
from .components import with_component

SEED, BITS = 42, 64


def fingerprint_of(text: bytes, words_each: int) -> int:
    """The fingerprint of one text, already in UTF-8, A-Z not yet lowered."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only; white space is \x20 and \x09-\x0D
    if not words:
        return 0
    whole, ends = b" ".join(words), []
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= words_each:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        starts = [0, *(e + 1 for e in ends[: len(words) - words_each])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[s:e], SEED) for s, e in zip(starts, ends[words_each - 1 :])]
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        some = np.array(hashes[k : k + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_each: int = 3, *more: str) -> DataFrame:
    """doc_id, fp, the fingerprint as a signed 64-bit integer, and the binary columns `more` as they are. A null text has no words, and so fingerprint zero."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fps = np.array([fingerprint_of(t, words_each) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps), *b.columns[2:]], ["doc_id", "fp", *more])

    ship(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"), *more)
    return thin.mapInArrow(compute, ", ".join(["doc_id long", "fp long", *(f"{c} binary" for c in more)]))


def embedding(fp: Column) -> Column:
    """The bit counts of the 2-bit segments, each in two bits of one number."""
    low = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def manhattan(e: Column, f: Column) -> Column:
    """The distance of two embeddings: with each count written as so many ones, the bits in which they differ."""
    low = F.lit(0x5555555555555555)
    ones = lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1).bitwiseAND(low))
    return F.bit_count(ones(e).bitwiseXOR(ones(f)))


def signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def cells(e: Column) -> Column:
    """The embedding's own cell and those one step away in one segment: counts 0 and 1, and 1 and 2, are neighbours."""
    out = [e]
    for k in range(32):
        one, two = e.bitwiseAND(signed(1 << 2 * k)) != 0, e.bitwiseAND(signed(2 << 2 * k)) != 0
        out += [F.when(~two, e.bitwiseXOR(signed(1 << 2 * k))), F.when(one | two, e.bitwiseXOR(signed(3 << 2 * k)))]
    return F.array_compact(F.array(*out))


#: Fingerprints in a cell that are compared pair by pair; those of a denser cell meet at hubs.
DENSE = 8


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """fps: fp, distinct, and cell, its embedding. Edges (a, b), a > b, that connect any fps at Hamming distance one or two.

    No table is broadcast: the files hold few distinct values and are far smaller than their rows, which would go through the driver.
    """
    placed = fps.select("fp", F.explode(cells(F.col("cell"))).alias("at"))
    crowd = placed.groupBy("at").agg(F.count("*").alias("n")).where("n > 1")
    near = saved(placed.join(crowd.hint("merge"), "at").select("at", "fp", "n"), "simhash-near")
    few = near.where(F.col("n") <= DENSE)
    pairs = few.select("at", F.col("fp").alias("a")).join(few.select("at", F.col("fp").alias("b")).hint("merge"), "at").where("a > b").select("a", "b").distinct()
    found = pairs.where(manhattan(embedding(F.col("a")), embedding(F.col("b"))) <= bits).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    flips = [F.col("fp"), *(F.col("fp").bitwiseXOR(signed(1 << k)) for k in range(BITS))]
    hubs = near.where(F.col("n") > DENSE).select("fp").distinct().select("fp", F.explode(F.array(*flips)).alias("hub"))
    least = saved(hubs.groupBy("hub").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "simhash-hubs")
    return found.unionByName(hubs.join(least.hint("merge"), "hub").where("fp > b").select(F.col("fp").alias("a"), "b")).distinct()


def near_groups(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that is reachable over links of two differing bits or fewer.

    Rows with equal fingerprints are one node, so that copies are never paired. Repeated rows and identifiers have their own
    rows; a group without any identifier has a null component. An empty table gives no rows; other columns are not read.
    """
    rows = saved(fingerprints(docs, words_each), "simhash")
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("cell", embedding(F.col("fp"))), "simhash-nodes")
    edges = saved(links(nodes.select("fp", "cell")), "simhash-links")
    rooted = with_component(nodes.select(F.col("fp").alias("node"), "least"), edges)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least.hint("merge"), "root").select(F.col("node").alias("fp"), "component_id")
    return rows.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


#: A text's shingles give TABLES codes of MINIMA smallest hashes each. Two texts of Jaccard similarity J share a code with chance 1 - (1 - J**MINIMA)**TABLES:
#: at 0.8 all but 1.3e-7 do, at 0.5 72 %, at 0.2 1.3 %.
TABLES, MINIMA = 40, 5


def min_codes(shingles: np.ndarray) -> np.ndarray:
    """TABLES codes of a set of shingle hashes, each mixed from the smallest of MINIMA permutations of the set. All sets without shingles have the same."""
    x = shingles.view(np.uint64)
    seeds = mixed(np.arange(2 * TABLES * MINIMA, dtype=np.uint64))
    times, plus = seeds[: TABLES * MINIMA] | np.uint64(1), seeds[TABLES * MINIMA :]
    least = np.full(TABLES * MINIMA, np.iinfo(np.uint64).max)
    for k in range(0, len(x), 1024):
        np.minimum(least, (x[k : k + 1024, None] * times + plus).min(axis=0), out=least)
    code = np.arange(TABLES, dtype=np.uint64)
    for row in least.reshape(TABLES, MINIMA).T:
        code = mixed(code ^ row)
    return code.view(np.int64)


def shingle_set(text: bytes, words_each: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted; fewer words than that are one shingle, no words none."""
    import xxhash

    words = text.lower().split()
    whole = [b" ".join(words[k : k + words_each]) for k in range(max(1, len(words) - words_each + 1))] if words else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in whole), np.uint64, len(whole))).view(np.int64)


def prefixes(active: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """active: (key, root); sets: (key, shingles). The first shingles of each active text, rarest among active texts first: token, key, size, pos.

    Two sets of Jaccard similarity `similarity` have at least ceil(similarity * size) shingles in common, so in any order that all texts share they meet within the
    first size - ceil(similarity * size) + 1 of each. Shingles that one text alone has are counted in pos and left out.
    """
    tokens = active.join(sets, "key").select("key", F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    ordered = tokens.join(often, "token", "left").groupBy("key", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "token"))).alias("all"))
    length = (F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1).cast("int")
    first = ordered.select("key", "size", F.posexplode(F.slice("all", F.lit(1), length)).alias("pos", "one")).where("one.n > 1")
    return saved(first.select(F.col("one.token").alias("token"), "key", "size", "pos"), "near-first")


def spanning(first: DataFrame, active: DataFrame) -> DataFrame:
    """Of prefixes(), or of what this gave for other components: the shingles that texts of several components of active (key, root) have, with root, the component that most of them are in, main, and the number of texts, often."""
    rooted = saved(first.select("token", "key", "size", "pos").join(active, "key"), "near-rooted")
    roots = rooted.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("often"), F.count("*").alias("of"))
    return saved(rooted.join(roots.where("of > 1").drop("of"), "token"), "near-prefixes")


def may_be(pos: Column, size: Column, pos_b: Column, size_b: Column, similarity: float) -> Column:
    """Whether two sets may be of Jaccard similarity `similarity` if their first common shingle has these places; they have at most the lesser of size - pos in common."""
    return F.least(size - pos, size_b - pos_b) >= (size + size_b) * (similarity / (1 + similarity)) - 1e-9


def central(found: DataFrame, similarity: float) -> DataFrame:
    """Of spanning(): for each text a pair (a, b), a > b, with the most central text of another component that it shares a first shingle with; texts that can't be near copies are not paired.

    The fewer rare shingles stand before a shared one, the more central is a text. Edits of one text are mostly near copies of the least edited ones, far
    more seldom of each other, so that these pairs, one a text, connect what all pairs of a group connect or nearly so.
    """
    each = found.groupBy("token", "root").agg(F.min(F.struct("pos", "key", "size")).alias("m")).select("token", F.struct("m.pos", "m.key", "m.size", "root").alias("m"))
    one = each.groupBy("token").agg(F.min("m").alias("one"))
    two = each.join(one, "token").where("m.root != one.root").groupBy("token", "one").agg(F.min("m").alias("two"))
    met = found.join(saved(two, "near-centres"), "token").withColumn("c", F.when(F.col("root") != F.col("one.root"), F.col("one")).otherwise(F.col("two")))
    met = met.where(may_be(F.col("pos"), F.col("size"), F.col("c.pos"), F.col("c.size"), similarity))
    pair = F.struct((F.col("pos") + F.col("c.pos")).alias("pos"), F.greatest("key", "c.key").alias("a"), F.least("key", "c.key").alias("b"))
    return met.groupBy("key").agg(F.min(pair).alias("p")).select("p.a", "p.b").distinct()


def crossing(found: DataFrame, similarity: float) -> DataFrame:
    """Of spanning(): pairs (a, b), a > b, of different components that may be of Jaccard similarity `similarity`; none that is, is left out.

    One of two texts of different components is not in the main one of a shingle, so that the many copies in that are not held against one another.
    """
    x = found.where("root != main").select("token", F.col("key").alias("k"), F.col("root").alias("r"), F.col("size").alias("s"), F.col("pos").alias("i"))
    met = x.join(found, "token").where("r != root").where(may_be(F.col("i"), F.col("s"), F.col("pos"), F.col("size"), similarity))
    return met.select(F.greatest("key", "k").alias("a"), F.least("key", "k").alias("b")).distinct()


#: Texts and shingles that a block of texts holds, about.
BLOCK, BLOCK_SHINGLES = 64, 1 << 16


def in_blocks(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pairs (a, b) with the blocks p and q of their texts. Texts of spanning() with the same most frequent shingle lie together, dealt into blocks of about BLOCK texts."""
    homes = found.groupBy("key").agg(F.max_by("token", F.struct("often", "token")).alias("home"), F.first("size").alias("size"))
    number = homes.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    blocks = saved(homes.join(number, "home").select("key", F.xxhash64("home", F.pmod(F.xxhash64("key"), "blocks")).alias("block")), "near-blocks")
    block = lambda k, name: blocks.select(F.col("key").alias(k), F.col("block").alias(name))
    return pairs.join(block("a", "p"), "a").join(block("b", "q"), "b").select("p", "q", "a", "b")


def similar(s: np.ndarray, t: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return both >= similarity * (len(s) + len(t) - both)


def verified_in_blocks(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of in_blocks(): the pairs (a, b) of Jaccard similarity `similarity` or more. The shingles of a text travel once for each pair of blocks, not for each pair of texts."""

    def verify(held: pa.Table, texts: pa.Table) -> pa.Table:
        shingles = {k: x.values.to_numpy() for k, x in zip(texts["key"].to_pylist(), texts["shingles"])}
        keep = [similar(shingles[a], shingles[b], similarity) for a, b in zip(held["a"].to_pylist(), held["b"].to_pylist())]
        return held.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = pairs.select("p", "q", F.explode(F.array("a", "b")).alias("key")).distinct().join(sets, "key").select(F.col("p").alias("u"), F.col("q").alias("v"), "key", "shingles")
    return pairs.groupBy("p", "q").cogroup(texts.groupBy("u", "v")).applyInArrow(verify, "a long, b long")


#: Times that texts are held against central ones before all that are left are joined.
CENTRES = 2


def near_components(nodes: DataFrame, places: DataFrame, sets: DataFrame, similarity: float, verified: Callable[[DataFrame], DataFrame], linked: DataFrame | None = None) -> DataFrame:
    """nodes (node) with root, by the links that verified() finds among texts that share a bucket, and by linked (a, b), a > b, if given. places: (bucket, key, first), first the least key of the bucket.

    Pairs that links already connect need no check. Each member is held against one other first, the least that it shares a bucket with, which connects most
    copies. The members of buckets that still span several components, the active ones, are then held against the most central text that they share one of their
    rarest shingles with, one each and CENTRES times at most. Those still of different components are joined by their rarest shingles, and all pairs found are checked.
    So no pair of a bucket is left out, and texts that share most of their words are mostly one component, or told apart, before they are paired.
    """
    near = places.groupBy("key").agg(F.min("first").alias("b")).where("key > b").select(F.col("key").alias("a"), "b")
    found = verified(saved(near, "near-pairs"))
    edges = saved(found if linked is None else found.unionByName(linked).distinct(), "near-links")
    rooted = saved(with_component(nodes, edges), "near-roots")
    placed = places.join(rooted.select(F.col("node").alias("key"), "root"), "key")
    spans = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("bucket")
    active = saved(placed.join(spans, "bucket", "left_semi").select("key", "root").distinct(), "near-active")
    found, steps = spanning(prefixes(active, sets, similarity), active), []
    for _ in range(CENTRES):
        links = saved(verified(saved(central(found, similarity), "near-central")), "near-links")
        if links.isEmpty():
            break
        active, step = joined(active, links)
        steps.append(step)
        found = spanning(found, active)
    pairs = saved(crossing(found, similarity), "near-pairs")
    _, step = joined(active, verified_in_blocks(saved(in_blocks(pairs, found), "near-rest"), sets, similarity))
    for step in (*steps, step):
        rooted = rooted.join(step, "root", "left").select("node", F.coalesce("joint", "root").alias("root"))
    return saved(rooted, "near-roots")


def across(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """pairs (a, b) whose ends are of different components of active (key, root), with the components, a_root and b_root."""
    root = lambda k: active.select(F.col("key").alias(k), F.col("root").alias(f"{k}_root"))
    return pairs.join(root("a"), "a").join(root("b"), "b").where("a_root != b_root")


def joined(active: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """active (key, root) with the components that links (a, b) join as one, and (root, joint): which each of them became."""
    edges = saved(across(links, active).select(F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b")).distinct(), "near-links")
    became = saved(with_component(active.select(F.col("root").alias("node")).distinct(), edges).select(F.col("node").alias("root"), F.col("root").alias("joint")), "near-joint")
    return active.join(became, "root").select("key", F.col("joint").alias("root")), became


def fingerprint_links(keyed: DataFrame, nodes: DataFrame, words_each: int) -> DataFrame:
    """keyed: (doc_id, text, digest); nodes: (key, digest). Edges (a, b), a > b, that hang each text on the least key of its group by op3's method."""
    rows = saved(fingerprints(keyed, words_each, "digest").dropDuplicates(["digest"]).select("digest", "fp"), "near-fps")
    fps = saved(nodes.join(rows.hint("merge"), "digest").select("key", "fp"), "near-fps")
    cells_of = saved(fps.groupBy("fp").agg(F.min("key").alias("least")).withColumn("cell", embedding(F.col("fp"))), "near-fp-nodes")
    rooted = with_component(cells_of.select(F.col("fp").alias("node"), "least"), saved(links(cells_of.select("fp", "cell")), "near-fp-links"))
    least = rooted.groupBy("root").agg(F.min("least").alias("b"))
    named = rooted.join(least.hint("merge"), "root").select(F.col("node").alias("fp"), "b")
    return fps.join(named.hint("merge"), "fp").where("key > b").select(F.col("key").alias("a"), "b")


def drop_near_copies(docs: DataFrame, words_each: int = 5, similarity: float = 0.8, fingerprint_words: int | None = None) -> DataFrame:
    """docs, all its columns, with one row, that of the least doc_id, of each group of near copies.

    Two texts are linked if their sets of word shingles have a Jaccard similarity of `similarity` or more, which is verified on the whole sets; groups are
    what links connect. With fingerprint_words, texts that op3's method links by fingerprints of so many words a shingle are linked as well. Candidates share one of TABLES codes of their shingles, see there for the chance; of those none is left out. Rows with equal text, told by its SHA-256,
    are one node; of rows that repeat an identifier and a text one stays. A null text has no words and is linked to others without words; null identifiers sort first.
    A very long text takes time in proportion to its length; its shingles, eight bytes each, are held by one task at a time.
    """
    ship(docs.sparkSession)
    rows_in = in_one(docs)
    text = F.encode(F.coalesce(F.col("row.text"), F.lit("")), "UTF-8")
    keyed = rows_in.select("row", F.col("row.doc_id").cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            codes = [min_codes(shingle_set(t, words_each)).tolist() for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(codes, pa.list_(pa.int64()))], ["doc_id", "digest", "codes"])

    rows = saved(keyed.select(F.col("id").alias("doc_id"), "digest", text.alias("text")).mapInArrow(compute, "doc_id long, digest binary, codes array<long>"), "near-codes")
    nodes = rows.groupBy("digest").agg(F.min(F.struct("doc_id"))["doc_id"].alias("least"), F.first("codes").alias("codes"))
    nodes = saved(nodes.withColumn("key", F.monotonically_increasing_id()), "near-nodes")
    places = nodes.select("key", F.explode("codes").alias("bucket"))
    least = places.groupBy("bucket").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    places = saved(places.join(least, "bucket"), "near-places")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.record_batch([b.column(0), pa.array([shingle_set(t, words_each) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["key", "shingles"])

    crowd = places.select("key").distinct().join(nodes.select("key", "digest", "least"), "key").withColumnRenamed("digest", "wanted")
    texts = keyed.select("digest", "id", text.alias("text")).join(crowd, (F.col("digest") == F.col("wanted")) & F.col("id").eqNullSafe(F.col("least")))
    sets = saved(texts.select("key", "text").mapInArrow(shingles, "key long, shingles array<long>").dropDuplicates(["key"]), "near-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k in range(b.num_rows):
                s, t = (b.column(c)[k].values.to_numpy() for c in (2, 3))
                keep.append(similar(s, t, similarity))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        held = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("t")), "b")
        return held.select("a", "b", "s", "t").mapInArrow(verify, "a long, b long")

    linked = fingerprint_links(keyed.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text"), "digest"), nodes.select("key", "digest"), fingerprint_words) if fingerprint_words else None
    rooted = near_components(nodes.select(F.col("key").alias("node")), places, sets, similarity, verified, linked)
    named = rooted.join(nodes.select(F.col("key").alias("node"), F.col("digest").alias("wanted"), "least"), "node")
    stays = named.groupBy("root").agg(F.min(F.struct("least", "wanted")).alias("m")).select("m.wanted", "m.least")
    kept = keyed.join(stays, (F.col("digest") == F.col("wanted")) & F.col("id").eqNullSafe(F.col("least")))
    again = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["digest", "least"])
    return kept.select("row.*")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
