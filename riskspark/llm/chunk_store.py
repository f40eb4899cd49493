"""A content-addressed store of token ids.

A rolling hash over the last ids cuts each document into chunks, so that equal passages give equal chunks wherever they
stand. Each distinct chunk is stored once, under the digest of its bytes. A recipe lists a document's chunks and the root
of the Merkle tree over them; a manifest holds a root over the documents of each recipe file.

Files, all Parquet: chunks(digest, ids: a byte that says 2 or 4, then ids of so many bytes, little-endian), recipes(part,
doc_id, start, n_tokens, root, digests) in ascending doc_id order, manifest(part, docs, tokens, root).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import ship

from .common import RANGE_ROWS, mixed, new_dir, read_table, saved, small, with_running_total
from .wordbpe import encoder, tokenizer_file

END_ID = 2
#: Chunks have about 2**CUT_BITS ids more than SHORTEST, and LONGEST at most.
CUT_BITS, SHORTEST, LONGEST = 8, 64, 1024
#: The reflected CRC-32 polynomial.
POLY = np.uint64(0xEDB88320)


GEAR = mixed(np.arange(1 << 16)).astype(np.uint32)


#: Bytes of ids whose chunks one task makes unique, about.
CHUNK_BYTES_A_TASK = 16 << 20


#: Ids that are cut at a time, about.
CUT_IDS = 1 << 20


def marks_of(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end. The hash at a place depends on the 32 ids before it only."""
    h = GEAR[ids & 0xFFFF]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def ends_of(marks: list[int], last: int, n: int) -> list[int]:
    """Ends of the chunks of a document from last to n, of the marks that lie in it."""
    out = []
    for m in [*marks, n]:
        while m - last > LONGEST:
            last += LONGEST
            out.append(last)
        if m - last >= SHORTEST or m == n and m > last:
            out.append(m)
            last = m
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document."""
    return ends_of(marks_of(ids).tolist(), 0, len(ids))


def chunked(docs: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The number of ids and the packed chunks of each document, whose ids are given at 32 bits each.

    Documents are hashed together: a first chunk has more than the 32 ids that a hash depends on, so that no cut depends on the document before.
    """
    at = 0
    while at < len(docs):
        to, size = at, 0
        while to < len(docs) and (to == at or size + len(docs[to]) <= 4 * CUT_IDS):
            size += len(docs[to])
            to += 1
        whole = np.frombuffer(b"".join(docs[at:to]), "<u4")
        marks, width = marks_of(whole), 2 if whole.max(initial=0) < 65536 else 4
        data = whole.astype("<u2").tobytes() if width == 2 else b""
        begins = np.append(0, np.cumsum([len(d) // 4 for d in docs[at:to]]))
        first, places, begins = np.searchsorted(marks, begins, "right").tolist(), marks.tolist(), begins.tolist()
        for k in range(to - at):
            last, n, parts = begins[k], begins[k + 1], []
            for e in ends_of(places[first[k] : first[k + 1]], last, n):
                parts.append(b"\2" + data[2 * last : 2 * e] if width == 2 else packed(whole[last:e]))
                last = e
            yield n - begins[k], parts
        at = to


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def packed(ids: np.ndarray) -> bytes:
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\4" + ids.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


def merkle_root(leaves: list[bytes]) -> bytes:
    """An odd leaf moves up as it is; leaves and inner nodes are hashed apart. No leaves: the digest of nothing."""
    level = [digest_of(b"\0" + x) for x in leaves] or [digest_of(b"")]
    while len(level) > 1:
        level = [digest_of(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo the CRC's, bits reflected."""
    p = np.zeros_like(a)
    for k in range(31, -1, -1):
        p ^= b * (a >> np.uint64(k) & np.uint64(1))
        b = (b >> np.uint64(1)) ^ POLY * (b & np.uint64(1))
    return p


def joined_crc32(sums: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """CRC-32 of each row's chunks put together. sums and sizes, in bytes, of all chunks; starts: each row's first chunk, no row is empty."""
    ends = np.cumsum(sizes)
    rows = np.diff(np.append(starts, len(sizes)))
    after = np.repeat(ends[np.append(starts[1:], len(sizes)) - 1], rows) - ends
    power, square = np.full(len(sums), 1 << 31, np.uint64), np.array([1 << 30], np.uint64)
    for _ in range(3):
        square = times(square, square)
    for k in range(int(after.max(initial=0)).bit_length()):
        at = (after >> k & 1).astype(bool)
        power[at] = times(power[at], np.broadcast_to(square, at.sum()))
        square = times(square, square)
    return np.bitwise_xor.reduceat(times(power, sums.astype(np.uint64)), starts)


def write_store(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID) -> None:
    """Encodes docs and writes the store. A null text is empty, and so one end id; repeated rows are documents of their own."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer))  # a vocabulary file of fixed size
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sent = encoder(spec.value), set()
        for b in small(batches):
            out = []
            for n, parts in chunked([x + end for x in enc.encode(b.column(1).to_pylist())]):
                digests, own = [digest_of(p) for p in parts], []
                for d, p in zip(digests, parts):
                    own.append(None if d in sent else p)
                    if len(sent) < 200_000:  # a task sends a chunk once, or as often as it likes when it has sent many
                        sent.add(d)
                out.append((n, merkle_root(digests), digests, own))
            sizes, root, digests, own = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(root, pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(own, pa.list_(pa.binary()))], ["doc_id", "n_tokens", "root", "digests", "chunks"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ship(docs.sparkSession)
    staged = saved(thin.mapInArrow(encode, "doc_id long, n_tokens long, root binary, digests array<binary>, chunks array<binary>"), "staged")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, data = None, b""
        for b in batches:
            keep = []
            for k, (d, x) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if d != last:
                    keep.append(k)
                elif x != data:
                    raise ValueError("two chunks have one digest")
                last, data = d, x
            yield b.take(pa.array(keep, pa.int32()))

    sent = staged.select(F.explode(F.arrays_zip("digests", "chunks")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.chunks").alias("ids")).where("ids IS NOT NULL")
    n = 1 + 4 * (staged.agg(F.sum("n_tokens")).first()[0] or 0) // CHUNK_BYTES_A_TASK
    sent.repartition(n, "digest").sortWithinPartitions("digest").mapInArrow(once, "digest binary, ids binary").write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = with_running_total(staged.drop("chunks"), ["doc_id", "root"], F.col("n_tokens"), "start", "recipes")
    parts = max(1, staged.count() // RANGE_ROWS)
    recipes.repartitionByRange(parts, "start").withColumn("part", F.spark_partition_id()).sortWithinPartitions("start").write.parquet(f"{path}/recipes")
    manifest(docs.sparkSession, path).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, docs, tokens, root: a Merkle root over the documents of each recipe file, of about RANGE_ROWS rows."""

    def root(part: pa.Table) -> pa.Table:
        part = part.sort_by("start")
        return pa.table({"part": part["part"][:1], "docs": pa.array([part.num_rows], pa.int64()), "tokens": pa.array([sum(part["n_tokens"].to_pylist())], pa.int64()), "root": pa.array([merkle_root(part["root"].to_pylist())], pa.binary())})

    return spark.read.parquet(f"{path}/recipes").select("part", "start", "n_tokens", "root").groupBy("part").applyInArrow(root, "part int, docs long, tokens long, root binary")


def chunk_sums(spark: SparkSession, path: str) -> DataFrame:
    """digest, n_ids, sum: read from every stored chunk, whose digest is verified; sum is the CRC-32 of its ids at 32 bits each."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sums = [], []
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if digest_of(x) != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
                ids = unpacked(x)
                n.append(len(ids))
                sums.append(zlib.crc32(ids.tobytes()))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.int64())], ["digest", "n_ids", "sum"])

    return spark.read.parquet(f"{path}/chunks").select("digest", "ids").mapInArrow(read, "digest binary, n_ids long, sum long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids: whole documents put together from their chunks."""
    ship(spark)

    @F.pandas_udf("array<int>")
    def ids(parts):
        return parts.map(lambda x: np.concatenate([unpacked(p) for p in x]).astype(np.int32))

    links = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("digests").alias("k", "digest"))
    parts = links.join(spark.read.parquet(f"{path}/chunks"), "digest").groupBy("start", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return parts.select("doc_id", "start", ids(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    Every chunk is read and held against its digest, the chunks' digests against the document's Merkle root and length,
    and the documents' roots against the manifest. CRCs of chunks give the document's by polynomial arithmetic, so that
    ids do not travel again.
    """
    ship(spark)
    recipes = spark.read.parquet(f"{path}/recipes")
    if not manifest(spark, path).exceptAll(spark.read.parquet(f"{path}/manifest")).isEmpty():
        raise ValueError("the recipes do not give the roots of the manifest")
    links = recipes.select("start", F.posexplode("digests").alias("k", "digest"))
    sums = saved(chunk_sums(spark, path), "chunk-sums")
    found = links.join(sums, "digest").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("k", "digest", "n_ids", "sum"))).alias("parts"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = b.column(4)
            sizes, flat = parts.value_lengths().to_numpy(), parts.flatten()
            starts = np.append(0, np.cumsum(sizes)[:-1])
            n_ids = flat.field("n_ids").to_numpy()
            if not (np.add.reduceat(n_ids, starts) == b.column(2).to_numpy()).all():
                raise ValueError("a document's chunks are not as long as its recipe says")
            digests = flat.field("digest").to_pylist()
            for at, n, root in zip(starts.tolist(), sizes.tolist(), b.column(3).to_pylist()):
                if merkle_root(digests[at : at + n]) != root:
                    raise ValueError("a document's chunks do not give its root")
            whole = joined_crc32(flat.field("sum").to_numpy(), 4 * n_ids, starts)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(whole.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = recipes.select("doc_id", "start", "n_tokens", "root").join(found, "start").select("doc_id", "start", "n_tokens", "root", "parts")
    return rows.mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "store")
    write_store(read_table(spark, sf_dir, "documents"), path)
    return read_sums(spark, path)
