"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units, runs of spaces with what follows up to the next space, which no piece of the model spans. Each
distinct unit is a lattice: its substrings, up to the length of the longest piece, are exploded and joined with the piece
table, and the pieces found are its edges. Edges are grouped by unit and folded with Spark's aggregate():

* unigram models: Viterbi, the path with the largest sum of scores;
* BPE models: the scores are priorities of merges, whose sum means nothing, and the largest sum gives other ids than the
  model's own encoder. The fold takes the edges by priority instead, and a piece is made if just two pieces of the
  unit so far make it up. That equals merging the best pair first again and again, if every piece comes about from merges
  of higher priority than its own, which is checked for the whole vocabulary before a model is used.

Documents are gathered into blocks of bounded text, each with a dictionary of its distinct units; a document's pieces are read off by
the numbers of its units there. So a unit is met once a block by any join, however often it occurs.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import ship

from .common import read_table, saved, small

SPACE = "▁"
#: Bytes of text in a block, about; a longer document is a block of its own.
BLOCK_BYTES = 32 << 20
#: Bits of a unit's number in the dictionary of its block, and of a block's number in its task.
NUMBER_BITS, BLOCK_BITS = 26, 12
#: Units whose edges a task groups in memory; if it has more, Spark goes on by sorting.
GROUPED_UNITS = 150_000
IN_MEMORY = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
#: Units up to this length keep their boundaries in the bits of one number.
SHORT = 61
#: Codes of code points without a piece begin here; codes of pieces are their places in the piece table.
ODD = 1 << 24
UNIGRAM, BPE = 1, 2


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model by code, its order of priority: pieces that text can match, with their ids and scores."""

    kind: int
    text: tuple[str, ...]
    ids: tuple[int, ...]
    scores: tuple[float, ...]
    #: The id of each byte, or that of the unknown piece for all.
    byte_ids: tuple[int, ...]
    #: What each id stands for, as bytes; a byte's id for that byte.
    values: tuple[bytes, ...]

    @property
    def ranks(self) -> list[int]:
        """The place of each piece's score among the scores, the highest first."""
        place = {x: k for k, x in enumerate(sorted(set(self.scores), reverse=True))}
        return [place[x] for x in self.scores]

    @property
    def longest(self) -> int:
        return max(map(len, self.text))


def load(name: str = "piece_bpe_32k.model") -> Pieces:
    """name: a path, or a file of the public tokenizers that are installed."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    model = SentencePieceProcessor(model_file=name)
    spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError(f"{name} normalises text in a way that is not built")
    kind = spec.trainer_spec.model_type
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"{name} is neither a unigram nor a BPE model")
    size = model.vocab_size()
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
    values = [b"" if model.is_control(i) else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
    return pieces_of(kind, [(model.id_to_piece(i), i, model.get_score(i)) for i in plain], [byte_ids.get(b, model.unk_id()) for b in range(256)], values)


def pieces_of(kind: int, rows: list[tuple[str, int, float]], byte_ids: list[int], values: list[bytes]) -> Pieces:
    """rows: (piece, id, score)."""
    text, ids, scores = zip(*sorted(rows, key=lambda r: (-r[2], len(r[0]), r[0])))
    if any(SPACE in t.lstrip(SPACE) for t in text):
        raise ValueError("a piece has a space after other letters")
    out = Pieces(kind, text, ids, scores, tuple(byte_ids), tuple(values))
    if kind == BPE and any(a == b and (t + u).strip(SPACE) for a, b, t, u in zip(scores, scores[1:], text, text[1:])):
        raise ValueError("pieces other than runs of spaces have equal scores")
    if kind == BPE and not in_priority(out):
        raise ValueError("a piece of the model does not come about by merges of higher priority")
    return out


def in_priority(pieces: Pieces) -> bool:
    """Whether each piece, taken alone, is what merging the best pair first makes of its letters, with its own merge the last in priority."""
    place = {t: k for k, t in enumerate(pieces.text)}
    for k, t in enumerate(pieces.text):
        parts = list(t)
        while len(parts) > 1:
            best = min((place.get(a + b, ODD), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] > k:
                return False
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return True


class Cuts:
    """Cuts words where no piece can span: between two letters that stand side by side in none."""

    def __init__(self, pieces: Pieces) -> None:
        pairs = {(ord(a), ord(b)) for t in pieces.text for a, b in zip(t, t[1:])}
        letters = sorted({c for pair in pairs for c in pair})
        self.kind = np.zeros(0x110000, np.int32)  # 0 is all letters without a pair
        self.kind[letters] = np.arange(1, len(letters) + 1)
        self.pair = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in pairs:
            self.pair[self.kind[a], self.kind[b]] = True

    def units(self, words: pa.StringArray) -> tuple[list[str], np.ndarray]:
        """The units of all words, each word with SPACE before it, one after another, and how many each word has."""
        whole = "".join(SPACE + w for w in words.to_pylist())
        kinds = self.kind[np.frombuffer(whole.encode("utf-32-le"), "<u4")]
        cut = np.append(True, ~self.pair[kinds[:-1], kinds[1:]]) if len(kinds) else np.zeros(0, bool)
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        begins = np.cumsum(lengths) - lengths
        cut[begins] = True
        at = np.flatnonzero(cut)
        edges = [*at.tolist(), len(whole)]
        return [whole[a:b] for a, b in zip(edges, edges[1:])], np.diff(np.append(np.searchsorted(at, begins), len(at)))


MORE_SPACES = re.compile("(?<= ) ")


def spaced(text: str) -> str:
    """text such that splitting it at spaces gives its words without the SPACE that each begins with: further spaces belong to the word that follows."""
    text = text.replace(SPACE, " ")
    out = MORE_SPACES.sub(SPACE, text)
    return SPACE + out[1:] if text.startswith(" ") else out


def spread(at: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all members of the lists `at`, one list after another, where list k has sizes[k] members from starts[k] on."""
    n = sizes[at]
    ends = np.cumsum(n)
    return np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 in few bytes: all lowest bytes first, then the next ones, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (doc_id, crc, text) in tables of about BLOCK_BYTES of text."""
    held, size = [], 0
    for whole in batches:
        for b in small([whole], 256):
            if held and size + b.column(2).nbytes > BLOCK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(b)
            size += b.column(2).nbytes
    if held:
        yield pa.Table.from_batches(held)


def staged(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """A row for each block: block, doc_ids, crcs (of each text as decoding gives it), sizes (units of each document), refs (their numbers in the block's dictionary), and units, that dictionary, the most frequent ones first."""
    cuts = Cuts(pieces)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(blocks(batches)):
            if k >> BLOCK_BITS:
                raise ValueError("a task has too many blocks")
            text = pa.concat_arrays(b["text"].chunks)
            odd = pc.or_(pc.or_(pc.match_substring(text, "  "), pc.starts_with(text, " ")), pc.match_substring(text, SPACE))
            if pc.any(odd).as_py():
                text = pa.array([spaced(t) if o else t for t, o in zip(text.to_pylist(), odd.to_pylist())], pa.string())
            words = pc.split_pattern(pc.if_else(pc.equal(pc.binary_length(text), 0), pa.scalar(None, pa.string()), text), " ")
            per_doc = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = words.flatten().dictionary_encode()
            found, sizes = cuts.units(coded.dictionary)
            units = pa.array(found, pa.string()).dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            refs = units.indices.to_numpy(zero_copy_only=False)[spread(at, np.cumsum(sizes) - sizes, sizes)]
            order = np.argsort(-np.bincount(refs, minlength=len(units.dictionary)), kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            ends = np.append(0, np.cumsum(sizes[at]))[np.append(0, np.cumsum(per_doc))]
            yield pa.record_batch([
                pa.array([TaskContext.get().partitionId() << BLOCK_BITS | k], pa.int64()), *(pa.array([b[c].to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "crc")),
                pa.array([np.diff(ends)], pa.list_(pa.int64())), pa.array([packed(number[refs])], pa.binary()), pa.array([units.dictionary.take(pa.array(order)).to_pylist()], pa.list_(pa.string())),
            ], ["block", "doc_ids", "crcs", "sizes", "refs", "units"])

    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(F.encode(F.translate(text, SPACE, " "), "UTF-8"))
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), crc.alias("crc"), text.alias("text"))
    return saved(thin.mapInArrow(cut, "block long, doc_ids array<long>, crcs array<long>, sizes array<long>, refs binary, units array<string>"), "pieces-staged")


def edges(units: DataFrame, pieces: Pieces) -> DataFrame:
    """The columns of units, which has unit, with code, rank, at, length: a row for each piece, or code point without one, that stands in a unit."""
    spark, own = units.sparkSession, units.columns
    table = spark.createDataFrame(pa.table({"piece": list(pieces.text), "code": pa.array(range(len(pieces.text)), pa.int32()), "rank": pa.array(pieces.ranks, pa.int32())}))
    size = F.length("unit")
    # From blocks of a long unit, as the place of a letter in a text is found by counting from its start.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / 64).cast("int")), lambda k: F.struct((k * 64).alias("from"), F.substring("unit", k * 64 + 1, F.lit(63 + pieces.longest)).alias("part")))
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("unit").alias("part")))
    parts = units.select(*own, F.explode(F.when(size <= 64, whole).otherwise(blocks)).alias("b")).select(*own, "b.from", "b.part")
    begun = parts.select(*own, "from", "part", F.explode(F.sequence(F.lit(1), F.least(F.length("part"), F.lit(64)))).alias("s"))
    spans = begun.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.length("part") - F.col("s") + 1))).alias("n"))
    found = spans.select(*own, (F.col("from") + F.col("s") - 1).alias("at"), F.substring("part", F.col("s"), F.col("n")).alias("piece"))
    joined = found.join(F.broadcast(table), "piece", "left").where("code IS NOT NULL OR length(piece) = 1")  # the piece table has a fixed size
    # A code point's number, from its bytes in UTF-32.
    point = F.conv(F.hex(F.encode("piece", "UTF-32")), 16, 10).cast("int") + ODD
    return joined.select(*own, F.coalesce("code", point).alias("code"), F.coalesce("rank", F.lit(0)).alias("rank"), "at", F.length("piece").alias("length"))


def bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def edge_bits() -> Column:
    """An edge of a unit of SHORT letters at most: key (rank, end, length and code in one number: of equal ranks the first end comes first, then the shorter
    piece; single letters, which no step makes, come last), ends (the bits of its two boundaries) and span (those and all between)."""
    at, n = F.col("at").cast("long"), F.col("length").cast("long")
    rank = F.when(n > 1, F.col("rank").cast("long")).otherwise(F.lit(1 << 24))
    key = F.shiftleft(rank, 37).bitwiseOR(F.shiftleft(at + n, 31)).bitwiseOR(F.shiftleft(n, 25)).bitwiseOR(F.col("code"))
    return F.struct(key.alias("key"), bit(at).bitwiseOR(bit(at + n)).alias("ends"), (bit(at + n + 1) - bit(at)).alias("span"))


def merged_short(found: Column, size: Column) -> Column:
    """Codes of a unit of SHORT letters at most. found: edge_bits() of its edges, sorted. A piece is made where just one boundary lies within it."""

    def step(mask: Column, x: Column) -> Column:
        makes = (F.bit_count(mask.bitwiseAND(x["span"])) == 3) & (mask.bitwiseAND(x["ends"]) == x["ends"])
        return F.when(makes, mask.bitwiseXOR(mask.bitwiseAND(x["span"])).bitwiseOR(x["ends"])).otherwise(mask)

    def standing(mask: Column) -> Column:
        kept = F.filter(found, lambda x: mask.bitwiseAND(x["span"]) == x["ends"])
        placed = F.sort_array(F.transform(kept, lambda x: F.struct(x["ends"].alias("ends"), x["key"].alias("key"))))
        return F.transform(placed, lambda x: x["key"].bitwiseAND(F.lit((1 << 25) - 1)).cast("int"))

    return F.aggregate(found, bit(size + 1) - 1, step, standing)


def merged_long(found: Column, size: Column) -> Column:
    """The same for any length, with the boundaries as a text of ones and zeros. found: sorted structs of rank, end, length, code, at."""

    def step(mask: Column, x: Column) -> Column:
        span = F.substring(mask, x["at"] + 1, x["length"] + 1)
        makes = span.rlike("^10*10*1$")
        cleared = F.concat(F.lit("1"), F.repeat(F.lit("0"), x["length"] - 1), F.lit("1"))
        return F.when(makes, F.overlay(mask, cleared, x["at"] + 1)).otherwise(mask)

    def standing(mask: Column) -> Column:
        kept = F.filter(found, lambda x: F.substring(mask, x["at"] + 1, x["length"] + 1).rlike("^10*1$"))
        return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["at"].alias("at"), x["code"].alias("code")))), lambda x: x["code"])

    return F.aggregate(F.filter(found, lambda x: x["length"] > 1), F.repeat(F.lit("1"), size + 1), step, standing)


def best_path(found: Column) -> Column:
    """Codes on the path with the largest sum of scores; of equal ones, that whose last piece begins first. found: structs of end, at, code, score, sorted."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("codes")))

    def step(paths: Column, x: Column) -> Column:
        before = F.element_at(paths, x["at"] + 1)
        new = F.struct((before["score"] + x["score"]).alias("score"), F.array_append(before["codes"], x["code"]).alias("codes"))
        return (
            F.when(F.size(paths) <= x["end"], F.array_append(paths, new))
            .when(new["score"] > F.element_at(paths, -1)["score"], F.array_append(F.slice(paths, 1, x["end"]), new))
            .otherwise(paths)
        )

    return F.aggregate(found, start, step, lambda paths: F.element_at(paths, -1)["codes"])


def encode_units(units: DataFrame, pieces: Pieces, short: bool = False) -> DataFrame:
    """units with codes, those of the pieces of each unit in order. units: unit, distinct, none empty, and other columns; short: none is longer than SHORT."""
    size, own = F.length("unit"), units.columns
    if pieces.kind == UNIGRAM:
        spark = units.sparkSession
        scores = spark.createDataFrame(pa.table({"code": pa.array(range(len(pieces.text)), pa.int32()), "score": pa.array(pieces.scores, pa.float64())}))
        unknown = min(pieces.scores) - 10
        scored = edges(units, pieces).join(F.broadcast(scores), "code", "left")  # a fixed size
        x = F.struct((F.col("at") + F.col("length")).alias("end"), "at", "code", F.coalesce("score", F.lit(unknown)).alias("score"))
        return scored.groupBy(*own).agg(F.sort_array(F.collect_list(x)).alias("found")).select(*own, best_path(F.col("found")).alias("codes"))
    if short:
        grouped = edges(units, pieces).groupBy(*own).agg(F.sort_array(F.collect_list(edge_bits())).alias("found"))
        return grouped.select(*own, merged_short(F.col("found"), size).alias("codes"))
    end = (F.col("at") + F.col("length")).alias("end")
    found = edges(units, pieces).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("rank", end, "length", "code", "at"))).alias("found"))
    return found.select(*own, merged_long(F.col("found"), size).alias("codes"))


def ids_of(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each code, one after another, and how many each has."""
    table = np.array(pieces.ids, np.uint32)
    odd = np.flatnonzero(codes >= ODD)
    n = np.ones(len(codes), np.int64)
    spelled = [[pieces.byte_ids[x] for x in chr(c - ODD).encode()] for c in codes[odd].tolist()]
    n[odd] = [len(x) for x in spelled]
    out = np.empty(n.sum(), np.uint32)
    starts = np.cumsum(n) - n
    plain = codes < ODD
    out[starts[plain]] = table[codes[plain]]
    for at, x in zip(starts[odd].tolist(), spelled):
        out[at : at + len(x)] = x
    return out, n


def dictionary(entries: DataFrame, pieces: Pieces) -> DataFrame:
    """key and codes of all entries (key, unit). Each distinct unit is encoded once, where its entries have been brought together."""
    out = None
    for short in (True, False):
        some = entries.where(F.length("unit") <= SHORT if short else F.length("unit") > SHORT).repartition("unit")
        # Both uses read the same two columns, so that Spark shuffles them once.
        encoded = encode_units(some.groupBy("unit").agg(F.min("key").alias("least")), pieces, short)
        part = some.join(encoded, "unit").select("key", "codes")
        out = part if out is None else out.unionByName(part)
    return out


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """A row for each row of docs: doc_id, crc, ids (binary, little-endian unsigned 32-bit).

    A null or empty text has no ids; crc is the CRC-32 of what decoding gives, the text with SPACE read as a space. Repeated rows and null identifiers have
    rows of their own; an empty table gives none; other columns are not read. A code point that is in no piece is spelled in bytes.
    """
    ship(docs.sparkSession)
    rows = staged(docs, pieces)
    entries = rows.select("block", F.posexplode("units").alias("k", "unit")).select(F.shiftleft("block", NUMBER_BITS).bitwiseOR(F.col("k")).alias("key"), "unit")
    conf = docs.sparkSession.conf
    before = conf.get(IN_MEMORY)
    conf.set(IN_MEMORY, str(GROUPED_UNITS))  # how Spark groups, not what it finds
    try:
        coded = saved(dictionary(entries, pieces), "pieces-codes")
    finally:
        conf.set(IN_MEMORY, before)
    codes = coded.select(F.shiftright("key", NUMBER_BITS).alias("of"), F.col("key").bitwiseAND(F.lit((1 << NUMBER_BITS) - 1)).cast("int").alias("k"), "codes")

    def look_up(texts: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("k")
        lists = pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *words["codes"].chunks])
        flat, each = ids_of(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pieces)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(lengths))]
        starts, sizes = ends[:-1], np.diff(ends)
        docs, crcs, out = [], [], []
        for r in texts.select(["doc_ids", "crcs", "sizes", "refs"]).to_pylist():
            refs = unpacked(r["refs"]).astype(np.int64)
            for part in np.split(refs, np.cumsum(r["sizes"])[:-1]) if len(r["sizes"]) else []:
                out.append(flat[spread(part, starts, sizes)].astype("<u4").tobytes())
            docs += r["doc_ids"]
            crcs += r["crcs"]
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "crc": pa.array(crcs, pa.int64()), "ids": pa.array(out, pa.binary())})

    return rows.drop("units").groupBy("block").cogroup(codes.groupBy("of")).applyInArrow(look_up, "doc_id long, crc long, ids binary")


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the text of its ids in the column `text`. Null ids give a null text; bytes that are not UTF-8 are replaced by U+FFFD."""
    names = [c for c in encoded.columns if c != text]
    place = names.index(ids)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pieces.values
        for b in small(batches):
            out = []
            for x in b.column(place).to_pylist():
                whole = None if x is None else b"".join([values[i] for i in np.frombuffer(x, "<u4").tolist()])
                if whole is not None:
                    whole = whole.decode("utf-8", "replace")
                    whole = whole[1:] if whole.startswith(" ") else whole  # the space that encoding puts first
                out.append(whole)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*names, text])

    return encoded.select(*names).mapInArrow(join, encoded.select(*names).withColumn(text, F.lit("").cast("string")).schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_crc32, and restored: whether the decoded text is the text."""
    pieces = load()
    ids = encode(read_table(spark, sf_dir, "documents"), pieces)
    found = decode(ids, pieces)
    return found.select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.crc32(F.encode("text", "UTF-8")).alias("decoded_crc32"),
        (F.crc32(F.encode("text", "UTF-8")) == F.col("crc")).alias("restored"),
    )
