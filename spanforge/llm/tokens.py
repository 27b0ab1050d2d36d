"""Token-id output in bit-shuffled blocks.

A block is a fixed number of consecutive token ids of one shard. Its ids are transposed into bit planes (or byte planes),
each plane is compressed with zstandard, and the block is stored as one self-describing byte string:

    b"BPS1", kind (1 byte: 1 bit planes, 8 byte planes), number of planes (1 byte), number of ids (u32 LE),
    compressed size of each plane (u32 LE each), the zstandard frames in order of rising significance.

Blocks are rows of a Parquet data set, so Spark's commit protocol makes retried tasks safe and any store that Spark
writes will do. Beside the blocks stands the chunk index (shard, block, first id, number of ids, bytes, first and last
doc_id) from which a reader seeks. A shard is a range of doc_id; in it ids follow ascending doc_id, and each document
ends with the end id. A document may span blocks: every block lists its documents' pieces.

Defined results: null and empty texts are the end id alone; a null doc_id sorts first; repeated rows are stored once
each; an empty table gives no blocks and no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table, tidy

BLOCK_IDS = 1 << 16
END_ID = 1

# ---------------------------------------------------------------- blocks


def pack_block(ids: np.ndarray, kind: int = 1, level: int = 1) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    top = int(ids.max()) if len(ids) else 0
    if kind == 1:
        count = max(1, top.bit_length())
        planes = [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & np.uint8(1), bitorder="little") for k in range(count)]
    else:
        count = max(1, (top.bit_length() + 7) // 8)
        planes = [(ids >> np.uint32(8 * k)).astype(np.uint8) for k in range(count)]
    press = zstandard.ZstdCompressor(level=level)
    frames = [press.compress(p.tobytes()) for p in planes]
    return b"BPS1" + struct.pack("<BBI", kind, count, len(ids)) + struct.pack(f"<{count}I", *map(len, frames)) + b"".join(frames)


def unpack_block(data: bytes) -> np.ndarray:
    if data[:4] != b"BPS1":
        raise ValueError("not a block of token ids")
    kind, count, n = struct.unpack_from("<BBI", data, 4)
    sizes = struct.unpack_from(f"<{count}I", data, 10)
    at, ids, press = 10 + 4 * count, np.zeros(n, "<u4"), zstandard.ZstdDecompressor()
    width = (n + 7) // 8 if kind == 1 else n
    for k, size in enumerate(sizes):
        plane = np.frombuffer(press.decompress(data[at : at + size], max_output_size=max(width, 1)), np.uint8)
        part = np.unpackbits(plane, count=n, bitorder="little") if kind == 1 else plane
        ids |= part.astype("<u4") << np.uint32(k if kind == 1 else 8 * k)
        at += size
    return ids


# ---------------------------------------------------------------- encoding

#: Signs whose words have pieces that are plain to find: runs of letters, and runs of the rest.
_LETTERS = "a-zß-öø-ÿ"
_SIGNS = rf"A-ZÀ-ÖØ-Þ{_LETTERS}.,;:!?*#$%&()\[\]\"/@_+=\-"
_ENDS = r" \t\n\x0b\f\r"
#: A word with any other sign: the tokenizer itself cuts it.
_OTHER = re.compile(rf"((?<![^{_ENDS}])[{_SIGNS}]*+[^{_SIGNS}{_ENDS}][^{_ENDS}]*+)")
_ODD = re.compile(f"[^{_SIGNS}{_ENDS}]")
_PIECE = re.compile(rf"[{_LETTERS}]+|[^{_LETTERS}{_ENDS}]+")
_END = re.compile(rf"[{_ENDS}]")
#: The normalizer, pre-tokenizer and word end that the two expressions above restate.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
PIECES_KEPT = 400_000
#: Code points of a text that are cut into pieces at a time (a longer word is taken whole).
STRETCH = 1 << 20


def _byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Kept(dict):
    """Ids by piece or word; a missing one is made. Of two halves of a fixed size the older goes when the newer is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most // 2, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.older = {}


def _loaded(path: str):
    """(tokenizer, whether its rules are the known ones)."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    return Tokenizer.from_file(path), all(rules.get(k) == v for k, v in _KNOWN.items()) and rules["model"]["type"] == "BPE" and not rules["model"].get("dropout")


class PieceEncoder:
    """Encodes texts. Where the tokenizer's rules are the known ones, no piece crosses white space, so equal pieces have
    equal ids and each distinct one is looked up in the model once; other tokenizers get whole texts."""

    def __init__(self, path: str):
        self.tokenizer, self.known = _loaded(path)
        self.model = self.tokenizer.model
        self.signs = _byte_signs()
        self.pieces, self.others = _Kept(self._piece, PIECES_KEPT), _Kept(self._whole, PIECES_KEPT // 8)

    def _piece(self, piece: str) -> bytes:
        signs = piece if piece.isascii() else "".join([self.signs[b] for b in piece.encode()])
        ids = [t.id for t in self.model.tokenize(signs)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _stretch(self, text: str) -> bytes:
        out, piece = [], self.pieces.__getitem__
        if not _ODD.search(text):
            return b"".join(map(piece, _PIECE.findall(text.lower())))
        for k, part in enumerate(_OTHER.split(text)):
            if k % 2:
                out.append(self.others[part])
            elif part:
                out.extend(map(piece, _PIECE.findall(part.lower())))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if not self.known:
            return self._whole(text)
        if len(text) <= STRETCH:
            return self._stretch(text)
        out, at = [], 0
        while at < len(text):
            cut = _END.search(text, at + STRETCH)
            end = cut.start() if cut else len(text)
            out.append(self._stretch(text[at:end]))
            at = end
        return b"".join(out)


@functools.cache
def encoder_at(path: str) -> PieceEncoder:
    """One encoder for each worker: a tokenizer's memory doesn't come back whole, so none is made anew in each task."""
    return PieceEncoder(path)


BLOCKS = "shard int, block int, first long, n_ids int, payload binary, doc_ids array<long>, ordinals array<long>, offsets array<long>, counts array<long>, lasts array<boolean>"


def _encoder(path: str, end_id: int, block_ids: int, kind: int):
    end = np.array([end_id], "<u4").tobytes()

    @tidy
    def run(batches):
        shard, encoder = TaskContext.get().partitionId(), encoder_at(path)
        pending, held, pieces, block, ordinal = [], 0, [], 0, 0

        def row(blob: bytes):
            ids = np.frombuffer(blob, "<u4")
            cols = list(zip(*pieces, strict=True))
            values = [shard, block, block * block_ids, len(ids), pack_block(ids, kind), *map(list, cols)]
            schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("ordinals", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("lasts", pa.list_(pa.bool_()))])
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids, done = memoryview(encoder.encode(text.as_py()) + end), 0
                while 4 * done < len(ids):
                    now = ids[4 * done : 4 * (done + block_ids - held)]
                    pending.append(now)
                    pieces.append((doc, ordinal, done, len(now) // 4, 4 * done + len(now) == len(ids)))
                    held, done = held + len(now) // 4, done + len(now) // 4
                    if held == block_ids:
                        yield row(b"".join(pending))
                        pending, held, pieces, block = [], 0, [], block + 1
                ordinal += 1
        if held:
            yield row(b"".join(pending))
        encoder.pieces.forget()
        encoder.others.forget()

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, kind: int = 1) -> None:
    """Encode docs(doc_id, text) in ascending doc_id order; blocks go to path/blocks and the chunk index to path/index."""
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    with small_batches(spark):
        rows.mapInArrow(_encoder(tokenizer, end_id, block_ids, kind), BLOCKS).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    index = blocks.select("shard", "block", "first", "n_ids", F.length("payload").alias("bytes"), F.element_at("doc_ids", 1).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"))
    index.write.mode("overwrite").parquet(f"{path}/index")


# ---------------------------------------------------------------- reading

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial, bits reflected."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1
    return out


def join_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two joined byte strings, from theirs and the size of the second."""
    shift, power, bits = 1 << 31, 1 << 30, 8 * size
    while bits:
        if bits & 1:
            shift = _times(power, shift)
        power, bits = _times(power, power), bits >> 1
    return _times(shift, first) ^ second


PIECES = "shard int, ordinal long, doc_id long, offset long, n long, crc long, at long, whole boolean"


@tidy
def _pieces(batches):
    for batch in batches:
        out = []
        cols = [batch.column(c).to_pylist() for c in ("shard", "first", "payload", "doc_ids", "ordinals", "offsets", "counts", "lasts")]
        for shard, first, payload, docs, ordinals, offsets, counts, lasts in zip(*cols, strict=True):
            raw, at = unpack_block(payload).tobytes(), 0
            for doc, ordinal, offset, n, last in zip(docs, ordinals, offsets, counts, lasts, strict=True):
                out.append((shard, ordinal, doc, offset, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), first + at, last and not offset))
                at += n
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        names = ["shard", "ordinal", "doc_id", "offset", "n", "crc", "at", "whole"]
        columns = list(zip(*out, strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


@tidy
def _joined(batches):
    """One row of a document from its pieces, sorted by offset."""
    for batch in batches:
        n, crc = [], []
        for pieces in batch.column("pieces").to_pylist():
            size, whole = pieces[0]["n"], pieces[0]["crc"]
            for p in pieces[1:]:
                whole, size = join_crc(whole, p["crc"], 4 * p["n"]), size + p["n"]
            n.append(size)
            crc.append(whole)
        at = pa.array([p[0]["at"].as_py() for p in batch.column("pieces")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), at], ["shard", "doc_id", "n", "crc", "at"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, from the files. Every block is unpacked once."""
    pieces = Scratch(spark, "pieces").table(spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(_pieces, PIECES), "pieces")
    whole = pieces.where("whole").select("shard", "doc_id", "n", "crc", "at")
    # a piece for each block that a document touches
    cut = pieces.where("not whole").groupBy("shard", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("offset", "n", "crc", "at"))).alias("pieces"))
    cut = cut.select("shard", "doc_id", "pieces").mapInArrow(_joined, "shard int, doc_id long, n long, crc long, at long")
    sizes = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one row a shard
    before, starts = 0, []
    for r in sizes:
        starts.append((r["shard"], before))
        before += r["n"]
    bases = F.broadcast(spark.createDataFrame(starts, "shard int, base long"))
    return whole.union(cut).join(bases, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, offset, ids) pieces of the stored documents."""

    @tidy
    def run(batches):
        for batch in batches:
            docs, offsets, ids = [], [], []
            for payload, d, o, counts in zip(*(batch.column(c).to_pylist() for c in ("payload", "doc_ids", "offsets", "counts")), strict=True):
                docs += d
                offsets += o
                ids += np.split(unpack_block(payload).astype(np.int64), np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(offsets, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "offset", "ids"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, offset long, ids array<long>")


def tokens_of(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs' ids to the shared folder and read the documents back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = f"{Scratch(spark, 'tokens').base}"
    write_tokens(spark, docs, path, tokenizer)
    return read_documents(spark, path)


def op2_bit_shuffled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(spark, table(spark, sf_dir, "documents"))
