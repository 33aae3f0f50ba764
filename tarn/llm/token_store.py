"""Token-ID output: frequency-ranked ids, byte-aligned coding with separate control bytes, numpy decoding."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import base

END_ID = 1
_BLOCK_IDS = 1 << 18  # ids in a block at most, unless one document has more
_RANGE_BYTES = 32 << 20  # of ids that one task orders and packs
_WORD_CACHE = 500_000  # pieces that a task keeps between slices
_TEXT_BYTES = 2 << 20  # of text that is cut into pieces at once; that takes some 15 times as much
#: A word of Latin-1 letters (whose normal form has letters only), then ASCII punctuation without the underscore.
_WORD_AND_MARKS = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-^`{-~]*)$"

# ---- coding -------------------------------------------------------------------------------------------------------
# Each id's rank takes 1 to 4 bytes, little endian; its length less one is two bits of a control byte (four ids each,
# lowest bits first). Control bytes and data bytes are stored apart.

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2**32."""
    values = ranks.astype(np.uint32)
    length = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.ones(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = length
    quads = padded.reshape(-1, 4) - 1
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4) < length[:, None]].tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block; lengths come from a table with a row for each control byte."""
    if not n:
        return np.zeros(0, np.uint32)
    length = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    if int(length.sum()) != len(data):
        raise ValueError("control bytes and data bytes disagree")
    raw = np.zeros((n, 4), np.uint8)
    raw[np.arange(4) < length[:, None]] = np.frombuffer(data, np.uint8)
    return raw.reshape(-1).view("<u4").astype(np.uint32)


# ---- tokenising ---------------------------------------------------------------------------------------------------


#: Rules of a vocabulary file whose texts can be encoded by pieces.
_PIECE_RULES = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _splits_into_pieces(spec: dict) -> bool:
    """Whether a vocabulary file's rules are those that ``WordEncoder`` relies on."""
    model = spec["model"]
    steps = [(spec.get(k) or {}).get("normalizers" if k == "normalizer" else "pretokenizers") == rules for k, rules in _PIECE_RULES.items()]
    return all(steps) and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("continuing_subword_prefix")


def _ids_of(tokenizer, texts: list[str], at_once: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """All ids in order, and each text's number of ids; the library's records of a few texts are held at a time, as they take many times their ids."""
    ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for at in range(0, len(texts), at_once):
        each = [e.ids for e in tokenizer.encode_batch_fast(texts[at : at + at_once], add_special_tokens=False)]
        ids.append(np.fromiter((i for x in each for i in x), np.uint32))
        sizes.append(np.array([len(x) for x in each], np.int64))
    return np.concatenate(ids), np.concatenate(sizes)


class WordEncoder:
    """Whole texts through the tokenizers library, by pieces between white space.

    The vocabulary's pre-tokenizer never joins characters across white space, nor a
    Latin-1 letter with ASCII punctuation after it; its normalizer works on each character or
    within such a piece. A text's ids are thus those of its pieces one after another,
    and a distinct piece goes through the library once while it is in the bounded
    cache. Words of ASCII letters go many at a time, through the same model without
    the normalizer, which does nothing to them but lower-case. A vocabulary file with
    other rules than these goes through the library text by text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        # a task has one core; the library's threads would each keep memory of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.by_piece = _splits_into_pieces(json.load(file))
        self.plain = None
        if self.by_piece:
            self.plain = Tokenizer(self.tokenizer.model)  # shared, not loaded again
            self.plain.pre_tokenizer = Split(" ", "removed")
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self):
        self.known = pa.array([""], pa.large_string())  # a piece's place is its code
        self.starts, self.sizes, self.flat = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(0, np.uint32)

    def _joined(self, tokenizer, words: list[str]) -> tuple[list[np.ndarray], list[int]] | None:
        """Ids and sizes of words, many to a call; None if the ends of words don't tell them apart."""
        ids = _ids_of(tokenizer, [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)], 16)[0]
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or (len(ids) and stops[-1] != len(ids)):
            return None
        return ids, np.diff(stops, prepend=0)

    def _learn(self, pieces: list[str]) -> None:
        ascii_words = [p for p in pieces if p.isascii() and p.isalpha()]
        other_words = [p for p in pieces if not p.isascii() and p.isalpha()]
        rest = [p for p in pieces if not p.isalpha()]
        ids, sizes, order = [], [], []
        for tokenizer, words in ((self.plain, ascii_words), (self.tokenizer, other_words)):
            if words and (got := self._joined(tokenizer, words)):
                ids.append(got[0])
                sizes.append(got[1])
                order += words
            else:
                rest = words + rest
        if rest:
            got = _ids_of(self.tokenizer, rest)
            ids.append(got[0])
            sizes.append(got[1])
            order += rest
        size = np.concatenate(sizes)
        self.known = pa.concat_arrays([self.known, pa.array(order, pa.large_string())])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(size) - size]).astype(np.int32)
        self.sizes = np.concatenate([self.sizes, size]).astype(np.int32)
        self.flat = np.concatenate([self.flat, *ids])

    def _codes(self, pieces: pa.Array) -> np.ndarray:
        """Places in the cache; what it lacks is learnt first. Known pieces never become Python strings."""
        codes = pc.index_in(pieces, value_set=self.known)
        if not codes.null_count:
            return codes.to_numpy(zero_copy_only=False)
        absent, before = codes.is_null(), len(self.known)
        missing = pieces.filter(absent)
        self._learn(pc.unique(missing).to_pylist())
        out = pc.fill_null(codes, 0).to_numpy(zero_copy_only=False).copy()
        # looked up among the new ones alone: the table of all known ones is built once a slice
        out[absent.to_numpy(zero_copy_only=False)] = before + pc.index_in(missing, value_set=self.known.slice(before)).to_numpy(zero_copy_only=False)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each text's number of ids."""
        if not self.by_piece:
            return _ids_of(self.tokenizer, [t or "" for t in texts.to_pylist()], 16)
        spaced = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ").cast(pa.large_string())
        pieces = pc.split_pattern(spaced, " ")
        ends = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        coded = pc.dictionary_encode(pieces.flatten())
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        del spaced, pieces  # a slice's arrays are large: none outlives its use
        index = coded.indices.to_numpy(zero_copy_only=False)
        if not len(index):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        pieces = coded.dictionary
        parts = pc.extract_regex(pieces, _WORD_AND_MARKS)
        cut = parts.is_valid()
        # letter case of ASCII makes no difference to the model; special tokens are not words, and stay as they are
        heads = pc.if_else(cut, pc.ascii_lower(pc.struct_field(parts, "word")), pieces)
        marks = pc.dictionary_encode(pc.if_else(cut, pc.struct_field(parts, "marks"), ""))
        if len(self.known) > _WORD_CACHE:
            self.clear()
        codes = self._codes(pa.concat_arrays([heads, marks.dictionary]))
        own = np.empty((len(heads), 2), np.int32)
        own[:, 0] = codes[: len(heads)]
        own[:, 1] = codes[len(heads) :][marks.indices.to_numpy()]
        both = own[index].reshape(-1)  # word, its marks, next word, ...
        del pieces, parts, cut, heads, marks, codes, own, index, coded
        each = self.sizes[both]
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(each, dtype=np.int32)])
        place = np.repeat(self.starts[both] - total[:-1], each)
        place += np.arange(total[-1], dtype=np.int32)
        return self.flat[place], (total[2 * ends[1:]] - total[2 * ends[:-1]]).astype(np.int64)


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _end_each(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """With ``end_id`` after each document's ids."""
    out = np.full(len(ids) + len(sizes), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(sizes + 1) - 1] = False
    out[keep] = ids
    return out, sizes + 1


# ---- the store ----------------------------------------------------------------------------------------------------


def _ranked(tokens: DataFrame, dtype: np.dtype) -> list[int]:
    """All ids by falling frequency, then by value; as many rows as the vocabulary has reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype))
            if len(n) > len(total):
                total = np.pad(total, (0, len(n) - len(total)))
            total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return [r.id for r in sorted(rows, key=lambda r: (-r.n, r.id))]


def write_store(
    docs: DataFrame, path: str, tokenizer_path: str, order_col: str = "doc_id", text_col: str = "text", id_col: str = "doc_id", end_id: int = END_ID
) -> None:
    """Write every whole text's ids, in ascending ``order_col`` (whole numbers), under ``path``.

    ``blocks`` holds a row for each run of documents in a partition: its place
    (``part, block``, and the part's ids before it), the documents' ``id_col`` values
    and numbers of ids, the control bytes, the data bytes and a CRC-32 of
    both. ``ranks`` is the list of ids by falling frequency. Blocks hold whole
    documents and about 256 k ids; tokens are written once before they are ordered,
    so a lost executor costs no second tokenising.

    Null texts are empty and take only the end id. Equal ``order_col`` values are
    ordered by ``id_col``, else in no set order; nulls come first. Other columns are ignored. An
    empty table gives a store without blocks.
    """
    spark = docs.sparkSession
    scratch = base.fresh_path(spark, "tokens")
    source = docs.select(F.col(order_col).cast("long").alias("seq"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = _tokenised(source, scratch, tokenizer_path, end_id)
    dtype = _encoder(tokenizer_path).dtype
    order = _ranked(tokens, dtype)
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    base_rank = spark.sparkContext.broadcast(rank)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, within = TaskContext.get().partitionId(), 0, 0
        own_ids: list = []
        raws: list = []
        held = 0

        def flush():
            nonlocal block, within, own_ids, raws, held
            ids = [np.frombuffer(r, dtype) for r in raws]
            control, data = encode_block(base_rank.value[np.concatenate(ids)])
            row = [part, block, within, own_ids, [len(x) for x in ids], held, control, data, zlib.crc32(data, zlib.crc32(control))]
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES, strict=True)], names=_BLOCK_NAMES)
            block, within, own_ids, raws, held = block + 1, within + held, [], [], 0
            return out

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                raw = raw.as_py()
                if own_ids and held + len(raw) // dtype.itemsize > _BLOCK_IDS:
                    yield flush()
                own_ids.append(doc_id)
                raws.append(raw)
                held += len(raw) // dtype.itemsize
        if own_ids:
            yield flush()

    # ranges of about _RANGE_BYTES of ids (one a core at least), whatever the session's number of shuffle partitions
    parts = max(spark.sparkContext.defaultParallelism, -(-(tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // _RANGE_BYTES))
    ordered = tokens.repartitionByRange(parts, F.col("seq").asc_nulls_first()).sortWithinPartitions(F.col("seq").asc_nulls_first(), F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(base.frugal(pack), _BLOCK_DDL).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(END_ID if not order else int(i), k) for k, i in enumerate(order or [END_ID])], "id long, rank long").coalesce(1).write.parquet(f"{path}/ranks")
    base.drop_table(spark, scratch)


_BLOCK_NAMES = ["part", "block", "within", "doc_ids", "sizes", "n_ids", "control", "data", "check"]
_BLOCK_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
_BLOCK_DDL = "part long, block long, within long, doc_ids array<long>, sizes array<long>, n_ids long, control binary, data binary, check long"


def _tokenised(source: DataFrame, path: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """``seq, doc_id, ids`` as a table written under ``path``; ids take two bytes each where the vocabulary allows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        try:
            for part in (part for batch in batches for part in base.slices(batch, most=_TEXT_BYTES, rows=batch.num_rows)):
                ids, sizes = _end_each(*encoder.encode(part.column("text")), end_id)
                offsets = np.concatenate([[0], np.cumsum(sizes)]) * encoder.dtype.itemsize
                data = pa.py_buffer(ids.astype(encoder.dtype).tobytes())
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), data])
                yield pa.RecordBatch.from_arrays([part.column("seq"), part.column("doc_id"), packed], names=["seq", "doc_id", "ids"])
                del ids, sizes, offsets, data, packed
                pa.default_memory_pool().release_unused()
        finally:
            encoder.clear()

    spark = source.sparkSession
    with base.arrow_rows(spark, base.ROWS_IN_BATCH):
        source.mapInArrow(base.frugal(run), "seq long, doc_id long, ids binary").write.option("compression", "zstd").parquet(path)
    return spark.read.schema("seq long, doc_id long, ids binary").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of each stored document; the positions follow from the blocks' id counts."""
    order = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    lookup = spark.sparkContext.broadcast(np.array(order, np.uint32))
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{path}/blocks")
    # a row for each write task: few, whatever the input
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS part_start")
    placed = blocks.join(F.broadcast(parts), "part").withColumn("first", F.col("part_start") + F.col("within"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["data"], zlib.crc32(row["control"])) != row["check"]:
                    raise ValueError(f"block {row['part']}/{row['block']} is damaged")
                ids = lookup.value[decode_block(row["control"], row["data"], row["n_ids"])].astype("<u4")
                cut = np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["first"] + cut[:-1], pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "ids"],
                )

    return placed.mapInArrow(base.frugal(unpack), "doc_id long, start long, ids binary")


def token_digests(stored: DataFrame) -> DataFrame:
    return stored.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_store(spark, sf_dir):
    """Contract query: write the store of ``documents``, read it back, one row per document."""
    path = base.fresh_path(spark, "token-store")
    write_store(base.table(spark, sf_dir, "documents"), path, vocabulary())
    return token_digests(read_store(spark, path))
