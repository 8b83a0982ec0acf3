"""Operator 4, token ids in fixed-width bit-packed files.

Documents are range-partitioned by doc_id, and each task writes one file: ids in ascending doc_id order, in
blocks of BLOCK ids, each id in the fewest bits that hold the vocabulary. Behind the blocks stand their byte
offsets, the documents' ids, starts and lengths, and a footer, so a reader seeks to any id or document and
unpacks whole blocks with numpy. Files go to the shared folder, under a name of the task attempt's own; the
manifest, written by Spark's committer, names only files of attempts that succeeded, so a repeated task or a
lost executor leaves no trace in it. Global starts are a prefix sum over the manifest, one row per file.

Encoding: a boundary before a space that follows a character other than white space is one that the
tokenizer's rule never crosses, so texts are cut there, equal pieces of some megabytes are encoded once by the
library, and those of the last megabytes are kept, and ids are put together by index. Texts with other white space before a space are encoded whole.

Scale: one shuffle, of the texts, by range; a task streams its texts and holds a block and its index.

Defined results: null is empty and has only the end id; rows with equal doc_id stay together, in any order
among themselves; a null doc_id comes first; an empty table writes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import materialize, shared_folder, slices, table

MODEL = "byte_bpe_50k.json"
END_ID = 0
BLOCK = 65_536
#: Bytes of text that are encoded at a time, and of the pieces and ids that a process keeps.
SLICE, KEPT = 16 << 20, 48 << 20
MAGIC = b"GLPACK01"
FOOTER = "<8sBIQQQQ"  # magic, bits, ids per block, blocks, documents, ids, place of the index
#: White space before a space; the class holds every character that the tokenizer's rule takes as such.
ODD_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids one after another, each in so many bits, lowest first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class PieceEncoder:
    """Ids of whole texts, each distinct piece encoded once."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids of tokens that begin with a space
        self.opens[[i for t, i in vocab.items() if t[0] == "Ġ"]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.ends = pa.array([], pa.string()), np.empty(0, np.uint32), np.empty(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + word for each word, flat, and where each ends. Many words go in one text: as no word
        holds a space or ends in white space, exactly the first token of each begins with a space."""
        odd = pc.or_(pc.equal(words, ""), pc.match_substring_regex(words, r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]$"))
        odd = odd.to_numpy(zero_copy_only=False)
        lists = words.to_pylist()
        plain = [w for w, o in zip(lists, odd, strict=True) if not o]
        joined = [" " + " ".join(plain[i : i + 500]) for i in range(0, len(plain), 500)]
        ids = [np.asarray(x, dtype=np.uint32) for i in range(0, len(joined), 64) for x in self._encode(joined[i : i + 64])]
        flat = np.concatenate([*ids, np.empty(0, np.uint32)])
        lengths = np.diff(np.append(np.flatnonzero(self.opens[flat]), len(flat)))
        if len(lengths) != len(plain) or odd.any():
            own = self._encode([" " + w for w, o in zip(lists, odd, strict=True) if o or len(lengths) != len(plain)])
            parts, rest, single = iter(np.split(flat, np.cumsum(lengths)[:-1]) if len(plain) else []), iter(own), len(lengths) != len(plain)
            out = [np.asarray(next(rest), np.uint32) if o or single else next(parts) for o in odd]
            return np.concatenate([*out, np.empty(0, np.uint32)]), np.cumsum([len(x) for x in out])
        return flat, np.cumsum(lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, with the end id after each, and the number of ids of each."""
        whole = pc.match_substring_regex(texts, ODD_SPACE)
        lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        words, starts = lists.flatten(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        heads = pc.if_else(whole, texts, words.take(pa.array(starts)))
        coded = words.dictionary_encode()
        unit = coded.indices.to_numpy().astype(np.int64)
        place = self._look_up(coded.dictionary)
        head_ids = self._encode(heads.to_pylist())
        # units: known pieces, then the texts' heads, then the end id
        n_known = len(self.ends)
        flat = np.concatenate([self.flat, *[np.asarray(x, np.uint32) for x in head_ids], [END_ID]]).astype(np.uint32)
        ends = np.concatenate([[0], self.ends, len(self.flat) + np.cumsum([*[len(x) for x in head_ids], 1])]).astype(np.int64)
        units = place[unit]
        units[starts] = n_known + np.arange(len(texts))
        after = np.append(starts[1:], len(units))
        units = np.insert(units, after, n_known + len(texts))
        lengths = (ends[1:] - ends[:-1])[units]
        total = np.cumsum(lengths)
        ids = flat[np.repeat(ends[:-1][units] - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)]
        last = after + np.arange(len(texts))
        return ids, np.diff(np.concatenate([[0], total[last]]))


    def _look_up(self, words: pa.Array) -> np.ndarray:
        """Places of words among the known pieces; what is new is encoded and added."""
        if self.known.nbytes + self.flat.nbytes + self.ends.nbytes > KEPT:
            self._forget()
        found = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(found))
        place = found.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(new))
        if len(new):
            ids, ends = self._pieces(new)
            self.known = pa.concat_arrays([self.known, new])
            self.ends = np.concatenate([self.ends, len(self.flat) + ends])
            self.flat = np.concatenate([self.flat, ids])
        return place


@lru_cache(maxsize=1)
def _encoder(name: str) -> PieceEncoder:
    return PieceEncoder(public_tokenizers.path(name))


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class PackedWriter:
    """Appends documents to one file."""

    def __init__(self, uri: str, vocabulary: int, block: int = BLOCK) -> None:
        fs, path = open_folder(uri)
        self.out, self.bits, self.block = fs.open_output_stream(path), bits_for(vocabulary), block
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.at = 0
        self.offsets: list[int] = []
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def append(self, ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray) -> None:
        self.docs.append(doc_ids.astype("<i8")), self.nulls.append(nulls.astype("u1")), self.lengths.append(lengths.astype("<i8"))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate([*self.waiting, np.empty(0, np.uint32)])
        full = len(ids) // self.block * self.block
        for i in range(0, len(ids) if rest else full, self.block):
            data = pack(ids[i : i + self.block], self.bits)
            self.offsets.append(self.at)
            self.at += self.out.write(data) or len(data)
        self.waiting = [] if rest else [ids[full:]]
        self.n_waiting = 0 if rest else len(ids) - full

    def close(self) -> None:
        self._flush(True)
        lengths = np.concatenate([*self.lengths, np.empty(0, "<i8")])
        starts = (np.cumsum(lengths) - lengths).astype("<i8")
        for part in (np.asarray(self.offsets, "<u8"), np.concatenate([*self.docs, np.empty(0, "<i8")]), np.concatenate([*self.nulls, np.empty(0, "u1")]), starts, lengths.astype("<i8")):
            self.out.write(part.tobytes())
        self.out.write(struct.pack(FOOTER, MAGIC, self.bits, self.block, len(self.offsets), len(lengths), self.n_ids, self.at))
        self.out.close()


class PackedReader:
    """Random access to one file: any range of ids, any document."""

    def __init__(self, uri: str) -> None:
        fs, path = open_folder(uri)
        self.file = fs.open_input_file(path)
        size, tail = self.file.size(), struct.calcsize(FOOTER)
        magic, self.bits, self.block, n_blocks, n_docs, self.n_ids, self.index_at = struct.unpack(FOOTER, self.file.read_at(tail, size - tail))
        if magic != MAGIC:
            raise ValueError(f"not a packed token file: {uri}")
        data, self.offsets, at = self.file.read_at(size - tail - self.index_at, self.index_at), None, 0
        out = []
        for kind, n in (("<u8", n_blocks), ("<i8", n_docs), ("u1", n_docs), ("<i8", n_docs), ("<i8", n_docs)):
            out.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
        self.offsets, self.doc_ids, self.nulls, self.starts, self.lengths = out

    def ids(self, begin: int, end: int) -> np.ndarray:
        """ids[begin:end]; reads only the blocks that hold them, in one go."""
        if begin >= end:
            return np.empty(0, np.uint32)
        first, last = begin // self.block, (end - 1) // self.block
        stop = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.index_at
        data = self.file.read_at(stop - int(self.offsets[first]), int(self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            at = int(self.offsets[b] - self.offsets[first])
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(data[at : at + -(-n * self.bits // 8)], n, self.bits))
        return np.concatenate(parts)[begin - first * self.block : end - first * self.block]


def write_token_files(docs: DataFrame, folder: str, model: str = MODEL, block: int = BLOCK) -> DataFrame:
    """Writes (doc_id, text) to files in folder and returns the manifest: file, first_id (null first), n_docs, n_ids, base."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, first, n_docs = None, f"{folder}/tokens-{uuid.uuid4().hex}.bin", None, 0
        encoder = _encoder(model)
        for batch in batches:
            at = 0
            for texts in slices(batch["text"], SLICE):
                doc_id = batch["doc_id"].slice(at, len(texts)).cast(pa.int64())
                at += len(texts)
                if writer is None:
                    fs, path = open_folder(folder)
                    fs.create_dir(path, recursive=True)
                    writer, first = PackedWriter(name, encoder.vocabulary, block), doc_id[0].as_py()
                ids, lengths = encoder.encode(texts.cast(pa.string()).fill_null(""))
                writer.append(ids, doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False), lengths)
                n_docs += len(texts)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "first_id": pa.array([first], pa.int64()), "n_docs": [n_docs], "n_ids": [writer.n_ids]})

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = materialize(ordered.mapInArrow(write, "file string, first_id bigint, n_docs bigint, n_ids bigint"))
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = PackedReader(row["file"])
                begin = 0
                while begin < len(reader.lengths):  # documents of about 16 blocks at a time
                    limit = int(reader.starts[begin]) + 16 * reader.block
                    end = max(begin + 1, int(np.searchsorted(reader.starts, limit)))
                    at = int(reader.starts[begin])
                    ids = reader.ids(at, int(reader.starts[end - 1] + reader.lengths[end - 1])).astype("<u4")
                    rows = range(begin, end)
                    crc = [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip((reader.starts[begin:end] - at).tolist(), reader.lengths[begin:end].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(reader.doc_ids[begin:end], pa.int64(), mask=reader.nulls[begin:end].astype(bool)),
                            "start": pa.array(reader.starts[begin:end] + row["base"], pa.int64()),
                            "n_tokens": pa.array(reader.lengths[begin:end], pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )
                    begin = rows.stop

    spread = manifest.select("file", "base").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_token_files(write_token_files(docs, shared_folder(spark)))
