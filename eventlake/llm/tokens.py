"""Token-id files with directly addressable codes (operator 3).

Documents are tokenised whole and laid out in ascending id order. The file is a Parquet table of
images; an image holds up to about `IMAGE_TOKENS` ids (more only when one document has more) in
directly addressable codes:

    header   4 x uint32: magic, ids, levels, rank step (bits)
    level k  uint32 count, `count` bytes (bits 8k to 8k+7 of the ids that reach this level),
             but for the last level: bitmap of ids that go on to level k+1, then one uint32 for each
             `step` bits with the number of set bits before it (the rank directory)

Any id is read by at most `levels` byte reads and rank look-ups; no block is decoded for it. Each row
also has the ids and token counts of its documents, its range partition and its first token within
that partition; the `parts` table has the first token of each partition.
"""

from __future__ import annotations

import gc
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.llm.common import select_only, settings
from eventlake.llm.words import LOWER, column_bytes, pieces, span_hashes, spans
from eventlake.session import scratch_dir

MAGIC, STEP, IMAGE_TOKENS, END_ID = 0x31434144, 512, 1 << 18, 2
IMAGES = "part int, seq int, start long, n_tokens long, doc_ids binary, doc_tokens binary, image binary"
DOCS = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"

# Kinds of bytes: a letter a-z, ASCII punctuation other than the apostrophe, anything else.
KIND = np.zeros(256, np.uint8)
KIND[list(string.ascii_lowercase.encode())] = 1
KIND[list(string.punctuation.replace("'", "").encode())] = 2

_BITS = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def encode(ids: np.ndarray) -> bytes:
    """Image of an array of ids below 2^32."""
    ids = np.asarray(ids, np.uint32)
    levels = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
    out = [struct.pack("<4I", MAGIC, len(ids), levels, STEP)]
    for level in range(levels):
        out += [struct.pack("<I", len(ids)), (ids & 0xFF).astype(np.uint8).tobytes()]
        if level == levels - 1:
            break
        ids = ids >> 8
        more = ids > 0
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % (STEP // 8)))
        ones = _BITS[bitmap].reshape(-1, STEP // 8).sum(1, dtype=np.uint32)
        out += [bitmap.tobytes(), (np.cumsum(ones, dtype=np.uint32) - ones).tobytes()]
        ids = ids[more]
    return b"".join(out)


class Image:
    """Random access to the ids of an image; nothing is decoded but what is asked for."""

    def __init__(self, data: bytes) -> None:
        magic, self.n, levels, self.step = struct.unpack_from("<4I", data)
        if magic != MAGIC:
            raise ValueError("not an image of token ids")
        self.levels, at = [], 16
        for level in range(levels):
            (count,) = struct.unpack_from("<I", data, at)
            low = np.frombuffer(data, np.uint8, count, at + 4)
            at += 4 + count
            if level == levels - 1:
                self.levels.append((low, None, None))
                break
            blocks = -(-count // self.step)
            bitmap = np.frombuffer(data, np.uint8, blocks * self.step // 8, at)
            at += len(bitmap)
            self.levels.append((low, bitmap, np.frombuffer(data, np.uint32, blocks, at)))
            at += 4 * blocks

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (low, bitmap, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (8 * level)
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // self.step
            whole = bitmap[block * self.step // 8 : i >> 3]
            i = int(ranks[block]) + int(_BITS[whole].sum()) + int(_BITS[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def all(self) -> np.ndarray:
        out, at = np.zeros(self.n, np.uint32), np.arange(self.n)
        for level, (low, bitmap, _) in enumerate(self.levels):
            out[at] |= low.astype(np.uint32) << np.uint32(8 * level)
            if bitmap is not None:
                at = at[np.unpackbits(bitmap, count=len(at), bitorder="little").astype(bool)]
        return out


class WordCoder:
    """A tokenizer that drops white space, applied to each different word once.

    Texts are cut at ASCII white space and between a letter a-z and ASCII punctuation other than the
    apostrophe, where such a tokenizer never joins. The ids of words met before are kept in sorted hash arrays, at most
    `LIMIT` words; beyond it the arrays start anew. Texts with the opening of a special token are
    encoded whole. A tokenizer for which white space matters is always applied to whole texts.
    """

    LIMIT, RECENT, SEP = 300_000, 1 << 14, "\x01"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        a, b = self._plain("Ab (c."), [i for x in ("ab", "(", "c", ".") for i in self._plain(x)]
        sep = self._plain(self.SEP)
        self.by_word = a == b and len(sep) == 1 and self._plain("a \x01 b") == self._plain("a") + sep + self._plain("b")
        self.sep = sep[0] if sep else -1
        self.as_bytes = _ByteChars()
        probe = ["a", "the", "zqxj", "heit", "\u00e9t\u00e9", "\u00df\u00fc\u017e"]
        self.by_letters = self.by_word and all(self._letters(w) == self._plain(w) for w in probe)
        self._clear()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, word: str) -> list[int]:
        """Ids of a word of lower-case Latin letters, straight from the tokenizer's model."""
        return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(self.as_bytes))]

    def _clear(self) -> None:
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.main, self.recent = empty, empty
        self.begin, self.length, self.flat = _Growing(np.int64), _Growing(np.int64), _Growing(np.uint32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        entry = np.full(len(hashes), -1)
        for known, index in (self.main, self.recent):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                entry[hit] = index[at[hit]]
        return entry

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        coded: list[list[int]] = [[]] * len(words)
        rest = []
        for i, word in enumerate(words):
            small = word.lower()
            if self.by_letters and small.isalpha() and (small.isascii() or max(small) < "\u0250"):
                coded[i] = self._letters(small)
            else:
                rest.append(i)
        for k in range(0, len(rest), 256):
            group = [words[i] for i in rest[k : k + 256]]
            ids = self._plain(f" {self.SEP} ".join(group)) if not any(self.SEP in w for w in group) else []
            parts, last = [], 0
            for end in [*(i for i, x in enumerate(ids) if x == self.sep), len(ids)]:
                parts.append(ids[last:end])
                last = end + 1
            for i, part in zip(rest[k : k + 256], parts if len(parts) == len(group) else map(self._plain, group)):
                coded[i] = part
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        new = np.arange(len(self.begin), len(self.begin) + len(coded))
        self.begin.extend(len(self.flat) + np.cumsum(sizes) - sizes)
        self.length.extend(sizes)
        self.flat.extend(np.fromiter((i for c in coded for i in c), np.uint32, int(sizes.sum())))
        self.recent = _merged(self.recent, (hashes, new))
        if len(self.recent[0]) > self.RECENT:
            self.main, self.recent = _merged(self.main, self.recent), (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column, and the number of ids of each row."""
        buf, at = column_bytes(column)
        counts, out = np.zeros(len(column), np.int64), []
        for piece, cuts, row, rows in pieces(buf, at):
            if not len(piece):
                continue
            ids, sizes = self._piece(piece, cuts)
            out.append(ids)
            counts[row : row + rows] += sizes
        ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
        special = [] if self.by_word else range(len(column))
        if self.by_word and b"<|" in buf.tobytes():
            special = [i for i in range(len(column)) if b"<|" in buf[at[i] : at[i + 1]].tobytes()]
        if len(special):  # their rows once more, as a whole
            rows = np.split(ids, np.cumsum(counts)[:-1])
            for i in special:
                rows[i] = np.array(self._plain(buf[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")), np.uint32)
                counts[i] = len(rows[i])
            ids = np.concatenate(rows)
        return ids, counts

    def _piece(self, piece: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            return np.zeros(0, np.uint32), np.zeros(len(cuts), np.int64)
        low = LOWER[piece]
        kind = KIND[low]
        stop = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1
        starts, ends = spans(piece, np.concatenate([cuts[cuts < len(piece)], stop]))
        hashes, first, which = np.unique(span_hashes(piece, starts, ends), return_index=True, return_inverse=True)
        entry = self._find(hashes)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            if len(self.begin) + len(missing) > self.LIMIT:
                self._clear()
                missing = np.arange(len(hashes))
            text = low.tobytes()
            self._learn(hashes[missing], [text[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[missing]])
            entry = self._find(hashes)
        entry = entry[which]
        sizes = self.length.data[entry]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat.data[np.repeat(self.begin.data[entry] - total[:-1], sizes) + np.arange(total[-1])]
        word = np.searchsorted(starts, np.append(cuts, len(piece)))
        return ids, np.diff(total[word])


def _merged(a, b):
    """Two sorted (hash, index) arrays as one."""
    at = np.searchsorted(a[0], b[0])
    return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])


class _Growing:
    """An array with room to spare at its end."""

    def __init__(self, kind) -> None:
        self.data, self.n = np.zeros(1024, kind), 0

    def __len__(self) -> int:
        return self.n

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(self.n + len(values), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class _ByteChars(dict):
    """Each character as the byte-level alphabet of the library writes it."""

    def __missing__(self, code: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self[code] = "".join(part for part, _ in level.pre_tokenize_str(chr(code)))
        return self[code]


@lru_cache(1)
def _coder(path: str) -> WordCoder:
    return WordCoder(path)


def _drop_coder() -> None:
    """Give the words of a task back: workers live on, and later stages need the memory."""
    _coder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def _with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def _pack(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = _coder(path), TaskContext.get().partitionId()
        seq = start = 0
        docs: list[int | None] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def image() -> pa.RecordBatch:
            nonlocal seq, start
            ids, counts = np.concatenate(held), np.concatenate(sizes)
            row = [part, seq, start, len(ids), _ids_to_bytes(docs), counts.astype("<i8").tobytes(), encode(ids)]
            seq, start = seq + 1, start + len(ids)
            docs.clear(), sizes.clear(), held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            names = ["part", "seq", "start", "n_tokens", "doc_ids", "doc_tokens", "image"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        try:
            for batch in batches:
                ids, counts = _with_ends(*coder.column(batch.column("text")), end_id)
                names, ends, row = batch.column("doc_id").to_pylist(), np.cumsum(counts), 0
                while row < len(names):
                    room = IMAGE_TOKENS - sum(map(len, held))
                    first = int(ends[row - 1]) if row else 0
                    last = max(row + 1, int(np.searchsorted(ends, first + room, side="right")))
                    docs += names[row:last]
                    sizes.append(counts[row:last])
                    held.append(ids[first : int(ends[last - 1])])
                    row = last
                    if sum(map(len, held)) >= IMAGE_TOKENS or row < len(names):
                        yield image()
            if docs:
                yield image()
        finally:
            del coder
            _drop_coder()

    return run


# The id that stands for a missing one in the files.
NO_ID = -(1 << 63)


def _ids_to_bytes(ids: list[int | None]) -> bytes:
    return np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Tokenise `docs` (doc_id, text) and write the files; returns the stored table of images.

    Order: doc_id, a missing id first; equal ids by their text's hash. A missing or empty text is its
    end id alone. Other columns are ignored. An empty table gives no image.
    """
    settings(docs.sparkSession)
    rows = select_only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("__tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("__tie")]
    packed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    packed.mapInArrow(_pack(tokenizer, end_id), IMAGES).write.option("compression", "zstd").option(
        "parquet.block.size", str(16 << 20)
    ).parquet(path)
    return docs.sparkSession.read.schema(IMAGES).parquet(path)


def part_starts(images: DataFrame) -> DataFrame:
    """First token of each range partition: a row for each partition, whatever the number of documents."""
    sizes = images.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = Image(row["image"]).all().astype("<u4")
            docs, sizes = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_tokens"], "<i8")
            starts = np.cumsum(sizes) - sizes
            crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(starts.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(docs), row["part"], np.int32)),
                    pa.array(docs, mask=docs == NO_ID),
                    pa.array(starts + row["start"]),
                    pa.array(sizes),
                    pa.array(crc, pa.int64()),
                ],
                names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the crc32 of its ids."""
    images = settings(spark).read.schema(IMAGES).parquet(path)
    docs = images.mapInArrow(_digest, DOCS)
    return docs.join(F.broadcast(part_starts(images)), "part").select(
        "doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of `docs` to the shared folder and return what reading them gives."""
    path = scratch_dir(docs.sparkSession, "token-ids")
    write_token_files(docs, path, tokenizer)
    return read_token_files(docs.sparkSession, path)
