"""Interpolated modified Kneser-Ney bigram model, counted in Spark (operator 7).

Words and word pairs are 64-bit hashes. Three passes: words are counted; pairs are counted, split by
their context (a context with a large share of all tokens by the pair); what each context and each
continuation needs is added to the words. The results are sorted hash arrays in files of the shared
folder, one for each range of hashes, which the scoring workers map into memory. Every file comes
from one task; a repeated task writes a new file, and only files named in a task's result are read.

Tasks hold one flush of tokens or one shard at a time; the number of shards follows the tokens. The
driver gets file names, totals and the hot contexts (at most `8 * shards`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import select_only, settings
from eventlake.llm.words import BASE, column_words, mix
from eventlake.session import scratch_dir

FLUSH, SHARD_TOKENS, MIN_BITS = 3_000_000, 4_000_000, 4
BEGIN, END = np.uint64(0x1B0B1E), np.uint64(0xE0D)
PAIR = np.uint64(0xD6E8FEB86659FD93)
BLOBS = "shard int, n long, data binary"
WORD = np.dtype([("h", "<u8"), ("c", "<u8"), ("cont", "<u8"), ("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])


def shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int32)


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * PAIR + word)


def pair_shard(context: np.ndarray, pair: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    shard = shard_of(mix(context), bits)
    if len(hot):
        split = np.isin(context, hot)
        shard[split] = shard_of(pair[split], bits)
    return shard


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text (its words, then the end), and where each text starts."""
    words, at = column_words(column)
    out = np.full(len(words) + len(column), END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(column)), np.diff(at))] = words
    return out, at + np.arange(len(at))


def contexts(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[at[:-1]] = BEGIN
    return before


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays with their types and lengths, compressed."""
    head = ";".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode()
    body = len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unzip(data: bytes) -> list[np.ndarray]:
    body = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n, out = int.from_bytes(body[:4], "little"), []
    at = 4 + n
    for item in body[4 : 4 + n].decode().split(";"):
        kind, _, length = item.rpartition(":")
        out.append(np.frombuffer(body, kind, int(length), at))
        at += out[-1].nbytes
    return out


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


# Columns of a word's row that each kind of blob adds to: counts, contexts, continuations.
COLUMNS = [[0], [2, 3, 4, 5], [1]]


def _kind(kind: int) -> np.ndarray:
    return np.array([kind], np.uint8)


def _narrow(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max(initial=0))
    return counts.astype("<u1" if top < 256 else "<u2" if top < 65536 else "<u8")


def _by_shard(shards: np.ndarray, bits: int, blob: Callable[[slice], bytes]) -> Iterator[tuple]:
    """One row for each shard of records sorted by shard."""
    cuts = np.searchsorted(shards, np.arange((1 << bits) + 1))
    for k in range(1 << bits):
        if cuts[k + 1] > cuts[k]:
            yield k, int(cuts[k + 1] - cuts[k]), blob(slice(cuts[k], cuts[k + 1]))


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, words) of some million tokens at a time."""
    held, n = [], 0
    for batch in batches:
        words, at = tokens(batch.column("text"))
        held.append((contexts(words, at), words))
        n += len(words)
        if n >= FLUSH:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _count_words(bits: int):
    def run(batches):
        for _, words in _flushes(batches):
            h, c = np.unique(words, return_counts=True)
            yield _rows(BLOBS, list(_by_shard(shard_of(h, bits), bits, lambda s: _zip(h[s], _narrow(c[s])))))

    return run


def _count_pairs(bits: int, hot: np.ndarray):
    def run(batches):
        for before, words in _flushes(batches):
            pairs, first, counts = np.unique(pair_hash(before, words), return_index=True, return_counts=True)
            before, words = before[first], words[first]
            shards = pair_shard(before, pairs, bits, hot)
            order = np.lexsort((before, shards))
            before, words, counts, shards = before[order], words[order], counts[order], shards[order]

            def blob(s: slice) -> bytes:
                context, sizes = np.unique(before[s], return_counts=True)
                known, which = np.unique(words[s], return_inverse=True)
                return _zip(context, _narrow(sizes), known, which.astype("<u4"), _narrow(counts[s]))

            yield _rows(BLOBS, list(_by_shard(shards, bits, blob)))

    return run


def _per_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """The blobs of each shard, from rows sorted by shard."""
    now, held = None, []
    for batch in batches:
        for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
            if shard != now and held:
                yield now, held
                held = []
            now = shard
            held.append(_unzip(data.as_py()))
    if held:
        yield now, held


def _totals(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of values for each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], *[np.add.reduceat(v[order].astype(np.uint64), starts) if len(keys) else v.astype(np.uint64) for v in values]


def _word_totals(hot_from: int):
    def run(batches):
        for shard, blobs in _per_shard(batches):
            h, c = _totals(np.concatenate([b[0] for b in blobs]), np.concatenate([b[1].astype("<u8") for b in blobs]))
            yield _rows("shard int, n long, tokens long, hot binary, data binary", [(shard, len(h), int(c.sum()), h[c >= hot_from].tobytes(), _zip(_kind(0), h, _narrow(c)))])

    return run


def _write(folder: str, name: str, *arrays: np.ndarray) -> str:
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    store, place = _place(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place) as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).tobytes())
    return path


def _place(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _mapped(path: str) -> np.ndarray:
    """A file as a read-only memory map; from a store that can't be mapped, as a copy of that one file."""
    store, place = _place(path)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(place, np.uint8, "r")
    with store.open_input_file(place) as file:
        return np.frombuffer(file.read(), np.uint8)


PAIR_ROWS = "kind int, shard int, n long, path string, ones long, twos long, threes long, fours long, data binary"


def _pair_totals(folder: str, word_bits: int):
    """Write the pairs of a shard; hand out what contexts and words get from them, by shard of the words."""

    def run(batches):
        for shard, blobs in _per_shard(batches):
            before = np.concatenate([np.repeat(b[0], b[1]) for b in blobs])
            words = np.concatenate([b[2][b[3]] for b in blobs])
            counts = np.concatenate([b[4].astype("<u8") for b in blobs])
            pairs = pair_hash(before, words)
            order = np.argsort(pairs, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], pairs[order][1:] != pairs[order][:-1]]))
            counts = np.add.reduceat(counts[order], starts)
            first = order[starts]
            before, words, pairs = before[first], words[first], pairs[first]
            path = _write(folder, f"pairs-{shard:05d}", pairs, np.minimum(counts, 0xFFFFFFFF).astype("<u4"))
            rows = [(0, shard, len(pairs), path, *[int((counts == k).sum()) for k in (1, 2, 3, 4)], None)]
            one = np.ones(len(pairs), np.uint64)
            h, total, n1, n2, n3 = _totals(before, counts, counts == 1, counts == 2, counts > 2)
            for k, n, data in _by_shard(shard_of(h, word_bits), word_bits, lambda s: _zip(_kind(1), h[s], *map(_narrow, (total[s], n1[s], n2[s], n3[s])))):
                rows.append((1, k, n, None, 0, 0, 0, 0, data))
            w, cont = _totals(words, one)
            for k, n, data in _by_shard(shard_of(w, word_bits), word_bits, lambda s: _zip(_kind(2), w[s], _narrow(cont[s]))):
                rows.append((2, k, n, None, 0, 0, 0, 0, data))
            yield _rows(PAIR_ROWS, rows)

    return run


WORD_ROWS = "shard int, n long, path string, known long, conts long, ones long, twos long, threes long, fours long"


def _word_files(folder: str):
    """Join the counts, context totals and continuations of the words of a shard into one sorted file."""

    def run(batches):
        for shard, blobs in _per_shard(batches):
            keys, columns = [], []
            for blob in blobs:
                kind, h, *sums = blob
                values = np.zeros((len(h), 6), np.uint64)
                for column, value in zip(COLUMNS[int(kind[0])], sums):
                    values[:, column] = value
                keys.append(h)
                columns.append(values)
            values = np.concatenate(columns)
            h, *sums = _totals(np.concatenate(keys), *values.T)
            del keys, columns, values
            table = np.zeros(len(h), WORD)
            for name, total in zip(("h", "c", "cont", "total", "n1", "n2", "n3"), (h, *sums)):
                table[name] = total
            cont = table["cont"]
            row = (int((table["c"] > 0).sum()), int(cont.sum()), *[int((cont == k).sum()) for k in (1, 2, 3, 4)])
            yield _rows(WORD_ROWS, [(shard, len(h), _write(folder, f"words-{shard:05d}", *[table[n] for n in WORD.names]), *row)])

    return run


def _discounts(ones: int, twos: int, threes: int, fours: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more; with too few counts to estimate them, 0.5, 1 and 1.5."""
    if not (ones and twos and threes and fours):
        return np.array([0, 0.5, 1.0, 1.5])
    y = ones / (ones + 2 * twos)
    d = np.array([0, 1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.85])


class Model:
    """A fitted model: where its files are, and the totals the driver has gathered. Small to send."""

    def __init__(self, **parts) -> None:
        self.__dict__.update(parts)

    def files(self):
        return _open(tuple(self.word_files), tuple(self.pair_files))

    def lookup(self, before: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
        """c, cont of words; total, n1, n2, n3 of contexts; c2 of pairs."""
        word_maps, pair_maps = self.files()
        out = {}
        for keys, names in ((words, ("c", "cont")), (before, ("total", "n1", "n2", "n3"))):
            known, which = np.unique(keys, return_inverse=True)
            found = {n: np.zeros(len(known), np.float64) for n in names}
            cuts = np.searchsorted(shard_of(known, self.word_bits), np.arange((1 << self.word_bits) + 1))
            for shard, columns in word_maps.items():
                part = slice(cuts[shard], cuts[shard + 1])
                at, hit = _at(columns["h"], known[part])
                for n in names:
                    found[n][part][hit] = columns[n][at[hit]]
            out |= {n: v[which] for n, v in found.items()}
        pairs, first, which = np.unique(pair_hash(before, words), return_index=True, return_inverse=True)
        shards = pair_shard(before[first], pairs, self.pair_bits, self.hot)
        c2 = np.zeros(len(pairs))
        order = np.argsort(shards, kind="stable")
        cuts = np.searchsorted(shards[order], np.arange((1 << self.pair_bits) + 1))
        for shard, (known, counts) in pair_maps.items():
            part = order[cuts[shard] : cuts[shard + 1]]
            at, hit = _at(known, pairs[part])
            c2[part[hit]] = counts[at[hit]]
        return out | {"c2": c2[which]}

    def log10(self, f: dict[str, np.ndarray]) -> np.ndarray:
        d0, d1 = self.cont_discounts, self.pair_discounts
        kinds = np.array([0, *self.cont_kinds])
        spare = float((d0 * kinds).sum()) if self.conts else 1.0
        lower = np.maximum(f["cont"] - d0[np.minimum(f["cont"], 3).astype(int)], 0) + spare / (self.known + 1)
        lower /= self.conts or 1
        held = np.maximum(f["c2"] - d1[np.minimum(f["c2"], 3).astype(int)], 0)
        free = d1[1] * f["n1"] + d1[2] * f["n2"] + d1[3] * f["n3"]
        seen = f["total"] > 0
        return np.log10(np.where(seen, (held + free * lower) / np.where(seen, f["total"], 1), lower))


def _at(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


@lru_cache(1)
def _open(word_files: tuple, pair_files: tuple):
    words, pairs = {}, {}
    for shard, n, path in word_files:
        data, at, words[shard] = _mapped(path), 0, {}
        for name in WORD.names:
            kind = WORD[name]
            words[shard][name] = data[at : at + n * kind.itemsize].view(kind)
            at += n * kind.itemsize
    for shard, n, path in pair_files:
        data = _mapped(path)
        pairs[shard] = data[: 8 * n].view("<u8"), data[8 * n :].view("<u4")
    return words, pairs


def fit(docs: DataFrame) -> Model:
    """Count the texts of `docs` (text); a missing text is an empty one. An empty table gives a uniform model."""
    spark = settings(docs.sparkSession)
    folder = scratch_dir(spark, "ngram")
    texts = docs.select("text")
    rough = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(MIN_BITS, int(np.ceil(np.log2(rough / 6 / SHARD_TOKENS + 1))))
    shards = 1 << bits
    dealt = lambda df: df.repartition(shards, "shard").sortWithinPartitions("shard")

    hot_from = max(1000, rough // 6 // (4 * shards))
    word_rows = f"{folder}/word-counts"
    dealt(texts.mapInArrow(_count_words(bits), BLOBS)).mapInArrow(
        _word_totals(hot_from), "shard int, n long, tokens long, hot binary, data binary"
    ).write.parquet(word_rows)
    counted = spark.read.parquet(word_rows)
    totals = counted.select("tokens", "hot").collect()
    hot = np.concatenate([np.frombuffer(r["hot"], "<u8") for r in totals] + [np.array([BEGIN])])

    pair_rows = f"{folder}/pair-rows"
    dealt(texts.mapInArrow(_count_pairs(bits, hot), BLOBS)).mapInArrow(_pair_totals(f"{folder}/arrays", bits), PAIR_ROWS).write.parquet(pair_rows)
    pairs = spark.read.parquet(pair_rows)
    pair_files = pairs.where("kind = 0").drop("data").collect()
    parts = counted.select("shard", "data").union(pairs.where("kind > 0").select("shard", "data"))
    word_files = dealt(parts).mapInArrow(_word_files(f"{folder}/arrays"), WORD_ROWS).collect()

    add = lambda rows, *names: [sum(r[n] for r in rows) for n in names]
    steps = ("ones", "twos", "threes", "fours")
    known, conts = add(word_files, "known", "conts")
    kinds = add(word_files, *steps)
    words_with_cont = sum(r["n"] for r in word_files)
    return Model(
        tokens=sum(r["tokens"] for r in totals),
        known=known,
        conts=conts,
        cont_discounts=_discounts(*kinds),
        cont_kinds=[kinds[0], kinds[1], max(known - kinds[0] - kinds[1], 0) if words_with_cont else 0],
        pair_discounts=_discounts(*add(pair_files, *steps)),
        hot=hot,
        word_bits=bits,
        pair_bits=bits,
        word_files=[(r["shard"], r["n"], r["path"]) for r in word_files],
        pair_files=[(r["shard"], r["n"], r["path"]) for r in pair_files],
    )


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model):
    def run(batches):
        for batch in batches:
            words, at = tokens(batch.column("text"))
            found = model.lookup(contexts(words, at), words)
            base = np.log10((found["c"] + 1) / (model.tokens + model.known + 1))
            log = model.log10(found)
            by_row = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else x[:0]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(np.diff(at)),
                    pa.array(by_row((found["c"] > 0).astype(np.int64))),
                    pa.array(np.full(len(at) - 1, model.tokens, np.int64)),
                    pa.array(by_row(base)),
                    pa.array(by_row(log)),
                ],
                names=[f.split()[0] for f in SCORES.split(", ")],
            )

    return run


def held_out(doc_id, folds: int = 7, fold: int = 2):
    """Whether a document is kept from training; one without an id is trained on."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Log10 probability of each whole text under the model, beside the add-one unigram score.

    Repeated rows are scored each; a missing or empty text is its end alone. Other columns are ignored.
    """
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(model), SCORES)


def lm_scores(docs: DataFrame) -> DataFrame:
    """Fit on the rows of `docs` (doc_id, text) that are not held out, and score all of them."""
    rows = select_only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return score(rows, fit(rows.where(~held_out(F.col("doc_id")))))

