"""Helpers that the training-data operators share: shared-folder tables, salted joins, word hashing."""

from __future__ import annotations

import os
from contextlib import contextmanager, suppress

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+`` as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def work_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's spark.checkpoint.dir, removed when the application ends."""
    return shared_folder(spark)


#: Rows and bytes of an Arrow batch to and from Python workers, at most (a row alone may be larger).
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Bounded Arrow batches for the jobs within; the session's own settings are put back."""
    want = {"maxRecordsPerBatch": rows, "maxBytesPerBatch": BATCH_BYTES}
    keys = {f"spark.sql.execution.arrow.{k}": v for k, v in want.items()}
    was = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str = "t", rows: int = BATCH_ROWS) -> DataFrame:
    """df, written once to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/{name}"
    with small_batches(df.sparkSession, rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_small_batches(df: DataFrame, name: str, rows: int = 256) -> DataFrame:
    """stored(), for Python steps each of whose rows may be as long as the longest texts."""
    return stored(df, name, rows)


def release() -> None:
    """Gives memory that a task has freed back to the machine, as the worker process lives on."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), whose tasks release their memory at the end."""

    def whole(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(whole, schema)


def let(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def salt(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def salted_left_join(big: DataFrame, small: DataFrame, key: str, by: str, n: int = 16) -> DataFrame:
    """big left join small on key, where one key may hold a third of big: each row of small, unique by key,
    is repeated for n salts, and big's rows take the salt of their column ``by``."""
    b = big.withColumn("_salt", salt(F.col(by), n))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return b.join(s, [key, "_salt"], "left").drop("_salt")


BITS = 20


def slot(x: Column, bits: int = BITS, hashed: bool = False) -> Column:
    """The place of x among 2**bits; hashed: x is a hash already, whose low bits are the place."""
    return x.bitwiseAND(F.lit((1 << bits) - 1)) if hashed else F.pmod(F.xxhash64(x), F.lit(1 << bits))


def bitmap(keys: DataFrame, bits: int = BITS, hashed: bool = False) -> DataFrame:
    """One row, ``bm`` array<bigint> of fixed size 2**bits / 64: bit slot(key) is set for each value of the
    only column. Its size does not depend on the input, so it may be sent to every task."""
    s = slot(F.col(keys.columns[0]), bits, hashed)
    words = keys.select(F.shiftright(s, 6).alias("w"), _shl(s).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    whole = keys.sparkSession.range((1 << bits) >> 6).withColumnRenamed("id", "w").join(words, "w", "left")
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))), lambda x: x["b"]).alias("bm"))


def in_bitmap(bm: Column, x: Column, bits: int = BITS, hashed: bool = False) -> Column:
    """Whether x's bit is set; other values may share the bit."""
    s = slot(x, bits, hashed)
    return F.get(bm, F.shiftright(s, 6).cast("int")).bitwiseAND(_shl(s)) != 0


def _shl(s: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(F.lit(63)).cast("int"))


class WordHash(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    LIMIT = 1 << 18

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case: bytes.split() splits at just these."""
    return text.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words, in order; of the whole sequence when there are fewer; none for none."""
    n = len(h)
    if n == 0:
        return h
    k2 = min(n, k)
    x = h[: n - k2 + 1] + np.uint64(k2)
    for i in range(1, k2):
        x = mixed(x) * _ODD + h[i : n - k2 + 1 + i]
    return mixed(x)


def texts_of(column) -> list[bytes]:
    """The Arrow string column as UTF-8 bytes; null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def sliced(batches, rows: int = 1024, most: int = 4 << 20):
    """Arrow batches in slices of so many rows and bytes at most (a row alone may be larger), so that a task's working
    memory doesn't follow the batch size."""
    for b in batches:
        todo = [b.slice(at, rows) for at in range(0, b.num_rows, rows)][::-1]
        while todo:
            x = todo.pop()
            if x.num_rows > 1 and x.nbytes > most:
                todo += [x.slice(x.num_rows // 2), x.slice(0, x.num_rows // 2)]
            else:
                yield x


_BASE = 0x5851F42D4C957F2D
_LOW = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        _POWERS[:] = [np.multiply.accumulate(np.full(n, b, dtype=np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _hashed(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in data; first: places where a text begins."""
    solid = ~_SPACE[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = first[(first > 0) & (first < len(data))]
    starts[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = _powers(len(data))
    total = np.cumsum(_LOW[data].astype(np.uint64) * up[: len(data)])
    h = (total[e] - total[s] + _LOW[data[s]] * up[s]) * down[s]
    return s, mixed(h + (e - s + 1).astype(np.uint64) * _ODD)


def word_hashes(column, chunk: int = 1 << 18) -> list[np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case, of each text of an Arrow string column: a
    polynomial over the bytes, computed for about ``chunk`` bytes at a time. Null is empty."""
    import pyarrow as pa

    a = column.cast(pa.large_binary()).fill_null(b"")
    if not len(a):
        return []
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", dtype=np.uint8)
    out, row = [], 0
    while row < len(a):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, "right")) - 1)
        part, first = data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        if len(part) > 4 * chunk:  # one long text, in pieces that end at white space
            blanks, cut, pieces = np.flatnonzero(_SPACE[part]), 0, []
            while cut < len(part):
                i = int(np.searchsorted(blanks, cut + chunk))
                end = int(blanks[i]) if i < len(blanks) else len(part)
                pieces.append(_hashed(part[cut:end], np.zeros(0, dtype=np.int64))[1])
                cut = end + 1
            out.append(np.concatenate(pieces))
        elif len(part):
            s, h = _hashed(part, first)
            out += np.split(h, np.searchsorted(s, first[1:-1]))
        else:
            out += [np.zeros(0, dtype=np.uint64)] * (to - row)
        row = to
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file's place; FACETGRAPH_TOKENIZER overrides it."""
    if os.environ.get("FACETGRAPH_TOKENIZER"):
        return os.environ["FACETGRAPH_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path(name)
