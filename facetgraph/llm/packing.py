"""Sum-of-squares online packing of tokenised documents into windows.

Within a scan partition the documents are a stream: each is tokenised, whole windows are cut from its front, and
the rest (shorter than a window) goes to the fill level h that minimises the sum over levels of squared counts of
partially filled windows; level 0 is a new window. The counts are an array of window_size levels, so a placement is one
vector operation. Nothing is shuffled: a task packs what it reads, and a task run again packs alike.

At a stream's end its open windows are closed together: the fullest takes pieces cut from the emptiest, so that all but one
are full. The last is cut at the powers of two of its fill, which need no padding. Open windows hold at most the rests
of what the task reads, whose size spark.sql.files.maxPartitionBytes bounds; the shorter the streams, the more windows
are closed by cutting.

Defined results: null or empty text is its end token alone; rows that repeat are separate documents; a null id
stays null; pieces of a document have ascending start and every id lies in exactly one piece; an empty table
gives no piece.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections import ChainMap, deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mapped, sliced, stored, texts_of

WINDOW = 4096
END = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words remembered by a worker.
_CACHE = 1 << 21
_MARKS = ".,!?%&#$*|;:"
#: str.split() takes these for white space, the tokenizer doesn't.
_APART = "\x1c\x1d\x1e\x1f"


class Tokens:
    """Ids of a text by a tokenizer that drops white space and never joins words across it. Words are tokenised
    once and remembered as bytes, up to a bound; a word of letters with ASCII marks behind it by its two parts,
    as the tokenizer splits there too."""

    def __init__(self, path: str, remember: int = _CACHE):
        import os

        self.remember = remember

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        made = self.tok.encode_batch_fast(words, add_special_tokens=False)
        return {w: array("I", e.ids).tobytes() for w, e in zip(words, made, strict=True)}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Bytes of ids of words, kept in ``known`` while there is room."""
        known, parts, need = self.known, [], set()
        for w in words:
            core = w.rstrip(_MARKS)
            if core.isascii():
                core, n = core.lower(), len(core)
                plain = core.isalpha()
            else:
                plain, n = unicodedata.normalize("NFC", core).lower().isalpha(), len(core)
            tail = w[n:]
            if not plain:
                core, tail = w, ""
            parts.append((w, core, tail))
            if core not in known:
                need.add(core)
            if tail and tail not in known:
                need.add(tail)
        new = self._encoded(list(need))
        both = ChainMap(new, known) if len(known) >= self.remember else known
        if both is known:
            known.update(new)
        out = {w: both[core] + both[tail] if tail else both[core] for w, core, tail in parts}
        if both is known:
            known.update(out)
        return out

    def of(self, texts: list[str], chunk: int = 1024) -> Iterator[np.ndarray]:
        known = self.known
        for at in range(0, len(texts), chunk):
            split = [None if any(c in t for c in _APART) else t.split() for t in texts[at : at + chunk]]
            found = [list(map(known.get, words or ())) for words in split]
            holes = [_holes(ids) for ids in found]
            new = {words[i] for words, at_ in zip(split, holes, strict=True) for i in at_}
            extra = self._learn(new) if new else {}
            for text, words, ids, at_ in zip(texts[at : at + chunk], split, found, holes, strict=True):
                if words is None:
                    yield np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")
                    continue
                for i in at_:
                    ids[i] = extra[words[i]]
                yield np.frombuffer(b"".join(ids), dtype="<u4")


def _holes(ids: list) -> list[int]:
    """The places of None."""
    out, i = [], -1
    try:
        while True:
            i = ids.index(None, i + 1)
            out.append(i)
    except ValueError:
        return out


#: One per worker process and file: tasks that follow find the words there.
_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str, remember: int = _CACHE) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    _TOKENS[path].remember = remember
    return _TOKENS[path]


class Packer:
    """The open windows of one stream. A piece: (doc, start, ids, doc_tokens)."""

    def __init__(self, first: int, size: int = WINDOW):
        self.size, self.next = size, first
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.at: list[list[list]] = [[] for _ in range(size)]

    def _close(self, pieces: list) -> list[tuple]:
        out, at = [], 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1
        return out

    def level(self, s: int) -> int:
        """The fill level at which s tokens least raise the sum of squares: moving a window from h to h + s changes
        it by 2 (N[h+s] - N[h]) + 2, a new one by 2 N[s] + 1, a full one by -2 N[h] + 1."""
        n = self.count
        gain = 2 * (n[1 + s :] - n[1 : self.size + 1 - s]) + 2
        if len(gain):
            gain[-1] = 1 - 2 * n[self.size - s]
            gain = np.where(n[1 : self.size + 1 - s] > 0, gain, np.iinfo(np.int64).max)
            best = len(gain) - 1 - int(np.argmin(gain[::-1]))  # ties to the fullest
            if gain[best] <= 2 * n[s] + 1:
                return best + 1
        return 0

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        out, total, size = [], len(ids), self.size
        whole = total - total % size
        for i in range(0, whole, size):
            out += self._close([(doc, i, ids[i : i + size], total)])
        if whole < total:
            piece, s = (doc, whole, ids[whole:], total), total - whole
            h = self.level(s)
            pieces = self.at[h].pop() if h else []
            pieces.append(piece)
            if h:
                self.count[h] -= 1
            if h + s == size:
                out += self._close(pieces)
            else:
                self.count[h + s] += 1
                self.at[h + s].append(pieces)
        return out

    def merge(self) -> list[tuple]:
        """Closes all open windows but the one that is left over, which stays open."""
        windows = deque(w for h in range(self.size) for w in self.at[h])  # emptiest first
        self.at, self.count[:] = [[] for _ in range(self.size)], 0
        out: list[tuple] = []
        while len(windows) > 1:
            full = windows.pop()
            gap = self.size - sum(len(p[2]) for p in full)
            while gap and windows:
                doc, start, ids, total = windows[0].pop()
                if len(ids) > gap:
                    windows[0].append((doc, start, ids[:-gap], total))
                    start, ids = start + len(ids) - gap, ids[-gap:]
                full.append((doc, start, ids, total))
                gap -= len(ids)
                if not windows[0]:
                    windows.popleft()
            if gap:
                windows.append(full)
                break
            out += self._close(full)
        for w in windows:
            h = sum(len(p[2]) for p in w)
            self.at[h].append(w)
            self.count[h] += 1
        return out

    def finish(self) -> list[tuple]:
        out = self.merge()
        left = [p for h in range(self.size) for w in self.at[h] for p in w]
        fill = sum(len(p[2]) for p in left)
        for bit in (1 << b for b in range(self.size.bit_length(), -1, -1) if fill >> b & 1):
            taken, gap = [], bit
            while gap:
                doc, start, ids, total = left.pop(0)
                if len(ids) > gap:
                    left.insert(0, (doc, start + gap, ids[gap:], total))
                    ids = ids[:gap]
                taken.append((doc, start, ids, total))
                gap -= len(ids)
            out += self._close(taken)
        return out


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", size: int = WINDOW, end: int = END, remember: int = _CACHE) -> DataFrame:
    """A row per piece. Sequence ids: the task's partition, then a running number. ``tokenizer``: a file's path,
    there on every machine; remember: words that a worker keeps, about 200 bytes each."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tokens, packer = tokens_of(tokenizer, remember), Packer(TaskContext.get().partitionId() << 40, size)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def rows(out):
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        out = []
        for batch in sliced(batches):
            ids = batch.column(0).to_pylist()
            for doc, t in zip(ids, tokens.of([x.decode() for x in texts_of(batch.column(1))]), strict=True):
                out += packer.add(doc, np.append(t, np.uint32(end)).astype("<u4"))
                if len(out) > 20_000:
                    yield rows(out)
                    out = []
        out += packer.finish()
        if out:
            yield rows(out)

    # written once, in batches of bounded size: who reads the pieces again sees the same sequences
    packed = stored(mapped(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), run, SCHEMA), "pieces")
    return packed.withColumnRenamed("doc_id", id_col)
