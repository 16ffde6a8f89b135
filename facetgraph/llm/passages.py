"""Substring dedup by compact windows.

A text's 5-word shingles are its tokens. For a hash function, a Cartesian tree over the tokens' hashes splits all
subsequences of at least T tokens into compact windows (l, c, r): every subsequence that starts in [l, c] and ends in
[c, r] has its least hash at c. There are about 2 n / T of them. Passages of likeness J have their least hash at the same
token with probability J, exact repeats always; ``FUNCTIONS`` functions are tried.

A passage of likeness 0.8 has an edit for 45 tokens at most, so two such passages are equal for ``RUN`` tokens somewhere. The
least of every WIDTH tokens, by the hash of the SIDE tokens behind it and its own, is the least token of a compact window of
that length; that hash is its signature. So two texts share a signature at each place where they are equal for RUN tokens,
whatever the hash function. Tokens here and below are words' shingles; passages whose own tokens repeat may be alike with
shorter equal runs.

Places of a signature are compared in three rounds:

* with the one of the smallest document, the signature's representative. Hits that put two documents on nearby diagonals are
  joined as intervals, and each place that isn't inside a verified passage is verified on tokens: an equal run of T tokens is a
  repeat; else the segments reach as far as tokens are found on the other side, with few between that aren't, and must have T
  tokens and Jaccard likeness of 0.8 or more;
* places that are neither copies of their representative, an equal run of T tokens, nor alike to it are open: they meet the
  representative of equal passages of T tokens around them. This only makes copies of most that are some;
* places that are open still: all of a signature with each other, and with those of known classes, which are alike to the
  representative or copies whose copied run ends within T tokens, as they may be alike by what is beyond it.

A signature's classes are the places that rows join in chains. Copies and places alike to a representative are members of its
class by a row each. In the last round pairs are taken by the tokens they share, the most first, those of one class aren't compared
again, and those whose tokens can't make a passage are left out by a bound that holds for all that ``alike`` finds. So two places
that are alike are in one class, and have a row of their own or a chain of rows at the signature. Other places of the
representative's document have no row with it, so they are open.

What is left out: two copies of the second round meet only through their representatives. If they are alike by tokens beyond their
copied runs, that pair has a chain only if they share another signature there. The pairs that the last round bounds or compares
grow with the square of a signature's open places, in blocks.

Equal texts are grouped first and reported with the smallest id.

Result: a row per verified pair of passages (words, end exclusive), both ways found through doc_id and other_id;
documents without a repeat have no row. Defined results: null, empty and short texts have no passages; rows that
repeat an id count once, with the least of their texts; rows of a null id take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, bitmap, in_bitmap, mapped, mixed, shingles, sliced, stored, stored_in_small_batches, word_hashes

K = 5
#: Tokens of a passage, at least: 50 words.
T = 46
LIKE = 0.8
#: Tokens behind the least one in a signature, and places of which one is the least. Tokens overlap by K - 1 words, so every
#: K-th one tells them all.
SIDE = 10
WIDTH = 11
#: Tokens that two passages must be equal for to share a signature.
RUN = WIDTH + SIDE
MAP_BITS = 24
#: Equal tokens that places share which meet a representative, by round.
STEPS = (SIDE + 1, T)
#: Tokens around a place that are compared, on either side; those within half a passage join places to islands.
AROUND = T + T // 2
#: Chains of a signature that one task compares with as many others.
BLOCK = 256
#: Diagonals that an edit within a passage may lie apart.
SHIFT = 16


def _reversed(x: np.ndarray, bits: int) -> np.ndarray:
    """The numbers with their lowest ``bits`` bits in opposite order."""
    out = np.zeros_like(x)
    for i in range(bits):
        out |= ((x >> np.uint64(i)) & np.uint64(1)) << np.uint64(bits - 1 - i)
    return out


def windows(v: np.ndarray, t: int = T, starts: np.ndarray | None = None) -> np.ndarray:
    """Rows (l, c, r) of the compact windows of the texts in v, which begin at ``starts``. The trees of all texts grow level by
    level. Equal hashes are ordered by their places' bits in opposite order, so that a text of equal words has a low tree."""
    ends = np.append(starts[1:], len(v)) if starts is not None else np.array([len(v)])
    lo, hi = (np.array([0]) if starts is None else starts).astype(np.int64), ends.astype(np.int64)
    bits = max(1, int(len(v)).bit_length())
    low = np.uint64((1 << bits) - 1)
    # a value holds its place: the least one tells where it stands
    key = np.append((v & ~low) | _reversed(np.arange(len(v), dtype=np.uint64), bits), np.uint64(2**64 - 1))
    out = []
    keep = hi - lo >= t
    lo, hi = lo[keep], hi[keep]
    while len(lo):
        least = np.minimum.reduceat(key, np.stack([lo, hi], axis=1).reshape(-1))[::2]
        c = _reversed(least & low, bits).astype(np.int64)
        out.append(np.stack([lo, c, hi - 1], axis=1))
        lo, hi = np.stack([lo, c + 1], axis=1).reshape(-1), np.stack([c, hi], axis=1).reshape(-1)
        keep = hi - lo >= t
        lo, hi = lo[keep], hi[keep]
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def runs(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n tokens, by their place; of the tokens' upper 32 bits, or of 32-bit tokens."""
    x = tokens >> np.uint64(32) if tokens.dtype == np.uint64 else tokens.astype(np.uint64)
    h = np.full(max(0, len(x) - n + 1), n, dtype=np.uint64)
    for i in sorted({*range(0, n, K), n - 1}):
        h = mixed(h + x[i : i + len(h)])
    return h


def anchors(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, signature, place) of several texts' tokens: those that are the least of WIDTH places by their signature."""
    h = [runs(x, SIDE + 1) for x in texts]
    sizes = np.array([len(x) for x in h], dtype=np.int64)
    v, starts = np.concatenate([*h, np.zeros(0, np.uint64)]), np.cumsum(sizes) - sizes
    c = np.unique(windows(v, WIDTH, starts)[:, 1])
    text = np.searchsorted(starts, c, "right") - 1
    return text, v[c].view(np.int64), c - starts[text]


def grown(hit: np.ndarray, c: int) -> tuple[int, int]:
    """The segment around c, end exclusive, that most outweighs misses (-4) by hits (+1) on either side."""
    gain = np.where(hit, 1, -4)
    right = np.cumsum(gain[c:])
    left = np.cumsum(gain[: c + 1][::-1])
    return c - int(left.argmax()), c + int(len(right) - 1 - right[::-1].argmax()) + 1


def longest(hit: np.ndarray, c: int) -> tuple[int, int]:
    """The longest segment around c, end exclusive, that begins and ends with a hit and has no more than a miss for 8 hits: with
    as many misses on the other side, its likeness is 0.8."""
    score = np.concatenate([[0], np.cumsum(np.where(hit, 1, -8))])
    starts, ends = np.flatnonzero(hit[: c + 1]), c + 1 + np.flatnonzero(hit[c:])
    if not len(starts) or not len(ends):
        return c, c
    low = np.minimum.accumulate(score[starts])
    first = np.searchsorted(-low, -score[ends])  # the first start whose score so far isn't above the end's
    ok = first < len(starts)
    if not ok.any():
        return c, c
    starts, ends = starts[first[ok]], ends[ok]
    i = int((ends - starts).argmax())
    return int(starts[i]), int(ends[i])


def alike(x: np.ndarray, cx: int, y: np.ndarray, cy: int, t: int = T, like: float = LIKE, memo: dict | None = None) -> tuple | None:
    """(start, end, other start, other end, likeness) in tokens of verified passages around the places, or None.
    memo: what earlier places of the same x and y found."""
    memo = {} if memo is None else memo
    return _alike(x, cx, y, cy, t, like, memo, grown) or _alike(x, cx, y, cy, t, like, memo, longest)


def _alike(x: np.ndarray, cx: int, y: np.ndarray, cy: int, t: int, like: float, memo: dict, segment) -> tuple | None:
    a, b = 0, len(y)
    for _ in range(2):
        if (a, b) not in memo:
            memo[a, b] = np.isin(x, y[a:b])
        sx, ex = segment(memo[a, b], cx)
        if ex - sx < t:
            return None
        if (a, b, sx, ex) not in memo:
            memo[a, b, sx, ex] = np.isin(y[a:b], x[sx:ex])
        sy, ey = (a + z for z in segment(memo[a, b, sx, ex], cy - a))
        if ey - sy < t:
            return None
        key = ("j", sx, ex, sy, ey)
        if key not in memo:
            u, w = np.unique(x[sx:ex]), np.unique(y[sy:ey])
            both = len(np.intersect1d(u, w, assume_unique=True))
            memo[key] = both / (len(u) + len(w) - both)
        if memo[key] >= like:
            return sx, ex, sy, ey, memo[key]
        a, b = sy, ey  # once more, against the segment alone
    return None


def islands(hits: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """hits (c, oc) of a pair of documents in groups: those within T tokens, on diagonals no more than SHIFT apart, in a chain. Of
    the groups near a diagonal the last one is looked at."""
    out: list[list] = []
    last: dict[int, list] = {}
    for c, oc in sorted(hits):
        d = c - oc
        at = d // SHIFT
        near = (last.get(k) for k in (at, at - 1, at + 1))
        g = next((g for g in near if g and c - g[0] <= T and abs(g[1] - d) <= SHIFT), None)
        if g is None:
            g = [c, d, []]
            out.append(g)
        g[0], g[1] = c, d
        g[2].append((c, oc))
        last[at] = g
    return [g[2] for g in out]


def compared(x: np.ndarray, x0: int, y: np.ndarray, y0: int, hits: list[tuple], t: int = T, like: float = LIKE) -> tuple[list, list, list, list]:
    """Verified passages (start, end, other start, other end, likeness) of an island's hits, in tokens; (c, oc, whether less than t
    tokens are equal on a side) of hits that are copies, in an equal run of t tokens; c of those that are alike; and c of those
    that are neither. x and y: the tokens from x0 and y0 on."""
    met, copies, near, others, memo, breaks, known = [], [], [], [], {}, {}, set()
    for c, oc in hits:
        i, j = c - x0, oc - y0
        if not (0 <= i < len(x) and 0 <= j < len(y)):
            continue
        if i - j not in breaks:
            a, b = max(0, j - i), max(0, i - j)  # y's and x's beginning of the diagonal
            n = min(len(x) - b, len(y) - a)
            breaks[i - j] = b, np.concatenate([[-1], np.flatnonzero(x[b : b + n] != y[a : a + n]), [n]])
        b, cuts = breaks[i - j]
        at = int(np.searchsorted(cuts, i - b))
        if cuts[at] == i - b:  # hashes of signatures met by chance
            continue
        s, e = b + int(cuts[at - 1]) + 1, b + int(cuts[at])
        if e - s >= t:
            copies.append((c, oc, i - s < t or e - i <= t))
            if (i - j, s) not in known and not any(p <= s + x0 and e + x0 <= q and op <= s + x0 - c + oc and e + x0 - c + oc <= oq for p, q, op, oq, _ in met):
                met.append((s + x0, e + x0, s + x0 - c + oc, e + x0 - c + oc, 1.0))
            known.add((i - j, s))
            continue
        found = any(p <= c < q and op <= oc < oq for p, q, op, oq, _ in met)
        if not found and (got := alike(x, i, y, j, t, like, memo)):
            met.append((got[0] + x0, got[1] + x0, got[2] + y0, got[3] + y0, got[4]))
            found = True
        (near if found else others).append(c)
    return met, copies, near, others


def copies_of(docs: DataFrame, t: int) -> DataFrame:
    """(doc, other, n): documents whose text a smaller id has too, and its words; only texts that may hold a passage."""
    c = F.col
    texts = docs.where(F.length("text") >= 2 * (t + K - 1) - 1).select("doc", F.unhex(F.sha2("text", 256)).alias("h"), F.regexp_count("text", F.lit(WORD)).alias("n"))
    texts = stored(texts.where(c("n") >= t + K - 1), "texts")
    first = texts.groupBy("h").agg(F.min("doc").alias("other"), F.max("doc").alias("last")).where("other < last")
    first = stored(first.select("h", "other"), "first")  # a table, so that a frequent text's rows can be split
    return texts.join(first, "h").where("other < doc").groupBy("doc").agg(F.min("other").alias("other"), F.min("n").alias("n"))


def without(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """docs whose ids aren't in copies, by bit maps of fixed size: of ids whose bit is a copy's, those that are none are looked up,
    and where their bit is a copy's again, joined. So texts pass no shuffle as long as the maps aren't full."""
    bit = lambda salt: F.xxhash64("doc", F.lit(salt))
    first = stored(bitmap(copies.select(bit(0))), "copies-map")
    marked = docs.select("doc", "text").withColumn("_bm", first.scalar())
    hit = in_bitmap(F.col("_bm"), bit(0))
    other = stored(marked.where(hit).select("doc").distinct().join(copies.select("doc"), "doc", "left_anti"), "others")
    second = stored(bitmap(other.select(bit(1))), "others-map")
    maybe = marked.where(hit).select("doc", "text").withColumn("_bm", second.scalar())
    maybe = maybe.where(in_bitmap(F.col("_bm"), bit(1))).select("doc", "text").join(other, "doc", "left_semi")
    return marked.where(~hit).select("doc", "text").unionByName(maybe)


def repeated(df: DataFrame, id_col: str = "doc_id", text: str = "text", t: int = T, like: float = LIKE) -> DataFrame:
    """doc_id, other_id, start, end, other_start, other_end (words), similarity of each verified repeat."""
    c = F.col
    docs = df.where(c(id_col).isNotNull()).select(c(id_col).cast("long").alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    copies = stored(copies_of(docs, t), "copies")
    own = without(docs, copies)  # equal texts are known: only the first of them goes on

    def found(mask: np.ndarray | None):
        """A row per signature; with a mask, only those whose bit is set, with their places."""

        def run(batches):
            import pyarrow as pa

            for b in sliced(batches):
                hashes = word_hashes(b.column(1))
                long = [i for i, w in enumerate(hashes) if len(w) >= t + K - 1]
                at, key, place = anchors([shingles(hashes[i], K) for i in long])
                if mask is None:
                    yield pa.RecordBatch.from_pydict({"key": key})
                    continue
                s = key & ((1 << MAP_BITS) - 1)
                keep = (mask[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                doc = np.asarray(b.column(0))[np.array(long, dtype=np.int64)[at[keep]]] if keep.any() else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({"key": key[keep], "doc": doc, "c": place[keep].astype(np.int32)})

        return run

    shared = mapped(own, found(None), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    mask = np.array(bitmap(shared, MAP_BITS, hashed=True).first().bm, dtype=np.int64).view(np.uint64)  # of fixed size
    open_ = stored(mapped(own, found(mask), "key long, doc long, c int"), "signatures")
    names = [id_col, "other_id", "start", "end", "other_start", "other_end", "similarity"]
    rounds = []  # the tables of checks
    for step in STEPS:
        if (cand := candidates(open_)).isEmpty():
            break
        if not rounds:
            tokens = stored_in_small_batches(tokens_of(own, cand, t), "tokens")
        rounds.append(stored_in_small_batches(checks(cand, tokens, t, like, step), "checked"))
        open_ = rounds[-1].where(c("step") == T).select("key", "doc", "c")
    if rounds:
        rest = rounds[0].where(c("step") == STEPS[0]).select("key", "doc", "c").distinct()
        known = rounds[0].where("step = 0").select("key", "doc", "c", F.lit(0).cast("long").alias("cls"))
        for x in rounds[1:]:
            copied = x.where("step = 0").groupBy("doc", "c").agg(F.min(F.xxhash64("other", "key")).alias("cls"))
            rest = rest.join(stored(copied, "copied"), ["doc", "c"], "left")
            known = known.unionByName(rest.where("cls is not null").select("key", "doc", "c", "cls"))
            rest = rest.where("cls is null").select("key", "doc", "c")
        spots = chains(rest.withColumn("cls", F.lit(None).cast("long")).unionByName(known))
        rounds.append(stored_in_small_batches(linked(spots, tokens, t, like), "linked"))
    whole = copies.select(c("doc").alias(id_col), c("other").alias("other_id"), F.lit(0).alias("start"), c("n").alias("end"), F.lit(0).alias("other_start"), c("n").alias("other_end"), F.lit(1.0).alias("similarity"))
    for x in rounds:
        whole = whole.unionByName(x.where("similarity is not null").select(c("doc").alias(id_col), c("other").alias("other_id"), *names[2:]))
    kinds = [c(n).cast("long").alias(n) for n in names[:6]]
    return whole.select(*kinds, "similarity").dropDuplicates(names[:6])


def candidates(rows: DataFrame) -> DataFrame:
    """doc, other, hits and their bounds: places (key, doc, c) with their key's representative, its least document and place there.
    The other places of the representative's document come too, as pairs of it with itself."""
    c = F.col
    spots = rows.groupBy("key").agg(F.min(F.struct("doc", "c")).alias("o"), F.max("doc").alias("last")).where("o.doc < last")
    spots = spots.select("key", c("o.doc").alias("other"), c("o.c").alias("oc"))
    # spots has a row per key; as a table it is shuffled apart from rows, so that adaptive execution can split a frequent key's
    return gathered(rows.join(stored(spots, "spots"), "key").where("doc != other or c != oc"))


def chains(places: DataFrame) -> DataFrame:
    """key, doc, c, last, open, cls: places (key, doc, c, cls) of signatures that have open ones, those without a class. Places of
    one signature whose tokens touch hold the same tokens and no other, so all of them find the same segments: they are one."""
    c = F.col
    by = Window.partitionBy("key", "doc").orderBy("c")
    sums = places.groupBy("key").agg(F.max(c("cls").isNull()).alias("some"), F.min("doc").alias("least"), F.max("doc").alias("most"))
    places = places.join(stored(sums.where("some and least < most").select("key"), "keys"), "key", "left_semi")
    places = places.withColumn("new", F.coalesce(c("c") - F.lag("c").over(by) > SIDE + 1, F.lit(True)).cast("int"))
    places = places.withColumn("chain", F.sum("new").over(by))
    ends = [F.min("c").alias("c"), F.max("c").alias("last"), F.max(c("cls").isNull()).alias("open"), F.max("cls").alias("cls")]
    return stored(places.groupBy("key", "doc", "chain").agg(*ends).drop("chain"), "chains")


def linked(spots: DataFrame, tokens: DataFrame, t: int, like: float) -> DataFrame:
    """Rows of verified passages (words) that link the chains of each signature: open ones with each other and with those of known
    classes. Blocks of chains meet in pairs, so that no task has a whole signature; what is linked already isn't compared again."""
    c = F.col
    n = spots.groupBy("key").agg(F.count_if("open").alias("n"), F.count_if(~c("open")).alias("m"))
    block = lambda k: F.pmod(F.xxhash64("doc", "c"), k).cast("int")
    many = lambda k: F.greatest(F.lit(1), F.ceil(c(k) / BLOCK)).cast("int")
    n = stored(n.select("key", many("n").alias("n"), many("m").alias("m")), "sizes")
    x = spots.join(n, "key").withColumn("block", F.when(c("open"), block(c("n"))).otherwise(block(c("m"))))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    up_to = lambda k, f: F.transform(F.sequence(F.lit(0), c(k) - 1), f)
    # a block of open chains meets those of known classes, as (block, -1 - block), and the other open ones
    others = F.filter(up_to("n", lambda i: pair(F.least(i, c("block")), F.greatest(i, c("block")))), lambda z: z["a"] < z["b"])
    of_open = F.concat(up_to("m", lambda i: pair(c("block"), -1 - i)), others)
    x = x.withColumn("at", F.explode(F.when(c("open"), of_open).otherwise(up_to("n", lambda i: pair(i, -1 - c("block"))))))
    x0 = F.greatest(F.lit(0), c("c") - AROUND)
    x = x.join(tokens, "doc").withColumn("k", F.substring("k", x0 * 4 + 1, (c("last") + AROUND + 1 - x0) * 4))
    spot = F.struct("doc", "c", "last", "open", "cls", "block", "k")
    # the largest groups are bounded by blocks; groups of one chain have nothing to compare
    x = x.groupBy("key", c("at.a").alias("a"), c("at.b").alias("b")).agg(F.collect_list(spot).alias("spots")).where(F.size("spots") > 1)

    def run(batches):
        import pyarrow as pa

        names = ["doc", "other", "start", "end", "other_start", "other_end", "similarity"]
        kinds = [pa.int64()] * 6 + [pa.float64()]
        for b in sliced(batches):
            out = []
            for a, z, group in zip(*(b.column(k).to_pylist() for k in ("a", "b", "spots")), strict=True):
                for doc, other, (s, e, os, oe, j) in links(group, a, z, t, like):
                    out.append((doc, other, s, e + K - 1, os, oe + K - 1, j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(z, kind) for z, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return mapped(x, run, "doc long, other long, start long, end long, other_start long, other_end long, similarity double")


def hopeful(texts: list[np.ndarray], places: list[int], t: int) -> tuple[np.ndarray, np.ndarray]:
    """[i, j]: whether alike() may find a passage around the places of texts i and j, which is so wherever it does; and the tokens
    of text i that are in text j. What grown() and longest() find in all of a text is as long as in a part at least."""
    n = len(texts)
    _, token = np.unique(np.concatenate(texts), return_inverse=True)
    ends = np.cumsum([len(x) for x in texts])
    owner = np.repeat(np.arange(n), [len(x) for x in texts])
    has = np.zeros((int(token.max()) + 1, n), bool)
    has[token, owner] = True
    by_gain, by_score, hits = (np.zeros((n, n), kind) for kind in (bool, bool, np.int32))
    for i, p in enumerate(places):
        hit = has[token[ends[i] - len(texts[i]) : ends[i]]]
        hits[i] = hit.sum(axis=0)
        # grown(): the last place of the highest sum on either side
        gain = np.where(hit, np.int32(1), np.int32(-4))
        sides = [np.cumsum(x, axis=0)[::-1] for x in (gain[p:], gain[p::-1])]
        by_gain[i] = sum(len(x) - x.argmax(axis=0) for x in sides) - 1 >= t
        # longest(): a segment of t tokens at least whose score isn't below 0; by the tokens on either side
        score = np.where(hit, np.int32(1), np.int32(-8))
        right, left = (np.maximum.accumulate(np.cumsum(x, axis=0)[::-1], axis=0)[::-1] for x in (score[p:], score[p::-1]))
        k = np.arange(max(1, t - len(left) + 1), min(t, len(right)) + 1)  # on the right, with the place
        if len(k):
            by_score[i] = (right[k - 1] + left[t - k] >= np.where(hit[p], 1, -8)).any(axis=0)
    return (by_gain & by_gain.T) | (by_score & by_score.T), hits


def links(group: list[dict], a: int, b: int, t: int, like: float):
    """(doc, other, passage) of chains that are alike, the nearest first, until no two classes have any that are left to compare."""
    group = sorted(group, key=lambda x: (x["doc"], x["c"]))
    texts = [np.frombuffer(x["k"], "<u4") for x in group]
    doc, is_open, block = (np.array([x[k] for x in group]) for k in ("doc", "open", "block"))
    if b >= 0:
        wanted = block[:, None] != block[None]
    else:
        wanted = (is_open[:, None] | is_open[None]) if b == -1 else (is_open[:, None] != is_open[None])
    wanted = np.tril(wanted & (doc[:, None] != doc[None]))
    if not wanted.any():
        return
    may, hits = hopeful(texts, [min(x["c"], AROUND) for x in group], t)
    hits = np.minimum(hits, hits.T)
    i, j = np.nonzero(wanted & may)
    if not len(i):
        return
    root = list(range(len(group)))

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    first: dict = {}
    for k, x in enumerate(group):
        if x["cls"] is not None:
            root[find(k)] = find(first.setdefault(x["cls"], k))
    for k in np.lexsort((j, i, -hits[i, j])):
        x, y = int(i[k]), int(j[k])
        if find(x) == find(y):
            continue
        u, v = group[x], group[y]
        places = sorted({(p, q) for p in (u["c"], u["last"]) for q in (v["c"], v["last"])})
        met, *_ = compared(texts[x], max(0, u["c"] - AROUND), texts[y], max(0, v["c"] - AROUND), places, t, like)
        if met:
            root[find(x)] = find(y)
            for m in met:
                yield u["doc"], v["doc"], m


def gathered(hits: DataFrame) -> DataFrame:
    """doc, other, hits and the bounds of what is compared around them, of rows (doc, other, c, oc)."""
    c = F.col
    low, high = (lambda x: F.greatest(F.lit(0), F.min(x) - AROUND)), (lambda x: F.max(x) + AROUND)
    bounds = [low("c").alias("x0"), high("c").alias("x1"), low("oc").alias("y0"), high("oc").alias("y1")]
    return stored(hits.groupBy("doc", "other").agg(F.collect_set(F.struct("c", "oc")).alias("hits"), *bounds), "candidates")


def tokens_of(docs: DataFrame, cand: DataFrame, t: int) -> DataFrame:
    """doc, k: the tokens of the candidates' documents, 32 bits each."""

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches):
            k = [(shingles(x, K) >> np.uint64(32)).astype("<u4").tobytes() for x in word_hashes(b.column(1))]
            yield pa.RecordBatch.from_pydict({"doc": b.column(0), "k": pa.array(k, pa.binary())})

    ids = stored(cand.select("doc").union(cand.select("other")).distinct(), "ids")
    some = docs.withColumn("_bm", bitmap(ids.select("doc"), 20).scalar()).where(in_bitmap(F.col("_bm"), F.col("doc"), 20)).select("doc", "text")
    some = some.join(ids, "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text"))
    return mapped(some, run, "doc long, k binary")


def checks(cand: DataFrame, tokens: DataFrame, t: int, like: float, step: int) -> DataFrame:
    """Rows of verified passages (words), and of places by ``step``. After the first round: STEPS[0] for open ones, with their signature, T for the same with passages of T tokens around them, and 0 for those that are alike and
    copies whose run ends within T tokens, with their signature. After the second: 0 for copies, with their representative's place."""
    c = F.col
    part = lambda k, a, b: F.substring(k, a * 4 + 1, (b - a + 1) * 4)
    x = cand.join(tokens, "doc").withColumn("kx", part(c("k"), c("x0"), c("x1"))).drop("k")
    x = x.join(tokens.select(c("doc").alias("other"), "k"), "other").withColumn("ky", part(c("k"), c("y0"), c("y1"))).drop("k")

    def passages_at(x, x0, places):
        """(hash, place) of passages of t tokens that hold the places: those that are the least of WIDTH in a row."""
        v = runs(x, t)
        if len(v) and places:
            wide = np.lib.stride_tricks.sliding_window_view(v, min(WIDTH, len(v)))
            least = np.unique(wide.argmin(axis=1) + np.arange(len(wide)))
            for p in places:
                for k in least[np.searchsorted(least, p - x0 - t, "right") : np.searchsorted(least, p - x0, "right")]:
                    yield int(v[k].view(np.int64)), p

    def run(batches):
        import pyarrow as pa

        fields = ["doc", "other", "start", "end", "other_start", "other_end", "similarity", "key", "c", "step"]
        kinds = [pa.int64()] * 6 + [pa.float64(), pa.int64()] + [pa.int32()] * 2
        for b in sliced(batches):
            out = []
            col = (b.column(k).to_pylist() for k in ("doc", "other", "hits", "x0", "y0", "kx", "ky"))
            for doc, other, hits, x0, y0, kx, ky in zip(*col, strict=True):
                u, v = np.frombuffer(kx, "<u4"), np.frombuffer(ky, "<u4")
                for hs in islands([(h["c"], h["oc"]) for h in hits]):
                    # the island's own part of the texts
                    (a, e), (oa, oe) = ((max(z, min(h[i] for h in hs) - AROUND), max(h[i] for h in hs) + AROUND + 1) for i, z in ((0, x0), (1, y0)))
                    xs, ys = u[a - x0 : e - x0], v[oa - y0 : oe - y0]
                    met, copied, near, others = compared(xs, a, ys, oa, hs, t, like)
                    if doc != other:
                        out += [(doc, other, s, n + K - 1, os, on + K - 1, j, *[None] * 3) for s, n, os, on, j in met]
                    keys = runs(xs, SIDE + 1).view(np.int64)
                    if step == STEPS[0]:
                        # places of the representative's document have no row with it: they stay open
                        known = [*near, *(p for p, _, ends in copied if ends)] if doc != other else []
                        open_ = others if doc != other else [*others, *near, *(p for p, *_ in copied)]
                        out += [(doc, other, *[None] * 5, int(keys[p - a]), p, step) for p in open_]
                        out += [(doc, other, *[None] * 5, key, p, t) for key, p in passages_at(xs, a, others if doc != other else [*others, *near])]
                        out += [(doc, other, *[None] * 5, int(keys[p - a]), p, 0) for p in known]
                    elif step == T and doc != other:  # the representative's place tells the class
                        out += [(doc, other, *[None] * 5, op, p, 0) for p, op, _ in copied]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(z, kind) for z, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=fields)

    schema = "doc long, other long, start long, end long, other_start long, other_end long, similarity double, key long, c int, step int"
    return mapped(x, run, schema)
