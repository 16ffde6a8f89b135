"""N-gram Jaccard join by grouped prefixes, with connected components of the links.

Texts become sets of hashed k-word shingles. In a common order of all shingles two sets of Jaccard likeness t or more
share one of their first n - ceil(t n) + 1 shingles (the prefix). The order puts frequent shingles last, so that
prefixes hold rare ones: counts come from all documents (lossy counting within batches, summed), and the ``FREQUENT``
most frequent shingles go to tasks. Any order that all agree on gives the same result.

1. Documents with equal sets fall together. Those left with an identical prefix and size become one group.
2. Groups that share a prefix shingle are candidates, filtered by size and by the places of the shingle. A list of
   groups that share a shingle is first linked as a star: each member with the list's hub, the one in whose prefix
   the shingle stands first. Only members that this leaves in another part than the hub then meet the whole list.
   So n near copies cost about n comparisons, and no link between parts is lost.
3. Groups are expanded to members. A pair whose parity maps differ in more bits than two alike sets can is no link:
   each element of one set alone flips one bit, so the maps differ in at most as many bits as the sets in elements.
   Every other pair is verified on the whole sets: 100 * shared >= percent * union.

Sets are vertices: rows of one id with different texts are apart, and linked only by what their texts share. Links between
documents already known to be in one component are not needed for components and are not searched for: ``links_seen``
counts the links that were verified, which in a group of many near copies are fewer than all.

Defined results: null and empty texts, and texts without words, have no shingles and link with nothing; texts of fewer
than k words are one shingle; rows that repeat an id are rows each, with that id's component; a null id has a null
component.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bitmap, in_bitmap, mapped, salted_left_join, shingles, sliced, small_batches, stored, word_hashes

K, PERCENT = 4, 85
FREQUENT = 1 << 19
LEAST_FREQUENT = 6
BITS = 20
#: Bits of a parity map.
LEAST_BITS, MOST_BITS = 256, 1 << 16


def sets_of(column, k: int) -> list[np.ndarray]:
    return [np.unique(shingles(h, k)) for h in word_hashes(column)]


def frequent(df: DataFrame, text: str, k: int = K, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` frequent shingles, ascending, and their ranks by frequency. Every document is counted; within
    a slice of a batch shingles seen once are let go, so a count may be short by 1 a slice."""

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches):
            s, c = np.unique(np.concatenate(sets_of(b.column(0), k) or [np.zeros(0, np.uint64)]), return_counts=True)
            s, c = s[c > 1], c[c > 1]
            yield pa.RecordBatch.from_pydict({"s": s.view(np.int64), "c": c.astype(np.int64)})

    counts = mapped(df.select(text), run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") >= LEAST_FREQUENT)
    with small_batches(df.sparkSession):
        top = counts.orderBy(F.desc("c"), "s").limit(most).toArrow()  # bounded by ``most``
    s, c = np.array(top.column("s")).view(np.uint64), np.array(top.column("c"))
    o = np.argsort(s)
    return s[o], c[o].astype(np.int64)


def digest(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


def prefix_length(n: int, percent: int) -> int:
    """The first shingles of which one is shared by any set of enough likeness."""
    return n - (-(-percent * n // 100)) + 1


def ordered(x: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """x in the common order: infrequent shingles by hash, then frequent ones by count."""
    if not len(common):
        return x
    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
    c = np.where(common[at] == x, count[at], 0)
    return x[np.lexsort((x, c))]


def parity(x: np.ndarray) -> bytes:
    """A bit map of the set: bit i is the parity of the elements that fall on i. It has the least power of two of
    bits, LEAST_BITS at least and MOST_BITS at most, that is twice the set's size or more. A half folded onto the
    other by exclusive or is the map of half the bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(x) - 1).bit_length()))
    return np.packbits(np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def may_link(na: int, pa: bytes, nb: int, pb: bytes, percent: int) -> bool:
    """False only if sets of these sizes and parity maps are surely less alike."""
    u, v = np.frombuffer(pa, np.uint8), np.frombuffer(pb, np.uint8)
    n = min(len(u), len(v))
    u, v = np.bitwise_xor.reduce(u.reshape(-1, n), axis=0), np.bitwise_xor.reduce(v.reshape(-1, n), axis=0)
    return int(np.bitwise_count(u ^ v).sum()) * (100 + percent) <= (na + nb) * (100 - percent)


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their parity maps don't rule out."""

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches):
            rows = zip(*(b.column(x).to_pylist() for x in ("na", "ma", "nb", "mb")), strict=True)
            yield b.select(["a", "b"]).filter(pa.array([may_link(*r, percent) for r in rows], pa.bool_()))

    side = lambda x: reps.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("map").alias(f"m{x}"))
    return mapped(pairs.join(side("a"), "a").join(side("b"), "b"), run, "a long, b long").distinct()


def profiles(df: DataFrame, id_col: str, text: str, common: np.ndarray, count: np.ndarray, k: int, percent: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc, n, digest (of the set), gkey (of prefix and size), map (of parities), prefix, and the columns ``keep``."""

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches):
            rows = {"n": [], "digest": [], "gkey": [], "map": [], "prefix": []}
            for x in sets_of(b.column(1), k):
                p = ordered(x, common, count)[: prefix_length(len(x), percent)] if len(x) else x
                rows["n"].append(len(x))
                rows["digest"].append(digest(x))
                rows["gkey"].append(xxhash.xxh3_128_digest(p.tobytes() + len(x).to_bytes(8, "little")))
                rows["map"].append(parity(x))
                rows["prefix"].append(p.view(np.int64))
            some = {x: pa.array(rows[x], pa.binary()) for x in ("digest", "gkey", "map")}
            kept = {f"k{i}": b.column(2 + i) for i in range(len(keep))}
            yield pa.RecordBatch.from_pydict({"doc": b.column(0), "n": pa.array(rows["n"], pa.int64()), **some, "prefix": pa.array(rows["prefix"], pa.list_(pa.int64())), **kept})

    texts = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = "".join(f", k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return mapped(texts, run, "doc long, n long, digest binary, gkey binary, map binary, prefix array<long>" + kinds)


def whole_sets(df: DataFrame, id_col: str, text: str, ids: DataFrame, k: int) -> DataFrame:
    """v and its set, for ids(v, doc, digest): an id may have several texts, of which the digest tells v's. A bit map of
    fixed size lets most other texts go before the shuffle."""

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches):
            sets = sets_of(b.column(2), k)
            own = [digest(x) == d for x, d in zip(sets, b.column(1).to_pylist(), strict=True)]
            sets = pa.array([x.view(np.int64) for x, o in zip(sets, own, strict=True) if o], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"v": b.column(0).filter(pa.array(own, pa.bool_())), "set": sets})

    d = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text")).withColumn("_bm", bitmap(ids.select("doc"), BITS).scalar())
    d = d.where(in_bitmap(F.col("_bm"), F.col("doc"), BITS)).select("doc", "text").join(ids, "doc").dropDuplicates(["doc", "v", "text"])
    return mapped(d.select("v", "digest", "text"), run, "v long, set array<long>").dropDuplicates(["v"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of enough likeness."""
    x = pairs.join(sets.select(F.col("v").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("v").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return x.withColumn("i", both).where(F.col("i") * 100 >= (F.size("sa") + F.size("sb") - F.col("i")) * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """v, component (the smallest vertex reachable) of the vertices of edges(a, b): the least label of the neighbours,
    then the label's label, until nothing changes. Labels are written to the shared folder each round."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("l")), "labels")
    while True:
        near = both.join(label, both["b"] == label["v"]).groupBy("a").agg(F.min("l").alias("m"))
        new = label.join(near, label["v"] == near["a"]).select("v", "l", F.least("l", "m").alias("m"))
        jump = label.select(F.col("v").alias("m"), F.col("l").alias("mm"))
        new = stored(new.join(jump, "m").select("v", F.col("l").alias("old"), F.least("m", "mm").alias("l")), "labels")
        label = new.select("v", "l")
        if new.where("old != l").isEmpty():
            return label.withColumnRenamed("l", "component")


def need(a: Column, b: Column, percent: int) -> Column:
    """The least number of shared shingles of two sets of these sizes that link."""
    return F.ceil((a + b) * percent / (100 + percent) - 1e-9)


def may(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Whether sets of these sizes whose first shared shingle may stand at these places can be alike enough."""
    return (n1 * percent <= n2 * 100) & (n2 * percent <= n1 * 100) & (F.least(n1 - p1, n2 - p2) >= need(n1, n2, percent))


def ordered_pair(x: str, y: str, to: tuple[str, str] = ("a", "b")) -> list[Column]:
    return [F.least(x, y).alias(to[0]), F.greatest(x, y).alias(to[1])]


def prefix_lists(groups: DataFrame) -> DataFrame:
    """s, g, n, pos, c, many, h, hn, hpos, least: the groups of each shingle that several prefixes hold, the number of
    them (c), whether one has several sets, the list's hub and its least size."""
    c = F.col
    # most shingles stand in one prefix only: they are counted and dropped before anything else is known of them
    lists = groups.select("g", "n", "many", F.posexplode("prefix").alias("pos", "s"))
    lists = lists.select("s", "g", (F.shiftleft("n", 32) + F.shiftleft("pos", 1) + c("many")).alias("np"))
    shared = lists.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    low = c("np").bitwiseAND(F.lit((1 << 32) - 1))
    lists = lists.join(shared, "s").select("s", "g", F.shiftright("np", 32).alias("n"), F.shiftright(low, 1).alias("pos"), low.bitwiseAND(F.lit(1)).alias("many"), "c")
    lists = stored(lists, "shared")
    hubs = lists.groupBy("s").agg(F.min(F.struct("pos", "n", "g")).alias("hub"), F.min("n").alias("least"), F.max("many").alias("many"))
    hub = [c("hub.g").alias("h"), c("hub.n").alias("hn"), c("hub.pos").alias("hpos")]
    return stored(lists.drop("many").join(hubs, "s").select("s", "g", "n", "pos", "c", "many", *hub, "least"), "lists")


def bridges(lists: DataFrame, members: DataFrame, inner: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different parts whose groups share a list or are one."""
    c = F.col
    # a list of two groups of one set each is settled by its star; so is a group of one that no other list holds
    lists = lists.where("c > 2 or many > 0")
    listed = lists.select("g").union(inner.select("g")).distinct()
    labelled = members.join(listed, "g", "left_semi").join(part, members["m"] == part["v"], "left")
    labelled = stored(labelled.select("g", "m", F.coalesce("part", "m").alias("part")), "members")
    # a group as a whole: its part if all members have one part, else null
    whole = labelled.groupBy("g").agg(F.when(F.min("part") == F.max("part"), F.min("part")).alias("gp"))
    whole = stored(whole, "groups")  # a table, so that adaptive execution can split what joins a frequent hub
    at = lists.join(whole, "g").join(whole.select(c("g").alias("h"), c("gp").alias("hp")), "h")
    # a member of the list that isn't in the hub's part, and may be alike to one of the sizes there
    apart = c("gp").isNull() | c("hp").isNull() | (c("gp") != c("hp"))
    least = F.greatest(c("least"), F.ceil(c("n") * percent / 100))
    out = at.where(apart & (c("n") - c("pos") >= need(c("n"), least, percent)))
    x = out.select("s", c("g").alias("g1"), c("n").alias("n1"), c("pos").alias("p1"), c("gp").alias("l1"))
    y = at.select("s", c("g").alias("g2"), c("n").alias("n2"), c("pos").alias("p2"), c("gp").alias("l2"))
    other = (c("g1") != c("g2")) & (c("l1").isNull() | c("l2").isNull() | (c("l1") != c("l2")))
    more = x.join(y, "s").where(other & may(c("n1"), c("p1"), c("n2"), c("p2"), percent))
    more = more.select(*ordered_pair("g1", "g2", ("g1", "g2"))).union(whole.where("gp is null").select(c("g").alias("g1"), c("g").alias("g2"))).distinct()
    m1 = labelled.select(c("g").alias("g1"), c("m").alias("a"), c("part").alias("q1"))
    m2 = labelled.select(c("g").alias("g2"), c("m").alias("b"), c("part").alias("q2"))
    pairs = more.join(m1, "g1").join(m2, "g2").where((c("q1") != c("q2")) & (c("a") != c("b")))
    return pairs.select(*ordered_pair("a", "b")).distinct()


def join(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_shingles, class_id (the smallest id with an equal set), links_seen, component_id of each row, the columns ``keep``,
    and group_id, a number of the row's component (an id with different texts may be the smallest of several), null without
    shingles."""
    c = F.col
    common, count = frequent(df, text, k)
    p = stored(profiles(df, id_col, text, common, count, k, percent, keep), "profiles")
    some = p.where("n > 0 and doc is not null")
    # a vertex v per distinct set: its number in the written table
    reps = some.groupBy("digest").agg(F.min("doc").alias("doc"), F.first("gkey").alias("gkey"), F.first("n").alias("n"), F.first("map").alias("map"))
    reps = stored(reps.withColumn("v", F.monotonically_increasing_id()), "reps")
    groups = some.groupBy("gkey").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), (F.min("digest") != F.max("digest")).cast("long").alias("many"))
    groups = stored(groups.withColumn("g", F.monotonically_increasing_id()), "groups")
    members = stored(reps.select("gkey", c("v").alias("m")).join(groups.select("gkey", "g"), "gkey").select("g", "m"), "sets")
    heads = stored(members.groupBy("g").agg(F.min("m").alias("r")), "heads")
    lists = prefix_lists(groups)

    star = lists.where((c("g") != c("h")) & may(c("n"), c("pos"), c("hn"), c("hpos"), percent)).select("g", "h").distinct()
    star = star.join(heads, "g").select("h", c("r").alias("r1")).join(heads.withColumnRenamed("g", "h"), "h").select(*ordered_pair("r", "r1"))
    inner = stored(members.join(heads, "g").where("m != r"), "inner")
    star = stored(star.union(inner.select(c("r").alias("a"), c("m").alias("b"))).distinct(), "star")

    def linked(pairs: DataFrame) -> DataFrame:
        likely = stored(plausible(pairs, reps, percent), "likely")
        ids = likely.select(c("a").alias("v")).union(likely.select(c("b").alias("v"))).distinct()
        ids = stored(ids.join(reps.select("v", "doc", "digest"), "v"), "ids")
        return stored(verified(likely, stored(whole_sets(df, id_col, text, ids, k), "sets"), percent), "links")

    links = linked(star)
    pairs = bridges(lists, members, inner, components(links).withColumnRenamed("component", "part"), percent)
    pairs = stored(pairs.join(star, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        links = stored(links.union(linked(pairs)), "links")
    comp = components(links)
    least = comp.join(reps.select("v", "doc"), "v").groupBy("component").agg(F.min("doc").alias("component_id"))
    comp = comp.join(least, "component").select("v", "component_id", "component")
    degree = links.select(c("a").alias("v")).union(links.select(c("b").alias("v"))).groupBy("v").agg(F.count("*").alias("links_seen"))
    cls = reps.select("digest", "v", c("doc").alias("class_id")).join(comp, "v", "left").join(degree, "v", "left")
    group = F.coalesce("component", "v").alias("group_id")
    cls = cls.select("digest", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("links_seen", F.lit(0)).alias("links_seen"), group)
    kept = [c(f"k{i}").alias(x) for i, x in enumerate(keep)]
    rows = p.select("doc", "n", F.when((c("n") > 0) & c("doc").isNotNull(), c("digest")).alias("digest"), *[f"k{i}" for i in range(len(keep))])
    rows = salted_left_join(rows, cls, "digest", "doc")
    # rows without shingles, but with the id of a row that has some, keep that id as a component of their own
    seen = F.coalesce("links_seen", F.lit(0)).cast("long").alias("links_seen")
    ids = [F.coalesce(x, "doc").alias(x) for x in ("class_id", "component_id")]
    return rows.select(c("doc").alias(id_col), c("n").alias("n_shingles"), ids[0], seen, ids[1], "group_id", *kept)


def survivors(joined: DataFrame, row: str, id_col: str = "doc_id") -> DataFrame:
    """``row`` (a column of join()'s ``keep``) of one row of each component, the first of its smallest id, and of all rows
    that link with nothing: those without an id or without words."""
    linked = joined.where(F.col("group_id").isNotNull())
    first = linked.where(F.col(id_col) == F.col("component_id")).groupBy("group_id").agg(F.min(row).alias(row))
    return first.select(row).unionByName(joined.where(F.col("group_id").isNull()).select(row))
