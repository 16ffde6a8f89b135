"""Document fingerprints: I-Match over randomised lexicons, in DataFrame functions only.

Terms are white-space words in lower case. Document frequencies are counted over the whole corpus; the lexicon
is the terms whose share of documents lies within a band, in 2**SLOTS slots by their hash: of terms that share a slot the
one of the least hash. So its size is bounded whatever the corpus, and no term outside the band is in it (by 64-bit hash).
A document keeps its terms in the lexicon, sorted and distinct, and hashes them once for each of ``SUBSETS``
randomised lexicons: rates 2**-level, so that short and long documents both have lexicons of the size at which a changed
term need not change the hash. A lexicon is a range of the terms' random hashes: those of the first two levels tile all
of them, those of the others follow one another, so that a term is in three lexicons at most and a lexicon's terms are
one slice of a document's sorted terms.

Defined results: null text counts as empty; the lexicon says little of a document with fewer than LEAST terms in it, which is
fingerprinted from all its terms; an empty hash is written as dashes and never counts as a match unless both texts are
without terms; equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import let, stored

LO, HI = 0.0005, 0.1
SLOTS = 19
LEAST = 4
#: Level and number of lexicons of rate 2**-level.
LEVELS = [(3, 8)] + [(level, 16) for level in range(4, 15)]
SUBSETS = sum(n for _, n in LEVELS)
WIDTH = 8
EMPTY = "-" * WIDTH


def terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x09-\x0D ]+", -1)), "")


def hashed_terms(text: Column) -> Column:
    return F.transform(terms(text), lambda t: F.xxhash64(t))


def slot(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << SLOTS) - 1)).cast("int")


def lexicon(df: DataFrame, text: str = "text", lo: float = LO, hi: float = HI) -> DataFrame:
    """One row: the array of 2**SLOTS slots, each a term's hash or 0, of the terms whose document share is within
    [lo, hi] and that two documents have; shares count all rows of df."""
    freq = df.select(F.explode(hashed_terms(F.col(text))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    docs = df.agg(F.count("*").alias("docs")).scalar()
    band = freq.where((F.col("n") >= F.greatest(F.lit(2.0), lo * docs)) & (F.col("n") <= hi * docs))
    taken = band.groupBy(slot(F.col("h")).cast("long").alias("id")).agg(F.min("h").alias("h"))
    whole = df.sparkSession.range(1 << SLOTS).join(taken, "id", "left").select("id", F.coalesce("h", F.lit(0)).alias("h"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "h"))), lambda x: x["h"]).alias("lexicon"))


def fingerprints(df: DataFrame, text: str, lex: DataFrame, out: str) -> DataFrame:
    """df with the fingerprint of its column text under the lexicon: an array of SUBSETS hashes. The lexicon is a column
    that one expression names once, so that Spark puts the subquery's result there and rows don't carry it."""

    def kept(found: Column) -> Column:
        some = F.filter(found, lambda h: F.get(F.col("_lexicon"), slot(h)) == h)
        marked = let(some, lambda x: F.concat(F.when(F.size(x) >= LEAST, x).otherwise(found), F.array(*[F.lit(x) for x in MARKS])))
        return F.sort_array(marked)

    df = df.withColumn("_lexicon", lex.scalar())
    df = df.select(*[c for c in df.columns if c != "_lexicon"], let(hashed_terms(F.col(text)), kept).alias("_kept"))
    # each step is a projection of its own, so that nothing is computed twice
    df = df.withColumn("_at", F.filter(F.transform("_kept", lambda x, i: F.when(x.isin(*MARKS), i + 1)), lambda i: i.isNotNull()))
    return df.withColumn(out, fingerprint(F.col("_kept"), F.col("_at"))).drop("_kept", "_at")


def _lexicons() -> tuple[list[int], list[tuple[int, int]]]:
    """The marks at which lexicons begin or end, as signed 64-bit hashes in order, and each lexicon's two marks."""
    ranges, at = [], 0.0
    for level, n in LEVELS:
        ranges += [(at + i / (1 << level), at + (i + 1) / (1 << level)) for i in range(n)]
        at = (at + n / (1 << level)) % 1.0
    ends = sorted({x for r in ranges for x in r})
    marks = [min(int(x * 2**64) - 2**63, 2**63 - 1) for x in ends]
    return marks, [(ends.index(a), ends.index(b)) for a, b in ranges]


MARKS, LEXICONS = _lexicons()
_LOW = 2**32 - 1


def fingerprint(kept: Column, at: Column) -> Column:
    """SUBSETS hashes of 32 bits, null without terms. kept: sorted hashes of terms and the MARKS among them; at: the places
    of the MARKS, from 1. A lexicon's marks are hashed with its terms, which changes nothing."""

    def hashed(x: Column) -> Column:
        first = F.get(at, x["a"])
        n = F.get(at, x["b"]) - first
        h = F.xxhash64(F.slice(kept, first, n)).bitwiseAND(F.lit(_LOW)) - F.lit(2**31)
        return F.when(n != x["b"] - x["a"], h.cast("int"))

    # a loop over the lexicons, not an expression for each: a method that long would not be compiled to machine code
    return F.transform(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in LEXICONS]), hashed)


def written(hashes: Column) -> Column:
    """A fingerprint as text: WIDTH hex digits of each hash."""
    digits = lambda h: F.lower(F.substring(F.hex(h.cast("long") + F.lit(2**31 + 2**32)), 2, WIDTH))
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(digits(h), F.lit(EMPTY))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the lexicons that either fingerprint meets; 1 for equal fingerprints."""
    met = F.filter(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), x.eqNullSafe(y))), lambda x: x.isNotNull())
    return F.when(a == b, 1.0).otherwise(let(met, lambda m: F.when(F.size(m) == 0, 0.0).otherwise(F.size(F.filter(m, lambda x: x)) / F.size(m))))


#: Bits of an id within a block, and of a block within a group of blocks.
BLOCK, GROUP = 10, 13


def with_previous(blocks: DataFrame, levels: int = 3) -> DataFrame:
    """blocks(b), distinct -> b, before: the block before it in order, for the first one the last. Blocks are numbers of
    64 - BLOCK bits; those of a group are ordered together, then groups of groups, so that no task orders more than
    2**GROUP (at the top, 2**(64 - BLOCK - levels * GROUP)) of them, however ids are spread."""
    if not levels:
        return blocks.withColumn("before", F.coalesce(F.lag("b").over(Window.orderBy("b")), F.max("b").over(Window.partitionBy())))
    inner = blocks.withColumn("p", F.shiftright("b", GROUP))
    groups = inner.groupBy("p").agg(F.max("b").alias("last"))
    above = with_previous(groups.select(F.col("p").alias("b")), levels - 1).withColumnsRenamed({"b": "p", "before": "q"})
    above = above.join(groups.select(F.col("p").alias("q"), "last"), "q").select("p", "last")
    inner = inner.withColumn("lag", F.lag("b").over(Window.partitionBy("p").orderBy("b")))
    return inner.join(above, "p").select("b", F.coalesce("lag", "last").alias("before"))


def with_next(df: DataFrame, key: str, derive) -> DataFrame:
    """derive(df), whose columns are key and others, with ``next``: a struct of the next row's other columns by key (ties
    by these columns), after the last the first.

    One shuffle by blocks of 2**BLOCK ids. The first row of each block is also dealt to the block before it, so that no
    window spans blocks. First rows are found by their ids alone, and derive() runs over them once more. Rows of a null
    key are nobody's next, and the first row is theirs. Rows of one key stand in one block."""
    block, known = F.shiftright(F.col(key), BLOCK), F.col(key).isNotNull()
    firsts = stored(df.where(known).groupBy(block.alias("b")).agg(F.min(key).alias(key)), "blocks")
    to = firsts.join(with_previous(firsts.select("b")), "b").select(key, F.col("before").alias("_b"))
    to = stored(to, "starts")  # a table of known size: joined by broadcast as long as it is small
    own = derive(df)
    value = F.struct(*[c for c in own.columns if c != key])
    guests = derive(df.where(known).join(to.select(key), key, "left_semi")).select(key, value.alias("_v")).groupBy(key).agg(F.min("_v").alias("_v")).join(to, key)
    guests = stored(guests.select(key, "_v", "_b"), "firsts")
    both = own.select(key, value.alias("_v"), block.alias("_b"), F.lit(False).alias("_guest"))
    both = both.where(known).unionByName(guests.withColumn("_guest", F.lit(True)))
    w = Window.partitionBy("_b").orderBy("_guest", key, "_v")
    out = both.withColumn("next", F.lead("_v").over(w)).where(~F.col("_guest")).select(key, "_v.*", "next")
    lost = own.where(F.col(key).isNull())
    return out.unionByName(lost.withColumn("next", guests.agg(F.min_by("_v", key).alias("v")).scalar()))


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of the other text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def compare_neighbours(df: DataFrame, id_col: str = "doc_id", text: str = "text", lo: float = LO, hi: float = HI) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    lex = stored(lexicon(docs, "text", lo, hi), "lexicon")  # one row, counted once for all its uses
    x = with_next(docs, "id", lambda d: fingerprints(d, "text", lex, "f"))
    x = x.select("id", "text", "f", F.col("next.text").alias("other"), F.col("next.f").alias("g"))
    x = x.select("id", "f", "g", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("other")).alias("e"))
    x = fingerprints(x.withColumn("sha", F.sha2("e", 256)), "e", lex, "ef")
    return x.select(
        F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), written(F.col("f")).alias("fingerprint"), written(F.col("ef")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("ef")).alias("near_edited"), likeness(F.col("f"), F.col("g")).alias("near_next"),
    )
