"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds of credentials are found by pattern, leftmost and non-overlapping within a kind. A wider,
less certain kind (``opaque``: long mixed-case tokens with digits) is only believed when the corpus says so:
every candidate's hash is counted by distinct owners and repositories; what few owners hold looks like a live
credential, what many hold is a copied example.

Defined results: a null text counts as empty (no spans); rows that repeat get a result each; a null owner or
repository counts as one, of an empty name; extra columns of the input, of any name, are kept by :func:`mask_secrets` and
ignored by :func:`scan_secrets`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bitmap, in_bitmap, let, salted_left_join, stored

# Fixed values of the contract: kind, pattern, value's group.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", r"AKIA[A-Z0-9]{16,}", 0),
    ("hex", r"[0-9a-f]{24,}", 0),
]
#: A token of 32 or more with a digit, an upper-case and a lower-case letter anywhere in it.
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{32,}"
LEAST_ASSIGNED = 6
#: A value of more owners, or of more repositories, than this is a copied example.
MAX_OWNERS, MAX_REPOS = 2, 6
KINDS = [k for k, _, _ in BASE] + ["opaque"]
#: Start, kind, end (exclusive) and the value's SHA-256: values themselves are never written.
SPAN = "struct<s:int,k:int,e:int,h:string>"
REDACTED = "[REDACTED]"
#: 2**PART matches of a text are gathered at a time, so that many matches don't cost their square.
PART = 9


def _none(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def _spans(text: Column, pattern: str, group: int, kind: int) -> Column:
    """array<SPAN> of all matches: the gaps between matches give their places, in code points."""

    def found(m: Column) -> Column:
        v = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(m))
        return F.when(F.size(m) == 0, _none()).otherwise(let(F.arrays_zip(gaps.alias("g"), m.alias("m"), v.alias("v")), placed))

    def placed(z: Column) -> Column:
        def one(t: Column, x: Column) -> Column:
            start = t["p"] + F.length(x["g"])
            end = start + F.length(x["m"])
            span = F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"), F.sha2(x["v"], 256).alias("h"))
            if kind == 0:
                kept = F.when(F.length(x["v"]) >= LEAST_ASSIGNED, F.array(span)).otherwise(_none())
            else:
                kept = F.array(span)
            return F.struct(end.alias("p"), F.concat(t["a"], kept).alias("a"))

        def part(acc: Column, i: Column) -> Column:
            some = F.slice(z, F.shiftleft(i, PART) + 1, 1 << PART)
            begin = F.struct(acc["p"].alias("p"), _none().alias("a"))
            return F.aggregate(some, begin, one, lambda t: F.struct(t["p"].alias("p"), F.concat(acc["a"], F.array(t["a"])).alias("a")))

        parts = F.sequence(F.lit(0), F.shiftright(F.size(z) - 1, PART))
        return F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("p"), _none(f"array<{SPAN}>").alias("a")), part, lambda acc: acc["a"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start, then kind as listed."""
    return F.array_sort(F.concat(*[_spans(text, p, g, k) for k, (_, p, g) in enumerate(BASE)]))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def candidates(df: DataFrame, key: Column) -> DataFrame:
    """key, id, owner, repo, base and opaque spans of df(id, text, owner, repo), written once; opaque spans keep clear of base
    ones. A null text is empty, and so are a null owner and repository."""
    text, blank = F.coalesce("text", F.lit("")), lambda c: F.coalesce(c, F.lit("")).alias(c)
    x = df.select("id", text.alias("text"), blank("owner"), blank("repo"))
    x = x.select("id", key.alias("key"), "owner", "repo", base_spans(F.col("text")).alias("base"), _spans(F.col("text"), OPAQUE, 0, len(BASE)).alias("wide"))
    clear = F.filter("wide", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return stored(x.select("id", "key", "owner", "repo", "base", F.when(F.size("wide") > 0, clear).otherwise(_none()).alias("opaque")), "candidates")


def some(df: DataFrame) -> DataFrame:
    return df.where((F.size("base") > 0) | (F.size("opaque") > 0))


def ownership(found: DataFrame) -> DataFrame:
    """found(h, owner, repo) -> h, n_seen, n_owners, n_repos. Distinct triples first, so that a value
    copied everywhere is reduced before it is counted."""
    once = found.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = once.groupBy("h", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return by_owner.groupBy("h").agg(F.sum("n").alias("n_seen"), F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"))


def judged(found: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """candidates' rows -> key, live and shared spans, and the most owners and repositories of one of its values."""
    cand = some(found).select("key", "owner", "repo", F.explode(F.concat("base", "opaque")).alias("x")).withColumn("h", F.col("x.h"))
    freq = ownership(cand.select("h", "owner", "repo"))
    seen = salted_left_join(cand.select("key", "x", "h"), freq.select("h", "n_owners", "n_repos"), "h", "key")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    spans = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("x"))))
    counts = [F.max(c).alias(c) for c in ("n_owners", "n_repos")]
    return seen.groupBy("key").agg(spans(live).alias("live"), spans(~live).alias("shared"), *counts)


def repository(source: str = "source", lang: str = "lang") -> Column:
    """Documents name no repository: a source's texts in one language stand for one."""
    return F.concat_ws("/", F.coalesce(source, F.lit("")), F.coalesce(lang, F.lit("")))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text: str = "text", owner: Column | None = None, repo: Column | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """A row per row of df: id, n_assign, n_access, n_hex, base (spans), spans (base and believed opaque ones, as text), live
    and shared ones (text) by the corpus-wide counts of owners and repositories, and the most of either that one of the
    row's values has."""
    owner, repo = F.col("source") if owner is None else owner, repository() if repo is None else repo
    found = candidates(df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), owner.alias("owner"), repo.alias("repo")), F.monotonically_increasing_id())
    verdict = judged(found, max_owners, max_repos)
    clean = found.where((F.size("base") == 0) & (F.size("opaque") == 0)).select("id", "base")
    rows = some(found).select("id", "key", "base").join(verdict, "key", "left").drop("key").unionByName(clean, allowMissingColumns=True)
    live, shared = F.coalesce("live", _none()), F.coalesce("shared", _none())
    spans = F.array_sort(F.concat(F.col("base"), F.filter(live, lambda x: x["k"] >= len(BASE))))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return rows.select(
        F.col("id").alias(id_col), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.col("base"),
        joined(spans).alias("spans"), joined(live).alias("live_spans"), joined(shared).alias("shared_spans"), "n_owners", "n_repos",
    )


def mask_secrets(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """df with every live-looking credential replaced by [REDACTED]; all rows and columns stay, whatever they are called.
    What is live in a text depends on the text alone, so verdicts are joined by its hash; a bit map of fixed size lets
    texts without a live one past the shuffle. Copied examples stay."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(text).alias("text"))
    hashed = F.sha2(F.coalesce("text", F.lit("")), 256)
    found = candidates(df.select(F.lit(None).cast("long").alias("id"), F.col(text).alias("text"), F.col("source").alias("owner"), repository().alias("repo")), hashed)
    live = stored(judged(found, max_owners, max_repos).where(F.size("live") > 0).select("key", "live"), "live")
    whole = whole.withColumn("key", hashed).withColumn("_bm", bitmap(live.select("key")).scalar())
    marked = in_bitmap(F.col("_bm"), F.col("key"))
    hit = salted_left_join(whole.where(marked).select("_row", "text", "key"), live, "key", "_row")

    def step(acc: Column, x: Column) -> Column:
        piece = F.substring(F.col("text"), acc["p"] + 1, x["s"] - acc["p"])
        more = F.when(x["s"] >= acc["p"], F.array(piece, F.lit(REDACTED))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["p"], x["e"]).alias("p"), F.concat(acc["t"], more).alias("t"))

    begin = F.struct(F.lit(0).alias("p"), F.array().cast("array<string>").alias("t"))
    rest = lambda acc: F.concat(acc["t"], F.array(F.substring(F.col("text"), acc["p"] + 1, F.length("text"))))
    clean = F.array_join(F.aggregate("live", begin, step, rest), "")
    hit = hit.withColumn("text", F.when(F.col("live").isNotNull(), clean).otherwise(F.col("text")))
    changed = F.col("_row").withField(f"`{text}`", F.col("text"))
    if n_chars and n_chars in df.columns:
        length = F.when(F.col("live").isNotNull(), F.length("text").cast(df.schema[n_chars].dataType)).otherwise(F.col(f"_row.`{n_chars}`"))
        changed = changed.withField(f"`{n_chars}`", length)
    return whole.where(~marked).select("_row").unionByName(hit.select(changed.alias("_row"))).select("_row.*")
