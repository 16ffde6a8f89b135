"""Changes to statements as set operations: each returns the new statements. History and merges over a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.statements import EMBEDDED, SCHEMA, VALUE
from ..sources.tables import stored
from .closure import closure

KEYS = [*VALUE, "context"]
LOG = "rev long, op string, " + SCHEMA + ", ts timestamp, author string, comment string"


def add(df: DataFrame, new: DataFrame) -> DataFrame:
    return df.unionByName(new.dropDuplicates(KEYS).join(df, KEYS, "left_anti"))


def create(df: DataFrame, new: DataFrame) -> DataFrame:
    """add, but an error if one of the objects is there."""
    there = new.select("subject").distinct().join(df.select("subject"), "subject", "left_semi").limit(1).collect()
    if there:
        raise ValueError(f"object {there[0].subject} already exists")
    return add(df, new)


def embedded_under(df: DataFrame, subjects: DataFrame) -> DataFrame:
    """Anonymous objects that live inside the subjects, at any depth."""
    edges = df.where((F.col("objecttype") == "R") & F.col("object").startswith(EMBEDDED)).select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    return closure(edges, subjects.select(F.col("subject").alias("start")), True).select(F.col("node").alias("subject")).distinct()


def remove(df: DataFrame, objects: DataFrame | None = None, props: DataFrame | None = None, values: DataFrame | None = None, cascade: bool = False) -> DataFrame:
    """Without whole objects (subject), all values of properties (subject, predicate), and single values (VALUE)."""
    if objects is not None:
        gone = objects.select("subject").distinct()
        if cascade:
            gone = gone.union(embedded_under(df, gone)).distinct()
        df = df.join(gone, "subject", "left_anti")
    if props is not None:
        df = df.join(props.select("subject", "predicate").distinct(), ["subject", "predicate"], "left_anti")
    return df.join(values.select(*VALUE).distinct(), VALUE, "left_anti") if values is not None else df


def _embedded_places(df: DataFrame) -> DataFrame:
    """subject, predicate, n, object: the embedded objects of each property, numbered by their place."""
    x = df.where((F.col("objecttype") == "R") & F.col("object").startswith(EMBEDDED)).select("subject", "predicate", "object", F.explode_outer("listpos").alias("pos"))
    w = Window.partitionBy("subject", "predicate").orderBy(F.col("pos").asc_nulls_first(), "object")
    return x.withColumn("n", F.row_number().over(w)).drop("pos")


def keep_identity(df: DataFrame, new: DataFrame) -> DataFrame:
    """new, whose embedded objects have the ids of those that stand at the same place of the same property in df, level by
    level."""
    while not (places := _embedded_places(new)).isEmpty():
        old = _embedded_places(df).withColumnRenamed("object", "kept")
        names = places.join(old, ["subject", "predicate", "n"]).where("object <> kept").groupBy(F.col("object").alias("made")).agg(F.min("kept").alias("kept"))
        names = stored(names)
        if names.isEmpty():
            break
        for c in ("subject", "object"):
            hit = new.join(names, (F.col(c) == F.col("made")) & (F.lit(c == "subject") | (F.col("objecttype") == "R")), "left")
            new = hit.withColumn(c, F.coalesce("kept", c)).drop("made", "kept")
        new = stored(new)
    return new


def update(df: DataFrame, new: DataFrame) -> DataFrame:
    """The values of each (subject, property) of new replace those that are there; embedded objects that are replaced keep their
    ids and lose what they held."""
    new = keep_identity(df, new)
    heads = df.where((F.col("objecttype") == "R") & F.col("object").startswith(EMBEDDED)).join(new.select("subject", "predicate").distinct(), ["subject", "predicate"], "left_semi")
    heads = heads.select(F.col("object").alias("subject")).distinct()
    if not heads.isEmpty():
        df = remove(df, objects=heads.union(embedded_under(df, heads)))
    return add(remove(df, props=new), new)


def replace(df: DataFrame, new: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Each subject of new (and of ids, which may have no statements left) is replaced as a whole; embedded objects keep their
    ids."""
    new = keep_identity(df, new)
    subjects = new.select("subject") if ids is None else new.select("subject").union(ids.select("subject"))
    return add(remove(df, objects=subjects), new)


def update_all(df: DataFrame, updated: DataFrame | None = None, replaced: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    df = replace(df, replaced) if replaced is not None else df
    df = update(df, updated) if updated is not None else df
    return remove(df, objects=removed) if removed is not None else df


class Triggers:
    """Callbacks around changes, by event: before-new (subjects that weren't there), before-add and before-remove
    (statements), before-change (old, new), before-commit (version), finalize-commit, after-commit, after-abort. One that
    comes before may refuse by raising, and nothing has changed then."""

    def __init__(self):
        self.calls: dict[str, list] = {}

    def on(self, event: str, call) -> None:
        self.calls.setdefault(event, []).append(call)

    def fire(self, event: str, *args) -> None:
        for call in self.calls.get(event, []):
            call(*args)


class Transaction:
    """Two-phase commit over participants (ready, commit, abort): all commit if all are ready, each asked ``retries`` times more,
    else all abort."""

    def __init__(self, triggers: Triggers | None = None, retries: int = 3):
        self.triggers, self.retries, self.participants = triggers or Triggers(), retries, []

    def join(self, participant) -> None:
        if participant not in self.participants:
            self.participants.append(participant)

    def commit(self) -> None:
        try:
            self.triggers.fire("before-commit", self)
            for p in self.participants:
                if not any(p.ready() for _ in range(self.retries + 1)):
                    raise RuntimeError(f"{p} is not ready to commit")
        except Exception:
            self.abort()
            raise
        self.triggers.fire("finalize-commit", self)
        for p in self.participants:
            p.commit()
        self.triggers.fire("after-commit", self)

    def abort(self) -> None:
        for p in self.participants:
            p.abort()
        self.triggers.fire("after-abort", self)


class Pending:
    """A store's change that is written and not yet visible: a participant of a transaction."""

    def __init__(self, store: Store, version: int):
        self.store, self.version = store, version

    def ready(self) -> bool:
        return self.store.version() == self.version - 1

    def commit(self) -> None:
        self.store._point(self.version)

    def abort(self) -> None:
        """Nothing points to what was written; the next version writes over it."""


class Store:
    """A folder of versions: each is its changes (``log-N``), every SNAPSHOT-th also a whole table (``data-N``). A commit
    writes them and then moves the pointer, so readers see one version or the other; a refused or failed transaction leaves
    the pointer where it was. The changes are the history: (rev, op, statement, ts, author, comment)."""

    SNAPSHOT = 16

    def __init__(self, spark, folder: str, triggers: Triggers | None = None):
        self.spark, self.folder, self.triggers = spark, folder.rstrip("/"), triggers or Triggers()

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        fs, path = self._fs()
        at = path(self.folder)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return max([int(n[7:]) for n in names if n.startswith("commit-")], default=-1)

    def log(self, last: int | None = None, first: int = 0) -> DataFrame:
        """The changes of the versions from first to last."""
        last = self.version() if last is None else last
        if last < first:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[f"{self.folder}/log-{v}" for v in range(first, last + 1)])

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v < 0:
            return self.spark.createDataFrame([], SCHEMA)
        at = v - v % self.SNAPSHOT
        base = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/data-{at}")
        if at == v:
            return base
        last = self.log(v, at + 1).groupBy(*KEYS).agg(F.max_by("op", "rev").alias("op"), F.max_by("listpos", "rev").alias("listpos"))
        return base.join(last.select(*KEYS), KEYS, "left_anti").unionByName(last.where("op = 'add'").drop("op")).select(*base.columns)

    def begin(self, change, author: str | None = None, comment: str | None = None) -> Pending:
        """change: statements to statements. Writes the next version, for a transaction to commit."""
        old, v = self.read(), self.version() + 1
        new = stored(change(old).select(*old.columns))
        self.triggers.fire("before-change", old, new)
        same = [*KEYS, "listpos"]
        added, removed = (x.join(y, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in same], "left_anti") for x, y in ((new.alias("x"), old.alias("y")), (old.alias("x"), new.alias("y"))))
        if "before-new" in self.triggers.calls:
            self.triggers.fire("before-new", added.select("subject").distinct().join(old.select("subject"), "subject", "left_anti"))
        self.triggers.fire("before-add", added)
        self.triggers.fire("before-remove", removed)
        # a statement whose list places changed is added anew
        removed = removed.join(new.select(*KEYS), KEYS, "left_anti")
        rows = added.withColumn("op", F.lit("add")).unionByName(removed.withColumn("op", F.lit("remove")))
        rows = rows.withColumns({"rev": F.lit(v).cast("long"), "ts": F.current_timestamp(), "author": F.lit(author).cast("string"), "comment": F.lit(comment).cast("string")})
        rows.select(*[f.split()[0] for f in LOG.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/log-{v}")
        if v % self.SNAPSHOT == 0:
            new.write.mode("overwrite").parquet(f"{self.folder}/data-{v}")
        return Pending(self, v)

    def _point(self, v: int) -> None:
        fs, path = self._fs()
        if not fs.createNewFile(path(f"{self.folder}/commit-{v}")):
            raise RuntimeError(f"version {v} was committed by another writer")

    def commit(self, change, author: str | None = None, comment: str | None = None) -> int:
        """begin() and commit. Votes (before-commit) come when the version is written."""
        pending = self.begin(change, author, comment)
        v = pending.version
        try:
            self.triggers.fire("before-commit", v)
        except Exception:
            self.triggers.fire("after-abort", v)
            raise
        self.triggers.fire("finalize-commit", v)
        pending.commit()
        self.triggers.fire("after-commit", v)
        return v


# History: a change log (rev, op, VALUE.., context, ts, author, comment)


def as_of(log: DataFrame, rev: int | None = None, keys: list[str] | None = None, context: str | None = None) -> DataFrame:
    """Statements visible after revision rev, or those of one context: per statement the last change decides."""
    keys = keys or VALUE
    log = log if rev is None else log.where(F.col("rev") <= rev)
    log = log if context is None else log.where(F.col("context") == context)
    last = log.groupBy(*keys).agg(F.max_by("op", "rev").alias("op"), F.max("rev").alias("rev"))
    return last.where("op = 'add'").drop("op")


def last_transaction(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last transaction that added each of keys' values, with its time, author and comment where the log has them."""
    extra = [c for c in ("ts", "author", "comment") if c in log.columns]
    return log.where("op = 'add'").groupBy(*keys).agg(F.max("rev").alias("txn"), *[F.max_by(c, "rev").alias(c) for c in extra])


def revisions(log: DataFrame, subject: str | None = None) -> DataFrame:
    """(subject, revs): the revisions that changed each subject, or one, in order."""
    log = log if subject is None else log.where(F.col("subject") == subject)
    return log.groupBy("subject").agg(F.array_sort(F.collect_set("rev")).alias("revs"))


def modified_after(log: DataFrame, rev: int) -> DataFrame:
    """Subjects changed after rev, with their last revision."""
    return log.where(F.col("rev") > rev).groupBy("subject").agg(F.max("rev").alias("last_rev"))


def with_anonymous(df: DataFrame, subjects: DataFrame) -> DataFrame:
    """The subjects, and the anonymous objects that hang together with them, by references from or to anonymous objects."""
    down = df.where((F.col("objecttype") == "R") & (F.col("object").startswith("_:"))).select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    both = down.union(down.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return closure(both, subjects.select(F.col("subject").alias("start"))).select(F.col("node").alias("subject")).distinct()


def conflicts(mine: DataFrame, theirs: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """Subjects that both sets of changes touch; with df, also through anonymous objects of theirs."""
    a, b = (x.select("subject").distinct() for x in (mine, theirs))
    if df is not None:
        a, b = with_anonymous(df, a), with_anonymous(df, b)
    return a.join(b, "subject", "left_semi")


def merge(log: DataFrame, changes: DataFrame, base: int, df: DataFrame | None = None) -> DataFrame:
    """changes, made on revision base, after the log's later ones, in their order; an error where both touch a subject."""
    clash = conflicts(log.where(F.col("rev") > base), changes, df).limit(1).collect()
    if clash:
        raise ValueError(f"both sides changed {clash[0].subject}")
    top = log.agg(F.coalesce(F.max("rev"), F.lit(0))).first()[0]
    first = changes.agg(F.coalesce(F.min("rev"), F.lit(0))).first()[0]
    return log.unionByName(changes.withColumn("rev", F.col("rev") - first + top + 1))


# Branch revisions: '0A00001,0B00002'


def parts(rev: str) -> dict[str, int]:
    return {p[1] if p[0].isdigit() else p[0]: int(p[2:] if p[0].isdigit() else p[1:]) for p in rev.split(",") if p}


def text(rev: dict[str, int]) -> str:
    return ",".join(f"0{b}{n:05d}" for b, n in sorted(rev.items()))


def increment(rev: str, branch: str) -> str:
    x = parts(rev)
    return text(x | {branch: x.get(branch, 0) + 1})


def merged(a: str, b: str) -> str:
    x, y = parts(a), parts(b)
    return text({k: max(x.get(k, 0), y.get(k, 0)) for k in x | y})


def compare(a: str, b: str) -> int | None:
    """-1, 0, 1, or None where neither holds the other."""
    x, y = parts(a), parts(b)
    less = all(n <= y.get(k, 0) for k, n in x.items())
    more = all(n <= x.get(k, 0) for k, n in y.items())
    return 0 if less and more else -1 if less else 1 if more else None
