"""Files of statements: N-Triples and JSON lines read line by line in order, JSON documents file by file; and their writers.

A line's place is (file, block, position in the block), as Spark's splits are; what a line means may depend on the lines
before it (directives), which are looked up within the block and, for its first lines, at the end of the block before.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .statements import COLUMNS, EMBEDDED, SCHEMA, VALUE, from_json, quoted, to_objects

# Extensions and the formats that they stand for; the multipart format's first line and reference key.
EXTENSIONS = {".nt": "ntriples", ".nj": "ntjson", ".json": "json", ".jsonl": "jsonl", ".mjson": "mjson", ".yaml": "yaml", ".rj": "rdfjson"}
MULTIPART, BLOB = "=multipart-json", "multipartjsonref"
_LINE = re.compile(r"\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|\"(?:\\.|[^\"\\])*\")(?:@([\w-]+)|\^\^<?([^>\s]*)>?)?\s*\.?\s*$")
LOG = "line long, op string, subject string, predicate string, object string, objecttype string, context string"


def sniff(path: str) -> str:
    """The format by the path's extension; N-Triples without a known one."""
    return next((f for x, f in EXTENSIONS.items() if path.rstrip("/").endswith(x)), "ntriples")


# Lines


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, block, pos, line of text files: lines of a block are in the order of pos, blocks in that of block."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(F.col("value").alias("line"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"))
    return lines.withColumn("pos", F.monotonically_increasing_id())


def _directive(line: Column) -> Column:
    """A directive's kind and context, 'end' for a statement or a comment, null for a blank line."""
    word = F.trim(F.regexp_extract(line, r"^\s*#!(?:remove|graph)\s*(\S*)", 1))
    return (
        F.when(F.trim(line) == "", None)
        .when(line.rlike(r"^\s*#!remove\b"), F.concat(F.lit("remove "), word))
        .when(line.rlike(r"^\s*#!graph\b"), F.concat(F.lit("graph "), word))
        .otherwise("end")
    )


def directed(lines: DataFrame) -> DataFrame:
    """Statements' lines with op and context: '#!remove' and '#!graph ctx' hold for the next statement; other comments end them."""
    x = lines.where(F.trim("line") != "").withColumn("kind", _directive(F.col("line")))
    w = Window.partitionBy("file", "block").orderBy("pos")
    x = x.withColumns({"k1": F.lag("kind").over(w), "k2": F.lag("kind", 2).over(w), "n": F.row_number().over(w)})
    # the last two lines of each block, for the first two of the next
    ends = x.groupBy("file", "block").agg(F.max_by(F.struct("kind", "k1"), "pos").alias("end"))
    ends = ends.withColumn("before", F.lag("end").over(Window.partitionBy("file").orderBy("block"))).select("file", "block", "before")
    first = x.where("n <= 2").join(ends, ["file", "block"])
    k1 = F.when(F.col("n") == 1, F.col("before.kind")).otherwise(F.col("k1"))
    k2 = F.when(F.col("n") == 1, F.col("before.k1")).otherwise(F.col("before.kind"))
    first = first.withColumns({"k1": k1, "k2": k2}).drop("before")
    x = x.where("n > 2").unionByName(first).where(~F.trim("line").startswith("#"))
    told = lambda what: F.coalesce(F.when(F.col("k1").startswith(what), F.col("k1")), F.when((F.col("k1") != "end") & F.col("k2").startswith(what), F.col("k2")))
    op = F.when(told("remove ").isNotNull(), "remove").otherwise("add")
    return x.select("file", "block", "pos", "line", op.alias("op"), F.coalesce(F.substring(told("graph "), 7, 1 << 20), F.lit("")).alias("context"))


def _bare(x: str) -> str:
    return x[1:-1] if x[0] == "<" else x


def parsed(line: str) -> tuple[str, str, str, str]:
    """(subject, predicate, object, objecttype) of an N-Triples line, or of an object {id, predicate: value}."""
    if line.lstrip().startswith("{"):
        x = json.loads(line)
        ((p, v),) = [(k, v) for k, v in x.items() if k != "id"]
        return x["id"], p, *_rdf_value(v)
    m = _LINE.match(line)
    if not m:
        raise ValueError(f"no statement: {line[:80]!r}")
    s, p, o, lang, kind = m.groups()
    if o[0] == '"':
        return _bare(s), p, json.loads(o, strict=False), lang or kind or "L"
    return _bare(s), p, _bare(o), "R"


def _rdf_value(v: dict) -> tuple[str, str]:
    kind = v["type"]
    if kind in ("uri", "bnode"):
        return ("_:" * (kind == "bnode" and not v["value"].startswith("_:"))) + v["value"], "R"
    return v["value"], v.get("xml:lang") or v.get("datatype") or "L"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """file, block, pos, op and the statement of each line of N-Triples or JSON statements."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [parsed(x) for x in b.column("line").to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            cols = [pa.array(c, pa.string()) for c in cols]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("file", "block", "pos", "op")] + cols + [b.column("context")], names=["file", "block", "pos", "op", *COLUMNS[:5]])

    return directed(numbered(spark, path)).mapInArrow(run, "file string, block long, pos long, op string, " + ", ".join(f"{c} string" for c in COLUMNS[:5]))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Statements after the adds and removes of the files, each in its lines' order, files by name; contexts don't matter to
    a removal."""
    at = F.struct("file", "block", "pos")
    last = read_log(spark, path).groupBy(*VALUE).agg(F.max_by("op", at).alias("op"), F.max_by("context", at).alias("context"))
    return last.where("op = 'add'").select(*VALUE, "context", F.lit(None).cast("array<int>").alias("listpos"))


# Documents


def _once(df: DataFrame) -> DataFrame:
    return df.groupBy(*COLUMNS[:5]).agg(F.first("listpos", ignorenulls=True).alias("listpos")).select(*COLUMNS)


def _statements(df: DataFrame, objects_of) -> DataFrame:
    """df(name, text) -> the statements of objects_of(text); ids of objects without one begin with the text's name."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [r for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in objects_of(text, name)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string()] * 5 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=COLUMNS)

    return _once(df.mapInArrow(run, SCHEMA))


def read_jsonl(spark: SparkSession, path: str, names: dict | None = None) -> DataFrame:
    """A JSON object per line, read in parallel within files."""
    x = numbered(spark, path).where(F.trim("line") != "")
    name = F.concat_ws(".", F.substring(F.md5("file"), 1, 8), F.hex("block"), F.hex("pos"))
    return _statements(x.select(name.alias("name"), "line"), lambda text, at: from_json(json.loads(text), names=names, prefix=at))


def _documents(spark: SparkSession, path: str, load, names: dict | None = None) -> DataFrame:
    """A document per file."""
    x = spark.read.text(path, wholetext=True).select(F.substring(F.md5(F.col("_metadata.file_path")), 1, 8).alias("name"), "value")
    return _statements(x, lambda text, at: from_json(load(text), names=names, prefix=at))


def read_json(spark: SparkSession, path: str, names: dict | None = None) -> DataFrame:
    return _documents(spark, path, json.loads, names)


def read_mjson(spark: SparkSession, path: str, names: dict | None = None) -> DataFrame:
    return _documents(spark, path, loads, names)


def read_yaml(spark: SparkSession, path: str, names: dict | None = None) -> DataFrame:
    """Needs the yaml package."""
    import yaml

    return _documents(spark, path, yaml.safe_load, names)


def read_rdfjson(spark: SparkSession, path: str) -> DataFrame:
    """{subject: {predicate: [value, ..]}}, or that for each context beside 'quads'."""

    def rows(text, _):
        x = json.loads(text)
        graphs = {k: v for k, v in x.items() if k != "quads"} if "quads" in x else {"": x}
        for ctx, subjects in graphs.items():
            for s, props in subjects.items():
                if s != "triples":
                    for p, values in props.items():
                        for i, v in enumerate(values):
                            yield s, (f"rdf:_{i + 1}" if p == "#member" else p), *_rdf_value(v), ctx, None

    x = spark.read.text(path, wholetext=True).select(F.lit("").alias("name"), "value")
    return _statements(x, rows)


# Multipart JSON: JSON values and blocks of text ('= id marker', lines, 'marker') that {"multipartjsonref": id} stands for


def loads(text: str) -> list:
    """The JSON values, with the texts in their places."""
    decoder, values, blobs, at = json.JSONDecoder(), [], {}, 0
    while at < len(text):
        if text[at].isspace():
            at += 1
        elif text.startswith(MULTIPART, at):
            at += len(MULTIPART)
        elif text[at] == "=":
            head, _, rest = text[at:].partition("\n")
            _, name, marker = head.split()
            body, found, _ = rest.partition("\n" + marker)
            if not found:
                raise ValueError(f"text {name!r} has no end")
            blobs[name], at = body, at + len(head) + 1 + len(body) + 1 + len(marker)
        else:
            value, at = decoder.raw_decode(text, at)
            values.append(value)

    def filled(x):
        if isinstance(x, dict):
            return blobs[x[BLOB]] if set(x) == {BLOB} else {k: filled(v) for k, v in x.items()}
        return [filled(v) for v in x] if isinstance(x, list) else x

    return [filled(x) for x in values]


def dumps(values: list, most: int = 1024, least: int = 30) -> str:
    """Multipart JSON: texts of over ``most`` characters, and those of several lines and over ``least``, as blocks."""
    out, blobs = [MULTIPART], {}

    def cut(x):
        if isinstance(x, dict):
            return {k: cut(v) for k, v in x.items()}
        if isinstance(x, list):
            return [cut(v) for v in x]
        if isinstance(x, str) and len(x) > least and (len(x) > most or "\n" in x):
            blobs[str(len(blobs) + 1)] = x
            return {BLOB: str(len(blobs))}
        return x

    for value in values:
        seen = len(blobs)
        out.append(json.dumps(cut(value)))
        for name in list(blobs)[seen:]:
            marker = next(m for n in range(3, 1000) for m in (c * n for c in "=!@#$%^&*()+") if m not in blobs[name])
            out.append(f"= {name} {marker}\n{blobs[name]}\n{marker}")
    return "\n".join(out) + "\n"


# Writers


def _directives(df: DataFrame, line: Column) -> Column:
    """The line after its context's directive and, where df has changes (``op``), after that of a removal."""
    line = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("#!graph "), "context", F.lit("\n"), line)).otherwise(line)
    return F.when(F.col("op") == "remove", F.concat(F.lit("#!remove\n"), line)).otherwise(line) if "op" in df.columns else line


def write_ntriples(df: DataFrame, path: str) -> None:
    name = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    kind = F.col("objecttype")
    tail = F.when(kind == "L", "").when(kind.rlike("^[a-z]{2}(-[A-Za-z]+)?$"), F.concat(F.lit("@"), kind)).otherwise(F.concat(F.lit("^^<"), kind, F.lit(">")))
    obj = F.when(kind == "R", name("object")).otherwise(F.concat(quoted(F.col("object")), tail))
    df.select(_directives(df, F.concat(name("subject"), F.lit(" <"), "predicate", F.lit("> "), obj, F.lit(" .")))).write.mode("overwrite").text(path)


def write_ntjson(df: DataFrame, path: str) -> None:
    """A JSON object {id, predicate: value} per statement."""
    kind, o = F.col("objecttype"), quoted(F.col("object"))
    field = lambda **x: F.concat(F.lit("{"), *[y for i, (k, v) in enumerate(x.items()) for y in (F.lit(("," if i else "") + f'"{k.replace("_", ":")}":'), v)], F.lit("}"))
    ref = field(type=F.when(F.col("object").startswith("_:"), F.lit('"bnode"')).otherwise(F.lit('"uri"')), value=o)
    lang = kind.rlike("^[a-z]{2}(-[A-Za-z]+)?$")
    value = F.when(kind == "R", ref).when(kind == "L", field(type=F.lit('"literal"'), value=o)).when(lang, field(type=F.lit('"literal"'), xml_lang=quoted(kind), value=o))
    value = value.otherwise(field(type=F.lit('"typed-literal"'), datatype=quoted(kind), value=o))
    line = F.concat(F.lit('{"id":'), quoted(F.col("subject")), F.lit(","), quoted(F.col("predicate")), F.lit(":"), value, F.lit("}"))
    df.select(_directives(df, line)).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object per line; objects referred to once stand in their place."""
    to_objects(df, inline=True).select("object").write.mode("overwrite").text(path)


def _by_part(df: DataFrame, path: str, dump) -> None:
    """The objects of each partition as one document."""

    def run(batches):
        import pyarrow as pa

        objects = [json.loads(x) for b in batches for x in b.column(0).to_pylist()]
        if objects:
            yield pa.RecordBatch.from_pydict({"value": [dump(objects).rstrip("\n")]})

    to_objects(df, inline=True).select("object").mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    _by_part(df, path, json.dumps)


def write_mjson(df: DataFrame, path: str) -> None:
    _by_part(df, path, dumps)


def write_yaml(df: DataFrame, path: str) -> None:
    """Needs the yaml package."""
    import yaml

    _by_part(df, path, yaml.safe_dump)


READERS = {"ntriples": read_ntriples, "ntjson": read_ntriples, "json": read_json, "jsonl": read_jsonl, "mjson": read_mjson, "yaml": read_yaml, "rdfjson": read_rdfjson}
WRITERS = {"ntriples": write_ntriples, "ntjson": write_ntjson, "json": write_json, "jsonl": write_jsonl, "mjson": write_mjson, "yaml": write_yaml}


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Statements of a file or folder, of the given format or that of its extension."""
    return READERS[kind or sniff(path)](spark, path)


def write(df: DataFrame, path: str, kind: str | None = None) -> None:
    WRITERS[kind or sniff(path)](df, path)


def copy(spark: SparkSession, source: str, target: str, source_kind: str | None = None, target_kind: str | None = None) -> None:
    """One format to another."""
    write(read(spark, source, source_kind), target, target_kind)


__all__ = ["EMBEDDED", "copy", "dumps", "loads", "read", "read_log", "sniff", "write"]
