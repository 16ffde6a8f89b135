"""RDFS entailment as closure-table joins over statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import closure

# The vocabulary's names.
TYPE, SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range"


def _closed(df: DataFrame, prop: str) -> DataFrame:
    edges = df.where(F.col("predicate") == prop).select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    return closure(edges, edges.select(F.col("src").alias("start")), True).select(F.col("start").alias("sub"), F.col("node").alias("sup"))


def entailed(df: DataFrame, classes: bool = True) -> DataFrame:
    """(subject, predicate, object, objecttype) of df and what follows by subproperty, domain, range and subclass."""
    base = df.select("subject", "predicate", "object", "objecttype").distinct()
    props = base.join(_closed(df, SUB_PROPERTY), F.col("predicate") == F.col("sub")).select("subject", F.col("sup").alias("predicate"), "object", "objecttype")
    rows = base.union(props).distinct()
    if not classes:
        return rows
    say = lambda p: df.where(F.col("predicate") == p).select(F.col("subject").alias("p"), F.col("object").alias("c"))
    typed = lambda x, s: x.select(F.col(s).alias("subject"), F.lit(TYPE).alias("predicate"), F.col("c").alias("object"), F.lit("R").alias("objecttype"))
    rows = rows.union(typed(rows.join(say(DOMAIN), F.col("predicate") == F.col("p")), "subject")).union(typed(rows.where("objecttype = 'R'").join(say(RANGE), F.col("predicate") == F.col("p")), "object")).distinct()
    up = rows.where(F.col("predicate") == TYPE).join(_closed(df, SUB_CLASS), F.col("object") == F.col("sub")).select("subject", "predicate", F.col("sup").alias("object"), "objecttype")
    return rows.union(up).distinct()
