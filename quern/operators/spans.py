"""Spans of texts: union, gaps and overlaps by a sweep, and what lies inside spans by bins, without a pair per token and span."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places of a bin; a span of a union is joined once for each bin that it touches.
BIN = 1024
#: Spans that a task sorts, about.
SORT_ROWS = 500_000
#: Terms that may be sent to the tasks that look for them.
MOST_TERMS = 100_000


def union(spans: DataFrame, by: str) -> DataFrame:
    """(`by`, lo, hi) spans, half open, to the disjoint spans of their union; touching ones become one. Empty spans and nulls are left out."""
    rows = spans.select(by, F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).filter("lo < hi")
    order = Window.partitionBy(by).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = rows.withColumn("_new", F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0))
    numbered = begins.withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(by, "_n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_n")


def coverage_faults(spans: DataFrame, texts: DataFrame, by: str) -> DataFrame:
    """Spans (`by`, lo, hi) against texts (`by`, length): (`by`, lo, hi, fault), where they don't cover each text once, in order.

    Faults: inverted (hi is not beyond lo, or a bound is null), outside (below 0 or beyond the length), unknown (of no text), gap (lo to hi is
    in no span), overlap (lo to hi is in an earlier span as well), uncovered (a text without any span). A text of
    length 0 needs none. Inverted and unknown spans cover nothing.
    """
    length = texts.select(F.col(by).alias("_by"), F.col("length").cast("long").alias("length"))
    rows = spans.select(by, F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    # a task's sort holds SORT_ROWS spans or so, whatever their number; one sort serves the join and the window
    tasks = max(-(-rows.count() // SORT_ROWS), 1)
    if tasks > int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        length, spread = length.repartition(tasks, "_by"), rows.repartition(tasks, by)
    else:
        spread = rows.repartition(by)
    dealt = spread.sortWithinPartitions(by, "lo", "hi").join(length, F.col(by) == F.col("_by"), "left")
    bad = F.when(F.col("_by").isNull(), "unknown").when(~F.coalesce(F.col("hi") > F.col("lo"), F.lit(False)), "inverted").when((F.col("lo") < 0) | (F.col("hi") > F.col("length")), "outside")
    dealt = dealt.withColumn("fault", bad)
    good = F.col("fault").isNull() | (F.col("fault") == "outside")
    before = Window.partitionBy(by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    ended = dealt.withColumn("_end", F.coalesce(F.max(F.when(good, F.col("hi"))).over(before), F.lit(0)))
    lo, hi, end = F.col("lo"), F.col("hi"), F.col("_end")
    piece = lambda when, lo, hi, fault: F.when(when, F.struct(lo.alias("lo"), hi.alias("hi"), fault.alias("fault")))
    own = [piece(F.col("fault").isNotNull(), lo, hi, F.col("fault")), piece(good & (lo > end), end, lo, F.lit("gap")), piece(good & (lo < end) & (lo >= 0), lo, F.least(hi, end), F.lit("overlap"))]
    found = ended.select(by, F.explode(F.array_compact(F.array(*own))).alias("_f")).select(by, "_f.*")
    last = spread.groupBy(by).agg(F.max(F.when(hi > lo, hi)).alias("_last")).select(F.col(by).alias("_own"), "_last")
    tails = length.filter("length > 0").join(last, F.col("_by") == F.col("_own"), "left")
    tails = tails.filter("_last IS NULL OR _last < length").select(F.col("_by").alias(by), F.coalesce("_last", F.lit(0)).alias("lo"), F.col("length").alias("hi"), F.when(F.col("_last").isNull(), "uncovered").otherwise("gap").alias("fault"))
    return found.unionByName(tails)


def outside(points: DataFrame, spans: DataFrame, by: str, at: str = "at") -> DataFrame:
    """Rows of `points` (`by`, `at`, ...) whose place is in no span (`by`, lo, hi).

    Spans are made disjoint and cut at bins, at most one piece for each bin of a text and each span, and meet points by
    (text, bin): a text of any length is dealt over tasks, and a bin's few spans are all that a point is held against.
    """
    whole = union(spans, by)
    pieces = whole.select(F.col(by).alias("_by"), "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor((F.col("hi") - 1) / BIN))).alias("_bin"))
    placed = points.withColumn("_at_bin", F.floor(F.col(at) / BIN))
    inside = (F.col(by) == F.col("_by")) & (F.col("_at_bin") == F.col("_bin")) & (F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))
    return placed.join(pieces, inside, "left_anti").drop("_at_bin")


#: An identifier.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def term_uses(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, term, at, line, col) of every identifier of a text that is one of the terms: place from 0, line and column from 1.

    Terms are counted first; over MOST_TERMS is an error. Only uses leave the task that reads a text.
    """
    found = [r.term for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(found) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms")
    wanted, kind = docs.sparkSession.sparkContext.broadcast(frozenset(found)), docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, pattern = wanted.value, re.compile(IDENTIFIER)
        for batch in batches:
            rows, said, places, lines, columns = [], [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                line, begins, seen = 1, 0, 0
                for m in pattern.finditer(t or ""):
                    if m[0] not in names:
                        continue
                    at = m.start()
                    line += t.count("\n", seen, at)
                    begins = t.rfind("\n", 0, at) + 1 if t.find("\n", seen, at) >= 0 else begins
                    seen = at
                    rows.append(k), said.append(m[0]), places.append(at), lines.append(line), columns.append(at - begins + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(said, pa.string()), *(pa.array(x, pa.int64()) for x in (places, lines, columns))], names=[key, "term", "at", "line", "col"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(scan, f"`{key}` {kind}, term string, at long, line long, col long")


def deprecated_uses(docs: DataFrame, key: str, text: str, terms: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """Uses of deprecated terms, without those that begin inside an exempt span (`key`, lo, hi)."""
    uses = term_uses(docs, key, text, terms)
    return uses if exempt is None else outside(uses, exempt, key)


def deprecated_columns(columns: DataFrame, terms: DataFrame) -> DataFrame:
    """(table, column) names to (table, column, term): names that are a deprecated term, or have one as a part between underscores."""
    parts = columns.select("table", "column", F.explode(F.array_distinct(F.concat(F.array("column"), F.split("column", "_")))).alias("term"))
    return parts.join(terms.select("term").distinct(), "term", "left_semi").select("table", "column", "term")
