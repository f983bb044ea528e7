"""Answers: evidence case sets, facet coverage, propositions, excerpts with traces, packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def case_set(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim (claim_id, text, evidence_ids) with its citations' quotes and sources, in order of evidence id."""
    each = claims.select("claim_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    cited = each.join(citations, "evidence_id").join(evidence.select("evidence_id", F.col("text").alias("_e")), "evidence_id")
    cited = cited.withColumn("exact", F.contains("_e", "quote"))
    per = cited.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "source_id", "quote", "exact"))).alias("cases"))
    return claims.join(per, "claim_id", "left").withColumn("complete", F.size("cases") >= F.size("evidence_ids"))


def facet_coverage(required: DataFrame, answered: DataFrame) -> DataFrame:
    """(task, facet) required against answered: counts, whole basis points, and covered, partial or missing."""
    marked = required.join(answered.select("task", "facet").distinct().withColumn("_a", F.lit(1)), ["task", "facet"], "left")
    per = marked.groupBy("task").agg(F.count(F.lit(1)).alias("required"), F.count("_a").alias("covered"))
    points = F.floor(F.col("covered") * 10000 / F.col("required")).cast("long")
    return per.select("task", "required", "covered", points.alias("basis_points"), F.when(F.col("covered") == F.col("required"), "covered").when(F.col("covered") > 0, "partial").otherwise("missing").alias("decision"))


def segments(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, text) and ordered, disjoint (id, start, end, kind) to all parts of the text: the spans and the plain parts between."""
    by = Window.partitionBy("id").orderBy("start")
    placed = spans.withColumn("_from", F.coalesce(F.lag("end").over(by), F.lit(0))).withColumn("_last", F.lead("start").over(by).isNull())
    whole = placed.join(texts.select("id", F.length("text").alias("_n")), "id")
    gaps = whole.select("id", F.col("_from").alias("start"), F.col("start").alias("end"), F.lit("plain").alias("kind"))
    tail = whole.filter("_last").select("id", F.col("end").alias("start"), F.col("_n").alias("end"), F.lit("plain").alias("kind"))
    bare = texts.join(spans.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("plain").alias("kind"))
    every = gaps.unionByName(tail).unionByName(bare).unionByName(spans.select("id", "start", "end", "kind")).filter("end > start")
    return every.join(texts, "id").select("id", "start", "end", "kind", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("part"))


def clip(text: Column, most: int = 900) -> Column:
    """At most `most` characters, cut with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def redact(path: Column) -> Column:
    """The last part of a path or locator, for display."""
    return F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)


#: Deprecated names that go to every task.
MOST_TERMS = 10_000


def terms_used(texts: DataFrame, deprecated: DataFrame) -> DataFrame:
    """(id, text) against (term, replacement): line and column, from 1, of each place of a deprecated identifier.

    A line is cut into identifiers and what lies between them, so a place is the sum of the lengths before it. The
    deprecated names are counted first: over MOST_TERMS is an error.
    """
    if deprecated.select("term").distinct().limit(MOST_TERMS + 1).count() > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} deprecated terms")
    terms = deprecated.agg(F.collect_set("term").alias("_terms"))  # a list of names to avoid: one row
    lines = texts.select("id", F.posexplode_outer(F.split("text", "\n")).alias("line", "content")).crossJoin(F.broadcast(terms))
    parts = F.regexp_extract_all("content", F.lit(r"([A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+)"), F.lit(1))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<column:int,term:string>>").alias("found"))
    step = lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.when(F.array_contains("_terms", x), F.concat(s["found"], F.array(F.struct(s["at"].alias("column"), x.alias("term"))))).otherwise(s["found"]).alias("found"))
    places = lines.select("id", "line", F.explode(F.aggregate(parts, start, step, lambda s: s["found"])).alias("w")).select("id", "line", "w.column", "w.term")
    return places.join(deprecated, "term").select("id", (F.col("line") + 1).alias("line"), "column", "term", "replacement")


def packet_lines(packets: DataFrame) -> DataFrame:
    """Items (packet_id, rank, score, text) as one Markdown text per packet."""
    item = F.concat(F.col("rank").cast("string"), F.lit(". "), clip(F.col("text")), F.lit(" ("), F.col("score"), F.lit(")"))
    return packets.groupBy("packet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("line")))), lambda x: x["line"]), "\n").alias("markdown"))


def bounded_graph(edges: list[tuple[str, str, str]], nodes: list[str], most: int) -> tuple[list[str], list[str]]:
    """Edges in order while both ends fit within `most` nodes, then nodes in order. Bounded input, on the driver."""
    chosen: dict[str, None] = {}
    kept = []
    for edge, a, b in sorted(edges):
        new = [x for x in dict.fromkeys((a, b)) if x not in chosen]
        if len(chosen) + len(new) <= most:
            chosen |= dict.fromkeys(new)
            kept.append(edge)
    for n in sorted(nodes):
        if len(chosen) < most:
            chosen.setdefault(n)
    return list(chosen), kept


def drilldown_terms(missing_anchors: list[str], question_terms: list[str], most: int = 48) -> list[str]:
    """Anchors still missing, then the question's terms, each once."""
    return list(dict.fromkeys([*missing_anchors, *question_terms]))[:most]


def page(rows: DataFrame, order: str, number: int, size: int = 30) -> DataFrame:
    """Page `number`, from 1, with the number of pages (1 at least) in `pages`; a page beyond the end is an error."""
    pages = max(1, -(-rows.count() // size))
    if not 1 <= number <= pages:
        raise ValueError(f"page {number} of {pages}")
    return rows.orderBy(order).offset((number - 1) * size).limit(size).withColumn("pages", F.lit(pages).cast("long"))
