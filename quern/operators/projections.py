"""Research projections, append-only tables, external reference maps, merged run graphs, recall and generator runs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import alias_key
from quern.operators import packets, scope

#: Fragments whose proposals a task holds at a time.
ROWS = 256
#: Fields of a projection theme that name atlas objects, and the kind they name.
THEME_REFERENCES = {"question_ids": "questions", "hypothesis_ids": "hypotheses", "gap_ids": "gaps"}


def projection_faults(materials: DataFrame, themes: DataFrame, atlas: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, field, missing): references of materials (id, source_id) and themes (id, arrays of ids) that the atlas can't answer.

    A material without a source is a fault with a null in `missing`; a theme's null array names nothing. A kind that the
    atlas lacks answers no reference.
    """
    refs = materials.select(F.lit("material").alias("kind"), F.col("id").cast("string").alias("id"), F.lit("source_id").alias("field"), F.lit("sources").alias("target"), F.col("source_id").cast("string").alias("missing"))
    for field, target in THEME_REFERENCES.items():
        if field in themes.columns:
            refs = refs.unionByName(themes.select(F.lit("theme").alias("kind"), F.col("id").cast("string").alias("id"), F.lit(field).alias("field"), F.lit(target).alias("target"), F.explode(F.col(field).cast("array<string>")).alias("missing")))
    known = None
    for target in ("sources", *THEME_REFERENCES.values()):
        if target in atlas:
            part = atlas[target].select(F.lit(target).alias("target"), F.col("id").cast("string").alias("missing"))
            known = part if known is None else known.unionByName(part)
    lost = refs if known is None else refs.join(known, ["target", "missing"], "left_anti")
    return lost.select("kind", "id", "field", "missing")


def load_projection(spark: SparkSession, path: str, case_id: str, atlas_hash: str, atlas: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The materials, themes and periods of a projection document, one JSON file read whole; an error unless it is bound to this atlas and closed."""
    text = spark.read.text(path, wholetext=True).first()[0]
    doc = json.loads(text)
    if doc["case_id"] != case_id or doc["base_manifest_hash"] != atlas_hash:
        raise ValueError("the projection belongs to another case or atlas")
    shapes = {"materials": "id string, source_id string", "themes": "id string, question_ids array<string>, hypothesis_ids array<string>, gap_ids array<string>", "periods": "id string, label string"}
    found = {kind: spark.createDataFrame([tuple(o.get(n.split()[0]) for n in shape.split(", ")) for o in doc.get(kind, [])], shape) for kind, shape in shapes.items()}
    if not projection_faults(found["materials"], found["themes"], atlas).isEmpty():
        raise ValueError("the projection names objects that the atlas doesn't have")
    return found


def append_faults(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, fault): rows of an append-only table that a later state has lost ("deleted") or holds otherwise ("updated").

    Rows without a key are compared with one another by what they hold, repeated rows by how often each is there.
    """
    columns = sorted(before.columns)
    image = F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns])), 256)
    count = lambda rows, n: rows.select(key, image.alias("_i")).groupBy(key, "_i").agg(F.count(F.lit(1)).alias(n))
    old, new = count(before, "_n"), count(after, "_m").withColumnsRenamed({key: "_k", "_i": "_j"})
    gone = old.join(new, old[key].eqNullSafe(new["_k"]) & (old["_i"] == new["_j"]), "left").filter(F.coalesce("_m", F.lit(0)) < F.col("_n")).select(key).distinct()
    held = after.select(F.col(key).alias("_k"), F.lit(True).alias("_held")).distinct()
    return gone.join(held, gone[key].eqNullSafe(held["_k"]), "left").select(key, F.when(F.col("_held"), "updated").otherwise("deleted").alias("fault"))


def reference_faults(entries: DataFrame, expected: DataFrame, library: str) -> DataFrame:
    """(external_id, fault) of a map (library_id, external_id, kind, target, alias) that has to cover (external_id) exactly.

    missing, extra; foreign: of another library; repeated_id, repeated_target and repeated_alias (by its folded key):
    each entry of a group that should have been one.
    """
    wanted = expected.select("external_id").distinct()
    have = entries.select("external_id").distinct()
    found = wanted.join(have, "external_id", "left_anti").select("external_id", F.lit("missing").alias("fault"))
    found = found.unionByName(have.join(wanted, "external_id", "left_anti").select("external_id", F.lit("extra").alias("fault")))
    found = found.unionByName(entries.filter(~F.col("library_id").eqNullSafe(F.lit(library))).select("external_id", F.lit("foreign").alias("fault")).distinct())
    rows = entries.select("external_id", "kind", "target", alias_key(F.col("alias")).alias("_a"))
    for fault, by in (("repeated_id", ["external_id"]), ("repeated_target", ["kind", "target"]), ("repeated_alias", ["_a"])):
        many = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        found = found.unionByName(rows.join(many, by, "left_semi").select("external_id", F.lit(fault).alias("fault")).distinct())
    return found


def resolved_reference(entries: DataFrame, library: str, asked: DataFrame) -> DataFrame:
    """Entries of this library for (alias) as asked, by folded key; an alias that no entry has is there with nulls."""
    own = entries.filter(F.col("library_id") == library).select(alias_key(F.col("alias")).alias("_a"), "external_id", "kind", "target")
    return asked.select("alias", alias_key(F.col("alias")).alias("_a")).join(own, "_a", "left").drop("_a")


def trimmed(text: Column) -> Column:
    """Receipt of a text without white space at its ends: start and end in the text given, what is left, and its hash."""
    left = F.length(F.regexp_extract(text, r"(?U)^\s*", 0))
    kept = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.struct(left.cast("long").alias("start"), (left + F.length(kept)).cast("long").alias("end"), kept.alias("text"), F.sha2(kept, 256).alias("text_hash"))


def merged_nodes(builds: DataFrame) -> DataFrame:
    """Nodes (run_id, node_id, kind, label, members array) of several runs' graphs, each once: its runs, all its members.

    `consistent` is false where runs disagree on kind or label; the least of each is given then.
    """
    said = builds.groupBy("node_id").agg(F.min("kind").alias("kind"), F.min("label").alias("label"), F.count_distinct("run_id").alias("runs"), F.count_distinct(F.struct("kind", "label")).alias("_d"))
    each = builds.select("node_id", F.explode("members").alias("m")).distinct()
    listed = each.groupBy("node_id").agg(F.array_sort(F.collect_list("m")).alias("members"))
    none = F.array().cast(builds.schema["members"].dataType)
    return said.join(listed, "node_id", "left").select("node_id", "kind", "label", "runs", (F.col("_d") == 1).alias("consistent"), F.coalesce("members", none).alias("members"))


def merged_edges(builds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (edge_id, a, b, kind) of several runs' graphs, each once, where both ends are nodes; `consistent` as for nodes."""
    edges = builds.groupBy("edge_id").agg(F.min(F.struct("a", "b", "kind")).alias("_e"), F.count_distinct(F.struct("a", "b", "kind")).alias("_d"))
    edges = edges.select("edge_id", "_e.*", (F.col("_d") == 1).alias("consistent"))
    for end in ("a", "b"):
        edges = edges.join(nodes.select(F.col("node_id").alias(end)).distinct(), end, "left_semi")
    return edges.select("edge_id", "a", "b", "kind", "consistent")


def recall(fragments: DataFrame, compiled: DataFrame, search: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Authorise, read, search, pack: (results, packets, the one-row receipt of what was read).

    fragments: (fragment_id, ...); compiled: see `scope.compile_access`; search gets the permitted fragments alone and gives
    (query_id, rank, id, score). A result from outside of what is permitted is an error when the results are read.
    """
    allowed = compiled.filter("permitted").select("fragment_id").distinct()
    results = search(fragments.join(allowed, "fragment_id", "left_semi"))
    inside = allowed.select(F.col("fragment_id").alias("id"), F.lit(True).alias("_in"))
    checked = results.join(inside, "id", "left").withColumn("id", F.when(F.col("_in"), F.col("id")).otherwise(F.raise_error(F.lit("a result from outside of the scope")))).drop("_in")
    # A sum of hashes is the same in any order and is added up before the shuffle, so no task lists all that was read.
    read = allowed.agg(F.count(F.lit(1)).alias("read"), F.coalesce(F.sum(F.conv(F.substring(F.sha2(F.col("fragment_id").cast("string"), 256), 1, 14), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("read_sum"))
    return checked, packets.packets(checked), read.crossJoin(F.broadcast(scope.policy_omission(compiled)))  # one row each


def generated(fragments: DataFrame, generate: Callable[[str, str], list[str]]) -> DataFrame:
    """A generator over permitted (fragment_id, text): (fragment_id, status, proposal, error), a row per proposal.

    A fragment for which it fails has one row with status "failed" and the error; one without proposals has one with status "empty".
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                keys, texts = (c.slice(start, ROWS) for c in batch.columns)
                out: list[tuple] = []
                for key, text in zip(keys, texts, strict=True):  # one text at a time becomes an object
                    try:
                        made = generate(key.as_py(), text.as_py() or "")
                    except Exception as e:  # the failure of a generator is a result
                        out.append((key.as_py(), "failed", None, f"{type(e).__name__}: {e}"))
                        continue
                    out += [(key.as_py(), "made", p, None) for p in made] or [(key.as_py(), "empty", None, None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["fragment_id", "status", "proposal", "error"])

    return fragments.select(F.col("fragment_id").cast("string").alias("fragment_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "fragment_id string, status string, proposal string, error string")


def receipts(rows: DataFrame, subject: str) -> DataFrame:
    """Rows as stored receipts (receipt_id, subject, body): the id is the hash of the body, so storing again adds nothing."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]))
    return rows.select(F.sha2(body, 256).alias("receipt_id"), F.col(subject).cast("string").alias("subject"), body.alias("body"))


def receipt_faults(stored: DataFrame) -> DataFrame:
    """Stored receipts whose body isn't what their id was made from."""
    return stored.filter(~F.sha2("body", 256).eqNullSafe(F.col("receipt_id"))).select("receipt_id", "subject")
