"""Default-deny access scopes, snapshots, versions and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Kinds of exclusions, and the column of a membership that each names.
EXCLUSIONS = {"fragment": "fragment_id", "source": "source_id", "family": "family_id"}
#: Fixed value: collections that a request may ask for.
MOST_COLLECTIONS = 16


def compile_access(memberships: DataFrame, collection_rules: DataFrame, source_rules: DataFrame, requested: list[str], exclusions: DataFrame | None = None) -> DataFrame:
    """Each candidate fragment with `permitted` and `policy_denied`.

    memberships: (fragment_id, source_id, collection_id, state), and family_id where families are excluded. Over its
    memberships in the requested collections (one to MOST_COLLECTIONS, each once) a fragment needs one at least, all
    active, and every collection listed as allowed; a denied source denies it. An excluded fragment, source or family
    (exclusions: kind, id) is dropped without counting as a policy denial; a fragment without a family is in none. An
    exclusion of another kind, or of families where memberships have none, is an error: it never goes unnoticed.
    """
    if not 1 <= len(requested) <= MOST_COLLECTIONS or len(set(requested)) != len(requested):
        raise ValueError(f"a request names 1 to {MOST_COLLECTIONS} collections, each once")
    family = ["family_id"] if "family_id" in memberships.columns else []
    rows = memberships.select("fragment_id", "source_id", *family, "collection_id", "state").filter(F.col("collection_id").isin(requested))
    rules = collection_rules.select("collection_id", F.col("effect").alias("_c"))
    rows = rows.join(rules, "collection_id", "left").join(source_rules.select("source_id", F.col("effect").alias("_s")), "source_id", "left")
    per = rows.groupBy("fragment_id", "source_id", *family).agg(
        F.bool_and(F.col("state") == "active").alias("_active"),
        F.bool_and(F.coalesce(F.col("_c") == "allow", F.lit(False))).alias("_listed"),
        F.bool_or(F.coalesce(F.col("_s") == "deny", F.lit(False))).alias("_denied"),
    )
    if exclusions is not None:
        kinds = {r.kind for r in exclusions.select("kind").distinct().limit(len(EXCLUSIONS) + 1).collect()}
        if unknown := kinds - set(EXCLUSIONS):
            raise ValueError(f"exclusions of unknown kinds: {sorted(map(str, unknown))}")
        if "family" in kinds and not family:
            raise ValueError("families are excluded, but memberships have no family_id")
        for kind in sorted(kinds):
            column = EXCLUSIONS[kind]
            out = exclusions.filter(F.col("kind") == kind).select(F.col("id").alias("_out")).distinct()
            per = per.join(out, F.col(column) == F.col("_out"), "left_anti")
    ok = F.col("_listed") & ~F.col("_denied")
    return per.select("fragment_id", "source_id", (F.col("_active") & ok).alias("permitted"), (F.col("_active") & ~ok).alias("policy_denied"))


def policy_omission(compiled: DataFrame) -> DataFrame:
    """One row, one bit: whether policy (and not an exclusion or a holdout) removed anything."""
    return compiled.agg(F.coalesce(F.bool_or("policy_denied"), F.lit(False)).alias("policy_omission_present"))


def disposition(incoming: DataFrame, history: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(uri, sha256) against (uri, sha256, version, is_head): added, unchanged, reverted or changed, and the version it leads to.

    Columns of `also`, such as the parser profile, are part of what a version is; neither side has nulls in them.
    """
    key = ["sha256", *also]
    known = history.select("uri", *key, F.col("version").alias("_v"), "is_head")
    last = known.groupBy("uri").agg(F.max("_v").alias("_last"), F.max(F.when(F.col("is_head"), F.struct(*key))).alias("_head"))
    same = known.groupBy("uri", *key).agg(F.max("_v").alias("_same"))
    rows = incoming.join(last, "uri", "left").join(same, ["uri", *key], "left")
    kind = F.when(F.col("_last").isNull(), "added").when(F.col("_head") == F.struct(*key), "unchanged").when(F.col("_same").isNotNull(), "reverted").otherwise("changed")
    return rows.select("uri", *key, kind.alias("disposition"), F.coalesce("_same", F.coalesce("_last", F.lit(0)) + 1).cast("long").alias("version"))


def lineage_conflicts(sources: DataFrame, family: str, digest: str = "sha256") -> DataFrame:
    """Digests whose sources are declared in more than one family, with the number of families: bytes belong to one."""
    return sources.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.count_distinct(family).alias("families")).filter("families > 1")


def manifest_faults(files: DataFrame, declared: DataFrame) -> DataFrame:
    """(relative_path) files against the (relative_path, logical_id, ...) of an identity manifest, which has to map each once.

    Faults: undeclared (a file without an entry), absent (an entry without a file), repeated (a path declared twice).
    """
    entries = declared.groupBy("relative_path").agg(F.count(F.lit(1)).alias("_n"))
    both = files.select("relative_path").distinct().withColumn("_f", F.lit(True)).join(entries, "relative_path", "full_outer")
    faults = F.array_compact(F.array(F.when(F.col("_n").isNull(), "undeclared"), F.when(F.col("_f").isNull(), "absent"), F.when(F.col("_n") > 1, "repeated")))
    return both.select("relative_path", F.explode(faults).alias("fault"))


def identified(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Files with what the identity manifest declares of them; an error unless it maps every file once and nothing else."""
    if not manifest_faults(files, declared).isEmpty():
        raise ValueError("the identity manifest does not map these files one to one")
    return files.join(declared, "relative_path")


def lineage_roles(sources: DataFrame, order: str = "source_id") -> DataFrame:
    """source_id, family, root_id and role of (source_id, sha256, declared, `order`): root, duplicate or derivative.

    `declared` is the family that a source's identity names, null where it names none. A source without one joins the
    family of the first source with its bytes, as a duplicate; the first is the root of a family of its own, named by
    its id. In a declared family the first source is the root, a later one a duplicate if the family has its bytes
    already, else a derivative. Null digests equal nothing. Ties of `order` go to the least source_id. Bytes of two
    declared families are conflicts, and so is a source that is bound twice (`lineage_conflicts`); neither is settled here.
    """
    place = F.struct(F.col(order).alias("at"), F.col("source_id").alias("id"))
    rows = sources.select("source_id", "sha256", F.col("declared").alias("_d"), place.alias("_p"))
    first = rows.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("_p").alias("_first"), F.min_by("_d", F.when(F.col("_d").isNotNull(), F.col("_p"))).alias("_known"))
    named = rows.join(first, "sha256", "left").withColumn("_own", F.coalesce(F.col("_first")["id"], F.col("source_id")))
    named = named.withColumn("family", F.coalesce("_d", "_known", F.col("_own").cast("string")))
    roots = named.groupBy("family").agg(F.min("_p").alias("_root"))
    bytes_ = named.filter("sha256 IS NOT NULL").groupBy("family", "sha256").agg(F.min("_p").alias("_same"))
    rows = named.join(roots, "family").join(bytes_, ["family", "sha256"], "left")
    role = F.when(F.col("_p") == F.col("_root"), "root").when(F.col("_same") < F.col("_p"), "duplicate").otherwise("derivative")
    return rows.select("source_id", "family", F.col("_root")["id"].alias("root_id"), role.alias("role"))


def duplicate_lineage(sources: DataFrame, order: str = "doc_id", digest: str = "text_sha256") -> DataFrame:
    """Sources whose bytes already exist join the family of the first: root_id, family size and role."""
    roots = sources.groupBy(digest).agg(F.min(order).alias("root_id"), F.count(F.lit(1)).alias("family_size"))
    return sources.join(roots, digest).withColumn("role", F.when(F.col(order) == F.col("root_id"), "root").otherwise("duplicate"))


def structure_units(fragments: DataFrame, least: int = 2, most: int = 128) -> DataFrame:
    """Maximal runs of neighbours with one heading path; too short or too long runs are omissions, never split."""
    by = Window.partitionBy("version_id").orderBy("ordinal")
    starts = F.when(F.lag("heading").over(by).eqNullSafe(F.col("heading")) & (F.lag("ordinal").over(by) + 1 == F.col("ordinal")), 0).otherwise(1)
    runs = fragments.withColumn("_start", starts).withColumn("run", F.sum("_start").over(by))
    units = runs.groupBy("version_id", "run").agg(F.first("heading").alias("heading"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.count(F.lit(1)).alias("members"))
    return units.withColumn("omission", F.when(F.col("members") < least, "below_minimum").when(F.col("members") > most, "oversized"))


def exact_read(table: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of `table` for the keys, keys that it lacks): a read is exact when the second is empty."""
    return table.join(keys, key), keys.join(table.select(key), key, "left_anti")


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of a content-addressed insert that the table doesn't hold yet, each key once."""
    return rows.dropDuplicates([key]).join(table.select(key), key, "left_anti")


def ordered_lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of `table` for (place, key) in the order asked for; a key asked for twice is there twice, a missing one not at all."""
    return keys.join(table, key).orderBy("place")


def snapshot_faults(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Collections whose stored (collection, members, manifest_hash) isn't what their members give now."""
    here = now.select("collection", F.col("members").alias("_m"), F.col("manifest_hash").alias("_h"))
    rows = stored.join(here, "collection", "full_outer")
    kind = F.when(F.col("_h").isNull(), "lost").when(F.col("manifest_hash").isNull(), "new").when(F.col("members") != F.col("_m"), "count").otherwise("content")
    return rows.filter(~F.col("manifest_hash").eqNullSafe(F.col("_h")) | ~F.col("members").eqNullSafe(F.col("_m"))).select("collection", kind.alias("fault"))


def identity_faults(bindings: DataFrame) -> DataFrame:
    """Declared identities (source_id, logical_id, family): a source bound to two identities, or an identity in two families."""
    rebound = bindings.groupBy("source_id").agg(F.count_distinct("logical_id").alias("n")).filter("n > 1").select(F.lit("rebound").alias("fault"), F.col("source_id").cast("string").alias("id"))
    split = bindings.groupBy("logical_id").agg(F.count_distinct("family").alias("n")).filter("n > 1").select(F.lit("families").alias("fault"), F.col("logical_id").cast("string").alias("id"))
    return rebound.unionByName(split)


def structure_exclusions(fragments: DataFrame, excluded: DataFrame) -> DataFrame:
    """(version_id, fragment_id, ordinal, markdown) to (version_id, reason): versions that no structure is proposed for.

    A version with an address that isn't Markdown, one whose permitted ordinals have gaps, and, if any fragment of the
    scope is excluded (fragment_id), every Markdown version.
    """
    any_out = fragments.join(excluded.select("fragment_id"), "fragment_id", "left_semi").limit(1).agg((F.count(F.lit(1)) > 0).alias("_out"))
    per = fragments.groupBy("version_id").agg(F.bool_and("markdown").alias("_md"), (F.max("ordinal") - F.min("ordinal") + 1 != F.count(F.lit(1))).alias("_gaps"))
    reasons = F.array_compact(F.array(F.when(~F.col("_md"), "not_markdown"), F.when(F.col("_gaps"), "not_contiguous"), F.when(F.col("_md") & F.col("_out"), "scope_exclusion")))
    return per.crossJoin(F.broadcast(any_out)).select("version_id", F.explode(reasons).alias("reason"))


def units_around(members: DataFrame, anchors: DataFrame, permitted: DataFrame) -> DataFrame:
    """Units (unit_id, fragment_id) with an anchor among their members, all of which are permitted."""
    touched = members.join(anchors.select("fragment_id").distinct(), "fragment_id", "left_semi").select("unit_id").distinct()
    outside = members.join(permitted.select("fragment_id").distinct(), "fragment_id", "left_anti").select("unit_id").distinct()
    return touched.join(outside, "unit_id", "left_anti")


def contained_paths(paths: DataFrame) -> DataFrame:
    """(path) to (outer, inner): every path that lies inside another; found by equality with each proper prefix."""
    own = paths.select("path").distinct()
    parts = F.split("path", "/")
    inner = own.select(F.col("path").alias("inner"), F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k > 0), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("outer"))
    return inner.join(own.select(F.col("path").alias("outer")), "outer", "left_semi").select("outer", "inner")


def comparable(requests: DataFrame, shared: list[str]) -> DataFrame:
    """Pairs (left_id, right_id) of requests (request_id, collection, ...) alike in all of `shared` over different collections.

    Requests with equal shared fields meet in one group of a shuffled join, which Spark splits when it is hot.
    """
    a, b = requests.alias("a"), requests.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in shared]
    return a.join(b, [*on, F.col("a.request_id") < F.col("b.request_id"), F.col("a.collection") != F.col("b.collection")]).select(F.col("a.request_id").alias("left_id"), F.col("b.request_id").alias("right_id"))
