"""The queries of the training-data operators, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid

from quern.llm import decontaminate, features, language_id, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, spelling, substring_dedup, toxicity, turns, url_filters, warc
from quern.llm.shared import cut, scratch_root
from quern.session import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    rows = warc.read(spark, path)
    page = lambda c: F.regexp_extract(c, "(-?[0-9]+)>$", 1).cast("long")
    return rows.select(
        page(F.col("record_id")).alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(F.col("warc_type") == "revisit", page(F.col("refers_to"))).alias("refers_to"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=2)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = quality_rules.apply_policy(quality_rules.apply_policy(rows, "base-1", "_base"), "web-1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "n_lines", "n_letters", "n_upper", "failed_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version contributes, from one ledger of bits that is written once."""
    rows = cut(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "failed_bits"), "ledger")
    return quality_rules.ablations(rows)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = features.fold(F.col("doc_id"), 5) == 0
    model = quality_classifier.train(docs, labels.filter(~held))
    rows = quality_classifier.score(docs, model)
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "meta_score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "contaminated", "item_ids", "similarity")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = features.fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels.filter(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = features.fold(F.col("doc_id"), 3) == 1
    net = language_id.train(docs.filter(~held))
    return language_id.predict(docs.select("doc_id", "text"), net).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def _number(text):
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _day(n):
    """A timestamp n days into 2024."""
    return F.timestamp_seconds(F.lit(1704067200) + n * 86400)


def list_entries(pages: DataFrame) -> DataFrame:
    """The query's dated lists: what a few curators would have logged about the hosts of `pages`, day by day."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct().withColumn("n", _number(F.col("host")))

    def some(name, every, key, action, day):
        return hosts.filter(F.col("n") % every == 0).select(F.lit(name).alias("list"), key.alias("key"), F.lit(action).alias("action"), _day(day).alias("at"))

    host, n = F.col("host"), F.col("n")
    entries = some("hosts", 4, host, "block", n % 300)
    for more in (some("hosts", 8, host, "remove", n % 300 + 60), some("hosts", 16, host, "block", n % 300 + 90), some("review", 12, F.concat(host, F.lit("/en")), "allow", n % 250)):
        entries = entries.unionByName(more)
    fixed = pages.sparkSession.sql("SELECT * FROM VALUES ('spam', 'cheap-pills.example.com', 'block', 0L), ('spam', 'casino.example.net', 'block', 40L), ('spam', 'example.org', 'block', 200L), ('spam', 'example.org', 'remove', 220L) AS t(list, key, action, day)")
    return entries.unionByName(fixed.select("list", "key", "action", _day(F.col("day")).alias("at")))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", _day(_number(F.col("page_id").cast("string")) % 365))
    rows = url_filters.judge(captures, list_entries(pages))
    return rows.select("page_id", "fetched_at", "blocked", "by_list", "by_key")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    runs = docs.select("id", F.explode(spelling.runs(F.col("text"), spelling.LEAST_LENGTH)).alias("run"))
    number = F.crc32(F.concat_ws(":", "id", "run"))
    at = F.pmod(number, F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(number % 199 == 0, short).otherwise(F.col("run")).alias("word"))
    return spelling.variants(spelling.vocabulary(words)).select("word", "form", "root", "n", "n_near", "form_n")


def damaged(turns_: DataFrame) -> DataFrame:
    """Conversations as op12's query damages them."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = turns_.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), how.alias("how")).filter("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = turns.repair(damaged(found)).withColumnRenamed("conv_id", "id")
    every = found.select("conv_id").distinct().join(rows, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_near_dedup": op2_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "quality_ablation": quality_ablation,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_decontamination": op6_decontamination,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_url_filters": op10_url_filters,
    "op11_spelling": op11_spelling,
    "op12_turn_repair": op12_turn_repair,
    "op13_line_dedup": op13_line_dedup,
}
