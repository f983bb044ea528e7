import random
from collections import defaultdict

from pyspark.sql import functions as F

from quern.llm import decontaminate, mixing, quality_rules, substring_dedup, url_filters
from tests.llm import brute

TEXTS = [None, "", " \n ", "one", "a b c d e f g h " * 3, "x y\nx y\nz\n\n x y", "é ü #tag | $5 <b>", "w " * 5000, "A\vB\fC\rD", " ".join(f"k{k % 9}" for k in range(40))]


def test_quality_measures_equal_brute_force(spark):
    rows = spark.createDataFrame([(k, t, 7) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.measure(rows).collect()}
    assert found == {k: brute.quality(t) for k, t in enumerate(TEXTS)}
    assert quality_rules.ledger(rows.limit(0)).count() == 0


def test_policies_and_ablation_read_the_ledger(spark):
    rows = quality_rules.ledger(spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")).cache()
    kept = {r.doc_id for r in quality_rules.apply_policy(rows, "base-1").filter("kept").collect()}
    assert kept == {r.doc_id for r in quality_rules.passing(rows, "base-1").collect()}
    assert kept == {k for k, t in enumerate(TEXTS) if (m := brute.quality(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    parts = {r.rule: (r.failed, r.only_failure) for r in quality_rules.ablation(rows, "base-1").collect()}
    assert parts["few_words"][0] == sum(brute.quality(t)[0] < 20 for t in TEXTS)
    assert all(only <= failed for failed, only in parts.values())


def test_mixing_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(0, 60), rng.choice(["a", "b", "b", "b", None, "é"]), 1) for k in range(3000)] + [(1, "w w", "a", 1)] * 2 + [(None, None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) and max(r.copies for r in found) <= 2
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in found:
        per[r.source][0] += r["size"] * r.copies
        per[r.source][1] += r["size"]
        per[r.source][2] = r.target
    assert abs(sum(x[2] for x in per.values()) - 1.5 * sum(x[1] for x in per.values())) < 1
    assert all(abs(took - goal) <= 0.03 * goal + 60 and goal <= 2 * size + 1e-6 for took, size, goal in per.values())
    again = sorted(map(str, mixing.mix(docs.repartition(3)).select("doc_id", "copies").collect()))
    assert again == sorted(map(str, [r for r in mixing.mix(docs).select("doc_id", "copies").collect()]))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.emit(docs).count() == sum(r.copies for r in found)
    nulls = mixing.mix(spark.createDataFrame([(None, f"w{k} " * (k % 9), "a") for k in range(400)], "doc_id long, text string, source string")).collect()
    assert abs(sum(r["size"] * r.copies for r in nulls) - nulls[0].target) <= 20


def test_targets_stop_at_the_cap_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1000, 1), (None, 100, 1)], "source string, source_size long, n_docs long")
    found = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert found["a"] == 20 and found[None] == 200 and abs(sum(found.values()) - 1.5 * 2110) < 1e-6 and abs(found["b"] - 2 * found["c"]) < 1e-6


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.randint(12, 40))) for k in range(12)] + [(20, "too few"), (21, ""), (22, None)]
    docs = []
    for k in range(60):
        w = items[k % 12][1].split()
        for _ in range(k // 20):
            w[rng.choice([0, len(w) - 1])] = "other"
        docs.append((k, say(30) + " " + ", ".join(w).upper() + ". " + say(30) if k % 3 else say(80)))
    docs += [(90, None), (91, ""), (92, "too few"), (93, items[0][1])]
    rows = spark.createDataFrame([(i, t, [1], "x") for i, t in docs], "doc_id long, text string, item_ids array<int>, k string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: set(r.item_ids) for r in decontaminate.decontaminate(rows, bench).collect() if r.contaminated}
    assert found == brute.leaks(docs, items) and len(found) > 20
    assert decontaminate.decontaminate(rows, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(rows.limit(0), bench).count() == 0


def test_decontamination_of_repeated_and_long_rows(spark):
    rng = random.Random(15)
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    items = [(1, say(30)), (1, say(30)), (2, say(1500)), (3, "a b c d e f g " * 6), (None, say(20))]
    long = items[2][1].split()
    long[700:740] = ["other"] * 40
    docs = [(1, say(9) + " " + items[0][1]), (1, say(9) + " " + items[0][1]), (2, say(4000) + " " + " ".join(long)), (3, say(40) + " " + items[3][1] + " " + say(8)), (None, items[4][1]), (5, say(50)), (None, None)]
    docs[1] = docs[0]
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:1] + items[2:], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, tuple(r.item_ids)) for r in found) == [(0, ()), (0, ()), (1, (1,)), (1, (1,)), (2, (2,)), (3, (3,)), (5, ())]


def test_fingerprints_find_what_an_exact_join_finds(spark):
    """Recall of the radius: windows at similarities from 0.8 up, against all windows compared exactly."""
    rng = random.Random(16)
    say = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    items = [(k, say(rng.randint(25, 50))) for k in range(40)]
    docs = []
    for k in range(240):
        w = list(items[k % 40][1])
        w[: rng.choice([0, 1, 2, 3])] = say(2)
        if rng.random() < 0.6:
            w[-1] = "zz"
        docs.append((k, " ".join(say(20) + w + say(20))))
    items = [(i, " ".join(w)) for i, w in items]
    want = brute.leaks(docs, items)
    rows = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {r.doc_id: set(r.item_ids) for r in rows.collect() if r.contaminated}
    assert len(want) > 120 and all(found[i] <= want[i] for i in found)
    assert sum(len(x) for x in found.values()) >= 0.98 * sum(len(x) for x in want.values())


def test_blocks_find_every_fingerprint_in_the_radius(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    rows = spark.createDataFrame(pairs, "p long, q long")
    met = rows.select(F.size(F.array_intersect(decontaminate._blocks("p"), decontaminate._blocks("q"))).alias("n"))
    assert met.filter("n = 0").count() == 0


def test_url_filters_ask_what_was_in_force(spark):
    day = lambda n: F.timestamp_seconds(F.lit(n * 86400))
    entries = spark.createDataFrame(
        [("l", "bad.com", "block", 10), ("l", "bad.com", "remove", 20), ("l", "bad.com", "block", 30), ("m", "a.bad.com", "allow", 12), ("m", "ok.com/x", "block", 0), ("l", "bad.com", "block", 10), ("l", None, "block", 1), ("l", "tie.com", "allow", 5), ("l", "tie.com", "block", 5)],
        "list string, key string, action string, day long",
    ).select("list", "key", "action", day(F.col("day")).alias("at"))
    asked = [("http://bad.com/", 9), ("http://bad.com/", 10), ("http://www.BAD.com:80/a?b", 19), ("http://bad.com/", 20), ("http://bad.com", 40), ("http://x.a.bad.com/", 15), ("http://a.bad.com/", 11), ("http://ok.com/x/y", 1), ("http://ok.com/y", 1), (None, 5), ("nonsense", 5), ("http://tie.com/", 6), ("http://bad.com/", None)]
    rows = spark.createDataFrame([(k, u, d, True) for k, (u, d) in enumerate(asked)], "k int, url string, day long, blocked boolean").withColumn("fetched_at", day(F.col("day")))
    found = [r.blocked for r in url_filters.judge(rows, entries).orderBy("k").collect()]
    assert found == [False, True, True, False, True, False, True, True, False, False, False, True, False]
    assert url_filters.judge(rows, entries.limit(0)).filter("blocked").count() == 0
    assert url_filters.judge(rows.limit(0), entries).count() == 0


def test_url_filters_join_alike_when_lists_are_long(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"http://h{k % 5}.com/p") for k in range(20)], "k int, url string").withColumn("fetched_at", F.timestamp_seconds(F.col("k")))
    entries = spark.createDataFrame([("l", f"h{k}.com", "block", k * 3) for k in range(4)], "list string, key string, action string, s long").select("list", "key", "action", F.timestamp_seconds("s").alias("at"))
    first = sorted(map(str, url_filters.judge(rows, entries).collect()))
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", 0)
    assert sorted(map(str, url_filters.judge(rows, entries).collect())) == first


def test_url_filters_meet_hosts_and_paths_of_any_depth(spark):
    deep = "a.b.c.d.e.f.g.h.i.com"
    lists = [("l", deep, "block"), ("l", "x.com", "block"), ("l", "x.com/1/2/3/4", "allow"), ("l", "x.com/1/2/3/4/5/6", "block"), ("l", "y.com/q/r/s", "block"), ("l", "k." * 120 + "com", "block"), ("l", "k." * 120 + "com/p", "allow")]
    entries = spark.createDataFrame(lists, "list string, key string, action string").withColumn("at", F.timestamp_seconds(F.lit(0)))
    asked = [
        (f"http://{deep}/", deep), (f"http://z.{deep}/p", deep), ("http://b.c.d.e.f.g.h.i.com/", None), ("http://x.com/1/2/3", "x.com"), ("http://x.com/1/2/3/4/5", "x.com/1/2/3/4"),
        ("http://x.com/1//2/3/4/5/6/7?q", "x.com/1/2/3/4/5/6"), ("http://y.com/q/r/s/t", "y.com/q/r/s"), ("http://y.com/q/r", None), ("http://" + "k." * 120 + "com/p", "k." * 120 + "com/p"), (None, None),
    ]
    rows = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(asked)], "k int, url string").withColumn("fetched_at", F.timestamp_seconds(F.lit(9)))
    action = {key: a for _, key, a in lists}
    found = [(r.by_key, r.blocked) for r in url_filters.judge(rows, entries).orderBy("k").collect()]
    assert found == [(key, action.get(key) == "block") for _, key in asked]
    keys = [[k.key for k in r[0]] for r in rows.orderBy("k").select(url_filters.keys_of(F.col("url"))).collect()]
    odd = spark.createDataFrame([(k, u) for k, u in enumerate(["http://10.0.0.1:80/a", "http://[::1]:8080/p", "http://u@10.0.0.1/", "http://10.0.0.1/a"])], "k int, url string").withColumn("fetched_at", F.timestamp_seconds(F.lit(9)))
    hosts = spark.createDataFrame([("l", "10.0.0.1", "block"), ("l", "[::1]", "block")], "list string, key string, action string").withColumn("at", F.timestamp_seconds(F.lit(0)))
    assert [r.by_key for r in url_filters.judge(odd, hosts).orderBy("k").collect()] == ["10.0.0.1", "[::1]", "10.0.0.1", "10.0.0.1"]
    assert len(keys[1]) == 12 and keys[5][-1] == "x.com/1/2/3/4/5/6/7" and keys[9] == []


CLASH = ["_n", "_words", "_windows", "_letters", "_at", "_class", "_block", "_mix", "_s", "_b", "_c", "_start", "_share", "_url", "_k", "_spans", "_found", "_items", "_row", "_passes", "_text", "_deal", "_cu", "_ct", "_most", "_size", "_rows", "_hash", "_ordered", "_lines", "_key"]


def test_columns_of_the_input_come_back_unchanged(spark):
    """Columns named like an operator's own inner ones are neither overwritten nor a crash."""
    values = {c: f"own {c}" for c in CLASH}
    rows = [(k, "some words that are here to be read " * (k % 3 + 1), "ab"[k % 2], "http://x.com/p", *values.values()) for k in range(40)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", "url string", *(f"{c} string" for c in CLASH)])).withColumn("fetched_at", F.timestamp_seconds(F.lit(9)))
    entries = spark.createDataFrame([("l", "x.com", "block")], "list string, key string, action string").withColumn("at", F.timestamp_seconds(F.lit(0)))
    items = spark.createDataFrame([(1, "some words that are here to be read some words"), (2, "x y z")], "item_id long, text string")
    made = {
        "ledger": quality_rules.apply_policy(quality_rules.ledger(docs), "web-1"),
        "passing": quality_rules.passing(quality_rules.ledger(docs), "base-1"),
        "mix": mixing.mix(docs),
        "emit": mixing.emit(docs),
        "judge": url_filters.judge(docs, entries),
        "decontaminate": decontaminate.decontaminate(docs, items),
        "repeats": substring_dedup.remove_repeats(docs),
    }
    for name, df in made.items():
        found = df.collect()
        assert (found or name == "passing") and all(r[c] == values[c] for r in found for c in CLASH), name
    assert all(r.blocked for r in made["judge"].collect())


def test_policies_side_by_side(spark):
    rows = quality_rules.ledger(spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")).cache()
    found = {(r.policy, r.rule): (r.failed, r.only_failure) for r in quality_rules.ablations(rows).collect()}
    assert {k for k in found} == {(p, r) for p, rules in quality_rules.POLICIES.items() for r in rules}
    bits = [r.failed_bits for r in rows.collect()]
    for (policy, rule), (failed, only) in found.items():
        mine, bit = quality_rules.mask(policy), quality_rules.BIT[rule]
        assert failed == sum(b & bit > 0 for b in bits) and only == sum(b & mine == bit for b in bits)
    assert {r.failed for r in quality_rules.ablations(rows.limit(0)).collect()} == {0}


def test_fingerprints_at_the_threshold(spark):
    """Windows from 0.80 to 0.85 similar, where fingerprints differ most: none is lost."""
    rng = random.Random(26)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(k, say(40 + k % 9)) for k in range(40)]
    docs = []
    for k in range(400):
        w = list(items[k % 40][1])
        w[0] = "aa"
        w[-3] = "zz"
        docs.append((k, " ".join(say(9) + w + say(9))))
    items = [(i, " ".join(w)) for i, w in items]
    want = brute.leaks(docs, items)
    rows = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: set(r.item_ids) for r in rows if r.contaminated} == want and len(want) == 400
    assert all(0.8 <= r.similarity < 0.85 for r in rows)


def test_texts_that_share_an_item_id_are_all_looked_for(spark):
    rng = random.Random(27)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    one, two = say(30), say(30)
    docs = spark.createDataFrame([(1, say(9) + " " + one), (2, two + " " + say(9)), (3, say(50))], "doc_id long, text string")
    items = spark.createDataFrame([(7, one), (7, two), (7, one)], "item_id long, text string")
    assert sorted((r.doc_id, tuple(r.item_ids)) for r in decontaminate.decontaminate(docs, items).collect()) == [(1, (7,)), (2, (7,)), (3, ())]


def test_list_keys_are_brought_to_one_form(spark):
    keys = [("B.C", "b.c"), (" b.c/ ", "b.c"), ("https://User@B.C:8080/", "b.c"), ("b.c.", "b.c"), ("*.b.c", "b.c"), ("b.c//P/q/?x#y", "b.c/P/q"), ("http:///x", None), ("", None), (None, None), ("[::1]:80/a", "[::1]/a"), ("b.c/p", "b.c/p")]
    rows = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(keys)], "k int, key string")
    assert [r.n for r in rows.orderBy("k").select(url_filters.normal_key(F.col("key")).alias("n")).collect()] == [b for _, b in keys]
    entries = spark.createDataFrame([("l", "B.C", "block"), ("l", "d.e/", "block"), ("l", "http://F.g/X/", "block"), ("l", "http:///", "block")], "list string, key string, action string").withColumn("at", F.timestamp_seconds(F.lit(0)))
    asked = [("http://a.b.c/", "b.c"), ("http://d.e", "d.e"), ("http://f.g/X/y", "f.g/X"), ("http://f.g/x/y", None), (None, None)]
    captures = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(asked)], "k int, url string").withColumn("fetched_at", F.timestamp_seconds(F.lit(9)))
    assert [r.by_key for r in url_filters.judge(captures, entries).orderBy("k").collect()] == [k for _, k in asked]
    assert [tuple(r) for r in url_filters.key_faults(entries).collect()] == [("l", "http:///")]


def test_captures_without_url_or_time_are_returned(spark):
    rows = [(k, None if k % 2 else "http://x.com/", None if k % 3 else 9) for k in range(60)] * 2
    captures = spark.createDataFrame(rows, "k int, url string, s long").withColumn("fetched_at", F.timestamp_seconds("s"))
    entries = spark.createDataFrame([("l", "x.com", "block")], "list string, key string, action string").withColumn("at", F.timestamp_seconds(F.lit(0)))
    found = url_filters.judge(captures, entries).collect()
    assert len(found) == 120 and all(r.blocked == (r.url is not None and r.s is not None) for r in found)
