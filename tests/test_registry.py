"""Registered queries against their SQL in DuckDB, on tables made here."""

import datetime as dt
import math
import random

import duckdb
import pytest

from quern.plans import registry


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = random.Random(0)
    folder = tmp_path_factory.mktemp("sf")
    say = lambda n: " ".join(rng.choice(["the", "thing", "blend", "Erer", "tion", "ther", "café", "worthless", "idiot", "clown", "and", "of", "42"]) for _ in range(n))
    texts = [say(rng.randint(1, 40)) + rng.choice(["", "\n" + say(5)]) for _ in range(120)]
    day = lambda: dt.datetime(1995, 1, 1) + dt.timedelta(days=rng.randint(0, 400))
    data = {
        "documents": ("doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT", [(k, t := texts[k % 110], rng.choice(["en", "fr", "de", "es"]), f"src{k % 11}", len(t)) for k in range(120)]),
        "labels": ("doc_id BIGINT, quality INTEGER, toxic INTEGER", [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 120, 2)]),
        "benchmark": ("item_id BIGINT, text VARCHAR", [(k, texts[k]) for k in range(4)]),
        "pages": ("page_id BIGINT, url VARCHAR, html VARCHAR", [(k, f"http://h{k % 5}.com/a", f"<h1>T</h1><nav><li>n</li></nav><p>{say(4)}</p><script>x</script>") for k in range(20)]),
        "conversations": ("conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR", [(c, t, rng.choice(["user", "assistant"]), say(3)) for c in range(10) for t in range(5)]),
        "events": ("event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR", [(k, day(), rng.randint(1, 6), rng.choice(["view", "purchase"]), rng.random(), '{"k": "v"}') for k in range(80)]),
        "embeddings": ("vec_id BIGINT, embedding FLOAT[], label INTEGER", [(k, [rng.random() for _ in range(4)], k % 3) for k in range(30)]),
        "region": ("r_regionkey INTEGER, r_name VARCHAR", [(0, "A"), (1, "B")]),
        "nation": ("n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER", [(k, f"N{k}", k % 2) for k in range(6)]),
        "customer": ("c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR", [(k, f"C{k}", k % 6, rng.random(), rng.choice("XY")) for k in range(20)]),
        "supplier": ("s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE", [(k, f"S{k}", k % 6, rng.random() - 0.3) for k in range(8)]),
        "part": ("p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE", [(k, rng.choice(["green red", "blue"]), f"B{k % 3}", "LARGE BRASS", k, 900 + 50.0 * k) for k in range(20)]),
        "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR", [(k, rng.randint(0, 14), "O", rng.random() * 400000, day(), rng.choice(["1-URGENT", "5-LOW"])) for k in range(60)]),
        "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP", [(k // 3, rng.randint(0, 19), rng.randint(0, 7), k % 3, float(rng.randint(1, 50)), 1.0, rng.randint(0, 10) / 100, rng.randint(0, 8) / 100, rng.choice("ANR"), "O", day()) for k in range(180)]),
    }
    db = duckdb.connect()
    for name, (schema, rows) in data.items():
        db.execute(f"CREATE TABLE {name} ({schema})")
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        db.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder), db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    folder, db = tables
    df = registry.QUERIES[name](spark, folder)
    got = [{c: plain(v) for c, v in zip(df.columns, r, strict=True)} for r in df.collect()]
    if name in registry.ORACLES:
        found = db.execute(registry.ORACLES[name])
        columns = [c[0] for c in found.description]
        want = [{c: plain(v) for c, v in zip(columns, r, strict=True)} for r in found.fetchall()]
        key = lambda r: repr(sorted(r.items()))
        assert sorted(got, key=key) == sorted(want, key=key)


def test_bm25_batch_asks_with_every_term_of_an_item(spark, tmp_path):
    """A text that holds only the seventieth term of an item is among its candidates, in SQL as well."""
    docs = [(1, "w69 alone"), (2, "nothing of it"), (3, "w0 w1"), (4, "other words")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(f"w{k}" for k in range(70)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted(tuple(r) for r in registry.QUERIES["bm25_batch"](spark, str(tmp_path)).select("query_id", "rank", "doc_id", "score", "candidates").collect())
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert [(r[2], r[4]) for r in found] == [(3, 2), (1, 2)] and found == sorted(con.sql(registry.ORACLES["bm25_batch"]).fetchall())
