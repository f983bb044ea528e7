import random
from collections import defaultdict

import numpy as np
import pytest

from quern.llm import line_dedup
from quern.llm import words as W

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(docs, least_docs=5, least=40):
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(i)
    rank = lambda i: (i is not None, i or 0)
    hot = {k: max(ids, key=rank) for k, ids in held.items() if len(ids) >= least_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot or hot[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def corpus(seed=2):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdé \tXYZ") for _ in range(n))
    common = [say(60) for _ in range(8)] + ["é" * 39 + "x", "é" * 39, "Q" * 40, "\U0001f600" * 40, "w" * 5000]
    docs = []
    for i in range(150):
        lines = [rng.choice(common) if rng.random() < 0.5 else say(rng.randint(0, 70)) for _ in range(rng.randint(1, 8))]
        lines = [rng.choice(["", "  ", "\t\r"]) + (x.upper() if rng.random() < 0.3 and x.isascii() else x) + rng.choice(["", " "]) for x in lines]
        docs.append((i if i % 40 else None, "\n".join(lines) + rng.choice(["", "\n"])))
    return docs + [(500, None), (501, ""), (502, "\n\n"), (503, " " * 60), docs[3], docs[3], (3, "other " * 12)]


@pytest.mark.parametrize("held", [2_000_000, 0])
def test_dropped_lines_equal_brute_force(spark, held, monkeypatch):
    """Arrays that executors hold, and arrays asked by shard."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    docs = corpus()
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_lines int, block string").repartition(5)
    found = line_dedup.drop_repeated_lines(rows, held_keys=held).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(docs)


def test_no_rows_and_no_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_repeated_lines(empty).count() == 0 and line_dedup.drop_repeated_lines(empty, held_keys=-1).count() == 0
    rows = spark.createDataFrame([(1, "a\nb"), (2, "a\nb")], "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.drop_repeated_lines(rows).collect())) == [(1, 2, 0, "a\nb"), (2, 2, 0, "a\nb")]


def test_a_line_of_most_documents(spark):
    line = "the same line in every document, over and over again"
    docs = [(i, f"{line}\nown {i}\n{line.upper()} ") for i in range(400)]
    for held in (2_000_000, 0):
        found = line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), held_keys=held).collect()
        assert sorted((tuple(r) for r in found), key=repr) == brute(docs)


def test_perfect_hash_is_minimal_and_survives_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 64, size=n, dtype=np.uint64))
        index = line_dedup.PerfectHash.unpack(line_dedup.PerfectHash(keys).pack())
        assert sorted(index.places(keys).tolist()) == list(range(len(keys)))
        other = rng.integers(0, 1 << 64, size=200, dtype=np.uint64)
        places = index.places(other)
        assert ((places >= -1) & (places < max(len(keys), 1))).all()
    assert len(line_dedup.PerfectHash(keys).pack()) * 8 < 5 * len(keys)


def test_hash_of_a_long_line_is_summed_in_stretches(monkeypatch):
    text = ("z" * 70 + "\n" + "Long " * 4000 + "\n" + "y" * 45 + "\n" + "b" * 999).encode()
    whole = line_dedup.lines_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    monkeypatch.setattr(W, "CHUNK_BYTES", 100)
    parts = line_dedup.lines_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(whole.a) == 4 and (whole.a == parts.a).all() and (whole.b == parts.b).all()
