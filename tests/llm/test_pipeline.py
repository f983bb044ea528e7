import random

import pytest

import corpus_pipeline
from quern.llm import decontaminate
from tests.llm import brute

SIZES = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(30)) for k in range(4)]
    passage = say(60)
    texts = [say(80) for _ in range(30)]
    texts += [texts[0], texts[1] + " more", "too few words", ("same words " * 60).strip(), say(40) + " " + passage, say(40) + " " + passage, say(40) + " " + items[2][1], None, ""]
    docs = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("tables")
    for name, rows in (("documents", docs), ("benchmark", items)):
        spark.createDataFrame(rows, SIZES[name]).write.parquet(f"{path}/{name}.parquet")
    return str(path), docs, items


def test_stages_equal_brute_force(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = [r for r in rows if (m := brute.quality(r[1]))[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    near = brute.near([(r[0], r[1]) for r in kept], 5)
    kept2 = [r for r in kept if near[r[0]][1] == r[0]]
    cut = {i: (gone, text) for i, _, gone, text in brute.repeats([(r[0], r[1]) for r in kept2], 35)}
    kept3 = [(r[0], cut[r[0]][1] if cut[r[0]][0] else r[1]) for r in kept2]
    dirty = brute.leaks(kept3, items)
    want = [sorted(r[0] for r in kept), sorted(r[0] for r in kept2), sorted(kept3), sorted((i, t) for i, t in kept3 if i not in dirty)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        if k < 4:
            assert docs.columns == columns
            docs.write.parquet(out := f"{path}/stage{k}")
            docs = spark.read.parquet(out)
            got = sorted((r.doc_id, r.text) for r in docs.collect()) if k > 1 else sorted(r.doc_id for r in docs.collect())
            assert got == want[k]
    total = sum(len(brute.words(t)) for _, t in want[3])
    taken = sum(len(brute.words(r.text)) for r in docs.collect())
    assert 1.2 * total <= taken <= 1.8 * total and dirty and len(kept3) < len(rows)


def test_one_row_of_each_group_of_repeated_rows_stays(spark, tmp_path):
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"word{rng.randrange(900)}" for _ in range(80)) for _ in range(4))
    rows = [(7, a), (7, a), (3, a + " more"), (5, b), (5, b), (None, c), (None, c), (9, c), (None, d), (None, d), (4, a[:20] + b), (4, d + " more"), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SIZES["documents"])
    out = corpus_pipeline.near_copies(spark, docs, str(tmp_path))
    out.write.parquet(f"{tmp_path}/near")
    kept = sorted((r.doc_id or 0, r.text) for r in spark.read.parquet(f"{tmp_path}/near").collect())
    want = sorted([(0, ""), (0, ""), (3, a + " more"), (4, a[:20] + b), (4, d + " more"), (9, c)])
    assert out.columns == docs.columns and kept == want
    left = corpus_pipeline.repeated_passages(spark, spark.read.parquet(f"{tmp_path}/near"), str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == want


def test_run_over_no_documents(spark, tmp_path):
    for name in SIZES:
        spark.createDataFrame([], SIZES[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert decontaminate.PERCENT == 80
