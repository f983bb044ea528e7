import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.operators import admission, chains, gates, graph, imports, packets, reading_room, routing, scope
from quern.plans import registry


def test_reach_goes_on_until_it_settles(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(60)] + [("n60", "n3"), (None, "x"), ("n5", None)], "src string, dst string")
    assert {r.node for r in graph.reach(edges, spark.createDataFrame([("n0",)], "node string")).collect()} == {f"n{k}" for k in range(61)}


def test_closures_of_many_seeds_at_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    seeds = spark.createDataFrame([("a", 1), ("b", 4), ("b", 3), ("c", 9), ("d", None)], "q string, node int")
    found = defaultdict(set)
    for r in graph.closure(edges, seeds, ["q"]).collect():
        found[r.q].add(r.node)
    assert found == {"a": {1, 2, 3}, "b": {4, 5, 3, 1, 2}, "c": {9}}
    assert graph.closure(edges.limit(0), seeds.limit(0), ["q"]).count() == 0


def test_premises_have_no_depth_limit(spark):
    n = 90
    steps = spark.createDataFrame([("t", f"s{k}", f"s{k - 1}" if k else None) for k in range(n)], "trace_id string, step string, premise string")
    assert gates.premise_closure(steps).count() == n * (n - 1) // 2


def test_families_are_excluded(spark):
    members = spark.createDataFrame([("a", "s1", "f1", "c", "active"), ("b", "s2", "f2", "c", "active"), ("d", "s3", None, "c", "active")], "fragment_id string, source_id string, family_id string, collection_id string, state string")
    rules, none = spark.createDataFrame([("c", "allow")], "collection_id string, effect string"), spark.createDataFrame([], "source_id string, effect string")
    out = lambda *rows: spark.createDataFrame(list(rows), "kind string, id string")
    found = {r.fragment_id: (r.permitted, r.policy_denied) for r in scope.compile_access(members, rules, none, ["c"], out(("family", "f1"))).collect()}
    assert found == {"b": (True, False), "d": (True, False)}
    with pytest.raises(ValueError, match="unknown"):
        scope.compile_access(members, rules, none, ["c"], out(("famly", "f1")))
    with pytest.raises(ValueError, match="family_id"):
        scope.compile_access(members.drop("family_id"), rules, none, ["c"], out(("family", "f1")))
    with pytest.raises(ValueError, match="collections"):
        scope.compile_access(members, rules, none, [])


def test_a_scope_that_changed_gets_an_index_of_its_own(spark, tmp_path):
    ask = spark.createDataFrame([(1, "secret")], "query_id int, question string")
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, "secret plan"), (2, "open plan"), (3, "other"), (4, "words"), (5, "more")], "doc_id long, text string").write.parquet(path)
    first = registry._session(spark, spark.read.parquet(path), "doc_id").search(ask).collect()
    spark.createDataFrame([(2, "open plan"), (3, "other")], "doc_id long, text string").write.mode("overwrite").parquet(path)
    again = registry._session(spark, spark.read.parquet(path), "doc_id").search(ask).collect()
    assert [r.id for r in first] == [1] and again == []
    held = len(registry.SESSIONS.held)
    registry._session(spark, spark.read.parquet(path), "doc_id")
    assert len(registry.SESSIONS.held) == held and isinstance(registry.SESSIONS, packets.Scopes)


def bounded(nodes, edges, node_limit, edge_limit):
    """One edge after another."""
    kept, taken = set(), []
    for t, s, d, e in sorted(edges):
        if len(taken) >= edge_limit:
            break
        if len(kept | {s, d}) <= node_limit:
            kept |= {s, d}
            taken.append(e)
    for _, n in sorted(nodes):
        if len(kept) < node_limit:
            kept.add(n)
    return kept, sorted(taken)


@pytest.mark.parametrize(("node_limit", "edge_limit"), [(5, 6), (1, 3), (4, 100), (2, 1), (40, 2)])
def test_bounded_graphs_equal_taking_edges_one_by_one(spark, node_limit, edge_limit):
    rng = random.Random(node_limit * 100 + edge_limit)
    nodes, edges = [], []
    for g in range(1000 if node_limit == 5 else 150):
        own = [(rng.choice("xy"), f"n{k:02}") for k in rng.sample(range(30), rng.randint(1, 9))]
        nodes += [(g, t, n) for t, n in own]
        for k in range(rng.randint(0, 14)):
            edges.append((g, rng.choice("pq"), rng.choice(own)[1], rng.choice(own)[1], f"e{k:02}"))
    shown, taken = admission.bounded_graphs(
        spark.createDataFrame(nodes, "graph int, node_type string, node_id string"), spark.createDataFrame([*edges, (0, "p", "gone", nodes[0][2], "e99")], "graph int, edge_type string, src string, dst string, edge_id string"), node_limit, edge_limit
    )
    got_n, got_e = defaultdict(set), defaultdict(list)
    for r in shown.collect():
        got_n[r.graph].add(r.node_id)
    for r in taken.collect():
        got_e[r.graph].append(r.edge_id)
    for g in {n[0] for n in nodes}:
        kept, ids = bounded([n[1:] for n in nodes if n[0] == g], [e[1:] for e in edges if e[0] == g], node_limit, edge_limit)
        assert (got_n[g], sorted(got_e[g])) == (kept, ids), g


def folded(rows, budget):
    """A route by the operator's words, with plain sets; rows are (kind order, place, id, stage, kind, asks, rests, questions, hypotheses, evidence, sources)."""
    have = {k: set() for k in admission.REASONS}
    seeds, order, out, gone = [], [], [], {}
    linked = None

    def over(more):
        return next((admission.REASONS[k] for k in admission.REASONS if len(have[k] | set(more.get(k, ()))) > budget[k]), None)

    for _, _, i, stage, kind, asks, rests, questions, hypotheses, evidence, sources in sorted(rows):
        more = {"question": questions, "hypothesis": hypotheses, "evidence": evidence, "source": sources}
        more = more | {kind: [*more.get(kind, []), i]}
        if kind == "question":
            parent = (stage, None)
        elif not seeds:
            continue
        elif kind == "relation":
            inside = [h for h in rests if h in have["hypothesis"]]
            if not inside:
                continue
            if len(inside) < len(rests):
                gone.setdefault((kind, i), "reference_budget")
                continue
            parent = ("hypothesis", rests[0])
        else:
            if kind != "hypothesis" and linked is None:
                linked = set(have["hypothesis"])
            first = [("question", q) for q in seeds if q in asks]
            if kind != "hypothesis":
                first += [("hypothesis", h) for h in order if h in rests and h in linked]
            if not first or (kind == "hypothesis" and i in have["hypothesis"]):
                continue
            parent = first[0]
        if reason := over(more):
            gone.setdefault((kind, i), reason)
            continue
        for k, ids in (("question", questions), ("hypothesis", hypotheses), (kind, [i])):
            for x in ids:
                if x not in have[k]:
                    have[k].add(x)
                    gone.pop((k, x), None)
                    out.append((k, x, "seed" if kind == "question" else "expansion", *parent))
                    if k == "hypothesis":
                        order.append(x)
        if kind == "question":
            seeds.append(i)
        have["evidence"] |= set(evidence)
        have["source"] |= set(sources)
    return {(k, i, n, o, a, b, None) for n, (k, i, o, a, b) in enumerate(out, 1)} | {(k, i, None, "omitted", None, None, r) for (k, i), r in gone.items()}


def test_routes_equal_a_fold_of_each(spark):
    rng = random.Random(12)
    some = lambda letter, n, most: [f"{letter}{k}" for k in rng.sample(range(n), rng.randint(0, most))]
    rows = []
    for route in range(1500):
        for kind in admission.KINDS:
            for k in rng.sample(range(8), rng.randint(0, 5)):
                i = f"{kind[0]}{k}"
                rests = some("h", 8, 2) if kind != "relation" else [f"h{x}" for x in rng.sample(range(4), 2)]
                inner = kind in ("question", "relation")
                rows.append((route, rng.choice(["semantic", "lexical"]), rng.randint(1, 9), kind, i, [] if inner else some("q", 8, 3), rests, [] if inner else some("q", 8, 2), [] if inner or kind == "hypothesis" else some("h", 6, 1), some("e", 20, 3), some("s", 6, 2)))
    arrays = ", ".join(f"{c} array<string>" for c in ("asks", "rests", "questions", "hypotheses", "evidence", "sources"))
    frame = spark.createDataFrame(rows, f"route_id int, stage string, place int, kind string, id string, {arrays}").repartition(5)
    budget = {"question": 5, "hypothesis": 3, "timeline": 3, "gap": 2, "relation": 1, "evidence": 12, "source": 5}
    got = defaultdict(set)
    for r in admission.routes(frame, budget).collect():
        got[r.route_id].add(tuple(r)[1:])
    for route in range(1500):
        own = [(admission.KINDS.index(r[3]), r[2], r[4], r[1], r[3], *r[5:]) for r in rows if r[0] == route]
        assert got[route] == folded(own, budget), route
    assert len({x[6] for found in got.values() for x in found}) > 6
    assert admission.routes(frame.limit(0), budget).count() == 0
    with pytest.raises(ValueError, match="gap"):
        admission.routes(frame, {k: v for k, v in budget.items() if k != "gap"})


def test_chains_of_ten_thousand_links_in_few_rounds(spark, monkeypatch):
    n = 10_000
    rows = [(k, k - 1 if k else None, k != 7000) for k in range(n)] + [(n + 1, n + 2, True), (n + 2, n + 1, True), (n + 3, n + 1, True), (n + 4, -9, True), (n + 5, n + 4, True), (n + 6, 50, None), (n + 7, n + 7, True)]
    records = spark.createDataFrame(rows, "id int, prior int, seen boolean")
    rounds = []
    whole = type(records).checkpoint
    monkeypatch.setattr(type(records), "checkpoint", lambda self, *a, **b: rounds.append(1) or whole(self, *a, **b))
    found = {r.id: tuple(r)[1:] for r in chains.chains(records, "seen").collect()}
    assert len(rounds) <= 17  # 15 rounds and the first table; a cycle takes them all
    assert found[n - 1] == (0, n - 1, False, None) and found[6999] == (0, 6999, True, None) and found[0] == (0, 0, True, None)
    assert all(found[n + k] == (None, None, False, "cycle") for k in (1, 2, 3, 7))
    assert found[n + 4] == (n + 4, 0, False, "missing") and found[n + 5] == (n + 4, 1, False, "missing") and found[n + 6] == (0, 51, False, None)
    assert {(r.prior, r.successors) for r in chains.forks(records).collect()} == {(50, 2), (n + 1, 2)}


def test_a_cycle_takes_no_more_rounds_than_the_chains_and_blocks_need_no_order(spark, monkeypatch):
    n, rng = 3000, random.Random(3)
    names = [f"k{x}" for x in rng.sample(range(10**6), n)]
    rows = [(names[k], names[k - 1] if k % 12 else None, k % 40 != 7, k) for k in range(n)] + [(f"r{k}", f"r{(k + 1) % 9}", True, -1) for k in range(9)] + [("r_in", "r0", True, -2), ("out", "nowhere", True, -3), ("out2", "out", True, -4)]
    prior, seen = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    rounds, kept = [], chains.kept
    monkeypatch.setattr(chains, "BLOCK", 64)
    monkeypatch.setattr(chains, "kept", lambda rows, *a: rounds.append(1) or kept(rows, *a))
    rng.shuffle(rows)
    found = {r.id: r for r in chains.chains(spark.createDataFrame(rows, "id string, prior string, seen boolean, n int").repartition(3), "seen", ("n",)).collect()}
    assert len(rounds) <= 9  # log2(12) rounds and what finds that no more ends; by the number of records it was 13
    assert len(found) == len(rows) and all(found[r[0]].n == r[3] for r in rows)
    for i in prior:
        way = [i]
        while prior.get(way[-1]) in prior and len(way) < 20:
            way.append(prior[way[-1]])
        fault = "cycle" if len(way) == 20 else "missing" if prior[way[-1]] else None
        want = (None, None) if fault == "cycle" else (way[-1], len(way) - 1)
        assert tuple(found[i])[:5] == (i, *want, fault is None and all(seen[x] for x in way), fault)


def test_an_id_that_is_there_again_has_every_way(spark, monkeypatch):
    monkeypatch.setattr(chains, "BLOCK", 4)
    rng = random.Random(5)
    rows = [(run * 10 + line, run * 10 + line - 1 if line > 1 and rng.random() < 0.7 else None, rng.random() < 0.8) for run in range(40) for line in [rng.randint(1, 7) for _ in range(6)]]
    ways: dict[int, list] = defaultdict(list)
    for i, prior, seen in sorted(rows, key=lambda r: r[0]):  # priors are smaller
        known = [r for r in rows if r[0] == prior]
        ways[i] += [(i, i, 0, seen and prior is None, None if prior is None else "missing")] if not known else [(i, r, d + 1, v and seen, f) for _, r, d, v, f in ways[prior]]
    found = chains.chains(spark.createDataFrame(rows, "id int, prior int, seen boolean").repartition(2), "seen").collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(repr(w) for per in ways.values() for w in per)


def test_what_stands_is_visible_to_the_root(spark):
    rows = [(1, None, "a", 1, True), (2, 1, "a", 2, False), (3, 2, "a", 3, True), (4, None, "b", 1, True), (5, 4, "b", 2, True), (6, 4, "b", 2, True)]
    found = chains.standing(spark.createDataFrame(rows, "id int, prior int, target string, at int, seen boolean"), "seen").collect()
    assert {(r.target, r.id) for r in found} == {("a", 1), ("b", 6)}


def test_imports_resolve_keys_and_report_what_they_cannot(spark):
    rows = [
        ("a", "leaf", "x", "p", []), ("a", "mid", "m", "q", ["x", "x"]), ("a", "top", "t", None, ["m", "x"]), ("a", "top", "t2", None, ["m", "x"]),
        ("a", "bad", "u", "p", ["nowhere", "x"]), ("a", "bad", "v", "p", ["u"]), ("a", "bad", "l1", "p", ["l2"]), ("a", "bad", "l2", "p", ["l1", "x"]), ("a", "bad", "l3", "p", ["l1"]),
        ("a", "bad", "twice", "p", []), ("a", "bad", "twice", "q", []), ("a", "bad", "w", "p", ["twice"]), ("a", "bad", None, "p", []), ("b", "leaf", "x", "p", None), ("b", "mid", "m", "q", ["t"]), ("a", "bad", "n", "p", [None]), ("a", "bad", "own", "p", ["own"]),
    ]
    objects = spark.createDataFrame(rows, "import string, kind string, key string, payload string, refs array<string>")
    found = {(r["import"], r.key): (r.id, r.level, r.fault) for r in imports.resolved(objects, ["import"]).collect()}
    assert found["a", "x"] == (found["b", "x"][0], 0, None) and found["a", "m"][1:] == (1, None)
    assert found["a", "t"] == found["a", "t2"] and found["a", "t"][1] == 2 and found["a", "t"][0].startswith("top_")
    assert {k[1]: v[2] for k, v in found.items() if v[0] is None} == {"u": "unresolved", "v": "blocked", "l1": "cycle", "l2": "cycle", "l3": "blocked", "twice": "repeated", "w": "unresolved", None: "repeated", "n": "unresolved", "own": "cycle", "m": "unresolved"}
    assert imports.resolved(objects.limit(0), ["import"]).count() == 0


def test_deep_imports(spark):
    rows = [("o", f"k{k}", "p", [f"k{k - 1}"] if k else []) for k in range(45)]
    found = {r.key: r.level for r in imports.resolved(spark.createDataFrame(rows, "kind string, key string, payload string, refs array<string>")).collect()}
    assert found == {f"k{k}": k for k in range(45)}


def test_migration_maps_all_or_reports(spark):
    rows = spark.createDataFrame([("a", ["b", "c"], "open", 1), ("b", [], "closed", 2), ("c", ["zz"], "open", 3), ("d", None, "lost", 4), ("e", ["two"], "open", 5)], "id string, refs array<string>, state string, n int")
    mapping = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D"), ("e", "E"), ("two", "T1"), ("two", "T2"), ("a", "A")], "old_id string, new_id string")
    good, faults = imports.migrated(rows, mapping, "id", ["refs"], {"open": "candidate", "closed": "accepted"})
    assert {(r.id, tuple(r.refs), r.state, r.n) for r in good.collect()} == {("A", ("B", "C"), "candidate", 1), ("B", (), "accepted", 2)}
    assert {tuple(r) for r in faults.collect()} == {("c", "refs", "zz"), ("d", "state", "lost"), ("e", "refs", "two")}


def test_lineage_roles(spark):
    rows = [(1, "h1", None), (2, "h1", None), (3, "h2", "f"), (4, "h3", "f"), (5, "h2", "f"), (6, "h3", None), (7, None, None), (8, None, "f")]
    found = {r.source_id: (r.family, r.root_id, r.role) for r in scope.lineage_roles(spark.createDataFrame(rows, "source_id long, sha256 string, declared string")).collect()}
    assert found == {1: ("1", 1, "root"), 2: ("1", 1, "duplicate"), 3: ("f", 3, "root"), 4: ("f", 3, "derivative"), 5: ("f", 3, "duplicate"), 6: ("f", 3, "duplicate"), 7: ("7", 7, "root"), 8: ("f", 3, "derivative")}
    assert scope.lineage_roles(spark.createDataFrame(rows, "source_id long, sha256 string, declared string").limit(0)).agg(F.count("role")).first()[0] == 0


def test_reading_rooms_write_no_checkpoint_and_keep_their_decisions_by_id(spark, tmp_path, monkeypatch):
    def refuse(self, *a, **b):
        raise AssertionError("a checkpoint of rows takes several times the disk of a table in columns")

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", refuse)
    out = registry.QUERIES["reading_rooms"](spark, "/root/testdata/sf0.001")
    assert out.count() > 0


def test_route_candidates_with_one_id_are_seen_in_order_of_what_they_hold(spark):
    """However rows come, and lists of what is passed by are never asked for."""
    none, seen = [], []
    rows = [(1, "semantic", 1, "question", "q1", none, none, none, none, ["e1"], ["s"]), (1, "graph", 5, "gap", "g", ["q1"], none, none, none, ["e3"], ["s"]), (1, "graph", 5, "gap", "g", ["q1"], none, none, none, ["e2"], ["s"]), (1, "graph", 6, "gap", "h", ["q1"], none, none, none, ["e3"], ["s"])]
    arrays = ", ".join(f"{c} array<string>" for c in admission.CANDIDATE[4:])
    budget = dict.fromkeys(admission.REASONS, 9) | {"evidence": 2}
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, f"route_id int, stage string, place int, kind string, id string, {arrays}").coalesce(1)
        found = {(r.kind, r.id): r.outcome for r in admission.routes(frame, budget).collect() if r.kind == "gap" and r.outcome != "omitted"}
        assert found == {("gap", "g"): "expansion"}
    route = admission.Route(budget)
    route.see("semantic", "question", "q1", [], [], lambda: ([], [], [], []))
    route.see("graph", "gap", "g", ["q2"], [], lambda: seen.append(1))
    assert not seen


def test_imports_equal_a_walk_of_each_object(spark, monkeypatch):
    """Objects of no, one and several references, repeated and null keys and gaps, by import, broadcast and not."""
    rng = random.Random(8)
    rows = []
    for i in ("a", "b"):
        for k in range(40):
            refs = [rng.choice([f"k{rng.randrange(max(k // 4, 1))}"] * 12 + [f"k{rng.randrange(44)}", None]) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] if k else []
            rows.append((i, "x", None if k == 30 else f"k{k if k != 31 else 20}", f"p{k}", refs))
    frame = spark.createDataFrame(rows, "i string, kind string, key string, payload string, refs array<string>").repartition(4)
    want = Counter()
    for i in ("a", "b"):
        own = [r for r in rows if r[0] == i]
        count = Counter(r[2] for r in own)
        known = {r[2]: r[4] for r in own if r[2] is not None and count[r[2]] == 1}
        level = {}
        for _ in known:
            level |= {k: max((level[x] + 1 for x in refs), default=0) for k, refs in known.items() if all(x in level for x in refs)}
        left = {k: v for k, v in known.items() if k not in level and all(x in known for x in v)}
        loops = set(left)
        for _ in left:
            loops = {k for k in loops if any(x in loops for x in left[k]) and any(k in left[x] for x in loops)}
        for r in own:
            k = r[2]
            fault = "repeated" if k not in known else None if k in level else "unresolved" if k not in left else "cycle" if k in loops else "blocked"
            want[i, k, level.get(k) if k in known else None, fault] += 1
    for most in (100_000, 0):
        monkeypatch.setattr(imports, "BROADCAST_ROWS", most)
        found = imports.resolved(frame, ["i"]).collect()
        assert Counter((r.i, r.key, r.level, r.fault) for r in found) == want and all((r.id is None) == (r.level is None) for r in found)
    assert {f for *_, f in want} >= {None, "repeated", "unresolved"}


def test_routes_keep_only_the_first_of_each_kind(spark, monkeypatch):
    limits = {"question": 2, "hypothesis": 3, "timeline": 1, "gap": 2}
    terms = lambda k: [(f"w{(k * j) % 17}", 1 + j % 3) for j in range(k % 9)]
    objects = [(routing.KINDS[k % 4], f"o{k:03}", k, terms(k)) for k in range(150)] + [("gap", "none", 1, None), ("other", "o", 2, [("w1", 5)])]
    objects = spark.createDataFrame(objects, "kind string, id string, place long, terms array<struct<term:string,weight:int>>").repartition(3)
    asked = spark.createDataFrame([(q, [f"w{(q + j) % 20}" for j in range(q % 7)]) for q in range(30)] + [(99, None), (98, ["w1", "w1"])], "query_id long, terms array<string>")
    every = [tuple(r) for r in routing.ranked(asked, objects).select("query_id", "kind", "id", "place", "score").collect()]
    want = [r for k, n in limits.items() for q in {r[0] for r in every} for r in sorted((r for r in every if r[:2] == (q, k)), key=lambda r: (-r[4], r[2]))[:n]]
    for cells in (1_000_000, 40):
        monkeypatch.setattr(routing, "CELLS", cells)
        found = routing.best(asked, objects, limits)
        assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) < len(every)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # no pair of question and object is a row
    monkeypatch.setattr(routing, "BROADCAST_TERMS", 3)
    assert sorted(map(tuple, routing.best(asked, objects, limits).select(found.columns).collect())) == sorted(want)
    pairs = spark.createDataFrame([(q, k, i) for q, k, i, _, _ in every[::5]] + [(0, "gap", "o000"), (1, "gap", None)], "query_id long, kind string, id string")
    for listed in (10_000, 2):
        monkeypatch.setattr(routing, "LISTED_IDS", listed)
        assert sorted(map(tuple, routing.scored(pairs, asked, objects).collect())) == sorted((q, k, i, s) for q, k, i, _, s in every[::5])


def _odd_rooms(spark, rng, rooms=12, cross=False):
    """Rooms with nulls, repeated ids, priors that are not there, cycles and edges that lack an end."""
    pick = lambda *x: rng.choice(x)
    nodes, edges, decisions = [], [], []
    for room in range(rooms):
        kinds = {f"n{k}": (pick("part", "part", "supplier"), f"h{k % 3}") for k in range(9)}
        for _ in range(rng.randrange(1, 40)):
            i = f"n{rng.randrange(9)}"
            nodes.append((room, pick(1, 2, 3, None), pick(kinds[i][0], kinds[i][0], None), i, kinds[i][1], pick(["all"], ["all", "own", None], None), pick(5, 3, None)))
        nodes.append((room, 1, "part", None, "h", ["all"], 1))
        for _ in range(rng.randrange(30)):
            a, b = f"n{rng.randrange(9)}", pick(None, *(f"n{k}" for k in range(9)))
            edges.append((room, pick(1, 2, 3, None), pick("A", "B") if a < "n5" else None, a, b, f"{a}{b}" if a < "n5" else f"x{a}{b}"))
            edges[-1] = (*edges[-1][:2], "A" if a < "n3" else "B" if a < "n5" else None, *edges[-1][3:])
        for k in range(rng.randrange(25)):
            i, t = f"n{rng.randrange(9)}", rng.randrange(9)
            name = lambda k, room=room: f"d{k}" if cross else f"{room}.{k}"
            decisions.append((room, pick(name(k), name(k), name(rng.randrange(25)), None), pick(None, name(rng.randrange(25))), i, pick("part", "part", "part", None), kinds[i][1] if t else "old", pick("accept", "reject", "defer", None), pick(["all"], ["all"], ["own"], [], None, ["all", None]), pick("reading", "reading", "other"), pick(None, None, "n1", "gone"), len(decisions) if t else None))
    return (
        spark.createDataFrame(nodes, "room int, run int, node_type string, node_id string, content_hash string, collections array<string>, created int").coalesce(1).localCheckpoint(),
        spark.createDataFrame(edges, "room int, run int, edge_type string, src string, dst string, edge_id string").coalesce(1).localCheckpoint(),
        spark.createDataFrame(decisions, "room int, id string, prior string, target string, target_type string, target_hash string, action string, scope array<string>, `use` string, replacement string, at int").coalesce(1).localCheckpoint(),
    )


def test_rooms_made_in_one_task_equal_rooms_made_by_joins(spark, monkeypatch):
    asked = (["part"], ["all", "own"], "reading", 5, 4, 3)
    nodes, edges, decisions = _odd_rooms(spark, random.Random(3), 6)
    rows = lambda rooms, c: sorted(map(repr, (out := getattr(rooms, c)).select(sorted(out.columns)).collect()))
    parts = ["views", "nodes", "edges"]
    tables = []
    kept = reading_room.kept
    monkeypatch.setattr(reading_room, "kept", lambda *a: tables.append(1) or kept(*a))
    want = reading_room._wide(nodes, edges, decisions, *asked)
    tables.clear()
    found = reading_room.reading_rooms(nodes, edges, decisions, *asked)
    assert len(tables) == 1  # no step but the one pass writes a table
    want = {c: rows(want, c) for c in parts}
    assert {c: rows(found, c) for c in parts} == want and len(want["edges"]) >= 10
    monkeypatch.setattr(reading_room, "ROOM_ROWS", 60)  # larger rooms by joins, others in one task
    mixed = reading_room.reading_rooms(nodes, edges, decisions, *asked)
    assert {c: rows(mixed, c) for c in parts} == want and len(tables) > 3


def test_rooms_whose_decisions_share_ids_go_by_joins_and_disagreeing_runs_are_an_error(spark):
    asked = (["part"], ["all", "own"], "reading", 5, 4, 3)
    nodes, edges, decisions = _odd_rooms(spark, random.Random(4), 4, cross=True)
    assert reading_room._crossing(decisions) and not reading_room._crossing(decisions.filter("room = 1"))
    with pytest.raises(ValueError):
        reading_room.reading_rooms(nodes.unionByName(nodes.limit(1).selectExpr("1 AS room", "1 AS run", "'part' AS node_type", "'n1' AS node_id", "'other' AS content_hash", "collections", "created")).unionByName(nodes.limit(1).selectExpr("1 AS room", "2 AS run", "'part' AS node_type", "'n1' AS node_id", "'another' AS content_hash", "collections", "created")), edges, decisions.filter("room = 1"), *asked)
