import hashlib
import random
import re
import zlib

import pytest

from quern.llm import queries, turns

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def plan(rows):
    """Least (cost, audit, repaired) of (role, text, fault) rows, over all edits, by the contract's words: state by state."""
    best = {"": (0, "", ())}

    def closed(best):
        for _ in range(2):
            for q, (c, a, t) in list(best.items()):
                to, who = {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}[q]
                new = (c + 5, a + "I", (*t, who + ":"))
                if to not in best or new < best[to]:
                    best[to] = new
        return best

    best = closed(best)
    for role, text, fault in rows:
        after = {}

        def put(q, new, after=after):
            if q not in after or new < after[q]:
                after[q] = new

        late = 5 if fault == "truncated" else 0
        for q, (c, a, t) in best.items():
            put(q, (c + 2, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            i = role[:1]
            if (i == "s" and q == "") or (i == "u" and q != "u") or (i == "a" and q == "u"):
                put(i, (c + late, a + "K", (*t, f"{role}:{text}")))
            to, who = ("a", "assistant") if q == "u" else ("u", "user")
            put(to, (c + 1 + late, a + "R", (*t, f"{who}:{text}")))
        best = closed(after)
    return min(best[q] for q in ("", "a") if q in best)


def brute(rows):
    """conv_id -> what the operator has to say, of (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv), key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
        seen, marked = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, said = plan(marked)
        numbers = [t for t, _, _ in own if t is not None]
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(own, own[1:], strict=False)]
        count = lambda f: sum(m[2] == f for m in marked)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (len(own), count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), gaps, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def say(rng):
    return rng.choice(["Yes.", "No!", "Why?", "and then", "", " \n", "Well. ", "é.", "ok", f"n{rng.randrange(9)}."])


def made(rng, conv, n):
    rows = []
    for k in range(n):
        rows.append((conv, rng.choice([k, k, k + 3, None, k // 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]), rng.choice([say(rng), None, say(rng) + str(k) + "."])))
        if rng.random() < 0.15:
            rows.append(rows[-1])
    return rows


def found_in(spark, rows, schema="conv_id long, turn long, role string, text string"):
    return {r.conv_id: tuple(r)[1:] for r in turns.repair(spark.createDataFrame(rows, schema)).collect()}


def test_repairs_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [r for c in range(120) for r in made(rng, c, rng.randint(1, 9))] + made(rng, None, 7)
    assert found_in(spark, rows) == brute(rows)


def test_a_conversation_over_many_tasks(spark):
    """One conversation with most of the rows lies in many tasks; its stretches have to agree on one least audit."""
    rng = random.Random(9)
    rows = made(rng, 7, 1500) + [r for c in range(20) for r in made(rng, c + 10, 3)]
    shuffle, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert found_in(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.mark.parametrize("seed", range(3))
def test_layers_and_trace_equal_a_plain_plan(seed):
    rng = random.Random(seed)
    for _ in range(400):
        marked = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.choice([None, None, "blank", "truncated", "duplicate"])) for _ in range(rng.randint(0, 14))]
        code = {None: 0, "blank": 1, "duplicate": 2, "truncated": 3}
        kinds = bytes({"s": 1, "u": 2, "a": 3}.get(r[0], 0) + 4 * code[f] for r, _, f in marked)
        cut = rng.randint(0, len(kinds))
        words, bases = turns.layers_of(kinds, turns.END)
        audit, _, cost = turns.trace(kinds, words, bases, 0, True)
        assert (cost, audit) == plan(marked)[:2]
        # two stretches by their tables give the same
        tail, _ = turns.layers_of(kinds[cut:], turns.END), None
        behind = turns.costs_of(tail[0][0], tail[1][0])
        table = turns.table_of(kinds[:cut])
        assert min(table[0][t] + behind[t] for t in range(4)) == cost


def test_repaired_roles_are_of_the_grammar(spark):
    rng = random.Random(5)
    for _ in range(200):
        marked = [(rng.choice(["user", "assistant", "system", "x"]), f"t{k}", rng.choice([None, "blank", "truncated"])) for k in range(rng.randint(0, 12))]
        assert GRAMMAR.match("".join(x[0] for x in plan(marked)[2]))


def test_other_kinds_of_keys_and_columns(spark):
    rows = [("b", 1, "user", "Hi.", 5), ("b", 2, "assistant", "Hello.", 5), ("a", 1, "assistant", "x" * 200_000 + ".", 5)]
    found = found_in(spark, rows, "conv_id string, turn int, role string, text string, kind int")
    assert found["b"][7:8] == ("KK",) and found["a"][6:8] == (2, "D")
    assert found_in(spark, [r for r in rows if False], "conv_id string, turn int, role string, text string, kind int") == {}


def test_damage_of_the_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["Hi. You!", "so", None])) for c in [*range(30), None] for t in [*range(4), None]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    left = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        how = zlib.crc32(f"{c if c is not None else ' '}:{t if t is not None else ' '}".encode()) % 20
        new = (c, t, "user" if how == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(how, text))
        left += [new] * {0: 0, 3: 2}.get(how, 1)
    want = brute(left)
    found = {r.conv_id: r for r in queries.op12_turn_repair(spark, str(tmp_path)).collect()}
    assert set(found) == {r[0] for r in rows}
    for c, r in found.items():
        w = want.get(c, (0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.gaps, r.cost, r.audit, r.repaired_sha256) == w[1:]
