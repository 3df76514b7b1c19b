import itertools
import random

from pyspark.sql import functions as F

from halyard.llm import chat as C


def least(roles):
    best = [None]

    def go(i, state, cost):
        if best[0] is not None and cost >= best[0]:
            return
        if i == len(roles):
            best[0] = min(cost + C.ending(state)[0], best[0] if best[0] is not None else 10**9)
            return
        own = C.STATE_OF.get(roles[i])
        for t in (1, 2, 3):
            step = 0 if t == own else C.RELABEL
            if t == state:
                go(i + 1, t, cost + step + C.MERGE)
            for n in range(3):
                for between in itertools.product((1, 2, 3), repeat=n):
                    way = (state, *between, t)
                    if all(p in C.LEGAL for p in itertools.pairwise(way)):
                        go(i + 1, t, cost + step + n * C.INSERT)

    go(0, 0, 0)
    return best[0]


def test_least_cost():
    rng = random.Random(0)
    for _ in range(150):
        roles = [rng.choice(["system", "user", "assistant", None]) for _ in range(rng.randint(1, 6))]
        m = C.transfer(roles)[0]
        costs = [int(m[s]) + C.ending(s)[0] for s in range(4)]
        assert min(costs) == least(roles)
        end = costs.index(min(costs))
        assert sum(x[0] for x in C.trace(roles, 0, end)) + C.ending(end)[0] == min(costs)


def rows(spark):
    rng = random.Random(1)
    data = [(c, t, rng.choice(["system", "user", "assistant", "tool", None, " User "]), rng.choice(["hi", None, "", "né"]), "k") for c in range(40) for t in range(rng.randint(1, 9))]
    data += [(100, 0, "user", "twice", "k")] * 2 + [(None, 0, "assistant", "x", "k"), (101, None, "user", "late", "k"), (101, 3, "user", "early", "k")]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, cost string")


def test_rendered_conversations_are_legal_and_segments_agree(spark):
    df = rows(spark)
    whole = lambda d: {r["conv_id"]: (r["cost"], r["r"]) for r in d.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "rendered"))), lambda x: x["rendered"]), "").alias("r")).collect()}
    one, many = whole(C.repaired(df.where("turn is not null"))), whole(C.repaired(df.where("turn is not null"), 2))
    assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in many.items()}
    for _, text in one.values():
        roles = [x for x in text.split("\n") if x.startswith("<|")]
        body = [r[2:-2] for r in roles]
        body = body[1:] if body[0] == "system" else body
        assert body and len(body) % 2 == 0 and body == ["user", "assistant"] * (len(body) // 2)
    got = C.repaired(df).collect()
    assert sum(r["n_in"] for r in got) == df.count()
    assert C.repaired(df.limit(0)).count() == 0


def plain(rows):
    """Every conversation repaired on its own, over all ways, by the stated order and tie rules."""
    key = lambda x: (x is not None, x or "")
    by = {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, []).append((turn is None, turn or 0, key(role), key(text), turn, role, text))
    out = {}
    for conv_id, held in by.items():
        held = [r[4:] for r in sorted(held)]
        roles = [r if r in C.STATE_OF else None for r in ((r or "").strip().lower() for _, r, _ in held)]
        best = {len(roles): {s: C.ending(s)[0] for s in range(4)}}
        for i in range(len(roles) - 1, -1, -1):
            best[i] = {s: min([c + best[i + 1][t] for c, t, *_ in C.moves(s, roles[i])], default=C.FAR) for s in range(4)}
        state, text, total, ends = 0, "", 0, []
        for i, (_, _, words) in enumerate(held):
            c, t, between, joins, _ = min(m for m in C.moves(state, roles[i]) if m[0] + best[i + 1][m[1]] == best[i][state])
            total += c
            text += "".join(f"<|{C.ROLE_OF[b]}|>\n\n" for b in between) + ("" if joins else f"<|{C.ROLE_OF[t]}|>\n") + f"{words or ''}\n"
            ends.append(C.ROLE_OF[t])
            state = t
        text += "".join(f"<|{C.ROLE_OF[b]}|>\n\n" for b in C.ending(state)[1])
        total += C.ending(state)[0]
        assert total == best[0][0]
        out[conv_id] = (text, total, ends)
    return out


def whole(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r["position"]):
        text, cost, roles = out.get(r["conv_id"], ("", 0, []))
        out[r["conv_id"]] = (text + r["rendered"], cost + r["cost"], [*roles, r["role"]])
    return out


def test_rows_equal_brute_force_whatever_the_segment(spark):
    df = rows(spark)
    want = plain([tuple(r)[:4] for r in df.collect()])
    for segment in (1024, 3, 1):
        got = C.turns(df, segment)
        assert got.count() == df.count()
        assert whole(got) == want


def test_a_long_conversation_with_sparse_numbers_and_equal_turns(spark):
    rng = random.Random(7)
    data = [(1, rng.choice([None, 5, 5, 10**9 * rng.randint(0, 50)]), rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "b", None, "c" * 200])) for _ in range(2500)]
    data += [(2, 0, "user", "x")] * 1100
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(7)
    got = C.turns(df)
    assert whole(got) == plain(data)
    assert sorted(r["position"] for r in got.where("conv_id = 1").collect()) == list(range(2500))


def test_null_turns_come_in_the_stated_order(spark):
    data = [(1, None, r, t) for r, t in (("user", "B"), ("assistant", "A"), ("user", "C"), ("assistant", "D"))]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    (row,) = C.repaired(df).collect()
    assert [x for x in row["rendered"].split("\n") if len(x) == 1] == ["A", "D", "B", "C"] and row["segment"] == 0
