import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from topiclake.llm import conversations as cv
from topiclake.llm.queries import Q

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = "[^\x20\x09-\x0d]"


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out[conv]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            own += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, result) by a walk over (rows done, state), settled in order of cost and letters.

    ``rows``: (role, text, must go, cut off)."""
    turn = {0: "user", 1: "user", 3: "user", 2: "assistant"}
    go = {"user": 2, "assistant": 3}
    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    best = {0: (0, "", ())}
    for i in range(len(rows) + 1):
        # Up to three insertions, whatever they are good for.
        for _ in range(3):
            for state, (c, a, out) in list(best.items()):
                new = (c + 3, a + "I", (*out, (turn[state], "")))
                to = go[turn[state]]
                if to not in best or new < best[to]:
                    best[to] = new
        if i == len(rows):
            break
        role, text, gone, cut = rows[i]
        after = {}

        def offer(state, cost, letter, more):
            c, a, out = best[state]
            new = (c + cost, a + letter, out + more)
            to = cv_to
            if to not in after or new < after[to]:
                after[to] = new

        for state in best:
            cv_to = state
            offer(state, 4, "D", ())
            if not gone:
                cv_to = go[turn[state]]
                offer(state, 3 + 3 * cut, "R", ((turn[state], text),))
                if (role[:1], state) in keep:
                    cv_to = keep[role[:1], state]
                    offer(state, 3 * cut, "K", ((role, text),))
        best = after
    return min(best[s] for s in (0, 3) if s in best)


def brute(rows):
    out = []
    for conv, own in damage(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults, steps = set(), Counter(), []
        for _, role, text in own:
            solid = re.findall(SPACE, text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            steps.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        roles = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, audit, result = cheapest(steps)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=str)


def run(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in cv.repair(df).collect()), key=str)


def made(seed, convs, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "Usage", "u"]
    texts = ["Hello.", "Hello", "What now?", " \t", None, "", "Fine! ", "x y z", "中文。", "end."]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(roles[:2]) if rng.random() < 0.7 else rng.choice(roles)
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {turn // 2}{rng.choice(['.', '', '?'])}"
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 3]), role, text))
    return rows


def test_short_conversations_equal_brute_force(spark):
    rows = made(1, 300, 9)
    assert run(spark, rows) == brute(rows)


def test_a_conversation_with_most_rows(spark):
    """Several segments and partitions for one conversation."""
    rows = made(2, 20, 6) + [(7000, t, r, x) for _, t, r, x in made(3, 60, 60)]
    rows += [(8000, i, ["user", "assistant"][i % 2], "again.") for i in range(700)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    keys = [(c, t) for c in range(200) for t in range(3)]
    dropped = [c for c in range(200) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,))]
    rows = [(dropped[0], 0, "user", "gone."), (None, None, None, None), (None, 3, "user", "a."), (None, 3, "user", "a."),
            (5001, None, "user", "a?"), (5001, None, "assistant", "b"), (5002, 1, "system", "only"),
            (5003, 1, "assistant", "x" * 300_000 + "."), (5004, -5, "user", "ünï."), (5004, 9, "assistant", "\n.\n")]
    assert keys and run(spark, rows) == brute(rows)
    got = {r[0]: r for r in run(spark, rows)}
    assert got[dropped[0]][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark, []) == []
    assert run(spark, [(None, 1, None, None)]) == brute([(None, 1, None, None)])
    wide = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("at"), F.lit("x").alias("_text"), F.lit(0).alias("cost"))
    assert sorted((tuple(r) for r in cv.repair(wide).collect()), key=str) == brute(rows)


def test_products_may_be_bracketed_in_any_way():
    rng = random.Random(5)
    for _ in range(60):
        symbols = "".join(rng.choice(cv.SYMBOLS) for _ in range(rng.randint(1, 14)))
        parts = [cv.row_matrix(s) for s in symbols]
        left = parts[0]
        for p in parts[1:]:
            left = cv.product(left, p)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [cv.product(parts[i], parts[i + 1])]
        plain = [[None if e is None else (e[0], str(e[1])) for e in row] for row in left]
        assert plain == [[None if e is None else (e[0], str(e[1])) for e in row] for row in parts[0]]
        path = cv.Path()
        path.add(left)
        rows = [(s.lower() if s != "d" else "u", "t", s == "d", s.isupper()) for s in symbols]
        assert path.end() == cheapest(rows)[:2]


def test_grammar_repeats_and_expands(spark):
    texts = ["uaua" * 10, "suaua", "uAuAdd", "uuuuuuu", "d"] * 30
    df = spark.createDataFrame([(t,) for t in texts], "symbols string").repartition(5)
    grammar = cv.learn(df)
    assert grammar.rounds
    parts = {new: pair for rules in grammar.rounds for pair, new in rules.items()}

    def expanded(s):
        return cv.SYMBOLS[s] if s < len(cv.SYMBOLS) else expanded(parts[s][0]) + expanded(parts[s][1])

    for t in set(texts):
        short = grammar.replace(cv.parse(t))
        assert "".join(map(expanded, short)) == t
    assert len(grammar.replace(cv.parse("uaua" * 10))) <= 3
    # Pairs of a round share no symbol.
    for rules in grammar.rounds:
        used = [s for pair in rules for s in set(pair)]
        assert len(used) == len(set(used))
    assert cv.learn(spark.createDataFrame([], "symbols string")).rounds == []


def test_query(spark, tmp_path):
    rows = made(9, 30, 8)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted((tuple(r) for r in Q["op13_conversation_repair"](spark, str(tmp_path)).collect()), key=str) == brute(rows)
