"""Operators 11 to 13 against brute-force versions, and on edge tables."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from conftest import SF
from fuzzcurve.llm import chosenpath, periods, registry, repair
from fuzzcurve.llm.common import read
from test_llm import ascii_words, brute_components, corpus, docs, edited, empty, prose  # noqa: F401

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

# 11


def brute_edits(rows):
    """(cost, audit, turns): every sequence of edits in order of its cost and letters, until one is well formed."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, shape, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, audit, out
        key = (i, shape[-1:], "s" in shape[:-1] or len(shape) > 1, len(audit))
        if key in done or len(audit) > 2 * len(rows) + 4:
            continue
        done.add(key)

        def step(cost, letter, i, *turn):
            new = shape + (turn[0][:1] if turn else "")
            if re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost, audit + letter, i, new, out + turn_of(turn)))

        turn_of = lambda turn: ((turn[0], turn[1]),) if turn else ()
        for role in ("user", "assistant"):
            step(cost + 5, "I", i, role, "")
        if i < len(rows):
            role, text, fault = rows[i]
            step(cost + 2, "D", i + 1)
            if fault in ("fine", "truncated"):
                more = 5 * (fault == "truncated")
                step(cost + more, "K", i + 1, role or "?", text)
                for new in ("user", "assistant"):
                    step(cost + more + 1, "R", i + 1, new, text)


def brute_repair(rows):
    """The query's columns for one conversation's rows (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "fine" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = brute_edits([(role, text, f) for (_, role, text), f in zip(rows, faults)])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "illegal": illegal, "cost": cost, "audit": audit,
        "repaired_sha256": sha("\n".join(f"{role}:{text}" for role, text in out)), **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
    }


def test_least_integer_is_the_least_edits():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice(["system", "user", "assistant", "assistant", "tool", "user"]), "x", rng.choice(["fine"] * 3 + ["truncated", "blank", "duplicate"])) for _ in range(rng.randrange(9))]
        got = repair.cheapest("".join(r[0] for r, *_ in rows), [("fine", "truncated", "blank", "duplicate").index(f) for *_, f in rows])
        assert got == brute_edits(rows)[:2], rows


@pytest.mark.parametrize("table", ["given", "made"])
def test_repair_query(spark, table, monkeypatch):
    if table == "made":
        rng = random.Random(4)
        rows = [(c, t, rng.choice(["user", "assistant", "system", "assistant", None, ""]), rng.choice(["Yes.", "no", "A b! ", " \t", "?", None, "é\n", "Yes."])) for c in range(60) for t in rng.sample(range(12), rng.randrange(1, 7))]
        rows += [(90, None, "user", "Hi."), (90, 3, "assistant", "Ho."), (91, None, "user", "Hi."), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS cost", "'y' AS phase").repartition(3)
        monkeypatch.setattr(repair, "read", lambda *_: df)
    else:
        rows = [tuple(r) for r in read(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    kept = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        say = lambda v: " " if v is None else str(v)
        fate, role, text, own = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20, say(role), say(text), kept.setdefault(conv, [])
        row = (turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
        own += [row] * (0 if fate == 0 else 2 if fate == 3 else 1)
    got = {r["conv_id"]: r.asDict() for r in registry.QUERIES["op11_repair"](spark, SF).collect()}
    assert set(got) == set(kept)
    for conv, own in kept.items():
        assert {k: got[conv][k] for k in brute_repair(own)} == brute_repair(own), (conv, own)


def test_repair_edges(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert repair.repair(spark.createDataFrame([], shape)).count() == 0
    gone = repair.repair(spark.createDataFrame([(1, 0, "user", "Hi.", True)], shape + ", gone boolean")).first()
    assert (gone["n_rows"], gone["cost"], gone["audit"], gone["repaired_sha256"]) == (0, 0, "", sha(""))
    long, many = "very long. " * 50_000, 1500
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, i, "ua"[i % 2] if i % 100 else "x", f"turn {i}.") for i in range(many)]
    got = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, shape)).collect()}
    assert got[1]["audit"] == "KK" and got[1]["repaired_sha256"] == sha(f"user:{long}\nassistant:{long}")
    assert got[2]["cost"] == many // 100 and got[2]["audit"].count("R") == many // 100 and got[2]["n_rows"] == many


# 12


def brute_runs(x):
    out = set()
    for q in range(1, len(x) // 4 + 1):
        j = 0
        while j + q < len(x):
            begin = j
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            n = j - begin + q
            if j > begin and n >= max(6, 4 * q) and not any((begin, n, p) in out for p in range(1, q)):
                out.add((begin, n, q))
            j += j == begin
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, most=6):
    x = []
    for _ in range(rng.randrange(1, most)):
        k = rng.randrange(1, 6)
        x += [rng.randrange(k) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 8) + [rng.randrange(k) + rng.choice([0, 0, 50]) for _ in range(rng.randrange(4))]
    return x


def test_lyndon_array():
    rng = random.Random(2)
    for _ in range(800):
        x = np.unique([rng.randrange(rng.randrange(1, 5)) for _ in range(rng.randrange(1, 40))], return_inverse=True)[1]
        y = x.tolist()
        longest = lambda i: max(k - i for k in range(i + 1, len(y) + 1) if all(y[i:k] < y[j:k] for j in range(i + 1, k)))
        assert periods.lyndon(x).tolist() == [longest(i) for i in range(len(y))]


def test_runs(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{v}" for v in repetitive(rng)) for _ in range(400)]
    texts += [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "x" * 70_000, " ".join(["ab cd ef"] * 20_000), "é\x0bé\x0cé é é é", " ".join(map(str, range(5000))) + " z" * 9]
    rows = list(enumerate(texts)) + [(None, texts[0]), (7, "b b b b b b b"), (7, texts[7])]
    got = periods.periodic_runs(spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, start string, n_runs long").repartition(3)).collect()
    want = []
    for i, t in rows:
        w = [x.decode() for x in ascii_words(t)]
        runs = brute_runs(w) if len(set(w)) < 3000 and len(w) < 20_000 else [(5000, 9, 1)] if t[-1] == "z" else [(0, 60_000, 3)]
        keep = [True] * len(w)
        for s, n, q in runs:
            keep[s + q : s + n] = [False] * (n - q)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
        want.append((i, len(w), len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for x, k in zip(w, keep) if k))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert periods.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 13


def test_near_duplicates(corpus, docs, empty):  # noqa: F811
    got = chosenpath.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    want = brute_components(corpus, percent=85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert chosenpath.near_duplicates(empty).count() == 0


def test_texts_of_one_id_link_through_it(spark):
    rng = random.Random(8)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (5, a), (5, b), (9, edited(rng, b, 0.01)), (6, prose(rng, 80))]
    got = chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (5, 1), (5, 1), (6, 6), (9, 1)]


def test_large_nodes_branch_and_are_compared_in_blocks(spark, monkeypatch):
    """Families of which some pairs link: leads, deeper levels and blocks find what pairs of all would."""
    for name, value in (("SMALL", 6), ("BLOCK", 5), ("COLUMNS", 50)):
        monkeypatch.setattr(chosenpath, name, value)
    for share, sizes in ((0.004, (100,)), (0.014, (100, 200))):  # nearly all pairs link, and few
        for n in sizes:
            rng = random.Random(11)
            base = prose(rng, 150)
            rows = [(i, edited(rng, base, share)) for i in range(n)] + [(1000 + i, prose(rng, 50)) for i in range(20)]
            got = chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
            assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, percent=85)


def test_trees_reach_the_recall():
    """The chance worked out is the chance seen, for sets that just link and nodes of the deepest level."""
    rng = np.random.default_rng(5)
    for percent, depth in ((85, 4), (85, chosenpath.DEEPEST)):
        met, trials = 0, 1500
        for _ in range(trials):
            tokens = rng.integers(0, 2**16, (2, chosenpath.COORDINATES), dtype=np.uint16)
            same = rng.random(chosenpath.COORDINATES) < percent / 100
            tokens[1, same] = tokens[0, same]
            root = rng.integers(0, 2**63, 1, dtype=np.int64).view(np.uint64)
            node, row = np.repeat(root, 2), np.arange(2)
            for _ in range(depth):
                node, row = chosenpath.descend(node, row, tokens, percent)
            met += bool(np.intersect1d(node[row == 0], node[row == 1]).size)
        assert abs(met / trials - chosenpath.survival(percent, depth)) < 0.06
    trees = chosenpath.trees_for(0.999, 85)
    assert 1 - (1 - chosenpath.survival(85, chosenpath.DEEPEST)) ** trees >= 0.999 > 1 - (1 - chosenpath.survival(85, chosenpath.DEEPEST)) ** (trees - 1)


# ids that several texts share


def reused(spark):
    """A and B under one id: A stands before and loses all, B is nowhere else and loses nothing."""
    rng = random.Random(21)
    a, b, c = (prose(rng, 60).replace("\n", "") for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, b), (6, c), (7, c), (7, a), (None, a)]
    return spark.createDataFrame([(i, t, "h", "x") for i, t in rows], "doc_id long, text string, source string, start string").repartition(3), a, b, c


def test_texts_of_one_id_lose_their_own_words_only(spark):
    from fuzzcurve.llm import substring, suffix

    df, a, b, c = reused(spark)
    want = sorted([(1, a, 0), (5, "", 60), (5, b, 0), (5, b, 0), (6, c, 0), (7, "", 60), (7, "", 60), (None, a, 0)], key=repr)
    assert sorted([(r["doc_id"], r["text"].strip(), r["n_removed"]) for r in substring.substring_dedup(df).collect()], key=repr) == want
    got = suffix.suffix_dedup(df).collect()
    want = [(1, a, 0), (5, "", len(a)), (5, b, 0), (5, b, 0), (6, c, 0), (7, "", len(c)), (7, "", len(a)), (None, a, 0)]
    assert sorted([(r["doc_id"], bytes(r["kept"]).decode(), r["n_removed"]) for r in got], key=repr) == sorted(want, key=repr)


def test_pipeline_keeps_texts_of_reused_ids(spark, tmp_path):
    import corpus_pipeline as p

    df, a, b, c = reused(spark)
    out = p.near_duplicates(spark, df, str(tmp_path))
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(1, a), (5, b), (6, c), (None, a)], key=repr)


def test_long_conversations_fold_in_linear_time():
    import time

    from fuzzcurve.llm import chat

    took = []
    for n in (10_000, 40_000):
        messages, order, begin = {}, [], time.perf_counter()
        for i in range(n):
            for kind in ("start", "delta", "regenerate", "delta"):
                chat.fold(messages, order, kind, i, "assistant", "x")
        took.append(time.perf_counter() - begin)
        assert len(messages) == n and all(m[1] == ["x"] for m in messages.values())
        chat.fold(messages, order, "regenerate", 3, None, None)
        assert list(messages) == [0, 1, 2, 3]
    assert took[1] < 12 * took[0]
