"""Prefix trie and structure repair of conversations against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchyard.llm import queries as Q
from switchyard.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def some_turns(seed, n=40):
    """Conversations with shared beginnings, copies, nulls, ties and repeated rows."""
    rnd = random.Random(seed)
    rows, parts = [], ["a", "b.", "", None, "d e!", "ü?"]
    for c in [*range(n), -3, -7, 10**12]:
        if rnd.random() < 0.3:
            script = [("user", "hello."), ("assistant", "hi.")] * 3
        else:
            script = [(rnd.choice(["user", "assistant", "system", None, ""]), rnd.choice(parts)) for _ in range(rnd.randint(1, 11))]
        for i, (role, text) in enumerate(script):
            rows.append((c, None if rnd.random() < 0.05 else i, role, text))
    rows += rnd.sample(rows, 5) + [(None, 1, "user", "nobody.")]
    rnd.shuffle(rows)
    return rows


def code(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def in_order(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, code(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in found.items()}


def slow_trie(convs):
    """Nodes of {conv_id: turns}, by definition."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in list(members):
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    return {(min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node], saved[node],
             hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, own in members.items()}


def rows_of(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def first_id(c):
    return c - (abs(c) % 5) * (1 if c > 0 else -1)


def test_find_close_on_random_parentheses():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 40, 3000, 40_000):
        for climb in (0.5, 0.9):
            bits, depth, left = [], 0, n
            while left or depth:
                up = left and (depth == 0 or rnd.random() < climb)
                bits.append(bool(up))
                depth, left = depth + (1 if up else -1), left - bool(up)
            want, stack = {}, []
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    want[stack.pop()] = i
            p = trie.Parentheses(np.array(bits))
            opens = np.flatnonzero(p.bits)
            assert p.find_close(opens).tolist() == [want[i] for i in opens.tolist()]
            assert p.leaf_pairs().tolist() == [want[i] == i + 1 for i in opens.tolist()]


@pytest.mark.parametrize(("small", "spines"), [(1 << 12, 1 << 12), (8, 1 << 12), (8, 8)])
def test_trie_in_shards_and_levels(spark, small, spines):
    rows = some_turns(3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit("x")).withColumn("key", F.lit(1))
    assert rows_of(trie.nodes(trie.paths(df), small_shard=small, spines=spines)) == slow_trie(in_order(rows))


def test_trie_of_copies_of_one_conversation(spark):
    """Members of one node over all shards, in the order of their numbers."""
    rows = [(c, i, "user", t) for c in range(300) for i, t in enumerate(("a", "b") if c % 3 else ("a",))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(trie.nodes(trie.paths(df), small_shard=50, spines=8)) == slow_trie(in_order(rows))


def test_trie_of_a_long_conversation(spark):
    long = [(1, i, "user", str(i)) for i in range(300)] + [(2, i, "user", str(i)) for i in range(299)] + [(3, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame(long, SCHEMA)
    assert rows_of(trie.nodes(trie.paths(df), small_shard=100)) == slow_trie(in_order(long))


def test_rebuilt_conversations(spark):
    rows = some_turns(5)
    own = in_order(rows)
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = own.get(first_id(c), [])[:h] + turns[h:]
    found = {r.conv_id: r for r in trie.rebuilt_paths(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {c: bytes(r.path).hex() for c, r in found.items()} == {c: "".join(code(*t) for t in turns) for c, turns in convs.items()}
    assert any(not turns for turns in convs.values())
    df = trie.rebuilt_paths(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(trie.nodes(df, small_shard=8, spines=8)) == slow_trie(convs)


def write_conversations(spark, folder, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    df.withColumn("gone", F.lit("x")).withColumn("first_id", F.lit(2)).withColumn("turns", F.lit(3)).write.parquet(f"{folder}/conversations.parquet")


def test_conversation_queries_on_an_empty_table(spark, tmp_path):
    write_conversations(spark, tmp_path, [])
    assert Q.op11_prefix_trie(spark, str(tmp_path)).collect() == []
    assert Q.op12_repair(spark, str(tmp_path)).collect() == []


# ------------------------------------------------------------------- repair
def cheapest(initials, go, cut):
    """Least cost and least audit, by the shortest path through the grammar's automaton."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    queue, done = [(0, "", 0, 0)], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(initials) and state in (0, 3):
            return cost, audit
        moves = [(3, "I", i, step.get((state, r))) for r in "ua"]
        if i < len(initials):
            moves.append((4, "D", i + 1, state))
            if not go[i]:
                moves.append((3 * cut[i], "K", i + 1, step.get((state, initials[i]))))
                moves += [(3 + 3 * cut[i], "R", i + 1, step.get((state, r))) for r in "ua"]
        for more, edit, j, to in moves:
            if to is not None:
                heapq.heappush(queue, (cost + more, audit + edit, j, to))


def slow_repair(conv, rows):
    """The result of one conversation's damaged rows (turn, role, text), by definition."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    blank = [re.search(r"[^\x20\x09-\x0D]", t) is None for _, _, t in rows]
    twice = [not b and (r[1:] in [x[1:] for x in rows[:i]]) for i, (r, b) in enumerate(zip(rows, blank))]
    cut = [not b and not d and re.findall(r"[^\x20\x09-\x0D]", t)[-1] not in ".!?" for (_, _, t), b, d in zip(rows, blank, twice)]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = cheapest(initials, [b or d for b, d in zip(blank, twice)], cut)
    turns = [t for t, _, _ in rows if t is not None]
    at, lines = iter(rows), []
    kept = [e for e in audit if e != "D"]
    kept_initial = None
    for edit, row in zip([e for e in audit if e != "I"], rows):
        if edit != "D":
            kept_initial = kept_initial or (edit, row[1][:1])
    system = bool(kept) and kept[0] == "K" and kept_initial == ("K", "s")
    position = 0
    for edit in audit:
        role = "assistant" if (position - system) % 2 else "user"
        if edit == "I":
            lines.append(f"{role}:")
        else:
            _, own, text = next(at)
            if edit != "D":
                lines.append(f"{own if edit == 'K' else role}:{text}")
        position += edit != "D"
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (conv, gaps, sum(blank), sum(twice), sum(cut), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def slow_damage(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is None:
            continue
        fault = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        out[c] += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def test_alignment_is_the_cheapest_and_least():
    rnd = random.Random(2)
    for _ in range(2500):
        n = rnd.choice([0, 1, 2, 3, 5, 8, 20])
        roles = [rnd.choice("uuaas x") if rnd.random() < rnd.choice([0.1, 1]) else "ua"[i % 2] for i in range(n)]
        go = [rnd.random() < 0.15 for _ in roles]
        cut = [not g and rnd.random() < 0.3 for g in go]
        assert repair.Alignment(roles, go, cut).best()[:2] == cheapest(roles, go, cut), (roles, go, cut)


def test_alignment_of_hundreds_of_turns():
    rnd = random.Random(7)
    roles = ["ua"[i % 2] if rnd.random() < 0.9 else "u" for i in range(600)]
    go = [rnd.random() < 0.1 for _ in roles]
    a = repair.Alignment(roles, go, [False] * 600)
    assert a.best()[:2] == cheapest(roles, go, [False] * 600)
    assert len(a.checkpoints) < 40


def test_repair_query(spark, tmp_path):
    rows = some_turns(11, 150) + [(5000 + i, 0, "user", "One only.") for i in range(60)]
    rows += [(7000, i, ("user", "assistant")[i % 2], "word. " * 2000) for i in range(300)]
    write_conversations(spark, tmp_path, rows)
    damaged = slow_damage(rows)
    want = {slow_repair(c, damaged[c]) for c in {r[0] for r in rows if r[0] is not None}}
    assert rows_of(Q.op12_repair(spark, str(tmp_path))) == want
    assert any(not damaged[c] for c in damaged), "a conversation without rows is among them"


def test_repaired_text_follows_the_grammar(spark):
    rows = some_turns(13, 80)
    out = repair.repair(repair.damage(spark.createDataFrame(rows, SCHEMA))).collect()
    for r in out:
        assert hashlib.sha256(r.repaired.encode()).hexdigest() == r.repaired_sha256
        initials = "".join(line[:1] for line in r.repaired.split("\n"))
        assert re.fullmatch("(s?(ua)+)?", initials), r
