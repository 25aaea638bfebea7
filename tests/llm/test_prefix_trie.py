"""Prefix trie: tree and merge against brute force, the query's rows, odd inputs."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

import __spark_entry__ as E
from fewshot_spark.llm import prefix_trie, radix
from fewshot_spark.session import read_table

SF001 = "/root/testdata/sf0.001"


def sha(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def brute_nodes(convs):
    """``convs``: id -> list of (role, text)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    own = {p: (len(m) - 1) * (len(p[-1][1]) if p else 0) for p, m in members.items()}
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = own[p] + sum(saved[k] for k in kids.get(p, []))
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha([c for c in m if len(convs[c]) == len(p)]))
        for p, m in members.items()
    }


def graft(convs):
    return {c: convs.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + t[zlib.crc32(str(c).encode()) % 6 :] for c, t in convs.items()}


def random_convs(n, seed, names="abc", most=7):
    rng = random.Random(seed)
    out = {}
    for c in rng.sample(range(10 * n), n):
        out[c] = [(rng.choice("ua"), rng.choice(names) * rng.randrange(1, 4)) for _ in range(rng.randrange(most))]
    return out


@pytest.mark.parametrize("batch", [1, 2, 7, 1000])
@pytest.mark.parametrize("names", ["ab", "abcdefghijklmnopqrstuvwxyz" * 12])
def test_batches_add_up_to_brute_force(batch, names):
    names = [*dict.fromkeys(names)] if len(names) < 30 else [f"w{i}" for i in range(300)]
    convs = random_convs(400, batch, names, 5)
    turn_key = {}
    for turns in convs.values():
        for t in turns:
            # ids that agree in their first bytes, so that branches lie inside an id
            turn_key[t] = bytes(10) + hashlib.md5(repr(t).encode()).digest()[:6]
    groups = {}
    for c, turns in convs.items():
        groups.setdefault(b"".join(turn_key[t] for t in turns), []).append(c)
    rows, low_of, merger = [], {}, radix.Merger()
    keys = sorted(groups)
    settled = []
    for at in range(0, len(keys), batch):
        tree = radix.Tree()
        for k in keys[at : at + batch]:
            m = groups[k]
            tree.insert(k, [len(t[1]) for t in convs[m[0]]], (len(m), min(m), sha(m)))
        closed, first, last = tree.rows()
        rows += closed
        settled += merger.take(first, last)
    settled += merger.leave(0)
    for x in settled:
        low_of[x[0]] = x[2]
    got = [(low, d, up if up is not None else low_of[dig], n, kids, lv, sv, ends) for low, d, up, dig, n, kids, lv, sv, ends, _ in rows]
    got += [(low, d, low_of.get(up), n, kids, lv, sv, ends) for _, up, low, d, n, kids, lv, sv, ends, _ in settled]
    want = brute_nodes(convs)
    assert len(got) == len(want) and set(got) == want


def test_layouts_grow_and_keep_their_children():
    node = radix.Node(b"", None, b"", ())
    order = random.Random(1).sample(range(256), 256)
    kinds = []
    for byte in order:
        node.adopt(radix.Node(bytes([byte, 7]), None, b"", ()))
        kinds.append((type(node.kids).__name__, getattr(node.kids, "room", None)))
    assert [kinds.index(k) for k in dict.fromkeys(kinds)] == [0, 4, 16, 48]
    assert [k.path[0] for k in node.children()] == list(range(256))
    assert node.kids.find(order[0]).path == bytes([order[0], 7])


def spark_nodes(df):
    cols = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))


def table(spark, convs, parts=4):
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)


def test_query_equals_brute_force(spark):
    convs = {}
    for r in sorted(read_table(spark, SF001, "conversations").collect(), key=lambda r: (r.conv_id, r.turn is not None, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = spark_nodes(E.queries()["op11_prefix_trie"](spark, SF001))
    assert got == sorted(map(str, brute_nodes(graft(convs))))


def test_many_copies_and_grafts(spark):
    convs = {c: t for c, t in random_convs(900, 3, "ab").items() if t}
    convs |= {c: [("u", "hot"), ("a", "same")] for c in range(20_000, 31_000)} | {c: [("u", "hot")] for c in range(31_000, 31_500)}
    df = prefix_trie.conversations(table(spark, convs))
    assert spark_nodes(prefix_trie.prefix_nodes(df)) == sorted(map(str, brute_nodes(convs)))
    assert spark_nodes(prefix_trie.prefix_nodes(prefix_trie.grafted(df))) == sorted(map(str, brute_nodes(graft(convs))))


def test_odd_turns(spark):
    kind = "conv_id long, turn long, role string, text string, turns string, low int"
    long = "é" * 300_000
    rows = [
        (1, None, "user", "first"), (1, 0, None, "x"), (1, 1, "user", None), (2, 0, "", "x"), (2, None, "user", "first"), (2, 1, "user", ""),
        (3, 5, "ab", "c"), (4, 5, "a", "bc"), (5, 0, "u", long), (6, 0, "u", long), (6, 1, "u", "t"), (7, 0, "r", "rep"), (7, 0, "r", "rep"),
        (None, 0, "u", "no conversation"), (-8, 0, "u", "neg"), (305, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], kind).repartition(3)
    one = [("user", "first"), ("", "x"), ("user", "")]
    convs = {1: one, 2: one, 3: [("ab", "c")], 4: [("a", "bc")], 5: [("u", long)], 6: [("u", long), ("u", "t")], 7: [("r", "rep")] * 2, -8: [("u", "neg")], 305: [("", "")]}
    assert spark_nodes(prefix_trie.prefix_nodes(prefix_trie.conversations(df))) == sorted(map(str, brute_nodes(convs)))
    assert prefix_trie.prefix_nodes(prefix_trie.grafted(prefix_trie.conversations(df.limit(0)))).count() == 0
