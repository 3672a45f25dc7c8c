"""The conversations' trie beside plain Python, with shards of any size."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeqc.llm import trie
from tapeqc.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth long"


def conversations():
    rng = np.random.default_rng(4)
    rows = []
    for c in [*range(0, 260), 1000, 1100, 1199, 100_000_000_001]:
        for k in range(int(rng.integers(1, 9))):
            rows.append((c, k, "ua"[k % 2], "hé"[: rng.integers(0, 3)] if k < 2 else f"t{rng.integers(0, 3)}", "x", 1))
    rows += [(100, 99, None, None, None, None), (100, None, "u", "no turn", None, None), (101, 3, "u", "tie b", None, None), (101, 3, "u", "tie a", None, None), (101, 3, "u", "tie a", None, None)]
    rows += [(None, 0, "u", "no conversation", None, None), (205, 7, "u", "x" * 20_000, None, None)]
    rows += [(300, k, "u", "same", None, None) for k in range(300)] + [(300 + c, k, "u", "same", None, None) for c in range(1, 60) for k in range(0, 300, 50)]
    return rows


def expected(rows, heads=6):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += not children[node]
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


key = lambda row: tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("nodes", [500_000, 7, 1])
def test_trie(spark, tmp_path, monkeypatch, nodes):
    monkeypatch.setattr(trie, "SHARD_NODES", nodes)
    rows = conversations()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    if nodes == 500_000:
        got = QUERIES["op12_conversation_trie"](spark, str(tmp_path)).collect()
    else:
        manifest = trie.write_tries(trie.rebuilt(spark.read.parquet(str(tmp_path / "conversations.parquet"))))
        assert manifest.count() > 20
        got = trie.nodes(manifest).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)


def test_empty_trie(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.nodes(trie.write_tries(trie.rebuilt(empty))).count() == 0
    assert trie.nodes(trie.write_tries(trie.rebuilt(spark.createDataFrame([(None, 1, "u", "x", "k", 1)], SCHEMA)))).count() == 0


def test_turnless_conversations(spark):
    rows = [(c, 0, "u", "one", None, None) for c in range(1, 40)]
    got = trie.nodes(trie.write_tries(trie.rebuilt(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)
    root = next(r for r in got if r.depth == 0)
    assert root.n_convs == 39 and root.parent_conv_id is None and root.ends_sha256 != hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("seed", range(6))
def test_parentheses(seed):
    rng = np.random.default_rng(seed)
    bits, depth = [1], 1
    for _ in range([1, 3, 70, 500, 5000, 4096][seed]):
        while depth > 1 and rng.random() < 0.1 + seed / 10:
            bits.append(0)
            depth -= 1
        bits.append(1)
        depth += 1
    bits = np.array(bits + [0] * depth, dtype=np.uint8)
    tree, stack, closes = trie.Parentheses(bits), [], {}
    for k, bit in enumerate(bits):
        if bit:
            stack.append(k)
        else:
            closes[stack.pop()] = k
    opens = np.flatnonzero(bits)
    assert tree.findclose(opens).tolist() == [closes[k] for k in opens]
    before = np.concatenate([[0], np.cumsum(2 * bits.astype(int) - 1)])
    assert tree.excess(opens).tolist() == before[opens].tolist()
    pairs = np.concatenate([[0], np.cumsum((bits[:-1] == 1) & (bits[1:] == 0))])
    assert tree.leaf_rank(opens).tolist() == pairs[opens].tolist()
    assert tree.bits(3, 50).tolist() == bits[3:50].tolist()


def test_rebuilt_heads(spark):
    rows = [(200, k, "u", f"base {k}", None, None) for k in range(8)] + [(c, k, "u", f"own {k}", None, None) for c in range(201, 212) for k in range(3)]
    got = {r.conv_id: r.weights for r in trie.rebuilt(spark.createDataFrame(rows, SCHEMA)).select("conv_id", F.size("weights").alias("weights")).collect()}
    assert got == {c: 8 if c == 200 else max(3, zlib.crc32(str(c).encode()) % 6) for c in [200, *range(201, 212)]}
