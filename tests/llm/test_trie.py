"""The prefix trie against a plain one, with every cut of the order there can be."""

import hashlib
import random
import zlib

import pytest

from vouch.llm import trie


def plain(chats):
    """chats: {conv_id: [(role, text)]}; the contract, prefix by prefix."""
    nodes = {}
    for i, turns in chats.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(i)
    if not chats:
        return []
    sums = {n: [0, 0] for n in nodes}
    children = {n: 0 for n in nodes}
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            sums[n[:d]][0] += not children[n]
            sums[n[:d]][1] += (len(members) - 1) * (len(n[-1][1]) if n else 0)
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(i) for i in sorted(members) if len(chats[i]) == len(n))
        up = min(nodes[n[:-1]]) if n else None
        out.append((min(members), len(n), up, len(members), children[n], *sums[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, chats):
    rows = [(i, k, r, t) for i, turns in chats.items() for k, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def found(spark, chats, shard):
    return sorted(map(tuple, trie.trie(trie.turn_lists(table(spark, chats)), shard).collect()), key=str)


def test_twin(twin):
    twin(trie, "op11_prefix_trie")


@pytest.mark.parametrize("shard", [1, 3, 20, 10**6])
def test_shards_of_any_size(spark, shard):
    rng = random.Random(shard)
    chats = {i: [(rng.choice(["user", "tool"]), "abc"[: rng.randint(0, 2)]) for _ in range(rng.randint(1, 6))] for i in rng.sample(range(1000), 150)}
    chats |= {2000 + i: [("user", "hot"), ("assistant", "copy")] for i in range(120)}  # copies, cut through
    chats |= {3000 + i: [("user", "hot"), ("assistant", "copy"), ("user", str(i % 7))] for i in range(60)}
    assert found(spark, chats, shard) == plain(chats)


def test_every_cut_of_one_order():
    """All ways to place two splitters give the same sums, whatever they cut."""
    key = lambda t: hashlib.sha256(t.encode()).digest()[: trie.STEP]
    chats = {1: "ab", 2: "ab", 3: "a", 4: "abc", 5: "abc", 6: "b", 7: "", 8: "a", 9: "abd"}
    rows = sorted((b"".join(map(key, t)), i, [len(x) for x in t]) for i, t in chats.items())
    want = plain({i: [("", x) for x in t] for i, t in chats.items()})
    for a in range(len(rows)):
        for b in range(a, len(rows)):
            skeleton = trie.Skeleton([r[:2] for r in (rows[a], rows[b])] if a < b else [rows[a][:2]])
            out = []
            for number in range(len(skeleton.splitters) + 1):
                own = [r for r in rows if skeleton.shard(r[0], r[1]) == number]
                shard = trie.Shard(number, skeleton, out)
                for path, i, chars in own:
                    shard.add(i, path, chars)
                if own:
                    shard.end()
            bones, pieces = {}, {}
            for r in out:
                if r[0] is not None and r[3] is None:
                    old = bones.setdefault(r[:2], [r[4], *[0] * 4, r[7:9]])
                    old[0] = min(old[0], r[4])
                    for k in range(4):
                        old[k + 1] += r[9 + k]
                elif r[3] is not None:
                    pieces.setdefault(r[:2], []).append((r[2], r[3]))
            none = hashlib.sha256(b"").digest()
            got = [(r[4], r[5], r[6] if r[6] is not None else bones[r[7:9]][0], *r[9:13], (r[13] or none).hex()) for r in out if r[0] is None]
            for k, v in bones.items():
                ends = hashlib.sha256(b",".join(t for _, t in sorted(pieces.get(k, [])))).hexdigest()
                got.append((v[0], k[1], bones[v[5]][0] if v[5] != (None, None) else None, *v[1:5], ends))
            assert sorted(got, key=str) == want, (a, b)


def test_long_lists_of_ends_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    chats = {i: [("user", "x")] for i in range(50)} | {100: [("user", "y"), ("user", "z")], 101: [("user", "y"), ("user", "z")]}
    assert found(spark, chats, 5) == plain(chats) == found(spark, chats, 10**6)


def test_rebuilt_heads(spark):
    from pyspark.sql import functions as F

    chats = {i: [("user", f"{i}.{k}") for k in range(i % 9 + 1)] for i in [*range(0, 40), *range(300, 320), 507, -3, -200]}
    lists = trie.turn_lists(table(spark, chats))
    first = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    got = {r.conv_id: [t.chars for t in r.turns] for r in trie.rebuilt(lists, F.col("conv_id") - F.col("conv_id") % 100, first, 5).collect()}
    for i, turns in chats.items():
        h, base = zlib.crc32(str(i).encode()) % 6, i - (abs(i) % 100) * (1 if i > 0 else -1)
        assert got[i] == [len(t) for _, t in [*chats.get(base, [])[:h], *turns[h:]]]


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [(1, None, None, None), (1, 0, "user", long), (1, 0, "user", long), (2, 5, "b", "x"), (2, 5, "a", "y"), (2, 5, "a", "X"), (None, 0, "user", "lost"), (3, None, "", "")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, owner int, shard int, path int")
    chats = {1: [("", ""), ("user", long), ("user", long)], 2: [("a", "X"), ("a", "y"), ("b", "x")], 3: [("", "")]}
    assert sorted(map(tuple, trie.trie(trie.turn_lists(df)).collect()), key=str) == plain(chats)
    assert trie.trie(trie.turn_lists(df.limit(0))).collect() == []


def test_a_long_conversation(spark):
    chats = {i: [("user", str(k % 5)) for k in range(3_000 + i)] for i in range(3)}
    assert found(spark, chats, 500) == plain_long(chats)


def plain_long(chats):
    """plain() for conversations that start one another: linear."""
    n = sorted(chats, key=lambda i: len(chats[i]))
    deepest = len(chats[n[-1]])
    saved = [sum(len(chats[i]) >= d for i in n) - 1 for d in range(deepest + 1)]
    saved[0], total, out = 0, 0, []
    for d in range(deepest, -1, -1):
        total += saved[d]
        members = [i for i in n if len(chats[i]) >= d]
        ends = ",".join(str(i) for i in sorted(members) if len(chats[i]) == d)
        out.append((min(members), d, min(i for i in n if len(chats[i]) >= d - 1) if d else None, len(members), int(d < deepest), 1, total, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)
