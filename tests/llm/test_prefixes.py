"""Prefix trie against a trie built from the rebuilt conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

from framelens.llm import prefixes

BASE, HEADS = "conv_id - conv_id % 5", "crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % 9"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in own.items()}
    member = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        s = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(s) + 1):
            member[s[:d]].append(c)
        ends[s].append(c)
    kids = defaultdict(list)
    for k in member:
        if k:
            kids[k[:-1]].append(k)
    below = lambda k: [k] + [v for x in kids[k] for v in below(x)]
    out = []
    for k, cs in member.items():
        sub = below(k)
        out.append((cs[0], len(k), member[k[:-1]][0] if k else None, len(cs), len(kids[k]), sum(not kids[v] for v in sub),
                    sum((len(member[v]) - 1) * len(v[-1][1].encode()) for v in sub if v), hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted((tuple(r) for r in prefixes.trie(df, BASE, HEADS, **kw).select(COLUMNS).collect()), key=str)


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = [(None, 1, "user", "lost"), (7, 3, None, None), (7, None, "user", "first"), (7, None, "user", "first"), (7, None, "user", "ä")]
    for c in rng.sample(range(400), 120):
        rows += [(c, t, rng.choice(("user", "assistant", None)), rng.choice(("a", "bb", "", None))) for t in range(rng.randrange(1, 12))]
    # one conversation of many turns, many of one first turn, and ids without a base
    rows += [(1000, t, "user", f"turn {t % 50}") for t in range(700)] + [(c, 0, "user", "hello") for c in range(2001, 2200)]
    assert got(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert got(spark, []) == []
    for row in ((3, 0, "user", "x"), (5, 0, None, None)):
        assert got(spark, [row]) == brute([row])


def test_colliding_residues_are_found_and_tried_again(spark, monkeypatch):
    """With moduli this small unlike prefixes share fingerprints; verification rejects them until the moduli are restored."""
    rows = [(c, t, "user", f"{c} {t}") for c in range(0, 60, 5) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(prefixes, "PRIMES", (3, 3, 3))
    monkeypatch.setattr(prefixes, "BASES", (2, 2, 2))
    scratch = prefixes.Scratch(spark)
    turns = prefixes.placed_turns(df, scratch)
    members = prefixes.members(turns, "conv_id", "0", scratch)
    assert prefixes.differing(members, prefixes._grouped(members), turns) > 0
    monkeypatch.undo()
    assert got(spark, rows) == brute(rows)


def test_digest_of_a_long_list(spark):
    df = spark.range(30_000).selectExpr("CAST(id % 3 = 0 AS BIGINT) AS k", "id AS v").repartition(7)
    expected = {k: hashlib.sha256(",".join(str(v) for v in range(30_000) if (v % 3 == 0) == k).encode()).hexdigest() for k in (False, True)}
    assert {bool(r.k): r.sha256 for r in prefixes.list_digests(df, ["k"], "v").collect()} == expected
