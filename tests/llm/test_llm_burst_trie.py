"""The trie of conversations beside a plain dictionary of prefixes."""

import collections
import hashlib
import re
import zlib

import pytest

from docwarden.llm import op13_burst_trie as op13

KINDS = "conv_id long, turn int, role string, text string, ids string, above string, n long"


def plain_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(found)] for c, found in turns.items()}
    members = collections.defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = collections.defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children[prefix]
        leaves[prefix] = sum(leaves[x] for x in below) or 1
        words = len(re.findall("[^\x20\x09-\x0D]+", prefix[-1][1])) if prefix else 0
        saved[prefix] = (len(members[prefix]) - 1) * words + sum(saved[x] for x in below)
    return collections.Counter(
        (
            min(found), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(found), len(children[prefix]), leaves[prefix], saved[prefix],
            hashlib.sha256(",".join(str(c) for c in sorted(found) if whole[c] == prefix).encode()).hexdigest(),
        )
        for prefix, found in members.items()
    )


def check(conversations, container):
    got = collections.Counter(map(tuple, op13.trie_nodes(conversations, container).collect()))
    assert got == plain_trie([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("container", [3, op13.CONTAINER])
def test_trie_of_the_table(spark, sf_dir, container):
    check(spark.read.parquet(f"{sf_dir}/conversations.parquet"), container)


def odd_turns():
    rows = [(None, 0, "user", "lost")]
    for c in range(0, 45):
        rows += [(c, t, "user" if t % 2 else None, f"shared {t}") for t in range(3)]
        rows += [(c, 3 + t, "x", f"branch {c % 3} {t}\tword") for t in range(c % 4)]
    rows += [(60, None, None, None), (60, 0, "", ""), (61, 0, "a", "one"), (61, 0, "a", "one"), (61, 0, "b", "two")]
    rows += [(c, 0, "user", "only") for c in (62, 63, 64, 65, 66)]
    rows += [(c, t, "r", f"copy {t}") for c in range(100, 160) for t in range(6)]
    rows += [(200, t, "r", "long " * (t % 3) + str(t)) for t in range(700)] + [(220, t, "r", "long " * (t % 3) + str(t)) for t in range(699)]
    rows += [(-5, 0, "r", "below zero"), (9223372036854775807, 0, "r", "large")]
    return [(*r, None, "x", 1) for r in rows]


@pytest.mark.parametrize("container", [1, 20])
def test_trie_of_odd_rows(spark, container):
    check(spark.createDataFrame(odd_turns(), KINDS).repartition(3), container)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(3, 0, "a", "b")], [(4, 0, "a", "b"), (4, 0, "a", "b")]])
def test_smallest_tries(spark, rows):
    check(spark.createDataFrame([(*r, None, None, None) for r in rows], KINDS), 1)


def test_pieces_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(op13, "ENDS_IN_PIECE", 3)
    rows = [(c, 0, "r", "same") for c in range(1000, 1400, 20)]
    check(spark.createDataFrame([(*r, None, None, None) for r in rows], KINDS).repartition(4), 2)
