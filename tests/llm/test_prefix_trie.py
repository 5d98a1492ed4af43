"""The trie of conversations against brute force and on odd input."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import prefix_trie as T
from lodestone.llm import queries as Q
from tests.oracle import connect, differences

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built = own.get(base, [])[:h] + ts[h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append((c, len(built)))
    nodes = {p: sorted(m) for p, m in members.items()}
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)

    def under(p):
        yield p
        for c in children[p]:
            yield from under(c)

    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = set()
    for p, m in nodes.items():
        below = list(under(p))
        ends = ",".join(str(c) for c, n in m if n == len(p))
        out.add((m[0][0], len(p), nodes[p[:-1]][0][0] if p else None, len(m), len(children[p]), sum(not children[x] for x in below), sum((len(nodes[x]) - 1) * words(x) for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def result(spark, rows, **options):
    got = [tuple(r) for r in T.conversation_trie(spark.createDataFrame(rows, SCHEMA), **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_sql(spark, sf_dir):
    assert not differences(Q.queries()["op12_prefix_trie"](spark, sf_dir), connect(sf_dir), Q.oracle_sql()["op12_prefix_trie"])


@pytest.mark.parametrize(("seed", "partitions"), [(0, 1), (1, 7), (2, 13), (3, 40)])
def test_against_brute_force(spark, seed, partitions):
    """Few different turns, so that nodes reach over many blocks."""
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a b", "c", "", "d e f"])) for c in range(-30, 170) for t in range(rng.choice([1, 1, 3, 6]))]
    assert result(spark, rows, partitions=partitions) == brute(rows)


def test_lone_branches_copies_and_a_long_conversation(spark):
    long = [(c, t, "user", f"turn {t}") for c in (20, 21, 22, 23) for t in range(400 - c)]
    copies = [(c, t, "user", f"same {t}") for c in range(10_000, 10_060) for t in range(3)]
    rows = long + copies
    assert result(spark, rows, partitions=5) == brute(rows)


def test_odd_input(spark):
    rows = [(None, 1, "user", "lost"), (1, None, "user", "first"), (1, 0, None, "second"), (1, 0, None, "second"), (2, 3, "user", None), (3, 5, "x", " \t\n"), (40, 0, "user", "a"), (2**40, 0, "user", "a"), (-7, 1, "user", "b")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows[:1]) == set()
    assert result(spark, [(1, 0, "u", "only"), (4, 0, "u", "only")]) == brute([(1, 0, "u", "only"), (4, 0, "u", "only")])  # turnless ones are members of the root
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("seq", "words", "block", "depth", "base", "owner", "n")})
    assert {tuple(r) for r in T.conversation_trie(clash).collect()} == brute(rows)


def test_role_and_text_are_told_apart(spark):
    rows = [(k, t, r, x) for k, (r, x) in enumerate([("ab", "c"), ("a", "bc"), ("", "abc"), ("ab", "c")]) for t in range(6)]
    assert result(spark, rows) == brute(rows)
