"""Prefix tries and Merkle manifests against direct versions in Python, with edge cases."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from latencylab.llm import merkle, prefix_trie as pt

TURNS = "conv_id bigint, turn int, role string, text string, key string, depth string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def direct_trie(sequences: dict[int, list[tuple[str, str]]]) -> collections.Counter:
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, rows = {}, {}, collections.Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(sequences[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        rows[min(members[p]), len(p), parent, len(members[p]), len(children[p]), leaves[p], saved[p], sha(ends)] += 1
    return rows


def direct_conversations(rows) -> dict[int, list[tuple[str, str]]]:
    found = collections.defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        found[r[0]].append((r[2] or "", r[3] or ""))
    return found


def some_conversations(seed: int, n: int = 260) -> list[tuple]:
    """Few different texts, so that prefixes are shared; one hot opening; one deep pair; an odd start."""
    rnd, rows = random.Random(seed), []
    for c in range(n):
        opening = ["hello"] * 3 if rnd.random() < 0.5 else []
        texts = opening + [rnd.choice("abé😀") * rnd.randint(0, 2) for _ in range(rnd.randint(0, 6))] or ["x"]
        rows += [(c, t, rnd.choice(["user", "assistant"]) if t > 2 else "user", x, "k", "d") for t, x in enumerate(texts)]
    for c in (n + 1, n + 2):
        rows += [(c, t, "user", f"{t}", "k", "d") for t in range(90 + c % 2)]
    rows += [(n + 3, None, None, None, "k", "d"), (n + 3, 0, "user", "after", "k", "d"), (None, 0, "user", "of none", "k", "d")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, group_rows", [(1, 1), (2, 12), (3, 10_000)])
def test_trie_is_that_of_all_prefixes(spark, seed, group_rows):
    rows = some_conversations(seed)
    convs = pt.conversations(spark.createDataFrame(rows, TURNS).repartition(7))
    got = collections.Counter(map(tuple, pt.trie(convs, group_rows).collect()))
    assert got == direct_trie(direct_conversations(rows))


def test_rebuilt_trie(spark):
    rows = some_conversations(4)
    own = direct_conversations(rows)
    expected = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        expected[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    assert any(not t for t in expected.values()) or min(map(len, expected.values())) > 0
    convs = pt.conversations(spark.createDataFrame(rows, TURNS))
    assert collections.Counter(map(tuple, pt.trie(pt.rebuilt(convs), 5).collect())) == direct_trie(expected)


def test_turnless_and_no_conversations(spark):
    kind = "id bigint, turns array<struct<digest:binary,size:int>>"
    none = spark.createDataFrame([], kind)
    assert pt.trie(none).collect() == []
    turnless = spark.createDataFrame([(7, []), (5, [])], kind)
    assert list(map(tuple, pt.trie(turnless).collect())) == [(5, 0, None, 2, 0, 1, 0, sha("5,7"))]


def test_many_copies_and_equal_turn_numbers(spark):
    rows = [(c, 0, "user", "same", "", "") for c in range(700)] + [(9000, 0, r, "x", "", "") for r in ("a", "b")]
    got = collections.Counter(map(tuple, pt.trie(pt.conversations(spark.createDataFrame(rows, TURNS))).collect()))
    assert (0, 1, 0, 700, 0, 1, 699 * 4, sha(",".join(map(str, range(700))))) in got
    again = pt.trie(pt.conversations(spark.createDataFrame(rows[::-1], TURNS).repartition(3)))
    assert got == collections.Counter(map(tuple, again.collect()))


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, g string, pos int"


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def flanks(levels, i) -> list[tuple[str, str]]:
    found = []
    for level in levels[:-1]:
        run = i // 8 * 8
        found.append(("".join(level[run:i]), "".join(level[i + 1:run + 8])))
        i //= 8
    return found


def direct_manifest(rows, tamper) -> collections.Counter:
    leaf = lambda r, text: sha("".join(map(field, (*r[:4], text))))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[g] = levels_of([leaf(r, r[4]) for r in groups[g]])
    top = levels_of([trees[g][-1][0] for g in names])
    root, found = top[-1][0], collections.Counter()
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = flanks(trees[g], i) + flanks(top, k)
            h = leaf(r, tamper(r))
            for left, right in path:
                h = sha(left + h + right)
            found[r[0], leaf(r, r[4]), trees[g][-1][0], root, sha("".join(a + b for a, b in path)), h, h == root] += 1
    return found


def lower_a_to_z(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 1}, {"a": 65, "é": 9, "": 64}, {"big": 4200, "z": 513, None: 512}])
def test_manifest_is_that_of_all_levels(spark, sizes):
    rnd, rows = random.Random(5), []
    for lang, n in sizes.items():
        for _ in range(n):
            i = rnd.choice([None, *range(50)]) if rnd.random() < 0.05 else len(rows) + 100
            text = rnd.choice([None, "", "Äb", "AbC" * 40, "plain", "x:1-"])
            rows.append((i, rnd.choice([None, "s1", "3:"]), lang, rnd.choice([None, 7]), text, "clash", "g", 1))
    rows += rows[:30]  # repeated rows
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    got = merkle.verified(docs, tampered={"text": merkle.lower_cased("text", third)}).collect()
    tamper = lambda r: r[4] if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 else lower_a_to_z(r[4])
    assert collections.Counter(map(tuple, got)) == direct_manifest(rows, tamper)


def test_manifest_without_tampering_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "s", "en", 3, "abc", "", "", 0)], DOCS)
    row = merkle.verified(docs).first()
    assert row["verified"] and row["leaf"] == row["root"] and row["proof_sha256"] == sha("")
    assert merkle.verified(docs.limit(0)).collect() == []
    long_text = docs.withColumn("text", F.repeat(F.lit("Long text. "), 300_000))
    assert merkle.verified(long_text).first()["verified"]
