import itertools
import random
import re

import numpy as np
import xxhash

from quarry.llm import simhash
from quarry.operators.components import connected_components


def brute_print(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, print); the smallest doc_id reachable at 4 or fewer bits."""
    label = {}
    for start in range(len(rows)):
        if start in label:
            continue
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for y in range(len(rows)):
                if y not in seen and (rows[x][1] ^ rows[y][1]).bit_count() <= 4:
                    seen.add(y)
                    todo.append(y)
        least = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        label |= {x: least for x in seen}
    return sorted(((rows[i][0], f"{rows[i][1]:016x}", label[i]) for i in label), key=repr)


TEXTS = [None, "", " \t\n", "One", "ONE", "a b c", "a b c d", "a  b\tc D", "a b c d e", "É È é \x85 x y\x1cz", "x " * 5000, "tie"]


def test_texts(spark):
    docs = [(i + 3, t) for i, t in enumerate(TEXTS)] + [(None, "lonely words here now and then"), (None, "a b c d"), (1, "tie"), (1, "tie")]
    frame = spark.createDataFrame([(i, t, 5, 6) for i, t in docs], "doc_id long, text string, fp int, component_id int")
    got = simhash.near_duplicates(frame).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == brute_components([(i, brute_print(t)) for i, t in docs])


def planted(n, seed=1):
    """Random fingerprints with chains and balls of near ones."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = r.choice(out)
        for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4, 4, 4, 5])):
            x ^= 1 << b
        out.append(x)
    return sorted(set(out))


def labels(spark, prints):
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    return {r.node % 2**64: r.component % 2**64 for r in connected_components(simhash.links(frame)).collect()}


def same_groups(found, prints):
    want = brute_components([(i, p) for i, p in enumerate(prints)])
    root = {prints[i]: prints[c] for i, _, c in want}
    groups = lambda x: {frozenset(p for p in prints if x.get(p, p) == r) for r in set(x.values())}
    return {g for g in groups(root) if len(g) > 1} == {g for g in groups(found) if len(g) > 1}


def test_planted_links(spark):
    prints = planted(150)
    assert same_groups(labels(spark, prints), prints)


def test_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 5)
    prints = planted(60, 2)
    assert same_groups(labels(spark, prints), prints)


def test_covering_and_division():
    r = random.Random(3)
    for first, width in simhash.PARTS:
        columns, patterns = simhash.covering_patterns(width)
        assert {*columns} == set(range(1, 16)) and all(len(p) for p in patterns)
    prints = np.array(planted(200, 4), "<u8")
    rows, keys = simhash.anchors(prints)
    at = {}
    for i, k in zip(rows.tolist(), keys.tolist()):
        at.setdefault(i, set()).add(k)
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (int(prints[i]) ^ int(prints[j])).bit_count() <= 4:
            assert at[i] & at[j]
            part = next(p for p, (f, w) in enumerate(simhash.PARTS) if ((int(prints[i]) ^ int(prints[j])) >> f & (1 << w) - 1).bit_count() <= 1)
            assert any(k[i] == k[j] for k in simhash.block_pair_keys(prints, part))
    assert r


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
