"""The near-duplicate join over hundreds of thousands of planted pairs around its threshold, in groups of 60 and of 900."""

import random
from itertools import combinations

from jobloom.llm import jaccard_join, shared

GROUPS, SIZE, LARGE = 40, 60, 900


def planted():
    """doc_id, text: each group's texts are its base with up to two words replaced in short texts (119 words) and up to five in long ones (300)."""
    rng, rows, groups = random.Random(3), [], []
    for g in range(GROUPS + 1):
        long = g % 2
        base = [f"g{g}w{i}" for i in range(300 if long else 119)]
        ids = []
        for _ in range(LARGE if g == GROUPS else SIZE):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.randint(0, 5 if long else 2)):
                words[at] = f"x{rng.getrandbits(60)}"
            ids.append(len(rows))
            rows.append((len(rows), " ".join(words)))
        groups.append(ids)
    return rows, groups


def links_of(rows, groups):
    """Pairs of linked documents, by comparing all pairs of each group: other groups share no word."""
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    out = []
    for ids in groups:
        for a, b in combinations(ids, 2):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                out.append((a, b))
    return out, sets


def test_planted_pairs_are_found(spark):
    rows, groups = planted()
    links, sets = links_of(rows, groups)
    different = sum(sets[a] != sets[b] for a, b in links)
    assert different > 50_000
    partners, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        partners[a] += 1
        partners[b] += 1
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shared.folder(spark, "recall")).collect()
    counted = {r.doc_id: r.n_links for r in got}
    assert len(counted) == len(rows)
    assert all(counted[k] <= n for k, n in enumerate(partners))  # no link that is not one
    recall = sum(counted.values()) / sum(partners)
    assert recall >= 0.9999, f"{recall:.6f} of {len(links)} links, {different} of them between different texts"
    assert {r.doc_id: r.class_id for r in got} == {k: find(k) for k in range(len(rows))}
