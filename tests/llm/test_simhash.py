"""SimHash links against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from chunkwright.llm.components import star_forest
from chunkwright.llm.simhash import SimHash, build_top, count_leaves, fingerprint, keep_one, link_shard, near_duplicates, route

SCHEMA = "doc_id long, text string, fp string, component_id long"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "A b c d e É", "a\x0bb\x1cc\xa0d e", "w " * 500])
def test_fingerprint(text):
    assert fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(n // 8)]
    return np.array(sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(8)}), np.uint64)


def test_routed_shards_lose_no_link():
    points, p = clustered(2400, 5), SimHash(leaf_points=16)
    top = build_top(points[::4], 9, p)
    assert count_leaves(top) > 3
    shard, index, home = route(top, points, 3)
    assert sorted(index[home]) == list(range(len(points)))
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for s in range(count_leaves(top)):
        own = index[shard == s]
        for a, b in enumerate(link_shard(points[own], home[shard == s], p)):
            ra, rb = find(own[a]), find(own[b])
            root[max(ra, rb)] = min(ra, rb)
    assert [find(i) for i in range(len(points))] == plain_components([int(x) for x in points])


def test_dense_cluster_and_identical_points():
    base = 0x123456789ABCDEF0
    points = np.array([base ^ (1 << i) ^ (1 << j) for i in range(30) for j in range(i)], np.uint64)
    assert (link_shard(points, np.ones(len(points), bool), SimHash(leaf_points=8)) == 0).all()


def test_star_forest_on_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    assert sorted(map(tuple, star_forest(edges).collect())) == [(i, 0) for i in range(1, 41)] + [(101, 100)]
    assert star_forest(edges.limit(0)).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(3, 60))) for _ in range(60)]
    texts += [t + " z" for t in texts[:30]] + [t.upper() for t in texts[:20]] + [None, "", "  ", "one"]
    rows = [(1000 - i, t, "x", 1) for i, t in enumerate(texts)] + [(1000, texts[0], "x", 1), (None, texts[1], "x", 1), (None, "quite alone here", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    comp = plain_components(fps)
    least = {}
    for (doc_id, *_), c in zip(rows, comp):
        least[c] = min(x for x in (least.get(c), doc_id) if x is not None) if (least.get(c), doc_id) != (None, None) else None
    want = sorted(((d, fp, least[c]) for (d, *_), fp, c in zip(rows, fps, comp)), key=str)
    params = SimHash(shard_points=20, leaf_points=4)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in near_duplicates(docs, params).collect()), key=str)
    assert got == want
    kept = keep_one(docs, params)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == sorted({v for v in least.values() if v is not None})
    assert kept.where("doc_id is null").count() == 1  # the one that is near no other


def test_one_row_of_each_component_is_kept_whatever_the_ids(spark):
    a, b = "words of one text that repeats here", "quite another text than that one before"
    cases = [[(3, b), (5, a), (5, b)], [(1, a), (1, a), (1, a)], [(None, a), (None, a), (None, b)], [(None, a), (7, a)], [(2, None), (2, ""), (None, " ")]]
    for rows in cases:
        docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
        kept = sorted(((r.text or "").strip() for r in keep_one(docs).collect()))
        assert kept == sorted({(t or "").strip() for _, t in rows})
    assert [r.doc_id for r in keep_one(spark.createDataFrame([(None, a, "x", 1), (7, a, "y", 2), (9, a, "z", 3)], SCHEMA)).collect()] == [7]
    assert keep_one(docs.limit(0)).count() == 0
    assert near_duplicates(docs.limit(0)).count() == 0


def test_texts_are_not_shuffled_where_few_rows_go(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(3000)]
    rows = [(rng.randrange(1 << 40), t) for t in texts]
    for more in ([(1 << 41, texts[0])], [(1 << 41, texts[0]), (None, texts[1])]):  # ids of their own; one without
        docs = spark.createDataFrame([(*r, "x", 1) for r in rows + more], SCHEMA)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
        try:
            kept = keep_one(docs)
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in rows)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
