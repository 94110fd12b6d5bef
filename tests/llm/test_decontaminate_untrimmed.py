"""Decontamination before trimming, against a count of the substitutions in all windows."""

import random
from dataclasses import replace
from itertools import combinations

import pytest

from chunkwright.llm.decontaminate import EVERY, SeedIndex, SpacedSeeds, drop_contaminated, find_overlaps, tokens


def promised(doc, item):
    """Whether 13 tokens lie over the item's with up to 2 substitutions, or a shorter item does whole with up to a fifth."""
    a, b = tokens(doc), tokens(item)
    n = min(len(b), 13)
    return n > 0 and any(sum(x != y for x, y in zip(a[i : i + n], b[j : j + n])) <= n // 5 for i in range(len(a) - n + 1) for j in range(len(b) - n + 1))


@pytest.mark.parametrize("n, k", [(13, 2), (15, 2), (16, 2), (18, 2), (20, 3), *[(n, n // 5) for n in range(1, 13)]])
def test_every_place_of_the_substitutions(n, k):
    item = [f"t{i}" for i in range(n)]
    index = SeedIndex([(1, " ".join(item))], EVERY)
    for gone in combinations(range(n), k):
        passage = " ".join("new" if i in gone else w for i, w in enumerate(item))
        assert index.overlaps([passage, f"before {passage} after"]).keys() == {0, 1}, gone


@pytest.mark.parametrize("n", [1, 4, 5, 9, 10, 12])
def test_short_items_only_whole(n):
    item = [f"t{i}" for i in range(n)]
    index = SeedIndex([(1, " ".join(item))], EVERY)
    changed = ["new"] * (n // 5 + 1) + item[n // 5 + 1 :]
    assert not index.overlaps([" ".join(item[1:]), " ".join(item[:-1]), " ".join(changed), "", None])


def test_random_texts_against_all_windows(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "a", "in"] + [f"w{i}" for i in range(60)])
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 22)))) for i in range(30)] + [(90, ""), (91, None)]
    docs = []
    for i in range(150):
        w, passage = [word() for _ in range(rng.randint(0, 40))], rng.choice(items[:30])[1].split()
        for _ in range(rng.randint(0, 3)):
            passage[rng.randrange(len(passage))] = word()
        at = rng.randint(0, len(w))
        docs.append((i, " ".join(w[:at] + passage + w[at:])))
    docs += [(900, ""), (901, None)]
    D, B = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_overlaps(D, B, EVERY).collect()}
    texts, passages = dict(docs), dict(items)
    for (d, i), r in got.items():  # nothing is found that is not there
        a, b = tokens(texts[d])[r.doc_token :][: r.tokens], tokens(passages[i])[r.item_token :][: r.tokens]
        assert len(a) == len(b) == r.tokens >= min(13, len(tokens(passages[i])))
        assert sum(x == y for x, y in zip(a, b)) == r.matches >= 4 * (r.tokens - r.matches)
    want = {(d, i) for d, t in docs for i, item in items if promised(t, item)}
    assert want <= got.keys() and len(want) > 60
    assert sorted(r.doc_id for r in drop_contaminated(D, B, EVERY).collect()) == sorted(set(texts) - {d for d, _ in got})


@pytest.mark.parametrize("params", [SpacedSeeds(), EVERY])
def test_joined_windows_find_what_the_broadcast_index_finds(spark, params):
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "of", "a"] + [f"w{i}" for i in range(40)])
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(25)] + [(3, "another text of a repeated id"), (3, None), (None, ""), (None, " ".join(word() for _ in range(20)))]
    docs = []
    for i in range(80):
        words = [word() for _ in range(rng.randint(0, 60))]
        if i % 2 and (inside := (rng.choice(items)[1] or "").split()):
            changed = ["new" if rng.random() < 0.1 else w for w in inside]
            words[rng.randint(0, len(words)) : 0] = changed
        docs.append((i, " ".join(words), i % 7))
    docs += [(5, docs[1][1], 0), (5, docs[1][1], 0), (None, docs[3][1], 1), (99, None, 2), (98, "", 3), (97, " ".join(word() for _ in range(20_000)) + " " + items[0][1], 4)]
    # a passage of one word over and over has one seed at all of its places
    items.append((70, "same " * 30))
    docs.append((71, "same " * 50, 0))
    documents = spark.createDataFrame(docs, "doc_id long, text string, row long").repartition(5)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    small = replace(params, block_tokens=10)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    found = rows(find_overlaps(documents, benchmark, params))
    assert found and found == rows(find_overlaps(documents, benchmark, small))
    kept = drop_contaminated(documents, benchmark, small)
    assert kept.columns == documents.columns
    assert rows(kept) == rows(drop_contaminated(documents, benchmark, params))
    assert rows(find_overlaps(documents.limit(0), benchmark, small)) == []
