import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from captionforge.llm import graph, jaccard
from captionforge.llm.graph import connected_components

from .helpers import docs, prose, words


def shingles(text):
    w = words(text)
    n = min(5, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute(texts):
    sets = [shingles(t) for t in texts]
    links = defaultdict(set)
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 1000 * len(a & b) >= 800 * len(a | b):
                links[i].add(j)
                links[j].add(i)
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return {i: (top(i), len(links[i]), len({sets[j] for j in links[i]} - {sets[i]})) for i in range(len(texts))}


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


def corpus():
    rng = random.Random(2)
    base, passage = prose(rng, 150), prose(rng, 40)
    texts = [base] + [edited(rng, base, rng.randint(1, 4)) for _ in range(24)]   # one dense group
    texts += [f"{prose(rng, 80)} {passage} {prose(rng, 60)}" for _ in range(24)]  # a passage in common
    texts += [base] * 5 + [None, "", "", " !! ", "one", "one", "one two three", "one two three four five"]
    texts += [prose(rng, 5_000)]
    return texts


def found(spark, texts, ids=None):
    return {r.doc_id: (r.class_id, r.n_links, r.n_linked_texts) for r in jaccard.near_duplicates(docs(spark, texts, ids)).collect()}


@pytest.mark.parametrize("bucket, depth", [(128, 6), (6, 6), (6, 0)])
def test_matches_brute_force(spark, monkeypatch, bucket, depth):
    """With usual buckets, with buckets that must be split, and with blocks instead of splits."""
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "DEPTH", depth)
    texts = corpus()
    assert found(spark, texts) == brute(texts)


def test_clusters_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_RECORDS", 7)
    texts = corpus()[:40]
    assert found(spark, texts) == brute(texts)


def test_keep_one(spark):
    texts = corpus()
    frame = docs(spark, texts)
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    want = {i for i, (c, _, _) in brute(texts).items() if c == i}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_null_and_repeated_ids_and_empty_table(spark):
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    frame = docs(spark, [a, a, b, a, a], [None, 7, 7, 7, None])
    rows = jaccard.near_duplicates(frame).collect()
    assert len(rows) == 5 and sorted(r.n_links for r in rows) == [0, 3, 3, 3, 3]
    assert {r.class_id for r in rows} == {7}
    kept = jaccard.keep_one(frame).collect()
    assert sorted((r.doc_id, r.text == a) for r in kept) == [(7, False), (7, True)]
    assert jaccard.near_duplicates(frame.limit(0)).count() == 0
    assert jaccard.keep_one(frame.limit(0)).count() == 0


def test_runs_follow_the_recall():
    assert jaccard.runs_for(0.9) < jaccard.runs_for(0.9999) < jaccard.runs_for(1 - 1e-12)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 201), (201, 200), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("edges, tables", [([(9, 1), (8, 1), (7, 2)], 1), ([(9, 1), (9, 2), (5, 1)], 5)])
def test_components_end_at_stars_in_tasks_for_the_links(spark, monkeypatch, edges, tables):
    """No round on what is one star per component, and no file per shuffle partition for a few links."""
    made = []
    write = graph.materialize

    def kept(df, label):
        made.append((df.rdd.getNumPartitions(), write(df, label)))
        return made[-1][1]

    monkeypatch.setattr(graph, "materialize", kept)
    components = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, components.collect())) == ({9: 1, 8: 1, 1: 1, 7: 2, 2: 2} if tables == 1 else {9: 1, 2: 1, 5: 1, 1: 1})
    assert len(made) == tables
    assert all(tasks == 1 for tasks, _ in made[1:])


def template_pairs(rng, groups, per_group, share, vocabulary=4000):
    """Near copies in groups of texts that share a long passage; about ``share`` of a text is the passage of its group."""
    word = [f"w{i}" for i in range(vocabulary)]
    texts = []
    for _ in range(groups):
        passage = rng.choices(word, k=int(200 * share))
        for _ in range(per_group):
            own = passage + rng.choices(word, k=200 - len(passage))
            other = list(own)
            for at in rng.sample(range(200), 3):
                other[at] = rng.choice(word)
            texts += [" ".join(own), " ".join(other)]
    return texts


@pytest.mark.parametrize("share", [0.4, 0.8])
def test_recall_of_near_copies_in_dense_buckets(spark, monkeypatch, share):
    """Every large bucket holds a whole group; pairs are at 0.8 to 0.93 and all texts of a group share the passage."""
    monkeypatch.setattr(jaccard, "BUCKET", 16)
    rng = random.Random(int(100 * share))
    texts = template_pairs(rng, 3, 60, share)
    want = brute(texts)
    linked = {i for i, row in want.items() if row[2]}
    assert len(linked) > 200
    rows = found(spark, texts)
    missed = [i for i in linked if rows[i][2] < want[i][2]]
    assert len(missed) <= 0.01 * len(linked), (len(missed), len(linked))
    assert all(rows[i][2] <= want[i][2] for i in want)


def test_a_group_of_different_near_copies(spark, monkeypatch):
    """Edited from one text: most pairs are below the threshold, all are linked through others."""
    monkeypatch.setattr(jaccard, "BUCKET", 16)
    monkeypatch.setattr(jaccard, "BLOCK_RECORDS", 32)
    rng = random.Random(9)
    base = prose(rng, 300)
    texts = [edited(rng, base, rng.randint(1, 9)) for _ in range(220)] + [prose(rng, 200) for _ in range(20)]
    assert found(spark, texts) == brute(texts)


def test_null_ids_stay_linear(spark):
    rng = random.Random(4)
    rows_of = {}
    for n in (60, 120):
        texts = []
        for _ in range(n // 2):
            base = prose(rng, 40)
            texts += [base, base + " and one more word"]
        frame = docs(spark, texts, [None] * n).select("doc_id", "text")
        records = frame.select("doc_id", F.xxhash64("text").alias("text_hash"), jaccard.record_of("text").alias("r")).select("doc_id", "text_hash", "r.*")
        records = records.withColumns({"rid": F.monotonically_increasing_id(), "copies": F.lit(1).cast("long")})
        records = jaccard.materialize(records, "records")
        clusters = connected_components(jaccard.candidate_links(records.select("rid", "size", "sketch", "paths")))
        spread, _ = jaccard.cluster_texts(frame, records, clusters)
        rows_of[n] = spread.count()
    assert rows_of == {60: 60, 120: 120}
    every = jaccard.near_duplicates(frame).collect()
    assert len(every) == 120 and all(r.n_links == 1 and r.class_id is None for r in every)
