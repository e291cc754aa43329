import random

from pyspark.sql import functions as F

from captionforge.llm import decontam

from .helpers import docs, prose, words


def brute(texts, items, n=13):
    windows = [(str(i), words(t)) for i, t in items]
    out = []
    for text in texts:
        w, hit, names = words(text), set(), set()
        for name, item in windows:
            size = min(n, len(item))
            known = {tuple(item[k:k + size]) for k in range(len(item) - size + 1)} if item else set()
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in known:
                    hit.update(range(k, k + size))
                    names.add(name)
        out.append((len(w), len(hit), sorted(names)))
    return out


def table(spark):
    rng = random.Random(4)
    items = [(1, prose(rng, 30)), (2, "short item"), (10, prose(rng, 13)), (3, None), (4, ""), (5, "short item")]
    texts = [None, "", "short ITEM", "x short, item y " + prose(rng, 40), prose(rng, 50), items[0][1].upper(), prose(rng, 5) + " " + items[2][1],
             " ".join(items[0][1].split()[:12]), prose(rng, 3000) + " " + items[0][1]] + ["short item"] * 2
    return items, texts, docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force(spark):
    items, texts, frame, bench = table(spark)
    for block in (decontam.BLOCK_BYTES, 300):  # one block, and one item or so a block
        found = decontam.scan(frame, bench, block_bytes=block).orderBy("doc_id").collect()
        assert [(r.scan.n_words, r.scan.n_hit, list(r.scan["items"])) for r in found] == brute(texts, items)


def test_spans_hold_the_hit_words(spark):
    items, texts, frame, bench = table(spark)
    for r in decontam.scan(frame, bench).collect():
        inside = [w for s in r.scan.spans for w in words(r.text[s.start:s.end])]
        assert len(inside) == r.scan.n_hit


def test_removal(spark):
    items, texts, frame, bench = table(spark)
    kept = decontam.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (n, h, _) in enumerate(brute(texts, items)) if not (h and 20 * h >= n)}
    cut = {r.doc_id: r.text for r in decontam.decontaminate(frame, bench, remove="spans").collect()}
    assert cut[4] == texts[4] and cut[2] == "" and cut[3].startswith("x  y ") and len(words(cut[8])) == 3000


def test_empty_tables(spark):
    items, texts, frame, bench = table(spark)
    assert decontam.scan(frame.limit(0), bench).count() == 0
    clean = decontam.scan(frame, bench.limit(0)).select(F.sum("scan.n_hit").alias("h"), F.sum("scan.n_words").alias("w")).first()
    assert clean.h == 0 and clean.w == sum(len(words(t)) for t in texts)
