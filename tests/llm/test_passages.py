import random
import time

import numpy as np
import pytest

from captionforge.llm import passages as P

from .helpers import docs, prose, words


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    return out


def corpus():
    rng = random.Random(6)
    passage, other = prose(rng, 70), prose(rng, 60)
    fuzzy = passage.split()
    for k in (11, 24, 40, 55):
        fuzzy[k] = "anders"
    del fuzzy[33]
    texts = [prose(rng, 200), f"{prose(rng, 50)} {passage} {prose(rng, 30)}", f"{passage} {prose(rng, 90)}", f"{prose(rng, 20)}. {' '.join(fuzzy)}",
             prose(rng, 40) + " " + " ".join(passage.split()[:40]), other, f"{other} {prose(rng, 10)} {other}", None, "", "!!", "kurz",
             "und " * 300, "und " * 300 + prose(rng, 5), prose(rng, 8000) + " " + passage]
    return texts, passage, other


def test_exact_and_fuzzy_passages(spark):
    texts, passage, other = corpus()
    rows = P.repeated_passages(docs(spark, texts)).collect()
    found = covered(rows)
    assert all(r.match_doc_id < r.doc_id and r.n_words >= 50 and r.equal_words >= 0.8 * r.n_words for r in rows)
    assert set(range(70)) <= found[2] and set(range(8000, 8070)) <= found[13]
    assert len(found[3] & set(range(20, 89))) >= 60        # edited in five places
    assert not {0, 1, 4, 5, 7, 8, 9, 10, 11} & set(found)   # first, too short or without repeats
    assert found[6] == set(range(60)) | set(range(70, 130))
    assert len(found[12]) >= 290


def test_removal(spark):
    texts, passage, other = corpus()
    texts.append(passage.upper())
    frame = docs(spark, texts)
    left = P.remove_repeats(frame)
    assert left.columns == frame.columns
    kept = {r.doc_id: r.text for r in left.collect()}
    assert set(kept) == set(range(14))                      # the copy lost all its words
    assert all(kept[i] == texts[i] for i in (0, 1, 4, 5, 7, 8, 9, 10, 11))
    assert len(words(kept[2])) == 90 and len(words(kept[6])) == 10 and len(words(kept[13])) == 8000


def test_many_copies_null_and_repeated_ids(spark):
    rng = random.Random(7)
    text = prose(rng, 120)
    frame = docs(spark, [text] * 40 + [prose(rng, 60)], [None, 5, 5, *range(6, 43), 50])
    rows = P.repeated_passages(frame).collect()
    # a null id sorts first; rows equal in id and text are one document
    assert {r.doc_id for r in rows} == {5, *range(6, 43)} and len(rows) == 38
    assert all(r.match_doc_id is None or r.match_doc_id < r.doc_id for r in rows)
    assert P.remove_repeats(frame).count() == 2


def test_empty_table(spark):
    frame = docs(spark, ["x"]).limit(0)
    assert P.repeated_passages(frame).count() == 0 and P.remove_repeats(frame).count() == 0


def brute_chain(d, r, n, cost):
    best = [0.0] * len(d)
    for i in sorted(range(len(d)), key=lambda i: (d[i], r[i])):
        best[i] = n[i] + max([0.0] + [best[j] - cost * (d[i] - d[j] - n[j] + r[i] - r[j] - n[j]) for j in range(len(d))
                                      if d[j] + n[j] <= d[i] and r[j] + n[j] <= r[i]])
    return max(best)


@pytest.mark.parametrize("seed", range(20))
def test_fenwick_chain_has_the_best_score(seed):
    rng = np.random.default_rng(seed)
    d, r, n = rng.integers(0, 60, 12), rng.integers(0, 60, 12), rng.integers(2, 9, 12)
    chain = max(P.chains_of(d, r, n), key=lambda c: score(c, d, r, n))
    assert score(chain, d, r, n) == pytest.approx(brute_chain(d, r, n, P.GAP_COST))


def score(chain, d, r, n):
    gaps = sum(d[b] - d[a] - n[a] + r[b] - r[a] - n[a] for a, b in zip(chain, chain[1:]))
    return n[chain].sum() - P.GAP_COST * gaps


def test_edits_every_eight_words_leave_a_seed(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        passage = [prose(rng, 1) + str(rng.randint(0, 99)) for _ in range(64)]
        edited = [f"anders{rng.random()}" if i % 8 == 7 else w for i, w in enumerate(passage)]
        texts += [f"{prose(rng, 30)} {' '.join(w)} {prose(rng, 30)}" for w in (passage, edited)]
    found = covered(P.repeated_passages(docs(spark, texts)).collect())
    assert sum(len(found.get(i, set()) & set(range(30, 94))) >= 50 for i in range(1, 120, 2)) >= 56


def test_ends_are_extended_over_added_and_missing_words():
    a = [f"w{i}" for i in range(120)]
    b = a[:30] + ["neu"] + a[30:80] + a[81:]
    start, end, other, other_end, same = P.align([{"d": 55, "r": 56, "n": 6}], a, 0, b, 0)
    # the flank is FLANK words on each side
    assert (start, end, other, other_end) == (0, 120, 0, 120) and same == 119


def test_passages_whose_seeds_belong_to_several_documents(spark):
    rng = random.Random(9)
    plain = lambda n: [prose(rng, 1) + str(rng.randint(0, 999)) for _ in range(n)]
    text = lambda w: " ".join(plain(20) + w + plain(20))
    texts, want = [], []
    for overlap in (10, 20, 28):                            # two documents that have a part each
        passage = plain(60)
        half = (60 + overlap) // 2
        texts += [text(passage[:half]), text(passage[60 - half:]), text(passage), text(passage)]
        want.append(len(texts) - 1)
    for _ in range(10):                                     # three sentences of three documents
        parts = [plain(20) for _ in range(3)]
        texts += [text(p) for p in parts] + [text(sum(parts, []))] * 1 + [text(sum(parts, []))]
        want.append(len(texts) - 1)
    rows = P.repeated_passages(docs(spark, texts)).collect()
    found = covered(rows)
    assert all(set(range(20, 80)) <= found.get(i, set()) for i in want)
    assert set(found) == set(want)


def edited_words(rng, passage, identity, indels, fresh):
    """Exactly ``1 - identity`` of the words are replaced, or replaced, left out or followed by another."""
    at, out = set(rng.sample(range(len(passage)), round((1 - identity) * len(passage)))), []
    for i, w in enumerate(passage):
        kind = rng.randrange(3) if indels else 0
        if i not in at:
            out.append(w)
        elif kind == 0:
            out.append(fresh())
        elif kind == 2:
            out += [w, fresh()]
    return out


def test_recall_of_fuzzy_passages(spark):
    """Planted passages of 50 to 70 words, of which 0.8 to 0.9 are equal, at random places of other texts."""
    rng = random.Random(10)
    fresh = lambda: f"w{rng.randrange(20000)}"
    plain = lambda n: [fresh() for _ in range(n)]
    texts, cases = [], []
    for identity in (0.8, 0.85, 0.9):
        for indels in (False, True):
            for _ in range(120):
                passage = plain(rng.randint(50, 70))
                other = edited_words(rng, passage, identity, indels, fresh)
                before = rng.randint(0, 80)
                texts.append(" ".join(plain(rng.randint(0, 80)) + passage + plain(60)))
                texts.append(" ".join(plain(before) + other + plain(60)))
                cases.append((identity, indels, len(texts) - 1, before, before + len(other)))
    found = covered(P.repeated_passages(docs(spark, texts)).collect())
    caught, total, beyond = {}, {}, 0
    for identity, indels, doc, lo, hi in cases:
        key, own = (identity, indels), found.get(doc, set())
        total[key] = total.get(key, 0) + 1
        # most of the passage, and not its surroundings
        caught[key] = caught.get(key, 0) + (len(own & set(range(lo, hi))) >= 0.9 * min(50, hi - lo))
        beyond += len(own - set(range(lo, hi)))
    assert all(caught[k] >= 0.9 * total[k] for k in total), {k: caught[k] / total[k] for k in total}
    assert beyond <= len(cases) and set(found) <= {doc for _, _, doc, _, _ in cases}


def test_a_shorter_passage_is_not_stretched(spark):
    """Forty equal words are no passage, whatever stands around them."""
    rng = random.Random(11)
    plain = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        passage = plain(40)
        texts += [" ".join(plain(40) + passage + plain(40)) for _ in range(2)]
    assert P.repeated_passages(docs(spark, texts)).count() == 0


def test_found_places_are_owners_only():
    rows = lambda *x: P.pa.RecordBatch.from_arrays([P.pa.array([r[i] for r in x], P.pa.int64()) for i in range(3)], names=["h", "doc_id", "at"])
    found = lambda pos: pos | P.UNLIKE
    # a passage that is found in many documents: none of them is matched, and one of them is the owner of the open place
    batch = rows((7, None, found(3)), *[(7, d, found(3)) for d in range(50)], (7, 60, 5), (8, 1, 2), (8, 2, found(2)), (8, 3, 4))
    kept = P.open_or_first(batch).to_pydict()
    assert kept == {"h": [7, 7, 8, 8], "doc_id": [None, 60, 1, 3], "at": [found(3), 5, 2, 4]}
    for seen in (batch, P.open_or_first(batch)):
        for split in (1, 2, seen.num_rows):
            out = P.pa.Table.from_batches(P._match_firsts(seen.slice(lo, split) for lo in range(0, seen.num_rows, split))).to_pylist()
            assert [tuple(r.values()) for r in out] == [(60, 5, None, found(3)), (3, 4, 1, 2)]


def plain_extend(a, b):
    """The ways to go on in two lists of words, a cell at a time."""
    low, step, drop, top = -(1 << 30), 1 << 12, P.X_DROP << 12, 0
    row = {j: -step * j for j in range(min(len(b), P.X_DROP) + 1)}
    out = [(0, 0, 0)]
    for i, word in enumerate(a, 1):
        new, best = {}, (low, 0, 0)
        for j in range(len(b) + 1):
            value = max(row.get(j, low), new.get(j - 1, low)) - step
            if j:
                slope = row.get(j - 1, low) + (step + 1 if word == b[j - 1] else -step)
                value = max(value, slope)
                if word == b[j - 1] and slope == value and value > best[0]:
                    best = value, j, value & 4095
            if value >= top - drop:
                new[j] = value
                top = max(top, value)
        if not new:
            break
        if best[0] >= top - drop:
            out.append((i, best[1], best[2]))
        row = new
    return out


def test_ends_of_many_chains_are_extended_as_one_by_one():
    rng, pairs = random.Random(12), []
    for _ in range(300):
        several = rng.choice([3, 10, 50, 500])
        a = [rng.randrange(several) for _ in range(rng.choice([0, 1, 5, 30, 64, 64]))]
        rate, b = rng.choice([0.05, 0.2, 0.3, 1]), []
        for x in a:
            kind = rng.randrange(3) if rng.random() < rate else 3
            b += [[], [x, rng.randrange(several)], [rng.randrange(several)], [x]][kind]
        pairs.append((a, b[:P.FLANK]))
    filled = lambda side: np.array([p[side] + [-1] * (P.FLANK - len(p[side])) for p in pairs])
    size = lambda side: np.array([len(p[side]) for p in pairs])
    got = [[] for _ in pairs]
    for row, *way in zip(*(x.tolist() for x in P._extend(filled(0), size(0), filled(1), size(1)))):
        got[row].append(tuple(way))
    assert got == [plain_extend(a, b) for a, b in pairs]


def chain_rows(rng, passage, around):
    """One chain of a seed, with the tiles of its two documents, and whether it is a passage."""
    sides = [[f"w{rng.randrange(5000)}" for _ in range(around)] + passage + [f"w{rng.randrange(5000)}" for _ in range(around)] for _ in range(2)]
    return [[" ".join(w[lo:lo + P.TILE]) for lo in range(0, len(w), P.TILE)] for w in sides], [{"d": around, "r": around, "n": 5}]


def test_chains_that_cannot_be_passages_are_not_placed(monkeypatch):
    """They are nine in ten; a batch of them is extended at once, and no border between batches matters."""
    rng, rows, want = random.Random(13), [], []
    for cid in range(200):
        words = 60 if cid % 10 == 0 else 5
        sides, blocks = chain_rows(rng, [f"p{cid}-{i}" for i in range(words)], 100)
        rows.append({"cid": cid, "side": -1, "tile": 0, "words": "", "doc_id": None if cid == 10 else cid, "salt": 1, "r_doc": 0, "r_salt": 2, "blocks": blocks})
        rows += [{"cid": cid, "side": s, "tile": t, "words": w} for s in range(2) for t, w in enumerate(sides[s])]
        if words == 60:
            want.append((rows[-len(sides[0]) - len(sides[1]) - 1]["doc_id"], 100, 60, 0, 100, 60))
    schema = P.pa.schema([("cid", P.pa.int64()), ("side", P.pa.int32()), ("tile", P.pa.int32()), ("words", P.pa.string()), ("doc_id", P.pa.int64()), ("salt", P.pa.int32()),
                          ("r_doc", P.pa.int64()), ("r_salt", P.pa.int32()), ("blocks", P._BLOCKS)])
    whole, placed, own = P.pa.RecordBatch.from_pylist(rows, schema=schema), [], P._placed
    monkeypatch.setattr(P, "_placed", lambda *x: placed.append(1) or own(*x))
    for size in (len(rows), 7, 1):
        placed.clear()
        out = P.pa.Table.from_batches(P._align_all(P.MIN_WORDS, P.IDENTITY)(whole.slice(lo, size) for lo in range(0, len(rows), size))).to_pylist()
        assert [(x["doc_id"], x["start_word"], x["n_words"], x["match_doc_id"], x["match_start_word"], x["equal_words"]) for x in out] == want
        assert len(placed) == len(want)


def test_longer_keys_do_not_depend_on_batches():
    rng, rows = random.Random(14), []
    for doc in range(30):
        tiles = [{"tile": t, "words": " ".join(f"w{rng.randrange(300)}" for _ in range(P.TILE))} for t in rng.sample(range(12), 6)]
        rows.append({"doc_id": doc or None, "salt": -doc, "tiles": tiles + tiles[:1], "stretches": [{"start": 40, "end": 300}, {"start": 290, "end": 500}],
                     "spans": [{"start_word": 200, "n_words": 100}, {"start_word": 60, "n_words": 20}][:doc % 3]})
    span = lambda *names: P.pa.list_(P.pa.struct([(n, P.pa.int32()) for n in names]))
    schema = P.pa.schema([("doc_id", P.pa.int64()), ("salt", P.pa.int32()), ("tiles", P.pa.list_(P.pa.struct([("tile", P.pa.int32()), ("words", P.pa.string())]))),
                          ("stretches", span("start", "end")), ("spans", span("start_word", "n_words"))])
    whole = P.pa.RecordBatch.from_pylist(rows, schema=schema)
    seen = []
    for size in (30, 4, 1):
        found = P.pa.Table.from_batches(P._longer_keys(P.MIN_WORDS, P.KMER, P.WINDOW)(whole.slice(lo, size) for lo in range(0, 30, size))).to_pylist()
        seen.append(sorted((x["doc_id"] or -1, x["at"], x["h"]) for x in found))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 1000
    covered = lambda doc, pos: any(x["start_word"] <= pos and pos + P.KMER <= x["start_word"] + x["n_words"] for x in rows[max(0, doc)]["spans"])
    for doc, at, _ in seen[0]:
        pos = at & P.UNLIKE - 1
        assert (at & P.UNLIKE != 0) == covered(doc, pos) and 40 <= pos and pos + P.KMER <= 500 and at >> 32 == -max(0, doc)


def test_waves_let_go_of_their_shuffles(spark, monkeypatch):
    """What a wave has dealt is gone when the next one begins, without a collection of the driver's garbage."""
    monkeypatch.setattr(P, "release_shuffles", lambda spark: None, raising=False)
    local, held, own = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), [], P.materialize

    def shuffles():
        names = (path.rsplit("/", 1)[-1] for path in local.getAllFiles().mkString(";").split(";"))
        return {name.split("_")[1] for name in names if name.startswith("shuffle_")}

    before = shuffles()

    def counted(*args, **kwargs):
        table = own(*args, **kwargs)
        end = time.time() + 10
        while shuffles() - before and time.time() < end:
            time.sleep(0.1)
        held.append(len(shuffles() - before))
        return table

    monkeypatch.setattr(P, "materialize", counted)
    rng = random.Random(15)
    passage = prose(rng, 80)
    assert P.repeated_passages(docs(spark, [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(20)])).count() == 19
    assert len(held) > 5 and not any(held)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
