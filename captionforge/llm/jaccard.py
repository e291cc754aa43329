"""Near-duplicate documents: chosen-path similarity join on word shingles.

1. A document becomes the set of its hashed five-word windows (one window of all words when it has fewer).
   Documents with the same set are one record with a number of copies; only records are joined.
2. A record goes down to the tokens whose hash is small (``BRANCH`` of a record in each run, the runs being
   consecutive ranges of the hash), so similar sets choose the same tokens and meet in the same buckets. The runs follow
   from the target recall. A row of a path is two numbers; sketches of 64 one-byte minima are joined where they are compared.
3. A bucket of at most ``BUCKET`` records is brute-forced on the sketches, to a spanning forest of candidate
   links; buckets with the same members are one. A record that has most of its paths in such buckets leaves the
   large ones, because its partners meet it here. What stays is groups that share most of their tokens.
4. In a large bucket the most frequent minimum of each bin is a centre. Records close to it become one candidate
   cluster with all that might be partners of such a record, and leave. The rest has a new centre, or is split on sampled
   tokens (minima) that the centre has not; after ``DEPTH`` splits it is compared by blocks.
5. Candidate links form clusters; all pairs inside a cluster are compared on their whole sets, in
   blocks of bounded size that give each record its number of links and a spanning forest.
   Pairs are never rows, a cluster is never in one task, and no bucket, partner or candidate is dropped.

Defined cases: null and empty texts have no token and resemble nothing, not even each other; a null
``doc_id`` is a document like others; repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionforge.llm.graph import connected_components
from captionforge.llm.text import lean, mix, window_hashes, word_groups
from captionforge.session import discard, in_tasks, materialize, small_batches

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
BRANCH = 4.0        # paths of a record in each run
BINS = 64
BUCKET = 128
DENSE_PATHS = 12    # paths of a record that are followed in large buckets
CENTRE_OF = 64      # records, in the mean, that a bucket's centre is taken from
DEEPER = 8          # children of a record in each split
DEPTH = 6
# A record leaves its bucket when it is as close as CENTRE_TAKES to the centre. By the triangle inequality of the
# distance of sketches its partners at 0.8 then resemble the centre by about 0.55 or more, and join its cluster.
CENTRE_TAKES = 0.75
CENTRE_LINKS = 0.25
BUCKET_ROWS = 1 << 14   # of small buckets, compared by one task
BLOCK_RECORDS = 2048
BLOCK_TOKENS = 1 << 19

RECORD = "struct<skey:binary,size:int,sketch:binary,paths:array<bigint>>"
_RECORD = pa.struct([("skey", pa.binary()), ("size", pa.int32()), ("sketch", pa.binary()), ("paths", pa.list_(pa.int64()))])


def runs_for(recall: float, threshold: float = THRESHOLD, branch: float = BRANCH) -> int:
    """Runs until a pair at the threshold meets with probability ``recall``.

    Two sets at Jaccard t share at least t of the paths of either. A record leaves large buckets if 1 - t / 2 of its
    paths are in small ones; even if all that the two do not share were among these, t / 2 of all paths would remain
    there, Poisson distributed.
    """
    return max(1, math.ceil(-math.log(1 - recall) / (threshold / 2 * branch)))


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) by groups of rows."""
    for words in word_groups(texts):
        hashes, first = window_hashes(words, n)
        rows = words.row[first]
        bounds = words.bounds()
        sizes = np.diff(bounds)
        short = [(r, length) for length in range(1, n) for r in np.flatnonzero(sizes == length)]
        if short:
            extra = np.array([_phrase_hash(words, int(bounds[r]), int(length)) for r, length in short], np.uint64)
            hashes = np.concatenate([hashes, extra])
            rows = np.concatenate([rows, np.array([r for r, _ in short], rows.dtype)])
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        hashes, rows = hashes[new], rows[new]
        at = np.searchsorted(rows, np.arange(words.n_rows + 1))
        yield words.first_row, [hashes[at[r]:at[r + 1]] for r in range(words.n_rows)]


def _phrase_hash(words, start: int, n: int) -> np.uint64:
    value = np.uint64(n)
    with np.errstate(over="ignore"):
        for h in words.hash[start:start + n]:
            value = mix(np.array([value * np.uint64(31) + h], np.uint64))[0]
    return value


def set_key(tokens: np.ndarray) -> bytes | None:
    """128 bits that name a set of tokens."""
    if not len(tokens):
        return None
    sums = [mix(tokens ^ np.uint64(seed)).sum(dtype=np.uint64) for seed in (0x51ED270B, 0xA24BAED4963EE407)]
    return np.array(sums, "<u8").tobytes()


def _sketch(tokens: np.ndarray) -> bytes:
    """Per bin the smallest token, as a byte from 1; 0 where the bin is empty."""
    h = mix(tokens ^ np.uint64(0xD6E8FEB86659FD93))
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (h % np.uint64(BINS)).astype(np.int64), h >> np.uint64(6))
    out = (mix(least) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    out[least == np.iinfo(np.uint64).max] = 0
    return out.tobytes()


def _records(wanted: float):
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for _, sets in shingle_sets(texts):
            for tokens in sets:
                if not len(tokens):
                    out.append({"skey": None, "size": 0, "sketch": None, "paths": None})
                    continue
                h = mix(tokens ^ np.uint64(0x2545F4914F6CDD1D))
                chosen = h[h <= np.uint64(min(1.0, wanted / len(tokens)) * (2**64 - 2**12))] if len(tokens) > wanted else h
                if not len(chosen):
                    chosen = h.min(keepdims=True)
                out.append({"skey": set_key(tokens), "size": len(tokens), "sketch": _sketch(tokens), "paths": chosen.view(np.int64)})
        return pa.array(out, _RECORD)

    return run


def _keys(texts: pa.Array) -> pa.Array:
    return pa.array([set_key(tokens) for _, sets in shingle_sets(texts) for tokens in sets], pa.binary())


def record_of(text_col: str, threshold: float = THRESHOLD, recall: float = RECALL) -> Column:
    find = _records(BRANCH * runs_for(recall, threshold))

    def batch(texts: pa.Array) -> pa.Array:
        return find(texts)

    return F.arrow_udf(lean(batch), RECORD)(F.col(text_col))


def key_of(text_col: str) -> Column:
    return F.arrow_udf(lean(_keys), "binary")(F.col(text_col))


def _grid(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, BINS)


def _alike(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard of sketches along the last axis, and the bins it rests on."""
    used = np.maximum(1, ((one != 0) | (other != 0)).sum(axis=-1))
    return ((one == other) & (one != 0)).sum(axis=-1) / used, used


def _may_pass(estimate: np.ndarray, used: np.ndarray, threshold: float) -> np.ndarray:
    """Five standard deviations below the threshold, or better."""
    return estimate >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / used)


def spanning_links(linked_rows: Iterator[tuple[int, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """A forest over 0..n-1 with the components of the links (i, each of the array)."""
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, others in linked_rows:
        for j in others:
            a, b = top(i), top(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, int(j)))
    return out


def _bucket_links(threshold: float):
    """Brute force of one bucket on the sketches: a spanning forest of the pairs that may pass."""

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def run(members: pa.Array) -> pa.Array:
        flat, ends = members.flatten(), np.append(0, np.cumsum(members.value_lengths().to_numpy()))
        rids, sizes, grid = flat.field("rid").to_numpy(), flat.field("size").to_numpy(), _grid(flat.field("sketch"))
        found, count = [], [0]
        for lo, hi in zip(ends, ends[1:]):
            sketch, size = grid[lo:hi], sizes[lo:hi]

            def rows():
                for i in range(1, hi - lo):
                    estimate, used = _alike(sketch[:i], sketch[i])
                    fits = np.minimum(size[:i], size[i]) >= threshold * np.maximum(size[:i], size[i])
                    yield i, np.flatnonzero(fits & _may_pass(estimate, used, threshold))

            forest = spanning_links(rows(), hi - lo)
            found += [(lo + i, lo + j) for i, j in forest]
            count.append(count[-1] + len(forest))
        pairs = rids[np.array(found, np.int64).reshape(-1, 2)]
        links = pa.StructArray.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])
        return pa.ListArray.from_arrays(pa.array(count, pa.int32()), links)

    return run


def _estimates(one: pa.Array, other: pa.Array) -> pa.Array:
    return pa.array(_alike(_grid(one), _grid(other))[0], pa.float64())


def _centres(members: pa.Array) -> pa.Array:
    """The most frequent byte of each bin of a list of sketches."""
    out = []
    for own in members:
        grid = _grid(own.values)
        counts = np.zeros((BINS, 256), np.int64)
        np.add.at(counts, (np.arange(BINS)[None, :], grid), 1)
        counts[:, 0] = 0
        out.append(counts.argmax(axis=1).astype(np.uint8).tobytes())
    return pa.array(out, pa.binary())


def _children(wanted: float):
    """Paths one token longer, for minima that the centre has not: ``wanted`` of a record in the mean, the same of similar records."""

    def run(path: pa.Array, sketch: pa.Array, centre: pa.Array) -> pa.Array:
        grid, middle = _grid(sketch), _grid(centre)
        paths = path.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        token = np.arange(BINS, dtype=np.uint64)[None, :] << np.uint64(8) | grid.astype(np.uint64)
        tagged = mix(token ^ mix(paths + np.uint64(1))[:, None])
        own = (grid != 0) & (grid != middle)
        share = np.minimum(1.0, wanted / np.maximum(1, own.sum(axis=1)))
        chosen = own & (tagged <= (share * (2**64 - 2**12)).astype(np.uint64)[:, None])
        child = mix(tagged[chosen] ^ np.uint64(0x94D049BB133111EB)).view(np.int64)
        ends = np.concatenate([[0], np.cumsum(chosen.sum(axis=1))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(child, pa.int64()))

    return run


def _forest(buckets: DataFrame, by: list[str], threshold: float, rows: int | None = None) -> DataFrame:
    """Links of each group; ``rows`` of them, if it is known, in tasks of ``BUCKET_ROWS``."""
    members = buckets.groupBy(*by).agg(F.collect_list(F.struct("rid", "size", "sketch")).alias("members"))
    if rows is not None:
        members = in_tasks(members, rows, BUCKET_ROWS)
    return members.select(F.explode(_bucket_links(threshold)("members")).alias("link")).select("link.*")


def _small_buckets(shared: DataFrame, records: DataFrame, threshold: float, n: int) -> DataFrame:
    """Links of buckets of a bounded size: those with the same members are compared once."""
    members = shared.groupBy("path").agg(F.sort_array(F.collect_list("rid")).alias("rids")).select("rids").distinct()
    rows = members.select(F.xxhash64("rids").alias("h"), F.get("rids", F.lit(0)).alias("first"), F.explode("rids").alias("rid"))
    return _forest(rows.join(records.select("rid", "size", "sketch"), "rid"), ["h", "first"], threshold, n)


def _rows_by_size(paths: DataFrame) -> tuple[int, int]:
    """Rows in small and in large buckets."""
    return tuple(paths.agg(F.count_if(F.col("n") <= BUCKET), F.count_if(F.col("n") > BUCKET)).first())


def _size_class(threshold: float) -> Column:
    """Sets at the threshold are in the same or in neighbouring classes."""
    return F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(threshold))).cast("int")


def _cluster_links(compared: DataFrame, centres: DataFrame, threshold: float) -> DataFrame:
    """Links to one taken record of the own size class of a path, else of a neighbouring one, and between these records."""
    near = compared.where(F.col("alike") >= CENTRE_LINKS).withColumn("class", _size_class(threshold))
    taken = near.where(F.col("alike") >= CENTRE_TAKES).groupBy("path", "class").agg(F.min("rid").alias("first"))
    # at most one entry for each class of sizes
    heads = taken.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("class", "first"))).alias("heads"))
    at = lambda step: F.try_element_at("heads", F.col("class") + step)
    linked = near.select("path", "rid", "class").join(heads, "path").select(
        F.col("rid").alias("a"), F.coalesce(at(0), at(-1), at(1)).alias("b"))
    between = heads.select(F.explode("heads").alias("class", "a"), "heads").select("a", F.explode(F.array(at(-1), at(-2))).alias("b"))
    return linked.union(between).where("a <> b")


def candidate_links(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) links between records (rid, size, sketch, paths) whose components hold every pair that meets."""
    links, used = [], []

    def kept(df: DataFrame, label: str) -> DataFrame:
        used.append(materialize(df, label))
        return used[-1]

    paths = records.select("rid", F.explode("paths").alias("path"))
    counts = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = kept(paths.join(counts, "path"), "shared")
    small, _ = _rows_by_size(shared)
    links.append(kept(_small_buckets(shared.where(F.col("n") <= BUCKET), records, threshold, small), "links"))
    # a record with most of its paths in small buckets, or alone, needs no large one
    dense = shared.where(F.col("n") > BUCKET)
    crowded = dense.groupBy("rid").agg(F.count(F.lit(1)).alias("dense"), F.sort_array(F.collect_list("path")).alias("own"))
    stays = crowded.join(records.select("rid", "size", "sketch", F.size("paths").alias("all")), "rid").where(
        F.col("dense") > threshold / 2 * F.col("all"))
    # the same tokens come first in similar sets, because a path is a hash of its token
    at = stays.select("rid", "size", "sketch", F.explode(F.slice("own", 1, DENSE_PATHS)).alias("path"), F.lit(0).alias("depth"))
    at = kept(at, "dense")
    while True:
        counts = at.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        at = kept(at.join(counts, "path"), "counted")
        small, wide = _rows_by_size(at)
        if small:
            links.append(kept(_forest(at.where(F.col("n") <= BUCKET), ["path"], threshold, small), "links"))
        if not wide:
            break
        large = at.where(F.col("n") > BUCKET)
        sampled = large.where(F.pmod(F.xxhash64("path", "rid", "depth"), F.col("n")) < CENTRE_OF)
        centres = in_tasks(sampled.groupBy("path").agg(F.collect_list("sketch").alias("own")), wide, BUCKET_ROWS)
        centres = kept(centres.select("path", F.arrow_udf(_centres, "binary")("own").alias("centre")), "centres")
        # every path has a centre of its own; without one (no record sampled) nothing is close to it
        met = large.join(centres, "path", "left").withColumn("centre", F.coalesce("centre", F.lit(bytes(BINS))))
        compared = kept(met.withColumn("alike", F.arrow_udf(_estimates, "double")("sketch", "centre")), "compared")
        links.append(kept(_cluster_links(compared, centres, threshold), "links"))
        left = compared.where(F.col("alike") < CENTRE_TAKES)
        now = left.groupBy("path").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        left = kept(left.join(now, "path").drop("alike"), "left")
        # a bucket that its centre has thinned out has another one, else it is split
        thinned = left.where((F.col("m") <= BUCKET) | (4 * F.col("m") <= 3 * F.col("n")))
        again = thinned.select("rid", "size", "sketch", "path", "depth")
        rest = left.where((F.col("m") > BUCKET) & (4 * F.col("m") > 3 * F.col("n")))
        links.append(_blocks(rest.where(F.col("depth") >= DEPTH), threshold))
        split = rest.where(F.col("depth") < DEPTH)
        child = F.arrow_udf(_children(DEEPER), "array<bigint>")("path", "sketch", "centre")
        split = split.select("rid", "size", "sketch", F.explode(child).alias("path"), (F.col("depth") + 1).alias("depth"))
        at = kept(again.union(split), "paths")
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    out = materialize(out.distinct(), "candidates")
    discard(*used)
    return out


def _blocks(rest: DataFrame, threshold: float) -> DataFrame:
    """All records of a bucket against each other, by pairs of blocks of about ``BLOCK_RECORDS``."""
    counts = rest.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / BLOCK_RECORDS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    paired = rest.join(counts, "path").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return _forest(paired, ["path", "lo", "hi"], threshold)


def _group_links(sets: list[np.ndarray], weights: np.ndarray, split: int, threshold: float):
    """Links of each set (documents, texts) and a spanning forest. Sets before ``split`` are compared with those from it on;
    with 0, all with all."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    kept = counts[inverse] > 1  # a token of one set is in no intersection
    column = np.cumsum(counts > 1) - 1
    owner, token = owner[kept], column[inverse[kept]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    left = split or n
    shared = np.zeros((left, n - split), np.float32)
    width = max(256, (4 << 20) // max(n, 1))
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        grid = np.zeros((n, width), np.float32)
        grid[owner[a:b], token[a:b] - lo] = 1
        shared += grid[:left] @ grid[split:].T
    docs, texts = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def rows() -> Iterator[tuple[int, np.ndarray]]:
        for i in range(left):
            common = np.rint(shared[i]).astype(np.int64)
            # whole numbers, so that a pair at the threshold is decided exactly
            linked = common * 1000 >= round(threshold * 1000) * (sizes[i] + sizes[split:] - common)
            if not split:
                linked[i] = False
            others = np.flatnonzero(linked) + split
            docs[i] += weights[others].sum()
            texts[i] += len(others)
            if split:
                docs[others] += weights[i]
                texts[others] += 1
            yield i, others

    forest = spanning_links(rows(), n)
    return docs, texts, forest


def _compare(threshold: float):
    """Streams sorted (cluster, lo, hi, skey, own, copies, text) rows and compares one group at a time."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("docs", pa.int64()), ("texts", pa.int64())])

    def flush(group: tuple, held: dict) -> pa.RecordBatch:
        # the two blocks of a pair one after the other
        keys = sorted(held, key=lambda k: (held[k][2], k))
        split = sum(held[k][2] == group[1] for k in keys) if group[1] != group[2] else 0
        if group[1] != group[2] and split in (0, len(keys)):
            return pa.RecordBatch.from_pylist([], schema=schema)
        docs, texts, forest = _group_links([held[k][0] for k in keys], np.array([held[k][1] for k in keys], np.int64), split, threshold)
        rows = [(k, None, int(d), int(t)) for k, d, t in zip(keys, docs, texts) if t] + [(keys[i], keys[j], 0, 0) for i, j in forest]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            rows = batch.select(["cluster", "lo", "hi", "skey", "own", "copies"]).to_pydict()
            for base, sets in shingle_sets(batch.column(batch.schema.get_field_index("text"))):
                for r, tokens in enumerate(sets, base):
                    here = (rows["cluster"][r], rows["lo"][r], rows["hi"][r])
                    if here != group:
                        if len(held) > 1:
                            yield flush(group, held)
                        group, held = here, {}
                    # a text with the same id and hash need not be the record
                    if set_key(tokens) == rows["skey"][r]:
                        held[rows["skey"][r]] = (tokens, rows["copies"][r], rows["own"][r])
        if len(held) > 1:
            yield flush(group, held)

    return run


def cluster_texts(docs: DataFrame, records: DataFrame, clusters: DataFrame) -> tuple[DataFrame, int]:
    """(cluster, lo, hi, skey, own, copies, text): the texts of each pair of blocks of a cluster; and all sets' tokens together."""
    members = clusters.join(records.select(F.col("rid").alias("node"), "skey", "doc_id", "text_hash", "size", "copies"), "node")
    members = materialize(members, "members")
    blocks = members.groupBy("component").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_RECORDS, F.sum("size") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = members.join(blocks, "component").withColumn("own", own)
    ids = placed.select(F.col("doc_id").alias("__id"), "text_hash", F.col("component").alias("cluster"), "skey", "copies", "own", "blocks")
    # an id may be null or repeated, so it takes the text's hash too to find a record's row
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    same = (hashed["text_hash"] == ids["text_hash"]) & F.col("doc_id").eqNullSafe(F.col("__id"))
    texts = hashed.join(ids.hint("merge"), same)
    spread = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "skey", "own", "copies", "text")
    return spread, members.agg(F.sum("size")).first()[0] or 0


def verified_links(docs: DataFrame, records: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """(a, b, docs, texts): links of a record to others, or (b not null) an edge of the forest."""
    spread, total = cluster_texts(docs, records, clusters)
    # a task holds the groups it was dealt one after the other
    # the work is in the sets, not in the bytes that adaptive execution would deal by
    dealt = spread.repartition(int(total // BLOCK_TOKENS) + 1, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    return dealt.mapInArrow(lean(_compare(threshold)), "a binary, b binary, docs bigint, texts bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, skey, copies, class_id, class_key, n_links, n_linked_texts.

    ``class_id`` is the smallest id of the component of links at ``threshold``; ``class_key`` names the
    record that holds it. ``n_links`` counts linked documents, copies included; ``n_linked_texts`` linked
    sets other than the own one.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = record_of("text", threshold, recall).alias("r")
    rows = materialize(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), found).select("doc_id", "text_hash", "r.*"), "rows")
    named = rows.where("skey is not null")
    # the smallest id that is not null, and the hash of a text it has
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("place")
    records = named.groupBy("skey").agg(place, F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"),
                                        F.min("sketch").alias("sketch"), F.min("paths").alias("paths"))
    # numbers that stay, because the table is written
    records = materialize(records.select(F.monotonically_increasing_id().alias("rid"), "skey", "place.doc_id", "place.text_hash", "copies", "size", "sketch", "paths"), "records")
    candidates = candidate_links(records.select("rid", "size", "sketch", "paths"), threshold)
    clusters = materialize(connected_components(candidates), "clusters")
    discard(candidates)
    checked = materialize(verified_links(docs, records, clusters, threshold), "verified")
    discard(clusters)
    classes = connected_components(checked.where("b is not null").select("a", "b"))
    links = checked.where("b is null").groupBy("a").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    labelled = records.select("skey", "doc_id", "copies").join(classes.withColumnRenamed("node", "skey"), "skey", "left")
    labelled = labelled.join(links.withColumnRenamed("a", "skey"), "skey", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "skey"))
    # the smallest id, nulls last, then the smallest key
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "skey")).alias("first")
    labelled = materialize(labelled, "labelled")
    of_class = labelled.groupBy("component").agg(first).select(
        "component", F.col("first.doc_id").alias("class_id"), F.col("first.skey").alias("class_key"))
    known = materialize(labelled.join(of_class, "component").select(
        "skey", "copies", "class_id", "class_key", (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_linked_texts")), "classes")
    discard(records, checked, labelled)
    empty = rows.where("skey is null").select(
        "doc_id", "skey", F.lit(1).cast("long").alias("copies"), F.col("doc_id").alias("class_id"), F.col("skey").alias("class_key"),
        F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_linked_texts"))
    return named.select("skey", "doc_id").join(known, "skey").select(*empty.columns).union(empty)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """``docs`` with one row of each near-duplicate class (its smallest id); texts without words all stay."""
    classes = near_duplicates(docs, id_col, text_col, **kwargs)
    chosen = classes.where("skey = class_key").select(
        F.col("class_key").alias("__k"), F.col("class_id").alias("__d")).distinct()
    keyed = docs.withColumn("__key", key_of(text_col))
    kept = keyed.join(chosen.hint("merge"), (F.col("__key") == F.col("__k")) & F.col(id_col).eqNullSafe(F.col("__d")), "left_semi")
    # rows repeated under one id are one document
    one = kept.dropDuplicates(["__key", id_col])
    return one.union(keyed.where("__key is null")).drop("__key")
