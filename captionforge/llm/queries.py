"""The operators as queries over the driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionforge.llm import chat, decontam, jaccard, licenses, packing, passages, periodic, quality, rules, squares, tokens, variants, warc
from captionforge.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op2_quality_cnn")
def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


@query("op4_decontaminate", f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
found AS (SELECT d.doc_id, p.i, p.n, x.item FROM
  (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
   FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)) p
  JOIN windows x ON x.n = p.n AND x.phrase = p.phrase JOIN docs d ON d.doc_id = p.doc_id),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY 1),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN names m ON m.doc_id = d.doc_id
""")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontam.scan(docs, table(spark, sf_dir, "benchmark"))
    return scanned.select(
        "doc_id", F.col("scan.n_words"), F.col("scan.n_hit"), F.size("scan.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "scan.items"), 256).alias("items_sha256"),
        decontam.is_contaminated().alias("contaminated"))


@query("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "copies", "n_links", "n_linked_texts")


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents")).drop("salt", "match_salt")


@query("op5_pack")
def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), of=F.crc32)
    return pieces.select("doc_id", "start", "length", F.col("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


_SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query("op8_quality_rules", f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_SPLIT} AS w FROM documents),
places AS (SELECT doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, phrase) AS c FROM places) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY 1),
base AS (SELECT d.doc_id, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines,
  string_split(text, chr(10)) AS lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS upper,
  length(regexp_replace(text, '[^!]+', '', 'g')) AS marks
  FROM docs d LEFT JOIN repeats r ON r.doc_id = d.doc_id),
judged AS (SELECT *, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_symbols * 2 > n_words OR upper * 10 > letters * 6
    OR letters * 2 < length(text) OR n_dup_lines * 10 > len(lines) * 3 OR marks * 5 > n_words
    OR len(list_filter(lines, lambda x: suffix(x, '...'))) * 10 > len(lines) * 3
    OR len(list_filter(w, lambda x: length(x) > 1000)) > 0) AS kept
FROM judged
""")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = rules.cascade(docs)
    text = rules.body()
    split = rules.with_words(docs)
    w = F.col(rules.WORDS)
    base = split.select(
        "doc_id", "text", rules.WORDS, rules.n_words(w).alias("n_words"), rules.word_chars(w).alias("word_chars"),
        rules.n_symbols(text).alias("n_symbols"), rules.n_dup_lines(text).alias("n_dup_lines"),
        rules.n_repeat_words(rules.windows(w)).alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = base.withColumn("base_failed", failed).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(rules.first_rejection(order).isNull()))
    return judged.drop("text", rules.WORDS)


@query("op7_warc", """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, payload_bytes, p.payload_digest,
  CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_chat_format", r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/INST\]|/ASST\]|/TURN\]|INST\]|ASST\]|/SYS\]|TURN\]|SYS\]|/s>|s>)', '\1\\\2\3', 'g') AS body FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 10 WHEN 'system' THEN 11 ELSE 16 + length(role) END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
""")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return chat.read_back(chat.formatted_table(turns.union(extra)))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("doc_id", tokens.count_tokens().alias("c"))
    return counted.select(
        "doc_id", F.col("c.n_tokens"), F.size("c.sections").cast("long").alias("n_lines"), F.col("c.n_crossing"),
        F.transform("c.sections", lambda s: s["tokens"].cast("int")).alias("line_tokens"))


def _license_sql() -> str:
    """The same scan with DuckDB list functions: identifiers by a join, rules by the same replacements."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in licenses.known_sentences().items())

    def split(ends: str) -> str:
        plain = f"trim(lower(regexp_replace(regexp_replace(coalesce(text, ''), '{ends}', chr(1), 'g'), '[^A-Za-z0-9\\x01]+', ' ', 'g')))"
        return f"list_filter(string_split_regex({plain}, ' ?\\x01[ \\x01]*'), lambda x: x <> '')"

    matched = "seq"
    for name, ids in licenses.RULES:
        pattern = f"u{{0,{licenses.MAX_GAP}}}".join(f"<{i}>" for i in ids)
        matched = f"regexp_replace({matched}, '{pattern}', '[{name}]', 'g')"
    return f"""
WITH known(s, id) AS (VALUES {known}),
texts AS (SELECT doc_id, 0 AS way, {split(licenses.END_OF_LINE)} AS f FROM documents
  UNION ALL SELECT doc_id, 1, {split(licenses.END_OF_SENTENCE)} FROM documents),
hits AS (SELECT doc_id, way, i, id FROM (SELECT doc_id, way, unnest(f) AS s, unnest(range(len(f))) AS i FROM texts) JOIN known USING (s)),
gaps AS (SELECT doc_id, way, i, repeat('u', CAST(least(9, i - lag(i, 1, -1) OVER (PARTITION BY doc_id, way ORDER BY i) - 1) AS BIGINT))
  || '<' || id || '>' AS part FROM hits),
seqs AS (SELECT doc_id, string_agg(part, '' ORDER BY i) AS seq FROM gaps GROUP BY doc_id, way),
done AS (SELECT doc_id, {matched} AS m FROM seqs),
marks AS (SELECT doc_id, unnest(regexp_extract_all(m, '\\[([^\\]]+)\\]', 1)) AS licence FROM done),
loose AS (SELECT doc_id, unnest(regexp_extract_all(m, '<([^>=]+)>', 1)) AS id FROM done)
SELECT d.doc_id, coalesce(l.names, '') AS licences, coalesce(o.names, '') AS loose FROM documents d
LEFT JOIN (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS names FROM (SELECT DISTINCT * FROM marks) GROUP BY 1) l ON l.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, string_agg(id, ',' ORDER BY id) AS names FROM (SELECT DISTINCT * FROM loose) GROUP BY 1) o ON o.doc_id = d.doc_id
"""


@query("op1_license_scan", _license_sql())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), out="found")
    return scanned.select("doc_id", F.concat_ws(",", "found.licences").alias("licences"), F.concat_ws(",", "found.loose").alias("loose"))


def _crc(value: str) -> str:
    """DuckDB has no crc32: a fold over the bytes of a string, each followed by eight shifts."""
    code = f"hex(encode({value}))"
    digit = f"(instr('0123456789ABCDEF', {code}[{{}}]) - 1)"
    byte = f"16 * {digit.format('2 * k + 1')} + {digit.format('2 * k + 2')}"
    steps = f"flatten(list_transform(range(strlen({value})), lambda k: list_concat([CAST({byte} AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))"
    fold = "lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce(list_concat([4294967295], {steps}), {fold}), 4294967295)"


@query("op11_word_runs", f"""
WITH split AS (SELECT doc_id, {_SPLIT} AS w, {_crc("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h FROM documents),
sized AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM split),
cycle AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM sized),
texts AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1])
  ELSE w END AS w FROM cycle),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM texts),
equal AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY ALL),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS rows,
  min(struct_pack(l := -length, start := start, period := period)) AS best FROM runs GROUP BY 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, -best.l AS length, best.period AS period,
  1000 * -best.l // best.period AS exponent_milli, sha256(coalesce(rows, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN listed USING (doc_id) LEFT JOIN kept k USING (doc_id)
""")
def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h")).withColumn(
        "w", F.when(F.col("h") % 10 == 0, words)).withColumns({"n": F.nullif(F.size("w").cast("long"), F.lit(0)), "g": F.floor(F.col("h") / 10)})
    # a tenth of the texts repeat their words from a place on
    docs = docs.withColumns({"a": F.col("g") % F.col("n"), "p": 1 + F.floor((F.col("n") - F.col("g") % F.col("n")) / (3 + F.col("g") % 8))})
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    cycled = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", place(i).cast("int"))), " ")
    texts = docs.select("doc_id", F.when(F.col("n").isNotNull(), cycled).otherwise(F.col("text")).alias("text"))
    found = periodic.with_runs(texts).withColumn("longest", periodic.longest(F.col("found.runs")))
    lines = F.array_join(F.transform("found.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("found.runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.concat(lines, F.when(F.size("found.runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("found.collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op12_spelling_variants", f"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY 1, 2),
hashed AS (SELECT run, c, {_crc("named")} AS h FROM counted),
spelled AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelled WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
cuts AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT x.word, y.word AS other FROM cuts x JOIN cuts y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, w.word FROM cuts x JOIN words w ON x.rest = w.word UNION SELECT w.word, x.word FROM cuts x JOIN words w ON x.rest = w.word),
best AS (SELECT near.word, count(*) AS n_near, min(struct_pack(less := -w.n, other := w.word)) AS top FROM near JOIN words w ON w.word = near.other GROUP BY 1),
judged AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 5 * n THEN top.other END AS form,
  CASE WHEN -top.less >= 5 * n THEN -top.less END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (WITH RECURSIVE c(word, last) AS (SELECT word, word FROM judged
  UNION ALL SELECT c.word, j.form FROM c JOIN judged j ON j.word = c.last WHERE j.form IS NOT NULL) SELECT * FROM c)
SELECT j.word, j.form, c.last AS root, j.n, j.n_near, j.form_n FROM judged j JOIN chain c ON c.word = j.word
JOIN judged e ON e.word = c.last AND e.form IS NULL
""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.word_counts(table(spark, sf_dir, "documents"), slips=199)
    return variants.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_squares_pack")
def op13_squares_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = squares.cut(table(spark, sf_dir, "documents"))
    digests = pieces.select(*squares.KEY, "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(squares.place(pieces), squares.KEY).drop(*squares.KEY)
