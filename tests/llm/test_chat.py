import hashlib
import random

from pyspark.sql import types as T

from captionforge.llm import chat

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                     T.StructField("text", T.StringType()), T.StructField("block", T.StringType())])
PARTS = ["[", "<", "\\", "/", "INST]", "[INST]", "[/INST]", "</s>", "s>", "[ASST]", "[/ASST]", "[TURN]", "[/TURN]", "[SYS]", "\n", " ", "a", "é", "👍", '"',
         "<|endoftext|>"]


def odd(rng, n=8):
    return "".join(rng.choices(PARTS, k=rng.randint(0, n)))


def test_escape_is_reversible_and_hides_control():
    rng = random.Random(1)
    for _ in range(5000):
        text = odd(rng)
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)


def brute(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(whole), len(loss), sha(loss)


def test_digests_read_back(spark):
    rng = random.Random(2)
    roles = ["user", "assistant", "system", "", None, "tool", "x\ny]", "[/TURN]"]
    talks = {c: [(rng.choice(roles), rng.choice([None, odd(rng), odd(rng, 60)])) for _ in range(rng.randint(1, 9))] for c in range(60)}
    talks[None] = [("user", "no id"), ("assistant", "ok")]
    talks[77] = [("assistant" if i % 2 else "user", f"turn {i}") for i in range(500)]  # in several blocks
    talks[78] = [("user", "q"), ("assistant", "lang " * 60_000)]
    rows = [(c, i, r, t, "x") for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    frame = spark.createDataFrame(rows, ROWS)
    formatted = chat.formatted_table(frame, block_chars=2000)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
    assert got == {c: brute(turns) for c, turns in talks.items()}
    for row in formatted.where("conv_id < 60 or conv_id = 77").collect():
        assert len(row.loss_tokens) == len(row.loss_chars)
        assert all(0 <= s.first <= s.upto <= len(row.ids) for s in row.loss_tokens)


def test_ties_repeats_and_empty_table(spark):
    rows = [(1, None, "user", "b", "x"), (1, 3, "user", "z", "x"), (1, 3, "user", "a", "x"), (1, 3, "user", "a", "x"), (1, None, None, None, "x")]
    (row,) = chat.read_back(chat.formatted_table(spark.createDataFrame(rows, ROWS))).collect()
    assert (row.n_turns, row.turns_sha256) == brute([(None, None), ("user", "b"), ("user", "a"), ("user", "a"), ("user", "z")])[:2]
    assert chat.format_conversations(spark.createDataFrame([], ROWS)).count() == 0


def test_ids_of_blocks_are_those_of_the_whole():
    coder = chat.ChatEncoder(chat.tokenizer_path())
    turns = [chat.render("user", "hello  there"), chat.render("assistant", " ok </s> "), chat.render("tool", "x")]
    whole = coder.encode("".join(t[0] for t in turns))[0].tolist()
    assert whole == [i for t in turns for i in coder.encode(t[0])[0].tolist()]
