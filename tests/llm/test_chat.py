"""Records against the turns they were made from, and masks against the assistant's texts."""

import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F

from tablewise.llm import chat
from tablewise.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))


def got(r):
    return (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)


def test_query_on_given_conversations(spark):
    folder = "/root/testdata/sf0.01"
    talks = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    rows = spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect()
    for r in rows:
        talks.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    found = QUERIES["op8_chat_format"](spark, folder).collect()
    assert {r.conv_id: got(r) for r in found} == {c: expected(t) for c, t in talks.items()}
    assert all(r.formatted_chars > r.loss_chars for r in found)


def test_escapes_are_reversible():
    rnd = random.Random(4)
    for _ in range(20_000):
        text = "".join(rnd.choice(["<", "|", "\\", "<|", "a", "<|im_end|>", "<\\|"]) for _ in range(rnd.randint(0, 9)))
        assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)


def test_random_turns_and_odd_rows(spark):
    rnd = random.Random(8)
    parts = ["é", "🙂", "\n", "\n\n", " ", "a", "<|im_end|>", "<|endoftext|>", "<|im_sep|>", "\\", "漢字", "\r\n", "\x00"]
    talks = {
        c: [
            (rnd.choice(["user", "assistant", "assistant", "x<|im_sep|>"]), "".join(rnd.choices(parts, k=rnd.randint(0, 8))))
            for _ in range(rnd.randint(1, 6))
        ]
        for c in range(200)
    }
    talks[500] = [("assistant", "word " * 100_000)]
    rows = [(c, n, r, t, 1) for c, turns in talks.items() for n, (r, t) in enumerate(turns)]
    rows += [(600, 0, "assistant", None, 1), (600, 1, None, "x", 1), (None, 0, "user", "u", 1), (None, 1, "assistant", "v", 1)]
    talks[600] = [("assistant", ""), ("", "x")]
    talks[None] = [("user", "u"), ("assistant", "v")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mask int")
    found = chat.format_chats(docs, PATH).collect()
    assert {r.conv_id: got(r) for r in found} == {c: expected(t) for c, t in talks.items()}
    for r in found:
        assert len(r.ids) == len(r["mask"]) and chat.read_back(r.formatted) == talks[r.conv_id]
    assert chat.format_chats(docs.limit(0), PATH).count() == 0


def test_repeated_turns_stay(spark):
    docs = spark.createDataFrame([(1, 0, "assistant", "b")] * 2 + [(1, 0, "assistant", "a")], "conv_id long, turn long, role string, text string")
    found = chat.format_chats(docs.withColumn("ids", F.lit(1)), PATH).first()
    assert got(found) == expected([("assistant", "a"), ("assistant", "b"), ("assistant", "b")])
