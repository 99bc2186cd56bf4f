"""Chat formatting: exact round trips."""

import hashlib
import random

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from toolweave.llm import chat

ENCODER = chat.Encoder(chat.read_ranks(chat.TOKENIZER))
TEXTS = st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<", "\\", "|", "\n", "n", "é", "<\\|", "a b"]), max_size=12).map("".join))


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS)
def test_turns_read_back(role, text):
    ids, start, stop = ENCODER.turn(role, text)
    assert ids.count(ENCODER.start) == ids.count(ENCODER.end) == 1
    reader = chat._Reader(1, ENCODER)
    reader.add(ids, [start <= i < stop for i in range(len(ids))])
    assert reader.row()[2] == hashlib.sha256(f"{role}\n{text}\n".encode()).hexdigest()
    assert reader.row()[4] == hashlib.sha256(text.encode()).hexdigest()
    assert chat.START not in chat.escape(text) and chat.END not in chat.role_line(role) and "\n" not in chat.role_line(role)


def test_long_words_and_nulls(spark):
    rows = [(1, 1, "assistant", "x" * 60_000), (1, 0, None, None), (None, 0, "user", "a"), (1, 1, "assistant", "x" * 60_000), (2, None, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {r.conv_id: r for r in chat.digests(chat.encode_turns(df)).collect()}
    assert by[1].n_turns == 3 and by[1].loss_chars == 120_000 and by[None].n_turns == 1 and by[2].loss_chars == 0
    assert by[1].loss_sha256 == hashlib.sha256(b"x" * 120_000).hexdigest()
    assert chat.digests(chat.encode_turns(df.limit(0))).count() == 0


def test_ids_are_those_of_the_whole_text():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "\n", "é", "1", "<|", "語", "'s"]) for _ in range(20_000)), "x" * 20_000, "a  \n\n" + " " * 3000 + "b" * 30]
    for text in texts:
        whole = ENCODER.plain.encode_ordinary(text)
        assert ENCODER.encode(text) == whole
        spaced = [i for m in regex.finditer(chat.PATTERN, text) for i in ENCODER.plain._encode_single_piece(m[0])]
        assert spaced == whole  # the way of texts with very long white space


def test_very_long_white_space():
    text = "a" + " " * 1_000_000 + "b\n" + "\n" * 300_000
    ids = ENCODER.encode(text)
    assert ENCODER.bytes_of(ids).decode() == text and ids[-1] != ids[0]
