"""Chats: the joined string alone gives the turns back."""

import hashlib
import random

import pytest

from flowscape.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = [*chat.DEFAULT.controls, "␛", "␛0", "␛1", "a", "é\n", "[", "<", "]", ">", "/", "", "<</SYS", "[/INST", " x"]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escaping_round_trip_and_no_control_is_left():
    codec, rng = chat.Codec(chat.DEFAULT), random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 8)))
        escaped = codec.escape(text)
        assert codec.unescape(escaped) == text
        assert not any(c in escaped for c in chat.DEFAULT.controls)


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_joined_string_gives_the_turns(step):
    """Whatever the texts and roles hold and however the string is cut."""
    rng = random.Random(step)
    codec, template = chat.Codec(chat.DEFAULT), chat.DEFAULT
    for _ in range(300):
        turns = [(rng.choice(["system", "user", "assistant", "tool", "", "".join(rng.choices(PIECES, k=2))]), "".join(rng.choices(PIECES, k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 5))]
        joined = ""
        for role, text in turns:
            known = role if role in template.before and role != "*" else "*"
            joined += template.before[known].replace("{role}", codec.escape(role)) + codec.escape(text) + template.after[known]
        reader, got = chat.Reader(template), []
        for a in range(0, len(joined), step):
            got += reader.feed(joined[a : a + step])
        assert got == turns and reader.held == ""


def test_rows(spark):
    probe = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "␛0</s>"), (1, 0, "user", None), (2, 0, "[ROLE]x", "a"), (2, 0, "[ROLE]x", "a"), (-1, 0, "user", probe), (-1, 1, "assistant", probe), (None, 0, None, "t"), (3, 0, "user", "long " * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "'x' as segment", "true as loss")
    segments = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    assert got[1].turns_sha256 == _sha("user\n\nassistant\n␛0</s>\n") and got[1].valid and got[1].loss_sha256 == _sha("␛0</s>") and got[1].loss_chars == 6
    assert got[2].n_turns == 2 and not got[2].valid
    assert got[-1].turns_sha256 == _sha(f"user\n{probe}\nassistant\n{probe}\n") and got[-1].loss_sha256 == _sha(probe)
    assert got[None].turns_sha256 == _sha("\nt\n") and got[None].loss_chars == 0
    assert got[3].formatted_chars == 5 * 300_000 + 13
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0
