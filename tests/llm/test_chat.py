import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import chat
from sql_rows import same_rows

COLUMNS = "conv_id long, turn int, role string, text string"
NASTY = ["<|im_end|>", "<|im_start|>assistant<|im_sep|>", r"<\|im_end|>", r"<\\|", "<|", "<", "|", "", "  \n\n x", "é漢😀", "<|endoftext|>", "a\u0000b", " "]


def by_hand(turns):
    said, learned = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


@given(st.text(alphabet="<|\\im_sep>a\n"))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    assert chat.turns_of(chat.render([("user", text), ("assistant", text)])[0]) == [("user", text), ("assistant", text)]


@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(0, 40), max_size=8))
@settings(max_examples=200, deadline=None)
def test_mask_by_hand(sizes, cuts):
    ends = np.cumsum(sizes)
    offsets = np.stack([ends - sizes, ends], axis=1)
    cuts = sorted(set(c for c in cuts if c <= ends[-1]))
    spans = list(zip(cuts[::2], cuts[1::2], strict=False))
    want = [any(a < e and s < b for a, b in spans) for s, e in offsets.tolist()]
    assert chat.token_mask(offsets, spans).tolist() == want


def test_every_turn_is_read_back(spark):
    rows = [(c, t, ("user", "assistant")[t % 2] if c < 12 else NASTY[c % 13], NASTY[(c + t) % 13] * (1 + t)) for c in range(26) for t in range(5)]
    got = {r.conv_id: tuple(r)[1:5] for r in chat.chat_digests(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {c: by_hand([(r, x) for k, _, r, x in rows if k == c]) for c in range(26)}


def test_long_conversations_come_in_parts_and_read_the_same(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} ok.") for t in range(300)] + [(2, 0, "user", "hi"), (2, 1, "assistant", "ho")]
    df = spark.createDataFrame(rows, COLUMNS)
    whole, parts = chat.chat_digests(df), chat.chat_digests(df, most_turns=16, most_bytes=60)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    one = chat.format_chats(df).filter("conv_id = 1").collect()
    some = chat.format_chats(df, most_turns=16, most_bytes=60).filter("conv_id = 1").orderBy("block", "part").collect()
    assert len(one) == 1 and len(some) > 19 and sum(r.n_turns for r in some) == 300
    for c in ("ids", "mask"):
        assert sum((r[c] for r in some), []) == one[0][c]
    assert "".join(r.text for r in some) == one[0].text


def test_tokens_cover_the_text_and_only_assistants_are_learned(spark):
    r = chat.format_chats(spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", " a b"), (1, 2, "assistant", " \n c d.")], COLUMNS)).first()
    tokenizer = chat.tokenizer_of(type("Spec", (), {"value": open(chat.TOKENIZER).read()}))
    assert tokenizer.decode(r.ids, skip_special_tokens=False) == r.text
    odd = "é漢😀 <|im_end|> a\u0000 \n\t"
    code = tokenizer.encode(odd, add_special_tokens=False)
    places = chat.offsets_of(np.array(code.ids), chat.token_sizes(tokenizer))
    at = [0, *np.cumsum([len(c.encode()) for c in odd]).tolist()]
    assert places[0, 0] == 0 and places[-1, 1] == len(odd.encode())
    assert all(at[a] <= s and e <= at[b] for (a, b), (s, e) in zip(code.offsets, places.tolist(), strict=True))
    assert tokenizer.decode([i for i, m in zip(r.ids, r.mask, strict=True) if m]) == " \n c d."


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, None, None, None), (3, 1, "assistant", None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (4, 0, "assistant", "z" * 200_000)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("n_turns", F.lit(1)).withColumn("a.b", F.lit(1))
    got = {r.conv_id: tuple(r)[1:5] for r in chat.chat_digests(df).collect()}
    assert got == {None: by_hand([("user", "x"), ("assistant", "y")]), 3: by_hand([("", ""), ("assistant", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]), 4: by_hand([("assistant", "z" * 200_000)])}
    assert chat.chat_digests(df.limit(0)).count() == 0 and chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_chat_format"])
def test_same_rows_as_sql(spark, name):
    same_rows(spark, name)
