import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegrid.llm import chat

TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", "", "<|im_end|>"]),
                           st.text(alphabet="a%253C|<>\nim_end", max_size=20)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TURNS)
def test_turns_come_back_from_the_output_and_loss_is_the_assistants_text(turns):
    r = chat.Rendering(chat.marked_turns)
    pieces = [r.add(*t) for t in turns]
    assert "".join(p for p, _, _ in pieces) == chat.marked_turns(turns)
    assert [t for p, _, _ in pieces for t in chat.read_turns(p)] == turns
    assert [chat.unescape(p[a:b]) for (p, a, b), (role, _) in zip(pieces, turns, strict=True) if role == "assistant"] == [
        t for role, t in turns if role == "assistant"]
    assert not r.rewritten


def test_a_template_that_rewrites_history_is_told():
    def last_only(turns):
        return f"{len(turns)} turns; " + (turns[-1][1] if turns else "")

    r = chat.Rendering(last_only)
    r.add("user", "a")
    assert r.add("assistant", "b")[1:] == (0, 0)
    assert r.rewritten


LONG = [("assistant" if i % 2 else "user", f"text {i}") for i in range(200)]


def spans(turns, template, **more):
    r = chat.Rendering(template, **more)
    return r, [r.add(*t) for t in turns]


@pytest.mark.parametrize("local", [False, True])
def test_long_conversations_render_as_a_whole(local):
    r, pieces = spans(LONG, chat.marked_turns, local=local)
    assert "".join(p for p, _, _ in pieces) == chat.marked_turns(LONG) and not r.rewritten
    assert len(r.turns) == (200 if not local else len(r.turns)) and (not local or len(r.turns) <= chat.WINDOW)


def numbered(turns):
    return "".join(f"[{i}] {role}: {text}\n" for i, (role, text) in enumerate(turns))


def test_a_template_that_numbers_its_turns_gives_its_whole_output():
    r, pieces = spans(LONG, numbered)
    assert "".join(p for p, _, _ in pieces) == numbered(LONG) and not r.rewritten
    assert [p[a:b] for (p, a, b), (role, _) in zip(pieces, LONG) if role == "assistant"] == [t for role, t in LONG if role == "assistant"]
    assert spans(LONG, numbered, local=True)[0].rewritten  # it is not local, and is found out


def test_history_rewritten_late_is_told():
    late = lambda turns: ("gone" if len(turns) > 100 else "kept") + numbered(turns)
    assert not spans(LONG[:100], late)[0].rewritten
    r, pieces = spans(LONG, late)
    assert r.rewritten and pieces[-1][1:] == (0, 0)


def test_a_head_and_a_text_left_out_or_trimmed():
    r, pieces = spans(LONG[:6], lambda turns: "<s>" + "".join(f"{role};" for role, _ in turns))
    assert all(a == b <= len(p) for p, a, b in pieces) and not r.rewritten
    r, pieces = spans([("assistant", "  x  "), ("assistant", " ")], lambda turns: "<s>" + "".join(f"({text.strip()})" for _, text in turns), local=True)
    assert [p[a:b] for p, a, b in pieces] == ["x", ""]
    assert not spans(LONG, lambda turns: "<s>" + chat.marked_turns(turns), local=True)[0].rewritten


def test_tables(spark):
    rows = [(1, 1, "assistant", None, 0), (1, 0, "user", "hi <|im_end|>", 0), (None, None, None, "x", 1), (2, 5, "assistant", "é😀", 2)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.format_digests(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (2, sha("user\nhi <|im_end|>\nassistant\n\n"), 0)
    assert (got[2].loss_chars, got[2].loss_sha256) == (2, sha("é😀"))
    assert got[None].turns_sha256 == sha("\nx\n")
    assert chat.format_digests(df.where("false")).count() == 0
    pieces = chat.format_turns(df.where("conv_id = 1")).orderBy("turn").collect()
    assert "".join(r.piece for r in pieces) == chat.marked_turns([("user", "hi <|im_end|>"), ("assistant", "")])


@pytest.mark.parametrize("text", ["%", "%25", "<|", "%3C|", "<<||", ""])
def test_escapes_turn_back(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
