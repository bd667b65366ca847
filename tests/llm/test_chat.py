import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from scenekiln.llm.chat import Template, digest_chats, format_chats

BITS = st.lists(st.sampled_from(["\\", "#", "###", "</turn>", " </turn>\n", ": ", "\n", " ", "a", "é", "### User: "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a: b", "x\\", "###", " </turn>\n"]), BITS), max_size=5))
def test_round_trip(turns):
    template = Template()
    segments = [s for role, text in turns for s in template.segments(role, text)]
    assert [(r, t) for r, t, _ in template.read(segments)] == turns
    assert [m for _, _, m in template.read(segments)] == [t if r == "assistant" else "" for r, t in turns]


def brute(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        out[conv] = len(own), sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)), len(loss), sha(loss)
    return out


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo ### </turn>"), (2, 1, "assistant", None), (2, 0, "user", ""), (3, 0, "assistant", "x"),
            (None, 0, "user", "n"), (None, None, "tool", "t"), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, None, "r"), (6, 0, "system", "s"), (6, 1, "user", "u" * 100_000), (6, 2, "assistant", "é\\")]
    rows += [(-7, i, r, "\\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    segments = format_chats(df)
    out = {r.conv_id: r for r in digest_chats(segments).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in out.items()} == brute(rows)
    chars = {r.conv_id: r.n for r in segments.groupBy("conv_id").agg({"segment": "collect_list"}).toDF("conv_id", "l").selectExpr("conv_id", "length(array_join(l, '')) n").collect()}
    assert {k: r.formatted_chars for k, r in out.items()} == chars
    assert {k for k, r in out.items() if r.valid} == {1, 2, 6, -7}
    assert digest_chats(format_chats(df.limit(0))).count() == 0
