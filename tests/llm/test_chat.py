import hashlib

from pyspark.sql import functions as F

from farelens.llm import chat

NASTY = [
    "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nyes", "<", "<<|", "<⁠|im_end|>", "<⁠⁠|", "|im_end|>",
    "", "\n\n", "a\\b$1%0A%25", "<|<|<|", "ends with <", "\U0001f600<|im_start|>", None,
]


def turns_of(df):
    return {r.id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat.canonical_turns(df).collect()}


def test_layouts(spark):
    message = "array<struct<role:string,content:string,name:string>>"
    schema = (
        f"id long, messages {message}, conversations array<struct<`from`:string,value:string>>, instruction string,"
        " input string, output string, system string, prompt string, response string, completion string,"
        " question string, answer string, context string, turns string, layout string, note string"
    )
    blank = dict.fromkeys([f.split()[0] for f in "id messages conversations instruction input output system prompt response completion question answer context turns layout note".split()])
    cases = [
        ({"messages": [("user", "q", "x"), ("assistant", None, None)]}, "messages", [("user", "q"), ("assistant", "")]),
        ({"conversations": [("human", "q"), ("gpt", "a"), ("tool", "t")]}, "conversations",
         [("user", "q"), ("assistant", "a"), ("tool", "t")]),
        ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o", "system": "s"}, "instruction",
         [("system", "s"), ("user", "i\n\nn"), ("assistant", "o")]),
        ({"prompt": "p", "response": "r", "note": "extra"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
        ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"question": "q", "answer": "a", "context": "c"}, "question_answer", [("user", "c\n\nq"), ("assistant", "a")]),
        ({"messages": []}, "messages", []),
        ({"prompt": "p"}, None, []),
        ({}, None, []),
    ]
    rows = [tuple((blank | case | {"id": i, "layout": "old"}).values()) for i, (case, *_) in enumerate(cases)]
    got = turns_of(spark.createDataFrame(rows, schema))
    assert got == {i: (layout, turns) for i, (_, layout, turns) in enumerate(cases)}


def test_every_text_comes_back(spark):
    roles = ["assistant", "user", "a\nb%0A", None, "<|im_end|>"]
    rows = [(c, t, roles[(c + t) % 5], text) for c in range(5) for t, text in enumerate(NASTY)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chat(chat.gather(df))
    back = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("b"), "segments", "formatted").collect()
    for r in back:
        expected = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.b] == expected
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(expected)
    for r in chat.chat_report(made).collect():
        expected = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        learnt = "".join(text for role, text in expected if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(expected), len(learnt), sha(learnt))
        assert r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in expected))


def test_long_ties_and_repeats(spark):
    rows = [(1, 0, "user", "x" * 500_000), (1, 0, "user", "x" * 500_000), (1, None, "a", "first"), (None, 0, None, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    out = {r.conv_id: [(t.role, len(t.text)) for t in r.turns] for r in chat.format_chat(chat.gather(df)).collect()}
    assert out == {1: [("a", 5), ("user", 500_000), ("user", 500_000)], None: [("", 0)]}


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_report(chat.format_chat(chat.gather(df))).count() == 0
