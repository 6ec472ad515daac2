"""Parsing, turns, chunks and the code splitter."""

import json

import pytest
from pyspark.sql import functions as F

from parlance.functions.text import collection, language, strip
from parlance.operators import chunks, sessions, splitter, turns
from parlance.operators.parsing import parse_line, parse_lines, parse_strings
from parlance.plans.queries import transcript_lines
from parlance.sources.transcripts import parse_events, read_lines, rejected, route


def said(role, content):
    return json.dumps({"timestamp": "t", "message": {"role": role, "content": content}})


@pytest.mark.parametrize(
    ("line", "content"),
    [
        (said("user", " hi \n"), "[text]\n hi"),
        (said("user", [{"type": "text", "text": "a"}, {"type": "image"}]), "[text]\na\n[Image Attached]"),
        (said("user", [{"type": "tool_result", "content": ["x", 2, None, True]}]), "[tool_result]\nx\n2\nNone\nTrue"),
        (said("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}]), "[thinking]\nhm[text]\nok"),
        (said("assistant", [{"type": "tool_use", "name": "Write", "input": {"p": "a.py", "n": 1.5, "b": False}}]), "[Write]\na.py\n1.5\nFalse"),
    ],
)
def test_parse_line(line, content):
    assert parse_line(line) == ("t", json.loads(line)["message"]["role"], content)


@pytest.mark.parametrize("line", ["", "x", "3", "null", "[]", '{"message": null}', '{"a": 1}', said("system", "x"), said("assistant", "text"), said("user", None), said("user", [3, {"type": "other"}])])
def test_lines_that_give_nothing(line):
    # a plain string, not a list of blocks, from the assistant has no blocks either
    assert parse_line(line) is None or line == said("user", " ")


def _messages(spark, lines):
    rows = [("c", "s", i, x) for i, x in enumerate(lines)]
    return parse_lines(spark.createDataFrame(rows, "collection string, session_id string, pos int, line string"))


def test_turns(spark):
    got = turns.assign_turns(_messages(spark, transcript_lines())).orderBy("pos").select("turn_no", "msg_no", "role").collect()
    assert [r.turn_no for r in got] == [1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3]
    assert [r.msg_no for r in got] == [0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 0]


def test_last_turn_without_a_start(spark):
    lines = [said("assistant", [{"type": "text", "text": str(i)}]) for i in range(3)]
    assert turns.last_turn(_messages(spark, lines)).count() == 3


def test_chunks(spark):
    found = chunks.process_turns(turns.assign_turns(_messages(spark, transcript_lines()))).orderBy("turn_no", "chunk_no").collect()
    context = [r.text for r in found if r.chunk_no == 0]
    # only the first tag of a message decides, so what begins with an image or a thought is not in the context
    assert context == ["[USER] write a parser\n[ASSISTANT] Sure.\n[Read]\np/a.py\n", "[USER] now in java\n", "[USER] \n"]
    code = [r for r in found if r.chunk_no]
    assert {r.file_path for r in code} == {"p/a.py", "M.java", "n.txt"}
    assert len([r for r in code if r.file_path == "p/a.py"]) > 1
    for r in code:
        assert r.chunk_id == f"{r.parent_id}_code_{r.chunk_no - 1}"
        assert splitter.weight(r.text) <= splitter.MAX_CHARS
    again = chunks.process_turns(turns.assign_turns(_messages(spark, transcript_lines()))).select("chunk_id").collect()
    assert sorted(r.chunk_id for r in again) == sorted(r.chunk_id for r in found)


def test_splitter_keeps_every_line():
    python = "import a\n\n@d\nclass K:\n" + "\n".join(f"    def f{i}(self):\n        return '{'x' * 60}'" for i in range(30)) + "\n\nprint(1)"
    for code, name in ((python, "python"), (python.replace(":", ":"), "java"), ("{\n" * 3 + "x;\n" * 900 + "}\n" * 3, "typescript"), ("def broken(:\n" * 200, "python")):
        pieces = splitter.split_code(code, name, 300)
        assert "\n".join(pieces).split() == code.split()
        assert all(splitter.weight(p) <= 300 or "\n" not in p.strip() for p in pieces)
    assert splitter.split_code("x" * 5000, None) == ["x" * 5000]


def test_text_functions(spark):
    df = spark.createDataFrame([("\u3000\x1c a b\n\t", "x/y/z.PY"), ("", "z.js"), (None, None)], "t string, p string")
    got = df.select(strip(F.col("t")), language(F.col("p")), collection(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("a b", "python", "y"), ("", "typescript", ""), (None, None, "")]


def test_files_and_events(spark, tmp_path):
    folder = tmp_path / "proj"
    folder.mkdir()
    (folder / "s1.jsonl").write_text("\n".join(transcript_lines()))
    lines = read_lines(spark, str(folder))
    assert {(r.collection, r.session_id) for r in lines.select("collection", "session_id").distinct().collect()} == {("proj", "s1")}
    assert parse_lines(lines).count() == 11
    assert parse_lines(read_lines(spark, str(folder), skip_first_line=True)).count() == 10
    raw = spark.createDataFrame([(json.dumps({"hook_event_name": n, "session_id": "s", "transcript_path": "/a/b/c", "prompt": "p"}),) for n in ("Stop", "UserPromptSubmit", "SessionEnd", "Odd")] + [("{",), ("",)], "value string")
    events = parse_events(raw)
    assert [route(events, n).count() for n in ("Stop", "UserPromptSubmit", "SessionEnd")] == [1, 1, 1]
    assert [r.reason for r in rejected(events).collect()] == ["unknown event"]
    with pytest.raises(ValueError):
        route(events, "Odd")


def test_plain_strings_and_sessions(spark):
    lines = [said("user", "q1"), said("assistant", "a1"), said("assistant", "a2"), said("user", "q2"), "junk"]
    df = spark.createDataFrame([("c", "s", i, x) for i, x in enumerate(lines)], "collection string, session_id string, pos int, line string")
    messages = parse_strings(df)
    assert messages.count() == 4
    pairs = sessions.qa_pairs(messages).orderBy("turn_no").collect()
    assert [(r.prompt, r.response, r.document) for r in pairs] == [("q1", "a1\na2", "Q: q1\nA: a1\na2"), ("q2", "", "Q: q2\nA: ")]
    told = sessions.session_summary(messages).first()
    assert (told.turn_count, told.message_count, told.first_prompt) == (2, 4, "q1")
