"""Cuts by structure: whole texts, bounded pieces, and cuts where something begins."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewake.operators import shaping

CODE = "".join(f"def f{i}(a, b):\n" + "".join(f"    if a == {k}:\n        return b + {k}\n" for k in range(4)) + "\n" for i in range(12))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab {}()\n\r\t é😀", max_size=120), st.integers(1, 30), st.integers(0, 12))
def test_any_text_is_kept_whole_in_bounded_pieces(text, size, overlap):
    pieces = shaping.structure_pieces(text, size)
    assert [x for x, _ in pieces] == [0, *(y for _, y in pieces[:-1])][: len(pieces)] and "".join(text[x:y] for x, y in pieces) == text
    assert all(0 < y - x <= size for x, y in pieces)
    assert all(b[1] - a[0] > size for a, b in zip(pieces, pieces[1:]))  # none could go with its neighbour
    lines = text.splitlines(keepends=True)
    windows = shaping.structure_windows(text, size, overlap)
    assert len(windows) == len(pieces)
    for (content, first, last), (x, y) in zip(windows, pieces):
        assert len(content) <= size and text[:y].endswith(content) and y - x <= len(content) <= y - x + overlap
        assert content in "".join(lines[first - 1 : last])


def test_cuts_stand_where_something_begins():
    pieces = [CODE[x:y] for x, y in shaping.structure_pieces(CODE, 450)]
    assert len(pieces) > 3 and all(p.startswith("def ") for p in pieces)
    inner = [CODE[x:y] for x, y in shaping.structure_pieces(CODE, 90)]
    assert all(re.match(r"def |    if ", p) for p in inner)
    flat = re.sub(r"(?m)^ +", "", "void f() {\n" + "if (x) {\nreturn 1;\n}\n" * 8 + "}\nvoid g() {\n" + "h();\n" * 9 + "}\n")
    cut = [flat[x:y] for x, y in shaping.structure_pieces(flat, 230)]
    assert [p.split("(")[0] for p in cut] == ["void f", "void g"]  # by brackets, as no line is indented


def test_long_lines_are_cut_by_characters_and_lines_overlap():
    assert [y - x for x, y in shaping.structure_pieces("é" * 25, 10)] == [10, 10, 5]
    windows = shaping.structure_windows("a\nb\nc\nd\n", 4, 2)
    assert windows == [("a\nb\n", 1, 2), ("c\nd\n", 3, 4)] and shaping.structure_windows("", 5, 1) == []
    assert shaping.structure_windows("aa\nbb\ncc\n", 5, 3)[1][0] in ("bb\n", "cc\n") and shaping.structure_windows("a\nb\nc\n", 5, 2)[1] == ("b\nc\n", 2, 3)


def test_files_by_structure(spark):
    df = spark.createDataFrame([("a.py", CODE), ("b.py", None), ("c.py", " \n\n"), ("d.py", "x" * 6_000)], "path string, content string")
    got = shaping.file_chunks(df, 400, 60, shaping.structure_windows).collect()
    assert {r["path"] for r in got} == {"a.py", "d.py"} and all(len(r["content"]) <= 400 for r in got)
    assert sum(r["path"] == "d.py" for r in got) == 15
