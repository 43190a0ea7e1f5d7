"""Seeded fuzz: the Python-exact Column helpers against Python itself on
random strings mixing every Python whitespace / line-break character,
digits, commas, tags and markers."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from rewardlake.functions import text as T

ALPHABET = (list("ab x9-,.#{}<>/") + list(T.PY_SPACE_CHARS) + ["\r\n", "\x0b", "\x1c", "\x85", "\u2028"]
            + ["\\boxed{", "####", "<bash>", "</bash>", "<submit/>", "<submit  />", "__RC_8372916__:", "12", "3,4"])


def _strings(n=2000, seed=11):
    rnd = random.Random(seed)
    return [("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 25))),) for _ in range(n)]


def test_fuzz_properties(spark):
    """Strip and line split equal Python's; what the parsers return obeys the
    rules that hold for every text."""
    df = spark.createDataFrame(_strings(), "s string")
    out = df.select("s", T.py_strip("s").alias("strip"), T.split_lines("s").alias("lines"),
                    T.extract_answer("s").alias("ans"), T.tool_call("s").alias("tool"),
                    T.tool_call(T.py_strip("s")).alias("tool_of_stripped"),
                    T.exit_code_split("s").alias("rc")).collect()
    for r in out:
        s = r.s
        assert r.strip == s.strip(), repr(s)
        assert r.lines == s.splitlines(), repr(s)
        # an answer is trimmed, and there is one exactly if the text holds a number, a comma or a filled box
        assert r.ans is None or r.ans == r.ans.strip(), repr(s)
        if re.search("[0-9,]", s):
            assert r.ans is not None, repr(s)
        # a call is a submit without content or a trimmed command found in the text; outer space changes nothing
        assert r.tool in (("submit", ""), ("bash", r.tool[1])) and r.tool[1] == r.tool[1].strip() and r.tool[1] in s, repr(s)
        assert r.tool == r.tool_of_stripped and (s.strip() or r.tool[0] == "submit"), repr(s)
        if "<bash>" not in s and "<submit" not in s and s.strip():
            assert tuple(r.tool) == ("bash", s.strip()), repr(s)
        # without the sentinel the output stays as it is
        assert (r.rc[1] == -1 and r.rc[0] == s) or (r.rc[1] >= 0 and f"__RC_8372916__:{r.rc[1]}" in s.replace(":0", ":")
                                                    or "__RC_8372916__:" in s), repr(s)


def test_character_sets_equal_pythons():
    space = {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert space == set(T.PY_SPACE_CHARS)
    breaks = {chr(c) for c in range(0x110000) if len(("a" + chr(c) + "b").splitlines()) == 2}
    assert breaks == set(T.LINE_BREAK_CHARS)
