from __future__ import annotations

import pytest

from millrace.functions.patterns import PatternError, literal_form, to_java_pattern
from millrace.functions.predicates import found
from pyspark.sql import functions as F

# pattern, lines it is found in, lines it is not found in
CASES = [
    (r"^<\d+>\s[A-Z]{3}", ["<34> Oct it begins".replace("Oct", "OCT")], ["<34>OCT", "x <34> OCT"]),
    (r"code=4[0-9]", ["x code=42"], ["code=52", "code=4"]),
    (r"unit-[a-f]{3}", ["(unit-bad)"], ["unit-xyz", "unit-ab"]),
    (r"begin.*end", ["begin and then end"], ["end begin"]),
    (r"^took [1-9]\d{2,}s", ["took 100s"], ["took 99s", "took 012s"]),
    (r"^\d$", ["7", "٣"], ["a", "77"]),
    (r"a.b", ["a\rb", "axb"], ["ab"]),
    (r"ab$", ["xab"], ["ab\r", "abc"]),
    (r"^\w$", ["é"], ["-"]),
    (r"(?i)^k$", ["k", "K", "K"], ["x"]),
    (r"(?P<year>\d+)-(?<month>\d+)", ["2024-01"], ["2024"]),
    (r"[[:alpha:]]", ["z"], ["1", ":", "é"]),
    (r"[[:^digit:]]", ["a"], ["1"]),
    (r"[^[:space:]x]", ["a"], ["x", " "]),
    (r"a*+b", ["b", "aab"], ["a"]),
    (r"(a*)*$", ["", "b"], []),
    (r"[]a]", ["]", "a"], ["b"]),
    (r"[^]a]", ["b"], ["]", "a"]),
    (r"[a-c-]", ["-", "b"], ["d"]),
    (r"[\x41-\x{43}]", ["B"], ["D"]),
    (r"[a[bc]]", ["c"], ["d"]),
    (r"[^a[bc]]", ["d"], ["a", "c"]),
    (r"\v", ["\x0b"], ["\n", "v"]),
    (r"é", ["é"], ["e"]),
    (r"\p{Greek}\pL", ["αx"], ["xα"]),
    (r"\P{L}", ["1"], ["a"]),
    (r"(?s-m:a.c)", ["abc"], ["ac"]),
    (r"x(?i)y|z", ["xY", "Z"], ["Xy"]),
    (r"\bcat\b", ["a cat."], ["concat"]),
    (r"a|", ["", "b"], []),
    (r"\#\-\~ \/", ["#-~ /"], ["#"]),
    (r"}]", ["}]"], ["}"]),
    (r"a{2}{2}", ["aaaa"], ["aaa"]),
    (r"\Aab\z", ["ab"], ["abc", "xab"]),
    ("", ["", "anything"], []),
    ("^", ["", "anything"], []),
    (r"\(ok\)", ["a (ok) b"], ["ok"]),
    (r"^start", ["start x"], ["x start"]),
    (r"\.gz$", ["a.gz"], ["agz", "a.gz "]),
    (r"^exact$", ["exact"], ["exactly", "inexact"]),
]


def test_translated_patterns_find_the_same_lines(spark):
    rows = [
        (i, line, want)
        for i, (_, hits, misses) in enumerate(CASES)
        for want, lines in ((True, hits), (False, misses))
        for line in lines
    ]
    df = spark.createDataFrame(rows, "i int, line string, want boolean")
    line = F.col("line")
    for build in (found, lambda c, p: c.rlike(to_java_pattern(p))):
        got = F.coalesce(
            *[F.when(F.col("i") == i, build(line, p)) for i, (p, _, _) in enumerate(CASES)]
        )
        wrong = [
            (CASES[r["i"]][0], r["line"]) for r in df.filter(got != F.col("want")).collect()
        ]
        assert wrong == []


@pytest.mark.parametrize(
    "pattern",
    [
        "[invalid", "(", ")", "a{", "a{2,1}", "*a", "(?:*)", "a|*", "(?=x)", "(?!x)", "(?<=x)",
        "(?<!x)", "(?>x)", r"\1", r"\Q", r"\Z", r"\G", r"\h", r"\R", "[z-a]", "[a-\\d]", "[\\d-z]",
        "[a&&b]", "[a--b]", "[[:nope:]]", r"\p{Nope}", r"\xZZ", r"\x{110000}", "(?x)a", "(?-u)a",
        "(?ii)a", "(?P<n>a)(?P<n>b)", "(?P<1>a)", "\\", "[\\b]", r"\b{start}", r"\<", "(?i", "[^a[^b]]",
    ],
)
def test_unusable_patterns_are_refused(pattern):
    with pytest.raises(PatternError):
        to_java_pattern(pattern)


def test_plain_text_needs_no_regex():
    assert literal_form("ERROR") == ("contains", "ERROR")
    assert literal_form(r"^\[dev\]") == ("startswith", "[dev]")
    assert literal_form(r"a\$") == ("contains", "a$")
    assert literal_form(r"\\$") == ("endswith", "\\")
    assert literal_form("a.b") is None
