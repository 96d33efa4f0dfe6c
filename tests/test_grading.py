import math

import pytest
from pyspark.sql import functions as F

from answerloom.functions import grading as G


def column(spark, values, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_last_boxed(spark):
    cases = {
        r"foo \boxed{42}": "42",
        r"\boxed{a} bla \boxed{b+c}": "b+c",
        r"noise \boxed   {  x^2 } end": "  x^2 ",
        r"\boxed{outer {inner} ok}": "outer {inner} ok",
        r"nothing here": None,
        r"\boxed  not_brace": None,
        r"\boxed{unbalanced": None,
        r"\boxed{a{b}": None,
        r"\boxed{{{x}}y} }": "{{x}}y",
        r"\boxed{}": "",
    }
    assert column(spark, list(cases), G.last_boxed) == list(cases.values())


def test_final_candidate(spark):
    cases = {
        "Steps...\n\\boxed{3/4}\nDone.": "3/4",
        "Reasoning...\n\\boxed{\\frac{3}{4}}": r"\frac{3}{4}",
        "Compute...\n\\boxed{\\sqrt{2}}": r"\sqrt{2}",
        "Tuple case...\n\\boxed{(1,2)}": "(1,2)",
        r"Earlier box \boxed{1/3}, later \boxed{2/3}": "2/3",
        r"Noisy \boxed   {  x^2 } trailing text": "x^2",
        r"Nested braces \boxed{outer {inner} ok}": "outer {inner} ok",
        r"In math mode: $ \boxed{ \dfrac{14}{3} } $": r"\dfrac{14}{3}",
        "Some steps...\nFinal Answer: 14/3": "14/3",
        "All done. 1 \nFinal 2 answer: ": "2",
        "no digits": "no digits",
        "": "",
    }
    assert column(spark, list(cases), G.final_candidate) == list(cases.values())
    only = column(spark, ["no digits", "7 and 8"], lambda c: G.final_candidate(c, "number_only"))
    assert only == ["", "8"]
    assert column(spark, ["7 and 8"], lambda c: G.final_candidate(c, None)) == [""]


def test_normalize_answer(spark):
    cases = {
        "  3/4  ": "3/4",
        "\n\t  (1, 2)  \t": "(1, 2)",
        "$2/3$": "2/3",
        r"\( 2/3 \)": "2/3",
        r"\left(1,\,2\right)": "(1,2)",
        r"\frac{3}{4}": "(3)/(4)",
        r"\dfrac{14}{3}": "(14)/(3)",
        r"(3)/(4)": "(3)/(4)",
        "c. 3": "3",
        "b: 2": "2",
        r"\sqrt{2}": "sqrt(2)",
        r"{x}": "x",
        r"{ (1, 2) }": "(1, 2)",
        "2²": "2**2",
        "1,234": "1234",
        "3 1/2": "3+1/2",
        "<|im_end|>Yes": "yes",
        r"50\%": "50",
        r"\text{(C)}": "(c)",
    }
    assert column(spark, list(cases), G.normalize_answer) == list(cases.values())


def test_answer_parts(spark):
    cases = {
        "(a, b)": ["a", "b"],
        "[x,y,z]": ["x", "y", "z"],
        "( 1 ,  2 )": ["1", "2"],
        "hello": ["hello"],
        "(a)": ["(a)"],
        "(a, )": ["(a, )"],
        "": [],
    }
    assert column(spark, list(cases), G.answer_parts) == list(cases.values())


GRADES = [
    ("3/4", r"\frac{3}{4}", "correct"),
    ("(3)/(4)", r"3/4", "correct"),
    (r"\frac{\sqrt{8}}{2}", "sqrt(2)", "needs_cas"),
    (r"\( \frac{1}{2} + \frac{1}{6} \)", "2/3", "correct"),
    ("(1, 2)", r"(1,2)", "correct"),
    ("(2, 1)", "(1, 2)", "wrong"),
    ("(1, 2, 3)", "(1, 2)", "wrong"),
    ("0.5", "1/2", "correct"),
    ("0.3333333333", "1/3", "wrong"),
    ("1,234/2", "617", "correct"),
    (r"\text{2/3}", "2/3", "correct"),
    ("50%", "1/2", "wrong"),
    (r"2\cdot 3/4", "3/2", "correct"),
    (r"90^\circ", "90", "correct"),
    (r"\left(\frac{3}{4}\right)", "3/4", "correct"),
    ("(1,2,3)", "(1,2,3)", "correct"),
    ("(1,2,3)", "(1,2)", "wrong"),
    ("", "1/2", "wrong"),
    (None, "1/2", "wrong"),
    ("1/2", None, "wrong"),
    ("13/4.", r"(13)/(4)", "correct"),
    ("0.5", r"(1)/(2)", "correct"),
    ("14/3", "15/3", "wrong"),
    ("(14/3, 2/3)", "(14/3, 4/6)", "correct"),
    ("(3)(4)", "34", "wrong"),
    ("3**2", "9", "correct"),
    ("1/0", "1", "needs_cas"),
    ("x+1", "1+x", "needs_cas"),
    ("-3", "3", "wrong"),
    ("007", "7", "correct"),
    ("9" * 40, "1.5", "needs_cas"),
]


def test_grade(spark):
    rows = [(i, p, g) for i, (p, g, _) in enumerate(GRADES)]
    df = spark.createDataFrame(rows, "i int, p string, g string")
    got = [r.verdict for r in G.grade(df, "p", "g").orderBy("i").collect()]
    wrong = [(g, case) for g, case in zip(got, GRADES) if g != case[2]]
    assert not wrong


def test_every_answer_equals_itself_and_its_box(spark):
    answers = ["3/4", r"\frac{\sqrt{8}}{2}", "(1, 2)", "x+1", r"\text{Evelyn}", "1,234", r"90^\circ"]
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    boxed = df.withColumn(
        "b", G.final_candidate(F.concat(F.lit("\\boxed{"), "a", F.lit("}")))
    ).withColumn("k", G.final_candidate(F.lit("\\boxed{123}")))
    assert {r.verdict for r in G.grade(boxed, "a", "a").collect()} == {"correct"}
    assert {r.verdict for r in G.grade(boxed, "b", "a").collect()} == {"correct"}
    assert "correct" not in {r.verdict for r in G.grade(boxed, "k", "a").collect()}


def test_heuristic_score(spark):
    texts = ["Result \\boxed{7}", "The answer is 7", "No numeric result here"]
    got = column(spark, texts, lambda c: G.heuristic_score(c))
    want = [2 + 1.5 * math.exp(-len(texts[0]) / 500), 1 + 1.5 * math.exp(-len(texts[1]) / 500),
            1.5 * math.exp(-len(texts[2]) / 500)]
    assert got == pytest.approx(want, rel=1e-9)
    bonus = column(spark, texts[2:], lambda c: G.heuristic_score(c, 100.0, fulltext_bonus=0.3))
    assert bonus == pytest.approx([0.3 + 1.5 * math.exp(-len(texts[2]) / 100)])


def test_rewards(spark):
    rows = [("Result \\boxed{2}", "2"), ("Answer is 2", "2"), ("Answer is 3", "2"),
            ("\\boxed{3}", "2"), ("\\boxed{x+1}", "1+x"), ("", "2")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, g string")
    out = G.rewards(df, "t", "g").orderBy("i").collect()
    assert [r.reward for r in out] == [1.0, 0.0, 0.0, 0.0, None, 0.0]
    assert [r.partial_reward for r in out] == [1.0, 0.5, 0.0, 0.0, None, 0.0]
    assert [r.format_bonus_reward for r in out] == [1.1, 1.0, 0.0, 0.1, None, 0.0]
    assert [r.undecided for r in out] == [False, False, False, False, True, False]


def test_answer_class(spark):
    cases = {
        r"\text{Evelyn}": ("text", "Evelyn"),
        r"52_8": ("base_subscript", "52_8"),
        r"\$32,\!348": ("currency", "32348.0"),
        r"\text{(C)}": ("text", "(C)"),
        r"(0,9) \cup (9,36)": ("union", "needs_cas"),
        r"x \in [0, 1]": ("membership", "needs_cas"),
        r"3 \pm 2": ("plus_minus", "needs_cas"),
        r"\begin{pmatrix} 1 \\ 2 \end{pmatrix}": ("matrix", "needs_cas"),
        r"(-\infty, 3]": ("interval", "needs_cas"),
        r"\{1, 2\}": ("set", "needs_cas"),
        r"\left( 1, 2 \right)": ("tuple", "needs_cas"),
        r"14": ("plain", "14"),
        r"11\sqrt2": ("plain", "needs_cas"),
    }
    assert column(spark, list(cases), G.answer_class) == [v[0] for v in cases.values()]
    assert column(spark, list(cases), G.class_canonical) == [v[1] for v in cases.values()]


def test_short_ways_equal_the_general_way(spark):
    cases = [
        ("12", "12", "1"), ("-7", "-7", "1"), ("007", "7", "1"), ("(12)/(5)", "12", "5"), ("(3)/(0)", None, None),
        ("(-3)/(2)", None, None), ("12/5", "12", "5"), ("1" * 18, "1" * 18, "1"), ("1" * 19, "1" * 19, "1"),
        (f"({'9' * 18})/({'9' * 19})", "9" * 18, "9" * 19), ("(2)(3)", "6", "1"), ("3**2", "9", "1"),
        ("-0", "0", "1"), ("+5", "5", "1"), ("1\n", "1", "1"), ("x", None, None), ("", None, None), (None, None, None),
    ]
    df = spark.createDataFrame(cases, "part string, num string, den string")
    got = df.withColumn("r", G.rational("part")).select(
        "part", "num", "den", F.col("r.num").cast("string").alias("n"), F.col("r.den").cast("string").alias("d")
    )
    for r in got.collect():
        assert (r.n, r.d) == (r.num, r.den), r


def test_candidate_and_normal_form_stay_out_of_the_generated_method(spark):
    """All rewrites in one generated method were too long for the JVM to compile."""
    df = spark.createDataFrame([("\\boxed{1}",)], "text string")
    out = df.select(G.normalize_answer(G.final_candidate("text")).alias("x"))
    code = out._jdf.queryExecution().debug().codegenToSeq()
    assert code.isEmpty() or "regexp" not in code.mkString().lower()
    white = "  　\\boxed{ 4 $} \n"
    rows = spark.createDataFrame([(white,), ("\\boxed{}",), ("\\boxed{} 7",), ("\\boxed",), (" 3 ",), (None,)], "text string")
    got = [r.c for r in rows.select(G.final_candidate("text").alias("c")).collect()]
    assert got == ["4", "\\boxed{}", "7", "\\boxed", "3", ""]
