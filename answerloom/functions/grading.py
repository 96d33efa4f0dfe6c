"""Answer extraction, normalisation and equality as column expressions.

A verdict has three values: ``correct``, ``wrong`` and ``needs_cas``. The last one marks
pairs that only symbolic algebra could decide; they are never counted as wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.common import col_of, let, strip

# fixed values: the marker of a final answer and the pattern of a number in running text
BOX = "\\boxed"
NUMBER = r"-?(?:\d+/\d+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"

# fixed values: superscript signs and the plain signs they stand for
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁽⁾"
SUPERSCRIPTS_PLAIN = "0123456789+-()"

# fixed values: rewrites that bring an answer to its canonical text, in order.
# (?d) makes only \n end a line.
ANSWER_REWRITES: list[tuple[str, str]] = [
    # one-letter choice label
    (r"(?d)^[A-Za-z]\s*[.:]\s*(.+)$", "$1"),
    # degrees
    (r"\^\s*\{\s*\\circ\s*\}", ""),
    (r"\^\s*\\circ", ""),
    (r"°", ""),
    # a text wrapper around the whole answer
    (r"(?d)^\\text\{(.+?)\}$", "$1"),
    # math wrappers
    (r"\\[()\[\]]", ""),
    # LaTeX spacing and operators
    (r"\\left\s*", ""),
    (r"\\right\s*", ""),
    (r"\\[,!;:]", ""),
    (r"\\cdot", "*"),
    (r"[·×]", "*"),
    (r"\\\^\\circ", ""),
    (r"\\[dt]frac", r"\\frac"),
    # a superscript run after its base
    (r"([0-9A-Za-z)\]}])(?=[⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻])", "$1**"),
]
ANSWER_REWRITES_AFTER_SUPERSCRIPTS: list[tuple[str, str]] = [
    (r"\\%|[$%]", ""),
    # roots and fractions
    (r"\\sqrt\s*\{([^}]*)\}", "sqrt($1)"),
    (r"\\sqrt\s+([^\\\s{}]+)", "sqrt($1)"),
    (r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", "($1)/($2)"),
    (r"\\frac\s+([^\s{}]+)\s+([^\s{}]+)", "($1)/($2)"),
    # powers, mixed numbers, thousands separators, braces
    (r"\^", "**"),
    (r"(?<=\d)\s+(\d+/\d+)", "+$1"),
    (r"(?d)(?<=\d),(?=\d\d\d(\D|$))", ""),
    (r"[{}]", ""),
]


def last_boxed(text: Column | str) -> Column:
    """Content of the last box with balanced braces, else NULL."""
    source = col_of(text)
    tail = F.regexp_replace(F.substring_index(source, BOX, -1), r"(?U)^\s+", "")

    def balanced(rest: Column) -> Column:
        # Braces and the runs between them; depth and the consumed length are folded.
        parts = F.regexp_extract_all(rest, F.lit(r"[{}]|[^{}]+"), F.lit(0))
        start = F.struct(
            F.lit(0).alias("depth"), F.lit(0).alias("used"), F.lit(False).alias("closed")
        )

        def step(acc: Column, part: Column) -> Column:
            depth = (
                acc["depth"] + F.when(part == "{", 1).when(part == "}", -1).otherwise(0)
            ).cast("int")
            return F.when(acc["closed"], acc).otherwise(
                F.struct(
                    depth.alias("depth"),
                    (acc["used"] + F.length(part)).cast("int").alias("used"),
                    (depth == 0).alias("closed"),
                )
            )

        end = F.aggregate(parts, start, step)
        return let(end, lambda e: F.when(e["closed"], F.substring(rest, F.lit(2), e["used"] - 2)))

    flat = r"^\{([^{}]*)\}"
    content = let(
        tail,
        lambda rest: F.when(rest.rlike(flat), F.regexp_extract(rest, flat, 1)).when(
            rest.startswith("{"), balanced(rest)
        ),
    )
    return F.when(source.contains(BOX), content)


def last_number(text: Column | str) -> Column:
    return F.try_element_at(F.regexp_extract_all(col_of(text), F.lit(NUMBER), F.lit(0)), F.lit(-1))


def final_candidate(text: Column | str, fallback: str | None = "number_then_full") -> Column:
    """Boxed content, else by ``fallback`` the last number or the whole text, else ''."""

    def chosen(source: Column) -> Column:
        boxed = let(last_boxed(source), lambda b: F.when(b != "", F.btrim(strip(b), F.lit("$ "))))
        cleaned = F.when(source.contains(BOX), boxed)
        if fallback == "number_then_full":
            return F.coalesce(cleaned, last_number(source), source)
        if fallback == "number_only":
            return F.coalesce(cleaned, last_number(source), F.lit(""))
        return F.coalesce(cleaned, F.lit(""))

    return let(F.coalesce(col_of(text), F.lit("")), chosen)


def normalize_answer(text: Column | str) -> Column:
    """Canonical text of an answer.

    Most answers need few of the rewrites: plain numbers and texts without any character
    that a rewrite looks for need none, texts without a backslash none of those for LaTeX.
    """

    def rewritten(raw: Column, rules_before, rules_after) -> Column:
        out = strip(F.regexp_replace(raw, r"<\|[^>]+?\|>", ""))
        for pattern, replacement in rules_before:
            out = F.regexp_replace(out, pattern, replacement)
        out = F.translate(out, SUPERSCRIPTS, SUPERSCRIPTS_PLAIN)
        for pattern, replacement in rules_after:
            out = F.regexp_replace(out, pattern, replacement)
        return F.lower(strip(out))

    def without_latex(rules):
        # A rule that needs a backslash cannot match; alternatives may do without one.
        return [r for r in rules if r"\\" not in r[0] or "|" in r[0]]

    every = ANSWER_REWRITES, ANSWER_REWRITES_AFTER_SUPERSCRIPTS

    def canonical(raw: Column) -> Column:
        plain = raw.rlike(r"^-?\d+(\.\d+)?\z")
        simple = ~raw.rlike(rf"[\\^{{}}$%°·×,.:<{SUPERSCRIPTS}]|\d\s+\d")
        return (
            F.when(plain, raw)
            .when(simple, F.lower(strip(raw)))
            .when(~raw.contains("\\"), rewritten(raw, *map(without_latex, every)))
            .otherwise(rewritten(raw, *every))
        )

    # Inside a lambda the rewrites are no part of the generated method, which with all of them
    # grows beyond the size that the JVM compiles.
    return let(F.coalesce(col_of(text), F.lit("")), canonical)


def answer_parts(text: Column | str) -> Column:
    """Elements of a bracketed comma list; any other text is one part, '' is none."""
    body = col_of(text)

    def split(inner: Column) -> Column:
        items = F.transform(F.split(inner, ",", -1), lambda p: strip(p))
        return let(
            items,
            lambda xs: F.when(F.forall(xs, lambda x: x != ""), xs).otherwise(F.array(body)),
        )

    listed = body.rlike(r"(?s)^[(\[].*,.*[)\]]\z")
    inner = F.substring(body, F.lit(2), F.length(body) - 2)
    return (
        F.when(body == "", F.array().cast("array<string>"))
        .when(listed, split(inner))
        .otherwise(F.array(body))
    )


_UNSIGNED = r"(?:\d+\.?\d*|\.\d+)"
_SUM = rf"^[+-]?{_UNSIGNED}([*/]{_UNSIGNED})*([+-]{_UNSIGNED}([*/]{_UNSIGNED})*)*$"
_BIG = "decimal(38,0)"


def _plain_arithmetic(part: Column) -> Column:
    """Products written out, blanks and the parentheses of a lone number or of all removed.

    Numbers side by side, with a blank or a parenthesis between them, are a product. A whole
    number to a small whole power is that many factors.
    """
    power = r"^\s*\(?(\d+)\)?\s*\*\*\s*\(?(\d{1,2})\)?\s*$"
    base, times = F.regexp_extract(part, power, 1), F.regexp_extract(part, power, 2).try_cast("int")
    factors = F.array_join(F.array_repeat(base, F.coalesce(times, F.lit(0))), "*")
    spelled = F.when(times == 0, F.lit("1")).otherwise(factors)
    bare = F.regexp_replace(part, r"(?<=[\d.)])\s*(?=\()|(?<=\))\s*(?=[\d.])|(?<=[\d.])\s+(?=[\d.])", "*")
    bare = F.when(part.rlike(power), spelled).otherwise(bare)
    bare = F.regexp_replace(bare, r"\s+", "")
    lone = rf"(?<![\w.)(])\(({_UNSIGNED})\)(?![\w.(])|(?<=\()\(({_UNSIGNED})\)(?![\w.(])"
    bare = F.regexp_replace(bare, lone, "$1$2")
    bare = F.regexp_replace(bare, r"^\(([^()]*)\)$", "$1")
    # Every rewrite needs a blank, a parenthesis or a star.
    return F.when(part.rlike(r"[\s()*]"), bare).otherwise(part)


def rational(part: Column | str) -> Column:
    """Exact ``(num, den)`` of a sum of products of decimal numbers.

    NULL when the text is anything else, divides by zero or needs more than 38 digits.
    """
    one = F.lit(1).cast(_BIG)

    def fraction(num, den) -> Column:
        return F.struct(num.cast(_BIG).alias("num"), den.cast(_BIG).alias("den"))

    def literal(text: Column) -> Column:
        digits = F.replace(text, F.lit("."), F.lit(""))
        places = F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(0)
        scale = F.rpad(F.lit("1"), places + 1, F.lit("0"))
        return fraction(digits.try_cast(_BIG), scale.try_cast(_BIG))

    def times(a: Column, b: Column) -> Column:
        return F.try_multiply(a, b).cast(_BIG)

    def multiply(acc: Column, factor: Column) -> Column:
        value = literal(F.regexp_replace(factor, "^[*/]", ""))
        flipped = F.when(
            factor.startswith("/"), fraction(value["den"], value["num"])
        ).otherwise(value)
        return let(
            flipped, lambda v: fraction(times(acc["num"], v["num"]), times(acc["den"], v["den"]))
        )

    def product(term: Column) -> Column:
        sign = F.when(term.startswith("-"), -one).otherwise(one)
        factors = F.regexp_extract_all(
            F.regexp_replace(term, "^[+-]", ""), F.lit(r"[*/]?[^*/]+"), F.lit(0)
        )
        return F.aggregate(factors, fraction(sign, one), multiply)

    def add(acc: Column, term: Column) -> Column:
        return let(
            product(term),
            lambda v: fraction(
                F.try_add(times(acc["num"], v["den"]), times(v["num"], acc["den"])),
                times(acc["den"], v["den"]),
            ),
        )

    def total(expr: Column) -> Column:
        terms = F.regexp_extract_all(expr, F.lit(r"[+-]?[^+-]+"), F.lit(0))
        return F.aggregate(terms, fraction(F.lit(0), one), add)

    def checked(value: Column) -> Column:
        sound = value["num"].isNotNull() & value["den"].isNotNull() & (value["den"] != 0)
        return F.when(sound, value)

    def value(text: Column) -> Column:
        arithmetic = let(
            _plain_arithmetic(text),
            lambda expr: F.when(expr.rlike(_SUM), let(total(expr), checked)),
        )
        # A whole number of few digits is its own numerator, and most fractions are two of them.
        ratio = r"^\((\d{1,18})\)/\((\d{1,18})\)\z"
        top, below = (F.regexp_extract(text, ratio, i).try_cast(_BIG) for i in (1, 2))
        return (
            F.when(text.rlike(r"^-?\d{1,18}\z"), fraction(text.try_cast(_BIG), one))
            .when(text.rlike(ratio), let(fraction(top, below), checked))
            .otherwise(arithmetic)
        )

    return let(col_of(part), value)


#: Whole numbers of which each has one spelling.
_WHOLE = r"^(0|-?[1-9]\d*)\z"


def _words_only(part: Column) -> Column:
    """No digit and no function name: such a text never equals a number."""
    return ~part.rlike(r"\d|sqrt|root|sin|cos|tan|log|ln|exp|abs|max|min")


def part_equality(truth: Column, pred: Column) -> Column:
    """TRUE / FALSE for one pair of parts, NULL when undecided."""

    def compare(a: Column, b: Column) -> Column:
        left = F.try_multiply(a["num"], b["den"])
        right = F.try_multiply(b["num"], a["den"])
        return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(left == right)

    exact = let(
        F.struct(rational(truth).alias("t"), rational(pred).alias("p")),
        lambda s: compare(s["t"], s["p"]),
    )
    return (
        F.when(truth == pred, F.lit(True))
        .when(truth.rlike(_WHOLE) & pred.rlike(_WHOLE), F.lit(False))
        .when(_words_only(truth) & rational(pred).isNotNull(), F.lit(False))
        .when(_words_only(pred) & rational(truth).isNotNull(), F.lit(False))
        .otherwise(exact)
    )


def verdict_of_parts(truth: Column, pred: Column) -> Column:
    """Three-valued verdict over two arrays of parts."""

    def judge(checks: Column) -> Column:
        return (
            F.when(F.exists(checks, lambda c: ~F.coalesce(c, F.lit(True))), "wrong")
            .when(F.exists(checks, lambda c: c.isNull()), "needs_cas")
            .otherwise("correct")
        )

    sizes_match = (F.size(truth) == F.size(pred)) & (F.size(truth) > 0)
    checks = F.zip_with(truth, pred, part_equality)
    return F.when(sizes_match, let(checks, judge)).otherwise("wrong")


def grade(df: DataFrame, pred: str, truth: str, out: str = "verdict") -> DataFrame:
    """Add the verdict of a prediction against the ground truth.

    Normalised texts are staged as columns, so every rewrite runs once a row. Missing sides
    are wrong. Equal normal forms and pairs of plain integers are decided without looking
    at parts or doing arithmetic.
    """
    staged = df.withColumns(
        {"__pn": normalize_answer(F.col(pred)), "__tn": normalize_answer(F.col(truth))}
    )
    p, t = F.col("__pn"), F.col("__tn")
    missing = F.col(pred).isNull() | F.col(truth).isNull() | (p == "") | (t == "")
    parts = F.struct(answer_parts(t).alias("t"), answer_parts(p).alias("p"))
    result = (
        F.when(missing, "wrong")
        .when(p == t, "correct")
        .when(p.rlike(_WHOLE) & t.rlike(_WHOLE), "wrong")
        .otherwise(let(parts, lambda s: verdict_of_parts(s["t"], s["p"])))
    )
    return staged.withColumn(out, result).drop("__pn", "__tn")


def heuristic_score(
    answer: Column | str,
    brevity_bonus: float = 500.0,
    boxed_bonus: float = 2.0,
    extract_bonus: float = 1.0,
    fulltext_bonus: float = 0.0,
) -> Column:
    """A bonus for how the answer is stated plus a reward that decays with length."""
    text = F.coalesce(col_of(answer), F.lit(""))
    stated = (
        F.when(final_candidate(text, None) != "", boxed_bonus)
        .when(final_candidate(text, "number_only") != "", extract_bonus)
        .when(final_candidate(text) != "", fulltext_bonus)
        .otherwise(0.0)
    )
    return stated + 1.5 * F.exp(-F.length(text) / F.lit(float(brevity_bonus)))


def rewards(df: DataFrame, text: str, truth: str, format_coeff: float = 0.1) -> DataFrame:
    """Verifiable, partial and format-bonus rewards.

    A pair that needs algebra gets NULL rewards and ``undecided = true`` rather than 0.
    """
    staged = df.withColumn("__box", final_candidate(F.col(text), None)).withColumn(
        "__cand",
        F.when(F.col("__box") != "", F.col("__box")).otherwise(final_candidate(F.col(text))),
    )
    staged = grade(staged, "__cand", truth, "__verdict")
    boxed = F.col("__box") != ""
    right = F.when(F.col("__verdict") == "correct", 1.0).when(F.col("__verdict") == "wrong", 0.0)
    return (
        staged.withColumns(
            {
                "reward": F.when(boxed, right).otherwise(0.0),
                "partial_reward": F.when(boxed, right).otherwise(right * 0.5),
                "format_bonus_reward": right + F.when(boxed, format_coeff).otherwise(0.0),
                "undecided": F.col("__verdict") == "needs_cas",
            }
        )
    ).drop("__box", "__cand", "__verdict")


# fixed values: answer classes and the pattern that marks them, first hit wins
ANSWER_CLASSES: list[tuple[str, str]] = [
    ("membership", r"\\in(?![a-z])"),
    ("plus_minus", r"\\pm"),
    ("text", r"^\\(text|mbox)\s*\{[^}]*\}$"),
    ("currency", r"^\\\$\s*[0-9,.\s\\!]+$"),
    ("matrix", r"(?s)\\begin\{[pbvBV]?matrix\}.*\\end\{[pbvBV]?matrix\}"),
    ("union", r"\\cup"),
    ("interval", r"(?s)\\infty|^\[.*,.*[)\]]$|^\(.*,.*\]$"),
    ("set", r"(?s)^\\\{.*\\\}$"),
    ("tuple", r"(?s)^[(\[{].*,.*[)\]}]$"),
    ("base_subscript", r"^[0-9A-Fa-f]+_\{?[0-9]+\}?$"),
]


def answer_class(text: Column | str) -> Column:
    """Format class of an answer."""
    raw = strip(col_of(text))
    bare = F.regexp_replace(raw, r"\\(left|right)\s*", "")
    tag = None
    for name, pattern in ANSWER_CLASSES:
        hit = (raw if name in ("text", "currency", "matrix") else bare).rlike(pattern)
        if name == "base_subscript":
            hit = hit & F.coalesce(_digits_fit(bare), F.lit(False))
        tag = F.when(hit, name) if tag is None else tag.when(hit, name)
    return tag.otherwise("plain")


def _plain_double(amount: Column) -> Column:
    """A decimal amount with one place at least and no exponent, as ``10000000.0``."""
    exact = amount.try_cast("decimal(38,10)").cast("string")
    short = F.regexp_replace(exact, r"0+$", "")
    return F.when(short.endswith("."), F.concat(short, F.lit("0"))).otherwise(short)


def _digits_fit(raw: Column) -> Column:
    """Whether a base subscript is 2 to 36 and every digit before it is below it."""
    base = F.regexp_extract(raw, r"_\{?([0-9]+)\}?$", 1).try_cast("int")
    digits = F.split(F.lower(F.regexp_extract(raw, "^([0-9A-Fa-f]+)_", 1)), "")
    value = lambda d: F.conv(d, 36, 10).cast("int")
    fits = F.forall(F.filter(digits, lambda d: d != ""), lambda d: value(d) < base)
    return base.between(2, 36) & fits


def class_canonical(text: Column | str) -> Column:
    """Canonical text for the classes that need no algebra; others are 'needs_cas'."""
    raw = strip(col_of(text))
    amount = F.regexp_replace(F.regexp_extract(raw, r"^\\\$(.*)$", 1), r"\\[,!]|\s|,", "")
    inner = strip(F.regexp_extract(raw, r"^\\(?:text|mbox)\s*\{([^}]*)\}$", 1))
    digits = F.regexp_replace(raw, r"[{}]", "")
    kind = answer_class(raw)
    return (
        F.when(kind == "text", inner)
        .when(kind == "currency", _plain_double(amount))
        .when(kind == "base_subscript", digits)
        .when((kind == "plain") & raw.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), raw)
        .otherwise("needs_cas")
    )
