"""Text, number and date expressions over columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.functions.common import col_of, is_blank, let, strip

# fixed values: currency codes and signs removed before a number is read
CURRENCY = r"(?i)(USD|EUR|GBP|JPY|CFA|NGN|INR|CAD|AUD|CHF|₦|₿|¥|€|£|\$)"
# fixed values: one token is a run of letters, digits and underscores, or one other sign
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# fixed values: domain keywords, first hit wins
DOMAIN_KEYWORDS: list[tuple[str, list[str]]] = [
    ("finance", ["finance", "revenue", "expenses", "budget"]),
    ("hr", ["hr", "employee", "staff", "training"]),
    ("sales", ["sales"]),
    ("project", ["project", "task"]),
    ("education", ["training", "course", "education"]),
    ("medical", ["medical", "patient", "blood pressure"]),
    ("logistics", ["logistics", "delivery"]),
    ("engineering", ["engineering", "resource"]),
    ("research", ["research", "publication"]),
]


def parse_numeric(value: Column | str) -> Column:
    """The number inside a noisy cell (``$50,994`` -> 50994.0), NULL when there is none.

    The column type is known when the plan is made: numeric columns skip the parsing, and
    plain numbers in text columns skip the rewrites.
    """
    cell = col_of(value)
    kind = F.typeof(cell)
    numeric = kind.isin("tinyint", "smallint", "int", "bigint", "float", "double") | kind.startswith(
        "decimal"
    )
    raw = cell.cast("string")
    digits = F.regexp_replace(F.regexp_replace(raw, CURRENCY, ""), r"[^\d.\-]", "")
    valid = digits.rlike(r"^-?(\d+(\.\d*)?|\.\d+)$")
    plain = raw.rlike(r"^-?\d+(\.\d+)?\z")
    return F.when(numeric | plain, raw.try_cast("double")).when(valid, digits.try_cast("double"))


def end_date(start: Column | str, nights: Column | str) -> Column:
    """Start plus whole days; a text start must be an ISO date or timestamp."""
    text = col_of(start).cast("string")
    stamp = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(text))
    return stamp + F.make_dt_interval(days=col_of(nights).cast("int"))


def profit(revenue: Column | str, expense: Column | str) -> Column:
    """Revenue minus expense, NULL unless both are numeric."""
    return col_of(revenue).try_cast("double") - col_of(expense).try_cast("double")


def domain_tag(text: Column | str, word_boundary: bool = False) -> Column:
    """First domain whose keywords occur in the text."""
    lowered = F.lower(col_of(text))
    tag = None
    for domain, words in DOMAIN_KEYWORDS:
        pattern = "|".join(words)
        hit = lowered.rlike(rf"\b({pattern})\b" if word_boundary else pattern)
        tag = F.when(hit, domain) if tag is None else tag.when(hit, domain)
    return tag


def canonical_name(text: Column | str) -> Column:
    return F.replace(F.lower(strip(col_of(text))), F.lit(" "), F.lit(""))


def longest_block(a: Column, b: Column) -> Column:
    """(start, n): the longest piece of ``a`` that occurs in ``b``, the first one of several.

    One walk over ``a``: as long as a piece longer than the best so far starts here, the best
    grows by a character; otherwise the start moves on.
    """
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0).alias("n"))

    def step(state: Column, _: Column) -> Column:
        longer = state["n"] + 1
        fits = state["at"] + longer <= F.length(a)
        found = fits & (F.position(F.substr(a, state["at"] + 1, longer), b) > 0)
        return F.when(
            found, F.struct(state["at"].alias("at"), state["at"].alias("start"), longer.alias("n"))
        ).otherwise(F.struct((state["at"] + 1).alias("at"), state["start"].alias("start"), state["n"].alias("n")))

    steps = F.sequence(F.lit(1), F.length(a) + F.least(F.length(a), F.length(b)))
    return F.aggregate(steps, none, step)


def matched_characters(a: Column, b: Column) -> Column:
    """Characters in matching blocks: the longest one, then those left and right of it, and so on.

    Every round cuts all open pairs of pieces at their longest block; a round matches one
    character at least on every path, so the shorter text bounds their number.
    """
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    start = F.struct(F.array(pair(a, b)).alias("open"), F.lit(0).alias("matched"))

    def cut(piece: Column) -> Column:
        return let(
            longest_block(piece["a"], piece["b"]),
            lambda m: let(
                F.position(F.substr(piece["a"], m["start"] + 1, m["n"]), piece["b"]) - 1,
                lambda at: F.struct(
                    m["n"].alias("n"),
                    F.array(
                        pair(F.substr(piece["a"], F.lit(1), m["start"]), F.substr(piece["b"], F.lit(1), at)),
                        pair(F.substr(piece["a"], m["start"] + m["n"] + 1), F.substr(piece["b"], at + m["n"] + 1)),
                    ).alias("rest"),
                ),
            ),
        )

    def both(piece: Column) -> Column:
        return (F.length(piece["a"]) > 0) & (F.length(piece["b"]) > 0)

    def round_of(state: Column, _: Column) -> Column:
        blocks = F.filter(F.transform(F.filter(state["open"], both), cut), lambda m: m["n"] > 0)
        following = let(
            blocks,
            lambda found: F.struct(
                F.flatten(F.transform(found, lambda m: m["rest"])).alias("open"),
                F.aggregate(found, state["matched"], lambda n, m: n + m["n"]).alias("matched"),
            ),
        )
        return F.when(F.size(state["open"]) == 0, state).otherwise(following)

    rounds = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.aggregate(rounds, start, round_of, lambda state: state["matched"])


def matching_ratio(a: Column | str, b: Column | str) -> Column:
    """Twice the characters in matching blocks over the characters of both texts, 0 to 1.

    Every character counts, however frequent; two empty texts are equal; NULL gives NULL. The
    order of the texts matters, as the first of several longest blocks is taken.
    """
    both = F.struct(col_of(a).alias("a"), col_of(b).alias("b"))
    ratio = lambda x: F.when(x["a"] == x["b"], F.lit(1.0)).otherwise(
        2.0 * matched_characters(x["a"], x["b"]) / (F.length(x["a"]) + F.length(x["b"]))
    )
    return let(both, lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), ratio(x)))


def similarity(a: Column | str, b: Column | str) -> Column:
    """The matching ratio after trimming, lower-casing and dropping spaces."""
    return matching_ratio(canonical_name(a), canonical_name(b))


def text_chunks(text: Column | str, size: int = 1000, overlap: int = 100) -> Column:
    """Overlapping pieces of a text, the last one short; empty text gives none.

    One linear pass: each match moves on by ``size - overlap`` and looks ahead ``size``.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    pattern = f"(?s)(?=(.{{1,{size}}})).{{1,{size - overlap}}}"
    return F.regexp_extract_all(col_of(text), F.lit(pattern), F.lit(1))


def text_slices(text: Column | str, size: int = 4000, limit: int | None = None) -> Column:
    """Pieces of ``size`` characters without overlap; ``limit`` keeps the first ones only."""
    pieces = text_chunks(text, size, 0)
    return pieces if limit is None else F.slice(pieces, 1, limit)


def token_count(text: Column | str) -> Column:
    """Number of tokens."""
    return F.regexp_count(col_of(text), F.lit(TOKEN)).cast("long")


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(col_of(text), F.lit(TOKEN), F.lit(0))


def token_ids(text: Column | str, vocabulary: int = 151_936) -> Column:
    """Integer ids of the tokens; a content hash stands in for a trained vocabulary."""
    return F.transform(
        tokens(text),
        lambda tok: (
            F.conv(F.substring(F.md5(tok.cast("binary")), 1, 7), 16, 10).cast("long") % vocabulary
        ).cast("int"),
    )


def row_text(columns: Sequence[str], separator: str = " | ") -> Column:
    """``name: value`` pairs of a row, blanks left out."""
    return F.concat_ws(
        separator,
        *[
            F.when(~is_blank(F.col(c)), F.concat(F.lit(f"{c}: "), F.col(c).cast("string")))
            for c in columns
        ],
    )


def row_values_text(columns: Sequence[str]) -> Column:
    """The values of a row joined by a space, in header order."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def slug(text: Column | str, default: str = "model") -> Column:
    """A safe file name stem."""
    safe = F.lower(F.btrim(F.regexp_replace(col_of(text), "[^A-Za-z0-9]+", "_"), F.lit("_")))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(default))


def last_items(items: Column | str, n: int) -> Column:
    """The last ``n`` array elements, at least one."""
    array = col_of(items)
    start = F.greatest(F.lit(1), F.size(array) - max(n, 1) + 1)
    return F.slice(array, start, max(n, 1))


def before_first(items: Column | str, stop) -> Column:
    """The elements in front of the first ``stop``."""
    array = col_of(items)
    at = F.array_position(array, stop)
    return F.when(at > 0, F.slice(array, F.lit(1), (at - 1).cast("int"))).otherwise(array)


def common_prefix_len(a: Column | str, b: Column | str) -> Column:
    """Number of equal leading elements."""
    left, right = col_of(a), col_of(b)
    differs = F.zip_with(left, right, lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differs, True)
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(left), F.size(right))).cast("long")


def first_new_item(base: Column | str, longer: Column | str) -> Column:
    """The element of ``longer`` right after the common prefix, NULL at the end."""
    return F.get(col_of(longer), common_prefix_len(base, longer).cast("int"))


def first_choice(text: Column | str, letters: str = "ABCD") -> Column:
    """The first option letter in a text, upper-cased; NULL when there is none."""
    found = F.regexp_extract(col_of(text), f"([{letters}{letters.lower()}])", 1)
    return F.upper(F.nullif(found, F.lit("")))


def gold_choice(answer: Column | str, letters: str = "ABCD") -> Column:
    """Option letter from an index or from a letter."""
    raw = strip(col_of(answer).cast("string"))
    index = F.when(raw.rlike(r"^\d+$"), raw.try_cast("int"))
    return F.when(index.isNotNull(), F.nullif(F.substring(F.lit(letters), index + 1, F.lit(1)), F.lit("")))\
        .otherwise(F.substring(F.upper(raw), 1, 1))


def judge_score(text: Column | str, default: int = 3) -> Column:
    """First digit 1-5 that is not followed by another digit."""
    digit = F.regexp_extract(col_of(text), r"([1-5])(?:\D|\z)", 1)
    return F.coalesce(F.nullif(digit, F.lit("")).try_cast("int"), F.lit(default))


def lookup(values: Mapping[str, str], key: Column, default: Column) -> Column:
    """A fixed dictionary as an expression."""
    flat = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), key), default)


def fallback_words(text: Column, n: int = 3) -> Column:
    """The last ``n`` words joined by a space."""
    return let(
        F.filter(F.split(text, r"\s+"), lambda w: w != ""),
        lambda words: F.array_join(last_items(words, n), " "),
    )
