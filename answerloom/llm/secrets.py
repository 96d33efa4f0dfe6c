"""Secrets in text: fixed patterns, and zstandard novelty of strings in sensitive places.

A string beside a sensitive word (``key``, ``auth``, ``pwd`` …) is measured: how many bytes
does it add to the compressed text around it, when the compressor already knows that text
and a dictionary of identifiers? Names and values that repeat what is known cost little; key
material cannot be compressed, and is reported.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import bounded_batches, fresh

KINDS = ("assign", "access", "hex", "novel")
MIN_ASSIGNED = 12
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
# A run is taken whole, so asking for its least length in the pattern drops the same runs.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: What the novelty test looks at.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=\-@])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=\-@])")
MIN_CHARS = 16
_JOINED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
#: Name and value, or the parts of a value, around inner equal signs; padding stays with its value.
_PIECE = re.compile(r"[^=]+(?:=+$)?")
#: What may stand between lines of one value: line ends, also written as escapes, and quotes.
_BREAK = re.compile(r"""["'+,;]*[ \t]*(?:\r?\n|\\)[\s"'+,;\\]*""")
_MORE_LINES = re.compile(rf"\A(?:{_BREAK.pattern}[A-Za-z0-9+/=]{{{MIN_CHARS},}})+(?:{_BREAK.pattern}[A-Za-z0-9+/=]*\Z)?")
_HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*(?:KEY|CERTIFICATE)[A-Z0-9 ]*)-----((?:(?!-----).)*)-----END", re.DOTALL
)
#: Blocks with these words in their heading are meant to be shown.
_SHOWN = re.compile(r"PUBLIC|CERTIFICATE")
_PEM_LINE = re.compile(r"^[ \t]*([A-Za-z0-9+/=]+)[ \t\r]*$", re.MULTILINE)
SENSITIVE = re.compile(
    r"api|auth|bearer|cert|cipher|credential|hmac|key|pass|private|pwd|salt|secret|sign|token", re.I
)
BESIDE_CHARS = 40
AROUND_CHARS = 256
MIN_SHARE = 0.7
#: A string with more digits than this share is not made of words.
WORD_DIGITS = 0.125
_BETWEEN = re.compile(r"[/_-]")
_NUMERIC = re.compile(r"[0-9TZ/_=+-]+")
LEVEL = 19

#: Words that code and settings are made of, as the compressor's dictionary.
IDENTIFIERS = """
abstract access account address admin algorithm allow amount append application argument array
assert async attribute auth authorization await backend base64 bearer begin boolean branch bucket
buffer build byte cache callback certificate char check class client close cluster code collection
column command commit common compare config configuration connect connection const constructor
container content context continue cookie copy count create credential current data database date
debug decode default define delete deploy description dev development device dictionary directory
disable display document domain double download driver dump element email enable encode encrypt
endpoint engine enum environment error event example except exception execute expect export
extends external factory false field file filter final finally find first flag float folder
format forward frame from function generate get global grant graph group handle handler hash
header height hello host html http https identifier image implements import include index info
init inner input insert instance integer interface internal invalid item iterator java javascript
join json key keyword label lambda last layout length level library license limit line link list
listen load local localhost location lock logger login long loop manager map master match max
memory merge message metadata method min mock mode model module mount name namespace network
next node none null number object offset open operation option order origin output override
package page parameter parent parse partition passphrase password path pattern payload permission
pipeline place platform plugin point policy pool port position post prefix print private process
production profile program project promise property protected protocol provider proxy public
publish push query queue raise random range read record redirect reference region register
release remote remove render repeat replace report repository request require reset resource
response result retry return revoke role root route row runtime sample save schema scope script
search secret section security select self send sequence server service session set setting
setup sha256 shared shell signature signing size snapshot socket sort source space spark split
staging start state statement static status stop storage store stream string struct style
submit subscribe success suffix super switch sync system table target task template temporary
test text thread throw timeout timestamp title token tool trace transaction transform true type
undefined union unique unit update upload uri url user username utf8 uuid valid validate value
variable vector verify version view void volume wait warning while width window worker workspace
wrapper write xml yaml yield zone
bin dist etc home lib opt packages python src tmp usr var
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx
"""

#: Letters as often as in prose: beside them a word costs what its letters cost, however little
#: text is around it. Put before candidates with few digits or none.
PROSE = (
    "dun seravit hole ni trasego umbelt ari conse deilat worthen pli gesto unreld ockham bevrin "
    "tia luesco nadfer ympa hindrel esco vati jorlen quasi delm ostinare frebuk helga tissor enwa "
    "pomard elik shutin rever zandil oma creth ueltas ingor deasi brenfo lacht iminer sutelo rand "
    "vorin xelma taden. Gresh ilun otepa Sirend malo wech tursin eadel oni Brasken thoul ferim. "
)
#: The same for dates and other numbers.
NUMBERS = (
    "2019-03-27T14:05:38Z 1998/11/02 07-41-56-120 2006_08_15 30294817 5560132 1875-90-64 "
    "2031-12-09T22-53-17-483 4071268395 61-50-27 8349 2750 9163 08/04/72 "
)


@functools.cache
def _compressor() -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_RAWCONTENT
    words = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=kind)
    words.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False)


def novelty(before: str, candidate: str, after: str) -> float:
    """Bytes that ``candidate`` adds to its compressed surroundings, per byte of its own."""
    size = _compressor().compress
    known = len(size((before + after).encode()))
    return (len(size((before + after + candidate).encode())) - known) / max(1, len(candidate))


def _meets(spans: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Whether a range meets any of the sorted ``spans``, which may overlap each other."""
    starts = [s for s, _, _ in spans]
    ends = list(accumulate((e for _, _, e in spans), max))

    def meets(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before > 0 and ends[before - 1] > start

    return meets


def _is_novel(text: str, start: int, end: int, min_share: float, carried: bool) -> bool:
    """Measured beside its surroundings, which must not be other parts or lines of its value."""
    before, after = text[max(0, start - AROUND_CHARS) : start], text[end : end + AROUND_CHARS]
    if carried:
        before = ""
    elif before.endswith("."):
        before = before.rstrip(_JOINED)
    if after.startswith("."):
        after = after.lstrip(_JOINED)
    after = _MORE_LINES.sub("", after)
    return _share(before, text[start:end], after) >= min_share


def _share(before: str, word: str, after: str) -> float:
    """``novelty`` behind the prose or numbers that ``word`` would be made of if it were no secret."""
    if _NUMERIC.fullmatch(word):
        before = NUMBERS + before
    elif sum(c.isdigit() for c in word) <= WORD_DIGITS * len(word):
        before = PROSE + before
        humps = _HUMP.findall(word)
        if sum(map(len, humps)) >= 4 * len(humps):
            # Capitals that only begin or make up words, and signs between words, are no news.
            word = _BETWEEN.sub(" ", word.lower())
    return novelty(before, word, after)


def _key_blocks(text: str, min_share: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Novel lines of private key blocks, and the range of every key or certificate block.

    A line is measured without its neighbours, which are parts of the same value. One of fewer
    than ``MIN_CHARS`` characters, as the last one may be, is measured with the line above it.
    """
    lines, ranges = [], []
    for block in _PEM.finditer(text):
        ranges.append((block.start(2), 3, block.end(2)))
        if _SHOWN.search(block.group(1)):
            continue
        above = ""
        for m in _PEM_LINE.finditer(block.group(2)):
            line = m.group(1)
            whole = line if len(line) >= MIN_CHARS else above + line
            above = whole if len(whole) >= MIN_CHARS and _share("", whole, "") >= min_share else ""
            if above:
                lines.append((block.start(2) + m.start(1), 3, block.start(2) + m.end(1)))
    return lines, ranges


def find_spans(text: str | None, min_share: float = MIN_SHARE) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every secret, in order; code points, end exclusive."""
    text = text or ""
    spans = [
        (m.start(), 0, m.end()) for m in _ASSIGN.finditer(text)
        if len(m.group(2)) >= MIN_ASSIGNED
    ]
    for kind, pattern in ((1, _ACCESS), (2, _HEX)):
        spans += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    spans.sort()
    meets = _meets(spans)
    found, blocks = _key_blocks(text, min_share)
    found = [f for f in found if not meets(f[0], f[2])]
    decided = _meets(blocks)
    last = (-1, False, False)  # end of the candidate before, whether it was sensitive, reported
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if decided(start, end):
            continue
        dotted = start > 0 and text[start - 1] == "."
        if dotted and last[0] == start - 1:
            carried = last[1]
        elif dotted:
            low = max(0, start - AROUND_CHARS)
            begin = low + len(text[low:start].rstrip(_JOINED))
            if begin > 0 and text[begin - 1] == "@":
                continue
            carried = bool(SENSITIVE.search(text[max(0, begin - BESIDE_CHARS) : start]))
        else:
            carried = last[2] and _BREAK.fullmatch(text, last[0], start) is not None
        pieces = [(start + p.start(), start + p.end()) for p in _PIECE.finditer(m.group())]
        sensitive, new = carried, []
        # Values behind their names first; a candidate without one is measured whole.
        for part in [*pieces, (start, end)] if len(pieces) > 1 else [(start, end)]:
            if part[1] - part[0] < MIN_CHARS or new and part == (start, end):
                continue
            # A name before the value counts whole, however long it is.
            beside = text[max(0, min(start, part[0] - BESIDE_CHARS)) : part[0]] if part[0] > start else (
                text[max(0, start - BESIDE_CHARS) : start]
            )
            if not carried and not SENSITIVE.search(beside):
                continue
            sensitive = True
            if _is_novel(text, *part, min_share, carried) and not meets(*part):
                new.append((part[0], 3, part[1]))
        found += new
        last = (end, sensitive, bool(new))
    return sorted(spans + found)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FOUND = "array<struct<kind:string,start:int,end:int,found:string>>"
_REPORT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def _report(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            spans = find_spans(text)
            base = [s for s in spans if s[1] < 3]
            counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            rows.append((*counts, digest, _joined(spans), len(spans) - len(base)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _REPORT.split(", ")])


def _found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(
            [
                [
                    {"kind": KINDS[k], "start": s, "end": e, "found": t[s:e]}
                    for s, k, e in find_spans(t)
                ]
                for t in texts
            ],
            index=texts.index,
        )


def _redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        out = []
        for text in texts:
            done = 0
            parts = []
            for start, kind, end in find_spans(text):
                if start >= done:
                    parts += [text[done:start], f"[{KINDS[kind]}]"]
                done = max(done, end)
            out.append("".join([*parts, text[done:]]) if parts else text)
        yield pd.Series(out, index=texts.index, dtype=object)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by fixed pattern, a digest of them, and all spans.

    ``spans`` lists ``kind:start:end`` by start, then kind. A null text counts as empty and
    has no spans. Texts are never cut; no row meets another one, so nothing is shuffled.
    Repeated rows are reported each; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(_report, _REPORT)(text_col).alias("r"))
    return rows.select("doc_id", "r.*")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per secret: doc_id, kind, start, end, found (the string itself).

    Null and empty texts and empty tables give no rows, repeated rows their secrets each time;
    texts of any length are read whole.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.pandas_udf(_found, _FOUND)(text_col)).alias("s"))
    return rows.select("doc_id", "s.*")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by its kind in brackets; all rows stay.

    Overlapping spans become one replacement. ``length_col`` is set to the new length where
    the table has such a column and the text has one. Null texts stay null, repeated rows and
    empty tables stay as they are.
    """
    bounded_batches(docs.sparkSession)
    new = fresh(docs, "redacted")
    out = docs.withColumn(new, F.pandas_udf(_redacted, "string")(text_col))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(new).alias(c))
        elif c == length_col:
            length = F.coalesce(F.length(new).cast(docs.schema[c].dataType), F.col(c))
            columns.append(length.alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)
