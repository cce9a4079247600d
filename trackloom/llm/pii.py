"""Personal data: regular expressions propose spans, checksums confirm, context adjusts a score.

DataFrame functions only. Positions come from splitting the text at the matches and adding up code-point lengths of gaps
and matches: blocks of ``BLOCK`` steps first, then blocks of their sums, so that the work grows with the number of
matches and not with its square. Context of long texts is read from pieces of ``PIECE`` code points, as a
substring is found by counting from the text's start. Patterns are written with possessive runs and a
look-behind, which match the same spans as the plain greedy patterns but cannot rescan a long run from each of
its characters.

Kinds: email, ip, card (Luhn), phone, and added by the method iban (mod 97), ssn (only where a
context word stands near). Spans of the first four kinds are reported whatever their score.

Score: a base per kind, raised where a checksum confirms, raised by a context word within
``window`` code points before or after, at most 1.

Defined results: null and empty texts hold no span; very long texts and very many matches take time in proportion;
repeated rows are scanned as rows of their own; columns other than id and text are not read, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Join = Callable[[Column, Column], Column]
_RUN = r"(?:\G|(?<![{0}]))[{0}]++"
_LOCAL = r"A-Za-z0-9._%+-"
#: kind -> (cheap test, pattern). Order is the order of report.
PATTERNS = {
    "email": ("@", _RUN.format(_LOCAL) + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": ("", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
BASE_KINDS = ("email", "ip", "card", "phone")
#: Base score, with checksum, added by context; context words.
SCORES = {"email": (0.7, 0.0, 0.2), "ip": (0.5, 0.2, 0.3), "card": (0.3, 0.5, 0.2), "phone": (0.5, 0.0, 0.3), "iban": (0.3, 0.6, 0.1), "ssn": (0.2, 0.0, 0.6)}
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact)\b",
    "ip": r"(?i)\b(ip|host|server|address)\b",
    "card": r"(?i)\b(card|credit|visa|mastercard|amex|payment)\b",
    "phone": r"(?i)\b(phone|tel|telephone|call|mobile|fax)\b",
    "iban": r"(?i)\b(iban|account|bank|konto)\b",
    "ssn": r"(?i)\b(ssn|social security)\b",
}
#: Steps of one block of a running sum, code points of one piece of a long text, and from what length a text is long.
BLOCK, PIECE, LONG_TEXT = 64, 1024, 4096
SPAN = "struct<kind:string,start:int,end:int,text:string,score:double>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's checksum over a string of digits."""
    turned = F.reverse(number)
    twice = lambda d: (d * 2) % 10 + F.when(d >= 5, 1).otherwise(0)
    places = F.transform(F.split(turned, ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(twice(c.try_cast("int"))))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """IBAN check: country and check digits go last, letters count 10 to 35, remainder 1."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(value(c) < 10, a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: step(a, c).cast("int")) == 1


def confirmed(kind: str, text: Column) -> Column:
    number = digits(text)
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).try_cast("int") <= 255))
    if kind == "card":
        return F.length(number).between(13, 19) & F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(text, F.lit(" "), F.lit("")))
    return F.lit(True)


def _blocks(column: str) -> Column:
    """An array column in blocks; it must be a column, as the lambda would compute an expression anew for each block."""
    n = F.size(column)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(column, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<int>>"))


def _add(a: Column, x: Column) -> Column:
    return a + x


def _total(block: Column, join: Join = _add) -> Column:
    return F.aggregate(block, F.lit(0), lambda a, x: join(a, x))


def _before(block: Column, join: Join = _add) -> Column:
    """What the entries before each entry come to. The state holds one block: an aggregate copies its state at each step."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))
    step = lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["sums"], F.array(a["at"])).alias("sums"))
    return F.aggregate(block, start, step, lambda a: a["sums"])


def _running(entries: str, totals: str, join: Join = _add) -> Column:
    """What stands before each entry of the array column ``entries``, from it and the column of its blocks' totals."""
    shifted = lambda blocks, offsets: F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(_before(b, join), lambda x: join(x, o))))
    second = _blocks(totals)
    return shifted(_blocks(entries), shifted(second, _before(F.transform(second, lambda b: _total(b, join)), join)))


def _cut(start: Column, length: Column) -> Column:
    """A substring of ``text`` from code point ``start``; of a long text by way of its ``pieces``."""
    first = F.floor(start / PIECE).cast("int")
    several = F.slice("pieces", first + 1, F.floor((start + length) / PIECE).cast("int") - first + 1)
    return F.when(F.col("pieces").isNull(), F.substr(F.col("text"), start + 1, length)).otherwise(F.substr(F.array_join(several, ""), start - first * PIECE + 1, length))


def _spans(kind: str, window: int) -> Column:
    """Array of confirmed spans of one kind, from the columns ``{kind}_starts`` and ``{kind}_matches``."""
    base, checked, near = SCORES[kind]
    kept = F.filter(F.arrays_zip(F.col(f"{kind}_starts").alias("s"), F.col(f"{kind}_matches").alias("m")), lambda x: confirmed(kind, x["m"]))

    def scored(x: Column) -> Column:
        from_, end = F.greatest(x["s"] - window, F.lit(0)), x["s"] + F.length(x["m"])
        around = F.concat(_cut(from_, x["s"] - from_), F.lit(" "), _cut(end, F.lit(window)))
        score = F.least(F.lit(1.0), F.lit(base + checked) + F.when(around.rlike(CONTEXT[kind]), near).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), end.alias("end"), x["m"].alias("text"), F.round(score, 6).alias("score"))

    out = F.transform(kept, scored)
    return out if kind in BASE_KINDS else F.filter(out, lambda s: s["score"] >= 0.5)


def _scan(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(doc_id, text, pieces, one array of spans per kind). Each step reads columns of the one before more than once."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def worth(kind: str) -> Column:
        mark = PATTERNS[kind][0]
        cheap = F.contains(text, F.lit(mark)) if mark else F.lit(True)
        return cheap if kind == "email" else cheap & text.rlike("[0-9]")

    found = {k: F.when(worth(k), F.regexp_extract_all(text, F.lit(PATTERNS[k][1]), F.lit(0))).otherwise(F.array().cast("array<string>")) for k in PATTERNS}
    rows = rows.select("doc_id", "text", *[found[k].alias(f"{k}_matches") for k in PATTERNS])
    some = {k: F.size(f"{k}_matches") > 0 for k in PATTERNS}
    no = F.array().cast("array<int>")
    gaps = {k: F.when(some[k], F.transform(F.split(text, PATTERNS[k][1], -1), F.length)).otherwise(no) for k in PATTERNS}
    long = F.when(F.length(text) > LONG_TEXT, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    kept = ["doc_id", "text", *[f"{k}_matches" for k in PATTERNS]]
    rows = rows.select(*kept, long.alias("pieces"), *[gaps[k].alias(f"{k}_gaps") for k in PATTERNS])
    kept += ["pieces"]
    # a gap and the match after it make one step
    steps = {k: F.zip_with(F.slice(f"{k}_gaps", F.lit(1), F.size(f"{k}_matches")), f"{k}_matches", lambda g, m: g + F.length(m)) for k in PATTERNS}
    rows = rows.select(*kept, *[f"{k}_gaps" for k in PATTERNS], *[steps[k].alias(f"{k}_steps") for k in PATTERNS])
    more = [f"{k}_{x}" for k in PATTERNS for x in ("gaps", "steps")]
    rows = rows.select(*kept, *more, *[F.transform(_blocks(f"{k}_steps"), lambda b: _total(b)).alias(f"{k}_sums") for k in PATTERNS])

    def starts(k: str) -> Column:
        before = _running(f"{k}_steps", f"{k}_sums")
        return F.when(some[k], F.zip_with(before, F.slice(f"{k}_gaps", F.lit(1), F.size(f"{k}_matches")), lambda s, g: s + g)).otherwise(no)

    rows = rows.select(*kept, *[starts(k).alias(f"{k}_starts") for k in PATTERNS])
    none = F.array().cast(f"array<{SPAN}>")
    return rows.select("doc_id", "text", "pieces", *[F.when(some[k], _spans(k, window)).otherwise(none).alias(k) for k in PATTERNS])


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 40) -> DataFrame:
    """doc_id and one array of spans per kind (kind, start, end, text, score; code points, end exclusive)."""
    return _scan(docs, id_col, text_col, window).drop("text", "pieces")


def span_list(kinds) -> Column:
    """``kind:start:end`` of all spans, comma-joined in the given order of kinds."""
    parts = [F.transform(F.col(k), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def mask_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 40) -> DataFrame:
    """doc_id and text with each span replaced by ``[KIND]``; overlapping spans are one, of the kind that starts first."""
    found = _scan(docs, id_col, text_col, window)
    spans = F.concat(*[F.col(k) for k in PATTERNS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = found.select("doc_id", "text", "pieces", ordered.alias("ordered"))
    found = found.select("*", F.transform("ordered", lambda s: s["end"]).alias("ends"))
    found = found.select("*", F.transform(_blocks("ends"), lambda b: _total(b, F.greatest)).alias("tops"))
    # a span that starts where all before it have ended begins a new gap
    zipped = F.arrays_zip(F.col("ordered").alias("span"), _running("ends", "tops", F.greatest).alias("before"))
    found = found.select("*", F.filter(zipped, lambda x: x["span"]["start"] >= x["before"]).alias("firsts"))
    parts = F.transform("firsts", lambda x: F.concat(_cut(x["before"], x["span"]["start"] - x["before"]), F.lit("["), F.upper(x["span"]["kind"]), F.lit("]")))
    found = found.select("*", F.coalesce(F.array_max("ends"), F.lit(0)).alias("last"))
    return found.select("doc_id", F.concat(F.array_join(parts, ""), _cut(F.col("last"), F.length("text") - F.col("last"))).alias("text"))
