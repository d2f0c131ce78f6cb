"""Personal data by regular expressions, checksums and context, with SQL functions only.

Each kind has a pattern that proposes spans, a check that confirms them, and
words whose nearness raises or lowers the score.  Positions come from marking
all matches of a pattern in one replacement and adding up the lengths of the
parts between the marks.  Spans of the base kinds stay whatever their score;
the others need ``LEAST``.  Patterns are possessive, and begin only where the
leftmost match can begin, so long runs of one class are read once.

Defined cases: a null or empty text has no spans; texts of any length are read
whole; equal spans of two kinds are both returned, in the order of the kinds;
repeated rows each give a row; an empty table gives an empty result; columns of
``docs`` are kept and helper columns begin with an underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import packed

#: Private-use characters that mark matches; in a text they are replaced by a third before.
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"
LEAST = 0.6
#: Code points on either side of a span that are searched for context words.
NEAR = 48
#: Parts of a text whose lengths are added up in one fold; what a fold holds grows with its square.
FOLD = 128


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a text without a match of this has no span
    base: bool
    score: float
    good: str  # context that raises the score
    bad: str  # context that lowers it


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_LOCAL = "[A-Za-z0-9._%+-]"
#: Kinds in their order of output.
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.9, "e-?mail|contact|write|reach", "example|test"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True, 0.7, r"\bip\b|address|host|server", "version|release"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", True, 0.8, "card|visa|credit|payment|pay", "order|isbn|serial"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", True, 0.8, "phone|call|tel|mobile|fax", "order|serial"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", False, 0.7, "iban|account|bank|transfer", "serial|model"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", False, 0.4, "ssn|social security|tax", "part|serial|model"),
)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(value, "[\\x20-]", "")
        return F.char_length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    if kind == "iban":
        plain = F.regexp_replace(value, "\\x20", "")
        turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))

        def step(acc: Column, c: Column) -> Column:
            letter = c >= "A"
            return F.pmod(acc * F.when(letter, 100).otherwise(10) + F.ascii(c) - F.when(letter, 55).otherwise(48), F.lit(97)).cast("long")

        return F.char_length(plain).between(15, 34) & (F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0).cast("long"), step) == 1)
    return F.lit(True)


def _score(kind: Kind, text: Column, start: Column, end: Column) -> Column:
    left = F.greatest(start - NEAR, F.lit(0))
    near = F.lower(F.concat(F.substring(text, left + 1, start - left), F.lit(" "), F.substring(text, end + 1, F.lit(NEAR))))
    return F.lit(kind.score) + F.when(near.rlike(kind.good), 0.3).otherwise(0.0) - F.when(near.rlike(kind.bad), 0.2).otherwise(0.0)


_SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,score:double>>"


def spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: array of (start, rank, stop, kind, score) in code points, stop exclusive, by start and kind."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), OPEN + CLOSE, OTHER + OTHER)
    df = packed(docs, _text=text)
    marked = {f"_m_{k.name}": F.when(F.col("_text").rlike(k.needs), F.split(F.regexp_replace("_text", k.pattern, f"{OPEN}$0{CLOSE}"), OPEN, -1)) for k in KINDS}
    df = df.withColumns(marked)

    def located(k: Kind) -> Column:
        parts = F.col(f"_m_{k.name}")
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,value:string>>").alias("found"))

        def step(acc: Column, part: Column) -> Column:
            value = F.substring_index(part, CLOSE, 1)
            stop = acc["at"] + F.char_length(value)
            one = F.struct(acc["at"].alias("start"), stop.alias("stop"), value.alias("value"))
            return F.struct((acc["at"] + F.char_length(part) - 1).alias("at"), F.array_append(acc["found"], one).alias("found"))

        # Folds of FOLD parts each, from 0 on, and one more over their lengths.
        folds = F.transform(F.sequence(F.lit(2), F.size(parts), F.lit(FOLD)), lambda k: F.aggregate(F.slice(parts, k, F.lit(FOLD)), zero, step))
        begins = F.aggregate(folds, F.array(F.char_length(F.element_at(parts, 1))), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x["at"]))

        def moved(fold: Column, begin: Column) -> Column:
            return F.transform(fold["found"], lambda x: F.struct((x["start"] + begin).alias("start"), (x["stop"] + begin).alias("stop"), x["value"].alias("value")))

        placed = F.transform(F.arrays_zip(folds.alias("fold"), F.slice(begins, 1, F.size(folds)).alias("begin")), lambda z: moved(z["fold"], z["begin"]))
        return F.when(F.size(parts) > 1, F.flatten(placed))

    df = df.withColumns({f"_f_{k.name}": located(k) for k in KINDS}).drop(*marked)

    def confirmed(rank: int, k: Kind) -> Column:
        good = F.filter(F.col(f"_f_{k.name}"), lambda x: _valid(k.name, x["value"]))
        scored = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop"), F.lit(k.name).alias("kind"), _score(k, F.col("_text"), x["start"], x["stop"]).alias("score")))
        return F.coalesce(scored if k.base else F.filter(scored, lambda x: x["score"] >= LEAST), F.array().cast(_SPAN))

    df = df.withColumns({f"_c_{k.name}": confirmed(i, k) for i, k in enumerate(KINDS)})
    df = df.withColumn("spans", F.array_sort(F.concat(*[F.col(f"_c_{k.name}") for k in KINDS])))
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != "spans"]
    return df.select(*kept, "spans")


def joined(spans_: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def base_only(spans_: Column) -> Column:
    return F.filter(spans_, lambda x: x["rank"] < sum(k.base for k in KINDS))


def count_of(spans_: Column, kind: str) -> Column:
    return F.size(F.filter(spans_, lambda x: x["kind"] == kind)).cast("long")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; of overlapping spans the first counts.

    A null text becomes empty, a text without spans stays as it is; other
    columns keep their names and values, ``spans`` too; an empty table stays empty.
    """
    rows = packed(docs, text=F.coalesce(F.col("text"), F.lit("")))
    whole = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["out"], F.substring(whole, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        free = x["start"] >= acc["at"]
        return F.struct(F.when(free, x["stop"]).otherwise(acc["at"]).alias("at"), F.when(free, more).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.char_length(whole))))
    return spans(rows).select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
