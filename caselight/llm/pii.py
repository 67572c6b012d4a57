"""Operator 10: personal data in texts, found, confirmed, scored and masked.

Method: regular expressions propose spans, checksums and ranges confirm them (Luhn for cards,
mod 97 for account numbers, parts of an address), and words nearby raise the score. Only Spark SQL
functions are used, so no text leaves the JVM.

How positions are found with SQL functions: every match is put between two marks, the text is
split at the marks, so that each second piece is a match, and the lengths of the pieces add up to
positions. The mark is a control character that no pattern can match; where a text holds it,
another such character stands in for it first, so positions stay right. Patterns are written so
that a failed attempt is not repeated from each later character of the same run: their cost is
linear in the text.

Kinds of the base are always reported if their check holds: email, ip, card, phone. Further kinds
are reported if their score, raised by words nearby, reaches ``least_score``: iban, ssn, secret.

Defined cases: null or empty text has no spans; rows with null or repeated ``doc_id`` stay rows;
spans of different kinds may overlap, masking joins overlapping ones; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK, _STAND_IN = "\u0001", "\u0002"
#: Characters before and after a span in which words are looked for.
NEARBY = 48
LEAST_SCORE = 0.5
_FOUND = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Text without this cannot match; saves the search.
    needs: str
    score: float
    #: Words nearby that raise the score by ``raised``.
    words: str
    raised: float = 0.4


BASE = (
    # A local part is taken whole from where the last match ended or a run begins.
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", 0.9, "e-?mail|mail|contact|write|courriel|correo", 0.1,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        ".", 0.6, "ip|address|host|server|login|adresse", 0.3,
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, "card|visa|mastercard|credit|payment|karte|carte|tarjeta", 0.3),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|tel|call|mobile|fax|telefon|t[eé]l[eé]fono?", 0.3),
)
MORE = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "", 0.8, "iban|account|bank|konto|compte|cuenta", 0.2,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        "-", 0.4, "ssn|social security|tax id",
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{32,64})(?![A-Za-z0-9_-])",
        "", 0.3, "token|secret|password|passwd|api[ _-]?key|access[ _-]?key|key",
    ),
)
#: Beginnings that say by themselves that a string is a secret (fixed values of their issuers).
_SURE_SECRET = "^(AKIA|gh[pousr]_)"


def _pieces(text: Column, kind: Kind) -> Column:
    marked = F.regexp_replace(text, F.lit(f"({kind.pattern})"), F.lit(f"{_MARK}$1{_MARK}"))
    cut = F.split(marked, _MARK)
    return F.when(F.contains(text, F.lit(kind.needs)), cut).otherwise(F.array(text)) if kind.needs else cut


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod_97(match: Column) -> Column:
    """Of an account number, its first four signs moved to the end, letters as 10 to 35."""
    plain = F.replace(match, F.lit(" "))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.regexp_extract_all(moved, F.lit("."), F.lit(0)), F.lit(0), step)


def _confirmed(kind: Kind, match: Column) -> Column:
    if kind.name == "ip":
        return F.forall(
            F.split(match, r"\."), lambda p: F.rlike(p, F.lit("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
        )
    if kind.name == "card":
        digits = _digits(match)
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind.name == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind.name == "iban":
        return _mod_97(match) == 1
    return F.lit(True)


def _score(kind: Kind, match: Column, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(F.right(before, F.lit(NEARBY)), F.lit(" "), F.left(after, F.lit(NEARBY))))
    named = F.rlike(near, F.lit(rf"(?<![a-z])({kind.words})(?![a-z])"))
    score = F.lit(kind.score)
    if kind.name == "secret":
        score = F.when(F.rlike(match, F.lit(_SURE_SECRET)), F.lit(0.9)).otherwise(score)
    return F.least(F.lit(1.0), score + F.when(named, F.lit(kind.raised)).otherwise(F.lit(0.0)))


def _found(pieces: Column, kind: Kind, rank: int, least: float) -> Column:
    """The confirmed spans among the pieces of a text; each second piece is a match."""
    at = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))

    def step(state: Column, i: Column) -> Column:
        before, match, after = at(i - 1), at(i), at(i + 1)
        start = state["at"] + F.length(before)
        end = start + F.length(match)
        score = _score(kind, match, before, after)
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"),
            F.lit(kind.name).alias("kind"), score.alias("score"),
        )
        good = _confirmed(kind, match)
        if least:
            good = good & (score >= least)
        spans = F.when(good, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    none = F.array().cast(_FOUND)
    places = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(F.size(pieces) > 2, F.aggregate(places, begin, step)["spans"]).otherwise(none)


def find_spans(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The given columns and ``pii_spans``: (start, rank, end, kind, score), by start and kind.

    Positions are code points, the end is exclusive. ``pii_base`` holds the base kinds alone. Given
    columns of these two names are replaced.
    """
    kinds = [*BASE, *MORE]
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARK, _STAND_IN)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("pii_base", "pii_spans")]
    cut = docs.select(*kept, text.alias("__text")).select(
        *kept, *[_pieces(F.col("__text"), k).alias(f"__{k.name}") for k in kinds]
    )
    # Each array of pieces is used more than once here, so Spark keeps it as a column.
    spans = cut.select(
        *kept,
        *[
            _found(F.col(f"__{k.name}"), k, i, least_score if k in MORE else 0).alias(f"__{k.name}")
            for i, k in enumerate(kinds)
        ],
    )
    in_order = lambda some: F.array_sort(F.concat(*[F.col(f"__{k.name}") for k in some]))
    return spans.select(*kept, in_order(BASE).alias("pii_base"), in_order(kinds).alias("pii_spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def report(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """One row per document: how many of each base kind, all spans, and the highest score."""
    count = lambda name: F.size(F.filter("pii_base", lambda s: s["kind"] == name)).cast("long")
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least_score)
    return found.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in BASE],
        F.sha2(as_text(F.col("pii_base")), 256).alias("base_sha256"),
        as_text(F.col("pii_spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii_spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def mask(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The same columns with each span of ``text`` replaced by its kind in brackets.

    Overlapping spans become one, named after the first. A null text stays null.
    """
    text = F.col("text")

    def step(state: Column, span: Column) -> Column:
        gap = F.substr(text, state["at"] + 1, span["start"] - state["at"])
        label = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        out = F.when(span["start"] >= state["at"], F.concat(state["out"], gap, label)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(
        "pii_spans", begin, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1))
    )
    masked = F.when(text.isNull() | (F.size("pii_spans") == 0), text).otherwise(whole)
    # The other columns go by names of their own meanwhile.
    names = {c: c if c == "text" else f"x{i}" for i, c in enumerate(docs.columns)}
    found = find_spans(docs.toDF(*names.values()), least_score)
    return found.select(*[(masked if c == "text" else F.col(x)).alias(c) for c, x in names.items()])
