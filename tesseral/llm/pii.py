"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Column expressions only: `regexp_extract_all` gives the matches, `split` by the
same pattern the text between them, and sums of lengths, run after run, their code
points, so that nothing is shuffled and no Python runs.

Defined results: a null text is empty; matches are leftmost and do not overlap
within a kind, spans of different kinds may; a match that fails its check is
dropped without another try. Base kinds (email, ip, card, phone) are always
reported; others (iban, national id) where checksum and context give at least
`threshold`. Rows pass through one by one, so repeated rows, null ids and empty
tables need no care; only the named text column is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """pattern: proposes spans (possessive and anchored so that no text takes quadratic time).
    needs: a pattern that any text with a match has; cheap to reject by. context: words that raise the score."""

    name: str
    pattern: str
    needs: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn check."""
    backwards = F.reverse(_digits(m))

    def step(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(backwards, i, F.lit(1))) - 48
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), step) % 10 == 0


def mod97(m: Column) -> Column:
    """Whether the letters and digits of m pass the check of account numbers (ISO 7064)."""
    plain = F.regexp_replace(m, "[^0-9A-Z]", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
KINDS = (
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.8, "mail|contact|write to|kontakt|correo|courriel", True,
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, r"\bip\b|address|server|host|login", True,
    ),
    Kind(
        "card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", "[0-9]", luhn, 0.8, "card|visa|master|credit|karte|tarjeta|carte", True,
    ),
    Kind(
        "phone", r"\+[0-9][ ().0-9-]+[0-9]", "\\+", lambda m: F.length(_digits(m)).between(9, 15), 0.7, "phone|call|tel|mobile|fax|anruf|llama", True,
    ),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "[0-9]", mod97, 0.7, r"iban|account|konto|cuenta|compte|bank", False,
    ),
    Kind(
        "nid", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.4, r"\bssn\b|social security|national id|identity", False,
    ),
)


def _found(text: Column, kind: Kind) -> Column:
    return F.when(text.rlike(kind.needs), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)))


def _between(text: Column, kind: Kind, found: str) -> Column:
    return F.when(F.size(found) > 0, F.split(text, kind.pattern, -1))


def _confirmed(kind: Kind, x: Column, threshold: float) -> tuple[Column, Column]:
    """Whether the hit of x passes its checks, and its score."""
    near = F.lower(F.concat(F.right(x["piece"], F.lit(48)), F.lit(" "), F.left(F.coalesce(x["next"], F.lit("")), F.lit(24))))
    score = F.lit(kind.score) + F.when(near.rlike(kind.context), F.lit(0.2)).otherwise(F.lit(0.0))
    ok = x["hit"].isNotNull() & kind.valid(x["hit"])
    return F.coalesce(ok if kind.base else ok & (score >= threshold), F.lit(False)), score


#: Hits of one run: what is built hit by hit has at most so many parts, and runs are joined at the end, so that a text takes time in proportion to its hits.
_RUN = 128


def _rows(pieces: str, found: str) -> Column:
    """Runs of (piece, hit, next piece) of one kind; the last hit is null."""
    rows = F.arrays_zip(F.col(pieces).alias("piece"), F.col(found).alias("hit"), F.slice(F.col(pieces), F.lit(2), F.size(pieces)).alias("next"))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _RUN).cast("int")), lambda k: F.slice(rows, k * _RUN + 1, F.lit(_RUN)))


def _starts(runs: Column) -> Column:
    """The code point at which each run begins."""
    sizes = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda n, x: n + F.length(x["piece"]) + F.coalesce(F.length(x["hit"]), F.lit(0))))
    return F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def _spans(kind: Kind, runs: str, starts: str, threshold: float) -> Column:
    """(span, score) of every confirmed hit of one kind, in order."""
    none = F.array().cast("array<struct<span:string,score:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        ok, score = _confirmed(kind, x, threshold)
        one = F.struct(F.concat(F.lit(f"{kind.name}:"), start.cast("string"), F.lit(":"), end.cast("string")).alias("span"), F.format_number(score, 2).alias("score"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.when(ok, F.array(one)).otherwise(none)).alias("out"))

    def run(rows: Column, start: Column) -> Column:
        return F.aggregate(rows, F.struct(start.alias("pos"), none.alias("out")), step, lambda acc: acc["out"])

    return F.flatten(F.zip_with(runs, F.slice(F.col(starts), F.lit(1), F.size(runs)), run))


def _names(kind: Kind) -> tuple[str, str, str]:
    return f"__found_{kind.name}", f"__pieces_{kind.name}", f"__spans_{kind.name}"


def _in_runs(df: DataFrame, kinds: tuple[Kind, ...], rest: list[str]) -> DataFrame:
    """df(rest, found and pieces of each kind) with the runs of each kind in place of its pieces; null without a hit."""
    return df.select(*rest, *[F.when(F.size(_names(k)[0]) > 0, _rows(_names(k)[1], _names(k)[0])).alias(_names(k)[1]) for k in kinds])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.6) -> DataFrame:
    """Per row: id, n_<kind> of each kind, base_spans, spans, scores (in the order of spans)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
    df = df.select("*", *[_found(F.col("__text"), k).alias(_names(k)[0]) for k in kinds])
    df = df.select("*", *[_between(F.col("__text"), k, _names(k)[0]).alias(_names(k)[1]) for k in kinds])
    df = _in_runs(df, kinds, ["__id"])
    df = df.select("*", *[F.when(F.col(_names(k)[1]).isNotNull(), _starts(F.col(_names(k)[1]))).alias(_names(k)[0]) for k in kinds])
    df = df.select("__id", *[F.when(F.col(_names(k)[1]).isNotNull(), _spans(k, _names(k)[1], _names(k)[0], threshold)).alias(_names(k)[2]) for k in kinds])

    def joined(field: str, own: list[Kind]) -> Column:
        return F.concat_ws(",", *[F.transform(_names(k)[2], lambda x: x[field]) for k in own])

    return df.select(
        F.col("__id").alias(id_col),
        *[F.coalesce(F.when(F.col(_names(k)[2]).isNotNull(), F.size(_names(k)[2])), F.lit(0)).cast("long").alias(f"n_{k.name}") for k in kinds],
        joined("span", [k for k in kinds if k.base]).alias("base_spans"),
        joined("span", list(kinds)).alias("spans"),
        joined("score", list(kinds)).alias("scores"),
    )


def _replaced(kind: Kind, threshold: float) -> Callable[[Column, Column], Column]:
    def step(acc: Column, x: Column) -> Column:
        ok, _ = _confirmed(kind, x, threshold)
        return F.concat(acc, x["piece"], F.when(ok, F.lit(f"[{kind.name.upper()}]")).otherwise(F.coalesce(x["hit"], F.lit(""))))

    return step


def _cleaner(kind: Kind, threshold: float) -> Callable[[Column], Column]:
    """The text of a run with its confirmed hits replaced."""
    return lambda run: F.aggregate(run, F.lit(""), _replaced(kind, threshold))


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.6) -> DataFrame:
    """docs with each confirmed span of text_col replaced by [KIND], kind after kind; a null text stays null."""
    columns = docs.columns
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    for kind in kinds:
        found, pieces, _ = _names(kind)
        df = df.select("*", _found(F.col("__text"), kind).alias(found))
        df = df.select("*", _between(F.col("__text"), kind, found).alias(pieces))
        df = _in_runs(df, (kind,), ["__row", "__text"])
        cleaned = F.array_join(F.transform(pieces, _cleaner(kind, threshold)), "")
        df = df.select("__row", F.when(F.col(pieces).isNotNull(), cleaned).otherwise(F.col("__text")).alias("__text"))
    return df.select(*[F.col("__text").alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in columns])
