"""ISBN detection and checksums as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blanks and hyphen that may stand inside an identifier.
BLANKS = r"\t\n\f\r "
SEPARATORS = "-\t\n\f\r "

# Well-formed numbers that never identify a book.
BAD_ISBNS = ["0123456789"] + [str(d) * 10 for d in range(10)]

# The look-behind pins a run to its first character, so a long stretch of
# blanks is tried once and not once per position.
_RUN_START = rf"(?<![0-9\-{BLANKS}])"
RUN_PATTERNS = {
    "isbn10": rf"{_RUN_START}[0-9\-{BLANKS}]+[0-9Xx]",
    "isbn13": rf"{_RUN_START}[0-9\-{BLANKS}]+[0-9]",
}

# Both run patterns in one pass over the text: from the first digit of a run to
# its end, plus an X right behind it. The quantifier is possessive, so the scan
# is linear and every match is a whole run.
_ANY_RUN = rf"[0-9][0-9\-{BLANKS}]*+[Xx]?"


def find_runs(text: Column, kind: str) -> Column:
    """H1/H2: all identifier-like runs of ``text`` for one ISBN kind."""
    return F.regexp_extract_all(text, F.lit(RUN_PATTERNS[kind]), F.lit(0))


def is_candidate(s: Column) -> Column:
    """P5: 10 or 13 characters, digits and X only, not a known bad number."""
    return (
        F.length(s).isin(10, 13) & ~s.rlike("[^0-9Xx]") & ~s.isin(BAD_ISBNS)
    )


def _check_sum(s: Column, term) -> Column:
    """Sum of ``term(position, character)`` over ``s``; positions start at 0."""
    positions = F.sequence(F.lit(0), F.length(s) - 1)
    total = F.aggregate(
        positions,
        F.lit(0),
        lambda acc, i: acc + term(i, F.substr(s, i + 1, F.lit(1))),
    )
    return F.when(F.length(s) > 0, total).otherwise(F.when(s.isNotNull(), 0))


def isbn10_valid(s: Column) -> Column:
    """Weighted sum divisible by 11; X counts 10 and only ends the number."""

    def term(i, c):
        return (
            F.when(c.between("0", "9"), (F.lit(10) - i) * (F.ascii(c) - 48))
            .when(c == "X", 10)
            .otherwise(0)
        )

    x_only_last = ~F.substr(s, F.lit(1), F.length(s) - 1).contains("X")
    return x_only_last & (_check_sum(s, term) % 11 == 0)


def isbn13_valid(s: Column) -> Column:
    """Sum with alternating weights 1 and 3 divisible by 10."""

    def term(i, c):
        return F.when(i % 2 == 0, 1).otherwise(3) * (F.ascii(c) - 48)

    return _check_sum(s, term) % 10 == 0


def _check_sql(kind: str, length: int) -> str:
    """P6 or P7 for a candidate of known length, written out over its digits."""
    if kind == "isbn10":
        weights = range(10, 10 - length, -1)
    else:
        weights = [3 if i % 2 else 1 for i in range(length)]
    digits = [f"{w}*(ascii(substr(s,{i},1))-48)" for i, w in enumerate(weights, 1)]
    total = " + ".join(digits)
    if kind == "isbn13":
        return f"({total}) % 10 = 0"
    ended = " + ".join([*digits[:-1], "10"])
    return f"if(endswith(s, 'X'), {ended}, {total}) % 11 = 0"


def candidate_numbers(text: str) -> Column:
    """Cleaned runs of the column ``text`` long enough for an ISBN, in text order.

    They consist of digits, with perhaps an X at the end.
    """
    runs = f"regexp_extract_all({text}, r'{_ANY_RUN}', 0)"
    cleaned = f"transform({runs}, s -> upper(translate(s, '{SEPARATORS}', '')))"
    return F.expr(f"filter({cleaned}, s -> length(s) between 10 and 14)")


def isbns_of(numbers: str, kind: str, strict_length: bool = False) -> Column:
    """H4 on a column of ``candidate_numbers``: P5, P6/P7 and P8.

    An X behind a run belongs to the ISBN-10 reading only; the ISBN-13 reading
    ends at the last digit. (SQL text: the same in Column calls takes a second
    to put together.)
    """
    if kind == "isbn13":
        numbers = f"transform({numbers}, s -> rtrim('X', s))"
    if strict_length:
        numbers = f"filter({numbers}, s -> length(s) = {int(kind[-2:])})"
    bad = ", ".join(f"'{s}'" for s in BAD_ISBNS)
    return F.expr(
        f"""filter({numbers}, s -> s not in ({bad}) and
            case length(s) when 10 then {_check_sql(kind, 10)}
                           when 13 then {_check_sql(kind, 13)} else false end)"""
    )


def identify_isbns(df: DataFrame, text: str = "text", strict_length: bool = False) -> DataFrame:
    """H4: replace the column ``text`` by ``isbn10s`` and ``isbn13s``.

    The length of an ISBN is not checked unless asked for.
    """
    others = [c for c in df.columns if c != text]
    numbers = df.select(*others, candidate_numbers(text).alias("numbers"))
    return numbers.select(
        *others,
        *[isbns_of("numbers", k, strict_length).alias(f"{k}s") for k in ("isbn10", "isbn13")],
    )
