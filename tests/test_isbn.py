import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colophon.functions import isbn
from tests import brute

# A copyright page with two printed and two electronic numbers.
PAGE = (
    "            <p>ISBN-13: 978-1-7185-0126-3 (print) \nISBN-13: 978-1-7185-0127-0 (ebook)\n</p>\n"
    "Identifiers: LCCN 2020052503 (print) | LCCN 2020052504 (ebook) | ISBN \n"
    "   9781718501263 (paperback) | ISBN 1718501269 (paperback) | ISBN \n"
    "   9781718501270 (ebook)  \nSubjects: LCSH: Computer networks--Security measures. | Hacking. | Cloud \n"
    "   computing--Security measures. | Penetration testing (Computer networks) \n"
    "Classification: LCC TK5105.59 .F624 2021  (print) | LCC TK5105.59  (ebook) \n"
    "   | DDC 005.8/7--dc23 \nLC record available at https://lccn.loc.gov/2020052503\n"
    "LC ebook record available at https://lccn.loc.gov/2020052504\n</p>"
)


def identify(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    t = F.col("text")
    with_runs = df.select(
        "*", isbn.find_runs(t, "isbn10").alias("runs10"), isbn.find_runs(t, "isbn13").alias("runs13")
    )
    return sorted(isbn.identify_isbns(with_runs).collect())


def checks(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    n = F.col("n")
    return {
        r.n: (r.c, r.v10, r.v13)
        for r in df.select(
            "n",
            isbn.is_candidate(n).alias("c"),
            isbn.isbn10_valid(n).alias("v10"),
            isbn.isbn13_valid(n).alias("v13"),
        ).collect()
    }


def test_candidates_and_checksums(spark):
    got = checks(
        spark,
        ["9781718501263", "9781718501270", "1718501269", "123", "11111111111", "1234567891123",
         "1111111111", "123456789x", "12345678x9", "0000000000000"],
    )
    assert [n for n, r in got.items() if r[0]] == [
        "9781718501263", "9781718501270", "1718501269", "1234567891123", "123456789x",
        "12345678x9", "0000000000000",
    ]
    assert got["1718501269"][1] and got["9781718501263"][2] and got["9781718501270"][2]
    assert not got["1234567891123"][2]


def test_copyright_page(spark):
    (row,) = identify(spark, [PAGE])
    assert len(row.runs10) == len(row.runs13) == 18
    assert row.isbn10s == ["2020052504", "1718501269", "2020052504"]
    assert row.isbn13s == ["9781718501263", "9781718501270", "9781718501263", "9781718501270"]


@pytest.mark.parametrize(
    "text, isbn10s, isbn13s",
    [
        ("9781718501263 9781718501270", [], []),
        ("0-8044-2957-X", ["080442957X"], []),
        ("080442957x", ["080442957X"], []),
        ("1 2 3 4 5 6 7 8 9 X", ["123456789X"], []),
        ("0000000000", [], []),
        ("0000000000000", ["0000000000000"], ["0000000000000"]),
        ("3-16-148410-0.", [], ["3161484100"]),
        ("ISBN:9783161484100", [], ["9783161484100"]),
        ("978\x0b1718501263", [], []),
        ("9780306564536", ["9780306564536"], ["9780306564536"]),
        ("9781718501263X", [], ["9781718501263"]),
        ("", [], []),
    ],
)
def test_vectors(spark, text, isbn10s, isbn13s):
    (row,) = identify(spark, [text])
    assert (row.isbn10s, row.isbn13s) == (isbn10s, isbn13s)


def test_null_text_has_no_isbns(spark):
    (row,) = identify(spark, [None])
    assert row.isbn10s is None and row.isbn13s is None


def random_texts(n, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            digits = "".join(rng.choice("0123456789") for _ in range(rng.choice([1, 8, 9, 10, 11, 12, 13, 14])))
            glued = "".join(d + rng.choice(["", "", "", "-", " ", "\n", " - "]) for d in digits)
            parts.append(rng.choice(["", " ", "-"]) + glued + rng.choice(["", "X", "x", "XX", "X5", "a", " ", " X", "."]))
        texts.append("".join(parts))
    return texts


def test_one_pass_equals_both_patterns(spark):
    texts = random_texts(4000, 7)
    rows = identify(spark, texts)
    assert sum(len(r.isbn10s) + len(r.isbn13s) for r in rows) > 200
    for text, row in zip(texts, rows):
        assert row.isbn10s == brute.isbns(text, "isbn10"), text
        assert row.isbn13s == brute.isbns(text, "isbn13"), text
        assert row.runs10 == brute.runs(text, "isbn10"), text
        assert row.runs13 == brute.runs(text, "isbn13"), text


def test_checks_equal_brute_force(spark):
    rng = random.Random(3)
    numbers = {"".join(rng.choice("0123456789Xx") for _ in range(rng.randint(1, 15))) for _ in range(3000)}
    numbers |= {"".join(rng.choice("0123456789") for _ in range(n)) for n in (10, 13) for _ in range(500)}
    for n, (c, v10, v13) in checks(spark, sorted(numbers)).items():
        assert c == brute.candidate(n), n
        assert v10 == brute.valid10(n), n
        assert v13 == brute.valid13(n), n


def check_digit13(twelve):
    return str(-sum((3 if i % 2 else 1) * int(c) for i, c in enumerate(twelve)) % 10)


def check_digit10(nine):
    value = -sum((10 - i) * int(c) for i, c in enumerate(nine)) % 11
    return "X" if value == 10 else str(value)


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.tuples(st.text("0123456789", min_size=9, max_size=9), st.sampled_from(["-", " ", ""]), st.integers(0, 8)),
        min_size=50,
        max_size=50,
    )
)
def test_valid_isbns_are_found_and_changed_ones_are_not(spark, cases):
    texts, wanted = [], []
    for nine, separator, place in cases:
        ten = nine + check_digit10(nine)
        thirteen = "978" + nine + check_digit13("978" + nine)
        changed = nine[:place] + str((int(nine[place]) + 1) % 10) + ten[place + 1:]
        for number, kind, found in ((ten, "isbn10", True), (thirteen, "isbn13", True), (changed, "isbn10", False)):
            texts.append(f"ISBN {separator.join(number)}.")
            wanted.append((number, kind, found and brute.candidate(number)))
    for row, (number, kind, found) in zip(identify(spark, texts), wanted):
        assert (number in row[f"{kind}s"]) == found


def test_strict_length(spark):
    df = spark.createDataFrame([("9780306564536; 3-16-148410-0",)], "t string")
    assert list(isbn.identify_isbns(df, "t", strict_length=True).first()) == [[], ["9780306564536"]]


def test_long_blank_runs_stay_linear(spark):
    (row,) = identify(spark, [" " * 300_000 + "a" + "- " * 300_000 + "ISBN 9781718501263"])
    assert row.isbn13s == ["9781718501263"]
