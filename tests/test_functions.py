import random

import pytest
from pyspark.sql import functions as F

from colophon.functions import records, text as tx
from colophon.functions.distance import title_distance
from colophon.schemas import BOOK
from tests import brute


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "v string").select(*columns).first()


@pytest.mark.parametrize(
    "path, name, ext, supported",
    [
        ("/b/a.pdf", "a.pdf", ".pdf", True),
        ("/b/a.PDF", "a.PDF", ".PDF", False),
        ("/b.pdf/a", "a", "", False),
        ("/b/.epub", ".epub", ".epub", True),
        ("/b/a.tar.txt", "a.tar.txt", ".txt", True),
        ("/b/a.", "a.", ".", False),
    ],
)
def test_paths(spark, path, name, ext, supported):
    v = F.col("v")
    assert list(one(spark, path, tx.basename(v), tx.extension(v), tx.is_supported(v))) == [name, ext, supported]


def test_absolute_path(spark):
    v = tx.absolute_path(F.col("v"))
    assert one(spark, "file:/b/a.pdf", v)[0] == "/b/a.pdf"
    assert one(spark, "file:///b/a.pdf", v)[0] == "/b/a.pdf"
    assert one(spark, "hdfs://n/b/a.pdf", v)[0] == "hdfs://n/b/a.pdf"


def test_window_and_gate_count_bytes(spark):
    v = F.col("v")
    row = one(
        spark, "é" * 3,
        F.length(tx.truncate_bytes(v, 5).cast("binary")), tx.enough_text(v, 6), tx.enough_text(v, 7),
    )
    assert list(row) == [5, True, False]
    assert one(spark, None, tx.enough_text(v, 1))[0] is False


def test_html(spark):
    html = '<p>ISBN&nbsp;978&#39;s <!-- 1 --><script>var t="</p>";</script>a &lt;b&gt; &amp;lt;</p><style>x'
    assert one(spark, html, tx.html_to_text(F.col("v")))[0].split() == ["ISBN", "978's", "a", "<b>", "&lt;"]
    for ref in ("978&#45;1", "978&#x2d;1", "978&#X2D;1"):
        assert one(spark, ref, tx.html_to_text(F.col("v")))[0] == "978-1"
    odd = "&#8211;&ndash;&#x1F600;&#0;&#1114112;&#xD800;&amp;#45;&# 45;&#45"
    assert one(spark, odd, tx.html_to_text(F.col("v")))[0] == "\u2013\u2013\U0001f600&#0;&#1114112;&#xD800;&#45;&# 45;&#45"


def test_broken_utf8_is_text(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "v binary")
    assert df.select(tx.decode_utf8(F.col("v"))).first()[0] == "a�b"


DISTANCES = [
    ("How to Hack Like a Ghost", "ghost.pdf", 23, 27), ("kitten", "sitting", 3, 7), ("", "a.pdf", 5, 4),
    ("abc", "abc", 0, 1), ("Dune", "Dune.epub", 5, 7), ("Emma", "Dune.epub", 9, 10),
    ("Dune Messiah", "Dune.epub", 7, 13), ("a", "a", 0, 0), ("ab", "xb", 1, 1), ("abcd", "bcda", 2, 4),
    ("xab", "ab", 1, 2),
]


def distances(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select("i", title_distance(a, b), title_distance(a, b, "compat")).collect()
    return [(t, c) for _, t, c in sorted(map(tuple, rows))]


def test_title_distance(spark):
    assert distances(spark, [d[:2] for d in DISTANCES]) == [d[2:] for d in DISTANCES]


def random_names(seed, letters, n):
    rng = random.Random(seed)
    word = lambda least: "".join(rng.choice(letters) for _ in range(rng.randint(least, 9)))
    return [(word(0), word(1)) for _ in range(n)]


def test_title_distance_random(spark):
    pairs = random_names(5, "abé. ", 300)
    assert [t for t, _ in distances(spark, pairs)] == [brute.levenshtein(a, b) for a, b in pairs]


def test_compat_distance_counts_bytes(spark):
    """Writing every byte as a letter of its own changes nothing."""
    pairs = random_names(6, "abéñ€", 300)
    seen = sorted({byte for pair in pairs for text in pair for byte in text.encode()})
    letter = {byte: chr(ord("A") + i) for i, byte in enumerate(seen)}
    spelled = [tuple("".join(letter[x] for x in text.encode()) for text in pair) for pair in pairs]
    assert [c for _, c in distances(spark, pairs)] == [c for _, c in distances(spark, spelled)]


def test_unknown_modes(spark):
    with pytest.raises(ValueError):
        title_distance(F.lit("a"), F.lit("b"), "other")
    with pytest.raises(ValueError):
        records.object_key(F.lit("a"), "other")


def test_pick_identifier(spark):
    ids = [("ISBN_13", "first"), ("isbn_13", "last"), ("OTHER", "o"), ("Uom", "u")]
    df = spark.createDataFrame([(ids,)], "ids array<struct<type string, identifier string>>")
    row = df.select(*[records.pick_identifier(F.col("ids"), k) for k in ("isbn_13", "isbn_10", "uom")]).first()
    assert list(row) == ["last", None, "u"]


def book(**fields):
    return tuple(fields.get(f.name) for f in BOOK)


def test_best_identifier(spark):
    rows = [
        book(isbn13="13", isbn10="10", filepath="/a"), book(isbn13="", isbn10="10", filepath="/b"),
        book(uom="u", title="t", filepath="/c"), book(title="t", filepath="/d"), book(title="", filepath="/e"),
    ]
    got = spark.createDataFrame(rows, BOOK).select("filepath", records.best_identifier()).collect()
    assert dict(map(tuple, got)) == {"/a": "13", "/b": "10", "/c": "u", "/d": "t", "/e": "/e"}


def test_book_json_leaves_empty_fields_out(spark):
    rows = [book(filepath="/a", authors=[], low_year=0, isbn10=""), book(title='q"', filepath="/b", authors=["x"], high_year=3)]
    got = [r[0] for r in spark.createDataFrame(rows, BOOK).select(records.book_json()).collect()]
    assert got == ['{"title":"","filepath":"/a"}', '{"title":"q\\"","authors":["x"],"high_year":3,"filepath":"/b"}']


def test_object_key(spark):
    v = F.col("v")
    row = one(spark, '/a"b\\c', records.object_key(v), records.object_key(v, "compat"))
    assert list(row) == ['"/a\\"b\\\\c"', '"/ab\\c"']


def test_unidentified_and_confidence(spark):
    df = spark.createDataFrame(
        [(None, None, None, None, float("nan")), ("t", None, None, None, 1.0), (None, None, None, "1", 0.0), (None, ["a"], None, None, None)],
        "title string, authors array<string>, isbn10 string, isbn13 string, c double",
    )
    rows = df.select(records.is_unidentified(), records.has_confidence(F.col("c"))).collect()
    assert [list(r) for r in rows] == [[True, False], [False, True], [False, False], [False, False]]
