import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from colophon import Provider, scan
from colophon.functions.records import book_json
from colophon.operators import collate, identify
from colophon.plans.scan import answer_table
from tests.helpers import VOLUMES, body, books, by_path, plan_of, responses, rows_of, texts

A, B, C = "9781718501263", "9781718501270", "1718501269"


@pytest.fixture(scope="module")
def corpus(spark):
    return texts(
        spark,
        [
            ("/b/hit.pdf", f"ISBN {A} and {C}"), ("/b/second.epub", f"see {C}; also ISBN {A}."),
            ("/b/none.txt", "nothing here"), ("/b/failed.txt", f"ISBN {B} or {A}"), ("/b/zero.txt", f"ISBN {C}"),
            ("/b/short.txt", ""), ("/b/other.xyz", f"ISBN {A}"),
        ],
    )


@pytest.fixture(scope="module")
def google(spark):
    rows = [(A, 200, body("hit", "second", isbn_13=A)), (B, 429, None), (C, 200, body())]
    return Provider("google", responses(spark, rows))


def errors(result, **kw):
    return by_path(result.books(**kw), "title", "error")


EXPECTED = {
    "/b/hit.pdf": ("hit", None),
    "/b/second.epub": ("second", None),
    "/b/none.txt": ("", collate.NO_RESULTS),
    "/b/failed.txt": ("", collate.NO_RESULTS),
    "/b/zero.txt": ("", collate.NOT_COLLATED),
    "/b/short.txt": ("", identify.NO_TEXT),
}


def test_every_file_has_one_outcome(corpus, google):
    result = scan(corpus, [google])
    assert errors(result) == EXPECTED
    assert by_path(result.outcomes, "stage", "status") == {
        "/b/hit.pdf": ("collate", "ok"), "/b/second.epub": ("collate", "ok"), "/b/none.txt": ("search", "failed"),
        "/b/failed.txt": ("search", "failed"), "/b/zero.txt": ("collate", "failed"), "/b/short.txt": ("extract", "failed"),
    }
    assert {tuple(r) for r in result.summary().collect()} == {
        ("collate", "ok", 2), ("search", "failed", 2), ("collate", "failed", 1), ("extract", "failed", 1),
    }
    hit = result.books().where("title = 'hit'").first()
    assert (hit.authors, hit.isbn13, hit.publish_date) == (["by hit"], A, "2001")


def test_counts_come_with_the_write(corpus, google, tmp_path):
    counts = Observation("counts")
    scan(corpus, [google]).observed(counts).books().write.parquet(str(tmp_path / "b"))
    assert counts.get == {"files": 6, "ok": 2, "extract_failed": 1, "search_failed": 2, "collate_failed": 1}


def test_a_shared_response_table(spark, corpus):
    rows = [("g", A, 200, body("of g")), ("h", A, 200, body("of h")), ("h", C, 200, body())]
    shared = spark.createDataFrame(rows, "provider string, isbn string, status int, body string")
    got = [errors(scan(corpus, [Provider(n, shared, missing="zero_hit")]))["/b/hit.pdf"] for n in "gh"]
    assert got == [("of g", None), ("of h", None)]


def test_compat_writes_successes_and_extract_errors(corpus, google):
    kept = {p: e for p, e in EXPECTED.items() if e[1] in (None, identify.NO_TEXT)}
    assert errors(scan(corpus, [google]), compat=True) == kept


def test_reference_window(spark, google):
    df = texts(spark, [("/a.txt", f"ISBN {A}".ljust(10_000)), ("/late.txt", " ".rjust(10_000, ".") + A), ("/short.txt", f"ISBN {A}")])
    assert by_path(scan(df, [google], max_bytes=10_000).books(), "error") == {
        "/a.txt": None, "/late.txt": collate.NO_RESULTS, "/short.txt": identify.NO_TEXT,
    }
    assert by_path(scan(df, [google]).books(), "error") == {"/a.txt": None, "/late.txt": None, "/short.txt": None}


def test_cache_and_retry(spark, corpus, google):
    cache = books(spark, {"filepath": "/b/hit.pdf", "title": "old"}, {"filepath": "/b/second.epub", "error": "no texts extracted"}, {"filepath": "/gone.pdf", "title": "gone"})
    kept = scan(corpus, [google], cache=cache)
    assert errors(kept) == {**EXPECTED, "/b/hit.pdf": ("old", None), "/b/second.epub": ("", "no texts extracted"), "/gone.pdf": ("gone", None)}
    retried = scan(corpus, [google], cache=cache, retry=True)
    assert errors(retried) == {**EXPECTED, "/b/hit.pdf": ("old", None), "/gone.pdf": ("gone", None)}
    with pytest.raises(ValueError):
        scan(corpus, [google], retry=True)


def test_large_set_of_new_files(spark, corpus, google, monkeypatch):
    monkeypatch.setattr("colophon.operators.incremental.BROADCAST_BYTES", 0)
    cache = books(spark, {"filepath": "/b/hit.pdf", "title": "old"})
    assert errors(scan(corpus, [google], cache=cache)) == {**EXPECTED, "/b/hit.pdf": ("old", None)}


def test_own_output_as_cache_changes_nothing(corpus, google):
    first = scan(corpus, [google]).books()
    again = scan(corpus, [google], cache=first)
    assert again.outcomes.count() == 0
    assert rows_of(again.books()) == rows_of(first)


def test_dry_run(spark, corpus, google):
    cache = books(spark, {"filepath": "/b/hit.pdf", "title": "old"})
    result = scan(corpus, [google], cache=cache, dry_run=True)
    assert errors(result) == {"/b/hit.pdf": ("old", None), "/b/short.txt": ("", identify.NO_TEXT)}
    assert set(by_path(result.search_terms, "isbn13s")) == {"/b/second.epub", "/b/none.txt", "/b/failed.txt", "/b/zero.txt"}
    assert {r.provider for r in result.plan_lookups().collect()} == {"google"} and B in {r.isbn for r in result.plan_lookups().collect()}
    known = answer_table([google])
    assert [r.isbn for r in result.plan_lookups(known).collect()] == [B]
    assert [r.isbn for r in scan(corpus, [google]).plan_lookups(budget=1).collect()] == [B]


def test_two_providers(spark, corpus, google):
    library = Provider("library", responses(spark, [(B, 200, body("lib B")), (C, 200, body("lib C"))]), missing="zero_hit", confidence=60.0)
    got = errors(scan(corpus, [google, library]))
    # the first provider is surer, the second fills in where it failed or found nothing
    assert got["/b/hit.pdf"] == ("hit", None)
    assert got["/b/failed.txt"] == ("lib B", None)
    assert got["/b/zero.txt"] == ("lib C", None)
    assert got["/b/none.txt"] == EXPECTED["/b/none.txt"]
    even = Provider("even", library.responses, missing="zero_hit")
    assert errors(scan(corpus, [even, google]))["/b/hit.pdf"] == ("lib C", None)


def test_own_confidence_column(spark, corpus):
    rows = [(A, 200, body("sure"), 5.0), (C, 200, body("nan"), float("nan"))]
    provider = Provider("own", spark.createDataFrame(rows, "isbn string, status int, body string, confidence double"), missing="zero_hit")
    got = errors(scan(corpus, [provider]))
    assert got["/b/hit.pdf"] == ("sure", None)
    assert got["/b/zero.txt"] == ("", collate.NOT_COLLATED)


def test_catalogue_provider(spark, corpus):
    rows = [(1, "second", ["x"], [("isbn_13", A)], "1999"), (2, "hit", ["y"], [("ISBN_13", A), ("ISBN_10", "0")], None)]
    got = by_path(scan(corpus, [Provider("cat", volumes=spark.createDataFrame(rows, VOLUMES))]).books(), "title", "isbn10", "error")
    assert got["/b/hit.pdf"] == ("hit", "0", None)
    assert got["/b/second.epub"] == ("second", None, None)
    assert got["/b/zero.txt"] == ("", None, collate.NOT_COLLATED)


def test_provider_function_sees_each_isbn_once(spark, corpus, google):
    asked = []

    def ask(isbns):
        asked.append(sorted(r.isbn for r in isbns.collect()))
        return google.responses

    assert errors(scan(corpus, [Provider("google", ask)])) == EXPECTED
    assert asked == [sorted([A, B, C])]


def test_two_extractors(spark, corpus, google):
    second = texts(spark, [("/b/short.txt", f"ISBN {A}"), ("/b/none.txt", None), ("/b/extra.pdf", "")])
    got = errors(scan([corpus, second], [google]))
    assert got["/b/short.txt"] == ("second", None) or got["/b/short.txt"][1] is None
    assert got["/b/extra.pdf"] == ("", identify.NO_TEXT)
    assert got["/b/none.txt"] == EXPECTED["/b/none.txt"]


def test_a_repeated_isbn_is_asked_once(spark, google):
    df = texts(spark, [("/b/hit.pdf", f"{B}; {A}; " * 2000), ("/b/x.pdf", f"{A}; " * 2000)])
    result = scan(df, [google])
    assert errors(result) == {"/b/hit.pdf": ("", collate.NO_RESULTS), "/b/x.pdf": ("hit", None)}
    asked = identify.asked_isbns(result.search_terms)
    assert {tuple(r) for r in asked.collect()} == {("/b/hit.pdf", 0, B), ("/b/hit.pdf", 1, A), ("/b/x.pdf", 0, A)}


def test_a_path_given_twice_is_written_once(corpus, google):
    assert errors(scan(corpus.unionByName(corpus), [google])) == EXPECTED


def test_at_least_one_extractor_and_provider(corpus, google):
    with pytest.raises(ValueError):
        scan([], [google])
    with pytest.raises(ValueError):
        scan(corpus, [])
    with pytest.raises(ValueError):
        scan(corpus, [Provider("off", google.responses, enabled=False)])
    with pytest.raises(ValueError):
        Provider("nothing")
    with pytest.raises(ValueError):
        Provider("bad", google.responses, missing="other")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the files name one ISBN, a third of the catalogue carries it."""
    rng = random.Random(11)

    def isbn13():
        twelve = "978" + "".join(rng.choice("0123456789") for _ in range(9))
        return twelve + str(-sum((3 if i % 2 else 1) * int(c) for i, c in enumerate(twelve)) % 10)

    pool = [isbn13() for _ in range(40)]
    files = [
        (f"/s/{rng.choice('abcdef') * rng.randint(1, 5)}{i}.txt", "; ".join([pool[0]] * (i % 3 == 0) + rng.sample(pool, rng.randint(0, 3))))
        for i in range(600)
    ]
    volumes = [
        (i, rng.choice("abcdef") * rng.randint(1, 9), ["x"], [("isbn_13", pool[0] if i % 3 == 0 else rng.choice(pool))], None)
        for i in range(300)
    ]
    answered = [(p, rng.choice([200, 200, 200, 429]), body("aaa", "bb", "ccc")) for p in pool[1:]] + [(pool[0], 200, body("aa", "dddd"))]
    return texts(spark, files), spark.createDataFrame(volumes, VOLUMES), responses(spark, answered)


def test_splitting_hot_isbns_changes_nothing(skewed):
    df, volumes, answered = skewed
    for provider in (Provider("g", answered), Provider("c", volumes=volumes)):
        plain = rows_of(scan(df, [provider]).books().select("filepath", "error", book_json().alias("j")))
        split = scan(df, [provider], hot_rows=20)
        assert rows_of(split.books().select("filepath", "error", book_json().alias("j"))) == plain
        assert "salt" in plan_of(split.outcomes)


def test_result_does_not_depend_on_partitions(spark, skewed):
    df, _, answered = skewed
    provider = Provider("g", answered)
    one = rows_of(scan(df.coalesce(1), [provider]).books())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows_of(scan(df.repartition(13), [provider]).books()) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_plans(spark, corpus, google, tmp_path):
    corpus.withColumn("junk", F.lit("x")).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    # reading the texts: map-only, needed columns only, the expression once
    extraction = plan_of(identify.extract_terms(identify.supported(stored)))
    assert "Exchange" not in extraction and "Python" not in extraction
    assert "ReadSchema: struct<filepath:string,text:string>" in extraction
    assert extraction.count("regexp_extract_all(") == 1
    # the rest: one shuffle of the files besides what the join itself needs
    outcomes = plan_of(scan(corpus, [google]).outcomes)
    assert "Python" not in outcomes and "CartesianProduct" not in outcomes and "NestedLoop" not in outcomes
    by_file = [line for line in outcomes.splitlines() if "hashpartitioning(filepath" in line]
    assert len(by_file) == 1
