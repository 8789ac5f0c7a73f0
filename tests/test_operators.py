import random

import pytest
from pyspark.sql import functions as F

from colophon.operators import answers as an
from colophon.operators import collate, identify, incremental, lookup
from colophon.operators.skew import hot_keys, salted_left_join
from tests import brute
from tests.helpers import VOLUMES, body, books, by_path, responses, rows_of, texts
from workload import corpus as wc

A, B, C = "9781718501263", "9781718501270", "1718501269"


def terms(spark, rows):
    return spark.createDataFrame(rows, "filepath string, ord int, kind string, isbn string")


# identify -------------------------------------------------------------------


def test_extract_searches_the_whole_text(spark):
    df = texts(spark, [("/a", "x" * 50_000 + f" ISBN {A}")])
    assert identify.extract_terms(df).first().isbn13s == [A]
    assert identify.extract_terms(df, max_bytes=10_000).first().isbn13s == []


def test_short_texts_fail(spark):
    df = texts(spark, [("/a", f"ISBN {A}"), ("/b", ""), ("/c", None)])
    assert by_path(identify.extract_terms(df), "error") == {"/a": None, "/b": identify.NO_TEXT, "/c": identify.NO_TEXT}
    window = identify.extract_terms(df, max_bytes=10_000)
    assert by_path(window, "error", "isbn13s")["/a"] == (identify.NO_TEXT, [])
    lenient = identify.extract_terms(df, max_bytes=10_000, min_bytes=0)
    assert by_path(lenient, "error", "isbn13s")["/a"] == (None, [A])


def test_a_failed_extractor_is_a_failed_row(spark):
    df = spark.createDataFrame([("/a", f"ISBN {A}", "boom")], "filepath string, text string, error string")
    row = identify.extract_terms(df).first()
    assert (row.isbn13s, row.error) == ([], identify.NO_TEXT)


def test_gather_terms_appends_in_order(spark):
    first = identify.extract_terms(texts(spark, [("/a", f"ISBN {B}"), ("/b", ""), ("/c", ""), ("/a", f"ISBN {B}")]))
    second = identify.extract_terms(texts(spark, [("/a", f"ISBN {A}; {C}"), ("/b", f"ISBN {A}"), ("/c", None)]))
    got = by_path(identify.gather_terms([first, second]), "isbn10s", "isbn13s", "error")
    assert got == {
        "/a": ([C], [B, A], None), "/b": ([], [A], None), "/c": ([], [], identify.NO_TEXT),
    }


def test_lookup_terms_put_isbn10s_first(spark):
    df = spark.createDataFrame([("/a", [C, C], [A]), ("/b", [], [])], "filepath string, isbn10s array<string>, isbn13s array<string>")
    assert [tuple(r) for r in identify.lookup_terms(df).collect()] == [
        ("/a", 0, "isbn10", C), ("/a", 1, "isbn10", C), ("/a", 2, "isbn13", A),
    ]
    assert by_path(df, identify.has_any_terms().alias("t")) == {"/a": True, "/b": False}


# answers --------------------------------------------------------------------


def test_response_answers(spark):
    df = responses(
        spark,
        [
            ("hit", 200, body("T", isbn_10="1", isbn_13="2", uom="3")), ("none", 200, body()),
            ("noitems", 200, body(total=3)), ("late", 429, None), ("nobody", 200, None), ("broken", 200, "{"),
            ("nototal", 200, "{}"), ("nostatus", None, body("T")),
        ],
    )
    got = {r.isbn: r for r in an.response_answers(df, "google").collect()}
    assert {k: (r.failed, r.confidence) for k, r in got.items()} == {
        "hit": (False, 100.0), "none": (False, 0.0), "noitems": (True, 0.0), "late": (True, 0.0),
        "nobody": (True, 0.0), "broken": (True, 0.0), "nototal": (False, 0.0), "nostatus": (True, 0.0),
    }
    assert got["noitems"].error == an.NO_MATCH and "429" in got["late"].error
    item = got["hit"]["items"][0]
    assert (item.title, item.isbn10, item.isbn13, item.uom, item.publish_date) == ("T", "1", "2", "3", "2001")


def test_repeated_responses_count_once(spark):
    df = responses(spark, [("a", 429, None), ("a", 200, body("T")), ("a", 200, body()), ("a", 200, body("T"))])
    (row,) = an.response_answers(df, "google").collect()
    assert (row.failed, row.confidence, row["items"][0].title) == (False, 100.0, "T")


def test_lookup_matches_each_file_by_its_own_name(spark):
    found = an.response_answers(
        responses(spark, [(A, 200, body("Dune Messiah", "Dune", "Dune")), (B, 429, None), (C, 200, body())]), "google"
    )
    asked = terms(
        spark, [("/x/Dune.epub", 0, "isbn13", A), ("/x/Dune Messiah.epub", 0, "isbn13", A), ("/y", 0, "isbn13", B),
                ("/y", 1, "isbn10", C), ("/z", 0, "isbn13", "9780000000002")],
    )
    got = {(r.filepath, r.ord): r for r in lookup.lookup(asked, found, [("google", "error")]).collect()}
    assert got["/x/Dune.epub", 0].item.title == "Dune" and got["/x/Dune.epub", 0].item.ord == 1
    assert got["/x/Dune Messiah.epub", 0].item.title == "Dune Messiah"
    assert got["/y", 0].failed and not got["/y", 1].failed and got["/y", 1].confidence == 0
    assert got["/z", 0].failed and got["/z", 0].error == lookup.NOT_ANSWERED
    lenient = lookup.lookup(asked, found, [("google", "zero_hit")]).where("filepath = '/z'").first()
    assert not lenient.failed and lenient.confidence == 0
    with pytest.raises(ValueError):
        lookup.lookup(asked, found, [("google", "other")])


@pytest.mark.parametrize("chunk_titles", [1, 3, 1000])
def test_catalogue_equals_brute_force(spark, chunk_titles):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
    volumes = []
    for i in range(120):
        hot = rng.random() < 0.4
        ids = [("ISBN_13", "hot" if hot else rng.choice("pqrs")), ("isbn_10", rng.choice("tu")), ("uom", "m")]
        volumes.append((i, word(), [f"author {i}"], ids, None))
    asked = [(f"/d/{word()}{i}", 0, "isbn13", rng.choice(["hot", "p", "q", "t", "absent"])) for i in range(60)]
    found = an.catalogue_answers(spark.createDataFrame(volumes, VOLUMES), "cat", chunk_titles=chunk_titles)
    if chunk_titles == 1:
        assert found.where("isbn = 'hot'").count() > 1
    matched = lookup.lookup(terms(spark, asked), found, [("cat", "zero_hit")], chunked=True)
    got = by_path(matched, "confidence", "distance", "item.ord")
    for path, _, _, isbn in asked:
        ranked = [
            (brute.levenshtein(title, path.split("/")[-1]), i)
            for i, title, _, ids, _ in volumes
            if isbn in (ids[0][1], ids[1][1])
        ]
        assert got[path] == ((100.0, *min(ranked)) if ranked else (0.0, None, None))


def test_lookup_of_two_providers_with_a_hot_isbn(spark):
    found = an.response_answers(responses(spark, [(A, 200, body("g"))]), "g").unionByName(
        an.response_answers(responses(spark, [(A, 200, body("l")), (B, 500, None)]), "l", 1, 60.0)
    )
    asked = terms(spark, [(f"/{i}", 0, "isbn13", A if i % 3 else B) for i in range(90)])
    assert lookup.hot_isbns(asked, 100) is None
    hot = lookup.hot_isbns(asked, 20)
    assert {tuple(r) for r in hot.collect()} == {(A, 3), (B, 2)}
    providers = [("g", "error"), ("l", "zero_hit")]
    plain, split = (lookup.lookup(asked, found, providers, hot=h) for h in (None, hot))
    assert rows_of(split) == rows_of(plain)
    got = {(r.filepath, r.provider): (r.failed, r.confidence) for r in split.collect()}
    assert len(got) == 180
    assert (got["/1", "g"], got["/1", "l"]) == ((False, 100.0), (False, 60.0))
    assert (got["/0", "g"], got["/0", "l"]) == ((True, 0.0), (True, 0.0))


# gate, choice, plan ---------------------------------------------------------


def lookups(spark, rows):
    return spark.createDataFrame(rows, "filepath string, provider string, provider_ord int, ord int, failed boolean, confidence double")


def test_provider_gate(spark):
    df = lookups(
        spark, [("/a", "g", 0, 0, False, 100.0), ("/a", "g", 0, 1, True, 0.0), ("/a", "l", 1, 0, False, 60.0),
                ("/b", "g", 0, 0, False, 100.0)],
    )
    left = {(r.filepath, r.provider) for r in lookup.provider_gate(df).collect()}
    assert left == {("/a", "l"), ("/b", "g")}


def results(spark, rows):
    from colophon.schemas import RESULT

    full = [tuple({"filepath": p, "title": t, "confidence": c, "provider_ord": po, "ord": o}.get(f.name) for f in RESULT) for p, t, c, po, o in rows]
    return spark.createDataFrame(full, RESULT)


def test_choose_best(spark):
    nan = float("nan")
    df = results(
        spark, [("/a", "nan", nan, 0, 0), ("/a", "zero", 0.0, 0, 1), ("/a", "first", 100.0, 0, 2), ("/a", "second", 100.0, 0, 3),
                ("/b", "nan", nan, 0, 0), ("/b", "zero", 0.0, 0, 1), ("/c", "late provider", 100.0, 1, 0), ("/c", "x", 100.0, 0, 9),
                ("/d", "sure", 90.0, 1, 5), ("/d", "unsure", 10.0, 0, 0)],
    )
    assert by_path(collate.choose_best(df), "title") == {"/a": "first", "/b": None, "/c": "x", "/d": "sure"}


def test_to_book_fills_nothing_in(spark):
    row = collate.to_book(results(spark, [("/a", None, 0.0, 0, 0)])).first()
    assert row.title == "" and row.filepath == "/a" and row.authors is None and row.error is None


def test_plan_lookups(spark):
    asked = terms(
        spark, [("/a", 0, "isbn13", A), ("/b", 0, "isbn13", A), ("/b", 1, "isbn13", A), ("/b", 2, "isbn13", B), ("/c", 0, "isbn10", C), ("/c", 1, "isbn10", "x")],
    )
    found = an.response_answers(responses(spark, [("x", 200, body("T")), (B, 429, None)]), "google")
    plan = [tuple(r) for r in lookup.plan_lookups(asked, found, ["google"]).collect()]
    assert plan == [("google", A, 2), ("google", C, 1), ("google", B, 1)]
    assert [tuple(r) for r in lookup.plan_lookups(asked, found, ["google"], 2).collect()] == plan[:2]
    both = [tuple(r) for r in lookup.plan_lookups(asked, found, ["google", "library"]).collect()]
    assert sorted(both) == sorted([*plan, *[("library", i, n) for i, n in ((A, 2), (B, 1), (C, 1), ("x", 1))]])


def test_plan_lookups_without_answers(spark):
    asked = terms(spark, [("/a", 0, "isbn13", A)])
    assert [tuple(r) for r in lookup.plan_lookups(asked, None, ["google"]).collect()] == [("google", A, 1)]


def test_emit_once_takes_a_book_before_a_failure(spark):
    rows = books(spark, {"filepath": "/a", "title": "", "error": "no texts extracted"}, {"filepath": "/a", "title": "Good"})
    assert [(r.title, r.error) for r in incremental.emit_once(rows).collect()] == [("Good", None)]


def test_gather_terms_is_the_same_for_any_number_of_extractors(spark):
    rows = spark.createDataFrame(
        [("/a", [], [], None), ("/a", [], [A], None), ("/a", [], [A], None), ("/b", [], [], "bad")],
        "filepath string, isbn10s array<string>, isbn13s array<string>, error string",
    )
    none = rows.limit(0)
    one, two = (sorted(map(tuple, identify.gather_terms(x).collect())) for x in ([rows], [rows, none]))
    assert one == two == [("/a", [], [A], None), ("/b", [], [], identify.NO_TEXT)]


def test_only_asked_isbns_are_parsed_and_grouped(spark):
    rows = responses(spark, [(A, 200, body("T")), (B, 200, "not read")])
    asked = spark.createDataFrame([(A,)], "isbn string")
    found = an.response_answers(rows, "google", isbns=asked)
    assert [r.isbn for r in found.collect()] == [A]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("from_json") < plan.index("LeftSemi")


# incremental ----------------------------------------------------------------


def test_incremental_operators(spark):
    cache = books(spark, {"filepath": "/a", "error": "no texts extracted"}, {"filepath": "/c", "title": "T", "error": ""})
    files = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "filepath string")
    assert by_path(incremental.drop_failed(cache), "title") == {"/c": "T"}
    assert [r[0] for r in incremental.skip_processed(files, cache).collect()] == ["/b"]
    assert sorted(r[0] for r in incremental.skip_processed(files, incremental.drop_failed(cache)).collect()) == ["/a", "/b"]
    assert incremental.processed_count(cache).first()[0] == 2
    assert by_path(incremental.emit_once(cache.unionByName(cache)), "title") == {"/a": "", "/c": "T"}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_skip_processed_texts_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(incremental, "BROADCAST_BYTES", limit)
    cache = books(spark, {"filepath": "/a"})
    left, fresh = incremental.skip_processed_texts(texts(spark, [("/a", "1"), ("/b", "2"), ("/b", "2")]), cache)
    if fresh is None:
        assert limit and [r.filepath for r in left.collect()] == ["/b", "/b"]
    else:
        assert not limit and [r.filepath for r in fresh.collect()] == ["/b"] and left.count() == 3


# skew -----------------------------------------------------------------------


def test_hot_keys_are_few_and_big(spark):
    counts = spark.createDataFrame([("a", 5000), ("b", 4000), ("c", 10)], "k string, n long")
    assert hot_keys(counts, 9010, min_rows=10_000) is None
    assert {tuple(r) for r in hot_keys(counts, 9010, min_rows=1000).collect()} == {("a", 5), ("b", 4)}
    # however low the floor, a hot key holds more than its share of the total
    assert hot_keys(counts, 50_000_000, min_rows=1).count() == 0


def test_salted_join_deals_a_hot_key_over_tasks(spark):
    many = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v")
    )
    one = spark.createDataFrame([("hot", 1), ("7", 2)], "k string, w int")
    counts = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, 3000, min_rows=100)
    got = salted_left_join(many, one, ["k"], hot, F.col("v"))
    assert rows_of(got) == rows_of(many.join(one, ["k"], "left"))
    # one part per shuffle partition: no table sent whole, no partitions merged
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        salted = salted_left_join(many, one, ["k"], hot, F.col("v")).where("k = 'hot'")
        per_task = salted.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        for k in confs:
            spark.conf.unset(k)
    assert sum(r["count"] for r in per_task) == 1000
    assert max(r["count"] for r in per_task) < 600


@pytest.mark.parametrize("made", [wc.responses, wc.library_responses, wc.catalogue])
def test_what_is_made_of_parts_is_dealt_over_tasks(spark, tmp_path, monkeypatch, made):
    parts = [(k, f"part {k}", "Brand#1", "ECONOMY", k % 50) for k in range(60)] + [(7, None, None, "ECONOMY", None)] * 2
    columns = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    spark.createDataFrame(parts, columns).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    one_task = made(spark, str(tmp_path))
    expected = sorted(map(repr, one_task.collect()))
    monkeypatch.setattr(wc, "TASK_PARTS", 10)
    rows = made(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) > 3
    assert sorted(map(repr, made(spark, str(tmp_path)).collect())) == expected


def test_chunks_are_combined_behind_the_shuffle(spark):
    rows = [("f", 1, "a", (2, 5)), ("f", 1, "a", (1, 9)), ("f", 2, "b", None)]
    matched = spark.createDataFrame(rows, "filepath string, ord int, isbn string, match struct<distance:int,ord:int>")
    nearest = lookup.nearest_over_chunks(matched, ["filepath", "ord"])
    assert sorted((r.ord, r.isbn, r.match and tuple(r.match)) for r in nearest.collect()) == [(1, "a", (1, 9)), (2, "b", None)]
    plan = lookup.nearest_over_chunks(matched, ["filepath", "ord"])._jdf.queryExecution().executedPlan().toString()
    # the root comes first: all aggregation and its sort above the one shuffle
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning") > max(plan.rindex("Aggregate"), plan.rindex("Sort ["))


@pytest.mark.parametrize("dealt", [False, True])
def test_answers_are_never_sent_whole_to_every_task(spark, dealt):
    asked = terms(spark, [("/x/a.pdf", n, "isbn13", A) for n in range(20)] + [("/x/b.pdf", 0, "isbn13", B)])
    found = an.response_answers(responses(spark, [(A, 200, body("a", "b")), (C, 200, body("c"))]), "p")
    counts = asked.groupBy("isbn").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, 21, min_rows=5) if dealt else None
    got = lookup.lookup(asked, found, [("p", "error")], hot=hot)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1
    assert plan.count("BroadcastHashJoin") == (2 if dealt else 0)  # the few hot keys, to both sides
    rows = got.select("filepath", "ord", "failed", "item.title").collect()
    assert sorted(map(tuple, rows)) == [("/x/a.pdf", n, False, "a") for n in range(20)] + [("/x/b.pdf", 0, True, None)]
