import pytest
from pyspark.sql import functions as F

from colophon import Provider
from colophon.operators import collate, identify
from colophon.schemas import BOOK
from colophon.streaming import paths
from colophon.streaming.incremental import earlier_books, identify_stream, read_output
from tests.helpers import RESPONSES, TEXTS, body, by_path, responses, texts

A, B = "9781718501263", "9781718501270"


@pytest.fixture
def stream(spark, tmp_path):
    provider = Provider("google", responses(spark, [(A, 200, body("T"))]))
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run(rows, providers=(provider,), **options):
        texts(spark, rows).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(TEXTS).parquet(source)
        identify_stream(arriving, list(providers), out, state, **options).awaitTermination()
        return read_output(spark, out)

    return run


def test_files_are_written_once(stream):
    first = stream([("/a.txt", f"ISBN {A}"), ("/b.txt", ""), ("/c.txt", f"ISBN {B}"), ("/d.xyz", f"ISBN {A}")])
    wanted = {"/a.txt": (0, None), "/b.txt": (0, identify.NO_TEXT), "/c.txt": (0, collate.NO_RESULTS)}
    assert by_path(first, "batch", "error") == wanted
    second = stream([("/a.txt", "changed"), ("/e.txt", f"ISBN {A}"), ("/e.txt", f"ISBN {A}")])
    assert by_path(second, "batch", "error") == {**wanted, "/e.txt": (1, None)}
    seen = []
    third = stream([("/a.txt", "again")], on_batch=lambda i, counts: seen.append((i, counts["files"])))
    assert seen == [(2, 0)]
    assert by_path(third, "batch", "error") == {**wanted, "/e.txt": (1, None)}


def test_a_repeated_batch_replaces_itself(spark, tmp_path, stream):
    stream([("/a.txt", f"ISBN {A}")])
    before = by_path(stream([("/b.txt", f"ISBN {A}")]), "batch", "title")
    # the last batch was written, but its end was not recorded
    commit = tmp_path / "state" / "commits" / "1"
    commit.unlink()
    commit.with_name(".1.crc").unlink(missing_ok=True)
    after = by_path(stream([("/c.txt", f"ISBN {A}")]), "batch", "title")
    assert after == {**before, "/c.txt": (2, "T")}


def test_a_batch_reads_only_what_may_hold_its_paths(spark, tmp_path):
    """After many batches: rows read follow the batch, not the output."""
    out = str(tmp_path / "out")
    rows = spark.range(20 * 200).selectExpr("concat('/f', id, '.txt') filepath", "cast(id % 20 as int) batch")
    books = rows.withColumn("bucket", paths.bucket_of(F.col("filepath")))
    books = books.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in BOOK if f.name != "filepath"], "filepath", "batch", "bucket")
    books.write.partitionBy("batch", "bucket").parquet(out)
    for n in range(20):
        paths.filters_of(rows.where(f"batch = {n}")).write.parquet(f"{out}/{paths.FOLDER}/batch={n}")
    new = spark.createDataFrame([(f"/new{i}.txt",) for i in range(50)], "filepath string")
    again = spark.createDataFrame([("/f7.txt",), ("/f2003.txt",)], "filepath string")
    assert earlier_books(new, out, 20).count() == 0
    assert len(paths.places_of(new, out, 20)) <= 2  # of 20 * 64 folders
    found = earlier_books(new.union(again), out, 20)
    assert {(r.filepath, r.batch) for r in found.collect()} == {("/f7.txt", 7), ("/f2003.txt", 3)}
    read = spark.read.parquet(*paths.places_of(new.union(again), out, 20)).count()
    assert 2 <= read <= 50 < books.count() / 50
    # batches from the asking one on are left out; a batch without filters is read whole
    assert {r.batch for r in earlier_books(again, out, 7).collect()} == {3}
    spark.createDataFrame([], "filepath string, bucket int").write.parquet(f"{out}/batch=20")
    assert f"{out}/batch=20" in paths.places_of(again, out, 21)


def test_filters_have_no_false_denial(spark):
    rows = spark.range(30_000).selectExpr("concat('/x/', id) filepath")
    held = paths.filters_of(rows, buckets=3).withColumn("batch", F.lit(0).cast("long")).cache()
    assert {r.n for r in held.collect()} and held.agg(F.sum("n")).first()[0] == 30_000
    for one in ("/x/0", "/x/29999", "/x/777"):
        asked = spark.createDataFrame([(one,)], "filepath string")
        assert paths.folders_with(asked, held, buckets=3).count() == 1
    others = [paths.folders_with(spark.createDataFrame([(f"/y/{i}",)], "filepath string"), held, 3).count() for i in range(5)]
    assert sum(others) == 0


def test_tables_of_a_batch_go_with_it(spark, stream):
    from pathlib import Path

    from colophon.sources.shared import shared_dir

    place = Path(shared_dir(spark)) / spark.sparkContext.applicationId
    before = set(place.glob("*")) if place.exists() else set()
    stream([("/a.txt", f"ISBN {A}")])
    stream([("/b.txt", f"ISBN {A}"), ("/a.txt", "x")])
    assert set(place.glob("*")) <= before


def test_provider_function_is_asked_per_batch(spark, stream):
    asked = []

    def ask(isbns):
        asked.append([r.isbn for r in isbns.collect()])
        return spark.createDataFrame([(A, 200, body("T"))], RESPONSES)

    provider = Provider("google", ask)
    stream([("/a.txt", f"ISBN {A}")], [provider])
    stream([("/b.txt", f"ISBN {A}")], [provider])
    assert asked == [[A], [A]]
