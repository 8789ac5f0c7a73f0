import json
import random
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from colophon import Provider, scan
from colophon.functions.records import book_json
from colophon.operators import identify
from colophon.operators.incremental import drop_failed, emit_once, skip_processed
from colophon.sources import books as io
from colophon.sources import files as src
from colophon.sources.json_object import object_entries
from colophon.sources.shared import materialize, shared_dir
from tests.helpers import body, books, by_path, plan_of, responses, rows_of

A = "9781718501263"


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "lib"
    (root / "deep" / "er").mkdir(parents=True)
    (root / "a.txt").write_text(f"ISBN {A}")
    (root / "deep" / "b c.html").write_text(f"<p>ISBN&nbsp;{A}</p>")
    (root / "deep" / "er" / "d.pdf").write_bytes(b"%PDF")
    (root / "deep" / "e.TXT").write_text("no")
    (root / "f.xyz").write_text("no")
    (root / "g.rst").write_bytes(b"ISBN \xff 9781718501263")
    return root


def test_scan_files(spark, library):
    files = src.scan_files(spark, str(library))
    names = {p.removeprefix(str(library)): n for p, n in by_path(files, "length").items()}
    assert names == {"/a.txt": 18, "/deep/b c.html": 30, "/deep/er/d.pdf": 4, "/g.rst": 20}
    twice = src.scan_files(spark, [str(library), str(library / "deep")])
    assert twice.count() == 4
    assert "content" not in plan_of(files)


def test_native_text(spark, library):
    got = by_path(src.extract_files(spark, str(library))[0], "text", "error")
    assert got[f"{library}/a.txt"] == (f"ISBN {A}", None)
    assert got[f"{library}/deep/b c.html"][0].split() == ["ISBN", A]
    assert got[f"{library}/g.rst"] == (f"ISBN � {A}", None)
    assert got[f"{library}/deep/er/d.pdf"][0] is None and got[f"{library}/deep/er/d.pdf"][1]
    with pytest.raises(ValueError):
        src.extract_files(spark, str(library), extractors=[])


def test_only_new_files_are_read(spark, library):
    cache = books(spark, {"filepath": f"{library}/a.txt"}, {"filepath": f"{library}/g.rst"})
    contents = src.read_contents(spark, str(library), cache)
    assert set(by_path(contents, "content")) == {f"{library}/deep/b c.html", f"{library}/deep/er/d.pdf"}
    done = cache.unionByName(books(spark, *[{"filepath": f"{library}/deep/{n}"} for n in ("b c.html", "er/d.pdf")]))
    assert src.read_contents(spark, str(library), done).count() == 0


def test_known_files_are_not_opened(spark, library):
    (library / "gone.txt").write_text("x")
    cache = books(spark, {"filepath": f"{library}/gone.txt"})
    contents = src.read_contents(spark, str(library), cache)
    (library / "gone.txt").unlink()  # opening it would fail now
    assert contents.count() == 4


def test_hidden_names_are_in_and_links_are_out(spark, library, tmp_path):
    (library / "_hid").mkdir()
    for name in ("_c.txt", ".d.txt", "_hid/.e.txt"):
        (library / name).write_text(f"ISBN {A}")
    (library / "link.txt").symlink_to(library / "a.txt")
    (library / "linked").symlink_to(library / "deep")
    (library / "empty").mkdir()
    found = {p.removeprefix(str(library)) for p in by_path(src.scan_files(spark, str(library)), "length")}
    assert found == {"/a.txt", "/deep/b c.html", "/deep/er/d.pdf", "/g.rst", "/_c.txt", "/.d.txt", "/_hid/.e.txt"}
    assert src.scan_files(spark, f"file://{library}").count() == len(found)
    texts = by_path(src.extract_files(spark, str(library))[0], "text")
    assert texts[f"{library}/_hid/.e.txt"] == f"ISBN {A}"


def test_roots(spark, library, tmp_path, monkeypatch):
    """A relative root gives absolute paths; a missing one is refused at once."""
    monkeypatch.chdir(tmp_path)
    (tmp_path / "shelf" / "in").mkdir(parents=True)
    (tmp_path / "shelf" / "in" / "a.txt").write_text("x")
    want = [str(tmp_path / "shelf" / "in" / "a.txt")]
    for root in ("shelf", "./shelf/in", str(tmp_path / "shelf"), f"file://{tmp_path}/shelf", "shelf/in/a.txt"):
        assert [r.filepath for r in src.scan_files(spark, root).collect()] == want
    for root in ("nowhere", f"file://{tmp_path}/nowhere"):
        with pytest.raises(FileNotFoundError, match="nowhere"):
            src.scan_files(spark, root)


def test_files_that_cannot_be_read_fail_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src, "FILE_BYTES", 10)
    (tmp_path / "a.txt").write_text("short")
    (tmp_path / "b.txt").write_text("much too long")
    (read,) = src.extract_files(spark, str(tmp_path))
    assert {r.filepath[-5:]: (r.text, r.error) for r in read.collect()} == {
        "a.txt": ("short", None), "b.txt": (None, src.UNREADABLE)
    }


def test_texts_are_written_one_file_a_folder(spark, tmp_path):
    rows = [("page_id=1", "<p>\u00e9"), (".kept/page_id=7", None), ("page_id=1", "<p>\u00e9"), ("page_id=2", "")]
    root = tmp_path / "out"
    assert src.write_texts(spark.createDataFrame(rows, "folder string, text string"), str(root)) == 3
    # nothing else lies there: no sums, no marks, no unfinished files
    found = {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}
    assert found == {
        "page_id=1/part-0.txt": "<p>\u00e9\n<p>\u00e9\n", ".kept/page_id=7/part-0.txt": "\n", "page_id=2/part-0.txt": "\n"
    }
    assert len(by_path(src.extract_files(spark, str(root))[0], "text")) == 3


def test_no_texts_are_an_empty_folder(spark, tmp_path):
    assert src.write_texts(spark.createDataFrame([], "folder string, text string"), f"file://{tmp_path}/none") == 0
    assert src.scan_files(spark, f"{tmp_path}/none").count() == 0


def test_names_with_wildcards(spark, library):
    (library / "h[1]{x}*.txt").write_text("x")
    cache = books(spark, *[{"filepath": f"{library}/{n}"} for n in ("a.txt", "g.rst", "deep/b c.html", "deep/er/d.pdf")])
    assert set(by_path(src.read_contents(spark, str(library), cache), "content")) == {f"{library}/h[1]{{x}}*.txt"}


def test_directory_to_books(spark, library, tmp_path):
    provider = Provider("google", responses(spark, [(A, 200, body("T"))]))
    out = str(tmp_path / "books")
    first = scan(src.extract_files(spark, str(library)), [provider]).books()
    io.write_books(first, out)
    assert set(by_path(io.read_books(spark, out), "error").values()) == {None, identify.NO_TEXT}
    (library / "new.txt").write_text(f"ISBN {A}")
    cache = io.read_books(spark, out)
    second = scan(src.extract_files(spark, str(library), cache=cache), [provider], cache=cache)
    assert list(by_path(second.outcomes, "status")) == [f"{library}/new.txt"]
    assert second.books().count() == 5


# books ----------------------------------------------------------------------


@pytest.fixture
def shelf(spark):
    return books(
        spark,
        {"filepath": "/b/plain.pdf", "title": "T", "authors": ["x", "y"], "isbn13": A},
        {"filepath": '/b/quo"te\\{1}.pdf', "title": '},"/ \\"},', "authors": ['},"/']},
        {"filepath": "/b/fail.pdf", "error": "no texts extracted"},
        {"filepath": "/b/brace}.pdf", "title": "}\n}"},
    )


@pytest.fixture
def stores(spark):
    paths = ["/b/a.pdf", "hdfs://nn/b/a.pdf", "s3a://b/q\"x.pdf", "/b/a.pdf", "relative,}.pdf"]
    return books(spark, *[{"filepath": p, "title": "T},"} for i, p in enumerate(paths)])


def test_object_keys_of_any_store(spark, stores, tmp_path):
    path = str(tmp_path / "out")
    io.write_books(stores.repartition(3), path, layout="object")
    document = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))))
    assert set(document) == {r.filepath for r in stores.collect()}
    assert as_json(io.read_books(spark, path, layout="object")) == as_json(stores)


@pytest.mark.parametrize("bad", ['{"/a": {"title": 1,"/b": {"title":"x","filepath":"/b"},"/c": {"title":"y","filepath":"/c"}}', '{"/a": {"filepath":"/a"}, "/b": {"title":"/b"}}', '{"/a": 5, "/b": {"filepath":"/b"}}'])
def test_unreadable_records_fail_the_run(spark, tmp_path, bad):
    (tmp_path / "books.json").write_text(bad)
    with pytest.raises(ValueError):
        io.read_books(spark, str(tmp_path / "books.json"), layout="object")


def as_json(df):
    return rows_of(df.select("filepath", book_json().alias("j")))


@pytest.mark.parametrize("layout", ["lines", "parquet", "object"])
def test_round_trip(spark, shelf, tmp_path, layout):
    path = str(tmp_path / "out")
    io.write_books(shelf, path, layout=layout)
    assert as_json(io.read_books(spark, path, layout=layout)) == as_json(shelf)
    with pytest.raises(AnalysisException):
        io.write_books(shelf, path, layout=layout)


def test_bucketed_cache_is_not_shuffled(spark, shelf, tmp_path):
    """Its side of J1, of a scan's skipping and of a retry has no exchange, whatever the partitions are."""
    path = str(tmp_path / "shelf")
    io.write_books(shelf, path, "buckets")
    with pytest.raises(ValueError, match="exists"):
        io.write_books(shelf, path, "buckets")
    cache = io.read_books(spark, path, "buckets")
    assert rows_of(cache) == rows_of(shelf)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("books_")]
    new = spark.range(1000).selectExpr("concat('/n', id, '.txt') filepath", "'x' text").unionByName(
        shelf.selectExpr("filepath", "'y' text"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        for partitions in (4, 200):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            for books in (cache, drop_failed(cache), emit_once(cache)):
                joined = skip_processed(new.select("filepath"), books).distinct()
                plan = plan_of(joined).split("(1)")[0]
                assert plan.count("Exchange") == 1 and plan.count("Sort ") <= 1, plan
                held = {r.filepath for r in books.select("filepath").collect()}
                assert {r.filepath for r in joined.collect()} == {r.filepath for r in new.select("filepath").collect()} - held
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_object_parts_are_one_document(spark, shelf, tmp_path):
    path = tmp_path / "out"
    io.write_books(shelf.repartition(4), str(path), layout="object")
    document = b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))
    parsed = json.loads(document)
    assert set(parsed) == {r.filepath for r in shelf.collect()}
    assert parsed["/b/plain.pdf"] == {"title": "T", "authors": ["x", "y"], "isbn13": A, "filepath": "/b/plain.pdf"}
    assert parsed["/b/fail.pdf"] == {"title": "", "filepath": "/b/fail.pdf", "error": "no texts extracted"}


def test_object_is_written_by_all_tasks_or_not_at_all(spark, tmp_path):
    many = spark.range(0, 3000, 1, 6).selectExpr("concat('/b/', id % 1500, '.pdf') filepath", "'T' title")
    path = tmp_path / "out"
    io.write_books(books(spark, {"filepath": "/x"}).limit(0).unionByName(many, allowMissingColumns=True), str(path), "object")
    parts = [p.read_text() for p in sorted(path.glob("part-*"))]
    assert len([p for p in parts if len(p) > 1000]) >= 2
    pairs = json.loads("".join(parts), object_pairs_hook=list)
    assert len(pairs) == 3000 and len({k for k, _ in pairs}) == 1500
    failing = many.withColumn("title", F.when(F.col("filepath") == "/b/1499.pdf", F.raise_error(F.lit("no"))).otherwise("T"))
    with pytest.raises(Exception, match="no"):
        io.write_books(books(spark, {"filepath": "/x"}).unionByName(failing, allowMissingColumns=True), str(tmp_path / "none"), "object")
    assert not (tmp_path / "none").exists()


def test_empty_object(spark, shelf, tmp_path):
    path = tmp_path / "out"
    io.write_books(shelf.limit(0), str(path), layout="object")
    assert json.loads(b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))) == {}
    assert io.read_books(spark, str(path), layout="object").count() == 0


def test_earlier_tools_output_is_split(spark, tmp_path):
    """One line, no final newline, keys as they are; cut into many splits."""
    entries = {f"/b/{i}.pdf": {"title": f"T{i}", "authors": ["a,}", "b"], "filepath": f"/b/{i}.pdf"} for i in range(5000)}
    text = "{" + ",".join(f'"{k}": {json.dumps(v)}' for k, v in entries.items()) + "}"
    (tmp_path / "books.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        read = io.read_books(spark, str(tmp_path / "books.json"), layout="object")
        assert read.select(F.spark_partition_id()).distinct().count() > 3
        assert by_path(read, "title") == {k: v["title"] for k, v in entries.items()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_unfinished_output(spark, tmp_path):
    text = '{"/b/a.pdf": {"title":"A","filepath":"/b/a.pdf"},"/b/b.pdf": {"title":"B","filepath":"/b/b.pdf"}'
    (tmp_path / "no-brace.json").write_text(text)
    (tmp_path / "cut.json").write_text(text[:-20])
    assert by_path(io.read_books(spark, str(tmp_path / "no-brace.json"), "object"), "title") == {"/b/a.pdf": "A", "/b/b.pdf": "B"}
    assert by_path(io.read_books(spark, str(tmp_path / "cut.json"), "object"), "title") == {"/b/a.pdf": "A"}


def test_reformatted_object(spark, tmp_path):
    entries = {"a.pdf": {"title": "A", "filepath": "a.pdf"}, "/b/c.pdf": {"title": "", "filepath": "/b/c.pdf", "error": "e"}}
    for k, (indent, separators) in enumerate(((2, None), ("\t", (" ,", " : ")), (None, None))):
        path = tmp_path / f"books{k}.json"
        path.write_text(json.dumps(entries, indent=indent, separators=separators))
        read = io.read_books(spark, str(path), "object")
        assert by_path(read, "error") == {"a.pdf": None, "/b/c.pdf": "e"}


def random_object(rng, n):
    """Keys and nested values full of signs that only count outside of strings."""

    def text():
        return "".join(rng.choice('\\\\"{}[],: \nax\u00e9') for _ in range(rng.randrange(9)))

    def value(deep):
        kind = rng.randrange(4 if deep else 2)
        if kind < 2:
            return text() if kind else rng.randrange(99)
        return [value(deep - 1) for _ in range(3)] if kind == 2 else {text(): value(deep - 1) for _ in range(3)}

    return {f"{i}{text()}": value(3) for i in range(n)}


def test_entries_for_every_cut(spark, tmp_path):
    """Blocks of a few bytes, groups of three: the entries are those of the whole text."""
    rng = random.Random(4)
    want = {}
    for k in range(40):
        made = random_object(rng, rng.randrange(7))
        written = json.dumps(made, indent=rng.choice([None, 1, 4]), ensure_ascii=rng.random() < 0.5)
        (tmp_path / f"{k}.json").write_text(written, encoding="utf-8")
        want[f"{k}.json"] = made
    for block in (1, 3, 8, 1 << 20):
        got = {k: {} for k in want}
        for r in object_entries(spark, str(tmp_path), block, 3).collect():
            assert r.done
            got[Path(r.file).name].update(json.loads(b"{" + r.value + b"}"))
        assert got == want


def test_entries_of_a_file_cut_anywhere(spark, tmp_path):
    """Whole entries before the cut are found, nothing behind it is called done."""
    whole = json.dumps({"a": {"x": "}" + 2 * chr(92)}, "b,": {"y": [chr(34), {}]}, "c": {}})
    for k in range(1, len(whole)):
        (tmp_path / f"{k:03}.json").write_text(whole[:k])
    got = {k: [] for k in range(1, len(whole))}
    for r in object_entries(spark, str(tmp_path), 7, 3).where("done and trim(string(value)) != ''").collect():
        got[int(Path(r.file).stem)].append(json.loads(b"{" + r.value + b"}"))
    ends = [k for k in range(1, len(whole)) if _top(whole[:k])]
    assert len(ends) == 3
    assert {k: len(found) for k, found in got.items()} == {k: sum(e <= k for e in ends) for k in got}


def _top(text):
    """Does the text end with the end of an entry's value?"""
    try:
        return text.endswith("}") and isinstance(json.loads(text + "}"), dict)
    except ValueError:
        return False


def test_responses_and_writers(spark, tmp_path, shelf):
    rows = spark.createDataFrame([("google", A, 200, body("T"))], "provider string, isbn string, status int, body string")
    rows.write.json(str(tmp_path / "r"))
    assert rows_of(io.read_responses(spark, str(tmp_path / "r"))) == rows_of(rows)
    seen = []
    io.write_with(shelf, seen.append)
    assert seen == [shelf]
    for wrong in (io.write_books, lambda df, path, layout: io.read_books(spark, path, layout)):
        with pytest.raises(ValueError):
            wrong(shelf, str(tmp_path / "x"), layout="csv")


def test_shared_tables(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df, seen = materialize(spark.range(10), "numbers", top=F.max("id"))
    assert seen == {"top": 9} and df.count() == 10
    assert shared_dir(spark) in df.inputFiles()[0]
