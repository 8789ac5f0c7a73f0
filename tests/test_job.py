import pytest

from colophon.__main__ import parse, run
from colophon.operators import collate, identify
from colophon.sources.books import read_books
from tests.helpers import VOLUMES, body, by_path

A, B = "9781718501263", "9781718501270"


def test_runs(spark, tmp_path):
    root = tmp_path / "books"
    root.mkdir()
    (root / "a.txt").write_text(f"ISBN {A}")
    (root / "b.txt").write_text(f"ISBN {B}")
    (root / "c.pdf").write_text("%PDF")
    schema = "provider string, isbn string, status int, body string"
    spark.createDataFrame([("google", A, 200, body("T"))], schema).write.json(str(tmp_path / "r1"))
    spark.createDataFrame([("google", A, 200, body("T")), ("google", B, 200, body("U"))], schema).write.json(str(tmp_path / "r2"))

    def job(out, *argv):
        run(spark, parse(["--scan", str(root), "--output", str(tmp_path / out), *argv]))
        got = by_path(read_books(spark, str(tmp_path / out)), "title", "error")
        return {p.removeprefix(f"{root}/"): v for p, v in got.items()}

    first = {"a.txt": ("T", None), "b.txt": ("", collate.NO_RESULTS), "c.pdf": ("", identify.NO_TEXT)}
    r1, r2 = ("--responses", str(tmp_path / "r1")), ("--responses", str(tmp_path / "r2"))
    assert job("o1", *r1, "--requests", str(tmp_path / "plan"), "--budget", "5") == first
    assert [r.isbn for r in spark.read.json(str(tmp_path / "plan")).collect()] == [B]
    cached = ("--cache", str(tmp_path / "o1"))
    assert job("o2", *r2, *cached) == first
    assert job("o3", *r2, *cached, "--retry") == {**first, "b.txt": ("U", None)}
    # a dry run reads no responses, and plans all that it would ask for
    nowhere = ("--responses", str(tmp_path / "nowhere.json"))
    spark.createDataFrame([("google", "x", 200, "unread")], schema).write.json(nowhere[1])
    assert job("o4", *nowhere, "--dry-run", "--requests", str(tmp_path / "all")) == {"c.pdf": first["c.pdf"]}
    assert {r.isbn for r in spark.read.json(str(tmp_path / "all")).collect()} == {A, B}
    volumes = [(1, "V", ["x"], [("ISBN_13", A)], "2001")]
    spark.createDataFrame(volumes, VOLUMES).write.parquet(str(tmp_path / "volumes"))
    assert job("o6", "--catalogue", str(tmp_path / "volumes"), "--strict-length", "--distance", "compat")["a.txt"] == ("V", None)
    assert job("o5", *r1, "--compat") == {k: first[k] for k in ("a.txt", "c.pdf")}
    with pytest.raises(SystemExit):
        parse(["--scan", str(root), "--output", "x", *r1, "--retry"])
