import json

from pyspark.sql import functions as F

TEXTS = "filepath string, text string"
RESPONSES = "isbn string, status int, body string"
VOLUMES = (
    "ord bigint, title string, authors array<string>, "
    "identifiers array<struct<type string, identifier string>>, publish_date string"
)
BOOKS = (
    "title string, authors array<string>, isbn10 string, isbn13 string, uom string, low_year bigint, "
    "high_year bigint, publish_date string, publisher string, filepath string, error string"
)


def body(*titles, total=None, **ids):
    items = [
        {
            "volumeInfo": {
                "title": t,
                "authors": [f"by {t}"],
                "industryIdentifiers": [{"type": k.upper(), "identifier": v} for k, v in ids.items()],
                "publishedDate": "2001",
            }
        }
        for t in titles
    ]
    return json.dumps({"totalItems": len(titles) if total is None else total, "items": items})


def texts(spark, rows):
    return spark.createDataFrame(rows, TEXTS)


def responses(spark, rows):
    return spark.createDataFrame(rows, RESPONSES)


def books(spark, *rows):
    full = [
        (r.get("title", ""), r.get("authors"), r.get("isbn10"), r.get("isbn13"), None, None, None, None, None,
         r["filepath"], r.get("error"))
        for r in rows
    ]
    return spark.createDataFrame(full, BOOKS)


def by_path(df, *columns):
    """{filepath: row values}; each path must come once."""
    rows = df.select("filepath", *columns).collect()
    got = {r[0]: tuple(r[1:]) if len(columns) > 1 else r[1] for r in rows}
    assert len(got) == len(rows), "a path came twice"
    return got


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(map(repr, df.select(*columns).collect()))


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def count(df):
    return df.agg(F.count(F.lit(1))).first()[0]
