"""A book corpus that Spark derives from the TPC-H-like tables.

Every part is a volume with an ISBN-10 and an ISBN-13, every order is a file
whose text names the ISBNs of its line items. All rows of the tables are used;
the remainders below only vary the shape of a row (file type, text length,
separator, response status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text length of a complete file; shorter texts count as not extracted.
FULL_TEXT = 600

# Parts whose volumes one task makes into responses or a catalogue, about.
TASK_PARTS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digit(position: int) -> str:
    return f"cast(substr(b12,{position},1) as int)"


_C13 = "+".join(f"{1 if i % 2 else 3}*{_digit(i)}" for i in range(1, 13))
_C10 = "+".join(f"{10 - i}*{_digit(i + 4)}" for i in range(9))

# Valid for Spark and DuckDB alike.
VOLUMES_SQL = f"""
select p_partkey, p_name as title, p_brand, p_type, p_size,
       b12 || cast((10-({_C13})%10)%10 as varchar(2)) as isbn13,
       substr(b12,4,9) || case when (11-({_C10})%11)%11=10 then 'X'
                               else cast((11-({_C10})%11)%11 as varchar(2)) end as isbn10,
       case when p_partkey%41=0 then 429 when p_partkey%43=0 then 500 else 200 end as status,
       case when p_partkey%17=0 then 0 else 2 end as total_items
from (select p_partkey, p_name, p_brand, p_type, p_size,
             '978'||lpad(cast(p_partkey as varchar(20)),9,'0') as b12 from part)
"""

LINES_SQL = """
select l_orderkey, l_linenumber, l_partkey, l_returnflag,
       case when l_partkey%3=0 then isbn10 else isbn13 end as isbn
from lineitem join volumes on l_partkey=p_partkey
"""

CORPUS_SQL = f"""
select o_orderkey, o_orderstatus, o_orderpriority,
       '/corpus/'||cast(o_orderkey as varchar(20))||case o_orderkey%13 when 0 then '.PDF' when 1 then '.xyz'
           when 2 then '.epub' when 3 then '.txt' when 4 then '.html' else '.pdf' end as filepath,
       case when o_orderkey%5=0 then 'Copyright. '||coalesce(terms,'')
            else rpad('Copyright. '||coalesce(terms,''), {FULL_TEXT}, '.') end as text
from orders left join terms on o_orderkey=l_orderkey
"""


def page_files(spark: SparkSession, sf_dir: str, hidden: Column | None = None) -> DataFrame:
    """``(folder, text)``: the pages, each in a folder of its own; ``hidden`` ones below a hidden folder."""
    folder = F.concat(F.lit("page_id="), F.coalesce(F.col("page_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    if hidden is not None:
        folder = F.when(hidden, F.concat(F.lit(".kept/"), folder)).when(~hidden, folder)
    rows = table(spark, sf_dir, "pages").select(folder.alias("folder"), F.col("html").alias("text"))
    return rows.where(F.col("folder").isNotNull())


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VOLUMES_SQL.replace("from part", "from {part}"), part=table(spark, sf_dir, "part"))


def _dealt_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volumes, dealt over tasks by their number.

    The table of parts is a few bytes a row, so one task reads millions of them, and what is
    made of a part is a hundred times its size.
    """
    number = table(spark, sf_dir, "part").count() // TASK_PARTS + 1
    rows = volumes(spark, sf_dir)
    return rows if number == 1 else rows.repartition(number, "p_partkey")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = LINES_SQL.replace("from lineitem join volumes", "from {lineitem} join {volumes}")
    return spark.sql(sql, lineitem=table(spark, sf_dir, "lineitem"), volumes=volumes(spark, sf_dir))


def _terms(lines: DataFrame, separator) -> DataFrame:
    """The ISBNs of each order as one string, in line order."""
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "isbn")))
    return (
        lines.groupBy("l_orderkey")
        .agg(F.transform(ordered, lambda x: x["isbn"]).alias("isbns"))
        .select("l_orderkey", F.call_function("array_join", "isbns", separator).alias("terms"))
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, o_orderstatus, o_orderpriority, filepath, text``."""
    separator = F.when(F.col("l_orderkey") % 7 == 0, " ").otherwise(" | ")
    terms = _terms(_lines(spark, sf_dir), separator)
    sql = CORPUS_SQL.replace("from orders left join terms", "from {orders} left join {terms}")
    return spark.sql(sql, orders=table(spark, sf_dir, "orders"), terms=terms)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("filepath", "text")


def returned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second extractor: it reads only files with returned line items."""
    returned = _lines(spark, sf_dir).where(F.col("l_returnflag") == "R")
    terms = _terms(returned, F.lit("; ")).withColumnRenamed("terms", "text")
    files = corpus(spark, sf_dir).select("o_orderkey", "filepath")
    return files.join(terms, files.o_orderkey == terms.l_orderkey).select("filepath", "text")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers of a web provider: one row per ISBN, two works per answer."""
    identifiers = F.array(
        F.struct(F.lit("ISBN_10").alias("type"), F.col("isbn10").alias("identifier")),
        F.struct(F.lit("ISBN_13").alias("type"), F.col("isbn13").alias("identifier")),
    )

    def work(title, ids):
        return F.struct(
            F.struct(
                title.alias("title"),
                F.array("p_brand").alias("authors"),
                ids.alias("industryIdentifiers"),
                F.lit("1998").alias("publishedDate"),
            ).alias("volumeInfo")
        )

    works = F.array(
        work(F.concat("title", F.lit(" guide")), F.slice(identifiers, 1, 0)),
        work(F.col("title"), identifiers),
    )
    body = F.to_json(
        F.struct(
            F.col("total_items").alias("totalItems"),
            F.when(F.col("total_items") > 0, works).alias("items"),
        )
    )
    return _dealt_volumes(spark, sf_dir).select(
        F.lit("google").alias("provider"),
        F.explode(F.array("isbn10", "isbn13")).alias("isbn"),
        "status",
        F.when(F.col("status") == 200, body).alias("body"),
    )


def library_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second provider that knows only ECONOMY parts and fails on large ones."""
    return (
        _dealt_volumes(spark, sf_dir)
        .where(F.col("p_type") == "ECONOMY")
        .select(
            F.lit("library").alias("provider"),
            F.explode(F.array("isbn10", "isbn13")).alias("isbn"),
            F.when(F.col("p_size") > 48, 503).otherwise(200).alias("status"),
            F.to_json(
                F.struct(
                    F.lit(1).alias("totalItems"),
                    F.array(
                        F.struct(
                            F.struct(F.concat(F.lit("Library "), "title").alias("title")).alias(
                                "volumeInfo"
                            )
                        )
                    ).alias("items"),
                )
            ).alias("body"),
        )
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of volumes; each ISBN is carried by two editions."""
    v = _dealt_volumes(spark, sf_dir)
    identifiers = F.array(
        F.struct(F.lit("isbn_10").alias("type"), F.col("isbn10").alias("identifier")),
        F.struct(F.lit("ISBN_13").alias("type"), F.col("isbn13").alias("identifier")),
    )
    titles = F.array("title", F.concat_ws(" ", "title", "p_type"))
    return v.select(
        "p_partkey", F.posexplode(titles).alias("edition", "title"),
        identifiers.alias("identifiers"), "p_brand",
    ).select(
        (F.col("p_partkey") * 2 + F.col("edition")).alias("ord"),
        "title",
        F.array("p_brand").alias("authors"),
        "identifiers",
        F.lit(None).cast("string").alias("publish_date"),
    )


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of an earlier run: the finished orders, urgent ones had failed."""
    failed = F.col("o_orderpriority") == "1-URGENT"
    text = F.lit(None).cast("string")
    return (
        corpus(spark, sf_dir)
        .where(F.col("o_orderstatus") == "F")
        .select(
            F.when(failed, "").otherwise("Cached").alias("title"),
            F.lit(None).cast("array<string>").alias("authors"),
            text.alias("isbn10"),
            text.alias("isbn13"),
            text.alias("uom"),
            F.lit(None).cast("bigint").alias("low_year"),
            F.lit(None).cast("bigint").alias("high_year"),
            text.alias("publish_date"),
            text.alias("publisher"),
            "filepath",
            F.when(failed, "no texts extracted").alias("error"),
        )
    )
