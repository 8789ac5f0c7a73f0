"""Schemas of the tables that flow between the operators."""

from pyspark.sql import types as T

_STR = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


BOOK = _struct(
    title=_STR,
    authors=T.ArrayType(_STR),
    isbn10=_STR,
    isbn13=_STR,
    uom=_STR,
    low_year=T.LongType(),
    high_year=T.LongType(),
    publish_date=_STR,
    publisher=_STR,
    filepath=_STR,
    error=_STR,
)

RESULT = _struct(
    filepath=_STR,
    title=_STR,
    authors=T.ArrayType(_STR),
    isbn10=_STR,
    isbn13=_STR,
    uom=_STR,
    low_year=T.LongType(),
    high_year=T.LongType(),
    publish_date=_STR,
    publisher=_STR,
    confidence=T.DoubleType(),
    source_provider_name=_STR,
    provider_ord=T.IntegerType(),
    ord=T.IntegerType(),
)

RESPONSE = _struct(provider=_STR, isbn=_STR, status=T.IntegerType(), body=_STR)

IDENTIFIER = _struct(type=_STR, identifier=_STR)

VOLUME_INFO = _struct(
    title=_STR,
    authors=T.ArrayType(_STR),
    industryIdentifiers=T.ArrayType(IDENTIFIER),
    publishedDate=_STR,
)

# `_corrupt` is filled by from_json when the body is not the expected JSON.
RESPONSE_BODY = _struct(
    totalItems=T.LongType(),
    items=T.ArrayType(_struct(volumeInfo=VOLUME_INFO)),
    _corrupt=_STR,
)

# One work of a provider's answer, with its place in the answer.
ITEM = _struct(
    ord=T.LongType(),
    title=_STR,
    authors=T.ArrayType(_STR),
    isbn10=_STR,
    isbn13=_STR,
    uom=_STR,
    publish_date=_STR,
)

# A provider's answer to one ISBN. `chunk` is 0, except for catalogue ISBNs
# that carry so many titles that their items are kept in several rows.
ANSWER = _struct(
    provider_ord=T.IntegerType(),
    provider=_STR,
    isbn=_STR,
    failed=T.BooleanType(),
    error=_STR,
    confidence=T.DoubleType(),
    chunk=T.IntegerType(),
    items=T.ArrayType(ITEM),
)
