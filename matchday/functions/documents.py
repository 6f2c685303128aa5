"""One strict parse of a JSON text into a declared schema.

JSON readers turn a number into text where text is declared, and stop reading after the first value.  Here text leaves are
parsed as variants, whose own type is asked, and the text is parsed as a member of a wrapping object that ends in the text's
digest: whatever follows or closes the text early breaks the wrap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchday.functions.expr import STRICT_JSON

OPTIONS = {**STRICT_JSON, "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}


def _map(kind: T.DataType, leaf) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _map(f.dataType, leaf)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_map(kind.elementType, leaf))
    return leaf(kind)


def _wrong(kind: T.DataType, value: Column) -> Column | None:
    """Whether a text leaf holds something else; null where nothing is there."""
    if isinstance(kind, T.StringType):
        return ~F.schema_of_variant(value).isin("STRING", "VOID")
    if isinstance(kind, T.StructType):
        parts = [p for f in kind.fields if (p := _wrong(f.dataType, value[f.name])) is not None]
        return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts]) if parts else None
    if isinstance(kind, T.ArrayType):
        inner = lambda x: F.coalesce(_wrong(kind.elementType, x), F.lit(False))
        return None if _wrong(kind.elementType, value) is None else F.exists(value, inner)
    return None


def _plain(kind: T.DataType, value: Column) -> Column:
    if isinstance(kind, T.StringType):
        return F.try_variant_get(value, "$", "string")
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_plain(f.dataType, value[f.name]).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _plain(kind.elementType, x))
    return value


def parsed(body: Column, schema: str) -> Column:
    """Struct of the wrapped document and what the wrap needs; see ``valid`` and ``content``."""
    kind = T.StructType.fromDDL(schema)
    loose = _map(kind, lambda leaf: T.VariantType() if isinstance(leaf, T.StringType) else leaf)
    wrap = T.StructType([T.StructField("_corrupt_record", T.StringType()), T.StructField("document", loose), T.StructField("digest", T.StringType())])
    text = F.concat(F.lit('{"document":'), body, F.lit(',"digest":"'), F.md5(body), F.lit('"}'))
    return F.from_json(text, wrap, OPTIONS)


def valid(wrapped: Column, body: Column, schema: str) -> Column:
    """True where the text is one JSON object, whole, and every leaf has the declared type."""
    wrong = _wrong(T.StructType.fromDDL(schema), wrapped["document"])
    fine = wrapped["_corrupt_record"].isNull() & (wrapped["digest"] == F.md5(body)) & wrapped["document"].isNotNull()
    return F.coalesce(fine & (F.lit(True) if wrong is None else ~wrong), F.lit(False))


def content(wrapped: Column, schema: str) -> Column:
    """The document with plain leaves."""
    return _plain(T.StructType.fromDDL(schema), wrapped["document"])
