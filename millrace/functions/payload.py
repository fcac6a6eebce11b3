"""Access to schemaless records held as ``map<string, variant>``.

A missing key gives SQL NULL while a key holding JSON null gives a non-NULL variant. ``coalesce``
over map lookups therefore picks the first key that is *present*, whatever its value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.parse import parse_float, split_tags, strip


def as_record(json_text: Column) -> Column:
    """JSON object text to ``map<string, variant>``; anything but an object gives NULL."""
    return F.from_json(json_text, "map<string,variant>")


def json_literal(text: str) -> Column:
    return F.parse_json(F.lit(text))


def first_present(record: Column, *keys: str, default: str | None = None) -> Column:
    """Value of the first key the record has, even if that value is JSON null.

    ``default`` is JSON text used when no key is present.
    """
    found = [record[k] for k in keys]
    if default is not None:
        found.append(json_literal(default))
    return F.coalesce(*found) if found else F.lit(None).cast("variant")


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_text(v: Column) -> Column:
    return kind_of(v) == "STRING"


def is_truthy(v: Column) -> Column:
    """Python truth of a JSON value: null, empty text, zero, false, [] and {} are false."""
    text = v.cast("string")
    empty_looking = text.isin("", "0", "0.0", "-0.0", "false", "[]", "{}")
    return F.coalesce(
        ~F.is_variant_null(v) & (~empty_looking | (is_text(v) & (text != ""))), F.lit(False)
    )


def first_truthy(*values: Column) -> Column:
    return F.coalesce(*[F.when(is_truthy(v), v) for v in values])


def text_of(v: Column) -> Column:
    """Any scalar as text; booleans as ``True``/``False``, JSON null as SQL NULL."""
    return text_from(v.cast("string"), v)


def _is_boolean(text: Column, v: Column) -> Column:
    """Looks at the kind only of values that read like a boolean."""
    return F.when(text.isin("true", "false"), kind_of(v) == "BOOLEAN").otherwise(False)


def text_from(text: Column, v: Column) -> Column:
    """:func:`text_of` where the value's text is at hand."""
    return F.when(_is_boolean(text, v), F.initcap(text)).otherwise(text)


def text_if_text(text: Column, kind: Column) -> Column:
    """The text of a JSON string; any other kind gives NULL."""
    return F.when(kind == "STRING", text)


def float_from(text: Column, v: Column) -> Column:
    """A value, its text at hand, to double: number, numeric text or boolean; else NULL."""
    return F.when(_is_boolean(text, v), (text == "true").cast("double")).otherwise(parse_float(text))


def clean_tags(v: Column) -> Column:
    """Tags from a JSON value: list elements as text, text split at commas, anything else empty.

    A null list element becomes the text ``None``, as the unified schema has always stored it.
    """
    elements = v.try_cast("array<variant>")
    texts = F.transform(elements, lambda e: strip(F.coalesce(text_of(e), F.lit("None"))))
    return (
        F.when(elements.isNotNull(), F.filter(texts, lambda t: t != ""))
        .when(is_text(v), split_tags(v.cast("string")))
        .otherwise(F.array().cast("array<string>"))
    )


def residual(record: Column, excluded: tuple[str, ...]) -> Column:
    """The record without the excluded keys."""
    return F.map_filter(record, lambda k, _: ~k.isin(*excluded))
