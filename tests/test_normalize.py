import datetime as dt

import pytest
from helpers import in_order, raw_of

from millrace.operators.normalize import normalize
from millrace.operators.validate import accepted, rejected, run_outcome, split, validate
from millrace.sources.csv import csv_records, read_csv_source
from millrace.sources.spec import KIND_MAPPINGS, FieldMapping


def mapped(spark, kind, records, *columns):
    return in_order(normalize(raw_of(spark, kind, records)), *columns)


def codes(spark, kind, records):
    checked = validate(normalize(raw_of(spark, kind, records)))
    return [row[0] for row in in_order(checked, "errors")]


def test_presence_decides_not_value(spark):
    records = [
        {"id": 1, "name": "n", "title": "t", "price": 1, "cost": 2},
        {"id": 1, "name": None, "title": "t", "price": None, "cost": 2},
        {"id": 1, "title": "t", "cost": 2},
        {"id": 1},
        {"id": 1, "name": "", "price": ""},
    ]
    assert mapped(spark, "api", records, "title", "amount") == [
        ("n", 1.0), (None, None), ("t", 2.0), ("Untitled", None), ("", None),
    ]


def test_ids_become_text(spark):
    records = [{"id": 7}, {"item_id": "x"}, {"id": None}, {}, {"id": True}, {"id": 1.5}]
    assert mapped(spark, "api", records, "external_id") == [
        ("7",), ("x",), (None,), ("",), ("True",), ("1.5",),
    ]
    missing = [["external_id_missing"]] * 2
    assert [c for c in codes(spark, "api", records) if c] == missing


def test_rest_record_maps_every_column(spark):
    record = {
        "id": "a1", "title": " Test Item ", "description": "d", "category": "c", "price": 99.5,
        "url": "http://u", "thumbnail": "http://i", "author": "w", "stock": "10.9", "rating": 4,
        "tags": ["x", " y ", "", 3, None, True], "created_at": "2024-01-15T10:00:00+02:00", "extra": 1,
    }
    row = normalize(raw_of(spark, "api", [record])).first()
    assert (row.external_id, row.title, row.description, row.category) == ("a1", "Test Item", "d", "c")
    assert (row.url, row.image_url, row.author) == ("http://u", "http://i", "w")
    assert (row.amount, row.quantity, row.rating, row.status) == (99.5, 10, 4.0, "active")
    assert row.tags == ["x", "y", "3", "None", "True"]
    assert row.published_at == dt.datetime(2024, 1, 15, 8)
    assert set(row.metadata) == set(record) - {"id", "title", "description", "category"}


def test_csv_record_maps_every_column(spark):
    record = {
        "row_id": "9", "name": "Product", "details": "d", "category": "c", "cost": "49.99",
        "qty": "3", "date": "2024-01-15", "keywords": " a, b ,", "link": "http://l",
    }
    row = normalize(raw_of(spark, "csv", [record])).first()
    assert (row.external_id, row.title, row.description, row.url) == ("9", "Product", "d", "http://l")
    assert (row.amount, row.quantity, row.tags) == (49.99, 3, ["a", "b"])
    assert row.published_at == dt.datetime(2024, 1, 15)
    assert set(row.metadata) == {"cost", "qty", "date", "keywords", "link"}


def test_csv_tags_take_the_first_truthy_key(spark):
    records = [
        {"keywords": "", "tags": "a,b"}, {"keywords": None, "tags": "c"}, {"keywords": "k", "tags": "t"},
        {"keywords": 5, "tags": "t"}, {"keywords": 0, "tags": "t"}, {"keywords": [], "tags": "t"},
        {"keywords": "0", "tags": "t"}, {},
    ]
    assert mapped(spark, "csv", records, "tags") == [
        (["a", "b"],), (["c"],), (["k"],), ([],), (["t"],), (["t"],), (["0"],), ([],),
    ]


def test_tag_forms(spark):
    forms = [["a", " "], "a, b", {"k": 1}, 5, None]
    records = [{"id": 1, "tags": form} for form in forms]
    assert mapped(spark, "rss", records, "tags") == [(["a"],), (["a", "b"],), ([],), ([],), ([],)]
    # REST sources take tags only from a list.
    assert mapped(spark, "api", records, "tags") == [(["a"],), ([],), ([],), ([],), ([],)]


def test_feed_entry_metadata_always_has_content(spark):
    records = [{"id": "1", "title": "t"}, {"id": "1", "title": "t", "content": "c", "categories": ["x"]}]
    got = normalize(raw_of(spark, "rss", records)).orderBy("ordinal").collect()
    assert [sorted(r.metadata) for r in got] == [["content"], ["categories", "content"]]
    assert [r.tags for r in got] == [[], []]


def test_categories_can_be_routed_to_tags(spark):
    mapping = FieldMapping(external_id=("id",), title=("title",), tags=("categories",))
    raw = raw_of(spark, "rss", [{"id": "1", "title": "t", "categories": ["x", "y"]}])
    row = normalize(raw, KIND_MAPPINGS, {("rss", "source"): mapping}).first()
    assert row.tags == ["x", "y"]


def test_text_fields_must_be_text(spark):
    records = [
        {"id": 1, "name": 5}, {"id": 1, "name": "n", "category": 3, "author": ["a"]},
        {"id": 1, "name": "n", "description": {}}, {"id": 1, "name": "n", "url": None},
    ]
    assert codes(spark, "api", records) == [
        ["title_not_text"], ["category_not_text", "author_not_text"], ["description_not_text"], [],
    ]


def test_titles(spark):
    records = [{"id": 1, "name": t} for t in (None, "", "   ", "x" * 500, "x" * 501, " " + "x" * 500)]
    assert codes(spark, "api", records) == [
        ["title_missing"], ["title_missing"], ["title_blank"], [], ["title_too_long"], ["title_too_long"],
    ]


@pytest.mark.parametrize(
    ("field", "value", "code"),
    [
        ("price", -0.01, "amount_out_of_range"), ("price", 0, None), ("price", "nan", "amount_out_of_range"),
        ("price", "inf", None), ("price", "not_a_number", None), ("price", -1, "amount_out_of_range"),
        ("price", True, None), ("stock", -1, "quantity_out_of_range"), ("stock", "-0.5", None),
        ("stock", 2**31 - 1, None), ("stock", 2**31, "quantity_out_of_range"),
        ("stock", "inf", "quantity_out_of_range"), ("stock", "nan", None), ("stock", 1e30, "quantity_out_of_range"),
        ("rating", 0, None), ("rating", 5, None), ("rating", 5.01, "rating_out_of_range"),
        ("rating", "nan", "rating_out_of_range"), ("category", "c" * 200, None),
        ("category", "c" * 201, "category_too_long"), ("url", "u" * 2049, "url_too_long"),
        ("author", "a" * 201, "author_too_long"), ("id", "i" * 256, "external_id_too_long"),
        ("image_url", "u" * 2048, None),
    ],
)
def test_limits(spark, field, value, code):
    assert codes(spark, "api", [{"id": "1", "name": "n", field: value}]) == [[code] if code else []]


def test_unmappable_records(spark):
    assert codes(spark, "feed", [{"id": 1}]) == [["unknown_source_type"]]
    assert codes(spark, "api", ["[1]", "oops", "5", "null"]) == [["payload_not_object"]] * 4


def test_split_keeps_every_row_on_one_side(spark, as_of):
    records = [{"id": i, "name": "n", "price": i - 3} for i in range(10)]
    checked = validate(normalize(raw_of(spark, "api", records)))
    items, rejects = split(checked, as_of)
    assert (items.count(), rejects.count()) == (7, 3)
    reject = rejects.orderBy("raw_data_id").first()
    assert (reject.phase, reject.error_class) == ("normalization", "ValidationError")
    assert reject.message == "amount_out_of_range" and reject.context["source_type"] == "api"
    row = items.first()
    assert len(row.uuid) == 36 and row.uuid.replace("-", "") == row.id


def test_outcome_counts_repeats_of_an_item(spark):
    records = [{"id": 1, "name": "a"}, {"id": 1, "name": "b"}, {"id": 2, "name": None}]
    checked = validate(normalize(raw_of(spark, "api", records)))
    row = run_outcome(checked, ["source_name"]).first()
    assert (row.records_extracted, row.records_loaded, row.records_failed) == (3, 2, 1)
    assert (row.distinct_keys_loaded, row.status) == (1, "partial")


def test_csv_columns_without_a_mapping_stay_null(spark, as_of, tmp_path):
    path = tmp_path / "shop.csv"
    path.write_text(
        "id,name,description,category,price,stock,rating,created_date,tags\n"
        'A1,Lamp,"Desk, LED",Office,45.00,80,4.3,2024-01-17,"lamp,led"\n'
        "A2,Mug,,Kitchen,,250,4.2,2024-01-22,mug\n",
        encoding="utf-8",
    )
    rows = csv_records(read_csv_source(spark, str(path)))
    raw = raw_of(spark, "csv", [r.payload for r in rows.orderBy("ordinal").collect()])
    items = accepted(validate(normalize(raw)))
    lamp, mug = items.orderBy("external_id").collect()
    for row in (lamp, mug):
        assert (row.quantity, row.rating, row.published_at) == (None, None, None)
        assert {"stock", "rating", "created_date"} <= set(row.metadata)
    assert (lamp.title, lamp.description, lamp.amount) == ("Lamp", "Desk, LED", 45.0)
    assert lamp.tags == ["lamp", "led"]
    assert (mug.amount, mug.description) == (None, None)
    assert rejected(validate(normalize(raw)), as_of).isEmpty()
