"""Totals of list pages, entries that count once, and pages without entries."""

from lexframe.sources import landed

ROW = '<div class="row result"><a href="/decision/{:016x}">A v B</a></div>'
PAGES = [
    ("capped", "row_divs", "Displaying 1 - 20 of 10,000" + ROW.format(1), (1, 10000, True)),
    ("below", "row_divs", "Displaying 1 - 20 of 9,999" + ROW.format(1) + ROW.format(2), (2, 9999, False)),
    ("silent", "row_divs", ROW.format(1), (1, 1, False)),
    ("two counts", "list_items", '<p class="tagline">12 cases</p><p class="count">13</p><li><a href="/case/id/5">x</a></li>', (1, 12, True)),
    ("one count", "list_items", '<p class="tagline">12 cases</p><p class="count">12</p><li><a href="/case/id/5">x</a></li>', (1, 12, False)),
    ("once", "link_list", '<a href="/en/Legislation/a">A</a><a href="/en/Legislation/b">B</a><a href="/en/Legislation/a#s1">again</a>', (2, 2, False)),
    ("chips", "chip_rows", "1 of 500,000 results", (0, 0, True)),
    ("attribute", "ordered_list", '<ol class="resultsList" total="1,234"><li>no link</li></ol>', (0, 1234, False)),
    ("headings", "heading_index", '<h2 id="operation-a">A</h2><p>one</p><h2>no id</h2><h2 id="operation-b">B</h2>', (2, 2, False)),
    ("empty", "table_rows", "", (0, 0, False)),
    ("null", "table_rows", None, (0, 0, False)),
    ("unknown", "no_such_kind", "<tr>", None),
]


def test_totals_of_listings(spark):
    pages = spark.createDataFrame([p[:3] for p in PAGES], "page_id string, source string, html string")
    got = {r.page_id: (r.n_rows, r.total, r.unreliable) for r in landed.listing_totals(pages, landed.listing_recipes(spark)).collect()}
    assert got == {name: want for name, _, _, want in PAGES if want}


def test_entries_that_count_once(spark):
    pages = spark.createDataFrame([p[:3] for p in PAGES], "page_id string, source string, html string").filter("page_id in ('once', 'headings')")
    got = [(r.page_id, r["rank"], r.id, r.title, r.extra) for r in landed.parse_listing(pages, landed.listing_recipes(spark)).orderBy("page_id", "rank").collect()]
    assert got == [("headings", 1, "operation-a", "A", "one no id"), ("headings", 2, "operation-b", "B", None), ("once", 1, "a", "A", None), ("once", 2, "b", "B", None)]
