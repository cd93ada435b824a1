"""Tables of pages: nesting, entities, comments, missing end tags."""

from confluence.operators import universe as U

CASES = {
    "entities": ("<table><tr><th>Symbol</th></tr><tr><td>AT&amp;T</td></tr><tr><td>&#65;&#x42;&eacute;&bogus;&amp;lt;&nbsp;</td></tr></table>", ["AT&T", "ABé&bogus;&lt;"]),
    "no blanks between nodes": ("<table><tr><th>Symbol</th></tr><tr><td><a href='x>y'>BRK</a> <b>B</b></td></tr></table>", ["BRKB"]),
    "comments and scripts": ("<!-- <table><tr><th>Symbol</th></tr><tr><td>no</td></tr></table> --><table><tr><th>Symbol<!-- x --></th></tr><tr><td>A<script>'<td>'</script><style>td{}</style></td></tr></table>", ["A"]),
    "nested table": ("<table><tr><th>Name</th><th>Symbol</th></tr><tr><td>a</td><td>X<table><tr><td>in</td><td>deep</td></tr></table></td></tr><tr><td>b</td><td>Y</td></tr></table>", ["Xindeep", "deep", "Y"]),
    "layout table around": ("<table><tr><td><table><tr><th>Symbol</th></tr><tr><td>A</td></tr></table></td></tr></table>", ["A"]),
    "rows left open": ("<table><tr><th>Symbol</th></tr><tr><td>A</td></tr><tr><td>B</table><p>behind</p>", ["A", "B"]),
    "end tags without a start": ("</td></table><table></tr><tr><th>Symbol</th></tr></td><tr><td>A</td></tr></table>", ["A"]),
    "empty first table": ("<table><tr><th>Symbol</th></tr><tr><td> </td></tr></table><TABLE CLASS=x><TR><TD>Symbol</TD></TR><TR><TD>b</TD></TR></TABLE>", ["b"]),
    "short rows": ("<table><tr><th>N</th><th>Symbol</th></tr><tr><td>1</td></tr><tr><td/><td>A</td></tr></table>", ["A"]),
    "a sign that opens no tag": ("<table><tr><th>Symbol</th></tr><tr><td>1 < 2</td></tr></table>", ["1< 2"]),
    "none": ("<p>Symbol</p>", []), "empty": ("", []), "null": (None, []),
}


def test_columns_of_tables(spark):
    df = spark.createDataFrame([(k, page) for k, (page, _) in CASES.items()], "page_id string, html string")
    got = {}
    for r in U.table_column(df, ("Symbol", "Ticker")).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.value)
    assert got == {k: v for k, (_, v) in CASES.items() if v}


def test_ticker_and_country_in_one_pass(spark):
    row = "<tr><td>{}</td><td>x</td><td><img alt='>'/> {}</td></tr>"
    head = "<table><tr><th>Ticker</th><th>Company</th><th>Country</th></tr>"
    body = [("ZURN", "Switzerland"), ("volv b", "Sweden"), ("LPP", "Poland"), ("", "France"), ("A&amp;B", "France")]
    page = "<table><tr><th>Ticker</th></tr><tr><td>no</td></tr></table>" + head + "".join(row.format(*b) for b in body) + "<tr><td>short</td></tr></table>"
    empty = head + "</table>" + head + row.format("late", "France") + "</table>"  # the first table counts, though it is empty
    got = U.constituents(spark.createDataFrame([(1, page), (2, empty)], "page_id int, html string")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, "ZURN", "Switzerland", "ZURN.SW"), (1, 1, "volv b", "Sweden", "VOLV-B.ST"), (1, 2, "LPP", "Poland", None), (1, 3, "A&B", "France", "A&B.PA"),
    ]


def test_a_table_of_many_rows_keeps_their_order(spark):
    n = 3000
    page = "<table><tr><th>N</th><th>Symbol</th></tr>" + "".join(f"<tr><td>{i}</td><td>S{i}</td></tr>" for i in range(n)) + "</table>"
    got = U.table_column(spark.createDataFrame([(1, page)], "page_id int, html string"), ("Symbol",)).orderBy("pos").collect()
    assert [r.value for r in got] == [f"S{i}" for i in range(n)] and got[-1].pos == n - 1
