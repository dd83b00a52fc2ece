"""Site lines against counting by hand."""

from collections import Counter

from arrpipe.llm import lines


def test_equals_counting(spark):
    pages = [(i, f"h{i % 3}" if i % 5 else "hot", ["menu", f"own {i}", "menu", "often" if i % 2 else "rare", ""][: i % 6]) for i in range(60)]
    pages += [(70, "two", ["both", "first"]), (71, "two", ["both", "second"]), (72, "long", ["x" * 2_000_000, "y"])]
    pages += [(60, "alone", ["menu", "x"]), (60, "alone", ["menu", "x"]), (None, "", None)]
    df = spark.createDataFrame(pages, "page_id long, host string, lines array<string>")
    totals, on = Counter(), Counter()
    for _, h, l in pages:
        totals[h] += 1
        on.update((h, x) for x in set(l or []))
    expected = []
    for p, h, l in pages:
        kept = [x for x in l or [] if not (on[h, x] >= 2 and on[h, x] / totals[h] > 0.2)]
        expected.append((str(p), h, len(l or []), "\n".join(kept)))
    rows = lines.drop_boilerplate(df).collect()
    assert sorted((str(r.page_id), r.host, r.n_lines, r.kept_text) for r in rows) == sorted(expected)


def test_html_and_hosts(spark):
    html = "<html><head><title>T &amp; U</title><style>p{}</style></head><body><!-- <p>no</p> --><p>a  b<br>c</p><script>x('</p>')</script><DIV>d <b>e</b>&lt;</DIV></body>"
    row = spark.createDataFrame([(html, "HTTP://user@Www.Ex.org:80/a?b")], "html string, url string").select(
        lines.lines_of(lines.html_text()).alias("l"), lines.host().alias("h")
    ).first()
    assert row.l == ["T & U", "a b", "c", "d e<"] and row.h == "www.ex.org"
    none = spark.createDataFrame([(None, None), ("", "no url")], "html string, url string").select(
        lines.lines_of(lines.html_text()).alias("l"), lines.host().alias("h")
    ).collect()
    assert all(r.l == [] and r.h == "" for r in none)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, host string, lines array<string>")
    assert lines.drop_boilerplate(df).collect() == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "h", ["a", "b"])] * 2, "page_id long, host string, lines array<string>").selectExpr(
        "*", "'x' as kept_text", "1 as n", "2 as h", "3 as p1", "4 as drop", "5 as pages", "6 as row"
    )
    rows = lines.drop_boilerplate(df).collect()
    assert [(r.h, r.n, r.p1, r.drop, r.pages, r.row, r.kept_text, r.n_dropped) for r in rows] == [(2, 1, 3, 4, 5, 6, "", 2)] * 2
