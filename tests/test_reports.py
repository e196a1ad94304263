"""Reports in frames of captured pages."""

import html as escaping

from convlake.operators import capture, html
from convlake.operators.reports import DIAGRAM

URL = "https://chatgpt.com/c/1"
PAGES = "page_id long, url string, html string"
DIGITS = "".join(f"<span>{k}</span>" for k in range(10))
SIZED = '<svg width="300px" height="90"><text>2020</text></svg>'


def grafted(report):
    """Texts and tags that stand in the frame."""
    n = html.tree(f'<div><iframe title="internal://deep-research" data-r="{escaping.escape(report)}"></iframe><p>behind</p></div>', graft="data-r")
    assert n["tag"][n["parent_id"][len(n["tag"]) - 2]] == "div" and n["text"][-1] == "behind"  # nothing leaves the frame
    inside = range(2, n["end_id"][1] + 1)
    return [n["text"][i] for i in inside if n["kind"][i] == "text"], [n["tag"][i] for i in inside if n["kind"][i] == "element"]


def test_counters_go():
    assert grafted(f"<div>{DIGITS}</div><p>a</p>")[0] == ["a"]
    assert grafted(f"<div>{DIGITS[: -len('<span>9</span>')]}</div>")[0] == []  # each is an innermost element of figures only
    assert grafted(f"<p>{DIGITS}<b>x</b>{DIGITS}</p>")[0] == ["x"]


def test_figures_of_the_search_go():
    said = "<p>Research completed in 5m · 3 citations</p><p>3 citations · 12 searches</p><p> fuentes · búsquedas</p><p>3 citations are few</p><div>4 sources<p>kept</p></div>"
    assert grafted(said)[0] == ["3 citations are few", "4 sources", "kept"]
    assert grafted(f"<div>{DIGITS} searches</div><p>a</p>")[0] == ["a"]  # innermost once its digits are gone
    assert grafted("<table><tr><td>2024</td><td>2024 a</td></tr></table>")[0] == ["2024 a"]  # bare figures are taken for such a line, in cells too


def test_doubled_titles_go_before_headings_only():
    assert grafted("<div>T</div><h1> T</h1><p>x</p><p>x</p>")[0] == [" T", "x", "x"]
    assert grafted("<table><tr><td>m</td><td>m</td></tr></table><ul><li>i</li><li>i</li></ul>")[0] == ["m", "m", "i", "i"]
    assert grafted("<div>T</div><p>y</p><h2>T</h2><h2>T</h2>")[0] == ["T", "y", "T"]


def test_diagrams_are_marked():
    assert grafted(f"<p>a</p>{SIZED}<p>b</p>")[0] == ["a", DIAGRAM, "b"]
    assert grafted('<svg viewBox="0 0 100,100"><text>t</text></svg>')[1] == []
    for shown, marked in (('aria-label="A Chart"', True), ('aria-label="arrow"', False), ('width="20" height="300"', False), ('width="80" viewBox="0 0 1 80"', True), ("", False)):
        assert (grafted(f"<svg {shown}></svg>")[0] == [DIAGRAM]) == marked
    assert grafted("<svg><title>my timeline</title></svg>")[0] == [DIAGRAM]


def test_what_is_relayed_cannot_leave_its_frame():
    texts, tags = grafted("</div></iframe><script>x()</script><p data-turn='user'>a<form>f</form></p></section>")
    assert texts == ["a"] and tags == ["p"]
    deep = escaping.escape('<iframe title="internal://x" data-r="<p>b</p>"></iframe>c')
    assert grafted(escaping.unescape(deep))[0] == ["c"]
    for attrs in ('title="other" data-r="<p>a</p>"', 'title="internal://a" data-r=" "', 'title="internal://a"', "data-r"):
        assert "text" not in html.tree(f"<iframe {attrs}></iframe>", graft="data-r")["kind"]


def test_turns_of_widgets(spark):
    frame = '<section data-turn="assistant"><h6 class="sr-only">It said:</h6><iframe title="internal://deep-research" {}></iframe></section>'
    report = escaping.escape(f"<div>Title</div><h1>Title</h1><p data-turn='user'>a <b>b</b></p><table><tr><td>c1</td><td>c2</td></tr></table>{SIZED}")
    text = "\n".join(["1 citation", *"0123456789", "body", "7", "Research completed in 3m"])
    answer = '<section data-turn="assistant"><div class="markdown prose">said</div><iframe title="internal://w" data-report-text="t"></iframe></section>'
    page = frame.format(f'data-report-html="{report}"') + frame.format(f'data-report-html=" " data-report-text="{text}"') + frame.format("") + answer
    df = capture.page_turns(spark.createDataFrame([(1, URL, page)], PAGES)).orderBy("turn")
    assert [r.content for r in df.collect()] == [
        f"Title\na b\nc1 | c2\n{DIAGRAM}", "body", "[Deep Research: rendered in an embedded viewer that the page does not expose]", "said",
    ]
