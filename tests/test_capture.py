"""Pages to turns."""

from convlake.operators import capture, pairing

ASK = '<section data-turn="user"><div data-message-author-role="user"><div class="user-message-bubble-color"><div class="whitespace-pre-wrap">{}</div></div></div></section>'
TELL = '<section data-turn="assistant"><div data-message-author-role="assistant"><div class="markdown prose">{}</div></div></section>'


def turns(spark, *pages, url="https://chatgpt.com/c/1"):
    return capture.page_turns(spark.createDataFrame([(i, url, p) for i, p in enumerate(pages)], "page_id long, url string, html string"))


def said(df):
    return [(r.page_id, r.turn, r.role, r.content) for r in df.orderBy("page_id", "turn").collect()]


def test_turns_keep_their_places(spark):
    page = ASK.format("a") + TELL.format("") + ASK.format("b") + ASK.format("c") + TELL.format("<p>d</p><pre><code>e\n f</code></pre>") + TELL.format("g") + ASK.format("h")
    df = turns(spark, page, None, "", "<p>no turns</p>")
    assert said(df) == [(0, k, r, t) for k, (r, t) in enumerate([("user", "a"), ("assistant", ""), ("user", "b"), ("user", "c"), ("assistant", "d\ne\n f"), ("assistant", "g"), ("user", "h")])]
    pairs = pairing.pair_turns(df.withColumnRenamed("page_id", "conv_id")).orderBy("turn").collect()
    # a regenerated question keeps its place, a last one waits, an answer too many goes
    assert [(p.question, p.answer) for p in pairs] == [("a", ""), ("b", ""), ("c", "d\ne\n f")]


def test_other_sites_give_no_turns(spark):
    assert turns(spark, ASK.format("a"), url="https://example.org/").count() == 0
    assert turns(spark, ASK.format("a"), url="https://claude.ai/chat/1").count() == 0
    assert said(turns(spark, ASK.format("a"), url="http://www.chat.openai.com/x")) == [(0, 0, "user", "a")]


def test_parts_of_a_turn(spark):
    two = (
        '<section data-turn="assistant"><div data-message-author-role="assistant"><div class="markdown prose">one</div><div class="markdown prose">not this</div></div>'
        '<div id="textdoc-message-x"><div class="prose">board</div></div><div data-message-author-role="assistant"><div class="markdown prose"><p>two</p><table><tr><td>1</td><td>2</td></tr></table></div><img src="/a.png"><img src="/icon.png"><button><img src="/b.png"></button></div></section>'
    )
    widget = '<section data-turn="assistant"><h6 class="sr-only">It said:</h6><div>plain <b>text</b></div></section>'
    df = turns(spark, two + widget)
    assert said(df) == [(0, 0, "assistant", "[Canvas Content]\nboard\n\none\n\ntwo\n1 | 2"), (0, 1, "assistant", "plain text")]
    assert [[i.src for i in r.images] for r in df.orderBy("turn").collect()] == [["/a.png"], []]


def test_every_rule_can_be_read():
    from convlake.operators.selectors import Automaton, parse

    assert all(parse(s) for rules in capture.RULES.values() for s in rules.values())
    assert [Automaton(rules) for rules in capture.RULES.values()]


def test_containers(spark):
    held = '<div class="conversation-container">{}</div>'
    page = held.format("<user-query-content>q</user-query-content>") + held.format('<model-response><message-content><div class="markdown">a</div></message-content><audio><source src="/s"></audio><video></video></model-response>') + held.format("<i>x</i>")
    df = turns(spark, page, url="https://gemini.google.com/app/1")
    assert said(df) == [(0, 0, "user", "q"), (0, 1, "assistant", ""), (0, 2, "user", ""), (0, 3, "assistant", "a")]
    got = pairing.pair_containers(capture.container_parts(df)).orderBy("pair_index").collect()
    assert [(r.question, r.answer, r.media) for r in got] == [("q", "", 0), ("", "a", 1)]
