"""Captured pages to turns: which nodes are turns, whose they are, and what each one says.

The places of turns and of what is in them are selectors of each platform, all asked for while the pages
are parsed.  A turn is an interval of nodes; texts, searches, canvases, artifacts and pictures inside it
belong to the nearest turn around them, so one exchange by page and turn puts a turn together.  A turn
whose text can't be read stays in its place with an empty text.

``page_turns`` gives (page_id, platform, turn, turn_id, role, content, images, media); with ``page_id`` as
the conversation, ``pairing.pair_turns`` makes pairs of them.  Where one container holds both halves
(``CONTAINERS``), it gives two turns, of which either may be empty; a container without any is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.artifacts import widget_fallback
from convlake.operators.html import collapse_math, element, filtered, flat_text, hit, inner, is_text, prose, strip_chrome, subtree, trees
from convlake.operators.reports import tidy_text
from convlake.operators.selectors import attr

#: The urls of the platforms, and where they keep turns and what is in them.
URLS = {
    "chatgpt": r"^https?://(www\.)?(chat\.openai|chatgpt)\.com", "claude": r"^https?://(www\.)?claude\.ai", "gemini": r"^https?://(www\.)?gemini\.google\.com",
}
RULES = {
    "chatgpt": {
        "turn": '[data-turn="user"], [data-turn="assistant"]', "user": '[data-turn="user"]', "assistant": '[data-turn="assistant"]',
        "asking": '[data-message-author-role="user"]', "message": '[data-message-author-role="assistant"]',
        "question": ".user-message-bubble-color .whitespace-pre-wrap", "answer": ".markdown.prose",
        "canvas": '[id^="textdoc-message-"]', "canvas_text": ".ProseMirror, .prose",
        "picture": ".group\\/imagegen-image, [class*=\"imagegen\"]", "picture_title": '.message-role, [class*="font-medium"]',
        "frame": 'iframe[title^="internal://"]',
        "hidden_image": 'pre.overflow-visible\\! img, [data-testid="webpage-citation-pill"] img, button img', "image": "img",
    },
    "claude": {
        "turn": "div[data-test-render-count]", "user": "[data-user-message-bubble], div.mb-1.mt-6.group", "assistant": 'div[data-is-streaming="false"]',
        "question": 'div[data-testid="user-message"] p.whitespace-pre-wrap', "answer": "div.standard-markdown, div.progressive-markdown",
        "upload": "div.relative.group\\/thumbnail", "artifact": "div.artifact-block-cell",
        "artifact_title": "div.leading-tight.text-sm.line-clamp-1", "artifact_label": "div.text-xs.line-clamp-1.text-text-400",
        "search": "div.ease-out.transition-all.flex.flex-col.font-ui.leading-normal", "search_button": "button.group\\/row",
        "search_query": ".flex.gap-2.relative.font-base.text-left", "search_count": "p.relative.bottom-\\[0\\.5px\\].pl-1.text-text-500",
        "search_result": "div.flex.flex-nowrap.p-2.pt-0.flex-col a",
    },
    "gemini": {"turn": ".conversation-container", "question": "user-query-content", "answer": "message-content .markdown", "response": "model-response"},
}
#: Platforms where one container holds a question and its answer.
CONTAINERS = ("gemini",)
TEXTS = ("question", "answer", "asking", "canvas_text")


def platform_of(url: Column) -> Column:
    return F.coalesce(*(F.when(url.rlike(pattern), F.lit(name)) for name, pattern in URLS.items()), F.lit(None).cast("string"))


def first_in(x: Column, name: str) -> Column:
    return F.get(F.filter(inner(x), lambda n: hit(n, name)), F.lit(0))


def said_in(x: Column, name: str) -> Column:
    return F.nullif(prose(first_in(x, name)), F.lit(""))


PART = "struct<node_id:int,turn_id:int,message_id:int,kind:string,text:string,src:string,alt:string,texts:array<struct<cell_id:int,row_id:int,block_id:int,verbatim:boolean,text:string>>>"


def part(x: Column, kind: Column | str, text: Column | None = None, src: Column | None = None, alt: Column | None = None, texts: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        x["node_id"].alias("node_id"), x["turn_id"].alias("turn_id"), x["message_id"].alias("message_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        (none if text is None else text).cast("string").alias("text"), (none if src is None else src).cast("string").alias("src"),
        (none if alt is None else alt).cast("string").alias("alt"), (none if texts is None else texts).alias("texts"),
    ).cast(PART)


def texts_of(x: Column) -> Column:
    return F.transform(F.filter(subtree(x), is_text), lambda n: F.struct(*(n[k].alias(k) for k in ("cell_id", "row_id", "block_id", "verbatim", "text"))))


#: Where a frame holds the html and the text of the document that it shows; named by whoever captures pages.
RELAYED = ("data-report-html", "data-report-text")


def page_parts(pages: DataFrame, relayed: tuple[str, str] = RELAYED) -> DataFrame:
    """(page_id, platform, node_id, turn_id, message_id, kind, text, src): what stands in the turns of pages, a row each.

    Pages of no known platform give no rows.  Each turn has a part of the kind ``turn`` itself; its text is only told where nothing
    else in it has one.  A widget's frame says its relayed report, else its relayed text, else the widget's name.
    """
    here = lambda where: filtered(lambda x: x["turn_id"].isNotNull() & where(x))
    known = pages.withColumn("platform", platform_of(F.col("url"))).where("platform IS NOT NULL")
    raw = trees(known, ("platform",), RULES, by="platform", graft=relayed[0])

    def search(x: Column) -> Column:
        count = F.nullif(F.regexp_extract(said_in(x, "search_count"), r"(\d+)", 1), F.lit(""))
        results = F.size(F.filter(inner(x), lambda n: hit(n, "search_result") & (attr(n, "href") != "")))
        found = F.when(results > 0, F.concat(F.lit("\n\nFound "), F.coalesce(count, results.cast("string")), F.lit(" results"))).otherwise("")
        query = F.when(first_in(x, "search_button").isNotNull(), said_in(x, "search_query"))
        return part(x, "search", F.concat(F.lit("[Web Search: "), query, F.lit("]"), found))

    def artifact(x: Column) -> Column:
        label, title = F.coalesce(said_in(x, "artifact_label"), F.lit("document")), F.coalesce(said_in(x, "artifact_title"), F.lit("Untitled Artifact"))
        return part(x, "artifact", F.concat(F.lit("["), label, F.lit(": "), title, F.lit("]")))

    def picture(x: Column) -> Column:
        image = F.get(F.filter(inner(x), lambda n: element(n, "img")), F.lit(0))
        turn = F.get("nodes", x["turn_id"])
        name = F.nullif(F.trim(F.try_element_at(F.split(said_in(turn, "picture_title"), "•"), F.lit(2))), F.lit(""))
        content = F.coalesce(F.concat(F.lit("[Image: "), name, F.lit("]")), F.lit("[Generated Image]"))
        return part(x, "picture", content, attr(image, "src"), F.coalesce(F.nullif(attr(image, "alt"), F.lit("")), F.lit("Generated image")))

    def shown(x: Column, image: Column) -> Column:
        return part(x, "image", src=attr(image, "src"), alt=F.nullif(attr(image, "alt"), F.lit("")))

    def upload(x: Column) -> Column:
        image = F.get(F.filter(inner(x), lambda n: element(n, "img")), F.lit(0))
        return shown(x, image)

    # what stands on buttons or is drawn is read before these go
    early = F.concat(
        F.transform(here(lambda x: hit(x, "search")), search), F.transform(here(lambda x: hit(x, "artifact")), artifact),
        F.transform(here(lambda x: hit(x, "picture")), picture), F.transform(here(lambda x: hit(x, "upload")), upload),
        F.transform(
            here(lambda x: hit(x, "image") & ~hit(x, "hidden_image") & (attr(x, "src") != "") & ~attr(x, "src").contains("sprites-core") & ~attr(x, "src").contains("icon")),
            lambda x: shown(x, x),
        ),
        F.transform(here(lambda x: hit(x, "user", "assistant")), lambda x: part(x, F.when(hit(x, "user"), "user").otherwise("assistant"))),
        F.transform(here(lambda x: element(x, "video", "audio")), lambda x: part(x, "media", src=F.coalesce(attr(x, "src"), attr(F.get(F.filter(inner(x), lambda n: element(n, "source")), F.lit(0)), "src")))),
    )
    clean = strip_chrome(collapse_math(raw.withColumn("early", early)))
    name = lambda x: F.coalesce(*(F.when(hit(x, n), F.lit(n)) for n in TEXTS))
    late = F.transform(here(lambda x: (x["kind"] == "element") & hit(x, *TEXTS)), lambda x: part(x, name(x), texts=texts_of(x)))
    unread = lambda x: widget_fallback(F.lit(None).cast("string"), tidy_text(attr(x, relayed[1])), attr(x, "title"))
    frames = F.transform(here(lambda x: hit(x, "frame")), lambda x: part(x, "frame", F.when(~F.exists(inner(x), is_text), unread(x)), texts=texts_of(x)))
    bare = lambda x: ~F.exists(subtree(x), lambda n: hit(n, *TEXTS))
    turns = F.transform(filtered(lambda x: (x["turn_id"] == x["node_id"]) & hit(x, "turn")), lambda x: part(x, "turn", texts=F.when(bare(x), texts_of(x))))
    rows = clean.select("page_id", "platform", F.explode(F.concat("early", late, frames, turns)).alias("x")).select("page_id", "platform", "x.*")
    return rows.withColumn("text", F.coalesce("text", F.nullif(flat_text("texts"), F.lit("")))).drop("texts")


def page_turns(pages: DataFrame, relayed: tuple[str, str] = RELAYED) -> DataFrame:
    """(page_id, platform, turn, turn_id, role, content, images, media), numbered by place."""
    parts = page_parts(pages, relayed).groupBy("page_id", "platform", "turn_id").agg(
        F.array_sort(F.collect_list(F.struct("node_id", "kind", "message_id", "text", "src", "alt"))).alias("p")
    )
    of = lambda *kinds: F.filter("p", lambda x: x["kind"].isin(*kinds))
    has = lambda kind: F.exists("p", lambda x: x["kind"] == kind)
    texts = lambda items: F.filter(F.transform(items, lambda x: x["text"]), lambda t: t.isNotNull())
    first = lambda kind: F.get(texts(of(kind)), F.lit(0))
    joined = lambda *lists: F.nullif(F.array_join(F.concat(*lists), "\n\n"), F.lit(""))
    whole = first("turn")
    alts = F.transform(of("image"), lambda x: F.coalesce(x["alt"], F.lit("image")))
    uploads = F.when(has("image"), F.concat(F.lit("[Uploaded images: "), F.array_join(alts, ", "), F.lit("]")))
    # of the answers of one message, the first
    answers = of("answer")
    firsts = F.filter(answers, lambda x, i: x["message_id"].isNotNull() & ((i == 0) | ~x["message_id"].eqNullSafe(F.get(answers, i - 1)["message_id"])))
    canvas = F.transform(F.slice(texts(of("canvas_text")), 1, 1), lambda t: F.concat(F.lit("[Canvas Content]\n"), t))
    asked = F.when(F.col("platform") == "chatgpt", F.coalesce(first("question"), first("asking"), whole, uploads)).when(
        F.col("platform") == "claude", F.coalesce(first("question"), uploads)
    ).otherwise(first("question"))
    answered = (
        F.when((F.col("platform") == "chatgpt") & F.exists("p", lambda x: (x["kind"] == "answer") & x["message_id"].isNotNull()), joined(canvas, texts(firsts)))
        .when(F.col("platform") == "chatgpt", F.coalesce(joined(canvas), first("picture"), first("answer"), first("frame"), whole))
        .when(F.col("platform") == "claude", joined(texts(of("search")), texts(answers), texts(of("artifact"))))
        .otherwise(joined(texts(answers)))
    )
    images = lambda *kinds: F.transform(of(*kinds), lambda x: F.struct(x["src"].alias("src"), x["alt"].alias("alt")))
    none = images("none")
    media = F.size(F.filter("p", lambda x: (x["kind"] == "media") & x["src"].isNotNull()))
    message = lambda role, content, pictures, n: F.struct(
        F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"), pictures.alias("images"), n.cast("int").alias("media")
    )
    # named once, so that each is computed once
    parts = parts.withColumns({"asked": asked, "answered": answered, "media": media, "pictures": F.when(has("picture"), images("picture")).otherwise(images("image")), "role": F.when(has("user"), "user").when(has("assistant"), "assistant")})
    asked, answered, media = F.col("asked"), F.col("answered"), F.col("media")
    both = F.col("platform").isin(*CONTAINERS)
    question, answer = message("user", asked, F.col("pictures"), F.lit(0)), message("assistant", answered, F.col("pictures"), media)
    messages = (
        F.when(both & (asked.isNotNull() | answered.isNotNull() | (media > 0)), F.array(message("user", asked, none, F.lit(0)), answer))
        .when(both, F.array()).when(F.col("role") == "user", F.array(question)).when(F.col("role") == "assistant", F.array(answer)).otherwise(F.array())
    )
    w = Window.partitionBy("page_id").orderBy("turn_id", "half")
    return parts.select("page_id", "platform", "turn_id", F.posexplode(messages).alias("half", "m")).select(
        "page_id", "platform", (F.row_number().over(w) - 1).alias("turn"), "turn_id", "m.*"
    )


def container_parts(turns: DataFrame) -> DataFrame:
    """Turns of platforms with containers as the parts that ``pairing.pair_containers`` takes."""
    kind = F.when(F.col("role") == "user", "question").otherwise("answer")
    held = turns.where(F.col("platform").isin(*CONTAINERS)).select("page_id", F.col("turn_id").alias("container"), kind.alias("kind"), F.col("content").alias("text"), "media")
    media = F.transform(F.when(F.col("media") > 0, F.sequence(F.lit(1), F.col("media"))).otherwise(F.array().cast("array<int>")), lambda _: F.struct(F.lit("media").alias("kind"), F.lit(None).cast("string").alias("text")))
    return held.select("page_id", "container", F.explode(F.concat(F.array(F.struct("kind", "text")), media)).alias("x")).select("page_id", "container", "x.*")
