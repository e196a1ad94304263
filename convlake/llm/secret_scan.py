"""Secret scan with corpus-wide ownership frequency.

Every text is scanned for candidates: the three base kinds of the contract, and long mixed
tokens outside of these (kind ``owned``).  The candidates' hashes are counted over the whole
corpus by distinct repositories and owners.  A value that more than ``max_owners`` owners or more
than ``max_repos`` repositories have is an example that was widely copied; one that stays with few of
both, and looks random, is a live-looking credential.  Base spans are always reported, with this verdict as counts beside
them; an ``owned`` span is reported only if its value is live-looking.

Spans come from built-in functions alone: ``split`` gives the text between matches and
``regexp_extract_all`` the matches, and the running sum of their lengths is the place.  The sum is
kept as an array, so the cost of one text grows with the square of its matches (about 10 s for
20,000 matches in one text).

Edge cases: a null text is empty; spans count code points; texts of any length are scanned
whole; repeated rows are scanned each, and count once for a repository and owner; a null
owner or repository is one more owner or repository; an empty table gives an empty table;
columns other than those named by the parameters aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import cut

#: Patterns of the contract's base kinds, in its order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs of 20 and more, the key's AKIA included
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f] of 24 and more
#: Long tokens without a known form; those with a digit and a letter are candidates.
MIXED = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
SPAN = "array<struct<start:int,k:int,end:int,value:string>>"


def spans(text: Column, pattern: str, kind: int, value: Column, could: Column) -> Column:
    """Leftmost non-overlapping matches as structs (start, k, end, value), in order.

    ``value``: an array with what is compared across the corpus, for each match;
    ``could``: false where a cheap test shows that there is none.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    # running sums: the end of match i is the sum of the first i + 1 gaps and matches
    ends = F.aggregate(
        F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda g, h: g + F.length(h)),
        F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))),
    )
    placed = F.transform(
        F.arrays_zip(hits.alias("h"), ends.alias("e"), value.alias("v")),
        lambda x: F.struct(
            (x["e"] - F.length(x["h"])).alias("start"), F.lit(kind).alias("k"), x["e"].alias("end"), x["v"].alias("value")
        ),
    )
    return F.when(could & F.rlike(text, F.lit(pattern)), placed).otherwise(F.array().cast(SPAN)).cast(SPAN)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    group = lambda pattern, n: F.regexp_extract_all(text, F.lit(pattern), F.lit(n))
    assign = spans(text, ASSIGN, 0, group(ASSIGN, 2), F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")))
    assign = F.filter(assign, lambda s: F.length(s["value"]) >= 6)
    access = spans(text, ACCESS, 1, group(ACCESS, 0), F.contains(text, F.lit("AKIA")))
    hexes = spans(text, HEX, 2, group(HEX, 0), F.lit(True))
    return F.array_sort(F.concat(assign, access, hexes))


def more_spans(text: Column, base: Column) -> Column:
    """Long mixed tokens that touch no base span."""
    found = spans(text, MIXED, 3, F.regexp_extract_all(text, F.lit(MIXED), F.lit(0)), F.lit(True))
    mixed = F.filter(found, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    return F.filter(mixed, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def looks_random(value: Column) -> Column:
    """Live-looking: ten different characters at least, and a digit and a letter."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (different >= 10) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def ownership(hits: DataFrame) -> DataFrame:
    """``hits``: rows (hash, repo, owner).  Distinct owners and repositories of each hash.

    Each step adds up within the tasks before it shuffles, so a value that a third of all rows
    have costs a row for each task.
    """
    return (
        hits.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner").agg(F.sum("one").alias("repos"))
        .groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))
    )


def scan_secrets(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source",
    max_owners: int = 2, max_repos: int = 50, salts: int = 16,
) -> DataFrame:
    """Rows (row, doc, base, more, n_live, n_example): spans with verdicts, for each input row.

    The texts are read once and never shuffled: the spans are written to the shared folder,
    and all counting works on them.
    """
    found = docs.select(
        F.col(doc).alias("doc"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    found = found.withColumn("base", base_spans(F.col("text")))
    found = found.withColumn("more", more_spans(F.col("text"), F.col("base"))).drop("text")
    hashed = lambda a: F.transform(
        a,
        lambda s: F.struct(
            s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"),
            F.sha2(s["value"], 256).alias("hash"), looks_random(s["value"]).alias("random"),
        ),
    )
    found = cut(
        found.select(F.monotonically_increasing_id().alias("row"), "doc", "repo", "owner", hashed(F.col("base")).alias("base"), hashed(F.col("more")).alias("more"))
    )
    hits = found.select("row", "repo", "owner", F.explode(F.concat("base", "more")).alias("s")).select(
        "row", "repo", "owner", "s", F.col("s.hash").alias("hash")
    )
    # a hash that very many rows have is joined in ``salts`` parts
    counts = ownership(hits).withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    judged = (
        hits.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int"))
        .join(counts.hint("merge"), ["hash", "salt"])
        .withColumn("copied", (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos))
        .withColumn("live", ~F.col("copied") & F.col("s.random"))
        .groupBy("row")
        .agg(
            F.array_sort(F.collect_list(F.when((F.col("s.k") == 3) & F.col("live"), F.struct("s.start", "s.k", "s.end")))).alias("kept"),
            F.count_if("live").alias("n_live"),
            F.count_if("copied").alias("n_example"),
        )
    )
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    return found.select("row", "doc", bare.alias("base")).join(judged.hint("merge"), "row", "left").select(
        "row", "doc", "base", F.coalesce("kept", none).alias("more"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def spelled(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kind(s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(documents: DataFrame) -> DataFrame:
    of = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return scan_secrets(documents).select(
        F.col("doc").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.array_sort(F.concat("base", "more"))).alias("spans"), "n_live", "n_example",
    )


def without_spans(text: Column, found: Column, mask: str) -> Column:
    """``text`` with each span of ``found`` (in order of start) replaced; what touches is replaced once."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: (
        F.when(s["end"] <= acc["at"], acc)
        .when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), s["end"].alias("at")))
        .otherwise(
            F.struct(
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out"),
                s["end"].alias("at"),
            )
        )
    )
    whole = F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def redact(docs: DataFrame, mask: str = "[SECRET]", max_owners: int = 2, max_repos: int = 50, salts: int = 16) -> DataFrame:
    """The documents with every reported span replaced by ``mask``; all columns and rows kept.

    Only documents with candidates beyond the base kinds wait for the counts of the corpus.
    """
    # the caller's columns travel in one struct, so that no name can meet one of those here
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("doc"), base_spans(text).alias("base"), F.col("doc_id").cast("string").alias("repo"), F.col("source").cast("string").alias("owner"))
    rows = rows.withColumn("more", more_spans(F.coalesce("doc.text", F.lit("")), F.col("base")))
    plain = rows.where(F.size("more") == 0).select("doc", F.col("base").alias("found"))
    waiting = cut(rows.where(F.size("more") > 0).select("doc", "base", "more", F.monotonically_increasing_id().alias("row")))
    hits = waiting.select("row", F.explode("more").alias("s")).select("row", "s", F.sha2("s.value", 256).alias("hash"))
    # the counts are those of the whole corpus: base spans of other documents count too
    everything = rows.select("repo", "owner", F.explode(F.concat("base", "more")).alias("s")).select("repo", "owner", F.sha2("s.value", 256).alias("hash"))
    few = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    counts = ownership(everything).where(few).withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    live = (
        hits.where(looks_random(F.col("s.value")))
        .withColumn("salt", F.pmod("row", F.lit(salts)).cast("int"))
        .join(counts.hint("merge"), ["hash", "salt"])
        .groupBy("row").agg(F.collect_list("s").alias("live"))
    )
    judged = waiting.join(live.hint("merge"), "row", "left").select(
        "doc", F.array_sort(F.concat("base", F.coalesce("live", F.array().cast(SPAN)))).alias("found")
    )
    hidden = F.col("doc").withField("text", without_spans(F.col("doc.text"), F.col("found"), mask))
    return plain.unionByName(judged).select(hidden.alias("doc")).select("doc.*")
