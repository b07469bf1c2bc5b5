"""Quality rules with cross-document line frequency, on DataFrame functions only.

``text_counts`` computes per-document counts inside the row (no shuffle)
and the hashes of its normalised lines.  ``frequent_lines`` counts in how many distinct
documents of a host each line occurs; ``removed_words`` tells how many words a document
loses when the lines above the limit are removed.  ``quality_rules`` joins them;
``cleaned_texts`` removes the lines.

Defined results: a null text counts as empty; null hosts form one host; a null
``doc_id`` is kept as a row of its own; repeated rows give repeated results;
exact copies of a text count as one document of their host, so that a copied
clean document does not turn into boilerplate (removing copies is another
operator's task); texts of any length count whole; ties at a limit keep the line; an empty table gives an empty result; extra columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import blank_words, spaced, written

SYMBOLS = "#*$%&|<>"
#: Defaults: a line is boilerplate in more than this share of a host's distinct documents, and more than so many.
HOST_SHARE, MIN_DOCS = 0.10, 20
#: A document is depleted when less than this percentage of its words remains.
KEEP_PERCENT = 30


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row, in one pass and without a shuffle: doc_id, host, content (hash of the text), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words and ``lines``, an array of (line: hash of the normalised line, n_words).

    ``n_repeat_words`` counts the words inside three-word windows that occur
    twice or more in the text, the first occurrence included.  Lines are normalised
    by lower case and without outer blanks.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).select("doc_id", "host", "text", spaced(F.col("text"), keep="\n").alias("blank"))
    letters = F.replace(F.replace("blank", F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    lines = F.filter(F.split("blank", "\n"), lambda x: F.trim(x) != "")
    raw_lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    parts = base.select(
        "doc_id", "host", F.xxhash64("text").alias("content"),
        blank_words(F.replace("blank", F.lit("\n"), F.lit(" "))).alias("words"),
        letters.alias("letters"), lines.alias("lines"), raw_lines.alias("raw_lines"),
    )
    plain = ["doc_id", "host", "content"]
    bare = F.col("letters")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    windows = parts.select(
        *plain,
        F.size("words").cast("long").alias("n_words"),
        F.length("letters").cast("long").alias("word_chars"),
        (F.length("letters") - F.length(bare)).cast("long").alias("n_symbols"),
        (F.size("raw_lines") - F.size(F.array_distinct("raw_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(F.lower(F.trim(x))).alias("line"), F.size(blank_words(x)).alias("n_words"))).alias("lines"),
        F.transform(
            F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
        ).alias("w3"),
    )
    plain += ["n_words", "word_chars", "n_symbols", "n_dup_lines", "lines"]
    # only texts that repeat a window pay for the sort
    ranked = windows.select(
        *plain,
        F.when(
            F.size(F.array_distinct("w3")) < F.size("w3"),
            F.sort_array(F.transform("w3", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("s"),
    )
    at = ranked.select(
        *plain,
        F.sort_array(
            F.filter(
                F.transform("s", lambda x, i: F.when((x.h == F.get("s", i - 1).h) | (x.h == F.get("s", i + 1).h), x.i)),
                lambda p: p.isNotNull(),
            )
        ).alias("at"),
    )
    gaps = F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3))))
    return at.select(*plain, F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def frequent_lines(counts: DataFrame, host_share: float = HOST_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """(host, line, n_docs, doc_limit) of the lines above their host's limit, from :func:`text_counts`."""
    rows = counts.select("host", "content", F.explode(F.array_distinct(F.transform("lines", lambda x: x.line))).alias("line"))
    counted = rows.groupBy("host", "line").agg(F.countDistinct("content").alias("n_docs"))
    # a limit is min_docs at least, so most lines go before the join with the hosts
    counted = counted.where(F.col("n_docs") > min_docs)
    hosts = counts.groupBy("host").agg(F.countDistinct("content").alias("host_docs"))
    limit = F.greatest(F.lit(float(min_docs)), F.col("host_docs") * F.lit(float(host_share)))
    return counted.join(hosts, "host").where(F.col("n_docs") > limit).select("host", "line", "n_docs", limit.alias("doc_limit"))


def _frequent_rows(counts: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, host, content, pos, line, n_words) of the documents' lines that are in ``frequent``."""
    rows = counts.select("doc_id", "host", "content", F.posexplode("lines").alias("pos", "x"))
    rows = rows.select("doc_id", "host", "content", "pos", F.col("x.line").alias("line"), F.col("x.n_words").alias("n_words"))
    return rows.join(frequent.select("host", "line"), ["host", "line"], "left_semi").dropDuplicates(["doc_id", "host", "content", "pos"])


def removed_words(counts: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, host, content, removed_words, removed_lines) of the documents that hold lines of ``frequent``."""
    hit = _frequent_rows(counts, frequent)
    return hit.groupBy("doc_id", "host", "content").agg(F.sum("n_words").cast("long").alias("removed_words"), F.count("*").alias("removed_lines"))


def cleaned_texts(docs: DataFrame, counts: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` without the lines of ``frequent`` in their texts, and ``removed``, the numbers of these lines from 0
    (all lines count, null if none is removed).  A line goes with one line break; ``counts`` may come from more documents."""
    gone = _frequent_rows(counts, frequent).groupBy("doc_id", "host", "content").agg(F.collect_set("line").alias("__lines"))
    gone = gone.withColumnsRenamed({"doc_id": "__id", "host": "__host", "content": "__content"})
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    out = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__content")) & (host == F.col("__host")), "left")
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("text"), i.alias("at"), F.xxhash64(F.lower(F.trim(spaced(x)))).alias("line")))
    left = F.array_join(F.transform(F.filter(lines, lambda x: ~F.array_contains("__lines", x.line)), lambda x: x.text), "\n")
    removed = F.transform(F.filter(lines, lambda x: F.array_contains("__lines", x.line)), lambda x: x["at"])
    return out.select(*(F.when(F.col("__lines").isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else c for c in docs.columns), F.when(F.col("__lines").isNotNull(), removed).alias("removed"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_words: int = 50, max_repeat_percent: int = 50,
    host_share: float = HOST_SHARE, min_docs: int = MIN_DOCS, keep_percent: int = KEEP_PERCENT,
) -> DataFrame:
    """One row per input row: the counts of :func:`text_counts`, ``base_failed``,
    ``removed_words``, ``removed_lines``, ``depleted`` and ``kept``."""
    counts = written(text_counts(docs, id_col, text_col, host_col), "counts")
    return judged(counts, frequent_lines(counts, host_share, min_docs), min_words, max_repeat_percent, keep_percent).drop("host", "content")


def judged(counts: DataFrame, frequent: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """The rows of :func:`quality_rules`, with host and content (hash of the text), from :func:`text_counts` and :func:`frequent_lines`."""
    gone = removed_words(counts, frequent)
    gone = gone.withColumnsRenamed({"doc_id": "g_id", "host": "g_host", "content": "g_content"})
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("content") == F.col("g_content")) & (F.col("host") == F.col("g_host"))
    out = counts.join(gone, same, "left")
    lost = F.coalesce("removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - lost) < keep_percent * F.col("n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        lost.alias("removed_words"), F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"), depleted.alias("depleted"), "host", "content",
    )
