"""Groups of spelling variants from errata tries.

Words are counted over all texts.  Two words are near if one inserted, deleted or replaced code point tells them apart.  Near pairs are found in
tries that Spark spreads by keys:

1. The edit of a near pair lies in the first or in the second half of the shorter word, so the two agree in the other half.  A word
   goes out under the half it keeps, once for each side and for being the shorter or the longer one.  Where a key holds more than ``most``
   words, its window of places is halved again, until it is one place wide; nothing is dropped.
2. The words of some keys form a trie, over reversed words where the end is kept.  By its heavy paths, each node moves only its light subtrees: their
   words, with the character at the node skipped, replaced by the heavy one, or the heavy one put before it, meet the words of the trie, and with the
   character replaced by a blank place they meet each other.  A word is moved at most log2(words) times.  Terminals that coincide are near pairs.
3. Of its near words a word's form is the most frequent one, if that is ``ratio`` times as frequent; forms are followed to the root by doubling.

Defined results: null texts have no words; a null id counts as the empty text where it is hashed; repeated rows count each time; of equally frequent near words the
smallest in code-point order is the form; texts and words of any length count whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import spent, written

#: Letters: ASCII and the Latin-1 block from U+00C0 on.
LETTERS = "A-Za-z\u00c0-\u00ff"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a key from which its window is halved (more than a window of one place can hold), and words and characters of a task's trie.
MOST, TRIE_WORDS, TRIE_CHARS = 20_000, 40_000, 2_000_000


def runs(docs: DataFrame, least_length: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, run): the longest runs of letters of every text that have ``least_length`` code points, only A-Z in lower case."""
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    every = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    return every.select("doc", F.translate("run", CAPITALS, SMALL).alias("run"))


def slipped(one_in: int = 31) -> Column:
    """The run of (doc, run), without one code point where ``one_in`` divides the crc32 of ``<doc>:<run>``."""
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return F.when(h % one_in == 0, cut).otherwise(F.col("run"))


def word_counts(words: DataFrame, least_length: int = 7, least_n: int = 2) -> DataFrame:
    """(word, n) of a column ``word`` of occurrences."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _key(m: str, a: str, b: str) -> Column:
    """Key of a word as one of a pair whose shorter word has ``m`` code points and whose edit lies between places ``a`` and ``b``."""
    return F.expr(f"xxhash64({m}, {a}, {b}, substring(word, 1, {a}), substring(word, char_length(word) - ({m} - {b}) + 1, {m} - {b}))")


def keyed(words: DataFrame, most: int = MOST) -> DataFrame:
    """(key, back, word, n, m, a, b): every word (word, n) under the keys that its near words share; ``back`` for tries of reversed words."""
    both = words.select("word", "n", F.explode(F.expr("array(char_length(word), char_length(word) - 1)")).alias("m"))
    now = both.select("word", "n", "m", F.explode(F.expr("array(struct(0 as a, shiftright(m, 1) as b), struct(shiftright(m, 1) as a, m as b))")).alias("w")).select("word", "n", "m", "w.*")
    out = None
    while True:
        now = written(now.withColumn("key", _key("m", "a", "b")), "spelling-keys")
        large = now.where("b - a > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most).select("key")
        large = written(large, "spelling-large")
        if not large.take(1):
            return now if out is None else out.unionByName(now)
        done = now.join(large, "key", "left_anti")
        out = done if out is None else out.unionByName(done)
        halves = F.explode(F.expr("array(struct(a, shiftright(a + b, 1) as b), struct(shiftright(a + b, 1) as a, b))")).alias("w")
        now = now.join(large, "key", "left_semi").select("word", "n", "m", halves).select("word", "n", "m", "w.*")


def near_in_trie(words: dict[str, int]) -> set[tuple[str, str]]:
    """Near pairs of a set of words (word to the first place at which an edit is looked for)."""
    order = sorted(words)
    # the trie as ranges of the sorted words: (first, end, depth), the words agree before the depth
    found, open_ = set(), [(0, len(order), 0)]
    while open_:
        lo, hi, depth = open_.pop()
        if hi - lo < 2:
            continue
        first, last = order[lo], order[hi - 1]
        while depth < len(first) and first[depth] == last[depth]:  # a path without a branch
            depth += 1
        children, at = [], lo + (len(first) == depth)
        while at < hi:
            c = order[at][depth]
            end = _end(order, at, hi, depth, c)
            children.append((c, at, end))
            at = end
        open_ += [(a, z, depth + 1) for _, a, z in children]
        heavy = max(children, key=lambda x: x[2] - x[1])
        errata = defaultdict(list)  # rests of the light subtrees behind a blank place
        if len(first) == depth and words[first] <= depth and first + heavy[0] in words:
            found.add((first, first + heavy[0]))
        for child in children:
            if child is heavy:
                continue
            for word in order[child[1] : child[2]]:
                if words[word] > depth:
                    continue
                head, rest = word[:depth], word[depth + 1 :]
                for other in (head + rest, head + heavy[0] + rest, head + heavy[0] + word[depth:]):
                    if other in words:
                        found.add((word, other))
                errata[rest].append(word)
        for same in errata.values():
            found.update((same[i], same[j]) for i in range(len(same)) for j in range(i))
    return found


def _end(order: list[str], lo: int, hi: int, depth: int, c: str) -> int:
    """Where the words of ``order[lo:hi]`` with ``c`` at ``depth`` end."""
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if order[mid][depth] == c else (lo, mid)
    return lo


def _trie_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    n = dict(zip(pdf.word, pdf.n))
    for back, rows in pdf.groupby("back"):
        # an edit is looked for from the first place of the widest window that the word came with
        starts: dict[str, int] = {}
        for word, m, a, b in zip(rows.word, rows.m, rows.a, rows.b):
            word, start = (word[::-1], m - b) if back else (word, a)
            starts[word] = min(start, starts.get(word, start))
        for x, y in near_in_trie(starts):
            x, y = (x[::-1], y[::-1]) if back else (x, y)
            out += [(x, y, n[y]), (y, x, n[x])]
    return pd.DataFrame(out, columns=["word", "near", "near_n"]).drop_duplicates()


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, near, near_n): every near pair of ``words`` (word, n), once from each side."""
    rows = keyed(words, most).withColumn("back", F.expr("a = 0"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars")).first()
    buckets = 1 + max(size["n"] // TRIE_WORDS, size["chars"] // TRIE_CHARS)
    spread = rows.select(F.pmod("key", F.lit(buckets)).alias("bucket"), "back", "word", "n", "m", "a", "b")
    return spread.groupBy("bucket").applyInPandas(_trie_pairs, "word string, near string, near_n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last of the chain of forms.  Forms are ever more frequent, so chains end; each round halves what is left of them."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while now.where("moved").take(1):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = written(after, "spelling-roots")
        spent(now)
        now = after
    return now.select("word", "root")


def variants(words: DataFrame, ratio: int = 10, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n for the counted ``words`` (word, n)."""
    words = written(words, "spelling-words")
    near = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("near_n"), F.min_by("near", F.struct(-F.col("near_n"), F.col("near"))).alias("near"))
    known = written(words.join(near, "word", "left"), "spelling-near")
    is_form = F.col("near_n") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    last = roots(known.where("form is not null").select("word", "form"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, one_in: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`variants` of the letter runs of ``docs``, one of which loses a code point now and then (see :func:`slipped`)."""
    return variants(word_counts(runs(docs, id_col=id_col, text_col=text_col).select(slipped(one_in).alias("word"))))
