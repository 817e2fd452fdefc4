"""URL filters: rules first, then a naive Bayes model over segmented names.

Rules name a host (with its subdomains) and the start of a path; the longest rule
that fits decides. For all other urls, host and path are turned into words and a
multinomial naive Bayes model gives the verdict.

Words of a host: labels are split at everything that is no letter (of any script), then
names are split by the most likely sequence of words (Viterbi over word counts of the
corpus). Which stretches of a
name are words is found by a join of all stretches with the counts, so no word list is
sent to the tasks. A word has up to ``MAX_WORD`` letters, as many as a label of a host
name may have at all.

The model learns from all urls: those whose host holds a word of ``SEED_BLOCK``
(as a whole segment) are examples to block, the others to allow. Its counts are
aggregates over the whole table. Both classes are smoothed towards the words' overall
shares, so a rare word that neither class owns weighs nothing. Words that often stand
beside those of the list on other hosts or in paths get weights of their own, so hosts
without a listed word can be blocked, and a listed word may be outweighed.

Defined results: a null url or one without ``://`` has an empty host and path, fits
no rule and is allowed; a host without words is scored by its path and the classes'
odds; repeated rows and null ids are kept row by row; an empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import cut, hint_few, perhaps_in

#: Words whose presence in a host marks an example to block: fixed values.
SEED_BLOCK = (
    "ad", "ads", "adult", "bet", "bets", "betting", "casino", "cheap", "clickbait", "escort", "farm", "gambling",
    "jackpot", "loan", "loans", "lottery", "malware", "phishing", "pills", "poker", "porn", "slots", "spam", "track",
    "tracker", "viagra", "warez", "win", "xxx",
)
#: Words of rules' top-level names and of hosts that say nothing by themselves.
COMMON_LABELS = ("www", "m", "blog")
MAX_WORD = 63
PRIOR = 10.0  # tokens of the overall shares that each class gets besides its own
FEW_PAGES = 50_000  # different pages whose scores are broadcast
SEED_COUNT = 1000  # what the word counts give a seed word at least


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path, both '' without ``://``."""
    has = url.contains("://")
    rest = F.when(has, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; ``rules``: (verdict, 'host/path')."""
    longest_first = sorted(rules, key=lambda r: -len(r[1]))

    def fits(rule: str) -> Column:
        name, start = rule.split("/", 1)
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)

    rule = reduce(lambda c, r: c.when(fits(r[1]), F.lit(r[1])), longest_first, F.when(F.lit(False), F.lit(None).cast("string")))
    verdict = reduce(lambda c, r: c.when(fits(r[1]), F.lit(r[0])), longest_first, F.when(F.lit(False), F.lit(None).cast("string")))
    return rule, verdict


# ------------------------------------------------------------- segmentation


def word_counts(texts: DataFrame, col: str) -> DataFrame:
    """word, n over all texts: runs of letters outside of tags."""
    words = F.split(F.lower(F.regexp_replace(col, r"<[^>]*>", " ")), r"\P{L}+")
    words = texts.select(F.explode(words).alias("word")).where(F.length("word").between(1, MAX_WORD))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def segment_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name, words: each distinct ``name`` split into its most likely words.

    A stretch without a count is a word of its own at a price that grows with its
    length, so every name has a split. Stretches carry a digest of their name, so that a
    long one is not repeated, and only those that a filter of fixed size lets pass as
    words of ``counts`` are shuffled.
    """
    names = names.withColumn("key", F.md5("name"))
    rest = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.struct(i.alias("at"), F.substring("name", i, F.lit(MAX_WORD)).alias("rest")))
    cuts = names.select("key", F.inline(rest)).select("key", "at", "rest", F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("len"))
    cuts = cuts.select("key", "at", "len", F.substring("rest", F.lit(1), F.col("len")).alias("word"))
    cuts = perhaps_in(cuts, counts, "word").where("perhaps").drop("perhaps")
    total = counts.agg(F.sum("n")).first()[0] or 1
    known = cuts.join(counts, "word").groupBy("key")
    per_name = known.agg(F.collect_list(F.struct("at", "len", (F.log("n") - log(total)).alias("score"))).alias("known"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [_best_split(name, [] if known is None else known, total) for name, known in zip(b["name"], b["known"])]
            yield pd.DataFrame({"name": b["name"], "words": words})

    return names.join(per_name, "key", "left").select("name", "known").mapInPandas(split, "name string, words array<string>")


def _best_split(name: str, known: list, total: int) -> list[str]:
    """Unigram Viterbi over one name (distinct names are few beside urls)."""
    score = {(k["at"] - 1, k["len"]): k["score"] for k in known}
    best = [0.0] + [float("-inf")] * len(name)
    back = [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for begin in range(max(0, end - MAX_WORD), end):
            n = end - begin
            new = best[begin] + score.get((begin, n), -log(max(total, 2)) - 3.0 * n)
            if new > best[end]:
                best[end], back[end] = new, begin
    out, at = [], len(name)
    while at:
        out.append(name[back[at] : at])
        at = back[at]
    return out[::-1]


def url_words(urls: DataFrame, corpus: DataFrame, corpus_col: str) -> DataFrame:
    """host, words: the segmented words of each distinct ``host``."""
    hosts = cut(urls.select("host").where("host <> ''").distinct())
    labels = F.filter(F.regexp_extract_all(F.lower("host"), F.lit(r"\p{L}+"), F.lit(0)), lambda x: ~x.isin(*COMMON_LABELS))
    parts = hosts.select("host", F.posexplode(labels).alias("pos", "name"))
    seeds = hosts.sparkSession.createDataFrame([(w, SEED_COUNT) for w in SEED_BLOCK], "word string, n long")
    counts = word_counts(corpus, corpus_col).unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts)  # read twice, as large as the vocabulary
    split = segment_names(cut(parts.select("name").distinct()), counts)
    joined = parts.join(split, "name").groupBy("host")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "words")))
    return joined.agg(F.flatten(F.transform(ordered, lambda x: x["words"])).alias("words"))


# ------------------------------------------------------------- naive Bayes


def naive_bayes(examples: DataFrame) -> tuple[DataFrame, float]:
    """token, weight (log P(token | block) - log P(token | allow)), and the log odds of
    the classes. ``examples``: tokens (array), block (boolean), n (how many rows are so)."""
    of = lambda block: F.coalesce(F.sum(F.when(F.col("block") == block, F.col("n"))), F.lit(0))
    n = examples.agg(of(True).alias("b"), of(False).alias("a")).first()
    tokens = examples.select("block", "n", F.explode("tokens").alias("token"))
    per = tokens.groupBy("token").agg(of(True).alias("b"), of(False).alias("a"))
    per = cut(per)
    sums = per.agg(F.sum("b").alias("b"), F.sum("a").alias("a")).first()
    sb, sa = float(sums["b"] or 0), float(sums["a"] or 0)
    share = (F.col("a") + F.col("b")) / F.lit(max(sa + sb, 1.0))
    p = lambda c, s: F.log((F.col(c) + PRIOR * share) / F.lit(s + PRIOR))
    return per.select("token", (p("b", sb) - p("a", sa)).alias("weight")), log((n["b"] + 1.0) / (n["a"] + 1.0))


def judge_urls(urls: DataFrame, rules: list[tuple[str, str]], corpus: DataFrame, corpus_col: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule, verdict, words and score (NB log odds; null where
    a rule decides) of every row."""
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    # Counted per distinct host and path: what repeats is scored once and joined back.
    words = cut(url_words(rows, corpus, corpus_col))
    block = F.exists("words", lambda w: w.isin(*SEED_BLOCK))
    path_words = F.regexp_extract_all(F.lower("path"), F.lit(r"\p{L}+"), F.lit(0))
    path_tokens = F.transform(path_words, lambda x: F.concat(F.lit("/"), x))
    distinct = rows.groupBy("host", path_tokens.alias("ptokens")).agg(F.count("*").alias("n"))
    # A host without words of its own (an address, other letters) is judged by its path.
    distinct = distinct.where("host <> ''").join(words, "host", "left")
    distinct = cut(distinct.withColumn("words", F.coalesce("words", F.array().cast("array<string>"))))
    tokens = F.concat("words", "ptokens")
    weights, odds = naive_bayes(distinct.select(tokens.alias("tokens"), block.alias("block"), "n"))
    # Common words are hot keys of this join, common hosts of the last one.
    scored = distinct.select("host", "ptokens", F.explode_outer(tokens).alias("token")).join(hint_few(weights), "token", "left")
    scored = scored.groupBy("host", "ptokens").agg((F.coalesce(F.sum("weight"), F.lit(0.0)) + odds).alias("score"))
    scored = scored.join(words, "host", "left").select("host", "ptokens", "words", "score")
    out = rows.withColumn("ptokens", path_tokens).join(hint_few(cut(scored), FEW_PAGES), ["host", "ptokens"], "left")
    guess = F.when(F.coalesce("score", F.lit(-1.0)) > 0, "block").otherwise("allow")
    return out.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", guess).alias("verdict"),
        F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.when(F.col("by_rule").isNull(), F.col("score")).alias("score"),
    )
