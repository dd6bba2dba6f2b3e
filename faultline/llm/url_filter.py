"""URL verdicts: explicit rules first, then naive Bayes over segmented host names and paths.

* The longest rule that fits decides. Rules are a short list given by the caller.
* Host names are cut at dots, hyphens and digits, and what runs together is segmented by
  Viterbi under a unigram model of words, counted over the pages' text and the
  hyphenated parts of hosts. Words reach a part by a join of its substrings with the counts, so that the model
  may be as large as the corpus makes it.
* Multinomial naive Bayes scores the tokens. Pages whose segmented host holds one of a few
  seed words train the class to block, the others the class to allow. Every token has its
  own counts; they reach the pages by a join on the token. Tokens that are more than one in
  ``OFTEN`` of all, fewer than ``OFTEN`` in number, are joined by broadcast, so that no task gets all rows of one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.line_dedup import LOWER, UPPER
from faultline.session import store

Rule = tuple[str, str, str]  # verdict, host, path
LONGEST = 24  # letters of a word
OFTEN = 1000
SEEN = 16.0  # tokens of each class taken as seen beforehand, spread over all distinct tokens
#: Words in a host name that mark pages to block, for training only.
SEEDS = ("adult", "ads", "bet", "bets", "betting", "casino", "cheap", "gambling", "jackpot", "loan", "loans", "malware", "phish", "pills", "poker", "porn",
         "replica", "scam", "sex", "slots", "spam", "torrent", "tracker", "viagra", "warez", "xxx")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls; of equally long ones the first given."""
    name = verdict = F.lit(None).cast("string")
    for said, rule_host, rule_path in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def _runs(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z]+"), lambda w: w != "")


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """word, n: how often each run of letters stands in the pages' text, and in hosts between hyphens.

    A host counts once, and its labels without a hyphen do not: they may be what is to be
    segmented.
    """
    text = F.regexp_replace(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "<[^>]*>", " ")
    words = pages.select(F.explode(_runs(text)).alias("word"))
    labels = pages.select("host").distinct().select(F.explode(F.split("host", "[.]")).alias("label")).filter(F.col("label").contains("-"))
    words = words.union(labels.select(F.explode(_runs(F.col("label"))).alias("word")))
    return words.filter(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def split_word(part: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """The most probable words of a run of letters. ``known``: log probability by start and length.

    An unknown word has ten times less probability per letter; of equal ways the one with longer last words.
    """
    n = len(part)
    best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
    rare = -np.log(total + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST), end):
            size = end - start
            score = best[start] + known.get((start, size), rare - size * np.log(10))
            if score > best[end]:
                best[end], back[end] = score, start
    words: list[str] = []
    while n:
        words.append(part[back[n] : n])
        n = back[n]
    return words[::-1]


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) of each distinct host: its parts, cut into words."""
    total = float(counts.agg(F.sum("n")).first()[0] or 0)
    parts = hosts.select("host", F.posexplode(_runs(F.col("host"))).alias("place", "part"))
    each = parts.select("part").distinct()
    spans = each.select("part", F.explode(F.sequence(F.lit(1), F.length("part"))).alias("start"))
    spans = spans.select("part", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("part") - F.col("start") + 1))).alias("size"))
    spans = spans.withColumn("word", F.substring(F.col("part"), F.col("start"), F.col("size")))
    met = spans.join(counts, "word").groupBy("part").agg(F.collect_list(F.struct("start", "size", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for part, found in zip(batch.column("part").to_pylist(), batch.column("spans").to_pylist()):
                known = {(s["start"] - 1, s["size"]): float(np.log(s["n"] / total)) for s in found or []}
                words.append(split_word(part, known, total))
            yield pa.record_batch([batch.column("part"), pa.array(words, pa.list_(pa.string()))], ["part", "words"])

    split = each.join(met, "part", "left").mapInArrow(run, "part string, words array<string>")
    rows = parts.join(split, "part").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("rows"))
    return rows.select("host", F.flatten(F.transform("rows", lambda r: r["words"])).alias("words"))


def token_weights(tokens: DataFrame) -> DataFrame:
    """(token, n, weight) of each distinct token of ``tokens`` (token, seeded): its count and its log odds of the class to block."""
    each = tokens.groupBy("token").agg(F.count_if("seeded").alias("block"), F.count("*").alias("n"))
    each = store(each, "token_counts")
    sums = each.agg(F.count("*").alias("kinds"), F.sum("block").alias("block"), F.sum("n").alias("n")).first()
    block, total = sums.block or 0, sums.n or 0
    before = SEEN / max(1, sums.kinds)
    share = lambda count, of: (count + F.lit(before)) / F.lit(of + SEEN)
    weight = F.log(share(F.col("block"), block)) - F.log(share(F.col("n") - F.col("block"), total - block))
    return each.select("token", "n", weight.alias("weight"))


def url_filter(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seeds: Sequence[str] = SEEDS) -> DataFrame:
    """(id, host, path, rule, verdict, score, words): a row per page.

    ``rule`` is null where none fits; there the verdict is block if the log odds ``score``
    of naive Bayes are above 0, else allow. ``words`` are the segmented host's.

    A null url, or one without ``://``, has an empty host and path, no words, and the score
    of the classes' shares alone. A null id is carried along; repeated rows are judged each
    and count each. A null page text counts no words. Other columns are not read. An empty
    table gives an empty one; without any seed in the hosts everything unruled is allowed.
    """
    host, path = url_parts(F.col(url_col).cast("string"))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col))
    counts = store(word_counts(parts, html_col), "words")
    urls = parts.select("id", "host", "path")
    hosts = store(segmented(urls.select("host").distinct(), counts), "hosts")
    tokens = F.filter(F.split(F.regexp_replace(F.lower("path"), "[0-9]+", "#"), "[^a-z#]+"), lambda t: t != "")
    known = urls.join(hosts, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    known = known.withColumn("seeded", F.arrays_overlap("words", F.array(*[F.lit(s) for s in seeds])))
    known = known.withColumn("tokens", F.concat(F.transform("words", lambda w: F.concat(F.lit("host:"), w)), tokens))
    scored = store(known.withColumn("row", F.monotonically_increasing_id()), "tokens")
    sizes = {r.seeded: r.n for r in scored.groupBy("seeded").agg(F.count("*").alias("n")).collect()}  # two rows
    prior = float(np.log((sizes.get(True, 0) + 0.5) / (sizes.get(False, 0) + 0.5))) if sizes.get(True) else -np.inf
    each = scored.select("row", "seeded", F.explode("tokens").alias("token"))
    weights = store(token_weights(each), "weights")
    total = weights.agg(F.sum("n")).first()[0] or 0
    often = weights.filter(F.col("n") * OFTEN > total).select("token", "weight")  # fewer than OFTEN rows
    rest = weights.filter(F.col("n") * OFTEN <= total).select("token", "weight")
    met = each.join(F.broadcast(often.withColumnRenamed("weight", "known")), "token", "left").select("row", "token", "known")
    met = met.filter("known is not null").select("row", F.col("known").alias("weight")).union(met.filter("known is null").join(rest, "token").select("row", "weight"))
    # sorted, so that a sum does not depend on the order in which rows arrive
    sums = met.groupBy("row").agg(F.aggregate(F.sort_array(F.collect_list("weight")), F.lit(0.0), lambda a, x: a + x).alias("sum"))
    judged = scored.join(sums, "row", "left").withColumn("score", F.coalesce("sum", F.lit(0.0)) + F.lit(prior))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score", "words")
