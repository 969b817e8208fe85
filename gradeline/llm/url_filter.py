"""URL filter: hosts are segmented into words by a unigram Viterbi search; multinomial naive Bayes judges the tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import cut, join_copies

BLOCK, ALLOW = "block", "allow"

#: (rule, verdict): a host with a path prefix. A rule fits the host and all its subdomains.
DEFAULT_RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))

#: A page whose visible text holds one of these words is a labelled row of the class block; other pages with text are of allow.
BLOCK_WORDS = tuple("adult porn sex xxx casino casinos bet bets betting poker slots gambling pills pharma viagra cialis spam farm ads track tracker tracking popup malware phishing warez crack keygen torrent escort loan loans payday cheap free win jackpot replica".split())

#: Longest pieces of a run that are all looked up; a longer word is found by its first LONGEST letters.
LONGEST = 24


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host up to `/`, `?`, `#` or the end with A-Z lower-cased; the path up to `?`, `#` or the end."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null; of equally long ones the last given."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def runs(text: Column) -> Column:
    """The runs of letters, and of digits as `0`, in a host or path, lower-cased."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"\p{N}+", "0"), F.lit(r"(\p{L}+|0)"))


def page_words(html: Column) -> Column:
    """Lower-cased words of at least two letters of the visible text of a page."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_extract_all(F.lower(bare), F.lit(r"(\p{L}{2,})"))


def _viterbi(text: str, logp: dict[str, float], unseen: float) -> list[str]:
    """The split with the highest sum of log probabilities; an unseen piece costs `unseen` a letter. Ties: fewer pieces.

    Pieces of any length are tried. Of starts more than LONGEST letters back the best for an unseen piece is carried along,
    as each further letter costs the same for all; known words that long are tried one by one.
    """
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    long = sorted({len(w) for w in logp if len(w) > LONGEST})
    far: int | None = None

    def piece(start: int, end: int, p: float | None) -> tuple[float, int, int]:
        return best[start][0] + (unseen * (1 + end - start) if p is None else p), -best[start][1] - 1, start

    for end in range(1, len(text) + 1):
        options = [piece(start, end, logp.get(text[start:end])) for start in range(max(0, end - LONGEST), end)]
        if end > LONGEST:
            gone = piece(end - LONGEST - 1, end, None)
            if far is not None:
                gone = max(gone, piece(far, end, None))
            far = gone[2]
            options.append(gone)
            for n in long:
                if n <= end and text[end - n : end] in logp:
                    options.append(piece(end - n, end, logp[text[end - n : end]]))
        score, pieces, start = max(options)
        best.append((score, -pieces, start))
    out, end = [], len(text)
    while end:
        start = best[end][2]
        out.append(text[start:end])
        end = start
    return out[::-1]


def segment(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """`names` (distinct runs of letters `run`, and how many there are, `many`) with `pieces`, by Viterbi over unigram counts
    (`word`, `n`).

    Every substring of a run of 2 to LONGEST letters meets the words that begin with it (a shorter word: that are it) in
    a join, longer words are kept where the run holds them whole, and each run gathers only its own known substrings; so
    neither vocabulary nor runs are broadcast, and words of any length are found. Very long runs cost LONGEST substrings a
    letter.
    """
    spans = names.filter(F.length("run") > 1).select("run", F.explode(F.sequence(F.lit(1), F.length("run") - 1)).alias("_a"))
    spans = spans.select("run", F.explode(F.transform(F.sequence(F.lit(2), F.least(F.lit(LONGEST), F.length("run") - F.col("_a") + 1)), lambda n: F.substring(F.col("run"), F.col("_a"), n))).alias("_start"))
    begun = counts.withColumn("_start", F.substring("word", 1, LONGEST))
    known = spans.distinct().join(begun, "_start").filter((F.col("word") == F.col("_start")) | F.col("run").contains(F.col("word")))
    known = known.groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    unseen = -math.log(total + 1.0) - 1.0

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pieces = [_viterbi(r, {x["word"]: math.log(x["n"] / total) for x in k} if k is not None else {}, unseen) for r, k in zip(b["run"], b["known"], strict=True)]
            yield pd.DataFrame({"run": b["run"], "many": b["many"], "pieces": pieces})

    return names.join(known, "run", "left").mapInPandas(split, "run string, many bigint, pieces array<string>")


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str], ...] = DEFAULT_RULES, block_words: tuple[str, ...] = BLOCK_WORDS, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Judge every url: adds `host`, `path`, `rule`, `verdict`, `tokens` and `log_odds` (block over allow).

    1. Unigram counts: words of all pages' visible text.
    2. Distinct runs of letters of hosts and paths are split into words (`segment`).
    3. Labelled rows: all pages with visible text; block if it holds a block word, else allow. The labels come from the
       text, the tokens from the url. Token counts per class over all of them give multinomial naive Bayes with add-one
       smoothing and class priors.
    4. The rule that fits decides; else block if the log odds are above 0.

    Null urls and urls without `://` have empty host and path and no tokens; the priors decide. Pages without text are
    judged, but teach nothing. Repeated rows are judged alike, and each counts. Of equally long rules the last given wins.
    Long urls are read whole. Input columns of the added names are replaced, others stay whatever their names. An empty
    table gives an empty result. Work is per distinct sequence of runs; the pages are joined once by its hash.
    """
    added = ("host", "path", "rule", "verdict", "tokens", "log_odds")
    outer = [c for c in pages.columns if c not in added]
    inner = pages.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(outer)])
    url, html = (F.col(f"c{outer.index(c)}") for c in (url_col, html_col))
    host, path = url_parts(url)
    parsed = inner.withColumns({"host": host, "path": path}).withColumn("runs", F.concat(runs(F.col("host")), runs(F.col("path"))))
    parsed = parsed.withColumn("key", F.unhex(F.md5(F.array_join("runs", " ").cast("binary"))))

    counts = cut(inner.select(F.explode(page_words(html)).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    words = page_words(html)
    label = F.when(F.size(words) > 0, F.arrays_overlap(words, F.array(*map(F.lit, block_words))))
    shapes = parsed.withColumn("_block", label).groupBy("key").agg(F.first("runs").alias("runs"), F.count("*").alias("n_pages"), F.count_if(F.col("_block")).alias("b"), F.count_if(~F.col("_block")).alias("a"))
    shapes = cut(shapes)
    names = shapes.select(F.explode("runs").alias("run")).filter("run != '0'").groupBy("run").agg(F.count("*").alias("many"))
    pieces = cut(segment(names, counts, total))
    # one row per run of a shape, in order; the commonest runs stand in most shapes
    listed = join_copies(shapes.select("key", F.posexplode("runs").alias("at", "run")), pieces, "run", "many", "left").withColumn("pieces", F.coalesce("pieces", F.array("run")))
    tokens = listed.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "pieces"))), lambda x: x["pieces"])).alias("tokens"))
    shaped = cut(shapes.drop("runs").join(tokens, "key", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))))

    each = shaped.select("key", "b", "a", F.explode("tokens").alias("word"))
    table = cut(each.groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("many")))
    known = table.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count_if(F.col("a") + F.col("b") > 0)).first()
    labelled = shaped.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    prior = math.log((labelled[0] + 1) / (labelled[1] + 1))
    weight = F.log((F.col("b") + 1) / F.lit(float(known[0] + known[2] + 1))) - F.log((F.col("a") + 1) / F.lit(float(known[1] + known[2] + 1)))
    odds = join_copies(each.select("key", "word"), table.select("word", "many", weight.alias("w")), "word", "many").groupBy("key").agg(F.sum("w").alias("w"))
    scored = cut(shaped.select("key", "n_pages", "tokens").join(odds, "key", "left").withColumn("log_odds", F.round(F.lit(prior) + F.coalesce("w", F.lit(0.0)), 9)).drop("w"))

    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(ruled, F.when(F.col("log_odds") > 0, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    judged = join_copies(parsed, scored, "key", "n_pages")
    return judged.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(outer)], "host", "path", rule.alias("rule"), verdict.alias("verdict"), "tokens", "log_odds")
