"""Each operator against brute force on small tables, and on nulls, empty and repeated rows, clashing names, no rows."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from gradeline.llm import mixing, ngram_join, pitman_yor, queries, tokens
from gradeline.llm import url_filter as url_filter_module
from gradeline.llm.common import Words, held_out
from gradeline.llm.components import connected_components
from gradeline.llm.grid_join import near_vectors
from gradeline.llm.mixing import mix_plan, mix_sources
from gradeline.llm.ngram_join import choose_bands, drop_near_copies, jaccard_classes
from gradeline.llm.packing import best_fit, local_search, pack, packed_sequences, pieces_of
from gradeline.llm.pitman_yor import score_texts
from gradeline.llm.quality import descend, fit_quality, labelled_texts, score_quality
from gradeline.llm.rules import quality_rules
from gradeline.llm.substring import first_minima, remove_repeats, repeated_words
from gradeline.llm.token_files import TokenFile, read_token_files, write_token_files
from gradeline.llm.tokens import WordEncoder, default_path
from gradeline.llm.url_filter import url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(20_000))
ROWS = [(1, "the cat sat on the mat and looked at the dog " * 3, "en", "a", 1), (2, None, "en", None, None), (3, "", None, "a", 0), (4, " \n\t", "en", "b", 1), (None, "no id here at all", "en", "b", 1), (5, LONG, "en", "b", 1), (6, LONG, "en", "b", 1), (6, LONG, "en", "b", 1), (7, "<|endoftext|> ünï ©", "en", "c", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a long text, repeated rows, and columns whose names operators use themselves."""
    return spark.createDataFrame(ROWS, DOCS).withColumns({"size": F.lit("s"), "component": F.lit("c"), "links": F.lit(1), "key": F.lit("k"), "label": F.lit("l"), "score": F.lit("z"), "kept": F.lit("y"), "piece": F.lit("p"), "_source": F.lit(1), "text_key": F.lit(2), "_text": F.lit(3), "_words": F.lit(4), "_id": F.lit(5), "_key": F.lit(6), "_copies": F.lit(7), "c0": F.lit(8), "c1": F.lit(9), "rows": F.lit(0)})


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def test_mixing(spark, odd, none, monkeypatch):
    plan = mix_plan(odd)
    rows = plan.select("doc_id", F.col("size"), "source_size", "target", "copies").collect()
    assert len(rows) == len(ROWS) and all(0 <= r.copies <= 3 for r in rows)
    assert sum({r.source_size: r.target for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert mix_sources(odd).columns == odd.columns
    assert mix_sources(odd).count() == sum(r.copies for r in rows)
    assert sorted(map(str, mix_plan(odd).select("doc_id", "copies").collect())) == sorted(map(str, plan.select("doc_id", "copies").collect()))
    assert mix_plan(none).count() == mix_sources(none).count() == 0
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mix_plan(odd).select("doc_id", "size", "target", "copies").collect())) == sorted(map(str, plan.select("doc_id", "size", "target", "copies").collect()))


def test_mixing_chances(spark):
    """Over many seeds a document gets its extra copy about as often as its source's fraction says."""
    docs = spark.createDataFrame([(k, "w " * (1 + k % 9), "ab"[k % 2]) for k in range(60)], "doc_id long, text string, source string")
    seeds = 20
    plans = [mix_plan(docs, seed=k) for k in range(seeds)]
    rows = [r for p in plans for r in p.collect()]
    for source in (0, 1):
        mine = [r for r in rows if r.doc_id % 2 == source]
        rate = mine[0].target / mine[0].source_size
        assert np.mean([r.copies for r in mine]) == pytest.approx(rate, abs=0.06)
        assert all({r.copies for r in mine if r.doc_id == k} <= {math.floor(rate), math.ceil(rate)} for k in range(60))


def test_rules(spark, odd, none):
    rows = {r.doc_id: r for r in quality_rules(odd).collect()}
    assert rows[2].n_words == rows[3].n_words == rows[4].n_words == 0 and rows[2].base_failed
    assert rows[1].n_words == 33 and rows[1].base_failed
    assert rows[5].n_words == 20_000 and quality_rules(odd).count() == len(ROWS) and quality_rules(none).count() == 0


def plain_url_filter(rows):
    """Segmentation over all splits and Bayes sums by loops; rows of (id, url, html)."""
    letters = lambda t, n: re.findall(rf"[a-z]{{{n},}}|[0-9]+", t)
    text = {i: [w for w in letters(re.sub(r"<[^>]*>", " ", h or "").lower(), 2) if w.isalpha()] for i, _, h in rows}
    counts = collections.Counter(w for i, _, _ in rows for w in text[i])
    total = sum(counts.values())
    unseen = -math.log(total + 1) - 1

    def split(run):
        cost = lambda s: (sum(math.log(counts[p] / total) if p in counts else unseen * (1 + len(p)) for p in s), -len(s))
        return max(all_splits(run), key=cost)

    tokens = {}
    for i, url, _ in rows:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups() if url and "://" in url else ("", "")
        tokens[i] = [p for part in (host, path) for r in letters(part.lower(), 1) for p in (split(r) if r.isalpha() else ["0"])]
    block = {i: bool(set(t) & set(url_filter_module.BLOCK_WORDS)) for i, t in text.items() if t}
    n = {c: collections.Counter(w for i, _, _ in rows if block.get(i) is c for w in tokens[i]) for c in (True, False)}
    size = len(n[True] + n[False]) + 1
    pages = {c: sum(block.get(i) is c for i, _, _ in rows) for c in (True, False)}
    weight = lambda w: math.log((n[True][w] + 1) / (n[True].total() + size)) - math.log((n[False][w] + 1) / (n[False].total() + size))
    return tokens, {i: math.log((pages[True] + 1) / (pages[False] + 1)) + sum(map(weight, tokens[i])) for i in tokens}


def test_url_filter(spark):
    good = [(20 + k, f"http://www.{h}.test/a{k}/news.html", "<p>daily news and garden notes</p>") for k, h in enumerate(["news", "garden", "dailynews", "notes", "newsnotes", "a-b"])]
    rows = [(1, "http://A.example.NET/en/x?q", None), (2, None, "<p>cheap pills casino</p>"), (3, "no scheme", ""), (4, "https://casinowin.example.com/de/", "x"), (5, "https://cheappills.test/p#f", "<b>cheap</b> pills win"), (5, "https://cheappills.test/p#f", "<b>cheap</b> pills win"), (6, "https://blog.site.org/fr/1", ""), (7, "https://cheapwin.test", None), (8, "https://gardennotes.test/" + "news/" * 300, None), *good]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").withColumns({"key": F.lit(1), "runs": F.lit(2), "word": F.lit(3), "host": F.lit(4), "c0": F.lit(5)})
    rows_ = {r.page_id: r for r in url_filter(pages).collect()}
    assert (rows_[1].host, rows_[1].path, rows_[1].rule, rows_[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert rows_[2].host == rows_[3].host == "" and rows_[2].rule is None
    assert (rows_[4].rule, rows_[4].verdict) == ("example.com/de/", "block") and (rows_[6].rule, rows_[6].verdict) == ("org/fr/", "allow")
    # 7 and 8 are held out: they teach nothing, their hosts are new, their words are not
    assert rows_[5].tokens[:2] == ["cheap", "pills"] and rows_[5].verdict == rows_[7].verdict == "block" and rows_[8].verdict == "allow"
    assert url_filter(pages).count() == len(rows) and url_filter(pages.filter("false")).count() == 0
    assert sorted(url_filter(pages).columns) == sorted({*pages.columns, "path", "rule", "verdict", "tokens", "log_odds"}) and rows_[5]["key"] == 1 and rows_[5]["c0"] == 5
    tokens, odds = plain_url_filter(rows)
    assert {i: r.tokens for i, r in rows_.items()} == tokens and {i: r.log_odds for i, r in rows_.items()} == pytest.approx(odds)
    ties = [("a.test/", "allow"), ("a.test/", "block")]
    assert [url_filter(spark.createDataFrame([(1, "http://a.test/", "x")], "page_id int, url string, html string"), rules=r).first().verdict for r in (ties, ties[::-1])] == ["block", "allow"]


def all_splits(text):
    return [[text[:k], *rest] for k in range(1, len(text) + 1) for rest in all_splits(text[k:])] if text else [[]]


def test_url_filter_finds_long_words(spark, monkeypatch):
    word, strange = "donaudampfschifffahrtsgesellschaft", "q" * 60
    pages = spark.createDataFrame([(1, f"http://alte{word}wien.at/{strange}", f"<p>alte {word} wien {word}x</p>")], "page_id bigint, url string, html string")
    assert url_filter(pages).first().tokens == ["alte", word, "wien", "at", strange]
    monkeypatch.setattr(url_filter_module, "LONGEST", 2)
    rng = np.random.default_rng(0)
    for _ in range(100):
        text = "".join(rng.choice(list("ab"), 9))
        logp = {text[a : a + n]: -float(rng.uniform(1, 6)) for a, n in zip(rng.integers(0, 8, 6), rng.integers(1, 7, 6), strict=True)}
        split, score = url_filter_module._viterbi(text, logp, -7.0), lambda s: sum(logp.get(p, -7.0 * (1 + len(p))) for p in s)
        assert "".join(split) == text and score(split) == pytest.approx(max(map(score, all_splits(text))))


def test_quality(spark, odd, none):
    labels = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    out = {r.doc_id: r for r in queries.op3_quality(spark, f"{SF}/../sf0.01").collect()}
    right = [out[r.doc_id].predicted == r.quality for r in labels.collect() if out[r.doc_id].held_out]
    assert len(out) == docs.count() and sum(right) / len(right) > 0.9
    labelled = spark.createDataFrame([(1, "good words here", 1), (2, "bad bad bad bad", 0), (3, None, 1), (4, "x", None), (None, "x", 1)], "doc_id bigint, text string, quality int")
    model = fit_quality(labelled)
    scored = score_quality(odd, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert score_quality(none, model).count() == 0
    one = fit_quality(labelled.filter("quality = 1"))
    assert score_quality(odd, one).agg(F.min("score")).first()[0] > 0.9 and 0 < fit_quality(labelled.filter("false")).scores([""])[0] < 1


def brute_classes(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := (t or "").split())}
    links = collections.defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    root = {i: i for i in texts}
    for _ in texts:
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in texts}
    return {i: (root[i], len(links[i])) for i in texts}


def test_quality_solver():
    """Coordinate descent ends where projected gradient steps on the dense dual problem end."""
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(12, rng.integers(1, 7), replace=False)) for _ in range(30)]
    y, ratio = np.where(rng.random(30) < 0.4, 1.0, -1.0), rng.normal(size=12)
    x = np.zeros((30, 13))
    for k, r in enumerate(rows):
        x[k, r], x[k, 12] = ratio[r] / np.sqrt(len(r)), 1
    upper = np.where(y > 0, 30 / (2 * (y > 0).sum()), 30 / (2 * (y < 0).sum()))
    q, alpha = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(30)
    for _ in range(200_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, upper)
    w = (alpha * y) @ x
    got, bias = descend(rows, y, ratio, 1.0, 3000)
    assert np.append(got, bias) == pytest.approx(np.append(w[:12] * ratio, w[12]), abs=1e-3)


def test_quality_label_ties(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    assert sorted(map(tuple, labelled_texts(docs, labels, F.lit(True)).collect())) == [(1, "a", 0), (2, "b", 1)]


def test_ngram_join(spark, odd, none):
    texts = {r.doc_id: r.text for r in docs_of(spark).collect()}
    base = [f"t{k}" for k in range(120)]
    texts |= {10_000 + k: " ".join(w if n % 29 != k % 29 else f"v{k}" for n, w in enumerate(base)) for k in range(12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(df).collect()} == brute_classes(texts)
    rows = jaccard_classes(odd).collect()
    assert len(rows) == len(ROWS) and sorted((r.class_id, r.n_links) for r in rows if r.doc_id in (5, 6)) == [(5, 2)] * 3
    left = drop_near_copies(odd)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert drop_near_copies(none).count() == jaccard_classes(none).count() == 0
    bands, per = choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**per) ** bands >= 0.999


def test_ngram_join_by_bucket(spark, monkeypatch):
    """Labels of several blocks, and labels so wide that they are compared bucket by bucket, lose and repeat no link."""
    rng = np.random.default_rng(9)
    base = [f"t{k}" for k in range(90)]
    texts = {k: " ".join(f"v{k}x{j}" if rng.random() < 0.025 else w for j, w in enumerate(base[:60 + 3 * (k % 11)])) for k in range(70)}
    df, expected = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), brute_classes(texts)
    assert 1 < len({c for c, _ in expected.values()}) < 70
    for block, wide in ((8, 100), (8, 1), (100, 0)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "WIDE", wide)
        assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(df, recall=0.99999).collect()} == expected


def test_ngram_join_sends_a_text_once(spark, monkeypatch):
    base = [f"w{k}" for k in range(100)]
    texts = {"a": " ".join(base), "b": " ".join([*base[:-1], "other"])}
    rows = [(None, texts["a"])] * 40 + [(5, texts["a"])] * 20 + [(6, texts["b"])]
    sent, send = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, *a: sent.append(self._df.count()) or send(self, *a))
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).groupBy("doc_id", "class_id", "n_links").count().collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 5, 60, 40), (5, 5, 60, 20), (6, 5, 60, 1)], key=str)
    assert sent == [2]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_packing(spark, odd, none):
    for seed in range(4):
        lengths = np.random.default_rng(seed).integers(1, 700, 300)
        first, steps = best_fit(lengths, 1000), []
        bins = local_search(first, lengths, 1000, steps)
        assert sorted(k for b in bins for k in b) == list(range(300)) and all(lengths[b].sum() <= 1000 for b in bins)
        # the search, not the first placing, makes the result: every step raises the squared fill, and bins empty
        assert len(bins) < len(first) and len(bins) <= -(-lengths.sum() // 1000) + 1
        assert steps and all(gain > 0 for _, gain in steps) and [n for n, _ in steps] == sorted((n for n, _ in steps), reverse=True) and steps[-1][0] == len(bins)
    held = pack(pieces_of(odd)).collect()
    assert sum(r.length for r in held if r.doc_id == 2) == 1
    by = collections.defaultdict(list)
    for r in held:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 2048 and all(o == sum(n for _, n in sorted(v)[:k]) for k, (o, _) in enumerate(sorted(v))) for v in by.values())
    assert pack(pieces_of(none)).count() == 0
    whole = packed_sequences(odd.filter("doc_id in (1, 2, 7)")).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in held if r.doc_id in (1, 2, 7))


def test_packing_tries_every_giver():
    # {3} can give nothing; a 4 of {4, 4} for a 3 of {3, 3, 3} opens the room that it needs
    lengths = np.array([4, 4, 3, 3, 3, 3])  # as given, best fit makes {4, 4}, {3, 3, 3}, {3}
    assert len(best_fit(lengths, 10)) == 3
    bins = local_search(best_fit(lengths, 10), lengths, 10)
    assert sorted(k for b in bins for k in b) == list(range(6)) and [lengths[b].sum() for b in bins] == [10, 10]


def test_packing_spreads_repeated_rows(spark):
    rows = [(None, 0, 0, 10, 5)] * 300 + [(k, 0, 0, 10, k) for k in range(100)]
    placed = []
    for parts in (3, 5):
        held = pack(spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").repartition(parts), 100, group=40).collect()
        assert collections.Counter(tuple(r)[:5] for r in held) == collections.Counter(rows)
        assert max(collections.Counter(r.sequence_id >> 32 for r in held).values()) < 80
        placed.append(sorted((r.sequence_id, r.offset, r.ids_crc32) for r in held))
    assert placed[0] == placed[1]


def test_encoder_equals_library(monkeypatch):
    e = WordEncoder(default_path())
    texts = [r[1] or "" for r in ROWS] + ["a<|startoftext|>b", "É é́ ﬁ  it's 12ab", "Word. WORD word?! wOrd's. ©. a&&&. é. ß.\u0338 x.\u0338 y\u0301. <|ENDOFTEXT|>. <|endoftext|>a. I'S. ... 12. ..a, ΑΣ. a.b."]
    signs, draw = "abcXYZäÖüßñéÉ'’sStdmlrv0123²½ªµ.,-!?#<|> \u0085İııſΣσς漢字é\u200b\u001f\ufeff😀 \t\n\x0b\x0c\r", np.random.default_rng(5)
    texts += ["".join(draw.choice(list(signs), draw.integers(40))) for _ in range(2000)]
    monkeypatch.setattr(tokens, "MEMO_WORDS", 3000)
    for _ in range(2):
        ids, at = e.encode(pa.array([None, *texts]).slice(1))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_refuses_tokens_with_spaces():
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_files(spark, odd, none):
    manifest = write_token_files(odd)
    rows = read_token_files(spark, manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 7]
    e = WordEncoder(default_path())
    text = {r[0]: r[1] for r in ROWS}
    at = 0
    for r in rows:
        ids = np.append(e.encode(pa.array([text[r.doc_id]], pa.string()))[0], 2).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    ids, mask = TokenFile(manifest[-1]["path"]).sequence(0)
    assert len(ids) == len(mask) == 2048 and not ids.flags.owndata
    assert write_token_files(none) == [] and read_token_files(spark, []).count() == 0


def test_substring(spark, odd, none):
    common = " ".join(f"c{k}" for k in range(60))
    texts = {1: f"a b {common} d", 2: f"{common} e f", 3: " ".join(f"u{k}" for k in range(80)), 4: " ".join([*(f"r{k}" for k in range(36)), "z", *(f"r{k}" for k in range(36))]), 5: " ".join(f"c{k}" for k in range(34)), 6: None, 7: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    cut_texts = {r.doc_id: r.text for r in remove_repeats(df).collect()}
    assert cut_texts == {1: "a b d", 2: "e f", 3: texts[3], 4: "z", 5: texts[5], 6: None, 7: ""}
    assert {(r.n_words, r.n_removed) for r in repeated_words(df).collect()} == {(63, 60), (62, 60), (80, 0), (73, 72), (34, 0)}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("texts_")]
    assert remove_repeats(odd).columns == odd.columns and remove_repeats(odd).count() == len(ROWS) and remove_repeats(none).count() == 0


def test_first_minima():
    h = np.random.default_rng(2).integers(0, 9, 200).astype(np.uint64)
    for size in (1, 2, 18, 27):
        assert first_minima(h, size).tolist() == [k + int(h[k : k + size].argmin()) for k in range(201 - size)]


def test_pitman_yor(spark, odd, none):
    rows = {r.doc_id: r for r in score_texts(docs_of(spark), ~held_out(F.col("doc_id"), 7)).collect()}
    split = lambda t: [*(t or "").encode().lower().split(), None]
    texts = {r.doc_id: split(r.text) for r in docs_of(spark).collect()}
    seen = collections.Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    total = sum(seen.values())
    for i, t in texts.items():
        base = sum(math.log10((seen[w] + 1) / (total + len(seen) + 1)) for w in t)
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(t), sum(w in seen for w in t), total) and rows[i].base_score == pytest.approx(base)
    out = [i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(rows[i].score for i in out) > sum(rows[i].base_score for i in out)
    assert score_texts(odd, F.col("doc_id") != 1).count() == len(ROWS) and score_texts(none, F.lit(True)).count() == 0
    assert score_texts(odd, F.lit(False)).filter("n_known > 0").count() == 0


MASK = (1 << 64) - 1


def mix(x):
    x &= MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_seat(c, others, share, d, key, sweep):
    t = min(c, 1)
    for k in range(1, c):
        drawn = (mix(key + mix(k * 0xD6E8FEB86659FD93 + (sweep + 1) * 0x9E3779B97F4A7C15)) >> 11) * 2.0**-53
        a = (pitman_yor.THETA + d * (others + t)) * share
        t += drawn * (a + k - d * t) < a
    return t


def plain_scores(texts, learn, shards):
    """The sampler with one dictionary for each restaurant, one customer at a time. texts: lists of hashes."""
    start, end = pitman_yor.START, pitman_yor.END
    rows = [[(mix(([start, start] + t)[k]) >> 48, ([start, start] + t)[k + 1], w >> 24) for k, w in enumerate(t)] for t in ([*t, end] for t in texts)]
    seen = collections.Counter(x[2] for r, l in zip(rows, learn, strict=True) if l for x in r)
    base = lambda w: (seen[w] + 1) / (sum(seen.values()) + len(seen) + 1)
    part = lambda u, v: u % shards.get(v, 1)
    c2 = collections.Counter(x for r, l in zip(rows, learn, strict=True) if l for x in r)
    t2 = dict.fromkeys(c2, 1)

    def tables():
        out = collections.Counter()
        for (u, v, w), t in t2.items():
            out[(v, part(u, v)), w] += t
        return out

    c1 = tables()
    t1 = dict.fromkeys(c1, 1)

    def discount(counts, group):
        n1, n2 = collections.Counter(), collections.Counter()
        for x, c in counts.items():
            n1[group(x)] += c == 1
            n2[group(x)] += c == 2
        k = pitman_yor.PRIOR_WEIGHT
        return lambda g: min(0.95, max(0.05, (n1[g] + pitman_yor.PRIOR * k) / (n1[g] + 2 * n2[g] + k)))

    of = lambda x: (x[1], part(x[0], x[1]))
    d2, d1 = discount(c2, of), discount(c1, lambda x: x[0])
    within = lambda held, q: sum(t for x, t in held.items() if x[0] == q)
    here = lambda held, x: sum(t for y, t in held.items() if y[:2] == x[:2])
    theta, total = pitman_yor.THETA, collections.Counter()
    for sweep in range(pitman_yor.BURN + pitman_yor.KEEP):
        drawn = {}
        for x, c in c2.items():
            u, v, w = x
            q, own = of(x), t2[x]
            rest = c1[q, w] - own
            held = min(t1[q, w], rest)
            share = (max(rest - d1(q) * held, 0) + (theta + d1(q) * (within(t1, q) - t1[q, w] + held)) * base(w)) / (theta + within(c1, q) - own)
            drawn[x] = plain_seat(c, here(t2, x) - own, share, d2(q), mix(mix(mix(u) + v) + w), 2 * sweep) if c > 1 else 1
        t2 = drawn
        c1 = tables()
        t1 = {x: min(t, c1[x]) for x, t in t1.items()}
        t1 = {(q, w): plain_seat(c, within(t1, q) - t1[q, w], base(w), d1(q), mix(mix(mix(q[0]) + q[1]) + w), 2 * sweep + 1) for (q, w), c in c1.items()}
        if sweep >= pitman_yor.BURN:
            for x in {x for r in rows for x in r}:
                q, w = of(x), x[2]
                up = (max(c1[q, w] - d1(q) * t1.get((q, w), 0), 0) + (theta + d1(q) * within(t1, q)) * base(w)) / (theta + within(c1, q))
                total[x] += (max(c2[x] - d2(q) * t2.get(x, 0), 0) + (theta + d2(q) * here(t2, x)) * up) / (theta + here(c2, x))
    return [sum(math.log10(total[x] / pitman_yor.KEEP) for x in r) for r in rows]


@pytest.mark.parametrize("owner_tokens", [2_000_000, 60])
def test_pitman_yor_equals_plain_sampler(spark, monkeypatch, owner_tokens):
    """Scores are those of a sampler of plain loops, whatever partitions, owners and hot words there are."""
    monkeypatch.setattr(pitman_yor, "OWNER_TOKENS", owner_tokens)
    monkeypatch.setattr(pitman_yor, "TOGETHER", 5)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"W{int(k)}" for k in rng.zipf(1.6, rng.integers(0, 40)) % 12) for _ in range(14)] + ["w1 w1 w1 w1 " * 6, "", "zzz w1"]
    learn = [k % 5 != 2 for k in range(len(texts))]
    hashed = [Words(pa.array([t])).hashes(lower=True).tolist() for t in texts]
    every = collections.Counter(w for t in hashed for w in [*t, pitman_yor.START, pitman_yor.END])
    limit = owner_tokens // 2
    expected = plain_scores(hashed, learn, {w: -(-n // limit) for w, n in every.items() if n > limit and w != pitman_yor.END})
    docs = spark.createDataFrame(list(zip(range(len(texts)), texts, learn, strict=True)), "doc_id bigint, text string, t boolean")
    for parts in (4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r.doc_id: r.score for r in score_texts(docs.repartition(parts), F.col("t")).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert [got[k] for k in range(len(texts))] == pytest.approx(expected, abs=1e-4)


def test_pitman_yor_sums_to_one():
    words = np.arange(3, 13, dtype=np.uint64)
    rng = np.random.default_rng(1)
    u, v, w = rng.integers(0, 3, (3, 400))
    seen = np.bincount(w, minlength=9)
    base = np.append((seen + 1) / (400 + 3 + 1), 0)[:10]
    base[3:9], base[9] = 0, 1 - base[:3].sum()
    ask = np.arange(10)
    rows = [np.concatenate([x, np.full(10, y)]) for x, y in ((u, 1), (v, 2))] + [np.concatenate([w, ask])]
    found = pitman_yor.log_probabilities(*rows, np.repeat([1, 0], [400, 10]), words, words, np.maximum(base, 1e-300), np.ones(10, np.int64))
    assert (10 ** found[400:]).sum() == pytest.approx(1)


def test_pitman_yor_prefers_seen_words(spark):
    """Of words after the same two the seen one scores best, a known one next, an unknown one last; a text seen twice scores above one seen once."""
    rng = np.random.default_rng(5)
    twice, once = (" ".join(f"{c}{k}" for k in rng.integers(0, 300, 60)) for c in "xy")
    train = [(k, "a b a c a b", True) for k in range(3)] + [(9, "b c d", True), (10, twice, True), (11, twice, True), (12, once, True)]
    asked = [(100 + k, f"a {w}", False) for k, w in enumerate(["a", "b", "c", "d", "zzz"])]
    df = spark.createDataFrame(train + asked, "doc_id bigint, text string, t boolean")
    rows = {r.doc_id: r for r in score_texts(df, F.col("t")).collect()}
    assert rows[101].score > rows[103].score > rows[104].score and rows[10].score > rows[12].score + 10


def test_grid_join(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16))
    x = [(centres[k % 8] + rng.normal(size=16) * 0.2).tolist() for k in range(300)]
    rows = [(k, v, k % 3) for k, v in enumerate(x)] + [(300, x[0], 0), (301, [0.0] * 16, 0), (302, None, 0), (303, x[1], None), (304, [float("nan")] * 16, 0), (305, [1.0, 2.0], 0), (306, [], 0), (None, x[0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({"links": F.lit(1), "component": F.lit("x")})
    good = [(i, np.array(v) / np.linalg.norm(v), g) for i, v, g in rows if i is not None and g is not None and v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    links = {i: [j for j, w, h in good if j != i and g == h and v @ w >= 0.93] for i, v, g in good}
    root = {i: i for i in links}
    for _ in range(50):
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in links}
    for r in near_vectors(df).collect():
        assert (r.n_links, r.component_id, r.kept) == (len(links.get(r.vec_id, [])), root.get(r.vec_id, r.vec_id), r.vec_id is not None and root.get(r.vec_id, r.vec_id) == r.vec_id)
    assert near_vectors(df.filter("false")).count() == 0 and near_vectors(df).columns[:5] == df.columns


def brute_removed(texts, window=35):
    """Texts without the words of windows that start more than once; texts without such windows as they are."""
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    starts = collections.Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if starts[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        out[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else texts[i]
    return out


def test_pipeline(spark, tmp_path):
    """The pieces of run() against plain loops over the same stages; repetition against the SQL of op2 on what is left."""
    import corpus_pipeline

    sf = SF
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    model = fit_quality(labelled_texts(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), F.col("doc_id").isNotNull()))
    texts = {i: r.text for i, r in docs.items() if model.scores([r.text])[0] >= queries.GOOD}
    classes = brute_classes(texts)
    texts = brute_removed({i: t for i, t in texts.items() if not (t or "").split() or classes[i][0] == i})
    texts = {i: t for i, t in texts.items() if (t or "").encode().split()}
    spark.createDataFrame([(i, t, docs[i].source) for i, t in texts.items()], "doc_id bigint, text string, source string").toPandas().to_parquet(tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    copies = {i: taken // size for i, size, taken in db.sql(f"select doc_id, size, taken from ({queries.ORACLE_SQL['op2_mixing']})").fetchall()}
    e, want = WordEncoder(default_path()), collections.Counter()
    for i, t in texts.items():
        ids = np.append(e.encode(pa.array([t], pa.string()))[0], 0).astype("<u4")
        for n, s in enumerate(range(0, len(ids), 2048)):
            want[i, n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += copies[i]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == +want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048


def test_pipeline_takes_odd_rows(spark, odd, none, tmp_path):
    """Every stage on nulls, blanks, a long text, repeated rows and clashing names, and on no rows."""
    import corpus_pipeline

    for name, docs in (("odd", odd), ("none", none)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 0), (6, 1, 0), (3, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        found = {}
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            assert k == 4 or out.columns == docs.columns
            found[stage] = out.collect()
        if name == "none":
            assert not any(found.values()) and corpus_pipeline.run(spark, folder).count() == 0
        else:
            assert sorted(r.doc_id or 0 for r in found["n-gram jaccard join"]) == [0, 1, 2, 3, 4, 5, 7]
            assert {r.doc_id for r in found["substring dedup"]} == {None, 1, 7} and sum(r.length for r in found["best-fit packing"] if r.doc_id == 2) == 1
            corpus_pipeline.run(spark, folder).collect()
