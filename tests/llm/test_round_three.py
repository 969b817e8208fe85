"""Exact dedup, token alignment and conversation repair against brute force; names that operators use inside; hot keys."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeline.llm import alignment, conversations, packing, pitman_yor, queries, token_files
from gradeline.llm.alignment import align_documents, aligner
from gradeline.llm.common import Words
from gradeline.llm.components import connected_components
from gradeline.llm.conversations import BLOCK, NEXT, START, WANTED, repair_report, solve, solve_short
from gradeline.llm.digest_index import MOST_SEGMENTS, DigestIndex, exact_groups
from gradeline.llm.ngram_join import jaccard_classes
from gradeline.llm.packing import pack, packed_sequences, pieces_of
from gradeline.llm.pitman_yor import score_texts
from gradeline.llm.token_files import read_token_files, write_token_files
from gradeline.llm.url_filter import url_filter
from gradeline.operators.versions import VersionTaken
from test_operators import plain_scores

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
LONG = "Ünd " + " ".join(f"w{k % 977}x{k % 31}" for k in range(20_000))
ODD = [(1, "The Cat"), (2, None), (3, ""), (4, " \n\t"), (None, "the cat"), (5, LONG), (6, LONG.upper()), (6, LONG), (6, LONG), (7, "<|endoftext|> <s> ünï © <0x0A>"), (8, "ÜND"), (9, "ünd"), (10, "a▁b"), (11, "x" * 30_000), (12, "ﬁ ①\x00"), (None, None)]
NAMES = ("_id", "_text", "_row", "_key", "_hash", "_salt", "_hot", "_full", "_group", "_part", "_number", "_before", "c", "conv", "c0", "c1", "digest", "keep_id", "copies", "codes", "code", "n_docs", "text_key", "rid", "pos", "block", "kind", "same", "label", "bucket", "key", "run", "many")


def clashes():
    """Columns of names that operators use themselves."""
    return {k: F.lit(1) for k in NAMES}


def same_as_sql(spark, name, tables, tmp_path):
    """The query's rows over these tables, and its SQL's."""
    db = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(str(tmp_path / f"{table}.parquet"))
        db.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    names = sorted(got.columns)
    want = db.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(n) for n in names]
    return sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr), sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


def lowered(text):
    return (text or "").encode().lower()


def test_exact_dedup_by_brute_force(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumns(clashes())
    for loads in (1, 2, 5):
        rows = exact_groups(docs, loads=loads).collect()
        groups = collections.defaultdict(list)
        for i, t in ODD:
            groups[hashlib.sha256(lowered(t)).digest()].append(i)
        largest = lambda ids: max((i for i in ids if i is not None), default=None)
        want = sorted(((i, largest(groups[d]), len(groups[d]), bytes(d)) for i, t in ODD for d in [hashlib.sha256(lowered(t)).digest()]), key=repr)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.digest)) for r in rows), key=repr) == want
        kept = collections.Counter(bytes(r.digest) for r in rows if r.kept)
        assert set(kept) == set(groups) and set(kept.values()) == {1} and all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert exact_groups(docs.filter("false")).count() == 0


def test_exact_dedup_equals_sql(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = docs.select((F.col("doc_id") + 1000).alias("doc_id"), F.upper("text").alias("text"))
    got, want = same_as_sql(spark, "op11_exact_dedup", {"documents": docs.unionAll(more)}, tmp_path)
    assert got == want and len(got) == 2 * docs.count()


def test_digest_index_lives_on(spark, tmp_path):
    folder = str(tmp_path / "index")
    make = lambda rows: spark.createDataFrame(rows, DOCS)
    index = DigestIndex(spark, folder, 4)
    exact_groups(make([(10, "a"), (11, "b"), (12, "A")]), index)
    # opened anew by its path: what was there stays, only new digests are appended
    again = DigestIndex(spark, folder)
    assert again.buckets == 4 and again.version == index.version
    rows = {(r.doc_id): (r.keep_id, r.group_size, r.kept) for r in exact_groups(make([(90, "B"), (91, "c"), (92, "c")]), again).collect()}
    assert rows == {90: (11, 2, False), 91: (92, 2, False), 92: (92, 2, True)}
    plan = again.tables()[0].join(again.tables()[1].select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    # two writers from one version: one is told so, and nothing of its load is read
    one, two = DigestIndex(spark, folder), DigestIndex(spark, folder)
    exact_groups(make([(1, "d")]), one, loads=1)
    with pytest.raises(VersionTaken):
        exact_groups(make([(2, "e")]), two, loads=1)
    assert DigestIndex(spark, folder).found().count() == 4
    with pytest.raises(ValueError, match="ids are"):
        exact_groups(spark.createDataFrame([("x", "f")], "doc_id string, text string"), DigestIndex(spark, folder))


def test_digest_index_merges_segments(spark, tmp_path, monkeypatch):
    from gradeline.llm import digest_index

    monkeypatch.setattr(digest_index, "MOST_SEGMENTS", 3)
    assert MOST_SEGMENTS > 3
    index = DigestIndex(spark, str(tmp_path / "i"), 2)
    for k in range(4):
        exact_groups(spark.createDataFrame([(k, "same"), (k + 50, f"t{k}")], DOCS), index, loads=1)
    assert len(index.segments) <= 4 and {r.copies for r in index.found().collect()} == {4, 1} and index.found().count() == 5


def test_hot_text_is_dealt_to_many_tasks(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    found = exact_groups(rows)
    assert found.filter("keep_id = 2997").count() == 1000 and found.filter("kept").count() == 2001


def plain_alignment(own, x):
    """By whole-text encoding with both libraries and one loop over bytes."""
    data = (" " + x).encode()
    a, b = own.a.encode(" " + x, add_special_tokens=False).ids, own.b.encode(x)
    if b"".join(own.a_bytes[k] for k in a) != data or b"".join(own.b_bytes[k] for k in b) != data:
        return None
    groups, ga, gb, at, to, i, j = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at <= to and i < len(a):
            at, ga, i = at + len(own.a_bytes[a[i]]), [*ga, a[i]], i + 1
        else:
            to, gb, j = to + len(own.b_bytes[b[j]]), [*gb, b[j]], j + 1
        if at == to:
            groups.append((ga, gb))
            ga, gb = [], []
    return a, b, groups


def plain_measures(own, rows):
    told = {x: plain_alignment(own, x) for x in {t for _, t in rows if t}}
    links = {x: collections.Counter((u, v) for ga, gb in t[2] for u in ga for v in gb) for x, t in told.items() if t}
    count = collections.Counter(p for _, x in rows if x in links for p in links[x])
    best = collections.defaultdict(int)
    for (u, _), n in count.items():
        best[u] = max(best[u], n)
    out = []
    for i, x in rows:
        t = told.get(x) if x else None
        if not t:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in t[2])
        out.append((i, len(t[0]), len(t[1]), len(t[2]), links[x].total(), sum(n for p, n in links[x].items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links[x].items()), hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_alignment_equals_whole_texts(spark, monkeypatch, tmp_path, limit):
    """Id pairs go to the tasks whole, or meet the links by shuffles: one result, that of the plain loops."""
    import public_tokenizers as P

    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", limit)
    rng = random.Random(limit)
    bits = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "\r\n", " \n ", "é", "\xa0", " ", "　", "▁", "<|endoftext|>", "<s>", "<0x0A>", "1", "123", "'s", "don't", "!!", "=====", "🎉", "ß", "\x85", "\x1c", "\x00", "你好", "ท", " The", "word", "-"]
    rows = [*ODD, *((100 + k, "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))) for k in range(300)), (999, "=" * 5000 + " " * 300 + "\n" * 200), (1000, "the cat")]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame(rows, DOCS).withColumns(clashes())
    docs.write.parquet(str(tmp_path / "d"))
    found = align_documents(spark.read.parquet(str(tmp_path / "d")))
    own = aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert found.columns == list(names)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_measures(own, rows)
    assert align_documents(docs.filter("false")).count() == 0


def test_alignment_forgets_without_a_trace(monkeypatch):
    import public_tokenizers as P

    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 900)}" for _ in range(50)) for _ in range(60)]
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    whole = alignment.Aligner(*paths).texts(pa.array(texts))
    monkeypatch.setattr(alignment, "MEMO_CHUNKS", 64)
    small = alignment.Aligner(*paths)
    parts = [small.texts(pa.array(texts[k : k + 5])) for k in range(0, 60, 5)]
    assert (np.concatenate([p[0] for p in parts]) == whole[0]).all() and sum((p[1] for p in parts), []) == whole[1]
    assert (np.concatenate([p[3] for p in parts]) == whole[3]).all()


def all_edits(turns, entry, goals, last):
    """Every sequence of edits with at most two insertions in a row, by recursion; the least (cost, audit)."""
    best = None

    def go(k, state, cost, audit, inserted):
        nonlocal best
        if k == len(turns) and state in goals and (best is None or (cost, audit, state) < best):
            best = (cost, audit, state)
        if inserted < 2 and (k < len(turns) or last):
            go(k, WANTED[state][1], cost + 5, audit + "I", inserted + 1)
        if k < len(turns):
            go(k + 1, state, cost + 2, audit + "D", 0)
            if turns[k] != "D":
                more = 5 if turns[k].isupper() else 0
                if (state, turns[k].lower()) in NEXT:
                    go(k + 1, NEXT[state, turns[k].lower()], cost + more, audit + "K", 0)
                go(k + 1, WANTED[state][1], cost + 1 + more, audit + "R", 0)

    go(0, entry, 0, "", 0)
    return best


def test_branch_and_bound_equals_all_edits():
    rng = random.Random(4)
    for k in range(1500):
        turns = "".join(rng.choice("suaxSUAXD" if k % 2 else "suuaaaUAD") for _ in range(rng.randint(0, 5)))
        entry, goals, last = rng.randrange(4), rng.choice([(0, 3), (0,), (1,), (2,), (3,)]), rng.random() < 0.5
        assert solve(turns, entry, goals, last) == solve_short(turns, entry, goals, last) == all_edits(turns, entry, goals, last), turns


def plain_table(turns, last=True):
    """Best (cost, audit) of a long run from the start, state by state."""
    best = {START: (0, "")}
    for c in turns:
        for _ in range(3):
            for q in list(best):
                t, v = WANTED[q][1], (best[q][0] + 5, best[q][1] + "I")
                best[t] = min(best.get(t, v), v)
        new = {}
        for q, (cost, audit) in best.items():
            ways = [(q, cost + 2, "D")]
            if c != "D":
                more = 5 if c.isupper() else 0
                ways += [(NEXT[q, c.lower()], cost + more, "K")] if (q, c.lower()) in NEXT else []
                ways.append((WANTED[q][1], cost + 1 + more, "R"))
            for t, x, letter in ways:
                new[t] = min(new.get(t, (x, audit + letter)), (x, audit + letter))
        best = new
    ends = [best[q] for q in (0, 3) if q in best]
    ends += [(best[2][0] + 5, best[2][1] + "I")] if 2 in best else []
    ends += [(best[1][0] + 10, best[1][1] + "II")] if 1 in best else []
    return min(ends)


TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_repair(rows):
    """The contract by loops; rows of (conv_id, turn, role, text)."""
    convs = collections.defaultdict(list)
    shown = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds, seen = [], set()
        for _, role, text in held:
            words = text.strip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "x" for r in held]
        codes = "".join("D" if k in ("blank", "duplicate") else i.upper() if k else i for k, i in zip(kinds, initials, strict=True))
        cost, audit = plain_table(codes)
        told, state, k = [], START, 0
        for c in audit:
            if c == "I":
                told.append(f"{WANTED[state][0]}:")
                state = WANTED[state][1]
                continue
            _, role, text = held[k]
            if c == "R":
                told.append(f"{WANTED[state][0]}:{text}")
                state = WANTED[state][1]
            if c == "K":
                told.append(f"{role}:{text}")
                state = NEXT[state, initials[k]]
            k += 1
        turns = {r[0] for r in held if r[0] is not None}
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_turns():
    rng = random.Random(6)
    roles = ["system", "user", "assistant", "user", "assistant", "", None, "unknown", "User", "tool"]
    texts = ["Yes.", "No", None, "", " \n", "Why?  ", "so it is!", "cut", "ok.", "Ends\t"]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in [*range(40), None] for _ in range(rng.randint(0, 9))]
    return [*rows, (50, 1, "user", LONG), (50, 2, "assistant", LONG + "."), (50, 2, "assistant", LONG + "."), (51, None, None, None), (52, 5, "system", "a."), (None, None, "user", "x.")]


def test_repair_by_plain_loops(spark, tmp_path):
    rows = odd_turns()
    df = spark.createDataFrame(rows, TURNS).withColumns(clashes())
    found = repair_report(df)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_repair(rows)
    assert repair_report(df.filter("false")).count() == 0
    got, want = same_as_sql(spark, "op13_conversation_repair", {"conversations": spark.createDataFrame(rows, TURNS)}, tmp_path)
    assert got == want


def test_repair_of_a_hot_conversation(spark, monkeypatch):
    """One of many thousand turns lies in several partitions and blocks, and comes out as if it were solved whole."""
    rng = random.Random(8)
    rows = [(7, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "No", "", f"t{k}.", f"u{k}!", f"v{k}"])) for k in range(5 * BLOCK)]
    rows += [(c, k, ["user", "assistant"][k % 2], f"{c} {k}.") for c in range(100, 160) for k in range(6)]
    df = spark.createDataFrame(rows, TURNS)
    held, turns = conversations.ordered_turns(conversations.damage(df))
    assert turns.filter("c = '=7'").select("block").distinct().count() > 4
    assert sorted((tuple(r) for r in repair_report(df).collect()), key=repr) == plain_repair(rows)


def test_packing_with_clashing_names(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    pieces = pieces_of(docs).withColumns(clashes() | {"c2": F.lit("z"), "c7": F.lit(None).cast("string")})
    packed = pack(pieces)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"] and packed.count() == pieces.count()
    assert {r.c2 for r in packed.collect()} == {"z"} and pack(pieces.filter("false")).count() == 0
    plain = pack(pieces_of(docs))
    key = lambda df: sorted((tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32", "offset").collect()), key=repr)
    assert key(packed) == key(plain)
    clash = docs.withColumns(clashes())
    whole = packed_sequences(clash).collect()
    assert sum(len(r.ids) for r in whole) == sum(s.length for r in whole for s in r.spans) == plain.agg(F.sum("length")).first()[0]
    assert packed_sequences(clash.filter("false")).count() == 0 and packing.GROUP > 0


def test_token_files_of_equal_ids(spark, tmp_path):
    """A third of all rows have no id: they go to several files, in order, and come back as often as they were."""
    rows = [(None if k % 3 else k, f"text {k % 40}") for k in range(600)] + [(5, "same")] * 50 + ODD
    docs = spark.createDataFrame(rows, DOCS).withColumns(clashes()).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = write_token_files(docs, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = read_token_files(spark, manifest).collect()
    assert len(manifest) >= 3 and len(back) == len(rows)
    whole = sorted(back, key=lambda r: r.start)
    assert [r.start for r in whole] == [0, *np.cumsum([r.n_tokens for r in whole])[:-1].tolist()]
    assert [r.doc_id for r in whole if r.doc_id is None] == [r.doc_id for r in whole][: sum(i is None for i, _ in rows)]
    ids = [r.doc_id for r in whole if r.doc_id is not None]
    assert ids == sorted(ids)
    enc = token_files.encoder(token_files.default_path())
    flat, at = enc.encode_ended(pa.array([t for _, t in rows]), 2)
    crc = collections.Counter((rows[k][0], zlib.crc32(flat[at[k] : at[k + 1]].astype("<u4").tobytes())) for k in range(len(rows)))
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in back) == crc
    assert write_token_files(docs.filter("false"), str(tmp_path / "e")) == []


def test_one_bucket_of_very_many_texts(spark):
    """Near copies that share bands fill one bucket; its members are dealt out and still find each other."""
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base, f"end{k}"])) for k in range(400)] + [(1000 + k, f"alone {k} " + " ".join(f"x{k}y{j}" for j in range(12))) for k in range(400)]
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(spark.createDataFrame(rows, DOCS).withColumns(clashes())).collect()}
    assert all(found[k] == (0, 399) for k in range(400)) and all(found[1000 + k] == (1000 + k, 0) for k in range(400))


def test_a_word_in_every_host(spark):
    """A common short word stands in a third of all hosts."""
    rows = [(k, f"http://{'the' if k % 3 == 0 else 'un'}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}shop.test/", "<p>the shop is fine</p>" if k % 2 else "<p>casino the shop</p>") for k in range(600)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").withColumns(clashes())
    found = url_filter(pages)
    assert found.count() == 600 and all("shop" in r.tokens for r in found.collect())
    assert all(r.tokens[0] == "the" for r in found.filter("page_id % 3 = 0").collect())



@pytest.mark.parametrize("owner_tokens", [2_000_000, 200, 60])
def test_pitman_yor_has_one_parent_a_word(spark, monkeypatch, owner_tokens):
    """A middle word has one restaurant, of all its owners, so scores are a plain sampler's however few tokens an owner takes."""
    monkeypatch.setattr(pitman_yor, "OWNER_TOKENS", owner_tokens)
    monkeypatch.setattr(pitman_yor, "TOGETHER", 5)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"W{int(k)}" for k in rng.zipf(1.6, rng.integers(0, 40)) % 12) for _ in range(14)] + ["w1 w1 w1 w1 " * 6, "", "zzz w1", None]
    learn = [k % 5 != 2 for k in range(len(texts))]
    expected = plain_scores([Words(pa.array([t], pa.string())).hashes(lower=True).tolist() for t in texts], learn, {})
    docs = spark.createDataFrame(list(zip(range(len(texts)), texts, learn, strict=True)), "doc_id bigint, text string, t boolean")
    got = {r.doc_id: r.score for r in score_texts(docs.repartition(3), F.col("t")).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(expected, abs=1e-4)


def test_pitman_yor_scores_do_not_depend_on_owners(spark, monkeypatch):
    """Equal scores to the last bit, with words dealt to several owners and without; texts' starts dealt out too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = []
    for owner_tokens in (2_000_000, 2000, 300):
        monkeypatch.setattr(pitman_yor, "OWNER_TOKENS", owner_tokens)
        found.append({r.doc_id: r.score for r in score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).collect()})
    assert found[0] == found[1] == found[2]


def test_components_keep_few_tasks_on_the_driver(spark):
    """Each task leaves an entry in the driver's memory: fewer than 80 rounds of the shuffle partitions (64, once 120) are run."""
    rng, parts, context = random.Random(5), 23, spark.sparkContext
    edges = [(k, k + 1) for k in range(30)] + [(1000 - k, 1000) for k in range(1, 300)] + [(2000, 2000 + k) for k in range(1, 300)] + [(3000 + rng.randrange(90), 3000 + rng.randrange(90)) for _ in range(70)]
    root = {k: k for e in edges for k in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if all(root[a] == root[b] for a, b in edges if a != b):
            break
    held = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("components", "")
        found = connected_components(spark.createDataFrame(edges, "a int, b int"))
        status = context.statusTracker()
        stages = {s for j in status.getJobIdsForGroup("components") for s in status.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)
        rows = [(r.node, r.component) for r in found.collect()]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == len(root) and dict(rows) == root
    assert 0 < tasks < 80 * parts
