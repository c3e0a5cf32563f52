"""Packing, ranked search and periodic runs against plain versions, and odd inputs."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperflow.llm import packing, periodic, search
from paperflow.llm.queries import QUERIES

from .conftest import FOLDER, SCHEMA, frame, long_text

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
ODD = [(2001, None, "a"), (2002, "", "a"), (2003, "one two three", None), (2003, "one two three", None), (None, "no id here", "b"),
       (None, "no id here", "b"), (2005, " \n\t ", ""), (2008, "a\0b   é", "a"), (2009, "  x \n\n y  <|endoftext|> z ", "a"), (-7, "the the the", "a")]


def prose(r, n):
    return " ".join(r.choice(["the", "of", "Water", "mill", "stone,", "über", "1999", "went\n", "don't", f"w{r.randrange(300)}"]) for _ in range(n))


# ------------------------------------------------------------------ packing

@functools.cache
def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def plain_ids(text):
    return [*whole_tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def test_packing_covers_every_token_once(spark):
    r = random.Random(1)
    rows = [(i, prose(r, r.choice([0, 3, 40, 200, 900, 1500])), "s") for i in range(150)] + ODD + [(3000, long_text(9000), "s")]
    got = packing.pack_documents(frame(spark, rows).repartition(5), TOKENIZER).collect()
    by_doc = {}
    for g in got:
        by_doc.setdefault(g.doc_id, []).append(g)
    for i, text, _ in rows:
        copies = sum(1 for x in rows if x[0] == i)
        pieces = sorted(by_doc[i], key=lambda g: g.piece)
        ids = plain_ids(text)
        assert len(pieces) == copies * -(-len(ids) // 2048)
        for g in pieces:
            assert g.length <= 2048 and np.frombuffer(g.ids, "<u4").tolist() == ids[g.start:g.start + g.length]
            assert zlib.crc32(g.ids) == g.ids_crc32
            assert g.length == 2048 or g.piece == 0
        assert sum(g.length for g in pieces) == copies * len(ids)
    bins = {}
    for g in got:
        bins.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(bins) <= 1.05 * sum(g.length for g in got) / 2048 + 1


def test_tables_of_ranks_say_the_same_as_the_tokenizer(spark):
    encode = packing.TextEncoder(TOKENIZER)
    assert encode.ranked is not None and packing.TextEncoder(public_word_file()).ranked is None
    texts = [d.text or "" for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    texts += ["", " ", "  a  b\t\n c ", "don't  can't've", "x\u00a0y\u2003z\u0085", "1999\u00b2\u00bd 12,5%", "\u4e2d\u6587 text \U0001f600", "a<|endoftext|>b", "\x00\x1c \x1f", "ÀÉÎ ſ ǅ ñ'll"]
    texts.append(" ".join(texts[:400]) * 3)  # cut into parts
    ids, counts = encode(texts, 7)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == [*whole_tokenizer().encode(text, add_special_tokens=False).ids, 7]
    assert len(encode.parts(texts[-1])) > 1


def public_word_file():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def one_bin_at_a_time(lengths, capacity):
    """The rule over single pieces."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], capacity
        while fit := [x for x in left if x <= gap]:
            own.append(fit[0])
            left.remove(fit[0])
            gap -= fit[0]
        if gap and len(own) > 1:
            small, best = own[-1], None
            for k, a in enumerate(left):
                for b in left[k + 1:]:
                    if small < a + b <= gap + small and (best is None or a + b > sum(best)):
                        best = a, b
            if best:
                own.pop()
                left.remove(best[0])
                left.remove(best[1])
                left = sorted([*left, small], reverse=True)
                own += best
        bins.append(own)
    return bins


def test_plan_follows_the_rule_bin_by_bin():
    r = random.Random(2)
    for _ in range(150):
        capacity = r.choice([12, 30, 64])
        lengths = [r.randrange(1, capacity + 1) for _ in range(r.randrange(0, 60))]
        plan = packing.plan_bins(Counter(lengths), capacity)
        held = {}
        for length, _, each, times, sequence, _ in plan:
            for s in range(sequence, sequence + times):
                held.setdefault(s, []).extend([length] * each)
        want = one_bin_at_a_time(lengths, capacity)
        assert [sum(held[s]) for s in sorted(held)] == [sum(b) for b in want]
        assert Counter(x for own in held.values() for x in own) == Counter(lengths)


def test_the_swap_beats_the_greedy_bin():
    # 6 + 3 leaves 1; taking out 3 makes room for 2 + 2.
    held, _ = packing.fill_bin(np.bincount([6, 3, 2, 2], minlength=11), 10)
    assert held == {6: 1, 2: 2}


def test_a_hot_length_is_spread_and_sequences_are_read_back(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text")).repartition(16)
    packed = packing.pack_documents(docs, TOKENIZER).cache()
    assert packed.select("sequence_id", "offset").distinct().count() == 3000
    size = len(plain_ids("same words here"))
    assert packed.agg(F.countDistinct("sequence_id")).first()[0] == -(-3000 // (2048 // size))
    back = packing.sequences(packed).collect()
    assert all(len(b.ids) == 4 * b.n_ids and len(b.documents) * size == b.n_ids for b in back)
    packed.unpersist()


def test_packing_of_an_empty_table_and_of_other_tokenizers(spark, nothing):
    assert packing.pack_documents(nothing, TOKENIZER).count() == 0
    import public_tokenizers
    from tokenizers import Tokenizer

    other = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(other)
    ids, counts = packing.TextEncoder(other)(["Ein  Wort, two"], 0)
    assert ids.tolist() == [*whole.encode("Ein  Wort, two", add_special_tokens=False).ids, 0] and counts.tolist() == [len(ids)]


# ------------------------------------------------------------------ ranked search

def plain_search(docs, items, k=50):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    split = [(i, Counter(cut(t))) for i, t in docs]
    split = [(i, c) for i, c in split if c]
    n_docs, n_terms = len(split), sum(c.total() for _, c in split)
    df = Counter(t for _, c in split for t in c)
    asked, out = {}, {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    for item, terms in asked.items():
        scores = []
        for i, c in split:
            m = 50 + 50 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1):
            out.setdefault(item, []).append((rank, i, -s))
    return {i: rows for i, rows in out.items() if rows}


def found(rows):
    out = {}
    for g in rows:
        out.setdefault(g.item_id, []).append((g["rank"], g.doc_id, g.score))
    return {i: sorted(x) for i, x in out.items()}


@pytest.mark.parametrize("postings,k", [(1 << 20, 50), (300, 5), (40, 3)])
def test_search_equals_plain_scoring(spark, monkeypatch, postings, k):
    monkeypatch.setattr(search, "SHARD_POSTINGS", postings)
    r = random.Random(4)
    vocabulary = [f"t{int(r.paretovariate(0.4)) % 500}" for _ in range(4000)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 5, 30, 120]))), "s") for i in range(400)]
    docs += [(1000 + i, docs[7][1], "s") for i in range(80)] + ODD + [(5000, long_text(30_000), "s")]  # ties, odd rows, a long text
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 20, 60])))) for i in range(25)]
    items += [(30, docs[7][1]), (31, None), (32, ""), (33, "unseen words only"), (34, "The"), (34, "one TWO"), (None, "no id"), (36, docs[7][1]), (36, docs[7][1])]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x")).withColumn("score", F.lit("y"))
    got = search.search_documents(frame(spark, docs).repartition(3), asked, k)
    assert found(got.collect()) == plain_search([(i, t) for i, t, _ in docs], items, k)


def test_search_in_blocks_of_items_and_with_text_ids(spark):
    docs = [(i, f"red {'blue' if i % 3 else 'green'} n{i}", "s") for i in range(60)]
    items = [(f"q{i}", f"n{i} green") for i in range(20)]
    asked = spark.createDataFrame(items, "item_id string, text string")
    got = search.search_documents(frame(spark, docs), asked, 7, block_terms=6)
    assert found(got.collect()) == plain_search([(i, t) for i, t, _ in docs], items, 7)


def test_search_of_empty_tables(spark, nothing):
    asked = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert search.search_documents(nothing, asked).count() == 0
    assert search.search_documents(frame(spark, [(1, "word", "s")]), asked.limit(0)).count() == 0
    assert search.search_documents(frame(spark, [(1, None, "s"), (2, "--", "s")]), asked).count() == 0


def test_accumulators_stop_and_survivors_stay_exact():
    """Common terms make no accumulators once the rare ones decide, and the scores still hold them."""
    n = 2000
    rare = [0] * n
    for i in range(10):
        rare[i] = 1
    terms, counts, ends = [], [], []
    for i in range(n):
        terms += [0, 1] if rare[i] else [1]
        counts += [9, 1] if rare[i] else [1]
        ends.append(len(terms))
    row = {"doc_ids": list(range(n)), "sizes": [2] * n, "ends": ends, "terms": np.array(terms, "<i4").tobytes(), "counts": np.array(counts, "<i8").tobytes()}
    shard = search.Shard(row, np.array([5000, 3]), n, 2 * n)
    survivors, scores = search.search_shard(shard, np.array([0, 1]), 5, 0)
    assert survivors.tolist() == list(range(10))
    assert scores.tolist() == [int(shard.gain[2 * i] + shard.gain[2 * i + 1]) for i in range(10)]


# ------------------------------------------------------------------ periodic runs

def plain_runs(words, least=12):
    met = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - s + p >= max(least, 2 * p):
                met.setdefault((s, i + p), p)
            i += 1
    return sorted(((s, e - s, p) for (s, e), p in met.items()), key=lambda x: (x[0], x[2]))


def kept_words(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def looping_texts(r, n):
    for _ in range(n):
        words = [f"w{r.randrange(r.choice([1, 2, 3, 40]))}" for _ in range(r.choice([0, 3, 14, 60, 200]))]
        if words and r.random() < 0.5:
            words += words[:r.randrange(1, len(words) + 1)] * r.randrange(1, 5)
        yield r.choice([" ", "\n", " \t "]).join(words)


def test_the_cover_is_a_perfect_difference_set():
    assert sorted((a - b) % periodic.MODULUS for a in periodic.COVER for b in periodic.COVER if a != b) == list(range(1, periodic.MODULUS))


def test_extensions_equal_word_by_word_comparison():
    r = random.Random(5)
    for n in (1, 31, 32, 200, 700):
        words = np.array([r.randrange(2) if n < 700 or i % 350 < 340 else 7 for i in range(n)] + [9])
        words[n // 2:n] = words[:n - n // 2]
        ext = periodic.Extensions(words)
        pairs = [(i, j) for i in range(0, n, max(1, n // 60)) for j in range(i + 1, n, max(1, n // 60))]
        i, j = np.array(pairs or [(0, 1)]).T
        want = [next((t for t in range(n + 1) if b + t > n or words[a + t] != words[b + t]), 0) for a, b in zip(i, j)]
        assert ext(i, j).tolist() == want


def test_runs_equal_brute_force(spark):
    r = random.Random(6)
    texts = list(looping_texts(r, 200)) + ["x " * 3000, " ".join(f"w{i % 700}" for i in range(3000)), " ".join(f"v{i}" for i in range(40)) + " go" * 11]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + ODD + [(9000, "a b c " * 5, "s")] * 2
    got = periodic.periodic_runs(frame(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(words)
        want[i, len(words), tuple(runs), kept_words(words, runs)] += 1
    assert Counter((g.doc_id, g.n_words, tuple(tuple(x) for x in g.runs), bytes(g.kept).decode()) for g in got) == want


def test_runs_of_a_very_long_text_and_an_empty_table(spark, nothing):
    assert periodic.periodic_runs(nothing).count() == 0
    half = long_text(60_000)
    g = periodic.periodic_runs(frame(spark, [(1, f"{half} {half}", "s"), (2, half, "s")])).orderBy("doc_id").collect()
    assert [tuple(x) for x in g[0].runs] == [(0, 120_000, 60_000)] and bytes(g[0].kept).decode() == half and g[1].runs == []


def test_query_equals_the_contract_read_plainly(spark):
    got = {g.doc_id: g for g in QUERIES["op13_cover_runs"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        o = got[d.doc_id]
        assert (o.n_runs, o.start, o.length, o.period) == (len(runs), *(best or (None, None, None)))
        assert o.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert o.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert o.collapsed_sha256 == hashlib.sha256(kept_words(words, runs).encode()).hexdigest()


def test_packing_query_equals_the_contract_read_plainly(spark):
    got = QUERIES["op11_best_two_fit"](spark, FOLDER).collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    ids = {i: plain_ids(t) for i, t in docs.items()}
    total = sum(map(len, ids.values()))
    assert sum(g.length for g in got) == total
    for g in got:
        own = np.array(ids[g.doc_id][g.start:g.start + g.length], "<u4")
        assert len(own) == g.length and zlib.crc32(own.tobytes()) == g.ids_crc32
    assert len({g.sequence_id for g in got}) <= 1.02 * total / 2048 + 2


def test_schema_of_extra_columns_is_not_looked_at(spark):
    assert "found int" in SCHEMA
    docs = frame(spark, [(1, "a a a a a a a a a a a a", "s")]).withColumn("runs", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("ids", F.lit(3)).withColumn("part", F.lit(4))
    assert periodic.periodic_runs(docs).first().runs[0].period == 1
    assert packing.pack_documents(docs, TOKENIZER).first().doc_id == 1
    asked = spark.createDataFrame([(1, "a b", 5)], "item_id long, text string, terms int")
    assert search.search_documents(docs, asked).first()["rank"] == 1
