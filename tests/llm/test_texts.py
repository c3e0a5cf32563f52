"""Operators on whole texts against brute force, exact round trips and held-out accuracy, and odd inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperflow.llm import audio, repeats
from paperflow.llm.block_repeats import dedup_blocks
from paperflow.llm.language import codewords, held_out, language_of, train
from paperflow.llm.near_duplicates import labelled_runs, near_duplicate_classes, similar_texts, words_of
from paperflow.llm.suffix_repeats import dedup_suffixes
from paperflow.llm.token_files import lookup, read_token_files, shard_starts, write_token_files

from .conftest import FOLDER, frame, long_text

WORD_FILE = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
ODD = [(2001, None, "a"), (2002, "", "a"), (2003, "one two three", None), (2003, "one two three", None), (None, "no id here", "b"), (None, "no id here", "b"), (2005, " \n\t ", ""), (2008, "a\0b   é", "a")]


def texts_with_repeats(seed, n=60):
    """Documents that share passages, repeat themselves and copy one another."""
    r = random.Random(seed)
    passage = [" ".join(f"p{k}.{i}" for i in range(r.randrange(15, 45))) for k in range(6)]
    rows = []
    for k in range(n):
        parts = [" ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(0, 40)))]
        for _ in range(r.randrange(0, 4)):
            parts += [r.choice(passage), " ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(0, 30)))]
        rows.append((k * 7 % n, r.choice([" ", "\n", "  "]).join(parts), "s"))
    rows += [(n + k, rows[k][1], "s") for k in range(5)] + [(n + 9, "ab" * 300, "s"), (n + 10, "x y " * 40, "s")]
    return rows


def brute_repeats(rows, window, cut):
    """Masks of removed pieces, for rows with different doc_ids."""
    seen, out = set(), {}
    for i, text, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        if i in out:
            continue
        pieces = cut(text)
        gone = [False] * len(pieces)
        for s in range(len(pieces) - window + 1):
            w = tuple(pieces[s:s + window])
            if w in seen:
                gone[s:s + window] = [True] * window
            seen.add(w)
        out[i] = (pieces, gone)
    return out


def test_block_repeats_equal_brute_force(spark):
    rows = texts_with_repeats(1) + ODD + [(900, long_text(), "s"), (901, "start " + long_text(), "s")]
    cut = lambda t: (t or "").encode().split()
    want = brute_repeats(rows, 20, cut)
    got = dedup_blocks(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for g in got:
        pieces, gone = want[g.doc_id]
        assert (g.n_words, g.n_removed) == (len(pieces), sum(gone))
        assert bytes(g.kept) == b" ".join(p for p, x in zip(pieces, gone) if not x)
        assert sum(s.length for s in g.spans) == g.n_removed and all(gone[k] for s in g.spans for k in range(s.start, s.start + s.length))


def test_suffix_repeats_equal_brute_force(spark):
    rows = texts_with_repeats(2) + ODD
    want = brute_repeats(rows, 100, lambda t: list((t or "").encode()))
    got = dedup_suffixes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for g in got:
        pieces, gone = want[g.doc_id]
        assert (g.n_bytes, g.n_removed) == (len(pieces), sum(gone))
        assert bytes(g.kept) == bytes(p for p, x in zip(pieces, gone) if not x)


def test_repeats_do_not_rest_on_one_fingerprint(spark, monkeypatch):
    """Nearly all windows share the first fingerprint; the second still tells them apart."""
    monkeypatch.setattr(repeats, "mixed", lambda x: x % np.uint64(5) << np.uint64(60))
    monkeypatch.setattr(repeats, "BATCH_BYTES", 4000)
    rows = texts_with_repeats(4)
    for dedup, window, cut in ((dedup_blocks, 20, lambda t: t.encode().split()), (dedup_suffixes, 100, lambda t: list(t.encode()))):
        want = brute_repeats(rows, window, cut)
        assert {g.doc_id: g.n_removed for g in dedup(frame(spark, rows)).collect()} == {i: sum(gone) for i, (_, gone) in want.items()}


def test_repeats_of_nothing(spark, nothing):
    assert dedup_blocks(nothing).count() == 0 and dedup_suffixes(nothing).count() == 0


def classes_by_brute_force(rows):
    ids, texts = [i for i, t, _ in rows], [(t or "").encode() for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = [w.tobytes() for w in words_of(texts)]
    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][1] is not None and rows[b][1] is not None and prints[a] == prints[b] and (prints[a] or texts[a] == texts[b])
            if ids[a] == ids[b] or same or similar_texts(texts[a], texts[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k in range(len(rows)):
        least[root(k)] = min(least.get(root(k), ids[k]), ids[k])
    return {ids[k]: least[root(k)] for k in range(len(rows))}


def test_near_duplicates_equal_brute_force(spark, nothing):
    r = random.Random(5)
    rows = []
    for k in range(12):
        base = [f"b{k}.{i}" if i % 3 else "the" for i in range(r.choice([3, 4, 6, 9, 14, 40, 60, 150, 400]))]
        for j in range(8):
            copy = list(base)
            for _ in range(int(len(base) * 0.012 * j)):
                at = r.randrange(len(copy))
                copy[at:at + 1] = r.choice([[], ["new", f"n{r.random()}"], [f"x{r.random()}"]])
            rows.append((k * 100 + j * 7, " ".join(copy), "s"))
    rows += [(5000, None, "a"), (5001, None, "a"), (5002, "", "a"), (5003, "", "a"), (5004, "!!", "a"), (5005, "Word", "a"), (5006, "word.", "a"), (5005, rows[0][1], "a"), (5007, long_text(), "a"), (5008, long_text() + " more", "a")]
    got = near_duplicate_classes(frame(spark, rows)).collect()
    assert {g.doc_id: g.class_id for g in got} == classes_by_brute_force(rows) and len(got) == len(rows)
    assert near_duplicate_classes(nothing).count() == 0
    lone = near_duplicate_classes(frame(spark, [(None, "a b c", "s"), (4, "a b c", "s")])).collect()
    assert sorted((x.doc_id is None, x.class_id) for x in lone if x.doc_id is not None) == [(False, 4)] and any(x.class_id is None for x in lone)


def test_hot_near_duplicates_keep_links(spark):
    """A group whose copies differ from one another by about the threshold, so that the central copy does not settle all."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(150):
        copy = list(base)
        for _ in range(r.randrange(0, 7)):
            copy[r.randrange(len(copy))] = f"x{r.randrange(40)}"
        rows.append((k, " ".join(copy), "s"))
    got = near_duplicate_classes(frame(spark, rows)).collect()
    assert {g.doc_id: g.class_id for g in got} == classes_by_brute_force(rows)


def test_order_counts():
    a = " ".join(f"a{i}" for i in range(100))
    words = a.split()
    assert similar_texts(a.encode(), (a + " b").encode())
    assert not similar_texts(a.encode(), " ".join(words[50:] + words[:50]).encode())  # the same runs but four, in another order
    assert len(np.unique(labelled_runs(next(words_of([b"x y " * 40]))))) == 76


def test_language_accuracy_and_odd_texts(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs.where(~held_out()))
    judged = docs.where(held_out() & F.col("lang").isNotNull()).select("lang", language_of(model, F.col("text")).alias("l"))
    assert judged.agg(F.avg((F.col("lang") == F.col("l.lang")).cast("int"))).first()[0] > 0.97
    odd = frame(spark, [(1, None, "a"), (2, "", "a"), (3, "12 .,; 34", "a"), (4, "und der die nicht schung", None), (4, long_text(), None)])
    got = odd.select(language_of(model, F.col("text")).alias("l")).select("l.*").collect()
    assert [g.lang for g in got[:3]] == ["und"] * 3 and [g.score for g in got[:3]] == [0.0] * 3 and all(0 <= g.score <= 1 for g in got)
    assert train(nothing) is None and train(odd) is None
    assert [g.l.lang for g in odd.select(language_of(None, F.col("text")).alias("l")).collect()] == ["und"] * 5
    one = train(odd.withColumn("lang", F.lit("xx")))
    assert [g.l.lang for g in odd.select(language_of(one, F.col("text")).alias("l")).collect()] == ["und"] * 3 + ["xx"] * 2
    assert nothing.select(language_of(model, F.col("text"))).count() == 0


@pytest.mark.parametrize("k", [2, 3, 4, 7, 12, 40])
def test_codewords_differ(k):
    code = codewords(k)
    assert len(np.unique(code, axis=0)) == k and len(code) == k


def test_token_files_round_trip(spark, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    strange = ["It's a dog's life, don't", "12.5% of 3,000", "ÀÉÎ straße İstanbul ǅ ŉ", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "é ≠  x y", "x\x1cy\x85z", "ab...!?,;", "...", "«quoted» – dash", "数字 漢字", "🙂 ok", "A.B.C", "O'Neil's", "×÷", "\0"]
    rows = ODD + [(100 + k, t, "s") for k, t in enumerate(strange)] + [(2003, "second text of three", "s"), (400, long_text(), "s")]
    folder = write_token_files(frame(spark, rows), path, shard_bytes=4000)
    back = read_token_files(spark, folder).join(shard_starts(spark, folder), "shard").orderBy(F.col("base") + F.col("offset")).collect()
    tokenizer, start = Tokenizer.from_file(path), 0
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
    assert [b.doc_id for b in back] == [i for i, _, _ in order]
    for b, (_, text, _) in zip(back, order):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (b.base + b.offset, b.n_tokens, b.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), text
        start += len(ids)
    found = lookup(spark, folder, spark.createDataFrame([(2003,), (100,), (12345,), (None,)], "doc_id long")).collect()
    assert sorted((f.doc_id is not None, f.doc_id or 0) for f in found) == [(False, 0)] * 2 + [(True, 100)] + [(True, 2003)] * 3
    assert np.frombuffer(next(f.ids for f in found if f.doc_id == 100), "<u4").tolist() == tokenizer.encode(strange[0], add_special_tokens=False).ids + [2]
    empty = write_token_files(nothing, path)
    assert read_token_files(spark, empty).count() == 0


def melody(seed, n, start=0):
    r = random.Random(seed)
    notes = [r.randrange(36) for _ in range(n)][start:]
    t = np.arange(512) / audio.RATE * 2 * np.pi
    return np.concatenate([0.4 * np.sin(t * 130.81 * 2 ** (k / 12)) for k in notes])


def test_audio_alignment(spark):
    whole, late = melody(1, 120), melody(1, 120, start=7)
    noisy = whole + np.random.default_rng(0).normal(0, 0.01, len(whole))
    a, b, c, d = (audio.fingerprint(audio.wav_bytes(x)) for x in (whole, late, noisy, melody(2, 120)))
    assert audio.aligned(a, b)[0] == 7 and audio.aligned(a, b)[1] < 0.02
    assert audio.aligned(a, c)[0] == 0 and audio.aligned(a, c)[1] < 0.1
    other = audio.aligned(a, d)
    assert other is None or other[1] > 0.25
    rows = [(1, audio.wav_bytes(whole)), (2, audio.wav_bytes(late)), (3, audio.wav_bytes(noisy)), (4, audio.wav_bytes(melody(2, 120))), (5, audio.wav_bytes(whole)),
            (6, None), (7, None), (8, b""), (9, b""), (10, b"RIFF nonsense"), (11, audio.wav_bytes(whole[:3000])), (12, audio.wav_bytes(np.zeros(30000))), (5, audio.wav_bytes(whole)), (None, b"")]
    got = audio.align_recordings(spark.createDataFrame(rows, "id long, media binary")).collect()
    assert {g.id: g.class_id for g in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10, 11: 11, 12: 12}
    assert {g.id: g.offset for g in got if g.class_id == 1} == {1: 0, 2: 7, 3: 0, 5: 0}
    assert audio.align_recordings(spark.createDataFrame([], "id long, media binary")).count() == 0


def with_bit_errors(ints, share, rng):
    flips = (rng.random((len(ints), 32)) < share).astype(np.uint64) @ (np.uint64(1) << np.arange(32, dtype=np.uint64))
    return ints ^ flips.astype(np.uint32)


def test_audio_classes_equal_brute_force_with_spread_bit_errors(spark):
    """Each copy carries its own bit errors, so that hardly two neighbouring integers of it are unchanged."""
    rng, shares = np.random.default_rng(3), [0, 0.02, 0.05, 0.08, 0.1, 0.12, 0.15]
    sounds = {}
    for k in range(12):
        whole = rng.integers(0, 1 << 32, 120, np.uint32)
        for j, share in enumerate(shares):
            sounds[100 * k + j] = with_bit_errors(whole, share, rng)[rng.integers(0, 6):]
    ids, label = sorted(sounds), {i: i for i in sounds}
    pairs = [(a, b) for a in ids for b in ids if a < b and audio.similar_recordings(sounds[a].tobytes(), sounds[b].tobytes())]
    for _ in ids:  # labels only fall, and fewer rounds than recordings settle them
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    rows = [(i, sounds[i].astype("<u4").tobytes(), str(i).encode()) for i in ids]
    got = {g.id: g.class_id for g in audio.align_fingerprints(spark.createDataFrame(rows, "id long, ints binary, key binary")).collect()}
    assert got == label
    assert all(a // 100 == b // 100 for a, b in pairs) and all(got[100 * k + j] == 100 * k for k in range(12) for j, share in enumerate(shares) if share <= 0.08)


def test_audio_forms():
    x = melody(3, 60)
    wav = audio.wav_bytes(x)
    stereo = np.repeat(np.frombuffer(wav[44:], "<i2"), 2).tobytes()
    both = wav[:22] + (2).to_bytes(2, "little") + wav[24:28] + (4 * audio.RATE).to_bytes(4, "little") + (4).to_bytes(2, "little") + wav[34:40] + len(stereo).to_bytes(4, "little") + stereo
    assert np.array_equal(audio.fingerprint(wav), audio.fingerprint(both))
    assert len(audio.FILTERS) == 16 and audio.fingerprint(b"RIFF0000WAVE").size == 0


def test_queries_read_whole_tables(spark):
    from paperflow.llm.registry import QUERIES

    n, c = spark.read.parquet(f"{FOLDER}/documents.parquet").count(), spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count()
    for name in ("op1_order_minhash_classes", "op5_language_codes", "op7_suffix_radix_dedup", "op8_token_shards"):
        assert QUERIES[name](spark, FOLDER).count() == n, name
    assert QUERIES["op9_chroma_fingerprints"](spark, FOLDER).count() == c


def thue_morse(n, a, b):
    """The word over two pieces that polynomials modulo 2**64 cannot tell from its mirror once it is long."""
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_long_words_that_polynomials_confuse_are_kept_apart(spark):
    one, other = "".join(thue_morse(2048, "a", "b")), "".join(thue_morse(2048, "b", "a"))
    frame_words = " ".join(f"w{i}" for i in range(19))
    got = {g.doc_id: g for g in dedup_blocks(frame(spark, [(1, f"{one} {frame_words}", "s"), (2, f"{other} {frame_words}", "s"), (3, f"{one} {frame_words}", "s")])).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 0, 20]


def test_long_texts_that_polynomials_confuse_are_kept_apart(spark):
    one, other = (" ".join(thue_morse(2048, *x)) for x in (("aa", "bb"), ("bb", "aa")))
    got = {g.doc_id: g.class_id for g in near_duplicate_classes(frame(spark, [(1, one, "s"), (2, other, "s"), (3, one.upper(), "s")])).collect()}
    assert got[1] == got[3] == 1 and (got[2] == 1) == similar_texts(one.encode(), other.encode())


def test_keys_that_share_a_hash_end_and_are_told_apart(spark):
    from paperflow.llm import token_files

    rows = [(None, "no id", "s"), (-9223372035001586580, "its twin", "s"), (-5, "negative", "s"), (None, "no id again", "s")]
    files = token_files.write_token_files(frame(spark, rows), WORD_FILE)
    found = {g.doc_id: len(g.ids) for g in lookup(spark, files, spark.createDataFrame([(-9223372035001586580,), (-5,), (7,)], "doc_id long")).collect()}
    assert set(found) == {-9223372035001586580, -5}
    keys = np.zeros(3, np.uint64)  # one first hash for all: the second decides
    displace = token_files.minimal_perfect_hash(keys, np.array([3, 10, 21], np.uint64))
    assert sorted(token_files.slot_of(keys, np.array([3, 10, 21], np.uint64), displace, 3).tolist()) == [0, 1, 2]
    with pytest.raises(ValueError):
        token_files.TRIES, kept = 256, token_files.TRIES
        try:
            token_files.minimal_perfect_hash(keys, keys)
        finally:
            token_files.TRIES = kept


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from paperflow.llm.token_files import WordEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [b"Two  words, here\n", b"", "Ünï 12".encode()]
    ids, counts = WordEncoder(path)(texts, 9)
    whole = Tokenizer.from_file(path)
    want = [[*whole.encode(t.decode(), add_special_tokens=False).ids, 9] for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    assert WordEncoder(WORD_FILE).by_words


def test_words_met_before_are_not_cut_again():
    from tokenizers import Tokenizer

    from paperflow.llm.token_files import WordEncoder

    texts = ["L'été, ÉTÉ! don't (abc) naïve. ... x!?", "", "  ", "abc)) ... don't été", "."]
    coder, whole = WordEncoder(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    want = [i for t in texts for i in [*whole.encode(t, add_special_tokens=False).ids, 2]]
    assert coder([t.encode() for t in texts], 2)[0].tolist() == want
    coder.learn = lambda words: pytest.fail(f"cut again: {words}")
    ids, counts = coder([t.encode() for t in texts], 2)
    assert ids.tolist() == want and counts.sum() == len(want)


def test_each_different_word_is_looked_up_once():
    from paperflow.llm.token_files import WordEncoder

    class Counting(dict):
        looked = 0

        def get(self, key, default=None):
            self.looked += 1
            return super().get(key, default)

    coder = WordEncoder(WORD_FILE)
    coder.words = Counting(coder.words)
    ids, counts = coder([b"one two, " * 500, b"two, three"] * 3, 2)
    assert coder.words.looked == len(coder.words) == 4 and len(counts) == 6 and (ids == 2).sum() >= 6
    broken = [b"caf\xe9 \xff\xff, abc", b"\xc3 x"]
    whole = [w for t in broken for w in [*coder.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, 2]]
    assert coder(broken, 2)[0].tolist() == whole


def test_the_driver_does_not_fit_the_language_model(spark, monkeypatch):
    import numpy as np

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    monkeypatch.setattr(np.linalg, "solve", lambda *_: pytest.fail("fitted on the driver"))
    model = train(docs)
    assert model.weights.shape == (1 << 13, model.code.shape[1]) and np.isfinite(model.weights).all()
