import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from quillspark.llm import best_fit, token_files
from quillspark.llm.words import CachedTokenizer, public_vocabulary

VOCABULARY = public_vocabulary("word_bpe_49k.json")
TEXTS = [
    "Hello, World. It's a test|with |bars| <|endoftext|>!",
    "J̌ A 'S it's İ ΣA Σ.  b\x1cc   d\x85e",
    "日本 語テキ,スト. 12345 é, É. a,. ,. hi!, 3. x-y.",
    "",
    None,
    "word " * 5000,
    "Hello, World. It's a test|with |bars| <|endoftext|>!",
]


def reference(text):
    return Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 5 if i < 5 else i, t, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_cached_ids_are_the_library_s():
    tok = CachedTokenizer(VOCABULARY)
    texts = [(t or "").encode() for t in TEXTS]
    expected = [np.array(reference(t), "<u4").tobytes() for t in TEXTS]
    assert tok.packed_batch(texts) == expected
    assert [tok.packed(t) for t in texts] == expected
    tok.limit = 0
    assert tok.packed_batch(texts[:3]) == expected[:3]


LETTERS_AND_SIGNS = [
    "ending ending.### ending, ending!! ending's ending' ending'' 'ending ending|. ending<| ending.|x ending_ #ending.",
    "ÉCOLE École, éÉ. Ünï§ ñandú»! ſtraße; ŉa ĀĐŊŒ.. ŸÿŽž× ×. ÷, a÷b. aªº, µm. straße's",
    "İ İ. aİ, İa.. ıI. Σ ΑΣ. ΑΣ, ǅ. ŀl, ĸ! Kelvin, Å. ﬁ, ﬁn. ʼn, ª! 한국, 가. e̊. q̌! Ă̱.",
    "x\x1cy. a\x85b, a\xa0b.  c, d　e. ﻿z, \x00a. \x7fb, a\x0bb\x0cc.",
    "don't, we'll. 'tis, I'm; '' ''' '. .' ',' <|endoftext|> <|endoftext|>. a<|endoftext|>b, <| |> |",
    "x1, 1x. 12ab!! ab12.## ½, x². ① ab①. -a- a-b. a.b.c. e.g., (a) [b], {c}. ~`^$+=<> a>b, a\\.",
    "  leading and trailing.  ",
    " \n ",
]


def test_letters_and_signs_are_the_library_s():
    """Letters, signs after them, capitals beyond ASCII and marks give the library's ids, learned in any order."""
    expected = {t: np.array(reference(t), "<u4").tobytes() for t in LETTERS_AND_SIGNS}
    for texts in (LETTERS_AND_SIGNS, LETTERS_AND_SIGNS[::-1], LETTERS_AND_SIGNS[3:]):
        tok = CachedTokenizer(VOCABULARY)
        for _ in range(2):
            assert tok.packed_batch([t.encode() for t in texts]) == [expected[t] for t in texts]
    rng = np.random.default_rng(3)
    alphabet = [*"abcABCéÉßİıſŒ×÷.,!#'\"|<>-_12 \n", "́", "̌", "Σ", "한", "'s", "ing", "  "]
    texts = ["".join(rng.choice(alphabet, 40)) for _ in range(3000)]
    library = Tokenizer.from_file(VOCABULARY)
    expected = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert CachedTokenizer(VOCABULARY).packed_batch([t.encode() for t in texts]) == expected


def test_letters_before_signs_are_learned_once(monkeypatch):
    """The library's whole way sees neither a run of letters nor one run with each of its signs."""
    tok, seen = CachedTokenizer(VOCABULARY), []
    encode = tok._encode
    monkeypatch.setattr(tok, "_encode", lambda text: seen.append(text) or encode(text))
    text = " ".join(f"{w}{s}" for w in ("zorblat", "quéndel", "mirfax") for s in ("", ".", ",", "!!", ".###", "$$$"))
    assert tok.packed(text.encode()) == np.array(reference(text), "<u4").tobytes()
    assert not any(w in b" ".join(seen) for w in (b"zorblat", "quéndel".encode(), b"mirfax"))
    assert {b"zorblat", b"mirfax.###"} <= tok.cache.keys()


def test_a_full_cache_keeps_the_words_at_hand():
    tok = CachedTokenizer(VOCABULARY, limit=3)
    tok.packed_batch([b"common words, here"])
    before, learned, learn = tok.cache[b"common"], [], tok._learn
    tok._learn = lambda words: learned.extend(words) or learn(words)
    assert tok.packed_batch([b"common word", b"here"]) == [np.array(reference(t), "<u4").tobytes() for t in ("common word", "here")]
    assert learned == [b"word"] and tok.cache[b"common"] is before and b"words," not in tok.cache


def test_another_vocabulary_goes_whole(tmp_path):
    """A file that splits in another way is encoded by itself alone."""
    library = Tokenizer.from_file(VOCABULARY)
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    library.save(str(tmp_path / "other.json"))
    tok = CachedTokenizer(str(tmp_path / "other.json"))
    text = "ending | éa,. longer words here 12"
    assert not tok.runs and tok.packed(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    text = "ending ending.### ending, comma, stop. éa,."  # a sign is no word of its own here
    assert tok.packed(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_files_round_trip(spark, docs):
    folder = token_files.write_token_files(docs, VOCABULARY)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, folder, with_ids=True).collect()}
    at = 0
    for r in sorted(docs.collect()):
        ids = reference(r.text) + [1]
        g = got[r.doc_id]
        assert (g.ids, g.start, g.n_tokens) == (ids, at, len(ids))
        assert g.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    meta = token_files.manifest(folder)
    file = token_files.TokenFile(folder, meta["files"][0]["name"])
    assert file.document(0).tolist() == got[int(file.ids[0])].ids
    assert meta["tokens"] == at


def test_a_token_file_is_written_without_whole_new_words(tmp_path, monkeypatch):
    """One file by hand: frames hold the library's ids, which came from letters and signs apart and from words at hand."""
    tok, seen = CachedTokenizer(VOCABULARY, limit=6), []
    encode = tok._encode
    monkeypatch.setattr(tok, "_encode", lambda text: seen.append(text) or encode(text))
    monkeypatch.setattr(token_files, "cached_tokenizer", lambda path: tok)
    texts = ["Zorblat zorblat. zorblat, quéndel!!", "mirfax### zorblat quéndel.", None, "zorblat zorblat!!"]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "text": pa.array([t], pa.string())}) for i, t in enumerate(texts)]
    footer = token_files._write_file(str(tmp_path / "a.tokens"), iter(batches), VOCABULARY, 1, 2, b"")
    (tmp_path / f"{footer['dictionary']}.dictionary").write_bytes(b"")
    file = token_files.TokenFile(str(tmp_path), "a.tokens")
    assert [file.document(k).tolist() for k in range(len(file))] == [reference(t) + [1] for t in texts]
    assert not any(w in b" ".join(seen) for w in (b"zorblat", "quéndel".encode(), b"mirfax"))


def test_token_files_reject_another_dictionary(spark, docs):
    folder = token_files.write_token_files(docs, VOCABULARY)
    system, where = token_files.filesystem(folder)
    digest = token_files.manifest(folder)["dictionary"]
    with system.open_output_stream(f"{where}/{digest}.dictionary", compression=None) as f:
        f.write(b"other")
    with pytest.raises(ValueError, match="dictionary"):
        token_files.TokenFile(folder, token_files.manifest(folder)["files"][0]["name"])


def test_empty_table(spark, docs):
    none = docs.where("false")
    assert token_files.read_token_files(spark, token_files.write_token_files(none, VOCABULARY)).count() == 0
    assert best_fit.pack_documents(none, VOCABULARY).count() == 0


def brute_force(lengths, capacity):
    """Best-fit decreasing, one piece at a time over all bins."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= n]
        if fits:
            max(fits, key=sum).append(n)
        else:
            bins.append([n])
    return sorted(map(sum, bins))  # equal bins are interchangeable


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    lengths = rng.integers(1, capacity + 1, rng.integers(1, 200)).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins = {}
    for row, n in zip(plan := best_fit.plan_best_fit(counts, capacity).tolist(), range(10**9)):
        following = plan[n + 1] if n + 1 < len(plan) else None
        end = following[1] if following and following[0] == row[0] else counts[row[0]]
        for rank in range(row[1], end):
            into = rank - row[1]
            bins.setdefault(row[2] + into // row[3], []).append((row[4] + into % row[3] * row[0], row[0]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(sum(n for _, n in b) for b in bins.values()) == brute_force(lengths, capacity)


def test_pack_documents(spark, docs):
    rows = best_fit.pack_documents(docs, VOCABULARY, capacity=64, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
    for r in docs.collect():
        own = sorted(by_doc[r.doc_id], key=lambda x: x.piece)
        assert sum((x.ids for x in own), []) == reference(r.text) + [0]
        assert [x.start for x in own] == [64 * k for k in range(len(own))]
        assert all(x.length == 64 for x in own[:-1])
    for own in by_sequence.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 64
    lengths = [r.length for r in rows]
    assert len(by_sequence) == len(brute_force(lengths, 64))


def test_rows_do_not_depend_on_partitions(spark, docs):
    packed = [best_fit.pack_documents(docs.repartition(n), VOCABULARY, 64).select("sequence_id", "length") for n in (1, 5)]
    counts = [sorted(p.groupBy("sequence_id").agg(F.sum("length").alias("n")).select("n").collect()) for p in packed]
    assert counts[0] == counts[1]


def test_dictionaries_of_small_and_large_samples():
    """Training errors are not swallowed; every sample gives a dictionary that frames need."""
    import zstandard

    rng = np.random.default_rng(1)
    for n in (1, 3, 15, 16, 40, 800):
        arrays = [rng.integers(0, 400, int(rng.integers(1, 3000)), dtype=np.uint16).tobytes() for _ in range(n)]
        raw = token_files.dictionary_of(arrays)
        assert raw and len(raw) <= token_files.DICTIONARY_BYTES
        assert (raw[:4] == b"\x37\xa4\x30\xec") == (sum(map(len, arrays)) >= token_files.LEAST_TRAINING_BYTES and n >= 16)  # the magic number of trained ones
        codec = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        assert [back.decompress(codec.compress(a)) for a in arrays] == arrays
    assert token_files.dictionary_of([]) == b""


def test_repeated_rows_null_ids_and_long_texts(spark):
    long = "Zebra, crossing 12 " * 60_000
    rows = [(4, "one two", "x"), (4, "one two", "x"), (None, "three", "y"), (9, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(2)
    got = token_files.read_token_files(spark, token_files.write_token_files(docs, VOCABULARY), with_ids=True).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(((i, reference(t) + [1]) for i, t, _ in rows), key=str)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 4, 4, 9]
    pieces = best_fit.pack_documents(docs, VOCABULARY, 64, with_ids=True).collect()
    assert len(pieces) == 3 + -(-(len(reference(long)) + 1) // 64)
    assert sorted(r.ids for r in pieces if r.doc_id == 4) == [reference("one two") + [0]] * 2
    assert [r.ids for r in pieces if r.doc_id is None] == [reference("three") + [0]]
    assert sum((r.ids for r in sorted(pieces, key=lambda r: r.piece) if r.doc_id == 9), []) == reference(long) + [0]
