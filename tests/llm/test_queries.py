"""Every registered query on the smallest tables: against its SQL, or against brute force over the same rows."""

import functools
import math
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import test_quality
import test_simhash
import test_tokens
import test_warc
from oracle import compare, duck
from tokenizers import Tokenizer

from quillspark.llm import language_id, quality, storage
from quillspark.llm.pieces import CachedPieces, PieceModel
from quillspark.llm.queries import ORACLES, PIECE_VOCABULARY, QUERIES, table
from quillspark.llm.words import public_vocabulary

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) > 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@functools.cache
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@functools.cache
def pieces():
    return CachedPieces(PieceModel(public_vocabulary(PIECE_VOCABULARY)))


def rows_of(spark, name, key="doc_id"):
    rows = QUERIES[name](spark, SF).collect()
    return {r[key]: r for r in rows}, rows


def test_op1_quality_rules(spark):
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    got, _ = rows_of(spark, "op1_quality_rules")
    assert len(got) == len(documents())
    for i, text in documents():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quick_counts(text or "")
        if i % 8 == 0 and (text or "").split() and len(text) < 20_000:
            assert math.isclose(r.quality, test_quality.plain_probability(model, text), rel_tol=1e-5)
        assert r.kept == (not r.base_failed and r.quality >= quality.KEEP_PROBABILITY)


def quick_counts(text):
    """As the brute force of test_quality, with windows counted in a table."""
    words = test_quality.WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = {w: 0 for w in windows}
    for w in windows:
        times[w] += 1
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if test_quality.WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words)


def test_op2_warc(spark):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    _, rows = rows_of(spark, "op2_warc", "page_id")
    assert sorted((tuple(r) for r in rows), key=str) == test_warc.expected(pages)


def test_op3_sentencepiece_codec(spark):
    got, rows = rows_of(spark, "op3_sentencepiece_codec")
    assert len(rows) == len(documents())
    for i, text in documents():
        raw = (text or "").encode()
        ids = pieces().packed(raw)
        assert (got[i].n_ids, got[i].ids_crc32) == (len(ids) // 4, zlib.crc32(ids))
        assert got[i].exact == (pieces().model.decode(struct.unpack(f"<{len(ids) // 4}I", ids)) == raw) == ("▁" not in (text or ""))


def word_sum(model, p, word):
    """Logarithm of the sum over segmentations for each column, one character after the other."""
    index = word_sum.index or word_sum.index.update({model.pieces[i]: i for i in model.normal}) or word_sum.index
    total = [np.zeros(p.shape[1])]
    for end in range(1, len(word) + 1):
        terms = [total[a] + np.log(p[index.get(word[a:end], -1)]) for a in range(max(0, end - 16), end) if word[a:end] in index or (end - a == 1 and word[a] not in index)]
        total.append(np.logaddexp.reduce(terms, axis=0))
    return total[-1]


word_sum.index = {}


def test_op4_language_id(spark):
    docs = table(spark, SF, "documents")
    vocabulary = public_vocabulary(PIECE_VOCABULARY)
    fitted = language_id.train(docs, vocabulary)
    got, rows = rows_of(spark, "op4_language_id")
    assert len(rows) == len(documents())
    scores = functools.cache(lambda w: word_sum(pieces().model, fitted.probabilities, "▁" + w))
    for i, text in documents():
        words = language_id.LETTERS.findall((text or "").lower())
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        if len(words) > 1500:
            continue
        total = sum(scores(w) for w in words)
        best = int(np.argmax(total))
        assert got[i].lang_pred == fitted.languages[best]
        assert math.isclose(got[i].score, 1 / np.exp(total - total[best]).sum(), rel_tol=1e-6)


@functools.cache
def tokenizer():
    return Tokenizer.from_file(test_tokens.VOCABULARY)


def ids_of(text, end):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, end]


def test_op5_best_fit_packing(spark):
    _, rows = rows_of(spark, "op5_best_fit_packing")
    lengths, by_doc, places = [], {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == {i for i, _ in documents()}
    for i, text in documents():
        ids, own = ids_of(text, 0), sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, at, min(2048, len(ids) - at)) for k, at in enumerate(range(0, len(ids), 2048))]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) for r in own]
        lengths += [r.length for r in own]
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(places) == len(test_tokens.brute_force(lengths, 2048))


def test_op8_token_files(spark):
    got, rows = rows_of(spark, "op8_token_files")
    at = 0
    for i, text in documents():
        ids = ids_of(text, 1)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert len(rows) == len(documents())


def test_op9_simhash_near_dedup(spark):
    got, rows = rows_of(spark, "op9_simhash_near_dedup")
    ids, fps = [i for i, _ in documents()], [test_simhash.brute_fingerprint(re.sub(r"[\t\n\x0b\x0c\r]", " ", t or "")) for _, t in documents()]
    assert [got[i].fingerprint for i in ids] == [f"{x:016x}" for x in fps] and len(rows) == len(ids)
    assert {i: got[i].component_id for i in ids} == test_simhash.brute_components(ids, fps)


def test_op10_token_counts(spark):
    got, rows = rows_of(spark, "op10_token_counts")
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(pieces().packed((t or "").encode())) // 4 for i, t in documents()} and len(rows) == len(got)


def test_pipeline_on_the_smallest_tables(spark):
    """Each stage by its query or by brute force over what the one before kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, SF, "documents")
    got = pipeline.run(spark, SF).collect()
    languages = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs, public_vocabulary(PIECE_VOCABULARY)), public_vocabulary(PIECE_VOCABULARY)).collect()}
    first = [(i, t) for i, t in documents() if languages[i].lang_pred != "und" and languages[i].score >= pipeline.LEAST_LANGUAGE_SCORE]
    kept = docs.where(docs.doc_id.isin([i for i, _ in first]))
    good = {r.doc_id for r in quality.score(kept, quality.train(kept, table(spark, SF, "labels"))).collect() if r.kept}
    second = [(i, t) for i, t in first if i in good]
    components = test_simhash.brute_components([i for i, _ in second], [test_simhash.brute_fingerprint(re.sub(r"[\t\n\x0b\x0c\r]", " ", t)) for _, t in second])
    last = [(i, t) for i, t in second if components[i] == i]
    assert 0 < len(last) <= len(second) < len(first) <= len(documents())
    expected = sorted((i, k, at, min(2048, len(ids) - at)) for i, t in last for ids in [ids_of(t, 0)] for k, at in enumerate(range(0, len(ids), 2048)))
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in got) == expected
    assert len({r.sequence_id for r in got}) == len(test_tokens.brute_force([n for *_, n in expected], 2048))


def test_folders_of_a_scope_go(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "x")], "doc_id long, text string")
    from quillspark.llm import simhash

    with storage.scope() as made:
        assert simhash.one_of_each(df).count() == 2
        assert made and any(system.get_file_info(where).type.name == "Directory" for system, where in map(storage.filesystem, made))
    assert all(system.get_file_info(where).type.name == "NotFound" for system, where in map(storage.filesystem, made))
