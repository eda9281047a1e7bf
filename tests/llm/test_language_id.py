import functools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quillspark.llm import language_id
from quillspark.llm.pieces import PieceModel
from quillspark.llm.words import public_vocabulary

VOCABULARY = public_vocabulary("piece_bpe_32k.model")
WORDS = {
    "aa": ["the", "river", "because", "under", "light", "morning", "of"],
    "bb": ["der", "fluss", "weil", "unter", "licht", "morgen", "von", "über"],
}


@pytest.fixture(scope="module")
def model():
    return PieceModel(VOCABULARY)


def test_forward_pass_sums_all_segmentations(model):
    rng = np.random.default_rng(1)
    p = rng.random((len(model.pieces) + 1, 3)) / 100
    index = {model.pieces[i]: i for i in model.normal}
    words = ["▁the", "▁morning", "▁é🤖a", "▁", "▁überall"]

    @functools.cache
    def total(rest):
        if not rest:
            return (1.0,) * 3
        out = np.zeros(3)
        for k in range(1, len(rest) + 1):
            if rest[:k] in index or (k == 1 and rest[0] not in index):
                out += p[index.get(rest[:k], -1)] * np.array(total(rest[k:]))
        return tuple(out)

    matches = language_id.Matches(model, words)
    assert np.allclose(matches.forward(p)[matches.last], [total(w) for w in words], rtol=1e-12)
    assert np.allclose(matches.backward(p)[matches.base], [total(w) for w in words], rtol=1e-12)


def log_total(model, p, word):
    """Logarithm of the sum over all segmentations, in exact fractions, for each column of p."""
    index = {model.pieces[i]: i for i in model.normal}
    out = []
    for k in range(p.shape[1]):
        exact = [Fraction(float(x)) for x in p[:, k]]
        total = [Fraction(1)]
        for end in range(1, len(word) + 1):
            own = ((word[a:end], total[a]) for a in range(max(0, end - 20), end))
            total.append(sum((t * exact[index.get(piece, -1)] for piece, t in own if piece in index or (len(piece) == 1 and piece not in index)), Fraction(0)))
        top = total[-1]
        shift = top.denominator.bit_length() - top.numerator.bit_length()
        out.append(math.log(top * Fraction(2) ** shift) - shift * math.log(2))
    return out


LONG = ["▁" + "Ω" * 47 + "the", "▁" + "the" * 70, "▁" + "Ωtheж" * 50, "▁" + "ж" * 200 + "morning" * 3, "▁under", "▁überallesundjedes"]


def test_long_words_are_summed_over_all_segmentations(model):
    rng = np.random.default_rng(2)
    p = rng.random((len(model.pieces) + 1, 3)) / 10_000
    p[-1] = language_id.UNKNOWN
    got = language_id.LanguageModel(["a", "b", "c"], p).word_scores(model, LONG)
    assert len(LONG[0]) > 48 and model.longest <= 20
    assert np.allclose(got, [log_total(model, p, w) for w in LONG], rtol=1e-12)
    assert np.ptp(got[0]) > 0  # the known part of a word of unknown letters still counts
    alone = np.concatenate([language_id.LanguageModel(["a", "b", "c"], p).word_scores(model, [w]) for w in LONG])
    assert np.array_equal(got, alone)


def test_expected_uses_of_long_words(model):
    """Each use of a piece is the derivative of the total's logarithm by that of its probability."""
    rng = np.random.default_rng(3)
    p = rng.random((len(model.pieces) + 1, 1)) / 10_000
    p[-1] = language_id.UNKNOWN
    words = [LONG[2], LONG[5], "▁the"]
    uses = language_id.Matches(model, words).expected(p, np.array([2.0, 1.0, 3.0]), len(p))
    for i in [model.pieces.index("the"), model.pieces.index("▁the"), len(p) - 1]:
        more = p.copy()
        more[i] *= 1 + 1e-6
        change = [log_total(model, more, w)[0] - log_total(model, p, w)[0] for w in words]
        assert math.isclose(uses[i], (2 * change[0] + change[1] + 3 * change[2]) / math.log1p(1e-6), rel_tol=1e-4, abs_tol=1e-6)


def test_score_of_a_whole_text_equals_the_sum_over_its_words(spark, model):
    texts = ["the river, der FLUSS 12 the!", "under" * 40 + " weil Ωж", "Ω" * 300 + " x\n\tthe"]
    fitted = language_id.LanguageModel.fit(model, [("aa", b"the river under the light"), ("bb", "der fluss weil über".encode())])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(docs, fitted, VOCABULARY).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\W\d_]+", text.lower())
        total = np.sum([log_total(model, fitted.probabilities, "▁" + w) for w in words], axis=0)
        best = int(np.argmax(total))
        assert got[i].lang_pred == fitted.languages[best]
        assert math.isclose(got[i].score, 1 / sum(math.exp(x - total[best]) for x in total), rel_tol=1e-9)


def test_very_long_word_takes_linear_time(model):
    fitted = language_id.LanguageModel(["a"], np.full((len(model.pieces) + 1, 1), 1e-5))
    [[score]] = fitted.word_scores(model, ["▁" + "under" * 40_000])
    assert np.isfinite(score)


def rows():
    rng = random.Random(4)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(30)).capitalize() + ".", lang) for i in range(300) for lang in [rng.choice(sorted(WORDS))]]


def test_held_out_accuracy_and_defined_cases(spark, model):
    own = rows()
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 + 3 !!", "aa"), (1003, "river light", None), (1004, "Ω" * 200, None), (None, "weil unter", "bb"), (1005, "Река", "aa")]
    docs = spark.createDataFrame(own + odd, "doc_id long, text string, lang string").selectExpr("*", "lang AS lang_pred", "1 AS score").repartition(4)
    fitted = language_id.train(docs, VOCABULARY)
    got = {r.doc_id: r for r in language_id.identify(docs, fitted, VOCABULARY).collect()}
    assert len(got) == len(own) + len(odd)
    for i, _, lang in own:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].lang_pred == lang and 0.9 < got[i].score <= 1
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[1003].lang_pred == "aa" and got[None].lang_pred == "bb" and not got[None].held_out
    # letters that no language has seen: all that differs is the word start, as the exact sums say
    aa, bb = log_total(model, fitted.probabilities, "▁" + "ω" * 200)
    assert got[1004].lang_pred == ("aa" if aa >= bb else "bb") and math.isclose(got[1004].score, 1 / (1 + math.exp(-abs(aa - bb))), rel_tol=1e-9)


def test_training_ignores_held_out_rows(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    swapped = docs.selectExpr("doc_id", "text", "IF(crc32(CAST(doc_id AS STRING)) % 3 = 1, 'zz', lang) AS lang")
    a, b = (language_id.train(x, VOCABULARY) for x in (docs, swapped))
    assert a.languages == b.languages == ["aa", "bb"]
    assert np.array_equal(a.probabilities, b.probabilities)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.identify(docs, language_id.train(docs, VOCABULARY), VOCABULARY).count() == 0


def test_repeated_rows_and_too_many_languages(spark, model, monkeypatch):
    docs = spark.createDataFrame(rows()[:40] + rows()[:40], "doc_id long, text string, lang string").repartition(3)
    fitted = language_id.train(docs, VOCABULARY)
    got = language_id.identify(docs, fitted, VOCABULARY).collect()
    assert len(got) == 80 and len({(r.doc_id, r.lang_pred, r.score) for r in got}) == 40
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="2 languages"):
        language_id.LanguageModel.fit(model, [("aa", b"x"), ("bb", b"y")])
