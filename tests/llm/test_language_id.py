"""Language identification: what counts as a letter, the bound on the sample, and a plain version of the scores."""

from collections import Counter

import numpy as np
import pytest


def model():
    from ctxspark.llm.language import fit

    texts = ["the quick brown fox jumps over that lazy dog", "der schnelle braune fuchs springt über den faulen hund", "быстрая лиса прыгает через собаку", "ਮੈਂ ਪੰਜਾਬੀ ਬੋਲਦਾ ਹਾਂ"]
    return fit([t.encode() for t in texts], ["en", "de", "ru", "pa"])


@pytest.mark.parametrize("text", ["", "...", "123", "×", "3 × 4 ÷ 2", "٠١٢", "؟", "।", "・", "฿", "​", "㊀", "1٢3"])
def test_texts_without_letters_are_unknown(text):
    assert not any(c.isalpha() for c in text)
    got = model().predict([text.encode(), b"the dog"])
    assert got[0][0] == "und" and got[1][0] == 0.0 and got[0][1] == "en"


@pytest.mark.parametrize(("text", "lang"), [("ਪੰਜਾਬੀ", "pa"), ("лиса", "ru"), ("١ fox ٢", "en"), ("über den", "de")])
def test_letters_of_any_script(text, lang):
    assert model().predict([text.encode()])[0] == [lang]


def test_every_letter_gets_a_learned_language():
    m = model()
    text = [chr(c) for c in range(0x110000) if chr(c).isalpha()][::97]
    names, score = m.predict([t.encode() for t in text])
    assert set(names) <= set(m.languages) and (score > 0).all()


def plain_scores(m, text):
    """Per word and language the mean table value over the word's subwords, with Python integers."""
    from ctxspark.llm.chargrams import BUCKET_BITS, SIZES

    fold = "".join(c.lower() if c.isascii() or (0xC0 <= ord(c) <= 0xDE and c != "×") else c for c in text)
    words = "".join(c if not c.isascii() or c.isalnum() else " " for c in fold).split()
    out = []
    for w in words:
        b, sums, n = f" {w} ".encode(), [0.0] * len(m.tables), 0
        for size in SIZES:
            for k in range(len(b) - size + 1):
                h = b[k]
                for c in b[k + 1 : k + size]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                bucket = ((h ^ h >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - BUCKET_BITS
                sums = [s + float(t[bucket]) for s, t in zip(sums, m.tables)]
                n += 1
        out.append([s / max(1, n) for s in sums])
    return np.array(out)


def test_word_scores_against_a_plain_version():
    from ctxspark.llm.chargrams import Words

    m = model()
    m.scripts[:] = True  # no script is ruled out
    text = "The QUICK fuchs, über-den hund. ÀÉ x I собаку ਪੰਜਾਬੀ fox2 supercalifragilistic"
    scores, lettered = m.word_scores(Words([text.encode()]))
    assert lettered.all() and np.allclose(scores, plain_scores(m, text), atol=1e-4)


def test_two_languages_beat_the_best_single_one():
    """A path of two stretches may leave out the language that is best throughout."""
    from ctxspark.llm.language import LanguageModel

    a, b, c = [1.0] * 5 + [-10.0] * 5, [-10.0] * 5 + [1.0] * 5, [0.0] * 10
    path = LanguageModel(list("abc"), [], np.ones((3, 17), bool), switch=6.0).label(np.array([a, b, c]).T)
    assert path.tolist() == [0] * 5 + [1] * 5


def test_sample_is_bounded_whatever_repeats(spark):
    from ctxspark.llm.language import training_sample

    rows = [("one text again and again", "en")] * 3000 + [(f"text number {k}", "en") for k in range(300)] + [(f"wort {k}", "de") for k in range(5)] + [(f"mot {k}", "fr") for k in range(9)]
    rows += [(None, "en"), ("no language", None), ("x" * 50, "long")]
    texts, langs = training_sample(spark.createDataFrame(rows, "text string, lang string").repartition(7), per_language=50, languages=3, chars=40)
    assert Counter(langs) == {"en": 50, "fr": 9, "de": 5} and len(set(texts)) == 64
    assert training_sample(spark.createDataFrame([], "text string, lang string")) == ([], [])


def test_very_many_languages(spark):
    from ctxspark.llm.language import fit, identify, training_sample

    rows = [(k, f"only text of language {k}", f"l{k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    texts, langs = training_sample(docs.select("text", "lang"), languages=20)
    assert len(texts) == len(set(langs)) == 20
    assert {r.lang_pred for r in identify(docs, fit(texts, langs)).collect()} <= set(langs)
