"""Rare insults beside a very common one, insults in other scripts, and the kernel against a plain one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from distlearn.llm import toxicity


def trained(spark, common, rare):
    draw = random.Random(2)
    filler = [f"{a}{b}{c}" for a in "bdfglm" for b in ("ora", "eni", "ulo", "ati") for c in ("st", "rd", "nk", "pe", "la")]
    rows, labels = [], []
    for i in range(3000):
        words = [draw.choice(filler) for _ in range(30)]
        if i < 600:
            words[5] = common
        elif i < 612:
            words[5] = rare
        rows.append((i, " ".join(words)))
        labels.append((i, int(i < 612)))
    return toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))


@pytest.mark.parametrize("common, rare", [("idiot", "vhukzwy"), ("придурок", "мерзавец")])
def test_rare_insults(spark, common, rare):
    model = trained(spark, common, rare)
    assert rare in model.landmarks and common in model.landmarks
    same_length = "я" * 3 + "щ" * 5 if rare > "z" else "q" * 7
    reader = toxicity.Reader(toxicity.Kernel(model.landmarks))
    clean, other, *bad = model.scores(reader, ["borast deniрd", f"borast {same_length} denird", f"borast {rare} denird", f"borast {common} denird"])
    assert max(clean, other) < toxicity.THRESHOLD <= min(bad)


def test_letters_of_other_scripts_are_distinct():
    assert toxicity.plain("дурак") != toxicity.plain("город") and toxicity.plain("ÉTÉ".lower()) == "ete" and toxicity.plain("i2d") == "i{d"
    at, values = toxicity.Kernel(["дурак"], floor=0.0).values([toxicity.plain(w) for w in ("дурак", "город", "д-у-рак")])
    assert dict(zip(at.tolist(), values[:, 0].tolist())) == pytest.approx({0: 1.0, 2: 1.0})


def test_kernel_against_a_plain_one():
    def dense(word):
        out = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.ORDER_SPAN)):
                    out[word[i] + word[j] + word[k]] = out.get(word[i] + word[j] + word[k], 0) + toxicity.DECAY ** (k - i - 2)
        norm = np.sqrt(sum(v * v for v in out.values()))
        return {c: v / norm for c, v in out.items()}

    words, landmarks = ["idixot", "stupidity", "aaaaaa", "漢字漢字", "zzz", "идиотка"], ["idiot", "stupid", "aaaa", "漢字漢"]
    want = [[sum(v * b.get(c, 0) for c, v in a.items()) for b in map(dense, landmarks)] for a in map(dense, words)]
    got = np.zeros((len(words), len(landmarks)))
    at, values = toxicity.Kernel(landmarks, floor=0.0).values(words)
    got[at] = values
    assert np.allclose(got, want, atol=1e-6)


def test_kernel_values_against_plain_sums():
    def subsequences(word):
        out = {}
        for i in range(len(word)):
            for b in range(2, toxicity.ORDER_SPAN):
                for a in range(1, b):
                    if i + b < len(word):
                        key = word[i], word[i + a], word[i + b]
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (b - 2)
        return out

    def kernel(x, y):
        p, q = subsequences(x), subsequences(y)
        norm = (sum(v * v for v in p.values()) * sum(v * v for v in q.values())) ** 0.5
        return sum(v * q.get(k, 0) for k, v in p.items()) / norm if norm else 0

    draw = random.Random(2)
    landmarks = ["".join(draw.choice("abcdeéд") for _ in range(draw.randint(3, 9))) for _ in range(40)]
    words = ["".join(draw.choice("abcdeéдxyz漢") for _ in range(draw.randint(0, 12))) for _ in range(800)] + landmarks
    at, values = toxicity.Kernel(landmarks).values(words)
    got = np.zeros((len(words), len(landmarks)))
    got[at] = values
    want = np.array([[kernel(w, x) for x in landmarks] for w in words])
    assert np.allclose(got, np.where(want >= toxicity.FLOOR, want, 0), atol=1e-6) and (got > 0).sum() > 50


def test_words_set_aside_are_remembered(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)
    texts = ["an idiot here", "one two three four five", "an idiot again", "six seven eight nine", "the idiott"]
    small, whole = toxicity.Reader(toxicity.Kernel(["idiot"])), toxicity.Reader(toxicity.Kernel(["idiot"]))
    for t in texts:
        assert len(small.sentences([t])[0]) == ("idiot" in t)
    assert [len(x) for x in whole.sentences(texts)] == [1, 0, 1, 0, 1]
