"""Runs of added words inside a passage that recurs."""

import random

import numpy as np
import pytest

from tests.llm.test_llm import WORDS, brute
from tidemark.llm import leakage


def holds(p, text):
    ids = {w: k for k, w in enumerate(p)}
    pb, tb = np.array([ids[w] for w in p]), np.array([ids.get(w, -1) for w in text])
    diagonals = np.unique([j - i for i in range(len(p)) for j in range(len(text)) if p[i] == text[j]])
    return leakage.stretch_on(pb, tb, diagonals)


@pytest.mark.parametrize("added,words", [(4, 20), (5, 25), (6, 30), (5, 24), (6, 29)])
@pytest.mark.parametrize("long", ["added", "supplementary"])
def test_a_run_of_added_words(added, words, long):
    rnd = random.Random(added)
    p = [f"{w}{i}" for i, w in enumerate(rnd.choices(WORDS, k=words))]
    cut = words // 2  # neither side has 16 words
    text = ["noise"] * 20 + p[:cut] + [long] * added + p[cut:] + ["noise"] * 20
    want = 5 * added <= words
    assert brute(p, text) == want
    assert holds(p, text) == want
    assert leakage.leaked_items(" ".join(text), leakage.Passages.of([(1, " ".join(p))])) == [1] * want


def test_runs_of_added_words_among_other_edits():
    rnd = random.Random(5)
    for _ in range(150):
        p = [f"{w}{i}" for i, w in enumerate(rnd.choices(WORDS, k=40))]
        copy = p[(a := rnd.randint(0, 8)) : a + rnd.randint(16, 32)]
        i = rnd.randrange(4, len(copy) - 4)
        copy[i:i] = ["added"] * rnd.randint(3, 7)
        for _ in range(rnd.randint(0, 2)):
            copy[rnd.randrange(len(copy))] = "other"
        text = ["noise"] * 9 + copy + ["noise"] * 9
        assert holds(p, text) == brute(p, text), (p, text)


@pytest.mark.parametrize("kind", ["added", "replaced", "dropped", "mixed"])
@pytest.mark.parametrize("words", [16, 20, 31, 47])
def test_edits_by_words_of_any_length(kind, words):
    """Passages of short and of long words, edited by words of 1 to 300 letters up to the bound, against brute force."""
    rnd = random.Random(f"{kind}{words}")
    letters = "abcdefghijklmnopqrstuvwxyz"
    found = 0
    for _ in range(25):
        longest = rnd.choice([1, 2, 4, 9, 40])
        p = ["".join(rnd.choices(letters, k=rnd.randint(1, longest))) + str(i % 10) * (longest > 1) for i in range(words)]
        copy = list(p)
        for i in sorted(rnd.sample(range(1, words - 1), rnd.randint(words // 5 - 1, words // 5)), reverse=True):
            how = rnd.choice(["added", "replaced", "dropped"]) if kind == "mixed" else kind
            copy[i : i + (how != "added")] = [] if how == "dropped" else ["".join(rnd.choices("xyz", k=rnd.choice([1, 7, 60, 300])))]
        text = ["noise"] * 30 + copy + ["noise"] * 30
        want = brute(p, text)
        found += want
        assert leakage.leaked_items(" ".join(text), leakage.Passages.of([(1, " ".join(p))])) == [1] * want, (p, text)
    assert found >= (0 if kind in ("dropped", "mixed") and words == 16 else 20)


def test_one_scan_for_many_blocks(spark):
    rnd = random.Random(1)
    texts = [" ".join(f"{w}{rnd.randint(0, 99)}" for w in rnd.choices(WORDS, k=30)) for _ in range(12)]
    docs = spark.createDataFrame([(i, "x " * 9 + t) for i, t in enumerate(texts)], "doc_id int, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id int, passage string")
    for scans, per in ((1, 16), (3, 4)):
        found = leakage.leaks(docs, items, block_characters=1, blocks_a_scan=per)
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == scans
        assert sorted(map(tuple, found.collect())) == [(i, i) for i in range(12)]


def test_tags_of_any_length():
    from tidemark.llm.normal import words_line

    line = lambda t: words_line(t).tobytes().decode().split()
    assert line(f'a <img src="data:{"Q" * 5000}" alt=x> b') == ["a", "b"]
    assert line(f'a <img src=\\"data:{"Q" * 5000}\\"> b') == ["a", "b"]
    assert line("a <!DOCTYPE " + "x " * 400 + "> b") == ["a", "b"]
    assert line("if i <n then " + "more words " * 60 + "> end")[2:] == ["n", "then", *["more", "words"] * 60, "end"]
