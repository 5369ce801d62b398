"""Decontamination against a comparison of all windows along all alignments, without seeds."""

from itertools import combinations

import brute
import pytest

from latentlake.llm import decontam


def windows(docs, items, window=13, percent=80):
    """{(doc_id, item_id): (item_words, window_hits, aligned_hits)} for (id, text) with distinct ids."""
    out = {}
    for d, text in docs:
        w = brute.words(text, True)
        for i, item in items:
            iw = brute.words(item, True)
            width = min(window, len(iw))
            for shift in range(-len(iw) + 1, len(w)) if iw else ():
                m = [iw[j] == w[j + shift] for j in range(len(iw)) if 0 <= j + shift < len(w)]
                best = max((sum(m[k:k + width]) for k in range(len(m) - width + 1)), default=0)
                if best * 100 >= percent * width:
                    n, a, b = out.get((d, i), (len(iw), 0, 0))
                    out[d, i] = (n, max(a, best), max(b, sum(m)))
    return out


def leaks(spark, docs, items, **kw):
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.item_words, r.window_hits, r.aligned_hits) for r in decontam.leaks(docs, items, **kw).collect()}


def substituted(item, gone):
    return " ".join(["before"] * 3 + [f"new{j}" if j in gone else w for j, w in enumerate(item)] + ["after"] * 3)


def patterns(items, most):
    """Documents with each item whole, each under every choice of up to ``most`` substituted places."""
    return list(enumerate(substituted(w, gone) for w in items for k in range(most + 1) for gone in combinations(range(len(w)), k)))


def item(n):
    return [f"i{n}.{j}" for j in range(n)]


def test_every_fifth_word_substituted(spark):
    items = [item(n) for n in (15, 20, 38, 59)]
    docs = list(enumerate(substituted(w, set(range(p, len(w), 5))) for w in items for p in range(5)))
    want = windows(docs, named := [(len(w), " ".join(w)) for w in items])
    assert len(want) == 19
    assert leaks(spark, docs, named) == want


@pytest.mark.parametrize("n", [9, 10, 11, 12, 13, 14])
def test_all_substitutions_of_an_item(spark, n):
    items = [item(n)]
    docs = patterns(items, 3)
    want = windows(docs, named := [(n, " ".join(w)) for w in items])
    assert 0 < len(want) < len(docs)
    assert leaks(spark, docs, named) == want


@pytest.mark.parametrize("window,percent", [(13, 60), (9, 100), (40, 75)])
def test_other_windows(spark, window, percent):
    items = [item(44)]
    docs = list(enumerate(substituted(items[0], {j for j in range(44) if j * p % 13 < q}) for p in range(1, 7) for q in range(8)))
    want = windows(docs, named := [(0, " ".join(items[0]))], window, percent)
    assert 0 < len(want) < len(docs)
    assert leaks(spark, docs, named, window=window, percent=percent) == want


def test_masks_are_complete():
    for width in range(9, 14):
        masks = decontam.masks_for(width, decontam.PERCENT)
        assert decontam.complete(masks, width, width * (100 - decontam.PERCENT) // 100)
    assert not decontam.complete(("110110011", "111010101"), 13, 2)


@pytest.mark.parametrize("n", [5, 6, 7, 8])
def test_all_substitutions_of_a_short_item(spark, n):
    docs = patterns([item(n)], 2)
    want = windows(docs, named := [(n, " ".join(item(n)))])
    assert len(want) == n + 1
    assert leaks(spark, docs, named) == want


def test_items_of_few_words(spark):
    named = [(n, " ".join(item(n))) for n in (0, 1, 2, 3, 4, 5, 20)] + [(7, "i1.0 i1.0"), (8, "IT IS")]
    docs = patterns([item(n) for n in (1, 2, 3, 4, 5, 20)], 1) + [(100, "i1.0 " * 50), (101, "it is, it is not"), (102, None), (103, "it")]
    want = windows(docs, named)
    assert {i for _, i in want} == {1, 2, 3, 4, 5, 20, 7, 8} and (101, 8) in want
    assert leaks(spark, docs, named) == want


def test_time_follows_the_length_of_a_repetitive_text(spark):
    """Twice the text, at most twice the time (and some); with one row per alignment it was four times."""
    import time

    item = [(1, "word and other words follow here word and other")]

    def seconds(n):
        t = time.perf_counter()
        text = "word and other words follow here " * n
        assert list(leaks(spark, [(1, text), (1, text)], item)) == [(1, 1)]
        return time.perf_counter() - t

    seconds(2000)  # compiles
    a, b = seconds(8000), seconds(16_000)
    assert b <= 2 * a + 2
