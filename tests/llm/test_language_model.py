import math
import re
import zlib
from collections import Counter

import pytest

from sitequarry.llm import backoff_lm


def tokens_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def brute_force(rows, order, mass):
    texts = [(i, tokens_of(t), zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in rows]
    counts = Counter()
    for _, t, held in texts:
        if not held:
            padded = ["<s>", *t]
            for n in range(1, order + 1):
                counts.update(tuple(padded[k : k + n]) for k in range(len(padded) - n + 1))
    words = {g[0]: c for g, c in counts.items() if len(g) == 1 and g[0] != "<s>"}
    n, v = sum(words.values()), len(words)

    def p(context, w):
        if not context:
            return (words.get(w, 0) + 1) / (n + v + 1)
        c = counts[context] if context != ("<s>",) else counts[("<s>",)]
        return (counts[(*context, w)] + mass * p(context[1:], w)) / (c + mass)

    out = []
    for i, t, held in texts:
        padded = ["<s>", *t]
        score = sum(math.log10(p(tuple(padded[max(0, k - order + 1) : k]), padded[k])) for k in range(1, len(padded)))
        base = sum(math.log10((words.get(w, 0) + 1) / (n + 1 * (v + 1))) for w in t)
        out.append((i, held, len(t), sum(words.get(w, 0) > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("name,order,block", [("documents", 2, 60_000), ("documents", 3, 1 << 22), ("odd", 2, 3000), ("odd", 1, 1 << 20)])
def test_scores_equal_brute_force(request, name, order, block):
    docs = request.getfixturevalue(name)
    got = backoff_lm.score(docs, order=order, mass=20.0, block_bytes=block).collect()
    want = brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], order, 20.0)
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6)


def test_model_beats_the_base_on_held_out_texts(documents):
    rows = backoff_lm.score(documents).where("held_out").toPandas()
    assert rows.score.sum() > rows.base_score.sum()


def test_probabilities_sum_to_one():
    texts = ["a b a c", "a b b", None]
    grams = backoff_lm.Grams([*texts, "a b c d"], 2)
    import numpy as np

    counts = grams.counts(np.array([True, True, True, False]))
    count = np.split(counts, np.cumsum([*map(len, grams.key)])[:-1])
    words = grams.tokens[grams.at[0]] != backoff_lm.BEGIN
    n, v = int(count[0][words].sum()), int((count[0][words] > 0).sum())
    model = backoff_lm.BackoffAutomaton(grams, count, n, v, 5.0)
    seen = [int(t) for t, c in zip(grams.tokens[grams.at[0]], count[0]) if c > 0 and t != backoff_lm.BEGIN]
    unseen = next(int(t) for t, c in zip(grams.tokens[grams.at[0]], count[0]) if c == 0)
    assert sum(10 ** model.score([t]) for t in [*seen, unseen]) == pytest.approx(1)
    first = next(t for t in seen if t != backoff_lm.END)  # nothing follows an end
    assert sum(10 ** (model.score([first, t]) - model.score([first])) for t in [*seen, unseen]) == pytest.approx(1)


def test_nothing_to_score(none):
    assert backoff_lm.score(none).count() == 0
