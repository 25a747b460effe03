"""Repeats within one stretch of windows."""
import hashlib
import random

import numpy as np
import pytest

from fleetsieve.llm import repeats


def brute(texts, size):
    """(bytes, removed, runs, digest of the rest) of every text, by all windows."""
    bodies, times = [t.encode() for t in texts], {}
    for b in bodies:
        for i in range(len(b) - size + 1):
            times[b[i:i + size]] = times.get(b[i:i + size], 0) + 1
    out = []
    for b in bodies:
        gone = set()
        for i in range(len(b) - size + 1):
            if times[b[i:i + size]] > 1:
                gone.update(range(i, i + size))
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        out.append((len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("heavy", [1 << 17, 10])
def test_a_text_that_repeats_only_itself_within_a_stretch(spark, heavy):
    texts = ["-" * 401, "head " + "=+" * 230 + " tail", "x" * 400, "ab", "é" * 260, "Once upon a time. " * 26]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(docs, heavy=heavy).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, 400)
    assert found[0][1] == 401 and found[2][1] == 0


def test_every_stretch_that_holds_a_window_twice_is_marked():
    rnd = random.Random(4)
    for gram in (3, 8, 12):
        grams = repeats.Grams(12, gram)
        for _ in range(40):
            period = bytes(rnd.choices(b"abcdefgh", k=rnd.randint(1, 14)))
            body = bytes(rnd.choices(b"xyz", k=rnd.randint(0, 9))) + (period * 40)[:rnd.randint(1, 40)] + bytes(rnd.choices(b"xyzabc", k=rnd.randint(0, 20)))
            for _, at, size, _, within in repeats._marked(np.frombuffer(body, np.uint8), np.array([len(body)]), grams):
                for p, s, marked in zip(at, size, within):
                    windows = [body[i:i + 12] for i in range(p, p + s - 11)]
                    assert marked or len(set(windows)) == len(windows)
