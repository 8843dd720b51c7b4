"""What is done only where it is needed gives the same as doing all of it."""

import random

import numpy as np
import pyarrow as pa
import pytest

from dimweave.llm import ann, suffixes


def in_order(q, x):
    """Exact scores of all pairs, summed from the first to the last component."""
    out = np.zeros((len(q), len(x)))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(q.shape[1]):
            out += q[:, d : d + 1] * x[None, :, d]
    return out


@pytest.mark.parametrize("n", [5, 300, 3000])
@pytest.mark.parametrize("kind", ["floats", "doubles", "ties", "norms", "huge", "tiny"])
def test_few_exact_products_find_the_nearest(n, kind):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 24))
    if kind == "floats":
        x = x.astype(np.float32).astype(float)
    elif kind == "ties":
        x = np.round(x[r.integers(0, n, n) // 3], 1)
    elif kind == "norms":
        x *= 10.0 ** r.integers(-12, 12, (n, 1))
    elif kind in ("huge", "tiny"):
        x *= 1e160 if kind == "huge" else 1e-165
    ids = r.permutation(n) // 2 if kind == "ties" else r.permutation(n)  # repeated ids too
    own, q, k, pairs = ids[:200], x[:200], 20, 0
    assert (ann.unpack(ann.pack(x), 24) == x).all()
    want, every = [], in_order(q, x)
    for i, s in zip(own, every, strict=True):
        at = np.flatnonzero(ids != i)
        at = at[np.lexsort((ids[at], -s[at], ~np.isnan(s[at])))][:k]
        want.append([(ids[j], s[j].tobytes()) for j in at])
    got = []
    for of_q, of_x in ann.candidates(own, q, ids, x, k):
        pairs += len(of_q)
        s = ann.exact_scores(q, x, of_q, of_x)
        at, rank = ann.best(of_q, ids[of_x], s, k)
        assert (rank == np.concatenate([np.arange(m) for m in np.unique(of_q[at], return_counts=True)[1]])).all()
        for j in np.unique(of_q):
            got.append([(ids[b], v.tobytes()) for a, b, v in zip(of_q[at], of_x[at], s[at], strict=True) if a == j])
    assert got == want
    if n == 3000 and kind in ("floats", "doubles"):
        assert pairs < 2 * k * len(own)  # before, all n


def test_texts_of_a_block_are_cut_to_words_once(monkeypatch):
    """Matches and retained runs of many texts at a time are those of each alone."""
    made = []
    monkeypatch.setattr(suffixes, "Words", lambda texts, cut=suffixes.Words: made.append(len(texts)) or cut(texts))
    r = random.Random(5)
    word = lambda n: [f"é{r.randrange(9000)}" for _ in range(n)]
    shared = [word(60 + k) for k in range(4)]
    texts = [[*word(k), *shared[k % 4], *word(3), *shared[(k + 1) % 4], *word(k % 5)] for k in range(12)] + [word(20), [], word(50)]
    raw = [" \n".join(t) for t in texts]
    kept = pa.RecordBatch.from_arrays([pa.array(range(15)), pa.array(range(15)), pa.array(raw)], names=["id", "row", "text"])
    whole = [x for b in suffixes._retain_pass(iter([kept])) for x in b.to_pylist()]
    assert made == [15]
    assert whole == [x for i in range(15) for b in suffixes._retain_pass(iter([kept.slice(i, 1)])) for x in b.to_pylist()]
    assert {x["row"] for x in whole} == {*range(12), 14}

    # pairs of texts, at each place where 36 words of the one are in the other
    pairs = []
    for a in range(12):
        for b in range(a + 1, 12):
            at = {tuple(texts[b][j : j + 36]): j for j in range(len(texts[b]) - 35)}
            found = [{"at_a": i, "at_b": at[tuple(texts[a][i : i + 36])], "first_id_a": i % 7} for i in range(len(texts[a]) - 35) if tuple(texts[a][i : i + 36]) in at]
            if found:
                pairs.append((a, b, found[::-1], raw[a], raw[b]))
    spot = pa.list_(pa.struct([("at_a", pa.int32()), ("at_b", pa.int32()), ("first_id_a", pa.int64())]))
    firsts, ranges = {a: [{"lo": a, "hi": a + 2}, {"lo": 70, "hi": 70}] if a % 3 else None for a in range(12)}, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    names = ["row_a", "row_b", "pairs", "text_a", "text_b", "firsts_a", "firsts_b"]
    kinds = [pa.int64(), pa.int64(), spot, pa.string(), pa.string(), ranges, ranges]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*((*p, firsts[p[0]], firsts[p[1]]) for p in pairs), strict=True), kinds, strict=True)], names=names)
    made.clear()
    got = sorted(tuple(x.values()) for b in suffixes._extend_pass(50)(iter([batch])) for x in b.to_pylist())
    assert made == [12]
    want = []
    for a, b, found, *_ in pairs:
        matches = {}
        for p in found:
            i, j = p["at_a"], p["at_b"]
            while i and j and texts[a][i - 1] == texts[b][j - 1]:
                i, j = i - 1, j - 1
            n = 0
            while i + n < len(texts[a]) and j + n < len(texts[b]) and texts[a][i + n] == texts[b][j + n]:
                n += 1
            matches[i, j, n] = min(matches.get((i, j, n), 99), p["first_id_a"])
        for (i, j, n), first in matches.items():
            for me, at in ((a, i), (b, j)):
                late = not any(x["lo"] <= at + n - 50 and x["hi"] >= at for x in firsts[me] or ())
                start = len(" \n".join([*texts[me][:at], ""]).encode())
                want.append((me, n, start, start + len(" \n".join(texts[me][at : at + n]).encode()), int(late), first))
    assert got == sorted(want) and {x[4] for x in got} == {0, 1}
