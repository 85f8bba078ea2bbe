"""The BMES hidden Markov model against plain loops, for short and long runs, and its cost."""

import time

import numpy as np

from corpusforge.operators import segment as Z


def model(symbols, seed):
    r = np.random.default_rng(seed)
    m = Z.BmesHmm(symbols)
    move = m.ALLOWED * (r.random((4, 4)) ** 3 + 1e-4)
    m.move = move / move.sum(axis=1, keepdims=True)
    m.emit = r.dirichlet(np.ones(len(symbols) + 1) * 0.3, 4) + 1e-5
    return m


def plain_expected(m, x):
    """Forward-backward letter by letter."""
    n = len(x)
    a, b, scale = np.zeros((n, 4)), np.ones((n, 4)), np.zeros(n)
    for t in range(n):
        a[t] = (a[t - 1] @ m.move if t else m.start) * m.emit[:, x[t]]
        scale[t] = a[t].sum()
        a[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        b[t] = m.move @ (m.emit[:, x[t + 1]] * b[t + 1]) / scale[t + 1]
    move, emit = np.zeros((4, 4)), np.zeros_like(m.emit)
    for t in range(n):
        if t + 1 < n:
            move += np.outer(a[t], m.emit[:, x[t + 1]] * b[t + 1]) * m.move / scale[t + 1]
        emit[:, x[t]] += a[t] * b[t] / (a[t] * b[t]).sum()
    return move, emit


def plain_cut(m, text, x):
    with np.errstate(divide="ignore"):
        move, emit, score = np.log(m.move), np.log(m.emit), np.log(m.start)
    score, back = score + emit[:, x[0]], []
    for c in x[1:]:
        ways = score[:, None] + move
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + emit[:, c]
    states = [2 if score[2] > score[3] else 3]
    for b in back[::-1]:
        states.append(int(b[states[-1]]))
    ends = [i + 1 for i, s in enumerate(reversed(states)) if s >= 2]
    return [text[i:j] for i, j in zip([0, *ends], ends)]


def test_runs_side_by_side_equal_plain_loops():
    symbols = list("abcdeé中𠀀")
    r = np.random.default_rng(1)
    sizes = [1, 2, 1, 30, Z.LONG - 1, Z.LONG, Z.LONG + 1, Z.LONG + 2, 2 * Z.LONG, 2 * Z.LONG + 1, 3 * Z.LONG + 1, 2000, *r.integers(1, 20, 60)]
    texts = ["".join(r.choice([*symbols, "z", "λ"], n)) for n in sizes]  # two of them the model does not know
    n = r.integers(1, 1000, len(texts))
    for seed in (1, 2):
        m = model(symbols, seed)
        known = {c: i for i, c in enumerate(symbols)}
        codes = [[known.get(c, len(symbols)) for c in t] for t in texts]
        assert m.encode("".join(texts)).tolist() == sum(codes, [])
        move, emit = m.expected(m.encode("".join(texts)), np.array(sizes), n)
        want = [plain_expected(m, x) for x in codes]
        assert np.allclose(move, sum(k * w for k, (w, _) in zip(n, want)), rtol=1e-9)
        assert np.allclose(emit, sum(k * w for k, (_, w) in zip(n, want)), rtol=1e-9)
        assert m.cut_all(texts) == [plain_cut(m, t, x) for t, x in zip(texts, codes)]
    assert m.cut_all(["", "a", ""]) == [[], ["a"], []] and m.cut_all([]) == [] and m.cut("") == []


def test_cost_of_a_letter():
    """Letter by letter, a round and the best path took about 30 microseconds a letter (measured on 300 runs): 78 s for these."""
    r = np.random.default_rng(1)
    letters = "".join(r.choice(list("abcdefgh"), 2_600_000))
    texts = [letters[i : i + 10] for i in range(0, 600_000, 10)] + [letters[600_000:]]
    m = model(list("abcdefg"), 3)
    began = time.process_time()
    for at in range(0, len(texts), 10_000):
        some = texts[at : at + 10_000]
        _, emit = m.expected(m.encode("".join(some)), np.array(list(map(len, some))), np.ones(len(some)))
        assert abs(emit.sum() - sum(map(len, some))) < 1e-3
        assert ["".join(t) for t in m.cut_all(some)] == some
    assert time.process_time() - began < 18


def test_tokens_of_texts_on_their_way(spark):
    """Tokens restore the texts, whatever stands between the runs; equal runs have equal tokens in every text."""
    texts = ["abab cd_12 abab", None, "", " \n", "Ünï 𠀀𠀀, ½x ٣٤ İΣ abab", "x" * 1500 + " abab", "áb 1a2b -- __"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.tokens for r in Z.hmm_segmented(df).collect()}
    assert got[1] == got[2] == got[3] == []
    for k, t in enumerate(texts):
        parts = Z.PARTS.findall((t or "").lower())
        assert "".join(got[k]) == "".join(parts)
        ends = {sum(map(len, got[k][:i])) for i in range(len(got[k]) + 1)}
        assert {sum(map(len, parts[:i])) for i in range(len(parts) + 1)} <= ends  # no token crosses a part
        at = 0
        for p in parts:
            own = sorted(e - at for e in ends if at < e <= at + len(p))
            assert p[0].isalpha() or own == [len(p)]
            at += len(p)


def test_tokens_over_flat_arrays_equal_the_plain_ones():
    """Whatever the characters and wherever a piece ends."""
    r = np.random.default_rng(3)
    odd = [*"aA1_-. \n\t\0", *map(chr, (0x130, 0x3A3, 0xBD, 0xB2, 0x2460, 0x663, 0xA0, 0x1C, 0x85, 0x3000, 0x200B, 0x301, 0x4E2D, 0x20000, 0x1F600, 0x2163, 0xE000, 0x10FFFF, 0x1D7CE))]
    texts = ["".join(r.choice(odd, k)) for k in r.integers(0, 40, 300)] + [None, "", " ", "a" * 1500, "_" * 300 + "ab" * 300, None]
    m = model(list("abi中"), 4)
    want = Z.by_runs(m.cut)(texts)
    for piece in (3, 100, 1 << 18):
        assert Z.FlatTokens(m.ends, piece)(texts).to_pylist() == want
    few = Z.FlatTokens(m.ends)
    assert few([]).to_pylist() == [] and few([None, "", " "]).to_pylist() == [[], [], []] and few(["", "1", ""]).to_pylist() == [[], ["1"], []]
