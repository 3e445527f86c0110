"""Robust estimates of the quality rules: at their fixed points, and with floors that leave every statistic a say."""

import numpy as np

from rankweave.llm import quality_rules
from tests.llm import plain
from tests.llm.conftest import prose

NAMES = [f"v_{k}" for k in ("word_length", "symbols", "same_lines", "repeats", "capitals")]


def step(x, m, s):
    """One concentration step: centre and covariance of the rings of distance that hold the nearest three fifths."""
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    ring = np.floor(np.log2(d + 1) * 32).astype(int)
    values, count = np.unique(ring, return_counts=True)
    core = x[ring <= values[np.cumsum(count) - count < len(x) * quality_rules.CORE].max()]
    m = core.mean(axis=0)
    return m, core.T @ core / len(core) - np.outer(m, m) + np.diag([quality_rules.FLOOR[v] ** 2 for v in NAMES])


def inverse(row):
    a = np.array([[row[f"a_{max(i, j)}_{min(i, j)}"] for j in range(5)] for i in range(5)])
    return np.linalg.inv(a)


def slow(seed, n):
    """A group whose core drifts for many steps: a dense part, and a far wider one beside it."""
    rng = np.random.default_rng(seed)
    near, wide = rng.normal(1, 0.25, (n // 2, 5)), rng.normal(1.6, 0.9, (n - n // 2, 5))
    return np.round(np.vstack([near, wide]) * quality_rules.UNIT)


def test_estimates_are_fixed_points(spark):
    groups = {g: slow(g, n) for g, n in ((2, 3000), (3, 300))}
    rows = [(g, *map(int, r)) for g, x in groups.items() for r in x]
    got = {r["__g"]: r for r in quality_rules.robust_estimates(spark.createDataFrame(rows, ["__g", *NAMES]), NAMES).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        x, m, s = x / quality_rules.UNIT, np.array([got[g][f"m_{i}"] for i in range(5)]), inverse(got[g])
        seen, at = [], (m, s)
        for _ in range(6):  # itself again, or a cycle of a few cores of which it has the least determinant
            at = step(x, *at)
            seen.append(np.linalg.slogdet(at[1])[1])
            if np.allclose(at[0], m, atol=1e-7) and np.allclose(at[1], s, atol=1e-7):
                break
        else:
            raise AssertionError(f"group {g} is not at its end")
        assert min(seen) >= np.linalg.slogdet(s)[1] - 1e-6


def test_steps_that_run_out_are_reported(spark, monkeypatch):
    rows = [(1, *map(int, r)) for r in slow(1, 1000)]
    frame = spark.createDataFrame(rows, ["__g", *NAMES])
    assert [r["settled"] for r in quality_rules.robust_estimates(frame, NAMES).collect()] == [True]
    monkeypatch.setattr(quality_rules, "MOST_STEPS", 2)
    assert [r["settled"] for r in quality_rules.robust_estimates(frame, NAMES).collect()] == [False]


def test_copied_lines_or_words_reject_by_themselves(spark):
    clean = [(i, "\n".join(prose(1000 * i + j, 10) for j in range(20))) for i in range(80)]
    lines = [prose(10**6 + j, 10) for j in range(16)]
    copied = [y for i, line in enumerate(lines) for y in (["melons"] * (1 + (i < 10)) + [line])][:-1]
    words = prose(2 * 10**6, 155).split()
    repeated = words[:110] + words[:45] + words[110:]
    rows = [*clean, (900, "\n".join(copied)), (901, "\n".join(" ".join(repeated[i:i + 7]) for i in range(0, 200, 7)))]
    *_, n_dup, n_repeat = plain.text_counts(rows[-2][1])
    assert n_dup / len(copied) > 0.6 and n_repeat == 0
    n_words, _, _, n_dup, n_repeat = plain.text_counts(rows[-1][1])
    assert n_dup == 0 and 0.44 <= n_repeat / n_words <= 0.46
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert not out[900]["kept"] and not out[901]["kept"]
    assert all(out[i]["kept"] for i, _ in clean)
