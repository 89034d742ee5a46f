import math

import pytest

from quillgraph.operators import stats as S


def test_tails():
    assert S.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert S.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert S.t_tail(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert S.normal_tail(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_binomial_and_published_corrections():
    raw = [S.binomial_test(126, 200), S.binomial_test(82, 181), S.binomial_test(13, 41)]
    assert raw[0] == pytest.approx(0.00029, abs=2e-5)
    assert round(S.bonferroni([raw[0], 0.5, 0.5], compat=True)[0], 3) == 0.002
    assert round(S.bonferroni([raw[0], 0.5, 0.5])[0], 3) == 0.001
    assert [round(p, 3) for p in S.bonferroni(raw[1:2] + [0.9])][0] == 0.468 and round(S.bonferroni([0.9, raw[2]])[1], 3) == 0.055


def test_chi2():
    x, p, dof = S.chi2_independence([[10, 20], [20, 10]])
    assert (round(x, 4), dof) == (5.4, 1) and p == pytest.approx(0.0201, abs=1e-4)
    assert S.chi2_independence([[5, 5], [0, 0]]) == (0.0, 1.0, 0)


def test_t_test():
    t, p, dof = S.t_test((5, 3.0, 2.5), (5, 5.0, 2.5))
    assert (t, dof) == (pytest.approx(-2.0), 8) and p == pytest.approx(0.0805, abs=1e-4)


def test_kappa_and_prf(spark):
    df = spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15 + [(None, "y")], "a string, b string")
    k = S.kappa(df, "a", "b").first()
    assert k["n"] == 50 and k["kappa"] == pytest.approx(0.4)
    r = S.precision_recall(df.where("a is not null"), "a", "b", "y").first()
    assert (r["precision"], r["recall"]) == (pytest.approx(2 / 3), pytest.approx(0.8))


@pytest.mark.parametrize("family", ["negative_binomial", "gaussian"])
def test_glm_of_two_groups_is_the_ratio_of_means(spark, family):
    df = spark.createDataFrame([(0.0, 2), (0.0, 4), (1.0, 8), (1.0, 10), (None, 3)], "x double, y long")
    const = S.log_link_glm(df.where("x is not null"), "y", [], family)[0]
    assert const["coef"] == pytest.approx(math.log(6), abs=1e-8)
    a, b = S.log_link_glm(df, "y", ["x"], family)
    assert a["coef"] == pytest.approx(math.log(3), abs=1e-7) and b["coef"] == pytest.approx(math.log(3), abs=1e-7)
    if family == "negative_binomial":  # information of a saturated group: n * mu / (1 + mu)
        assert a["se"] == pytest.approx(math.sqrt(1 / (2 * 3 / 4)), rel=1e-6)


@pytest.mark.parametrize("p", [0.5, 0.3, 0.9])
def test_binomial_test_equals_the_sum_of_outcomes(p):
    for n in (1, 2, 7, 30):
        mass = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        for k in range(n + 1):
            assert S.binomial_test(k, n, p) == pytest.approx(min(1.0, sum(m for m in mass if m <= mass[k] * (1 + 1e-6))), abs=1e-9)
    assert 0 < S.binomial_test(5_000_500_000, 10_000_000_000) < 1  # no loop over outcomes


def test_t_interval():
    low, high = S.t_interval((5, 3.0, 2.5), (5, 5.0, 2.5))
    assert (low + high) / 2 == pytest.approx(-2) and (high - low) / 2 == pytest.approx(2.306004135, abs=1e-6)
