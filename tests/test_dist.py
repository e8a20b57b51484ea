"""Distribution functions against published table values and each other."""

import math

import pytest

from estimara.functions import dist


@pytest.mark.parametrize("value, want", [
    (dist.t_quantile(0.975, 10), 2.228138851964939), (dist.t_quantile(0.975, 1), 12.706204736432095), (dist.chi2_quantile(0.95, 1), 3.841458820694124), (dist.chi2_quantile(0.95, 10), 18.307038053275146),
    (dist.f_quantile(0.95, 3, 10), 3.708264819590506), (dist.normal_quantile(0.975), 1.959963984540054), (dist.normal_cdf(1.96), 0.9750021048517795), (dist.t_p(2.228138851964939, 10), 0.05), (dist.chi2_upper(18.307038053275146, 10), 0.05),
])
def test_table_values(value, want):
    assert value == pytest.approx(want, rel=1e-9)


def test_relations():
    for t, df in ((0.5, 3), (2.5, 7), (6.0, 40)):
        assert dist.f_upper(t * t, 1, df) == pytest.approx(dist.t_p(t, df), rel=1e-10)
        assert dist.t_cdf(t, df) + dist.t_cdf(-t, df) == pytest.approx(1)
    assert dist.t_p(1.3, 1e7) == pytest.approx(dist.normal_p(1.3), rel=1e-5)
    assert dist.chi2_upper(3.0, 2) == pytest.approx(math.exp(-1.5), rel=1e-12)
    assert sum(dist.gamma_tails(2.5, 3.1)) == pytest.approx(1, abs=1e-14)
    assert 0 < dist.t_p(60, 50) < 1e-40 and dist.t_p(math.inf, 5) == 0 and math.isnan(dist.t_p(math.nan, 5))
    for p in (0.01, 0.3, 0.8):
        assert dist.t_cdf(dist.t_quantile(p, 6), 6) == pytest.approx(p, abs=1e-12)
