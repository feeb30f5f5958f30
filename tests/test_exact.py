import itertools
import math

import pytest

from tausift.functions.exact import kendall_exact, kendall_normal, mann_whitney_exact, normal_tail, rank_sum_greater, student_tail


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6])
def test_kendall_exact_by_enumeration(n):
    counts = [sum(p[i] > p[j] for i, j in itertools.combinations(range(n), 2)) for p in itertools.permutations(range(n))]
    pairs = n * (n - 1) // 2
    for d in range(pairs + 1):
        far = abs(pairs - 2 * d)
        assert kendall_exact(d, n) == pytest.approx(sum(abs(pairs - 2 * c) >= far for c in counts) / len(counts))


def test_kendall_exact_published():
    # 25 entities, tau 0.34: 99 discordant of 300 pairs
    assert kendall_exact(99, 25) == pytest.approx(0.0168, abs=2e-3)


@pytest.mark.parametrize("n1,n2", [(2, 3), (3, 3), (4, 2)])
def test_mann_whitney_by_enumeration(n1, n2):
    us = [sum(a > b for a in pick for b in set(range(n1 + n2)) - set(pick)) for pick in itertools.combinations(range(n1 + n2), n1)]
    for u in range(n1 * n2 + 1):
        assert mann_whitney_exact(u, n1, n2) == pytest.approx(sum(x >= u for x in us) / len(us))


def test_mann_whitney_published():
    assert mann_whitney_exact(91, 5, 21) == pytest.approx(0.004925509273335359)
    assert mann_whitney_exact(83, 5, 21) == pytest.approx(0.02432350258437215)


def test_tails():
    assert normal_tail(1.959963984540054) == pytest.approx(0.05)
    assert student_tail(2.2281388519649385, 10) == pytest.approx(0.05)
    assert student_tail(12.706204736432095, 1) == pytest.approx(0.05)
    assert student_tail(0, 5) == 1.0
    assert math.isnan(kendall_normal(0, 0, 1, [], []))
    assert kendall_normal(0, 0, 2, [2], []) != kendall_normal(0, 0, 2, [2], [])  # no variance: not a number


def test_kendall_with_ties():
    # 12 pairs with ties, variance by hand: groups of 2 and 3 on one side, of 2 on the other
    n, v = 12, lambda t: t * (t - 1) * (2 * t + 5)
    variance = (v(12) - v(2) - v(3) - v(2)) / 18 + 8 * 2 / (2 * n * 11) + 6 * 0 / (9 * n * 11 * 10)
    assert kendall_normal(50, 10, n, [2, 3], [2]) == pytest.approx(normal_tail(40 / math.sqrt(variance)))


def test_rank_sum():
    assert rank_sum_greater(91, 5, 21, []) == pytest.approx(0.004925509273335359)
    plain = math.erfc((330 - 200 - 0.5) / math.sqrt(400 / 12 * 41) / math.sqrt(2)) / 2
    assert rank_sum_greater(330, 20, 20, []) == pytest.approx(plain)
    assert rank_sum_greater(330, 20, 20, [5, 4]) < plain and math.isnan(rank_sum_greater(2, 2, 2, [4]))
