"""Fees, payoffs, bet sizes and strategy-risk formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelight.functions.maths import norm_cdf

# Fee schedule.
FEE_RATE, MIN_FEE, REBATE_RATE = 0.07, 1e-5, 0.2


def risk_usd(shares: Column, p: Column) -> Column:
    """Dollars at risk: shares times the standard deviation of a binary payoff."""
    return shares * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)))


def fee_per_share(price: Column, rate: float = FEE_RATE) -> Column:
    return rate * price * (1 - price)


def taker_fee(shares: Column, price: Column, rate: float = FEE_RATE) -> Column:
    """Rounded half-even to five digits, and at least the smallest fee once there is any."""
    raw = shares * rate * price * (1 - price)
    return F.when(raw <= 0, 0.0).otherwise(F.greatest(F.bround(raw, 5), F.lit(MIN_FEE)))


def maker_rebate(shares: Column, price: Column, rebate: float = REBATE_RATE, rate: float = FEE_RATE) -> Column:
    return rebate * shares * rate * price * (1 - price)


def cost_of(price: Column) -> Column:
    return price + fee_per_share(price)


def price_from_cost(cost: Column, rate: float = FEE_RATE) -> Column:
    """The price whose price plus fee is ``cost``: a root of a quadratic."""
    return ((1 + rate) - F.sqrt((1 + rate) ** 2 - 4 * rate * cost)) / (2 * rate)


def bet_pnl(stake: Column, price: Column, payoff: Column) -> tuple[Column, Column, Column]:
    """Shares, fee and profit of a stake that pays price and fee."""
    shares = stake / cost_of(price)
    fee = shares * fee_per_share(price)
    return shares, fee, shares * payoff - stake


def binary_pnl(win: Column, price: Column, rate: float = FEE_RATE) -> Column:
    return win - price - rate * price * (1 - price)


def logit(p: Column, clip: float = 1e-3) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(q / (1 - q))


def dev_feature(last: Column, fair: Column) -> Column:
    return logit(F.coalesce(last, fair)) - logit(fair)


def size_from_prob(p: Column, classes: int = 2, side: Column | int = 1) -> Column:
    z = F.try_divide(p - 1.0 / classes, F.sqrt(p * (1 - p)))
    return F.lit(side) * (2 * norm_cdf(z) - 1) if isinstance(side, int) else side * (2 * norm_cdf(z) - 1)


def size_vs_price(p: Column, price: Column) -> Column:
    z = F.try_divide(p - price, F.sqrt(p * (1 - p)))
    return F.least(F.greatest(2 * norm_cdf(z) - 1, F.lit(0.0)), F.lit(1.0))


def kelly(p: Column, price: Column) -> Column:
    return F.when(price < 1, F.greatest((p - price) / (1 - price), F.lit(0.0))).otherwise(0.0)


def discrete_size(m: Column, step: float) -> Column:
    return F.least(F.greatest(F.bround(m / step) * step, F.lit(-1.0)), F.lit(1.0))


def bet_size(w: Column, x: Column) -> Column:
    return x / F.sqrt(w + x * x)


def dynamic_size(w: Column, x: Column, form: str = "sigmoid") -> Column:
    return bet_size(w, x) if form == "sigmoid" else F.signum(x) * F.pow(F.abs(x), w)


def calibrate(x: Column, m: Column, form: str = "sigmoid") -> Column:
    """The width at which divergence ``x`` gives size ``m``."""
    return x * x * (1 / (m * m) - 1) if form == "sigmoid" else F.ln(m) / F.ln(x)


def target_position(w: Column, forecast: Column, market: Column, most: int) -> Column:
    """Truncated toward zero."""
    return (bet_size(w, forecast - market) * most).cast("int")


def inverse_price(forecast: Column, w: Column, m: Column, form: str = "sigmoid") -> Column:
    if form == "sigmoid":
        return forecast - m * F.sqrt(w / (1 - m * m))
    return forecast - F.signum(m) * F.pow(F.abs(m), 1 / w)


def limit_price(target: Column, held: Column, forecast: Column, w: Column, most: int) -> Column:
    """Mean inverse price over the units between the held and the target position."""
    step = F.when(target > held, 1).otherwise(-1)
    units = F.sequence(held + step, target, step)
    total = F.aggregate(units, F.lit(0.0), lambda acc, j: acc + inverse_price(forecast, w, j / F.lit(float(most))))
    return F.when(target != held, total / F.abs(target - held))


def pq_decomposition(y: Column, price: Column, fee: Column, p: Column, q: Column) -> dict[str, Column]:
    """Profit of a share split into luck, model edge, mispricing and cost; the parts sum to the total."""
    return {"luck": y - p, "model_edge": p - q, "market_mispricing": q - price, "cost": -fee, "total": y - price - fee}


def sharpe_symmetric(p: Column, n: Column) -> Column:
    return (2 * p - 1) * F.sqrt(n) / (2 * F.sqrt(p * (1 - p)))


def sharpe_asymmetric(p: Column, n: Column, up: Column, down: Column) -> Column:
    return ((up - down) * p + down) * F.sqrt(n) / ((up - down) * F.sqrt(p * (1 - p)))


def implied_precision(down: Column, up: Column, n: Column, theta: float) -> Column:
    """The precision that gives Sharpe ratio ``theta``: the greater root of its quadratic."""
    a = (n + theta**2) * (up - down) * (up - down)
    b = (2 * n * down - theta**2 * (up - down)) * (up - down)
    c = n * down * down
    return (-b + F.sqrt(b * b - 4 * a * c)) / (2 * a)


def implied_frequency(down: Column, up: Column, p: Column, theta: float) -> Column:
    """Bets a year that give ``theta``; null where the mean bet has the other sign."""
    mean = (up - down) * p + down
    n = theta**2 * (up - down) * (up - down) * p * (1 - p) / (mean * mean)
    return F.when(F.signum(mean) == F.signum(F.lit(theta)), n)


def prob_z(sr: Column, n: Column, skew: Column, kurtosis: Column, benchmark: Column | float = 0.0) -> Column:
    """How many standard errors a Sharpe ratio is above the benchmark."""
    return (sr - benchmark) * F.sqrt(n - 1) / F.sqrt(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr)


def prob_sharpe(sr: Column, n: Column, skew: Column, kurtosis: Column, benchmark: float = 0.0) -> Column:
    """Probability that the true Sharpe ratio is above the benchmark."""
    return norm_cdf(prob_z(sr, n, skew, kurtosis, benchmark))


def bagged_variance(sigma: Column, rho: Column, n: Column) -> Column:
    return sigma * sigma * (rho + (1 - rho) / n)


def bagging_accuracy(n: Column, p: Column, classes: int = 2) -> Column:
    """Chance that more than ``n / classes`` of ``n`` independent votes are right: a binomial tail, summed in logs."""
    log_factorial = lambda m: F.aggregate(F.sequence(F.lit(0), m), F.lit(0.0), lambda acc, j: acc + F.ln(F.greatest(j, F.lit(1))))
    k = F.sequence(F.lit(0), F.floor(n / classes).cast("int"))
    term = lambda j: F.exp(log_factorial(n) - log_factorial(j) - log_factorial(n - j) + j * F.ln(p) + (n - j) * F.ln(1 - p))
    return 1 - F.aggregate(k, F.lit(0.0), lambda acc, j: acc + term(j))


def estimators_for_accuracy(p: Column, classes: int = 2) -> Column:
    edge = p - 1.0 / classes
    return p / (edge * edge)


def half_life(phi: Column) -> Column:
    return -F.ln(F.lit(2.0)) / F.ln(phi)


def phi_from_half_life(tau: Column) -> Column:
    return F.pow(F.lit(2.0), -1 / tau)


def gaussian_entropy(sigma: Column) -> Column:
    return 0.5 * F.ln(2 * F.pi() * F.e() * sigma * sigma)


def entropy_implied_sigma(h: Column) -> Column:
    return F.exp(h - 0.5) / F.sqrt(2 * F.pi())


def gaussian_mutual_information(rho: Column) -> Column:
    return -0.5 * F.ln(1 - rho * rho)


def allocation_ramp(days: Column, full: float, initial: float) -> Column:
    """Share of its weight that a strategy gets so many days after its start: ``initial``, rising as a square root to 1 at ``full``."""
    return F.least(F.lit(1.0), initial + (1 - initial) * F.sqrt(F.greatest(days, F.lit(0.0)) / full))
