"""Column functions on times, priors, allowances and paging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference's time rules.
WEEK_MS = 604_800_000
PRIOR_UNIT_MS = 6_000
DAY_MS = 86_400_000
MAX_SECONDS_AGO = 8_640_000
DEFAULT_MAX = 10
MAX_MAX = 200


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def millis_between(later, earlier) -> Column:
    """Whole milliseconds from ``earlier`` to ``later`` (timestamps)."""
    return F.timestamp_diff("MILLISECOND", _c(earlier), _c(later))


def page_window(page, max_) -> tuple[Column, Column]:
    """F16: (max, start).  max: bad/absent -> 10, clamped to [1, 200];
    start = (page - 1) * max, bad or negative -> 0."""
    m = F.coalesce(_c(max_).cast("string").try_cast("int"), F.lit(DEFAULT_MAX))
    m = F.least(F.greatest(m, F.lit(1)), F.lit(MAX_MAX))
    p = _c(page).cast("string").try_cast("int")
    start = F.greatest(F.coalesce((p - F.lit(1)) * m, F.lit(0)), F.lit(0))
    return m, start


def seconds_ago(ts, now) -> Column:
    """``1 + (now - ts) / 1000`` whole seconds; negative or > 100 days -> 8,640,000."""
    ago = F.lit(1) + (millis_between(now, ts) / F.lit(1000)).cast("long")  # Java long division truncates
    return F.when((ago < 0) | (ago > MAX_SECONDS_AGO) | ago.isNull(), F.lit(MAX_SECONDS_AGO)).otherwise(ago)


def effective_prior(prior, ok, err, upsince, now) -> Column:
    """``coalesce(prior, 0) + ok/t - err/t``, ``t = max(now - upsince, 1 week) div 6000``."""
    t = F.floor(F.greatest(millis_between(now, upsince), F.lit(WEEK_MS)) / F.lit(PRIOR_UNIT_MS))
    return (
        F.coalesce(_c(prior).cast("double"), F.lit(0.0))
        + F.coalesce(_c(ok), F.lit(0)) / t
        - F.coalesce(_c(err), F.lit(0)) / t
    )


def allowance(allow, last_used, rate, now) -> Column:
    """``min(rate, int(allow + elapsed_ms / 86,400,000 * rate))``."""
    cur = _c(allow) + millis_between(now, last_used) / F.lit(DAY_MS) * _c(rate)
    return F.when(cur > _c(rate), _c(rate)).otherwise(cur.cast("int"))


def is_healthy(ok_ts, err_ts, n_err) -> Column:
    """last success not before last error, or no error at all."""
    return (_c(ok_ts) >= _c(err_ts)) | (_c(n_err) == 0)
