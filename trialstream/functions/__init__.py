"""Column expressions: all stay in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Responses count in the half-open window (start, stop] after the event, in seconds.
RESPONSE_START, RESPONSE_STOP = 0.15, 0.75


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """Not null, not NaN and not infinite."""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def null_or(part: Column, *inputs: Column | str) -> Column:
    """part, but null where an input is null."""
    missing = F.lit(False)
    for c in inputs:
        missing = missing | col(c).isNull()
    return F.when(~missing, part)


def differs(a: Column | str, b: Column | str) -> Column:
    """a <> b, null where either is null."""
    return null_or(col(a) != col(b), a, b)


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null without a match."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


IMAGE_TOKEN = r"^(.+)_r-?(\d+(?:\.\d+)?)$"


def image_identity(c: Column | str) -> Column:
    """The name part of an image token such as `im115_r-0.7`."""
    return extract(c, IMAGE_TOKEN, 1)


def image_contrast(c: Column | str) -> Column:
    """The number of an image token, or null."""
    return extract(c, IMAGE_TOKEN, 2).try_cast("double")


def normalized_category(c: Column | str) -> Column:
    """Trimmed text; `<missing>` for null and blank."""
    return F.coalesce(F.nullif(F.trim(col(c).cast("string")), F.lit("")), F.lit("<missing>"))


_DIGITS = "0123456789"


def whole_number(text: Column) -> Column:
    """The number that text consists of, or null."""
    return F.when((F.translate(text, _DIGITS, "") == "") & (text != ""), text.try_cast("int"))


def recording_day(day: Column | str, number: Column | str) -> Column:
    """The day of a session: what follows the label of `EPHYS_3`, or a plain number, and the session's number where the day says nothing. Null where both disagree or it isn't positive."""
    text = F.upper(F.trim(col(day).cast("string")))
    parsed = whole_number(F.when(F.startswith(text, F.lit("EPHYS")), F.ltrim(F.substring(text, 6, 100), F.lit(" _-"))).otherwise(text))
    number = col(number).try_cast("int")
    found = F.coalesce(parsed, number)
    return F.when((found > 0) & F.coalesce(parsed == number, F.lit(True)), found)


def response_window(c: Column | str) -> Column:
    """A JSON array of two finite increasing numbers as an array, else null."""
    pair = F.from_json(col(c), "array<double>")
    ok = (F.size(pair) == 2) & is_finite(pair[0]) & is_finite(pair[1]) & (pair[0] < pair[1])
    return F.when(ok, pair)


def session_asset(path: Column | str) -> Column:
    """Whether a path names a subject's session file: a folder of the subject, and in it a file named by the folder and a time stamp of eight and six digits."""
    parts = F.split(col(path), "/")
    folder, name = parts[0], F.get(parts, F.lit(1))
    stamp = F.substring(name, F.length(folder) + 6, 15)
    dated = (F.translate(stamp, _DIGITS, "") == "T") & (F.length(stamp) == 15) & (F.substring(stamp, 9, 1) == "T")
    named = (name == F.concat(folder, F.lit("_ses-"), stamp, F.lit(".nwb"))) & F.startswith(folder, F.lit("sub-")) & (F.length(folder) > 4)
    return F.coalesce((F.size(parts) == 2) & named & dated, F.lit(False))


def reasons(*pairs: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order, joined by `;`; empty if none does."""
    return F.concat_ws(";", *[F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in pairs])


@dataclass(frozen=True)
class UnitThresholds:
    max_isi: float = 0.5
    max_amplitude_cutoff: float = 0.1
    quality: str = "good"
    require_nonnegative: bool = True


def well_isolated(thresholds: UnitThresholds = UnitThresholds(), isi: str = "isi_violations", cutoff: str = "amplitude_cutoff", quality: str = "quality") -> Column:
    """Finite, not negative and strictly below both thresholds, with the wanted quality label."""

    def one(c: str, most: float) -> Column:
        ok = is_finite(c) & (F.col(c) < most)
        return ok & (F.col(c) >= 0) if thresholds.require_nonnegative else ok

    return F.coalesce(one(isi, thresholds.max_isi) & one(cutoff, thresholds.max_amplitude_cutoff) & (F.col(quality) == thresholds.quality), F.lit(False))


def unit_reasons(thresholds: UnitThresholds = UnitThresholds(), isi: str = "isi_violations", cutoff: str = "amplitude_cutoff", quality: str = "quality") -> Column:
    """Why a unit isn't well isolated: invalid values apart from those over the threshold."""
    out = []
    for name, c, most in (("isi_violations", isi, thresholds.max_isi), ("amplitude_cutoff", cutoff, thresholds.max_amplitude_cutoff)):
        bad = ~is_finite(c) | (F.col(c) < 0) if thresholds.require_nonnegative else ~is_finite(c)
        out += [(f"{name}_invalid", F.coalesce(bad, F.lit(True))), (f"{name}_above_threshold", ~F.coalesce(bad, F.lit(True)) & (F.col(c) >= most))]
    return reasons(*out, ("quality_not_good", ~F.col(quality).eqNullSafe(F.lit(thresholds.quality))))


def wilson_interval(successes: Column, trials: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval, clipped to [0, 1]; null without trials."""
    n = F.when(trials > 0, trials.cast("double"))
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    # greatest and least skip nulls
    return F.when(trials > 0, F.greatest(F.lit(0.0), middle - half)), F.when(trials > 0, F.least(F.lit(1.0), middle + half))


#: Coefficients of the rational approximation of the inverse normal distribution (P. J. Acklam).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_LOW = 0.02425


def _horner(coefficients: tuple[float, ...], x):
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def _quantile(p: Column) -> Column:
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    outer = _horner(_C, tail) / _horner(_D, tail)
    q = p - 0.5
    inner = _horner(_A, q * q) * q / _horner(_B, q * q)
    return F.when((p > 0) & (p < 1), F.when(p < _LOW, outer).when(p > 1 - _LOW, -outer).otherwise(inner))


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1, null otherwise; relative error below 2e-9."""
    # bound once as a lambda's variable, so that plans stay small
    return F.element_at(F.transform(F.array(p.cast("double")), _quantile), 1)


def inverse_normal_sql(p: str) -> str:
    """The same as SQL text."""

    def horner(coefficients: tuple[float, ...], x: str) -> str:
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r})"
        return f"CAST({out} AS DOUBLE)"

    tail, q = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"({p} - 0.5)"
    outer = f"{horner(_C, tail)} / {horner(_D, tail)}"
    inner = f"{horner(_A, f'({q} * {q})')} * {q} / {horner(_B, f'({q} * {q})')}"
    return f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {_LOW} THEN {outer} WHEN {p} > {1 - _LOW} THEN -({outer}) ELSE {inner} END"


def loglinear_dprime(hits: Column, go: Column, false_alarms: Column, catch: Column) -> Column:
    """z((hits + .5) / (go + 1)) - z((false alarms + .5) / (catch + 1)); null without go or catch trials."""
    value = inverse_normal((hits + 0.5) / (go + 1)) - inverse_normal((false_alarms + 0.5) / (catch + 1))
    return F.when((go > 0) & (catch > 0), value)


def is_sorted(values: Column | str) -> Column:
    """Whether an array is finite throughout and doesn't decrease; true for an empty one, null for null."""
    v = col(values)
    places = F.when(F.size(v) > 1, F.sequence(F.lit(1), F.size(v) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(v.isNotNull(), F.forall(v, is_finite) & F.forall(places, lambda i: F.element_at(v, i) <= F.element_at(v, i + 1)))


def window_count(values: Column | str, start: Column, stop: Column) -> Column:
    """How many values lie in [start, stop)."""
    return F.size(F.filter(col(values), lambda s: (s >= start) & (s < stop)))


def lick_free(licks: Column | str, event: Column | str, before: float, after: float, tolerance: float = 8 * 2.220446049250313e-16) -> Column:
    """No lick in the closed interval from before to after the event; false for null arrays or values and invalid events."""
    t = col(event)
    clear = F.forall(col(licks), lambda x: is_finite(x) & ((x < t - before - tolerance) | (x > t + after + tolerance)))
    return F.coalesce(is_finite(event) & clear, F.lit(False))


def lick_response(event: Column | str, licks: Column | str, start: float = RESPONSE_START, stop: float = RESPONSE_STOP) -> Column:
    """A struct of status, response, latency, n_raw, n_unique, n_duplicates from an event time and an array of licks.

    status: invalid_event_time, missing, invalid (a value isn't finite), unsorted or pass; response and latency are
    null unless it is pass. Exact duplicates count once. A lick at start isn't a response, one at stop is.
    """
    t, v = col(event).cast("double"), col(licks)
    unique = F.array_distinct(v)
    status = F.when(~is_finite(t), "invalid_event_time").when(v.isNull(), "missing").when(~F.forall(v, is_finite), "invalid").when(~is_sorted(v), "unsorted").otherwise("pass")
    inside = F.filter(unique, lambda x: (x - t > start) & (x - t <= stop))
    ok = status == "pass"
    return F.struct(
        status.alias("status"), F.when(ok, F.size(inside) > 0).alias("response"), F.when(ok & (F.size(inside) > 0), F.array_min(inside) - t).alias("latency"),
        F.when(v.isNotNull(), F.size(v)).alias("n_raw"), F.when(v.isNotNull(), F.size(unique)).alias("n_unique"), F.when(v.isNotNull(), F.size(v) - F.size(unique)).alias("n_duplicates"),
    )


def stabilized(count: Column) -> Column:
    """Square root of a count plus 3/8."""
    return F.sqrt(count + 0.375)


def stabilized_response(spikes: Column | str, event: Column, response: tuple[float, float], baseline: tuple[float, float], stop: Column | None = None, width: float | None = None) -> Column:
    """Variance-stabilised rate in the response window less that in the baseline window, both relative to the event.

    With stop and width the response window consists of bins of that width, of which only those that end by stop
    after the event count; NaN if none does.
    """

    def part(a, b, duration) -> Column:
        return stabilized(window_count(spikes, event + a, event + b)) / F.sqrt(duration)

    base = part(F.lit(baseline[0]), F.lit(baseline[1]), F.lit(baseline[1] - baseline[0]))
    if stop is None:
        return part(F.lit(response[0]), F.lit(response[1]), F.lit(response[1] - response[0])) - base
    bins = F.least(F.floor((stop - response[0]) / width + 1e-9), F.lit(round((response[1] - response[0]) / width)))
    end = F.lit(response[0]) + bins * width
    return F.when(bins > 0, part(F.lit(response[0]), end, bins * width) - base).otherwise(F.lit(float("nan")))


def structure_path(c: Column | str) -> Column:
    """`/997/8/` as an array of integers."""
    return F.transform(F.filter(F.split(col(c), "/"), lambda x: x != ""), lambda x: x.cast("int"))


#: Families of physical types.
DTYPE_FAMILIES = {
    "integer": ("tinyint", "smallint", "int", "bigint"),
    "numeric": ("tinyint", "smallint", "int", "bigint", "float", "double"),
    "string": ("string",),
    "boolean": ("boolean",),
    "list_numeric": ("array<int>", "array<bigint>", "array<float>", "array<double>"),
    "list_string": ("array<string>",),
}


def dtype_compatible(observed: Column | str, expected: Column | str) -> Column:
    """Whether a physical type belongs to the expected family."""
    out = F.lit(False)
    for family, kinds in DTYPE_FAMILIES.items():
        out = F.when(col(expected) == family, col(observed).isin(*kinds)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def portable_draw(n: Column, *parts: Column) -> Column:
    """A number from 0 to n - 1 drawn by a hash of parts: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint") % n


def reversible(e1: Column, nr: Column, e2: Column) -> Column:
    """Half of both outer blocks less the middle one."""
    return 0.5 * e1 - nr + 0.5 * e2


def dominant_class(early: Column, late: Column, action: Column) -> tuple[Column, Column, Column]:
    """(class, sign, margin) of the response of largest size; the first of equal ones."""
    sizes = F.array(F.abs(early), F.abs(late), F.abs(action))
    at = F.array_position(sizes, F.array_max(sizes))
    own = F.element_at(F.array(early, late, action), at.cast("int"))
    ordered = F.sort_array(sizes, asc=False)
    return F.element_at(F.array(F.lit("early"), F.lit("late"), F.lit("action")), at.cast("int")), F.signum(own), ordered[0] - ordered[1]


def z_of(confidence: float) -> float:
    """The two-sided normal quantile of a confidence level."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(0.5 + confidence / 2)
