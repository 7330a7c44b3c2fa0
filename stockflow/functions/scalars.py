"""Scalar rules as Column expressions (X1-X8, X10-X14); all JVM-side, no UDFs.

Money is a (decimal amount, currency) pair. Operations that the source
application would throw on (currency mismatch, negative result) yield a NULL
amount plus an error text instead, so a batch never aborts on one bad row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockflow.functions.enums import ASSIGNED, COMPLETED, IN_PROGRESS, PENDING

# Fixed values (must equal the source application's texts and rules):
#   open-ended period end sentinel: 9999-12-31 23:59:59.999999
#   default address when blank: street "Unknown", city "Unknown", state "TX", zip "00000", country "USA"
#   US ZIP shape: 5 digits, or 5 digits, a hyphen and 4 digits
#   VIN: 17 letters or digits after trim and upper-casing; short VIN = last 8; missing model -> "Unknown"
#   work-order number shape: WO-<4-digit year>-<5 digits>, random part drawn from 10000..99998
#   status texts: "Waiting for assignment", "Scheduled for <MM/dd/yyyy>", "⚠️ DELAYED - In Progress",
#                 "Currently being worked on", "✅ Completed", "Unknown status"
#   ledger notes: "Reserved {n} parts for work order", "Released {n} parts reservation",
#                 "Issued {n} parts to work order", "Received {n} parts", "Moved from {old} to {new}"
OPEN_END = "9999-12-31 23:59:59.999999"
ZIP_PATTERN = r"^[0-9]{5}(-[0-9]{4})?$"
VIN_PATTERN = r"^[\p{L}\p{Nd}]{17}$"
WO_NUMBER_PATTERN = r"^WO-[0-9]{4}-[0-9]{5}$"
WO_NUMBER_LOW, WO_NUMBER_HIGH = 10000, 99998


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


# -- X1 money ------------------------------------------------------------------

def same_currency(cur_a, cur_b) -> Column:
    return F.upper(_c(cur_a)) == F.upper(_c(cur_b))


def money_add(a, cur_a, b, cur_b) -> Column:
    """a + b in a's currency; NULL when the currencies differ."""
    return F.when(same_currency(cur_a, cur_b), _c(a) + _c(b))


def money_sub(a, cur_a, b, cur_b) -> Column:
    """a - b; NULL when the currencies differ or the result would be negative."""
    d = _c(a) - _c(b)
    return F.when(same_currency(cur_a, cur_b) & (d >= 0), d)


def money_sub_error(a, cur_a, b, cur_b) -> Column:
    return (F.when(~same_currency(cur_a, cur_b), F.lit("currency mismatch"))
             .when(_c(a) - _c(b) < 0, F.lit("negative amount")))


def money_mul(a, factor) -> Column:
    """amount x factor; NULL for a negative factor."""
    return F.when(_c(factor) >= 0, _c(a) * _c(factor))


def money_gt(a, cur_a, b, cur_b) -> Column:
    return F.when(same_currency(cur_a, cur_b), _c(a) > _c(b))


def money_lt(a, cur_a, b, cur_b) -> Column:
    return F.when(same_currency(cur_a, cur_b), _c(a) < _c(b))


# -- X2 / X3 -------------------------------------------------------------------------

def profit_margin(price, cost, price_cur=None, cost_cur=None) -> Column:
    """(price - cost) / price x 100 as double; 0 when price is 0.

    NULL when the subtraction is refused (cost above price or mixed currencies).
    """
    p, c = _c(price), _c(cost)
    ok = (p - c) >= 0
    if price_cur is not None and cost_cur is not None:
        ok = ok & same_currency(price_cur, cost_cur)
    return (F.when(p == 0, F.lit(0.0))
             .when(ok, (p - c).cast("double") / p.cast("double") * F.lit(100.0)))


def margin_error(price, cost, price_cur, cost_cur) -> Column:
    p, c = _c(price), _c(cost)
    return (F.when(p == 0, F.lit(None).cast("string"))
             .when(~same_currency(price_cur, cost_cur), F.lit("currency mismatch"))
             .when(p - c < 0, F.lit("negative amount")))


def money_format(amount, currency) -> Column:
    """'1,234.50 USD'."""
    return F.concat(F.format_number(_c(amount), 2), F.lit(" "), F.upper(_c(currency)))


# -- X4 / X5 address ------------------------------------------------------------------

def parse_address(text) -> Column:
    """Free text -> struct(street, street2, city, state, zip_code, country, error).

    Blank -> the default address. Four or more comma pieces -> street, city,
    state, zip (extras ignored). Otherwise the whole text is the street with the
    default city/state/zip. A required piece left blank or a bad US ZIP gives an
    error text and NULL fields.
    """
    t = _c(text)
    pieces = F.transform(F.split(t, ",", -1), lambda x: F.trim(x))
    four = F.size(pieces) >= 4
    blank = _blank(t)
    street = F.when(blank, F.lit("Unknown")).when(four, pieces[0]).otherwise(F.trim(t))
    city = F.when(blank | ~four, F.lit("Unknown")).otherwise(pieces[1])
    state = F.when(blank | ~four, F.lit("TX")).otherwise(F.upper(pieces[2]))
    zipc = F.when(blank | ~four, F.lit("00000")).otherwise(pieces[3])
    err = (F.when(_blank(street), F.lit("Street address is required"))
            .when(_blank(city), F.lit("City is required"))
            .when(_blank(state), F.lit("State is required"))
            .when(_blank(zipc), F.lit("ZIP code is required"))
            .when(~zipc.rlike(ZIP_PATTERN), F.lit("Invalid US ZIP code format")))
    ok = err.isNull()
    return F.struct(
        F.when(ok, street).alias("street"),
        F.lit(None).cast("string").alias("street2"),
        F.when(ok, city).alias("city"),
        F.when(ok, state).alias("state"),
        F.when(ok, zipc).alias("zip_code"),
        F.when(ok, F.lit("USA")).alias("country"),
        err.alias("error"),
    )


def format_address(addr, sep: str = ", ") -> Column:
    """Street, street2, 'City, ST zip', country (only when not USA); blanks skipped."""
    a = _c(addr)
    line3 = F.concat(F.coalesce(a.city, F.lit("")), F.lit(", "), F.coalesce(a.state, F.lit("")), F.lit(" "),
                     F.coalesce(a.zip_code, F.lit("")))
    country = F.when(a.country != "USA", a.country)
    parts = F.array(a.street, a.street2, line3, country)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (F.trim(x) != "")), sep)


# -- X6 VIN -----------------------------------------------------------------------------

def vin_clean(vin) -> Column:
    return F.upper(F.trim(_c(vin)))


def vin_valid(vin) -> Column:
    return F.coalesce(vin_clean(vin).rlike(VIN_PATTERN), F.lit(False))


def vin_short(vin) -> Column:
    v = vin_clean(vin)
    return F.when(F.length(v) >= 8, F.substring(v, -8, 8)).otherwise(v)


def equipment_model(model) -> Column:
    m = _c(model)
    return F.when(_blank(m), F.lit("Unknown")).otherwise(F.trim(m))


def equipment_display_name(vin, etype, model) -> Column:
    return F.concat(equipment_model(model), F.lit(" "), F.trim(_c(etype)), F.lit(" ("), vin_clean(vin), F.lit(")"))


# -- X7 / X8 periods ----------------------------------------------------------------------

def ntz_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (timestamp_ntz) value, independent of the
    session time zone (a cast to TIMESTAMP would shift by the zone and break across DST)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


def _micros(ts: Column) -> Column:
    return ntz_micros(ts)


def is_open_ended(end) -> Column:
    e = _c(end)
    return e.isNull() | (e >= F.lit(OPEN_END).cast("timestamp_ntz"))


def period_end_or(end, as_of: str) -> Column:
    """End of a period with an open end replaced by ``as_of`` (durations run to 'now')."""
    return F.when(is_open_ended(end), F.lit(as_of).cast("timestamp_ntz")).otherwise(_c(end))


def period_metrics(start, end, as_of: str) -> Column:
    """struct(duration_hours, duration_days, is_open_ended, is_past, is_future, is_current)."""
    s, e = _c(start), _c(end)
    now = F.lit(as_of).cast("timestamp_ntz")
    eff = period_end_or(e, as_of)
    micros = _micros(eff) - _micros(s)
    days = micros / F.lit(86400000000.0)
    open_ = is_open_ended(e)
    true_end = F.when(open_, F.lit(OPEN_END).cast("timestamp_ntz")).otherwise(e)
    return F.struct(
        (micros / F.lit(3600000000.0)).alias("duration_hours"),
        F.when(days >= 0, F.floor(days)).otherwise(F.ceil(days)).cast("int").alias("duration_days"),
        open_.alias("is_open_ended"),
        (true_end < now).alias("is_past"),
        (s > now).alias("is_future"),
        ((s <= now) & (true_end >= now)).alias("is_current"),
    )


def period_format(start, end) -> Column:
    """'yyyy-MM-dd HH:mm - yyyy-MM-dd HH:mm (h.h hours)' or '... - (ongoing)'."""
    s, e = _c(start), _c(end)
    hours = (_micros(e) - _micros(s)) / F.lit(3600000000.0)
    return F.when(is_open_ended(e), F.concat(F.date_format(s, "yyyy-MM-dd HH:mm"), F.lit(" - (ongoing)"))) \
            .otherwise(F.concat(F.date_format(s, "yyyy-MM-dd HH:mm"), F.lit(" - "),
                                F.date_format(e, "yyyy-MM-dd HH:mm"), F.lit(" ("),
                                F.format_string("%.1f", hours), F.lit(" hours)")))


# -- X10-X14 ------------------------------------------------------------------------------

def is_delayed(status, scheduled_end, as_of: str) -> Column:
    """Delay flag: a scheduled end before ``as_of`` and not Completed (Cancelled included)."""
    e = _c(scheduled_end)
    return F.coalesce(e.isNotNull() & (_c(status) != COMPLETED) & (F.lit(as_of).cast("timestamp_ntz") > e),
                      F.lit(False))


def status_description(status, scheduled_start, scheduled_end, as_of: str) -> Column:
    st, start = _c(status), _c(scheduled_start)
    return (F.when(st == PENDING, F.lit("Waiting for assignment"))
             .when((st == ASSIGNED) & start.isNotNull(),
                   F.concat(F.lit("Scheduled for "), F.date_format(start, "MM/dd/yyyy")))
             .when((st == IN_PROGRESS) & is_delayed(st, scheduled_end, as_of), F.lit("⚠️ DELAYED - In Progress"))
             .when(st == IN_PROGRESS, F.lit("Currently being worked on"))
             .when(st == COMPLETED, F.lit("✅ Completed"))
             .otherwise(F.lit("Unknown status")))


def full_name(first, last) -> Column:
    return F.concat(F.coalesce(_c(first), F.lit("")), F.lit(" "), F.coalesce(_c(last), F.lit("")))


def max_jobs_for_skill(skill) -> Column:
    s = _c(skill)
    return F.when(s == 1, 2).when(s == 2, 3).when(s == 3, 4).when(s == 4, 5).otherwise(2)


def wo_number_valid(number) -> Column:
    return F.coalesce(_c(number).rlike(WO_NUMBER_PATTERN), F.lit(False))


def ledger_note(ttype, qty, reason=None) -> Column:
    """Note text of a ledger row; quantities are shown unsigned, adjustments carry their reason."""
    t, n = _c(ttype), F.abs(_c(qty)).cast("string")
    adj = _c(reason) if reason is not None else F.lit(None).cast("string")
    return (F.when(t == "Reservation", F.concat(F.lit("Reserved "), n, F.lit(" parts for work order")))
             .when(t == "Release", F.concat(F.lit("Released "), n, F.lit(" parts reservation")))
             .when(t == "Issue", F.concat(F.lit("Issued "), n, F.lit(" parts to work order")))
             .when(t == "Receipt", F.concat(F.lit("Received "), n, F.lit(" parts")))
             .when(t == "Adjustment", adj))


def bin_move_note(old_bin, new_bin) -> Column:
    return F.concat(F.lit("Moved from "), _c(old_bin), F.lit(" to "), _c(new_bin))
