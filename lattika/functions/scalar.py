"""Scalar functions over columns, all built in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS, DECAY_ORIGIN_MS, DECAY = 86_400_000, 1_451_577_600_000, 0.99
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


# ---- dates


def day_start(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def day_end(ts: Column) -> Column:
    """The day's last millisecond."""
    return F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 0.001 SECOND")


def previous_day(ts: Column) -> Column:
    return F.date_trunc("day", ts) - F.expr("INTERVAL 1 DAY")


def month_number(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMM").cast("int")


def compact_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def compact_hour(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHH")


def from_compact(text: Column) -> Column:
    """A day from `yyyyMMdd`; null if it is none."""
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd")))


def minute_floor(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def clock12(ts: Column) -> Column:
    """`yyyy-MM-dd hh:mm:ss` with hours from 01 to 12, as clocks show them."""
    return F.date_format(ts, "yyyy-MM-dd hh:mm:ss")


def past_date(ts: Column, days: int) -> Column:
    """The day's start, so many days before."""
    return F.date_trunc("day", ts) - F.make_dt_interval(F.lit(days))


def nanos(millis: Column) -> Column:
    return millis.cast("long") * 1_000_000


def millis(nano: Column) -> Column:
    return F.floor(nano / 1_000_000).cast("long")


def left_time(done: Column, total: Column, spent: Column) -> Column:
    """The time still needed at the pace so far; null before anything is done."""
    return F.when(done > 0, spent * (total - done) / done)


# ---- texts


def normal_space(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[ \\t]+", " ")


def is_number(text: Column) -> Column:
    """Digits only; an empty text counts as one."""
    return text.rlike("^[0-9]*$")


def is_email(text: Column) -> Column:
    return text.rlike(r"^[\w.\-]+@([\w\-]+\.)+[\w\-]+$")


def loose_int(text: Column) -> Column:
    """`1,234` and `1.5k` as numbers; 0 for null, null for anything else."""
    t = F.lower(F.regexp_replace(text, ",", ""))
    return F.when(text.isNull(), 0).when(t.endswith("k"), F.expr("0") + F.floor(F.regexp_replace(t, "k$", "").try_cast("double") * 1000)).otherwise(t.try_cast("long")).cast("long")


def script_of(text: Column) -> Column:
    """`english` without Han signs, `chinese` with them and spaces only, else `mixed`; mixed for null or empty."""
    han = F.regexp_count(text, F.lit("[\\u4e00-\\uffff]"))
    return F.when(F.coalesce(text, F.lit("")) == "", "mixed").when(han == 0, "english").when(han + F.regexp_count(text, F.lit(" ")) == F.length(text), "chinese").otherwise("mixed")


def words(text: Column) -> Column:
    """The distinct words between spaces, in order of appearance."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda x: x != ""))


def search_tag(destination: Column, text: Column) -> Column:
    """`destination:x|language:en|word:a|word:b` in lower case with sorted words."""
    head = F.concat(F.when(destination.isNotNull(), F.concat(F.lit("destination:"), F.lower(destination))).otherwise(F.lit("")), F.lit("|language:en"))
    tail = F.transform(F.array_sort(words(F.lower(text))), lambda w: F.concat(F.lit("|word:"), w))
    return F.concat(head, F.coalesce(F.array_join(tail, ""), F.lit("")))


def url_host(url: Column) -> Column:
    return F.try_parse_url(F.lower(url), F.lit("HOST"))


def nth_index(text: Column, part: str, n: int) -> Column:
    """The place (from 0) of the n-th occurrence of `part`, -1 if there are fewer."""
    found = F.size(F.split(text, _quoted(part))) - 1
    return F.when(found >= n, F.length(F.substring_index(text, part, n))).otherwise(-1)


def _quoted(part: str) -> str:
    return "\\Q" + part + "\\E"


def data_url_type(url: Column) -> Column:
    kind = F.substring_index(url, "base64,", 1)
    return F.when(~F.contains(url, F.lit("base64,")), "").when(kind == "data:image/gif;", ".gif").when(kind == "data:image/png;", ".png").when(kind == "data:image/jpeg;", ".jpg").otherwise("")


def data_url_bytes(url: Column) -> Column:
    return F.unbase64(F.substring_index(url, "base64,", -1))


def base32(raw: Column) -> Column:
    """Base32 with padding, from the binary digits of a binary column."""
    bits = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.lpad(F.bin(F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long")), 8, "0")))
    bits = F.when(F.length(raw) == 0, F.lit("")).otherwise(bits)
    five = F.ceil(F.length(bits) / 5).cast("int")
    padded = F.rpad(bits, 5 * five, "0")
    digits = F.transform(F.sequence(F.lit(0), five - 1), lambda k: F.substring(F.lit(BASE32), F.conv(F.substring(padded, 5 * k + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.when(five == 0, F.lit("")).otherwise(F.rpad(F.concat_ws("", digits), 8 * F.ceil(five / 8).cast("int"), "="))


def unbase32(text: Column) -> Column:
    """The bytes of a Base32 text; padding is left out, and null stands for a text with other signs."""
    digits = F.rtrim(F.upper(text), F.lit("="))
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.lpad(F.bin(F.instr(F.lit(BASE32), F.substring(digits, i, F.lit(1))) - 1), 5, "0"))
    bits = F.concat_ws("", each)
    bytes_ = F.floor(n * 5 / 8).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), bytes_ - 1), lambda k: F.lpad(F.conv(F.substring(bits, 8 * k + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.when(bytes_ == 0, F.lit("").cast("binary")).when(digits.rlike("^[A-Z2-7]*$"), F.unhex(F.concat_ws("", pairs)))


def base64(raw: Column) -> Column:
    return F.base64(raw)


def hexed(raw: Column) -> Column:
    return F.hex(raw)


# ---- numbers and keys


def reversed_bits(x: Column, width: int = 64) -> Column:
    """The number whose binary digits are those of x backwards, unsigned, as text."""
    return F.conv(F.reverse(F.lpad(F.bin(x), width, "0")), 2, 10)


def discrete_id(x: Column) -> Column:
    """A sequence number spread over the positive longs: the bits of 2 x backwards."""
    return reversed_bits(x * 2).cast("long")


def order_of_discrete(x: Column) -> Column:
    return F.floor(F.conv(F.reverse(F.lpad(F.bin(x), 64, "0")), 2, 10).cast("decimal(20,0)") / 2).cast("long")


def rank_key(text: Column) -> Column:
    """A key that orders texts by length in bytes, then by bytes."""
    return F.struct(F.octet_length(text).alias("n"), text.alias("v"))


#: What counts as null for a type, and stands in for it.
ZEROS = {"string": "", "long": 0, "int": 0, "double": 0.0, "boolean": False}


def is_empty(value: Column, kind: str) -> Column:
    """Whether a value is null or its type's zero."""
    return F.coalesce(value == F.lit(ZEROS[kind]), F.lit(True))


def same_value(a: Column, b: Column) -> Column:
    """Whether two values are equal; nulls are equal to each other."""
    return a.eqNullSafe(b)


def as_kind(value: Column, kind: str) -> Column:
    """A value as another type; its zero where it can't be read."""
    return F.coalesce(value.try_cast(kind), F.lit(ZEROS[kind]))


def incremented(value: Column, by: float) -> Column:
    return value.try_cast("double") + F.lit(by)


def in_scope(value: Column, start: Column | None, stop: Column | None, zero) -> Column:
    """start <= value < stop with a null value as its type's zero."""
    v, out = F.coalesce(value, F.lit(zero)), F.lit(True)
    if start is not None:
        out = out & (v >= start)
    return out & (v < stop) if stop is not None else out


def segment_level(rows: Column) -> Column:
    """The compaction level of a row count, by integer comparison with each level's bound; null above the last."""
    from ..plans.spec import LEVEL_FACTOR, LEVEL_LAST, LEVEL_ROWS

    bounds = [LEVEL_ROWS * LEVEL_FACTOR ** (k + 1) for k in range(LEVEL_LAST + 1)]
    return reduce(lambda a, kb: F.when(rows.cast("decimal(38,0)") < F.lit(str(kb[1])).cast("decimal(38,0)"), kb[0]).otherwise(a), reversed(list(enumerate(bounds))), F.lit(None).cast("int"))


# ---- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def toward(a: Column, b: Column, rate: float) -> Column:
    """a moved toward b by a share."""
    return F.zip_with(a, b, lambda x, y: x + (y - x) * rate)


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two word -> weight maps; 0 where either is empty or they share nothing."""
    both = F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))
    n = norm(F.map_values(a)) * norm(F.map_values(b))
    return F.when((n == 0) | n.isNull() | (both == 0), 0.0).otherwise(both / F.nullif(n, F.lit(0.0)))


def map_sum(a: Column, b: Column) -> Column:
    """Two maps of numbers added key by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def map_sum2(a: Column, b: Column) -> Column:
    """Two maps of maps of numbers added key by key."""
    none = F.expr("map_from_entries(cast(array() as array<struct<key:string,value:double>>))")
    return F.map_zip_with(a, b, lambda _, x, y: map_sum(F.coalesce(x, none), F.coalesce(y, none)))


def decayed(value: Column, now_ms: Column, coef: float = DECAY) -> Column:
    """A weight at `now`: it falls by coef a day since the origin."""
    return value if coef == 1.0 else F.when(now_ms < DECAY_ORIGIN_MS, value).otherwise(value * F.pow(F.lit(coef), (now_ms - DECAY_ORIGIN_MS) / DAY_MS))


def undecayed(value: Column, now_ms: Column, coef: float = DECAY) -> Column:
    """A weight learnt now, in terms of the origin."""
    return value if coef == 1.0 else value / F.pow(F.lit(coef), (now_ms - DECAY_ORIGIN_MS) / DAY_MS)
