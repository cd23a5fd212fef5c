"""Event time: what a stamp says, and nothing that it doesn't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Stamps that an event's header may start with.
_DAYS, _MONTHS = "Mon|Tue|Wed|Thu|Fri|Sat|Sun", "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
STAMPS = (
    r"\d{8}-\d{1,2}:\d{1,2}:\d{1,2}:\d{1,3}(?=\|)",
    rf"(?<=\[)(?:{_DAYS})\s+(?:{_MONTHS})\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+\d{{4}}(?=\])",
    r"(?<=\[)\d{1,2}\.\d{1,2}\s+\d{2}:\d{2}:\d{2}(?=\])",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:\s*(?:Z|[+-]\d{2}:?\d{2})(?![\w:+-]))?",
    r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:\s*(?:Z|[+-]\d{2}:?\d{2})(?![\w:+-]))?",
    r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?",
    r"\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}(?:\s+[+-]\d{4})?",
)
_LEVEL = r"(?:\[(?:INFO|ERROR|WARN|WARNING|DEBUG|TRACE|FATAL|CRITICAL)\]|INFO|ERROR|WARN|WARNING|DEBUG|TRACE|FATAL|CRITICAL)\s*[:|\-]?\s+"
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
#: Local clocks: (shape, format), fractions cut off before.
LOCAL = (
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}$", "MM/dd/yyyy HH:mm:ss"),
    (r"^\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}$", "d/MMM/yyyy:HH:mm:ss"),
    (r"^\d{8}-\d{1,2}:\d{1,2}:\d{1,2}$", "yyyyMMdd-H:m:s"),
    (r"^\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}$", "yyyy-MM-dd-HH.mm.ss"),
    (rf"^(?:{_MONTHS})\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+\d{{4}}$", "MMM d HH:mm:ss yyyy"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm"),
    (r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
)
#: What stands before a fraction, and what parts them: a dot or comma after the seconds, a colon or dot in the two forms with their own separators.
_FRACTION = r"^(.*:\d{2}(?=[.,])|\d{8}-\d{1,2}:\d{1,2}:\d{1,2}(?=:)|\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}(?=\.))[.,:](\d+)$"
_NO_SECONDS = r"^\d{4}-\d{2}-\d{2}[T\s]\s*\d{2}:\d{2}$"
LARGEST_SECONDS = 10_000_000_000


def header_stamp(log: Column) -> Column:
    """The stamp at the start of the first line, after a level or a bracket at most; null if there is none."""
    first = F.ltrim(F.substring_index(log, "\n", 1))
    found = F.regexp_extract(first, rf"^(?:{_LEVEL})?\[?({'|'.join(STAMPS)})", 1)
    return F.nullif(found, F.lit(""))


def first_stamp(log: Column) -> Column:
    """The first stamp of the first line, wherever it stands: tells where a header ends, and never when an event was. Families count in the order of STAMPS."""
    first = F.substring_index(log, "\n", 1)
    return F.coalesce(*[F.nullif(F.regexp_extract(first, p, 0), F.lit("")) for p in STAMPS])


def _parts(stamp: Column) -> Column:
    """struct(clock without fraction and offset, microseconds, offset or empty)."""

    def parted(text: Column) -> Column:
        micros = F.try_to_number(F.rpad(F.substring(F.regexp_extract(text, _FRACTION, 2), 1, 6), 6, "0"), F.lit("999999")).cast("bigint")
        return F.struct(F.regexp_replace(text, _FRACTION, "$1").alias("clock"), F.coalesce(micros, F.lit(0)).alias("micros"))

    def split(text: Column) -> Column:
        rest = let(F.regexp_replace(F.trim(F.regexp_replace(text, OFFSET, "")), rf"^(?:{_DAYS})\s+", ""), parted)
        return F.struct(rest.alias("rest"), F.regexp_extract(text, OFFSET, 1).alias("offset"))

    return let(let(F.trim(stamp), split), lambda x: F.struct(x["rest"]["clock"].alias("clock"), x["rest"]["micros"].alias("micros"), x["offset"].alias("offset")))


def _clock(text: Column) -> Column:
    out = F.lit(None).cast("timestamp_ntz")
    for shape, fmt in reversed(LOCAL):
        clean = F.regexp_replace(text, r"\s+", " ") if " " in fmt else text  # a format's blank stands for any
        out = F.when(text.rlike(shape), F.try_to_timestamp(clean, F.lit(fmt)).cast("timestamp_ntz")).otherwise(out)
    return out


def _micros(local: Column) -> Column:
    """Microseconds of a local clock as if it were UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), local)


def localise(micros: Column, zone: Column) -> Column:
    """UTC microseconds of a local clock in a zone; null where the clock occurs twice there, or never."""
    naive = F.timestamp_micros(micros)
    guess = F.to_utc_timestamp(naive, zone)

    def shows(at: Column) -> Column:
        return F.from_utc_timestamp(at, zone) == naive

    hour = F.expr("INTERVAL 1 HOUR")
    once = shows(guess) & ~shows(guess + hour) & ~shows(guess - hour)
    return F.when(once, F.unix_micros(guess))


def reading(stamp: Column, zone: Column | None = None) -> Column:
    """struct(explicit, zoned, naive): UTC microseconds of a stamp by itself, and also by its clock in ``zone``; and whether it is a clock without an offset.

    Epoch seconds or milliseconds and clocks with an offset are explicit. Needs the session time zone to be UTC. A clock without offset and zone is
    no instant; a date alone isn't either. Seconds may be left out only beside an offset. The names of weekdays aren't compared with their dates.
    """
    none = F.lit(None).cast("bigint")

    def read(text: Column) -> Column:
        number = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))
        epoch = F.when(number > LARGEST_SECONDS, number * 1000).otherwise(number * 1_000_000).cast("bigint")

        def instant(p: Column) -> Column:
            offset = p["offset"]

            def placed(local: Column) -> Column:
                sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
                digits = F.regexp_replace(offset, "[^0-9]", "")
                shift = F.when(offset == "Z", 0).otherwise(sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))
                naive = local.isNotNull() & (offset == "") & ~p["clock"].rlike(_NO_SECONDS)
                by_zone = F.when(naive, localise(local, zone)) if zone is not None else none
                explicit = F.coalesce(epoch, F.when(offset != "", local - shift.cast("bigint") * 60_000_000))
                return let(explicit, lambda e: F.struct(e.alias("explicit"), F.coalesce(e, by_zone).alias("zoned"), F.coalesce(naive, F.lit(False)).alias("naive")))

            return let(_micros(_clock(p["clock"])) + p["micros"], placed)

        return let(_parts(text), instant)

    return let(F.trim(stamp), read)


def normalise(stamp: Column, zone: Column | None = None) -> Column:
    """UTC microseconds of a stamp, as ``reading`` finds them; else null."""
    return reading(stamp, zone)["zoned"]


def resolve(message: Column, zone: Column, source: Column) -> tuple[Column, Column]:
    """(microseconds, basis): the message's own instant, then its clock in the source's zone, then the record's time, else untimed."""
    return resolved(reading(message, zone), normalise(source))


def resolved(own: Column, record: Column) -> tuple[Column, Column]:
    """``resolve`` from the message's ``reading`` and the record's instant."""
    basis = F.when(own["explicit"].isNotNull(), "message_explicit").when(own["zoned"].isNotNull(), "message_source_timezone").when(record.isNotNull(), "source_record").otherwise("untimed")
    return F.coalesce(own["zoned"], record), basis


def status(message: Column, zone: Column) -> Column:
    """Why a message gives no instant of its own; null if it does."""
    return status_of(message, zone, reading(message, zone))


def status_of(message: Column, zone: Column, own: Column) -> Column:
    """``status`` from the message's ``reading``."""
    text = F.trim(message)
    no_clock, no_date, no_year = text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.rlike(r"^\d{2}:\d{2}:\d{2}"), text.rlike(r"^([A-Z][a-z]{2}\s+\d{1,2}|\d{1,2}\.\d{1,2})\s+\d{2}:\d{2}:\d{2}$")
    return (
        F.when(own["zoned"].isNotNull(), None)
        .when(message.isNull() | (text == ""), "missing")
        .when(own["naive"] & zone.isNotNull(), "source_timezone_unresolved")
        .when(own["naive"], "timezone_missing")
        .when(no_year, "year_missing")
        .when(no_date | no_clock, "date_missing")
        .when(text.rlike(r"^\d{4}-"), "invalid")
        .otherwise("unparsed")
    )
