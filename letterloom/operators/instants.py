"""One unambiguous sending instant from dates written in many ways.

A date is read by an ordered cascade of anchored patterns. Each pattern rewrites the text it
matches as a whole to the canonical form ``year|month|day|hour|minute|second|half|zone``; a text no
pattern matches, or whose fields make no calendar date, is unreadable. ``day/month`` order that the
text leaves open yields two readings. A reading with an offset, a known abbreviation or a named zone
is an instant; one without is in the default zone looked up for its source, and tells nothing where
the lookup has none.

Local times in a named zone follow an explicit policy: a time the clock showed twice yields two
readings; a time it never showed is read with the offset in force before the gap. Of several
readings the latest one not after the arrival (``received``) is meant; without an arrival to choose
by, the instant stays unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAMED_MONTHS = {  # English, German, French, Spanish, Portuguese; without dots, lower case
    1: "jan january januar janv janvier enero ene janeiro jänner",
    2: "feb february februar févr fév février febrero fevereiro fev",
    3: "mar march märz mrz mär mars marzo março",
    4: "apr april avr avril abril abr",
    5: "may mai mayo maio",
    6: "jun june juni juin junio junho",
    7: "jul july juli juil juillet julio julho",
    8: "aug august août aoû agosto ago",
    9: "sep sept september septembre septiembre setembro set",
    10: "oct october okt oktober octobre octubre outubro out",
    11: "nov november novembre noviembre novembro",
    12: "dec december dez dezember déc décembre diciembre dic dezembro",
}
MONTHS = {name: n for n, names in _NAMED_MONTHS.items() for name in names.split()}

#: Minutes east of UTC of the zone abbreviations that mail programs write.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "met": 60, "cest": 120, "mest": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "brt": -180, "art": -180,
    "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_ZONE = r"(?: ?([+-]\d{1,2}:?\d{2}|[A-Za-z]{1,5}|\([A-Za-z]+(?:/[A-Za-z_]+)+\)|\[[A-Za-z]+(?:/[A-Za-z_]+)+\]))?"
_COMMENT = r"(?: \([^()]*\))?"
_DAY_NAME = r"(?:\p{L}+\.?,? )?"

#: Ordered (pattern, canonical form); the first pattern that matches the whole text decides.
CASCADE: list[tuple[str, str]] = [
    (rf"^{_DAY_NAME}(\d{{1,2}})\.? (?:de )?(\p{{L}}+)\.? (?:de )?(\d{{4}}|\d{{2}})(?: at|,)? {_TIME}{_ZONE}{_COMMENT}$", "$3|$2|$1|$4|$5|$6||$7"),
    (rf"^{_DAY_NAME}(\p{{L}}+) (\d{{1,2}}) {_TIME} (\d{{4}})$", "$6|$1|$2|$3|$4|$5||"),
    (rf"^{_DAY_NAME}(\p{{L}}+) (\d{{1,2}}) {_TIME} ([A-Za-z]{{1,5}}|[+-]\d{{4}}) (\d{{4}})$", "$7|$1|$2|$3|$4|$5||$6"),
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_TIME}{_ZONE}{_COMMENT}$", "$1|$2|$3|$4|$5|$6||$7"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})([Zz]|[+-]\d{4})?$", "$1|$2|$3|$4|$5|$6||$7"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_TIME}{_ZONE}{_COMMENT}$", "$3|$2|$1|$4|$5|$6||$7"),
]
#: Year-last dates with slashes; with a half of the day they are month first, else either order may be meant.
_SLASHED = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_TIME}(?: ?([AaPp])\.?[Mm]\.?)?{_ZONE}{_COMMENT}$"
_EPOCH = r"^\d{10}(?:\d{3}|\d{6}|\d{9})?$"


def _local(at: Column) -> Column:
    """struct(local: seconds as if UTC, zone) of the parts of a canonical date; null where it is none."""
    months = F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in MONTHS.items()) + ")")
    year, hour, half = at[0].cast("int"), at[3].cast("int"), F.lower(at[6])
    year = F.when(F.length(at[0]) == 2, year + F.when(year < 70, 2000).otherwise(1900)).otherwise(year)
    month = F.coalesce(F.try_element_at(months, F.lower(at[1])), at[1].try_cast("int"))
    hour = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.when(at[5] == "", 0).otherwise(at[5].cast("int"))
    ts = F.try_make_timestamp(year, month, at[2].cast("int"), hour, at[4].cast("int"), F.least(second, F.lit(59)).cast("decimal(8,6)"), F.lit("UTC"))
    local = F.when(second <= 60, F.unix_seconds(ts) + F.greatest(second - 59, F.lit(0)))
    return F.struct(local.alias("local"), F.regexp_replace(at[7], r"[\[\]()]", "").alias("zone"))


def _offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC of an offset or abbreviation; null for anything else."""
    digits = F.regexp_replace(zone, "[+:-]", "").try_cast("int")
    minutes = F.when(
        zone.rlike(r"^[+-]\d{1,2}:?\d{2}$"),
        F.when(zone.startswith("-"), -1).otherwise(1) * (F.floor(digits / 100) * 60 + digits % 100),
    ).otherwise(F.try_element_at(F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in ABBREVIATIONS.items()) + ")"), F.lower(zone)))
    return (minutes * 60).cast("bigint")


def _shift(at: Column, zone: Column) -> Column:
    """Seconds that ``zone`` is east of UTC at the instant ``at``."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(at), zone)) - at


def date_readings(df: DataFrame, text: str, default_zone: str | None, out: str) -> DataFrame:
    """Adds ``out``: all instants (epoch seconds, fractions cut off, ascending) that the date ``text`` can mean.

    ``null``, empty and unreadable texts give an empty array, as do dates without any zone whose
    ``default_zone`` (a column, or None for no default at all) is null. Each step is a column of its
    own and each date is bound once per step, so that the expression stays small.
    """
    empty = F.array().cast("array<bigint>")
    s = F.col("__s")
    plain = F.lit(None).cast("string")
    for pattern, form in reversed(CASCADE):
        plain = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, form)).otherwise(plain)
    slashed = s.rlike(_SLASHED)
    month_first = F.when(slashed, F.regexp_replace(s, _SLASHED, "$3|$1|$2|$4|$5|$6|$7|$8"))
    day_first = F.when(slashed & (F.regexp_extract(s, _SLASHED, 7) == ""), F.regexp_replace(s, _SLASHED, "$3|$2|$1|$4|$5|$6||$8"))
    default = F.lit(None).cast("string") if default_zone is None else F.col(default_zone)

    def placed(one: Column) -> Column:
        named = F.when(one["zone"] == "", default).when(one["zone"].contains("/"), one["zone"])
        return F.struct(one["local"].alias("local"), _offset_seconds(one["zone"]).alias("offset"), named.alias("named"))

    def around(one: Column) -> Column:
        before, after = (F.when(one["offset"].isNull(), _shift(one["local"] + d, one["named"])) for d in (-86400, 86400))
        return F.struct(one["local"].alias("local"), one["offset"].alias("offset"), before.alias("before"), after.alias("after"), one["named"].alias("named"))

    def meant(one: Column) -> Column:
        both = F.array_distinct(F.array(one["local"] - one["before"], one["local"] - one["after"]))
        shown = F.filter(both, lambda t: t + _shift(t, one["named"]) == one["local"])
        zoned = F.when(F.size(shown) > 0, shown).otherwise(F.array(one["local"] - one["before"]))
        return F.when(one["offset"].isNotNull(), F.array(one["local"] - one["offset"])).when(one["before"].isNotNull(), zoned).otherwise(empty)

    def canonical() -> Column:
        return F.filter(F.array(plain, month_first, day_first), lambda c: c.isNotNull())

    df = df.withColumn("__s", F.trim(F.regexp_replace(text, r"\s+", " "))).withColumn("__c", canonical())
    df = df.withColumn("__c", F.transform("__c", lambda c: _local(F.split(c, r"\|"))))
    df = df.withColumn("__c", F.transform(F.filter("__c", lambda c: c["local"].isNotNull()), placed))
    df = df.withColumn("__c", F.flatten(F.transform(F.transform("__c", around), meant)))
    epoch = F.when(s.rlike(_EPOCH), F.array(F.substring(s, 1, 10).cast("bigint"))).otherwise(empty)
    return df.withColumn(out, F.coalesce(F.array_sort(F.array_distinct(F.concat("__c", epoch))), empty)).drop("__s", "__c")


def choose_reading(readings: Column, received: Column) -> Column:
    """The reading that is meant: the only one, else the latest not after ``received``, else null."""
    earlier = F.filter(readings, lambda t: t <= received)
    return F.when(F.size(readings) == 1, F.get(readings, 0)).when(received.isNotNull() & (F.size(earlier) > 0), F.array_max(earlier))


def header(headers_json: Column, name: str) -> Column:
    """Value of a header in a JSON object, its name compared without case; null if absent or no JSON."""
    entries = F.map_entries(F.from_json(headers_json, "map<string,string>"))
    return F.get(F.filter(entries, lambda e: F.lower(e["key"]) == name.lower()), 0)["value"]


def sending_instants(messages: DataFrame, zones: DataFrame) -> DataFrame:
    """``messages`` with ``sent_ts`` (epoch seconds, null = unknown) and ``readings`` (all meanings of Date).

    ``zones`` (domain, zone) is looked up with the domain of ``from_email``, without case; a domain
    listed twice counts with its first zone in order. Spark broadcasts it only while it is below the
    session's threshold. Null or broken headers, a missing or unreadable Date, and a Date without
    zone whose sender has none give null. Rows are neither dropped nor repeated; columns named like
    the added ones are replaced.
    """
    lookup = zones.where(F.col("domain").isNotNull()).groupBy(F.lower("domain").alias("__domain")).agg(F.min("zone").alias("__zone"))
    df = (
        messages.drop("sent_ts", "readings")
        .withColumn("__domain", F.lower(F.regexp_extract("from_email", r"@([^@>\s]+)>?\s*$", 1)))
        .withColumn("__date", header(F.col("headers_json"), "date"))
        .withColumn("__received", F.element_at(F.split(header(F.col("headers_json"), "received"), ";"), -1))
        .join(lookup, "__domain", "left")
    )
    df = date_readings(date_readings(df, "__date", "__zone", "readings"), "__received", None, "__arrivals")
    arrival = F.get("__arrivals", 0)
    return df.withColumn("sent_ts", choose_reading(F.col("readings"), arrival)).drop("__domain", "__zone", "__date", "__received", "__arrivals")


def wrong_instants(messages: DataFrame, zones: DataFrame) -> DataFrame:
    """Ids of messages whose ``date_ts`` is not the instant their headers tell."""
    known = sending_instants(messages, zones).where("sent_ts IS NOT NULL")
    return known.where(~F.col("date_ts").eqNullSafe(F.col("sent_ts"))).select("id").distinct()
