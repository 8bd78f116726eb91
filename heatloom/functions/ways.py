"""What the tags of a way say: levels, predicates, rises; and opening hours. Columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ways that people may walk on, and larger streets.
WALK = "footway path pedestrian steps corridor living_street residential service unclassified tertiary tertiary_link secondary secondary_link primary primary_link track road cycleway platform".split()
ARTERIAL = "primary primary_link secondary secondary_link".split()
STOREY_M, STEP_M = 4.0, 0.17
DAYS = "mo tu we th fr sa su".split()


def tag(tags: Column, name: str) -> Column:
    """A tag's value, an empty text where it has none: predicates are never null."""
    return F.coalesce(F.element_at(tags, name), F.lit(""))


def levels_of(text: Column) -> Column:
    """Whole levels in a text like "0;-1"; a minus begins a new one; [0] where there is none."""
    parts = F.split(F.replace(text, F.lit("-"), F.lit(";-")), ";")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("double").cast("int"))
    own = F.array_distinct(F.filter(numbers, lambda n: n.isNotNull()))
    return F.when(F.size(own) > 0, F.array_sort(own)).otherwise(F.array(F.lit(0)))


def storeys(tags: Column) -> Column:
    return levels_of(F.element_at(tags, "level"))


def levels(tags: Column) -> Column:
    """Levels for the question which ways may be joined: those of `level`, failing that those of `layer`. Heights use storeys."""
    return levels_of(F.coalesce(F.element_at(tags, "level"), F.element_at(tags, "layer")))


def walkable(tags: Column) -> Column:
    closed = lambda n: tag(tags, n).isin("no", "private")
    return tag(tags, "highway").isin(*WALK) & ~closed("foot") & ~closed("access")


def indoor(tags: Column) -> Column:
    return (tag(tags, "indoor") == "yes") | (tag(tags, "highway") == "corridor") | (tag(tags, "tunnel") == "building_passage")


def below_ground(tags: Column) -> Column:
    return F.array_min(storeys(tags)) < 0


def covered(tags: Column) -> Column:
    return tag(tags, "covered").isin("yes", "arcade") | (tag(tags, "man_made") == "bridge") | below_ground(tags)


def deck(tags: Column) -> Column:
    return (tag(tags, "bridge").isin("yes", "viaduct", "boardwalk") | (F.array_max(storeys(tags)) > 0)) & ~indoor(tags)


def conveying(tags: Column) -> Column:
    return F.element_at(tags, "conveying").isNotNull() & (tag(tags, "conveying") != "no")


def crossing(tags: Column) -> Column:
    return (tag(tags, "footway") == "crossing") | (tag(tags, "highway") == "crossing")


def arterial(tags: Column) -> Column:
    return tag(tags, "highway").isin(*ARTERIAL)


def step_rise(tags: Column) -> Column:
    """Metres that a stepped way climbs: by its steps, else its levels, else one storey; null elsewhere."""
    counted = F.abs(F.element_at(tags, "step_count").try_cast("double")) * STEP_M
    span = (F.array_max(storeys(tags)) - F.array_min(storeys(tags))) * STOREY_M
    return F.when(tag(tags, "highway") == "steps", F.coalesce(counted, F.when(span > 0, span), F.lit(STOREY_M)))


def default_hours(is_indoor: Column, is_covered: Column, level: Column) -> Column:
    """The class of a way that lies in no mapped area; null: never closed."""
    return F.when(is_indoor, "indoor").when(is_covered & (level < 0), "subway")


# --- opening hours ---

_DAY = "(?:mo|tu|we|th|fr|sa|su)"
_DAY_SPEC = rf"^{_DAY}(?:-{_DAY})?(?:,{_DAY}(?:-{_DAY})?)*$"
_SPAN_SPEC = r"^\d{1,2}:\d{2}\s*-\s*\d{1,2}:\d{2}(?:,\s*\d{1,2}:\d{2}\s*-\s*\d{1,2}:\d{2})*$"


def _number(day: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, DAYS)), day) - 1


def _has_day(spec: Column, dow: Column) -> Column:
    """Whether a list of days and ranges (they may wrap over Sunday) holds a weekday."""
    def one(part):
        a, b = _number(F.substring(part, 1, 2)), _number(F.substring(part, -2, 2))
        return F.pmod(dow - a, F.lit(7)) <= F.pmod(b - a, F.lit(7))

    return F.exists(F.split(spec, ","), one)


def _has_minute(spec: Column, minute: Column) -> Column:
    """Whether a list of spans holds a minute; a span that ends before it begins goes over midnight, on the same weekday."""
    def one(span):
        clock = lambda i: F.regexp_extract(span, r"(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})", i).cast("int")
        a, b = clock(1) * 60 + clock(2), clock(3) * 60 + clock(4)
        return F.when(b > a, (minute >= a) & (minute < b)).otherwise((minute >= a) | (minute < b))

    return F.exists(F.split(spec, ","), one)


def _empty_span(spec: Column) -> Column:
    return F.exists(F.split(spec, ","), lambda s: F.regexp_extract(s, r"(\d{1,2}:\d{2})\s*-", 1) == F.regexp_extract(s, r"-\s*(\d{1,2}:\d{2})", 1))


def open_at(text: Column, dow: Column, minute: Column) -> Column:
    """Whether a place is open on a weekday (Monday: 0) at a minute of the day: true, false, or null where the text is
    missing or says more than days, times, off and 24/7. Later rules win; a day that no rule names is closed."""
    whole = F.trim(F.lower(text))
    cleaned = F.transform(F.split(whole, ";"), lambda r: F.trim(F.regexp_replace(r, '"[^"]*"', " ")))
    rules = F.filter(cleaned, lambda r: r != "")

    def read(rule: Column) -> Column:
        off = rule.rlike(r"\b(off|closed)\b")
        rest = F.trim(F.regexp_replace(rule, r"\b(off|closed)\b", " "))
        head = F.regexp_extract(rest, r"^(\S*)", 1)
        named = rest.rlike(rf"^{_DAY}(?:[-,\s]|$)")
        days, times = F.when(named, head), F.trim(F.when(named, F.regexp_replace(rest, r"^\S*", "")).otherwise(rest))
        good_days = days.isNull() | days.rlike(_DAY_SPEC)
        good_times = (off & (times == "")) | (times.rlike(_SPAN_SPEC) & ~_empty_span(times))
        today = F.when(days.isNull(), True).otherwise(_has_day(F.when(good_days, days), dow))
        now = F.when(off & (times == ""), False).otherwise(_has_minute(F.when(good_times, times), minute))
        return F.struct((good_days & good_times).alias("good"), F.coalesce(today, F.lit(False)).alias("today"), F.coalesce(now, F.lit(False)).alias("now"))

    seen = F.transform(rules, read)
    ruled = F.filter(seen, lambda x: x["today"])
    last = F.coalesce(F.get(ruled, F.size(ruled) - 1)["now"], F.lit(False))
    always = whole.isin("24/7", "mo-su 00:00-24:00", "00:00-24:00")
    return F.when(always, True).when((F.size(rules) > 0) & F.forall(seen, lambda x: x["good"]), last)
