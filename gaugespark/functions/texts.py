"""Column builders for replies and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def unfenced(c: Column) -> Column:
    """What a code fence around the whole text holds, else the text."""
    inner = F.regexp_extract(F.trim(c), r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(c))


def last_number_of(c: Column, key: str) -> Column:
    """The number of the last {"key": number} in a text, else null."""
    found = F.regexp_extract_all(c, F.lit('"' + key + r'"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)'), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def matched_label(c: Column, labels: Sequence[str]) -> Column:
    """The label that a text is: exactly, else without case and outer brackets, dots or quotes."""
    plain = F.lower(F.trim(F.regexp_replace(F.trim(c), r"^[\[\(\"']+|[\]\)\"'.]+$", "")))
    out = F.lit(None).cast("string")
    for label in labels:
        if sum(x.lower() == label.lower() for x in labels) == 1:
            out = F.when(plain == label.lower(), label).otherwise(out)
    for label in labels:
        out = F.when(c == label, label).otherwise(out)
    return out


def stated_probability(c: Column) -> tuple[Column, Column]:
    """(p, how): a bare number, a percentage, "p: x" or JSON {"p": x}; else null and 'none'.

    Only numbers from 0 to 1 (or 0 to 100 percent) count; booleans don't.
    """
    text = unfenced(c)
    number = r"([0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
    forms = [("json", r'^\{\s*"p"\s*:\s*' + number + r"\s*\}$", 1.0), ("bare", "^" + number + "$", 1.0), ("named", r"(?i)^p\s*[:=]\s*" + number + "$", 1.0), ("percent", "^" + number + r"\s*%$", 100.0)]
    p, how = F.lit(None).cast("double"), F.lit("none")
    for name, pattern, scale in reversed(forms):
        value = F.regexp_extract(text, pattern, 1).try_cast("double") / scale
        fits = F.coalesce(value.between(0, 1), F.lit(False))
        p, how = F.when(fits, value).otherwise(p), F.when(fits, F.lit(name)).otherwise(how)
    return p, how


def _given(value: Column, build) -> Column:
    """build(value) with the value worked out once: it is the one element of an array."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def probability_list(c: Column, labels: Sequence[str]) -> Column:
    """(p, status): the probabilities, in label order, of a JSON object of them.

    Labels left out count 0; the sum must be from 0.9 to 1.1, and is made 1.
    Only objects that are read and fit have p. The text is parsed once.
    """
    known = F.array(*[F.lit(x) for x in labels])

    def judged(x: Column) -> Column:
        total = F.aggregate(x["values"], F.lit(0.0), lambda a, v: a + v)
        status = F.when(x["size"] <= 0, "unreadable").when(x["unknown"] > 0, "unknown label").when(F.exists(x["values"], lambda v: (v < 0) | (v > 1)), "out of range").when(~total.between(0.9, 1.1), "sum").otherwise("ok")
        return _given(F.struct(total.alias("total"), status.alias("status")), lambda t: F.struct(F.when(t["status"] == "ok", F.transform(x["values"], lambda v: v / t["total"])).alias("p"), t["status"].alias("status")))

    def read(given: Column) -> Column:
        values = F.array(*[F.coalesce(F.try_element_at(given, F.lit(x)), F.lit(0.0)) for x in labels])
        return F.struct(values.alias("values"), F.coalesce(F.size(given), F.lit(-1)).alias("size"), F.size(F.array_except(F.map_keys(given), known)).alias("unknown"))

    return _given(_given(F.from_json(c, "map<string,double>"), read), judged)


def embedded_object(c: Column) -> Column:
    """The last flat JSON object in a text, else null."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"\{[^{}]*\}"), F.lit(0)), F.lit(-1))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def word_runs(ws: Column, k: int) -> Column:
    """All runs of k words, as texts; words are bound to a name, as a lambda works out what it takes from outside for each run."""
    runs = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(ws), runs), F.lit(0))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)


def first_pattern(c: Column, kinds: Sequence[tuple[str, str]], other: str) -> Column:
    """The name of the first pattern that a text holds."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for name, pattern in kinds:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise(other)


def request_key(c: Column, digits: int = 24) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, digits)


def clock(minutes: Column) -> Column:
    """+h h mm min of an offset in minutes."""
    size = F.abs(minutes)
    return F.format_string("%s%d h %02d min", F.when(minutes < 0, "-").otherwise("+"), F.floor(size / 60).cast("int"), (size % 60).cast("int"))


def occurrences(c: Column, part: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def first_difference(a: Column, b: Column) -> Column:
    """The place, from 1, of the first character in which two texts differ; null if none does."""
    places = F.sequence(F.lit(1), F.greatest(F.length(a), F.length(b), F.lit(1)))
    return F.get(F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))), F.lit(0))


def problems(*checks: tuple[Column, str]) -> Column:
    """The messages of the checks that fail (or can't be told), in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), message) for ok, message in checks]))


def parsed_timeline(c: Column) -> Column:
    """(minute, value) of each "+h:mm value" entry of a text."""
    entry = r"([+-]\d+):(\d\d) (\d+\.\d\d)"
    part = lambda k: F.regexp_extract_all(c, F.lit(entry), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("h"), part(2).alias("m"), part(3).alias("v"))
    return F.transform(zipped, lambda x: F.struct((x["h"].cast("int") * 60 + x["m"].cast("int")).alias("minute"), x["v"].cast("decimal(10,2)").alias("value")))
