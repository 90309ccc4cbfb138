"""Column expressions that turn display text into values."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from .core import hit, let, pack
from .text import clock, human_bytes


def _num(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")).try_cast("double"), F.lit(0.0))


def duration(text: Column) -> Column:
    """Seconds of ``[d:]h:m:s[.ms]``, ISO 8601 or worded durations; years, months and weeks count nothing."""
    return let(F.regexp_replace(text, r"^\s+|\s+$", ""), _duration)


def _duration(s: Column) -> Column:
    # The accepted spellings of a duration.
    clock_re = r"^(?:(?:([0-9]+):)?([0-9]+):)?([0-9]+):([0-9]{1,2})(?:[.:]([0-9]+))?Z?$"
    secs_re = r"^([0-9]+)(?:[.:]([0-9]+))?Z?$"
    words_re = (r"(?i)^(?:P?(?:[0-9]+\s*y(?:ears?)?,?\s*)?(?:[0-9]+\s*m(?:onths?)?,?\s*)?(?:[0-9]+\s*w(?:eeks?)?,?\s*)?"
                r"(?:([0-9]+)\s*d(?:ays?)?,?\s*)?T)?(?:([0-9]+)\s*h(?:(?:ou)?rs?)?,?\s*)?"
                r"(?:([0-9]+)\s*m(?:in(?:ute)?s?)?,?\s*)?(?:([0-9]+)(?:\.([0-9]+))?\s*s(?:ec(?:ond)?s?)?\s*)?Z?$")
    long_re = r"(?i)^(?:([0-9.]+)\s*(?:hours?)|([0-9.]+)\s*(?:mins?\.?|minutes?)\s*)Z?$"

    def total(pattern, d, h, m, sec, ms):
        g = lambda i: F.regexp_extract(s, pattern, i) if i else F.lit("")
        frac = g(ms)
        return ((_num(g(d)) * 24 + _num(g(h))) * 60 + _num(g(m))) * 60 + _num(g(sec)) \
            + F.when(frac != "", _num(frac) / F.pow(F.lit(10.0), F.length(frac))).otherwise(F.lit(0.0))

    return (F.when(s == "", F.lit(None))
            .when(s.rlike(clock_re), total(clock_re, 1, 2, 3, 4, 5))
            .when(s.rlike(secs_re), total(secs_re, 0, 0, 0, 1, 2))
            .when(s.rlike(words_re), total(words_re, 1, 2, 3, 4, 5))
            .when(s.rlike(long_re), total(long_re, 0, 1, 2, 0, 0)))


def _unit_value(text: Column, units: dict) -> Column:
    """Number and unit at the start of the text, times the unit's factor, truncated."""
    names = "|".join(re.escape(u) for u in units)
    pattern = rf"^([0-9]+(?:[,.][0-9]*)?)\s*({names})\b"
    num = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    table = F.create_map(*[F.lit(x) for kv in units.items() for x in (kv[0], float(kv[1]))])
    return F.when(text.rlike(pattern),
                  (num * F.try_element_at(table, F.regexp_extract(text, pattern, 2))).try_cast("bigint"))


def _size_units() -> dict:
    """Unit table: ``XiB`` and ``xB`` are binary, ``XB``, ``Xb`` and ``xb`` decimal, plus the long names."""
    units = {"B": 1, "b": 1, "bytes": 1}
    names = ["kilo kibi", "mega mebi", "giga gibi", "tera tebi", "peta pebi", "exa exbi", "zetta zebi", "yotta yobi"]
    for i, (letter, pair) in enumerate(zip("KMGTPEZY", names), 1):
        decimal, binary = pair.split()
        low = letter.lower()
        units.update({f"{letter}iB": 1024 ** i, f"{letter}B": 1000 ** i, f"{low}B": 1024 ** i, f"{letter}b": 1000 ** i,
                      f"{low}b": 1000 ** i, f"{decimal}bytes": 1000 ** i, f"{binary}bytes": 1024 ** i})
    return units


def filesize(text: Column) -> Column:
    """Bytes of a size text; null beyond the range of a 64-bit count."""
    return _unit_value(text, _size_units())


def count(text: Column) -> Column:
    """Counts such as ``1.2k`` or ``1,234`` (separators dropped)."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    plain = F.regexp_replace(s, r"[,.+]", "").try_cast("bigint")
    units = {"k": 1e3, "K": 1e3, "m": 1e6, "M": 1e6, "kk": 1e6, "KK": 1e6}
    return F.when(s.rlike(r"^[\d,.]+$"), plain).otherwise(_unit_value(s, units))


def resolution(text: Column) -> Column:
    """struct(width, height) of ``WxH``, ``720p``/``720i`` or ``4k``/``8k``."""
    box = r"\b(\d+)\s*[xX×]\s*(\d+)\b"
    lines, kilo = r"\b(\d+)[pPiI]\b", r"\b([48])[kK]\b"
    w = hit(text, box, 1).try_cast("int")
    h = (F.when(text.rlike(box), hit(text, box, 2).try_cast("int"))
         .when(text.rlike(lines), hit(text, lines).try_cast("int"))
         .when(text.rlike(kilo), hit(text, kilo).try_cast("int") * 540))
    return pack(width=w, height=h)


def bitrate(text: Column) -> Column:
    return hit(text, r"\b(\d+)\s*kbps").try_cast("int")


# The date spellings that are understood, in order of trial.
DATE_FORMATS = [
    "%d %B %Y", "%d %b %Y", "%B %d %Y", "%B %dst %Y", "%B %dnd %Y", "%B %drd %Y", "%B %dth %Y", "%b %d %Y",
    "%b %dst %Y", "%b %dnd %Y", "%b %drd %Y", "%b %dth %Y", "%b %dst %Y %I:%M", "%b %dnd %Y %I:%M", "%b %drd %Y %I:%M",
    "%b %dth %Y %I:%M", "%Y %m %d", "%Y-%m-%d", "%Y.%m.%d.", "%Y/%m/%d", "%Y/%m/%d %H:%M", "%Y/%m/%d %H:%M:%S",
    "%Y%m%d%H%M", "%Y%m%d%H%M%S", "%Y%m%d", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%d %H:%M:%S:%f", "%d.%m.%Y %H:%M", "%d.%m.%Y %H.%M", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%fZ",
    "%Y-%m-%dT%H:%M:%S.%f0Z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M", "%b %d %Y at %H:%M",
    "%b %d %Y at %H:%M:%S", "%B %d %Y at %H:%M", "%B %d %Y at %H:%M:%S", "%H:%M %d-%b-%Y"]
DAY_FIRST = ["%d-%m-%Y", "%d.%m.%Y", "%d.%m.%y", "%d/%m/%Y", "%d/%m/%y", "%d/%m/%Y %H:%M:%S", "%d-%m-%Y %H:%M"]
MONTH_FIRST = ["%m-%d-%Y", "%m.%d.%Y", "%m/%d/%Y", "%m/%d/%y", "%m/%d/%Y %H:%M:%S"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december"]
_PIECES = {"d": r"(3[0-1]|[1-2]\d|0[1-9]|[1-9]| [1-9])", "m": r"(1[0-2]|0[1-9]|[1-9])", "Y": r"(\d\d\d\d)",
           "y": r"(\d\d)", "H": r"(2[0-3]|[0-1]\d|\d)", "I": r"(1[0-2]|0[1-9]|[1-9])", "M": r"([0-5]\d|\d)",
           "S": r"(6[0-1]|[0-5]\d|\d)", "f": r"([0-9]{1,6})", "B": "(" + "|".join(MONTHS) + ")",
           "b": "(" + "|".join(m[:3] for m in MONTHS) + ")"}


def _date_rule(fmt: str):
    """(pattern, replacement) that rewrites a spelling as ``y|m|d|H|M|S``."""
    slots, pattern = {}, ""
    for tok in re.findall(r"%.|\s+|.", fmt):
        if tok[0] == "%":
            slots[tok[1]] = f"${len(slots) + 1}"
            pattern += _PIECES[tok[1]]
        else:
            pattern += r"\s+" if tok.isspace() else re.escape(tok)
    year = slots.get("Y") or ("y" + slots["y"])
    month = slots.get("m") or slots.get("B") or slots.get("b")
    hour = ("i" + slots["I"]) if "I" in slots else slots.get("H", "0")
    return f"(?i)^{pattern}$", "|".join([year, month, slots["d"], hour, slots.get("M", "0"), slots.get("S", "0")])


def _shapes(fmt: str) -> set[str]:
    """What ``_shape`` makes of the texts that a spelling fits. A full month's name may have three letters (May), a day a blank before it."""
    out = {""}
    for tok in re.findall(r"%.|\s+|[a-zA-Z]+|.", fmt):
        kind = {"B": ("B", "b"), "b": ("b",), "d": ("0", " 0")}.get(tok[1], ("0",)) if tok[0] == "%" else (" ",) if tok.isspace() else (tok.lower(),)
        out = {x + k for x in out for k in kind}
    return {re.sub(r" ?0+", lambda m: re.sub("[^0]", "", m[0]), re.sub(r"(?<=0)0", "", x)) for x in out}


def _shape(text: Column) -> Column:
    """A text with its numbers as ``0``, its words by their length, and without blanks before numbers or a line's end."""
    s = F.regexp_replace(F.lower(text), r"(?:\r\n|[\n\r\u0085\u2028\u2029])\z", "")
    s = F.regexp_replace(s, r"\s*[0-9]+", "0")
    s = F.regexp_replace(s, r"(?<![a-z])[a-z]{3}(?![a-z])", "B3")
    s = F.regexp_replace(s, r"[a-z]{4,}", "B")
    return F.replace(F.regexp_replace(s, r"\s+", " "), F.lit("B3"), F.lit("b"))


def _moment(text: Column, formats) -> Column:
    """Timestamp of the first spelling in ``formats`` that fits. Only spellings of the text's shape, three at most, are tried."""
    by_shape: dict[str, list[str]] = {}
    for fmt in formats:
        for shape in sorted(_shapes(fmt)):
            by_shape.setdefault(shape, []).append(fmt)

    def first(fits):
        pick = None
        for fmt in fits:
            pattern, repl = _date_rule(fmt)
            cond, value = text.rlike(pattern), F.regexp_replace(text, pattern, repl)
            pick = F.when(cond, value) if pick is None else pick.when(cond, value)
        return pick

    def tried(shape):
        pick = None
        for known, fits in by_shape.items():
            pick = F.when(shape == known, first(fits)) if pick is None else pick.when(shape == known, first(fits))
        return pick
    return _from_parts(let(_shape(text), tried))


def _from_parts(parts: Column) -> Column:
    return let(F.split(F.lower(parts), r"\|"), _assemble)


def _assemble(split: Column) -> Column:
    p = F.transform(split, lambda x: F.trim(x))
    at = lambda i: F.try_element_at(p, F.lit(i))
    short = F.regexp_extract(at(1), r"^y(\d\d)$", 1)
    year = F.when(short != "", short.try_cast("int") + F.when(short.try_cast("int") >= 69, 1900).otherwise(2000)) \
        .otherwise(at(1).try_cast("int"))
    names = F.array(*[F.lit(m[:3]) for m in MONTHS])
    month = F.coalesce(at(2).try_cast("int"), F.array_position(names, F.substring(at(2), 1, 3)).cast("int"))
    twelve = F.regexp_extract(at(4), r"^i(\d+)$", 1)
    hour = F.when(twelve != "", twelve.try_cast("int") % 12).otherwise(at(4).try_cast("int"))
    sec = F.least(at(6).try_cast("int"), F.lit(59))
    return F.try_make_timestamp(year, month, at(3).try_cast("int"), hour, at(5).try_cast("int"), sec)


# Offsets in hours of zone names.
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5,
         "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
# Fixed value: an offset or Z at the end, unless it looks like part of a date.
_OFFSET = (r"^.{8,}?(Z|(?:(?<=.\b\d{4}|\b\d{2}:\d\d)|(?<!.\b[a-zA-Z]{3}|[a-zA-Z]{4}|..\b\d\d)) ?"
           r"([+-])([0-9]{2}):?([0-9]{2})$)")
_ZONE_NAME = r"\d{1,2}:\d{1,2}(?:\.\d+)?(\s*[A-Z]+)$"


def split_zone(text: Column):
    """(offset in seconds, text without the zone)."""
    tz = F.regexp_extract(text, _OFFSET, 1)
    # Z, or a sign and four digits.
    digits = F.replace(tz, F.lit(":"), F.lit(""))
    secs = F.when(tz == "Z", 0).otherwise(F.when(F.contains(tz, F.lit("-")), -1).otherwise(1) * (_num(F.substring(digits, -4, 2)) * 3600 + _num(F.right(digits, F.lit(2))) * 60))
    named = F.regexp_extract(text, _ZONE_NAME, 1)
    table = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    hours = F.when(named != "", F.try_element_at(table, F.trim(named)))
    cutoff = lambda part: F.substring(text, F.lit(1), F.length(text) - F.length(part))
    offset = F.when(tz != "", secs).otherwise(F.coalesce(hours * 3600, F.lit(0)).cast("double")).cast("bigint")
    rest = F.when(tz != "", cutoff(tz)).when(hours.isNotNull(), cutoff(named)).otherwise(text)
    return offset, rest


_MERIDIEM = r"(?i)\s*(?:AM|PM)(?:\s+[A-Z]+)?"
_MAIL = (r"(?i)^\s*(?:[a-z]+,?\s+)?(\d{1,2})[\s-]+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s-]+(\d{4})"
         r"\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?.*$")


_MAIL_MONTH = (r"(?i)^\s*(?:[a-z]+,?\s+)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(\d{1,2})\s+(\d{4})"
               r"\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?.*$")


def _mail_moment(text: Column) -> Column:
    """Mail header dates, day or month first, the last resort after the listed spellings."""
    parts = (F.when(text.rlike(_MAIL), F.regexp_replace(text, _MAIL, "$3|$2|$1|$4|$5|0$6"))
             .when(text.rlike(_MAIL_MONTH), F.regexp_replace(text, _MAIL_MONTH, "$3|$1|$2|$4|$5|0$6")))
    return _from_parts(parts)


def strdate(text: Column, day_first: bool = True) -> Column:
    """``YYYYMMDD`` of a date text; where several spellings fit, the last listed one wins."""
    formats = DATE_FORMATS + (DAY_FIRST if day_first else MONTH_FIRST)
    s = F.regexp_replace(F.replace(text, F.lit(","), F.lit(" ")), _MERIDIEM, "")
    found = let(let(s, lambda x: split_zone(x)[1]), lambda x: F.coalesce(_moment(x, formats[::-1]), _mail_moment(x)))
    return F.date_format(found, "yyyyMMdd")


def timestamp(text: Column, day_first: bool = True) -> Column:
    """Epoch seconds of a date text; the first spelling that fits wins, PM adds 12 hours even to 12."""
    s = F.regexp_replace(text, r"(?i)[,|]|(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?)(day)?", "")
    s = F.regexp_replace(s, r"\s+", " ")
    formats = DATE_FORMATS + (DAY_FIRST if day_first else MONTH_FIRST)

    def read(x):
        late = F.when(x.rlike("(?i)PM"), 12 * 3600).otherwise(0)
        offset, rest = split_zone(x)
        rest = F.regexp_replace(rest, _MERIDIEM, "")
        rest = F.regexp_replace(rest, r"(\d{1,2}:\d{1,2}(?:\.\d+)?)\s*[A-Z]+$", "$1")
        rest = F.regexp_replace(
            rest, r"^([0-9]{4,}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\.[0-9]{6})[0-9]+$", "$1")
        at = let(rest, lambda y: F.coalesce(_moment(y, formats), _mail_moment(y)))
        return F.unix_seconds(at) - offset + late
    return let(s, read)


def iso8601(text: Column) -> Column:
    """Epoch seconds of an ISO 8601 time; fractions are dropped."""
    def read(x):
        offset, rest = split_zone(x)
        return F.unix_seconds(_moment(rest, ["%Y-%m-%dT%H:%M:%S"])) - offset
    return let(F.regexp_replace(text, r"\.[0-9]+", ""), read)


# Codec names by kind.
VIDEO_CODECS = ["avc1", "avc2", "avc3", "avc4", "vp9", "vp8", "hev1", "hev2", "h263", "h264", "mp4v", "hvc1", "av1",
                "theora", "dvh1", "dvhe"]
AUDIO_CODECS = ["flac", "mp4a", "opus", "vorbis", "mp3", "aac", "ac-4", "ac-3", "ec-3", "eac3", "dtsc", "dtse", "dtsh",
                "dtsl"]


def codecs(text: Column) -> Column:
    """struct(vcodec, acodec, dynamic_range) of a codec list; two unknown names count as video and audio."""
    names = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    base = lambda x: F.regexp_replace(F.lower(F.substring_index(x, ".", 1)), r"0+(?=\d)", "")
    first = lambda ns, kinds: F.try_element_at(F.filter(ns, lambda x: base(x).isin(kinds)), F.lit(1))
    found = let(names, lambda ns: pack(names=ns, v=first(ns, VIDEO_CODECS), a=first(ns, AUDIO_CODECS)))
    return let(found, _codecs)


def _codecs(found: Column) -> Column:
    names, v, a = found["names"], found["v"], found["a"]
    rest = lambda x: F.regexp_extract(x, r"^[^.]*\.(.*)$", 1)
    head = lambda x: F.lower(F.substring_index(x, ".", 1))
    full = lambda x: F.concat(head(x), F.when(rest(x) != "", F.concat(F.lit("."), rest(x))).otherwise(F.lit("")))
    part = lambda n: F.ltrim(F.coalesce(F.try_element_at(F.split(rest(v), r"\."), F.lit(n)), F.lit("")), F.lit("0"))
    hdr = (F.when(head(v).isin("dvh1", "dvhe"), F.lit("DV"))
           .when(head(v).isin("av1", "av01") & (part(3) == "10"), F.lit("HDR10"))
           .when(head(v).isin("vp9", "vp09") & (part(1) == "2"), F.lit("HDR10")))
    known, two, none = v.isNotNull() | a.isNotNull(), F.size(names) == 2, F.lit("none")
    return pack(
        vcodec=F.when(known, F.coalesce(full(v), none)).when(two, F.try_element_at(names, F.lit(1))),
        acodec=F.when(known, F.coalesce(full(a), none)).when(two, F.try_element_at(names, F.lit(2))),
        dynamic_range=F.when(known, hdr))


# Media subtypes whose usual extension differs from the subtype.
MIME_EXTS = {"3gpp": "3gp", "smptett+xml": "tt", "ttaf+xml": "dfxp", "ttml+xml": "ttml", "x-flv": "flv",
             "x-mp4-fragmented": "mp4", "x-ms-sami": "sami", "x-ms-wmv": "wmv", "mpegurl": "m3u8", "x-mpegurl": "m3u8",
             "vnd.apple.mpegurl": "m3u8", "dash+xml": "mpd", "f4m+xml": "f4m", "hds+xml": "f4m",
             "vnd.ms-sstr+xml": "ism", "quicktime": "mov", "mp2t": "ts", "x-wav": "wav"}


def mime_ext(mime: Column) -> Column:
    """File extension of a MIME type."""
    sub = F.lower(F.trim(F.substring_index(F.substring_index(mime, "/", -1), ";", 1)))
    table = F.create_map(*[F.lit(x) for kv in MIME_EXTS.items() for x in kv])
    return (F.when(mime == "audio/mp4", F.lit("m4a")).when(mime == "audio/mpeg", F.lit("mp3"))
            .otherwise(F.coalesce(F.try_element_at(table, sub), sub)))


# Rating marks and their ages.
FILM_RATINGS = {"G": 0, "PG": 10, "PG-13": 13, "R": 16, "NC": 18}
TV_RATINGS = {"Y": 0, "Y7": 7, "G": 0, "PG": 0, "14": 14, "MA": 17}


def age_limit(text: Column) -> Column:
    """Years of a plain age (0–21), ``16+``, a film rating or a TV rating."""
    n = text.try_cast("int")
    film = F.create_map(*[F.lit(x) for kv in FILM_RATINGS.items() for x in kv])
    tv = F.create_map(*[F.lit(x) for kv in TV_RATINGS.items() for x in kv])
    tv_mark = F.regexp_extract(text, r"^TV[_-]?(Y|Y7|G|PG|14|MA)$", 1)
    return (F.when(n.isNotNull(), F.when(n.between(0, 21), n))
            .when(text.rlike(r"^\d{1,2}\+?$"), F.regexp_extract(text, r"^(\d{1,2})", 1).try_cast("int"))
            .otherwise(F.coalesce(F.try_element_at(film, text), F.try_element_at(tv, F.nullif(tv_mark, F.lit(""))))))


def jsonp(text: Column) -> Column:
    """The argument of a callback wrapper, or the text itself."""
    return F.regexp_replace(
        text, r"(?s)^(?:window\.)?([a-zA-Z0-9_.$]*)(?:\s*&&\s*\1)?\s*\(\s*(.*)\);?\s*?(?://[^\n]*)*$", "$2")


def int_or_null(text: Column, scale: int = 1, invscale: int = 1) -> Column:
    """Whole number times ``invscale``, floor-divided by ``scale``."""
    n = F.regexp_replace(text, r"^\s+|\s+$", "").try_cast("bigint")
    return F.floor((n * invscale).cast("decimal(38,0)") / scale).cast("bigint") if scale != 1 else n * invscale


def float_or_null(text: Column, scale: float = 1, invscale: float = 1) -> Column:
    return F.trim(text).try_cast("double") * invscale / scale


def text_or_null(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def bool_or_null(text: Column) -> Column:
    """Only the JSON words true and false count."""
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def rank_in(value: Column, order) -> Column:
    """0-based place in a quality list, -1 for unknown values."""
    return F.coalesce((F.array_position(F.array(*[F.lit(v) for v in order]), value) - 1).cast("int"), F.lit(-1))


KINDS = {"duration": duration, "filesize": filesize, "count": count, "resolution": resolution, "bitrate": bitrate,
         "strdate": strdate, "timestamp": timestamp, "iso8601": iso8601, "codecs": codecs, "mime_ext": mime_ext,
         "age_limit": age_limit, "jsonp": jsonp, "int": int_or_null, "float": float_or_null, "text": text_or_null,
         "bool": bool_or_null, "human_bytes": human_bytes, "clock": clock}


def usable(kind: str, value: Column) -> Column:
    """Whether a normalised value carries anything."""
    if kind == "resolution":
        return value["height"].isNotNull()
    if kind == "codecs":
        return value["vcodec"].isNotNull()
    return value.isNotNull()
