"""Column expressions on URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import hit, let, pack

# File extensions of media and manifests that are known without probing.
VIDEO_EXTS = ["avi", "flv", "mkv", "mov", "mp4", "webm", "3g2", "3gp", "f4v", "mk3d", "divx", "mpg", "ogv", "m4v", "wmv"]
AUDIO_EXTS = ["aiff", "alac", "flac", "m4a", "mka", "mp3", "ogg", "opus", "wav", "aac", "ape", "asf", "f4a", "f4b",
              "m4b", "m4p", "m4r", "oga", "ogx", "spx", "vorbis", "wma", "weba"]
MANIFEST_EXTS = ["f4f", "f4m", "m3u8", "smil", "mpd"]
# For texts of ASCII letters only; the case mapping of all languages takes several times as long.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KNOWN_EXTS = VIDEO_EXTS + AUDIO_EXTS + MANIFEST_EXTS


def sanitize(url: Column) -> Column:
    """Add a missing scheme and mend two common scheme typos."""
    return (F.when(url.startswith("//"), F.concat(F.lit("http:"), url))
            .when(url.startswith("httpss://"), F.regexp_replace(url, "^httpss://", "https://"))
            .otherwise(F.regexp_replace(url, "^rmtp([es]?)://", "rtmp$1://")))


def valid(url: Column) -> Column:
    """The trimmed URL if its scheme is one that can be fetched (or is left out), else null."""
    u = F.trim(url)
    return F.when(u.rlike(r"^(?:(?:https?|rt(?:m(?:pt?[es]?|fp)|sp[su]?)|mms|ftps?):)?//"), u)


def ext_of(url: Column, default: str | None = "unknown_video") -> Column:
    """File extension: the text after the last dot before any query."""
    guess = F.substring_index(F.substring_index(url, "?", 1), ".", -1)
    guess = F.when(F.substring_index(url, "?", 1).contains("."), guess).otherwise(F.lit(""))
    bare = F.regexp_replace(guess, "/+$", "")
    return (F.when(url.isNull() | ~url.contains("."), F.lit(default))
            .when(guess.rlike("^[A-Za-z0-9]+$"), guess)
            .when(bare.isin(KNOWN_EXTS), bare)
            .otherwise(F.lit(default)))


def scheme(url: Column) -> Column:
    """Lower-cased scheme, empty when there is none."""
    return F.translate(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), UPPER, LOWER)


def protocol_of(protocol: Column, url: Column) -> Column:
    """The given protocol, else one told by scheme or manifest extension."""
    ext = ext_of(url)
    return F.coalesce(protocol, F.when(url.startswith("rtmp"), F.lit("rtmp"))
                      .when(url.startswith("mms"), F.lit("mms"))
                      .when(url.startswith("rtsp"), F.lit("rtsp"))
                      .when(ext == "m3u8", F.lit("m3u8"))
                      .when(ext == "f4m", F.lit("f4m"))
                      .otherwise(scheme(url)))


def path_of(url: Column) -> Column:
    """Path of a URL: without scheme, host, query and fragment."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def basename(url: Column) -> Column:
    """Last non-empty path segment (slashes at the ends are ignored)."""
    return F.substring_index(F.regexp_replace(path_of(url), "^/+|/+$", ""), "/", -1)


def base_url(url: Column) -> Column:
    """Everything up to and with the last slash before a query, fragment or ampersand."""
    return hit(url, r"^(https?://[^?#&]+/)")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def tidy_path(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of a path that starts with a slash."""
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), let(F.split(F.regexp_replace(path, "^/", ""), "/"), _tidy)).otherwise(path)


def _tidy(parts: Column) -> Column:
    kept = F.aggregate(
        parts, F.expr("CAST(array() AS ARRAY<STRING>)"),
        lambda acc, p: F.when(p == ".", acc)
        .when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(p))))
    # A path that ends in a dot segment names a folder.
    folder = F.element_at(parts, -1).isin(".", "..")
    return let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(folder & (F.size(k) > 0), F.lit("/")).otherwise(F.lit(""))))


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of a link on a page; null without a usable base or link."""
    return let(pack(base=base, link=link), lambda p: F.coalesce(_beside(p), _resolve(p)))


def _beside(pair: Column) -> Column:
    """The usual case in two patterns: a plain path beside or below a page without query, and without dot segments; null for all others."""
    joined = lambda folder: let(F.concat(folder, pair["link"]), lambda u: F.when((folder != "") & ~u.contains("/."), u))
    return F.when(pair["link"].rlike(r"^[a-zA-Z0-9_][^:?#]*\z"), let(F.regexp_extract(pair["base"], r"^(https?://[^/?#\s]+/(?:[^?#\s]*/)?)[^/?#\s]*\z", 1), joined))


def _resolve(pair: Column) -> Column:
    base, link = pair["base"], pair["link"]
    return (F.when(link.isNull() | (link == ""), F.lit(None))
            .when(link.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+-.]*:)?//"), link)
            .when(~base.rlike(r"^(?:https?:)?//") | base.isNull(), F.lit(None))
            .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
            .otherwise(let(pack(
                origin=F.regexp_extract(base, r"^((?:https?:)?//[^/?#]*)", 1), path=path_of(base),
                query=F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1), to=F.regexp_extract(link, "^([^?#]*)", 1),
                tail=F.regexp_extract(link, r"^[^?#]*(.*)$", 1)), _rebase)))


def _rebase(p: Column) -> Column:
    folder = F.when(p["path"] == "", F.lit("/")).otherwise(F.regexp_extract(p["path"], "^(.*/)", 1))
    target = F.when(p["to"].startswith("/"), p["to"]).otherwise(F.concat(folder, p["to"]))
    # An empty path stays on the page; its query then holds unless the link brings one.
    tail = F.when(p["tail"].startswith("?"), p["tail"]).otherwise(F.concat(p["query"], p["tail"]))
    return (F.when(p["to"] == "", F.concat(p["origin"], p["path"], tail))
            .otherwise(F.concat(p["origin"], let(target, tidy_path), p["tail"])))


# Characters that stay as they are when a URL part is escaped.
_SAFE = r"A-Za-z0-9_.~%/;:@&=+$,!*'()?#\[\]\-"


def escape(text: Column) -> Column:
    """Percent-escape every character outside the safe set as UTF-8 bytes."""
    pieces = F.regexp_extract_all(text, F.lit(rf"([{_SAFE}]+|[^{_SAFE}]+)"), F.lit(1))
    done = F.transform(pieces, lambda p: F.when(p.rlike(rf"^[{_SAFE}]"), p)
                       .otherwise(F.regexp_replace(F.hex(F.encode(p, "UTF-8")), "(..)", "%$1")))
    return F.array_join(done, "")


TRACKERS = (r"(?:(?:chtbl\.com/track|media\.blubrry\.com|play\.podtrac\.com)/[^/]+"
            r"|(?:dts|www)\.podtrac\.com/(?:pts/)?redirect\.[0-9a-z]{3,4}"
            r"|flex\.acast\.com|pd(?:cn\.co|st\.fm)/e)/")


def strip_trackers(url: Column) -> Column:
    return F.regexp_replace(url, TRACKERS, "")
