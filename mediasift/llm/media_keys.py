"""Names of media in one spelling: what an address or an evidence id leads to, whatever way it is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing value.
PLACEHOLDERS = ["-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "tbd", "undefined", "unknown"]
# Parameters of an address that only track, share, sign or keep a session.
PASSING = (
    r"utm_\w*|ref|referrer|referer|source_ref|fbclid|gclid|dclid|msclkid|yclid|igshid|mc_cid|mc_eid|_ga|share|share_id|shareid|si|feature|"
    r"token|expires|expiry|exp|sig|sign|signature|hash_sig|policy|key-pair-id|x-amz-[\w-]+|auth|hdnts|"
    r"sid|session|session_id|sessionid|phpsessid|jsessionid|aspsessionid\w*"
)
# First labels of a host that name a serving node of the site.
NODES = r"www\d*|m|mobile|amp|(?:cdn|edge|node|static|media|video|img|srv|s|stream|mirror|cache|lb|origin)(?:-?\d+)?"
# File name endings that only say the rendition's height, with or without frames a second.
RENDITION = r"[_.-]\d{3,4}[pP](?:\d{2,3})?(?=\.[A-Za-z0-9]+$|$)"

SPACE = r"[\s\x{00a0}\x{200b}\x{feff}\x{0085}]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def _decoded(c: Column) -> Column:
    """Percent escapes undone, but for those of characters that would then separate parts or can't stand in an address;
    these are kept as escapes in upper case. An escape that isn't one stays as it is."""
    kept = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    kept = F.regexp_replace(kept, r"(?i)%(2F|3F|23|26|3D|25|2B|3B|0[0-9A-F]|1[0-9A-F]|7F)", "%25$1")
    kept = F.regexp_replace(kept, r"\+", "%2B")
    return F.coalesce(F.try_url_decode(kept), c)


def _escapes_upper(c: Column) -> Column:
    # only the kept escapes are left; their letters are few
    for low, high in (("a", "A"), ("b", "B"), ("c", "C"), ("d", "D"), ("e", "E"), ("f", "F")):
        c = F.regexp_replace(c, rf"%([0-9A-Fa-f]?){low}", f"%$1{high}")
    return c


def url_key(c: Column) -> Column:
    """The file and site that an http(s) address leads to, or null if it leads nowhere.

    Of no matter are: surrounding white space, scheme, user, port 80 or 443, letter case and closing dot of the host, the
    serving node, escapes that needn't be, doubled slashes, dot segments and a closing slash of the path, the rendition
    in a file name, the order of parameters, parameters that pass, empty ones, and the fragment. Letter case in path and
    values, codes, part numbers and all other parameters count.
    """
    t = trimmed(c)
    part = lambda k: F.regexp_extract(t, r"^(?i:https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    host = F.regexp_replace(F.lower(part(1)), r"^.*@", "")
    host = F.regexp_replace(host, r"(?::(?:80|443)?)$", "")
    host = F.regexp_replace(host, r"\.+$", "")
    host = F.regexp_replace(host, r"\.+(:\d+)$", "$1")
    host = F.regexp_replace(host, rf"^(?:(?:{NODES})\.)+(?=[^.]+\.[^.]+)", "")
    path = F.regexp_replace(_escapes_upper(_decoded(part(2))), r"/+", "/")
    path = F.regexp_replace(path, r"(?:/\.)+(?=/|$)", "")
    for _ in range(3):  # a/../ of some depth
        path = F.regexp_replace(path, r"/(?!\.\./)[^/]+/\.\.(?=/|$)", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), RENDITION, "")
    pairs = F.filter(F.split(F.regexp_replace(part(3), "&amp;", "&"), "&"), lambda p: (p != "") & ~p.rlike(rf"^(?i:{PASSING})(?:=|$)"))
    query = F.array_join(F.array_sort(F.transform(pairs, lambda p: _escapes_upper(_decoded(F.regexp_replace(p, r"\+", "%20"))))), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def evidence_key(c: Column) -> Column:
    """An evidence id without case, separators, brackets and name-space prefixes; null if it names nothing."""
    t = F.lower(trimmed(c))
    bare = F.regexp_replace(F.regexp_replace(t, r"^.*[:/](?=[^:/]*[a-z0-9])", ""), r"[^a-z0-9]", "")
    return F.when((bare != "") & ~t.isin(PLACEHOLDERS), bare)
