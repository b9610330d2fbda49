"""URL parsing and rewriting as column expressions.

`parse_url` is not used: it fails on inputs such as a space in the path and
returns no host for names holding an underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from urlvane import fixed_values as fv
from urlvane.functions.columns import settle

# A dotted quad without leading zeros, as the strict address parsers read it.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _ipv6_pattern() -> str:
    """Every legal IPv6 text form, built by where the `::` stands."""
    h = "[0-9A-Fa-f]{1,4}"
    forms = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{IPV4}", f"(?:{h}:){{1,7}}:"]
    forms += [f"(?:{h}:){{{n}}}(?::{h}){{1,{7 - n}}}" for n in range(1, 7)]
    forms += [f":(?::{h}){{1,7}}", "::"]
    forms += [f"(?:{h}:){{{n}}}:(?:{h}:){{0,{5 - n}}}{IPV4}" for n in range(1, 6)]
    forms += [f"::(?:{h}:){{0,5}}{IPV4}"]
    return "(?:" + "|".join(forms) + ")(?:%[^%]+)?"


IPV6 = _ipv6_pattern()

PARTS = ["web", "scheme", "netloc", "host", "port_text", "path", "query", "fragment", "username", "password"]

# One match cuts a URL text into scheme, netloc, path, query and fragment.
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# One match cuts a netloc into user info, bracketed host, port after it, plain host, port.
_NETLOC = r"(?s)^(?:(.*)@)?(?:[^\[]*\[([^\]]*)\]?:?(.*)|([^:]*):?(.*))$"
_CUT = "\x01"
_FOLD = fv.HOST_FOLDING_CHARACTERS
# http or https with a host that a strict splitter accepts: brackets only around an
# IPv6 or future address, no character that folds to a delimiter.
WEB = (
    rf"^(?i:https?)://(?:[^/?#\[\]{_FOLD}]*@)?"
    rf"(?:[^/?#\[\]:@{_FOLD}]+|\[(?:{IPV6}|v[0-9A-Fa-f]+\.[^/?#\]]+)\])"
    rf"(?::[^/?#\[\]@{_FOLD}]*)?(?:[/?#]|$)"
)


def _after(text: Column, head: Column, skip: int = 0) -> Column:
    return F.substring(text, F.length(head) + F.lit(skip + 1), F.length(text))


def _cleaned(url: Column) -> Column:
    """Without leading blanks and control characters, and without tabs and line ends."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def is_web_url(url: Column | str) -> Column:
    """One match on the text, cheap to push below a projection or to a scan."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(_cleaned(url).rlike(WEB), F.lit(False))


def with_url_parts(df: DataFrame, url: str = "url", prefix: str = "u_") -> DataFrame:
    """Add web, scheme, netloc, host, port text, path, query, fragment, user and password.

    Two matches do the cutting; the rest are cheap look-ups in the cut texts.
    """
    p = prefix
    cut = lambda text, pattern, groups: F.split(
        F.regexp_replace(text, pattern, _CUT.join(f"${i}" for i in range(1, groups + 1))), _CUT
    )
    df = df.withColumn(f"{p}clean", _cleaned(F.replace(F.col(url), F.lit(_CUT), F.lit(" "))))
    df = df.withColumn(f"{p}cut", cut(F.col(f"{p}clean"), _SPLIT, 5))
    piece = lambda i: F.get(f"{p}cut", F.lit(i))
    df = df.withColumns({
        f"{p}web": F.coalesce(F.col(f"{p}clean").rlike(WEB), F.lit(False)),
        f"{p}scheme": F.lower(piece(0)), f"{p}netloc": piece(1), f"{p}path": piece(2),
        f"{p}query": piece(3), f"{p}fragment": piece(4),
        f"{p}place": F.when(piece(1).rlike(r"[@:\[]"), cut(piece(1), _NETLOC, 5)).otherwise(
            F.array(F.lit(""), F.lit(""), F.lit(""), piece(1), F.lit(""))
        ),
    })
    place = lambda i: F.get(f"{p}place", F.lit(i))
    df = df.withColumns({
        f"{p}rawhost": F.concat(place(1), place(3)),
        f"{p}port_text": F.concat(place(2), place(4)),
        f"{p}username": F.substring_index(place(0), ":", 1),
        f"{p}password": F.regexp_extract(place(0), r"(?s)^[^:]*:(.*)$", 1),
    })
    host = F.col(f"{p}rawhost")
    lowered = F.when(F.contains(host, F.lit("%")), F.concat(F.lower(F.substring_index(host, "%", 1)), F.regexp_extract(host, "%.*", 0)))
    df = df.withColumn(f"{p}host", lowered.otherwise(F.lower(host)))
    return df.drop(*[p + name for name in ("clean", "cut", "place", "rawhost")])


def drop_url_parts(df: DataFrame, prefix: str = "u_") -> DataFrame:
    return df.drop(*[prefix + name for name in PARTS])


def is_web(prefix: str = "u_") -> Column:
    """http or https with a host, and splittable."""
    return F.col(prefix + "web")


def has_credentials(prefix: str = "u_") -> Column:
    return F.coalesce((F.col(prefix + "username") != "") | (F.col(prefix + "password") != ""), F.lit(False))


def is_ip_host(host: Column | str) -> Column:
    host = F.col(host) if isinstance(host, str) else host
    return host.rlike(rf"^(?:{IPV4}|{IPV6})$")


def is_search_host(host: Column | str) -> Column:
    host = F.col(host) if isinstance(host, str) else host
    names = "|".join(name.replace(".", r"\.") for name in fv.SEARCH_DOMAINS)
    return F.lower(host).rlike(rf"(^|\.)({names})$")


def url_key(url: Column | str) -> Column:
    return F.sha2(F.col(url) if isinstance(url, str) else url, 256)


def site_domain(netloc: Column | str) -> Column:
    """Host part without any `www.`, when the text starts with `www` and one more character."""
    netloc = F.col(netloc) if isinstance(netloc, str) else netloc
    return F.when(netloc.rlike(r"^www[^\n]"), F.replace(netloc, F.lit("www."), F.lit(""))).otherwise(netloc)


def char_entropy(text: Column | str) -> Column:
    """Shannon entropy (base 2) of the code points; 0.0 for the empty text.

    log2(n) - sum(k * log2(k)) / n over the counts k. Characters are sorted, so equal ones
    form runs; a run of one adds nothing, and only longer runs are extracted.
    """
    text = F.col(text) if isinstance(text, str) else text
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1+"), F.lit(0))
    size = lambda run: F.length(run).cast("double")
    weighed = F.aggregate(runs, F.lit(0.0), lambda acc, run: acc + size(run) * F.log2(size(run)))
    total = size(text)
    return F.when(total > 0, F.log2(total) - weighed / total).otherwise(F.lit(0.0))


def _restore(encoded: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), pairs, encoded)


def _form_escape_strict(text: Column) -> Column:
    """Form escaping that keeps `~` and escapes `*`."""
    return _restore(F.url_encode(text), [("*", "%2A"), ("%7E", "~")])


def _path_escape(text: Column) -> Column:
    kept = [("+", "%20"), ("%2F", "/"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","),
            ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"), ("*", "%2A"), ("%7E", "~")]
    return _restore(F.url_encode(text), kept)


def _lenient_decode(text: Column) -> Column:
    """Form decoding that leaves a stray percent sign as it is."""
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _secret(key: Column, on_search_host: Column) -> Column:
    lowered = F.lower(key)
    return lowered.isin(fv.SENSITIVE_PARAMETERS) | (lowered.isin(fv.SEARCH_PARAMETERS) & on_search_host)


def _pair(part: Column, decode) -> Column:
    name = F.substring_index(part, "=", 1)
    return F.struct(decode(name).alias("k"), decode(_after(part, name, 1)).alias("v"))


def canonical_query(query: Column, host: Column) -> Column:
    """Decode, drop broken parts, redact, sort by key (stable) and encode again."""
    search = is_search_host(host)
    parts = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.contains(x, F.lit(";")))
    decoded = F.filter(
        F.transform(parts, lambda x: _pair(x, F.try_url_decode)),
        lambda x: x["k"].isNotNull() & x["v"].isNotNull(),
    )
    keyed = F.transform(
        decoded,
        lambda x, i: F.struct(
            x["k"].alias("k"),
            F.when(_secret(x["k"], search), F.lit(-1)).otherwise(i).alias("i"),
            F.when(_secret(x["k"], search), F.lit(fv.REDACTED)).otherwise(x["v"]).alias("v"),
        ),
    )
    # A redacted key carries the same position everywhere, so its copies are equal
    # and collapse here; other repeats keep their own position.
    ordered = F.array_sort(F.array_distinct(keyed))
    return F.array_join(
        F.transform(ordered, lambda x: F.concat(_form_escape_strict(x["k"]), F.lit("="), _form_escape_strict(x["v"]))),
        "&",
    )


def browser_query(query: Column, host: Column) -> Column:
    """Redact in place: first copy of a secret key stays, later copies go.

    The text is kept untouched when nothing is secret and rewritten as a whole otherwise.
    """
    search = is_search_host(host)
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    pairs = F.transform(parts, lambda x: _pair(x, _lenient_decode))
    marked = F.transform(
        pairs,
        lambda x, i: F.struct(
            F.when(_secret(x["k"], search), F.lit(-1)).otherwise(i).alias("i"),
            x["k"].alias("k"),
            F.when(_secret(x["k"], search), F.lit(fv.REDACTED)).otherwise(x["v"]).alias("v"),
        ),
    )
    rewritten = F.array_join(
        F.transform(
            F.array_distinct(marked),
            lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"])),
        ),
        "&",
    )
    return F.when(F.exists(pairs, lambda x: _secret(x["k"], search)), rewritten).otherwise(query)


def _escape_unsafe(text: Column, unsafe: str, kept: str) -> Column:
    """Percent-encode only where an unsafe character occurs; existing escapes stay."""
    pairs = [("+", "%20")] + [("%%%02X" % ord(ch), ch) for ch in kept if ch not in "*%"] + [("%25", "%")]
    return F.when(text.rlike(unsafe), _restore(F.url_encode(text), pairs)).otherwise(text)


#: Characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def _dot_free(path: Column) -> Column:
    """Resolve `.` and `..` path segments."""
    is_dot = lambda x: F.lower(F.replace(F.lower(x), F.lit("%2e"), F.lit(".")))
    kept = F.aggregate(
        F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            is_dot(x) == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        ).when(is_dot(x) == ".", acc).otherwise(F.array_append(acc, x)),
    )
    last = is_dot(F.element_at(F.split(path, "/"), -1))
    resolved = F.concat(
        F.lit("/"), F.array_join(kept, "/"),
        F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""),
    )
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), resolved).otherwise(path)


# Single classes, not repeated groups: a repeated group recurses once per character
# in the regex engine and overflows its stack on a long URL.
_VALID_PATH = r"^[A-Za-z0-9\-._~!$&'()*+,;=:@/\[\]%]*$"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_BAD_HOST = r"""[\x00-\x7F&&[^A-Za-z0-9\-._~!$&'()*+,;=:\[\]<>"]]"""


def canonical_url(df: DataFrame, url: str = "url", out: str = "canonical_url",
                  host: str = "canonical_host", error: str = "url_error") -> DataFrame:
    """Privacy-normalized URL with a sorted query, its host, and the reason if refused."""
    p = "_c_"
    df = with_url_parts(df, url, p)
    raw, c = F.col(url), (lambda name: F.col(p + name))
    hostport = F.substring_index(c("netloc"), "@", -1)
    port_ok = hostport.rlike(r"^(?:\[[^\]]*\]|[^:\[\]]*)(?::[0-9]*)?$")
    host_ok = ~hostport.rlike(_BAD_HOST)
    user_ok = F.regexp_extract(c("netloc"), r"^(.*)@", 1).rlike(r"^[A-Za-z0-9\-._:~!$&'()*+,;=%@]*$")
    escapes_ok = ~F.concat(c("path"), F.lit("#"), c("fragment")).rlike(_BAD_ESCAPE)
    control = raw.rlike(r"[\x00-\x1F\x7F]") | raw.rlike(r"^ ")
    parsed = ~control & port_ok & host_ok & user_ok & escapes_ok & (c("host") != "")
    df = settle(df, {
        error: F.when(raw.isNull() | (F.octet_length(raw) == 0) | (F.octet_length(raw) > fv.MAX_URL_LENGTH), "invalid URL length")
        .when(~F.coalesce(parsed, F.lit(False)), "invalid URL")
        .when(~c("scheme").isin(fv.WEB_SCHEMES), "unsupported URL scheme"),
    })
    path = F.when(c("path").rlike(_VALID_PATH), c("path")).otherwise(
        _path_escape(F.try_url_decode(F.replace(c("path"), F.lit("+"), F.lit("%2B"))))
    )
    query = canonical_query(c("query"), c("host"))
    shown_host = F.when(
        hostport.rlike(r"[^\x00-\x7F]"),
        _escape_unsafe(hostport, r"[^\x00-\x7F]", "~!$&'()*+,;=:[]<>\""),
    ).otherwise(hostport)
    df = settle(df, {
        out: F.when(
            F.col(error).isNull(),
            F.concat(c("scheme"), F.lit("://"), shown_host, path,
                     F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))),
        ),
        host: F.when(F.col(error).isNull(), c("host")),
    })
    return drop_url_parts(df, p).drop("_b_text")


def browser_url(df: DataFrame, url: str = "url", out: str = "browser_url",
                host: str = "browser_host") -> DataFrame:
    """Browser-side normalization: order kept, NULL for anything not a web URL."""
    p = "_b_"
    df = df.withColumn("_b_text", F.regexp_replace(F.col(url), r"[\x00-\x20]+$", ""))
    df = with_url_parts(df, "_b_text", p)
    c = lambda name: F.col(p + name)
    port_number = F.expr(f"try_cast({p}port_text as int)")
    default_port = F.when(c("scheme") == "https", 443).otherwise(80)
    port = F.when((c("port_text") == "") | (port_number == default_port), "").otherwise(
        F.concat(F.lit(":"), port_number.cast("string"))
    )
    port_ok = (c("port_text") == "") | (c("port_text").rlike("^[0-9]+$") & port_number.between(0, 65535))
    host_text = F.when(F.contains(c("host"), F.lit(":")), F.concat(F.lit("["), c("host"), F.lit("]"))).otherwise(c("host"))
    host_ok = ~c("host").rlike(r"[\x00-\x20#/<>?@\\^|\[\]%\x7F]")
    usable = is_web(p) & port_ok & host_ok
    path = _dot_free(F.replace(c("path"), F.lit("\\"), F.lit("/")))
    path = _escape_unsafe(path, r"""[^\x21-\x7E]|["<>`{}^]""", "/:@!$&'()*+,;=~[]|\\%")
    query = _escape_unsafe(c("query"), r"""[^\x21-\x7E]|["<>']""", "/:@!$&()*+,;=~[]|\\%?`{}^")
    query = browser_query(query, c("host"))
    df = settle(df, {
        host: F.when(usable, c("host")),
        out: F.when(
            usable,
            F.concat(
                c("scheme"), F.lit("://"), host_text, port,
                F.when(path == "", "/").otherwise(path),
                F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
            ),
        ),
    })
    return drop_url_parts(df, p).drop("_b_text")
