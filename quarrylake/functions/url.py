"""URL expressions. All are built from Spark SQL functions; a null URL gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRACKING_PARAMS = ["fbclid", "gclid", "gclsrc", "dclid", "msclkid", "yclid", "igshid", "mc_cid", "mc_eid", "ref_src", "ref", "spm", "_ga", "_hsenc", "_hsmi"]
TEST_LABELS = ["uat", "staging", "stage", "dev", "test", "qa", "sandbox"]
AUTHORITY = {".gov": 0.9, ".gov.in": 0.9, ".nic.in": 0.9, ".edu": 0.85, ".ac.in": 0.85, ".org": 0.6}
DEFAULT_AUTHORITY = 0.5
PRIVATE_SUFFIXES = [".home.arpa", ".internal", ".lan", ".local", ".localdomain", ".localhost"]
PRIVATE_HOSTS = ["home.arpa", "instance-data", "internal", "ip6-localhost", "ip6-loopback", "lan", "local", "localdomain", "localhost", "metadata", "metadata.google.internal"]

SPLIT = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
VERSION_SEGMENT = r"(?i)^(v(er(sion)?)?[-_.]?)?[0-9]+([._][0-9]+){0,3}$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SPLIT, 1))


def authority_part(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 4)


def host(url: Column) -> Column:
    """The lower-cased host without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(F.regexp_replace(authority_part(url), "^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(authority_part(url), r":([0-9]+)$", 1)


def domain(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def registrable(url: Column) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(domain(url), r"([^.]*\.)?[^.]*$", 0)


def is_tracking(name: Column) -> Column:
    low = F.lower(name)
    return low.startswith("utm_") | low.isin(TRACKING_PARAMS)


def decode(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def encode(part: Column) -> Column:
    """Percent encoding that leaves letters, digits and _.-~ as they are and writes a space as +."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _param(url: Column, name: str) -> Column:
    return decode(F.regexp_extract(query(url), rf"(?:^|&){name}=([^&]*)", 1))


def unwrap(url: Column) -> Column:
    """The target behind a translation or reader wrapper, else the URL itself."""
    h = host(url)
    translated = h.endswith("translate.google.com") | (h == "translate.google.co.in")
    found = F.coalesce(*[F.when(_param(url, k).rlike("^https?://"), _param(url, k)) for k in ("u", "url", "q")])
    inner = F.regexp_extract(url, r"^\s*[A-Za-z]+://r\.jina\.ai/+(https?://.*)$", 1)
    return F.when(translated, F.coalesce(found, url)).when((h == "r.jina.ai") & (inner != ""), inner).otherwise(url)


def canonical(url: Column) -> Column:
    """The key under which two URLs are one page: https, no www., default port, fragment, tracking parameters or closing
    slash; parameters in order. Null for what isn't http or https."""
    u = F.trim(unwrap(url))
    pairs = F.transform(
        F.filter(F.split(query(u), "&"), lambda p: p != ""),
        lambda p: F.struct(decode(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(p, r"^[^=]*=?(.*)$", 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~is_tracking(p["k"])))
    text = F.array_join(F.transform(kept, lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    bare = F.when(path(u) == "", "/").otherwise(F.when(path(u).rlike("^/+$"), F.when(F.length(path(u)) == 1, "/").otherwise("")).otherwise(F.regexp_replace(path(u), "/+$", "")))
    place = F.when(port(u).isin("", "80", "443"), domain(u)).otherwise(F.concat(domain(u), F.lit(":"), port(u)))
    made = F.concat(F.lit("https://"), place, bare, F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)))
    return F.when(scheme(u).isin("http", "https") & (host(u) != ""), made)


def is_ipv4(h: Column) -> Column:
    return h.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")


def is_test_host(url: Column) -> Column:
    h = host(url)
    return (h == "localhost") | h.endswith(".local") | F.regexp_extract(h, "^[^.]*", 0).isin(TEST_LABELS) | is_ipv4(h)


def ipv4_number(h: Column) -> Column:
    parts = F.split(h, r"\.")
    return sum((parts[i].cast("long") * F.lit(256 ** (3 - i)) for i in range(1, 4)), parts[0].cast("long") * F.lit(256**3))


#: IPv4 networks that aren't public, as (network, prefix length).
NOT_PUBLIC = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]


def network_range(network: str) -> tuple[int, int]:
    address, bits = network.split("/")
    first = sum(int(x) << 8 * (3 - i) for i, x in enumerate(address.split(".")))
    return first, first + (1 << 32 - int(bits)) - 1


def is_blocked_ipv4(h: Column) -> Column:
    """Whether a dotted IPv4 address lies in a network that isn't public; false for other hosts."""
    n = F.when(is_ipv4(h), ipv4_number(h))
    inside = [n.between(*network_range(x)) for x in NOT_PUBLIC]
    found = inside[0]
    for x in inside[1:]:
        found = found | x
    return F.coalesce(found, F.lit(False))


#: IPv6 networks that aren't public.
NOT_PUBLIC_V6 = ["::/128", "::1/128", "::ffff:0:0/96", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8"]


def ipv6_hex(h: Column) -> Column:
    """The 32 hex digits of an IPv6 address, with or without brackets; null if it is none. The last 32 bits may be dotted."""
    bare = F.lower(F.regexp_replace(h, r"^\[|\]$|%.*$", ""))
    dotted = F.regexp_extract(bare, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    number = F.lpad(F.lower(F.hex(ipv4_number(dotted))), 8, "0")
    plain = F.when(is_ipv4(dotted), F.concat(F.regexp_extract(bare, r"^(.*:)[0-9.]+$", 1), F.substring(number, 1, 4), F.lit(":"), F.substring(number, 5, 4))).otherwise(bare)
    halves = F.split(plain, "::")
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    left, right = groups(halves[0]), F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    missing = 8 - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.when(F.size(halves) == 2, missing).otherwise(0)), right)
    fits = plain.contains(":") & (F.size(halves) <= 2) & (F.size(whole) == 8) & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & ((F.size(halves) == 1) | (missing > 0))
    return F.when(fits, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))


def is_blocked_ipv6(h: Column) -> Column:
    """Whether an IPv6 address lies in a network that isn't public; false for other hosts."""
    bits = F.array_join(F.transform(F.split(ipv6_hex(h), ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")
    return F.coalesce(F.exists(F.array(*[F.lit(network_bits(x)) for x in NOT_PUBLIC_V6]), lambda b: bits.startswith(b)), F.lit(False))


def network_bits(network: str) -> str:
    """The fixed bits of an IPv6 network."""
    address, n = network.split("/")
    left, _, right = address.partition("::")
    heads, tails = [g for g in left.split(":") if g], [g for g in right.split(":") if g]
    groups = heads + ["0"] * (8 - len(heads) - len(tails)) + tails
    return "".join(f"{int(g, 16):016b}" for g in groups)[: int(n)]


def is_public(url: Column) -> Column:
    """Whether a URL is clearly public http(s): no white space, control character, backslash or user, no private host or
    address; an IPv6 address in brackets counts by its network."""
    u = F.trim(url)
    full = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))
    h = F.regexp_replace(host(full), r"\.+$", "")
    private = h.isin(PRIVATE_HOSTS) | ~(h.contains(".") | h.startswith("[")) | is_blocked_ipv4(h) | (h.startswith("[") & (ipv6_hex(h).isNull() | is_blocked_ipv6(h)))
    for s in PRIVATE_SUFFIXES:
        private = private | h.endswith(s)
    good = scheme(full).isin("http", "https") & (h != "") & ~authority_part(full).contains("@") & ~h.contains("%") & ~private
    return F.coalesce((u != "") & ~u.rlike(r"[\s\x00-\x1f\x7f\\]") & good, F.lit(False))


def domain_matches(h: Column, d: Column | str) -> Column:
    d = F.lit(d) if isinstance(d, str) else d
    return (h == d) | h.endswith(F.concat(F.lit("."), d))


def scope_matches(url: Column, scope: Column | str) -> Column:
    """Whether a URL lies in a scope, host or host/path; paths match by whole segments."""
    s = F.regexp_replace(F.trim(F.lower(F.lit(scope) if isinstance(scope, str) else scope)), r"^www\.", "")
    s_host, s_path = F.regexp_extract(s, "^[^/]*", 0), F.regexp_extract(s, "^[^/]*/(.*)$", 1)
    p = F.lower(F.when(path(url) == "", "/").otherwise(path(url)))
    inside = (s_path == "") | (p == F.concat(F.lit("/"), s_path)) | p.startswith(F.concat(F.lit("/"), F.regexp_replace(s_path, "/+$", ""), F.lit("/")))
    return F.coalesce((domain(url) != "") & (s != "") & domain_matches(domain(url), s_host) & inside, F.lit(False))


def normalize_domain(value: Column) -> Column:
    v = F.regexp_replace(F.lower(F.trim(value)), "^[a-z]+://", "")
    return F.regexp_replace(F.regexp_extract(v, "^[^/?#]*", 0), r"^www\.", "")


def version_segments(url: Column) -> Column:
    return F.transform(F.filter(F.split(path(url), "/"), lambda s: (s != "") & s.rlike(VERSION_SEGMENT)), F.lower)


def slug_words(url: Column) -> Column:
    """The words of a URL's path, lower-cased: without a page's extension, separators as spaces."""
    p = F.regexp_replace(path(url), r"(?i)\.(html?|php|aspx?|cms)$", " ")
    return F.lower(F.regexp_replace(p, r"[/\-_.]+", " "))


def slug_title(url: Column) -> Column:
    """A title made of the last path segment; the URL if that has no words."""
    last = F.try_element_at(F.filter(F.split(path(url), "/"), lambda s: s != ""), F.lit(-1))
    words = F.substring(F.trim(F.regexp_replace(F.regexp_replace(last, r"(?i)\.(html?|php|aspx?)$", ""), r"[-_]+", " ")), 1, 240)
    return F.when(words != "", words).otherwise(url)


def source_id(key: Column) -> Column:
    return F.concat(F.lit("s"), F.substring(F.sha2(key, 256), 1, 10))


def authority(url: Column, weights: dict[str, float] = AUTHORITY, default: float = DEFAULT_AUTHORITY) -> Column:
    """The weight of the longest suffix that matches the host."""
    h, out = domain(url), None
    for suffix in sorted(weights, key=lambda s: (-len(s.lstrip(".")), s)):
        hit = domain_matches(h, suffix.lstrip(".").lower())
        out = F.when(hit, F.lit(weights[suffix])) if out is None else out.when(hit, F.lit(weights[suffix]))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


# Publishers.
ESTABLISHED = "reuters.com apnews.com bbc.com bbc.co.uk theguardian.com nytimes.com washingtonpost.com wsj.com ft.com bloomberg.com cnbc.com cnn.com npr.org pbs.org abcnews.go.com cbsnews.com nbcnews.com aljazeera.com politico.com politico.eu axios.com theverge.com arstechnica.com techcrunch.com wired.com nature.com science.org sciencemag.org nationalgeographic.com economist.com time.com newsweek.com usatoday.com latimes.com sfchronicle.com thehindu.com hindustantimes.com indianexpress.com nikkei.com japantimes.co.jp scmp.com dw.com france24.com lemonde.fr spiegel.de elpais.com corriere.it globo.com folha.uol.com.br thestreet.com marketwatch.com barrons.com coindesk.com theblock.co insideevs.com space.com spaceflightnow.com nasaspaceflight.com mongabay.com carbonbrief.org flightglobal.com aviationweek.com defensenews.com breakingdefense.com".split()
PRIMARY_SUFFIXES = ".gov .gov.in .gov.uk .mil .nic.in .int .europa.eu .un.org .who.int .gc.ca .canada.ca".split()
PRIMARY_DOMAINS = "nasa.gov nih.gov cdc.gov noaa.gov usgs.gov federalreserve.gov sec.gov commerce.gov whitehouse.gov ec.europa.eu ecb.europa.eu unfccc.int who.int opec.org iea.org iter.org llnl.gov inpe.br boj.or.jp apple.com openai.com airbus.com boeing.com investor.nvidia.com nhc.noaa.gov earthquake.usgs.gov eci.gov.in".split()


def source_quality(url: Column) -> Column:
    """0.95 for primary publishers, 0.85 for established ones and their subdomains, else 0.5."""
    h = domain(url)
    primary = h.isin(PRIMARY_DOMAINS)
    for s in PRIMARY_SUFFIXES:
        primary = primary | (h == s.lstrip(".")) | h.endswith(s)
    labels = F.split(h, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.arrays_overlap(tails, F.array(*[F.lit(x) for x in ESTABLISHED]))
    return F.when(h == "", 0.5).when(primary, 0.95).when(known, 0.85).otherwise(0.5)


def search_redirect(href: Column) -> Column:
    """The target of a redirect that carries it in uddg, else the link (with https: before //)."""
    full = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    found = decode(F.regexp_extract(full, r"[?&]uddg=([^&#]*)", 1))
    return F.when(found != "", found).otherwise(full)


def coded_redirect(href: Column) -> Column:
    """The target of a redirect that carries it in u as a1 and URL-safe base64, else the link."""
    token = F.regexp_extract(href, r"[?&]u=a1([^&#]*)", 1)
    plain = F.translate(token, "-_", "+/")
    padded = F.rpad(plain, F.length(plain) + F.pmod(-F.length(plain), F.lit(4)), "=")
    found = F.try_to_binary(padded, F.lit("base64")).cast("string")
    mine = host(href).endswith("bing.com") & path(href).startswith("/ck/")
    return F.when(mine & (token != "") & found.rlike("^https?://"), found).otherwise(href)


def click_redirect(href: Column) -> Column:
    """The target of a click counter that carries it in url or u, else the link."""
    found = F.coalesce(*[F.when(_param(href, k).rlike("^https?://"), _param(href, k)) for k in ("url", "u")])
    return F.when(host(href).endswith("bing.com"), F.coalesce(found, href)).otherwise(href)


def cookie_domain_matches(h: Column, d: Column, host_only: Column) -> Column:
    return F.when(host_only, h == d).otherwise(domain_matches(h, d))


def cookie_path_matches(requested: Column, own: Column) -> Column:
    return (requested == own) | (requested.startswith(own) & (own.endswith("/") | (F.substr(requested, F.length(own) + 1, F.lit(1)) == "/")))


#: Scheme, authority with its slashes, path, query with its mark, fragment with its mark (RFC 3986, appendix B).
REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def without_dot_segments(path: Column) -> Column:
    """A path without its . and .. segments (RFC 3986, 5.2.4), as a fold over its segments; a path without a leading slash and
    one without a dot segment stay as they are."""
    segments = F.split(F.substr(path, F.lit(2)), "/", -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    last = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.startswith("/") & path.contains("/."), F.concat(F.lit("/"), F.array_join(F.concat(kept, last), "/"))).otherwise(path)


def resolve(base: Column, reference: Column) -> Column:
    """A reference as an absolute URL against the base it was found under (RFC 3986, 5.2.2, strict). Space around either is
    dropped; a null gives null. A base without a scheme gives what a reference alone can say."""
    b, r = F.trim(base), F.trim(reference)
    part = lambda u, k: F.regexp_extract(u, REFERENCE, k)
    scheme, authority, path, query = (part(r, k) for k in (1, 2, 3, 4))
    merged = F.when((part(b, 2) != "") & (part(b, 3) == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_extract(part(b, 3), r"(?s)^(.*/)?", 0), path))
    own = (scheme != "") | (authority != "")
    new_path = F.when(own | path.startswith("/"), without_dot_segments(path)).when(path == "", part(b, 3)).otherwise(without_dot_segments(merged))
    new_query = F.when(own | (path != "") | (query != ""), query).otherwise(part(b, 4))
    new_scheme = F.when(scheme != "", scheme).otherwise(part(b, 1))
    new_authority = F.when(own, authority).otherwise(part(b, 2))
    return F.concat(F.when(new_scheme != "", F.concat(new_scheme, F.lit(":"))).otherwise(""), new_authority, new_path, new_query, part(r, 5))


def _byte(data: Column, at: Column) -> Column:
    """The byte at a place from 0, as a number; null beyond the end."""
    return F.when(at < F.length(data), F.conv(F.hex(F.substr(data, at.cast("int") + 1, F.lit(1))), 16, 10).cast("long"))


def _varint(data: Column, at: Column) -> Column:
    """(value, next): the varint at a place; next is null if it doesn't end within nine bytes."""
    zero = F.struct(F.lit(0).cast("long").alias("value"), at.cast("long").alias("at"), F.lit(None).cast("long").alias("next"))

    def step(state: Column, k: Column) -> Column:
        b = _byte(data, state["at"])
        more = F.struct((state["value"] + (b % 128) * F.pow(F.lit(2), k * 7).cast("long")).alias("value"), (state["at"] + 1).alias("at"), F.when(b < 128, state["at"] + 1).alias("next"))
        return F.when(state["next"].isNotNull() | b.isNull(), state).otherwise(more)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(8)), zero, step)
    return F.struct(done["value"].alias("value"), done["next"].alias("next"))


def wire_fields(data: Column, most: int = 16) -> Column:
    """The first `most` fields of a message in protobuf's wire format: an array of (number, kind, bytes), with the content of
    those that have a length (kind 2). It ends where the bytes do or make no sense."""
    none = F.array().cast("array<struct<number: long, kind: long, bytes: binary>>")

    def step(state: Column, _: Column) -> Column:
        def field(tag: Column) -> Column:
            kind = tag["value"] % 8

            def sized(length: Column) -> Column:
                begin = F.when(kind == 2, length["next"]).otherwise(tag["next"])
                size = F.when(kind == 2, length["value"]).when(kind == 0, length["next"] - tag["next"]).when(kind == 1, F.lit(8).cast("long")).when(kind == 5, F.lit(4).cast("long"))
                good = tag["next"].isNotNull() & (tag["value"] >= 8) & size.isNotNull() & (size >= 0) & (begin + size <= F.length(data))
                one = F.struct(F.floor(tag["value"] / 8).alias("number"), kind.alias("kind"), F.when(kind == 2, F.substr(data, begin.cast("int") + 1, size.cast("int"))).alias("bytes"))
                return F.when(F.coalesce(good, F.lit(False)), F.struct((begin + size).alias("at"), F.concat(state["found"], F.array(one)).alias("found"))).otherwise(F.struct(F.lit(None).cast("long").alias("at"), state["found"].alias("found")))

            return F.get(F.transform(F.array(_varint(data, tag["next"])), sized), F.lit(0))

        return F.when(state["at"].isNull() | (state["at"] >= F.length(data)), state).otherwise(F.get(F.transform(F.array(_varint(data, state["at"])), field), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.struct(F.lit(0).cast("long").alias("at"), none.alias("found")), step)["found"]


def coded_news(url: Column) -> Column:
    """The publisher's URL that a news wrapper's path holds as a message: its first field that is one. Where the message can't be
    read as fields, the first run of printable characters that begins as a URL; without either the wrapper itself."""
    last = F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), "[^/]*$", 0)
    plain = F.translate(last, "-_", "+/")
    data = F.try_to_binary(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "="), F.lit("base64"))
    texts = F.transform(F.filter(wire_fields(data), lambda f: f["kind"] == 2), lambda f: F.decode(f["bytes"], "ISO-8859-1"))
    field = F.get(F.filter(texts, lambda t: t.rlike(r"^https?://[\x20-\x7e]+$")), F.lit(0))
    loose = F.nullif(F.regexp_extract(F.decode(data, "ISO-8859-1"), r"https?://[\x20-\x7e]+", 0), F.lit(""))
    return F.when(host(url).endswith("news.google.com") & (last != ""), F.coalesce(field, loose, url)).otherwise(url)
