"""Text expressions: tokens, phrases, sentences, measures, safety flags. Spark SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = "a an and are as at be been but by can could did do does for from had has have how i in into is it its of on or should so than that the their them there these they this to was we were what when where which who why will with would you your".split()
GENERIC_TERMS = "report reports said says news according also more most about their there which would could other using".split()
STORY_STOPWORDS = "a an the and or of in on at to for by with from as is are was were be been it its this that has have had will would can could".split()
NEGATIONS = "not no never without cannot none neither nor isn't doesn't wasn't aren't didn't won't don't hasn't".split()
CJK = r"\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{0E00}-\x{0E7F}\x{0E80}-\x{0EFF}\x{1780}-\x{17FF}\x{1000}-\x{109F}"
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
RUN = r"(?:[A-Za-z0-9._+#\-]|[^\x00-\x7F\p{Z}])+"
SITE = r"(?i)\bsite:([A-Za-z0-9][A-Za-z0-9._\-]*(?:/[^\s]*)?)"
QUOTED = r"\"([^\"]{2,120})\"|\x{201C}([^\x{201D}]{2,120})\x{201D}"
TITLE_WORD = r"[\p{L}\p{N}_]+"
CONTENT_WORD = r"[A-Za-z][A-Za-z'\-]*|[0-9]+(?:\.[0-9]+)?"
NUMBER = r"\b[0-9]+(?:[.,][0-9]+)?%?"
SYNDICATION = r"(?i)\b(reuters|associated press|ap|afp|agence france-presse|bloomberg|cnn|bbc|the guardian|guardian|al jazeera|via|syndicated|wire report|breaking news|latest news|update[sd]?|live|watch|video|photos?)\b"
INJECTION = [
    ("instruction_override", r"ignore (?:all |any |the )?(?:previous|prior|above) (?:instructions|prompts|messages|rules)"),
    ("role_hijack", r"\byou are now (?:a |an |the )?(?:system|developer|admin|unrestricted)|\bact as (?:the )?(?:system|developer)\b"),
    ("system_prompt_probe", r"(?:reveal|print|show|leak) (?:your|the) (?:system )?(?:prompt|instructions)"),
    ("tool_directive", r"(?:call|invoke|execute|run)\s+(?:the\s+)?(?:shell\s+command|bash|sh|zsh|fish|powershell|cmd\.exe)\b"),
    ("tool_directive", r"(?:call|invoke|execute|run)\s+(?:the\s+)?(?:tool|function|api|endpoint|command)\s+(?:[\"'`][^\"'`\n]{1,120}[\"'`]|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\s*\(|[\w-]+(?:\.[\w-]+)+)"),
    ("tool_directive", r"\b(?:you|agent|assistant|model|llm|ai)\b[^.\n]{0,30}?\b(?:must|should|need\s+to|needs\s+to|have\s+to|shall)\s+(?:now\s+)?(?:call|invoke|execute|run)\s+(?:the\s+)?(?:tool|function|command|api)\b"),
    ("tool_directive", r"\b(?:agent|assistant|ai|llm|model)\s*[:,]\s*(?:please\s+)?(?:call|invoke|execute|run)\s+(?:the\s+)?(?:tool|function|command|api)\b"),
    ("tool_directive", r"\b(?:now|then|next|finally|after\s+that)\s*[:,]?\s+(?:call|invoke|execute|run)\s+(?:the\s+)?(?:tool|function|command|api)\b"),
    ("credential_exfiltration", r"(?:send|post|upload|exfiltrate|forward) .{0,80}(?:password|api key|cookies?|credentials?|session token)"),
    ("embedded_data_image", r"data:image/(?:png|jpe?g|gif|webp|svg\+xml);base64,[A-Za-z0-9+/]{256,}"),
    ("embedded_iframe", r"<\s*iframe\b"),
    ("secret_material", r"-----BEGIN (?:RSA |OPENSSH |EC |DSA |PGP )?PRIVATE KEY-----"),
]
UNITS = {"": "count", "%": "percent", "percent": "percent", "per cent": "percent", "$": "usd", "usd": "usd", "€": "eur", "eur": "eur", "£": "gbp", "gbp": "gbp", "₹": "inr", "inr": "inr", "bn": "billions", "billion": "billions", "mn": "millions", "mm": "millions", "million": "millions", "k": "thousands", "thousand": "thousands", "crore": "crores", "lakh": "lakhs"}
MEASURE = r"(?i)(?:^|[^\p{L}\p{N}_])([0-9][0-9,]*(?:\.[0-9]+)?)\s*(percent|per\s+cent|%|usd|inr|eur|gbp|\$|€|£|₹|billion|bn|million|mm|mn|thousand|k|crore|lakh)?"
SHELL_NOTICES = ["enable javascript", "javascript is required", "javascript is disabled", "you need to enable javascript", "must enable javascript", "this application requires javascript", "please enable js"]
NOT_FOUND = ["404 not found", "page not found", "error 404", "does not exist"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it; a lambda's own expressions are worked out
    at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def site_scopes(text: Column) -> Column:
    found = F.transform(_all(text, SITE, 1), lambda s: F.regexp_replace(F.lower(F.regexp_extract(s, r"^[^?]*", 0)), r"\.+$", ""))
    return F.array_distinct(F.filter(found, lambda s: s != ""))


def without_sites(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, SITE, " "))


def site_hosts(text: Column) -> Column:
    return F.array_distinct(F.transform(site_scopes(text), lambda s: F.regexp_extract(s, "^[^/]*", 0)))


def site_scoped(text: Column) -> Column:
    scopes = site_scopes(text)
    named = F.array_join(F.transform(scopes, lambda s: F.concat(F.lit("site:"), s)), " ")
    return F.when(F.size(scopes) == 0, squeeze(text)).otherwise(F.trim(F.concat(named, F.lit(" "), without_sites(text))))


def _token(run: Column) -> Column:
    def named(t: Column) -> Column:
        t = F.when(t.startswith(".") & ~t.rlike(r"^\.[A-Za-z][A-Za-z0-9]*$"), F.regexp_replace(t, r"^\.+", "")).otherwise(t)
        return F.when(t.rlike(r"[\p{L}\p{N}]"), F.lower(t)).otherwise("")

    # Most runs are plain words, which are what they are but for their case.
    return F.when(run.rlike("^[A-Za-z0-9]+$"), F.lower(run)).otherwise(let(F.regexp_replace(F.regexp_replace(run, r"^[-_]+|[-_]+$", ""), r"\.+$", ""), named))


def tokens(text: Column) -> Column:
    """Distinct tokens in order, with the signs of names such as c++, c# and .net kept; runs of scripts without spaces
    whole and as pairs of characters; hosts of site: operators last. Text is taken to be in NFC (html.normal_form gives it)."""
    def pieces(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))
        return F.when((F.length(run) >= 2) & run.rlike(f"^[{CJK}]+$"), F.concat(F.array(run), pairs)).otherwise(F.array(_token(run)))

    # Each run once, and nothing twice that a text without operators doesn't need.
    scoped = text.rlike(SITE)
    runs = F.array_distinct(_all(F.when(scoped, without_sites(text)).otherwise(text), RUN))
    found = F.array_distinct(F.filter(F.flatten(F.transform(runs, pieces)), lambda t: t != ""))
    return F.when(scoped, F.array_distinct(F.concat(found, site_hosts(text)))).otherwise(found)


def terms(text: Column) -> Column:
    """Tokens that mean something: of more than two characters, with + # or . in them, or not ASCII."""
    return terms_of(tokens(text))


def terms_of(found: Column) -> Column:
    """The same of what tokens() gives."""
    return F.filter(found, lambda t: (F.length(t) > 2) | t.rlike(r"[+#.]|[^\x00-\x7F]"))


def quoted(text: Column) -> Column:
    both = F.zip_with(_all(text, QUOTED, 1), _all(text, QUOTED, 2), lambda a, b: squeeze(F.when(a != "", a).otherwise(b)))
    return F.array_distinct(F.filter(both, lambda p: p != ""))


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, QUOTED, "$1$2")


def clean_query(text: Column, most: int = 400) -> Column:
    """Without control and invisible characters, white space squeezed; null if empty or longer than `most`."""
    t = squeeze(F.regexp_replace(F.regexp_replace(text, CONTROL, ""), INVISIBLE, ""))
    return F.when((t != "") & (F.length(t) <= most), t)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def title_words(title: Column) -> Column:
    return F.array_distinct(F.transform(_all(title, TITLE_WORD), F.lower))


def syndication_terms(title: Column) -> Column:
    return F.array_sort(terms(F.regexp_replace(F.lower(title), SYNDICATION, " ")))


def story_stem(t: Column) -> Column:
    n = F.length(t)
    cut = (
        F.when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, 1, n - 3), F.lit("y")))
        .when((n > 4) & t.endswith("ing"), F.substring(t, 1, n - 3))
        .when((n > 4) & t.endswith("ed"), F.substring(t, 1, n - 2))
        .when((n > 3) & t.endswith("s") & ~t.rlike("(ss|us|is)$"), F.substring(t, 1, n - 1))
        .otherwise(t)
    )
    return F.when((F.length(cut) > 3) & cut.endswith("e"), F.substring(cut, 1, F.length(cut) - 1)).otherwise(cut)


def story_words(title: Column) -> Column:
    words = F.filter(F.transform(_all(title, TITLE_WORD), F.lower), lambda w: ~w.isin(STORY_STOPWORDS))
    return F.array_distinct(F.transform(words, story_stem))


def containment(a: Column, b: Column, least: int = 4) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.when(n >= least, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def content_terms(text: Column) -> Column:
    """Distinct content words in order: three characters or more, no stopword, generic word or number."""
    low = F.transform(_all(text, CONTENT_WORD), lambda w: F.regexp_replace(F.lower(w), r"^['\-]+|['\-]+$", ""))
    return F.array_distinct(F.filter(low, lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS + GENERIC_TERMS) & ~w.rlike("^[0-9]+$")))


def evidence_relevance(question: Column, text: Column) -> Column:
    q = content_terms(question)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, content_terms(text))) / F.size(q)).otherwise(F.lit(0.0))


SHELLISH = r"(?i)&&|\\\s*$|^\s*\$\s|^\s*(?:curl|wget|pip|npm|docker)\s"


def clean_markup(text: Column) -> Column:
    """Prose without fenced code, tags, images, link targets, tables, shell lines, list marks and emphasis."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", " ")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1")
    lines = F.filter(F.split(t, r"\r\n|\n|\r"), lambda x: ~x.rlike(r"\|.*\|") & ~x.rlike(SHELLISH))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"^\s{0,3}(?:#{1,6}\s+|[-*+]\s+|[0-9]+[.)]\s+|>\s*)", ""))
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"\*\*|__|`", ""), r"https?://\S+", " ")), "\n")


def sentences(text: Column) -> Column:
    """Sentences of 6 to 40 words that are letters for three fifths or more."""
    return sentences_of(clean_markup(text))


def sentences_of(prose: Column) -> Column:
    """The same for what clean_markup() gives."""
    parts = F.transform(F.split(prose, r"(?<=[.!?])\s+|\n+"), squeeze)
    n = lambda p: F.size(F.split(p, " "))
    return F.filter(parts, lambda p: n(p).between(6, 40) & (F.length(F.regexp_replace(p, r"[^\p{L}]", "")) >= F.length(p) * 0.6))


def measurements(sentence: Column) -> Column:
    """Numbers as written, without four-digit years."""
    return F.filter(_all(sentence, NUMBER), lambda x: ~x.rlike(r"^(19|20)[0-9]{2}$"))


def negated(sentence: Column) -> Column:
    low = F.transform(_all(sentence, r"[A-Za-z']+"), lambda w: F.regexp_replace(F.lower(w), r"^'+|'+$", ""))
    return F.arrays_overlap(low, F.array(*[F.lit(x) for x in NEGATIONS]))


def unit_values(text: Column) -> Column:
    """The first value of each unit, as a map."""
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    pairs = F.zip_with(_all(text, MEASURE, 1), _all(text, MEASURE, 2), lambda v, u: F.struct(
        F.coalesce(F.try_element_at(units, F.lower(F.regexp_replace(u, r"\s+", " "))), F.lit("count")).alias("unit"), F.replace(v, F.lit(","), F.lit("")).cast("double").alias("value")))
    return F.aggregate(pairs, F.expr("CAST(map() AS MAP<STRING, DOUBLE>)"), lambda m, p: F.when(F.map_contains_key(m, p["unit"]), m).otherwise(F.map_concat(m, F.create_map(p["unit"], p["value"]))))


def materially_different(a: Column, b: Column) -> Column:
    high, low = F.greatest(F.abs(a), F.abs(b)), F.least(F.abs(a), F.abs(b))
    return F.when(a == b, False).when(low == 0, True).otherwise((high - low) / low > 0.05)


#: What a text in lower case must hold before a pattern of that name is tried at all.
CUES = {
    "instruction_override": ["ignore"], "role_hijack": ["you are now", "act as"], "system_prompt_probe": ["prompt", "instructions"], "tool_directive": ["call", "invoke", "execute", "run"], "credential_exfiltration": ["password", "api key", "cookie", "credential", "session token"],
    "embedded_data_image": ["data:image"], "embedded_iframe": ["iframe"], "secret_material": ["private key"],
}


def flags(text: Column) -> Column:
    """Sorted flags of invisible characters and of phrases that try to command a reader."""
    def of(low: Column) -> Column:
        found = [F.when(text.rlike(INVISIBLE), "invisible_characters")]
        for name, cues in CUES.items():
            held = F.contains(low, F.lit(cues[0]))
            for cue in cues[1:]:
                held = held | F.contains(low, F.lit(cue))
            hit = F.lit(False)
            for flag, pattern in INJECTION:
                hit = hit | text.rlike("(?i)" + pattern) if flag == name else hit
            found.append(F.when(held & hit, f"prompt_injection:{name}"))
        return F.array_sort(F.array_compact(F.array(*found)))

    return let(F.lower(text), of)


def sanitize(text: Column, most: int = 2000) -> Column:
    """Without invisible and control characters, blanks squeezed, cut with an ellipsis inside the limit."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), INVISIBLE, ""), CONTROL, "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"^\s+|\s+$", "")
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most - 1), r"\s+$", ""), F.lit("…"))).otherwise(t)


def truncate(text: Column, most: int) -> Column:
    """At most `most` characters, with a note of how many were left out inside the limit."""
    n = F.length(text)
    note = lambda left: F.concat(F.lit("\n\n…[truncated "), left.cast("string"), F.lit(" chars]"))
    # The note's length depends on the number's digits; two rounds settle it.
    first = n - (most - F.length(note(n - max(0, most - 32))))
    second = n - (most - F.length(note(first)))
    cut = F.concat(F.regexp_replace(F.substring(text, F.lit(1), n - second), r"\s+$", ""), note(second))
    return F.when(n <= most, text).when(F.length(note(second)) > most, F.substring(text, 1, most)).otherwise(F.substring(cut, 1, most))


def is_soft_404(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 1024))
    hit = head.contains(NOT_FOUND[0])
    for m in NOT_FOUND[1:]:
        hit = hit | head.contains(m)
    return (F.length(text) <= 2000) & hit


LINK_LINE = r"^(?:[-*]\s+|#{1,6}\s+)?(?:\[[^\]]*\]\([^)]*\)\s*)+$"


def longest_link_run(text: Column) -> Column:
    """The longest run of lines that are nothing but links."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x).rlike(LINK_LINE))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc: Column, hit: Column) -> Column:
        now = F.when(hit, acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(lines, zero, step, lambda a: a["best"])


def is_empty_shell(text: Column) -> Column:
    """Whether a text is none: a notice that asks for scripts, or hardly any text."""
    t = squeeze(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    notice = low.contains(SHELL_NOTICES[0])
    for m in SHELL_NOTICES[1:]:
        notice = notice | low.contains(m)
    return notice | (F.length(t) < 150)


def is_script_shell(text: Column) -> Column:
    """Whether text looks like an application's shell: a notice, hardly any text, mostly links, no sentences, or a menu."""
    t = squeeze(F.coalesce(text, F.lit("")))
    n = F.length(t)
    labels = F.aggregate(_all(t, r"\[([^\]]*)\]\([^)]*\)", 1), F.lit(0), lambda a, x: a + F.length(x))
    ends = F.regexp_count(t, F.lit(r"[.!?](?:\s|$)"))
    return is_empty_shell(text) | (labels >= n * 0.55) | ((n >= 400) & ((ends * 1000.0 < n * 1.2) | (longest_link_run(text) >= 4)))


def is_prose(segment: Column) -> Column:
    n = F.size(F.split(squeeze(segment), " "))
    return (squeeze(segment) != "") & ((n >= 10) | ((n >= 5) & segment.rlike(r"[.!?][\"')]?\s*$")))


def html_title(html: Column) -> Column:
    """The text of <title>, else of the first <h1>."""
    def inner(tag: str) -> Column:
        return squeeze(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"<[^>]+>", " "))

    return F.when(inner("title") != "", inner("title")).otherwise(inner("h1"))


def found_in_page(text: Column, phrase: Column, most: int = 50, around: int = 100) -> Column:
    """The first `most` places of a phrase in a text, whatever the case, with what stands around each: (at, context)."""
    def places(parts: Column) -> Column:
        upto = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p)) + (i - 1) * F.length(phrase) + 1
        one = lambda i: let(upto(i), lambda at: F.struct(at.alias("at"), F.substr(text, F.greatest(F.lit(1), at - around), F.length(phrase) + around + F.least(F.lit(around), at - 1)).alias("context")))
        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(parts) - 1)), one)).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<at: INT, context: STRING>>)"))

    quoted = F.concat(F.lit(r"\Q"), F.replace(F.lower(phrase), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when(phrase != "", let(F.call_function("split", F.lower(text), quoted, F.lit(-1)), places))
