"""What a question asks for: a page to read, a subject and a kind of source, engines to ask. Expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import intent as I
from . import text as T
from . import url as U

# Fixed values.
QUESTION_OPENERS = "what why how when where who whom whose which is are was were do does did can could should would will has have had explain tell meaning difference".split()
OPENERS = "what which who whom whose when where why how is are was were do does did can could should would will shall may might must explain describe define list".split()
MARKERS = """
academic accounts against alternatives announcement archive article articles arxiv behavior breaking browser case cases caveats change changes check code comment comments common comparability compare comparison competing concern conflicting
consequences conservation contemporary context corroborated counterexample counterexamples court csv current dashboard data dataset datasets date dates debate debugging definition definitions disambiguation discrepancy disputed documentation documented documents doi downloadable
earliest economic effect encyclopedia error errors evidence exact example examples experiment experimental explanation explanations fact facts factual failing failure failures fee fees fix gaps github government guidance guide
guideline guidelines historical histories implications independent industry interactive interpretation interpretations intervals issue issues known later latest lecture legal legislation library limit limitations list literal literature logs main metadata
methodology methods migration minimal misconception misconceptions navigation note notes numeric official operations original page paper papers pdf peer primary principles proof public published recent recommended record records reference
references regression release releases reliable rendered report reports reproduce reproducibility reproducible research retrospective review reviewed reviews revisions rigorous safety scoping section sections semantics simplified source sources specific spelling
statistics statute studies study subscription superseding systematic technical terminology text texts trial troubleshooting two uncertainty university update usual variants version versions versus wiki without worked
""".split()
SHAPE_WORDS = """
academic accessibility account accounts against alternative alternatives announcement archive article behavior breaking browser case causal caveats change changes check claims common comparability compare comparison competing conflicting conservation contemporary context
conventions corroborated counterexample court csv current dashboard dataset date dates debugging definition definitions disambiguation disputed documentation documented documents downloadable earliest effect eligibility encyclopedia error errors evidence exact example
exceptions experimental explanation explanations fact facts factual failing failure failures fees fix github government guidance guide guideline historical histories how implication implications independent indian industry interactive interpretations intervals
issue known later latest lecture limitations literature main meaning measurement metadata methodology methods migration minimal misconceptions names navigation notes official pdf peer primary proof quality recent recommended record
reference references regression release reliable rendered replication reporting reproducible research retry review reviewed reviews revisions rigorous scientific section security simplified software source sources specific spelling statute studies study
systematic technical terminology text troubleshooting two uncertainty university update usual variants version what where which who why wikipedia without worked year
""".split()
CONNECTIVES = "and as by for from in into of on or that the to with within".split()
MONTH_WORDS = "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec".split()
PHRASES = [p.strip() for p in """
academic source references|archive documents|arxiv|as of 17 october 2026 official source|browser rendered content accessibility|common factual errors|common misconceptions and evidence|compare explanations from two independent references|
compare independent estimates|compare two independent systematic reviews|competing historical interpretations|conflicting accounts evidence|conflicting definitions conventions|conflicting estimates methodology|conflicting guidelines explanation|
conservation or archive official record|contemporary accounts versus later histories|csv api metadata|current rules october 2026|debugging production error|disambiguation|disputed facts reliable sources|doi|earliest documented date|encyclopedia fact check|
evidence for and against causal effect|evidence quality systematic review|exact date and terms|exact dates primary sources|exceptions court interpretation|experimental evidence and limitations|explanation with primary sources|failure case study|
fees and eligibility official source|github issue regression|government data versus industry claims|government reference source|indian government guideline|interactive dashboard data source|known limitations 2026|latest guideline date|
latest official update october 2026|latest release|latest release date|latest release date primary source|latest year methodology|limits of the usual simplified explanation|main article text without navigation|measurement methods uncertainty|
measurement uncertainty|migration breaking changes|minimal failing example fix|minimal reproducible example|official dataset download|official documentation|official policy|official procedure|official reference|official source|original paper|
original paper arxiv|original paper doi|pdf|peer reviewed comparison methods|primary documentation|primary source|primary studies with uncertainty intervals|proof assumptions limitations|public access alternatives|
recent peer reviewed research 2025 2026|recent reporting corroborated by official announcement|recommended retry behavior|references|replication failures primary literature|reproducible error documentation|revisions comparability caveats|
rigorous explanation|safety limits primary source|scientific meaning|security implications|september 2026 versus october 2026 changes|software context|source methodology and downloadable data|spelling variants historical names|
standards technical guide|statute section primary source|systematic review|terminology definition sources|troubleshooting guide|university lecture notes pdf|version specific known issue|who guidance|wikipedia references|
worked counterexample|worked numerical example
""".replace("\n", "").split("|")]
KIND_WORDS = {
    "documentation": "documentation docs manual".split(),
    "primary": "primary original doi arxiv study studies literature paper".split(),
    "official": "government official statute guideline legal legislation policy conservation archive announcement record procedure".split(),
    "latest": "latest current release recent newest update changes".split(),
    "dataset": "dataset data csv api dashboard statistics download metadata".split(),
    "reference": "lecture notes academic references bibliography textbook course university pdf".split(),
    "encyclopedia": "encyclopedia wikipedia".split(),
}
#: Kinds of sources: ends of hosts, beginnings of hosts, whole segments of paths, words of titles.
SOURCES = {
    "documentation": ([".readthedocs.io", ".readthedocs.org", ".readthedocs.com"], ["docs.", "developer."], ["docs", "doc", "documentation", "reference", "manual", "developer", "api", "tutorial", "tutorials", "guide", "how-to", "cookbook"], ["documentation", "docs", "reference", "manual", "guide", "tutorial", "cookbook", "getting started"]),
    "official": ([".gov", ".gov.in", ".gov.uk", ".mil", ".nic.in", ".state.gov", ".europa.eu", ".un.org", ".who.int", ".int"], [], ["guideline", "guidelines", "circular", "notification", "act", "rules", "official", "policy", "statute"], ["official", "government", "ministry", "department", "guideline", "guidelines", "circular", "notification", "statute", "policy"]),
    "primary": ([".edu", ".ac.uk", ".ac.in", ".edu.in", "doi.org", "arxiv.org", "jstor.org", "pubmed.ncbi.nlm.nih.gov", "springer.com", "sciencedirect.com", "ieee.org", "acm.org", "nature.com", "science.org", "plos.org", "biomedcentral.com"], [], ["doi", "abs", "pdf", "paper", "preprint", "record"], ["original paper", "primary source", "primary study", "research", "study", "journal", "preprint", "doi", "peer reviewed", "peer-reviewed", "systematic review", "arxiv"]),
    "latest": ([], [], ["changelog", "releases", "release-notes", "whatsnew", "what-s-new", "versions", "latest"], ["changelog", "release notes", "what's new", "whats new", "new in", "latest release"]),
    "dataset": (["data.gov", "data.gov.in", "worldbank.org", "un.org", "europa.eu", "oecd.org", "kaggle.com", "datahub.io", "data.gov.uk", "nseindia.com"], ["data.", "datasets."], ["dataset", "datasets", "data", "api", "indicator", "statistics", "download", "downloads", "metadata"], ["dataset", "datasets", "statistics", "download", "dashboard", "indicator", "metadata"]),
    "reference": ([".edu", ".ac.uk", ".ac.in", ".edu.in", "scholar.google.com", "semanticscholar.org", "researchgate.net", "arxiv.org", "jstor.org"], [], ["lecture", "notes", "course", "syllabus", "pdf", "paper", "bibliography", "references"], ["lecture notes", "notes", "course", "syllabus", "references", "bibliography", "textbook", "academic"]),
    "encyclopedia": (["wikipedia.org", "britannica.com", "encyclopedia.com"], [], [], ["wikipedia", "encyclopedia", "britannica"]),
}
KIND_BONUS = 0.20
ACADEMIC = r"\b(peer[ -]?reviewed|systematic review|meta-analysis|primary literature|original paper|research paper|journal article|preprint|doi|bibliography|citation|scholarly literature|academic paper)\b|\barxiv\s+[0-9]{4}\.[0-9]{4,5}\b"
CODE_HOST = r"\b(github|repository|repositories|repo|repos|issue|issues|pull request|pull requests|release notes|open regression issue|source code|commit history)\b"
CODE_THING = r"\b(repository|repositories|repo|repos|pull request|pull requests|issue|issues|release|releases|commit|source code)\b"
TECHNICAL = r"\b(python|javascript|typescript|java|rust|c\+\+|c#|\.net|sql|postgres(?:ql)?|mysql|sqlite|redis|docker|kubernetes|k8s|nginx|linux|git|http|https|tls|ssl|node\.?js|react|vue|svelte|django|fastapi|numpy|pandas|pytest|terraform|webpack|openssl|grpc|graphql|asyncio|stack overflow|stackoverflow)\b|\b(?:ts|e|err)_?[0-9]{3,}\b"
STATES = ["andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal", "delhi", "jammu and kashmir", "ladakh", "puducherry"]
COUNTRIES = [
    ("india", "India", [".gov.in", ".nic.in", ".in"]), ("united states", "United States", [".gov"]), ("usa", "United States", [".gov"]), ("united kingdom", "United Kingdom", [".gov.uk"]), ("uk", "United Kingdom", [".gov.uk"]),
    ("australia", "Australia", [".gov.au"]), ("canada", "Canada", [".gc.ca", ".canada.ca"]), ("new zealand", "New Zealand", [".govt.nz"]), ("singapore", "Singapore", [".gov.sg"]), ("ireland", "Ireland", [".gov.ie"]),
    ("south africa", "South Africa", [".gov.za"]), ("uae", "UAE", [".gov.ae"]), ("germany", "Germany", [".de"]), ("france", "France", [".gouv.fr"]), ("japan", "Japan", [".go.jp"]), ("indian", "India", [".gov.in", ".nic.in", ".in"]),
]
LEADING_URL = "^(?i)(https?://[^\\s<>\"'`]+)"
AFTER_URL = ".,;:!?)]}\"'"
NOT_RUN = r"(?:[\x00-\x22\x24-\x2A\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]|\p{Z})*"


def _among(word: Column, items: list[str]) -> Column:
    return word.isin(items)


def read_request(question: Column) -> Column:
    """(url, request, asks): the URL that a question begins with and what follows it; asks is whether it wants something of
    that page: no second URL, no question of its own."""
    raw = F.trim(F.coalesce(question, F.lit("")))
    whole = F.regexp_extract(raw, LEADING_URL, 1)
    rest = F.trim(F.substr(raw, F.length(whole) + 1))
    first = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^\S+", 0), r"^[.,:;!?]+|[.,:;!?]+$", ""))
    asks = (whole != "") & ~rest.rlike("(?i)https?://") & ~rest.endswith("?") & ~_among(first, QUESTION_OPENERS)
    return F.struct(F.regexp_replace(whole, r"[.,;:!?)\]}\"']+$", "").alias("url"), F.when(whole != "", rest).otherwise("").alias("request"), asks.alias("asks"))


def _date_like(low: Column) -> Column:
    return _among(low, MONTH_WORDS) | low.rlike("[0-9]")


def _phrase_size(low: Column) -> Column:
    """How many of a question's last words are the longest known request; null if none are or nothing is before them."""
    plain = F.filter(F.transform(low, lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]\"']+|[.,;:!?()\[\]\"']+$", "")), lambda w: w != "")
    sizes = F.create_map(*[F.lit(x) for p in PHRASES for x in (p, len(p.split()))])

    def longest_of(kept: Column) -> Column:
        tails = F.transform(F.sequence(F.lit(1), F.least(F.lit(max(len(p.split()) for p in PHRASES)), F.size(kept) - 1)), lambda k: F.try_element_at(sizes, F.array_join(F.slice(kept, -k, k), " ")))
        return F.when(F.size(kept) > 1, F.array_max(tails))

    return T.let(plain, longest_of)


def _begin(words: Column) -> Column:
    """At which of a question's words its request begins (from 0); null where it has none that can be cut off."""
    return T.let(F.transform(words, F.lower), _begin_of)


def _begin_of(low: Column) -> Column:
    n = F.size(low)
    every = F.sequence(F.lit(0), n - 1)
    at = lambda i: F.get(low, i)
    stops = F.array_max(F.filter(every, lambda i: T.let(at(i), lambda w: _among(w, MARKERS) | ~(_date_like(w) | _among(w, CONNECTIVES)))))
    in_shape = lambda w: _among(w, SHAPE_WORDS) | _among(w, MARKERS) | _among(w, CONNECTIVES) | _date_like(w)
    opener = F.when(_among(at(F.lit(0)), OPENERS), at(F.lit(1))).otherwise(at(F.lit(0)))
    year = at(n - 1).rlike(r"^(19|20)[0-9]{2}$")

    def scanned(last: Column) -> Column:
        before = F.array_max(F.filter(every, lambda i: (i < last) & ~T.let(at(i), in_shape)))
        return F.when(_among(at(last), MARKERS), F.when(last > 0, F.coalesce(before + 1, F.lit(0)))).when(year, n - 1)

    by_scan = F.when(~F.coalesce(_among(opener, MARKERS), F.lit(False)), T.let(stops, scanned))
    found = T.let(_phrase_size(low), lambda longest: F.when(longest.isNotNull(), n - longest).otherwise(by_scan))
    return F.when(n >= 2, T.let(found, lambda x: F.when(x > 0, x)))


def _cut(raw: Column, begin: Column) -> Column:
    """(subject, request) of a question without site scopes whose request begins at a word (from 0)."""
    begin = F.when(F.size(T.site_scopes(raw)) == 0, begin)
    head = T.let(begin, lambda n: F.call_function("regexp_extract", raw, F.concat(F.lit(f"^(?:{NOT_RUN}{T.RUN}){{"), n.cast("string"), F.lit("}" + NOT_RUN)), F.lit(0)))
    return T.let(head, lambda h: F.struct(F.trim(F.regexp_replace(F.trim(h), r"[:;,\-\x{2014} ]+$", "")).alias("subject"), F.trim(F.substr(raw, F.length(h) + 1)).alias("request")))


def known_request(question: Column) -> Column:
    """(subject, request) as split_subject gives them, but only where a question ends in a known request; else null."""
    def begin(words: Column) -> Column:
        return T.let(F.transform(words, F.lower), lambda low: T.let(_phrase_size(low), lambda n: F.when(F.size(low) > n, F.size(low) - n)))

    def known(raw: Column) -> Column:
        return T.let(_cut(raw, begin(T._all(raw, T.RUN))), lambda c: F.when((c["subject"] != "") & (c["request"] != ""), c))

    return T.let(T.squeeze(F.coalesce(question, F.lit(""))), known)


def split_subject(question: Column) -> Column:
    """(subject, request): what a question is about, and the words at its end that ask for a kind of source.

    The longest known phrase at the end is the request; else words from the last
    marker back over words that requests are made of; else a year at the end. A
    question with a site scope, or that begins with a marker, is all subject.
    """
    def whole(raw: Column) -> Column:
        return T.let(_cut(raw, _begin(T._all(raw, T.RUN))), lambda c: F.when((c["subject"] != "") & (c["request"] != ""), c).otherwise(F.struct(raw.alias("subject"), F.lit("").alias("request"))))

    return T.let(T.squeeze(F.coalesce(question, F.lit(""))), whole)


def request_markers(request: Column) -> Column:
    """The markers of a request, in order, each once."""
    return F.array_distinct(F.filter(F.transform(T._all(request, T.RUN), F.lower), lambda w: _among(w, MARKERS)))


def request_kinds(question: Column, request: Column) -> Column:
    """The kinds of sources that a question asks for, sorted, by its request; a question that begins with a marker is all request."""
    def kinds(words: Column) -> Column:
        return F.array_sort(F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in items])), F.lit(kind)) for kind, items in KIND_WORDS.items()])))

    def shape(raw: Column) -> Column:
        opener = T.let(F.transform(F.slice(T._all(raw, T.RUN), 1, 2), F.lower), lambda low: F.when(_among(F.get(low, F.lit(0)), OPENERS), F.get(low, F.lit(1))).otherwise(F.get(low, F.lit(0))))
        return F.when(request != "", request).when(_among(opener, MARKERS), raw).otherwise("")

    text = T.let(T.squeeze(F.coalesce(question, F.lit(""))), shape)
    return T.let(F.split(F.lower(F.translate(text, ",-", "  ")), r"\s+"), kinds)


def source_kinds(url: Column, title: Column) -> Column:
    """The kinds of sources that a page is, sorted; none for a bare home page."""
    host, segments = U.domain(url), F.filter(F.split(F.lower(U.path(url)), "/"), lambda s: s != "")
    low = F.lower(F.coalesce(title, F.lit("")))
    kinds = []
    for kind, (ends, begins, paths, words) in SOURCES.items():
        tests = [host.endswith(x) for x in ends] + [host.startswith(x) for x in begins]
        tests += [F.arrays_overlap(segments, F.array(*[F.lit(x) for x in paths]))] if paths else []
        single, several = [w for w in words if " " not in w], [w for w in words if " " in w]
        tests.append(low.rlike(r"\b(" + "|".join(single) + r")\b"))
        tests += [F.contains(low, F.lit(w)) for w in several]
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        kinds.append(F.when(hit, F.lit(kind)))
    return F.when(F.size(segments) > 0, F.array_sort(F.array_compact(F.array(*kinds)))).otherwise(F.array().cast("array<string>"))


def kind_bonus(asked: Column, page: Column) -> Column:
    """What a page of a kind that was asked for gains in relevance."""
    return F.when(F.arrays_overlap(asked, page), KIND_BONUS).otherwise(0.0)


def jurisdiction(question: Column) -> Column:
    """(label, suffixes, domains): the place whose official sites a question means; an empty label if none."""
    low = F.lower(T.squeeze(F.coalesce(question, F.lit(""))))
    none = F.array().cast("array<string>")
    place = lambda label, suffixes, domains: F.struct(F.lit(label).alias("label"), F.array(*[F.lit(x) for x in suffixes]).alias("suffixes"), domains.alias("domains"))
    state = F.get(F.filter(F.array(*[F.lit(s) for s in STATES]), lambda s: F.contains(low, s)), F.lit(0))
    out = F.when(state.isNotNull(), F.struct(F.initcap(state).alias("label"), F.array(F.lit(".gov.in"), F.lit(".nic.in")).alias("suffixes"), F.array(F.concat(F.replace(state, F.lit(" "), F.lit("")), F.lit(".gov.in")), F.lit("gov.in")).alias("domains")))
    for name, label, suffixes in COUNTRIES:
        out = out.when(low.rlike(rf"\b{name}\b"), place(label, suffixes, none))
    return out.otherwise(F.struct(F.lit("").alias("label"), none.alias("suffixes"), none.alias("domains")))


def intent_multiplier(url: Column, kind: Column, suffixes: Column, domains: Column) -> Column:
    """What a page's host gains under a question's jurisdiction and kind of answer."""
    host = U.domain(url)
    on = F.exists(domains, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
    placed = F.when(on, 1.30).when(F.exists(suffixes, lambda s: host.endswith(s)), 1.20).otherwise(1.0)
    gov = F.contains(host, F.lit(".gov"))
    fit = (
        F.when((kind == "procedure") & (gov | host.endswith(".nic.in")), 1.20)
        .when((kind == "error") & (host.isin("stackoverflow.com", "github.com") | host.startswith("docs.") | host.startswith("developer.")), 1.20)
        .when((kind == "statistic") & (gov | F.contains(host, F.lit("statistics")) | host.startswith("data.")), 1.15)
        .otherwise(1.0)
    )
    return F.when(F.coalesce(host, F.lit("")) == "", 1.0).otherwise(placed * fit)


def routes(question: Column, today: Column) -> Column:
    """The special engines that a question is put to besides the general ones, in order."""
    text = T.squeeze(F.coalesce(question, F.lit("")))
    low = F.lower(text)
    hosted = F.exists(T.site_hosts(text), lambda h: h == "github.com") | (low.rlike(r"\bgithub\b") & low.rlike(CODE_HOST) & low.rlike(CODE_THING))
    archive = I.archive_bounds(text, today).isNotNull()
    news = I.is_news(text) | (I.answer_type(text) == "current_event")
    names = lambda *items: F.array(*[F.lit(x) for x in items])
    none = F.array().cast("array<string>")
    first = F.when(archive, names("sitemaps", "publisher-feeds")).when(news, names("bing-news", "google-news", "publisher-feeds", "gdelt")).otherwise(none)
    return F.when(hosted, names("github-search")).when(low.rlike(ACADEMIC), names("crossref", "arxiv")).otherwise(F.concat(first, F.when(low.rlike(TECHNICAL), names("stackexchange")).otherwise(none)))
