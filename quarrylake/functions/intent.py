"""What a question asks for: kind of answer, place, news window, topics; and what failures mean. Expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Kinds of answers, tried in this order.
ERROR = r"(?i)\b(error|exception|traceback|failed|failure|not working|cannot|can't|unable to|fix|debug|crash|segfault|timeout after)\b|\bERR_[A-Z_]+|\bE[0-9]{3,}\b"
COMPARISON = r"\b(vs\.?|versus|compare|comparison|difference between|better|which is cheaper)\b"
PROCEDURE = r"^(how (to|do|can|should) )|\b(register|registration|apply|application|licence|license|certificate|renew|renewal|claim|eligibility|documents required|process|steps|form|enrol|enroll|admission|complaint|appeal|refund|withdraw|transfer|mutation|permit)\b"
CURRENT = r"\b(latest|recent|today|news|winner|results?|election|summit|launch)\b"
YEAR = r"\b20[0-9]{2}\b"
STATISTIC = r"\b(rate|growth|share|revenue|sales|production|capacity|statistics|forecast|market size|inflation|gdp|exports|imports|issuance|shipments|leasing|vacancy|penetration|aum|premium|deficit|reserves|turnover|index of)\b"
DEFINITION = r"^(what (is|does|are)|meaning of|define |definition of|who (is|was|wrote|invented|discovered|painted)|capital of|currency of|national [\p{L}\p{N}_]+ of|how many|how much|when (was|did)|where is)"
NEWS = r"\b(latest|recent|today|tonight|breaking|current|currently|news|newest|this week|this month|this morning|yesterday|just announced|announced|update[sd]?|developing|live|right now|as of|forecast|polls?|earnings|layoffs|outbreak|evacuation|launch schedule|order backlog|election|summit|reporting|alerts?|monetary policy|production decision)\b"
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fourteen": 14, "fifteen": 15, "twenty": 20, "thirty": 30, "sixty": 60, "ninety": 90}
SPAN = r"\b(?:last|past|previous|within)\s+([0-9]+|" + "|".join(NUMBERS) + r")\s*(hours?|hrs?|days?|weeks?|months?|years?)\b"
REGIONS = [
    ("IN-AS", "assam guwahati dibrugarh jorhat silchar tezpur".split()),
    ("IN-NE", ["northeast", "north east", "meghalaya", "shillong", "manipur", "imphal", "nagaland", "kohima", "mizoram", "aizawl", "tripura", "agartala", "arunachal"]),
    ("IN", "india indian delhi mumbai bengaluru chennai kolkata rbi".split()),
    ("GB", ["britain", "british", "uk", "united kingdom", "london", "westminster"]),
    ("US", ["united states", "usa", "america", "washington", "congress", "white house", "federal reserve"]),
]
TOPICS = {
    "technology": ["technology", "tech", "software", "gadget", "chip", "semiconductor", "startup"],
    "ai": ["ai", "artificial intelligence", "llm", "openai", "machine learning", "chatbot"],
    "politics": ["politics", "political", "election", "government", "parliament", "minister", "policy", "crisis"],
    "crisis": ["crisis", "war", "conflict", "protest", "coup", "disaster", "earthquake", "flood", "outbreak", "attack"],
    "science": ["science", "research", "space", "nasa", "climate", "physics", "biology"],
    "business": ["business", "economy", "earnings", "market", "inflation", "interest rate", "fed", "reserve bank"],
    "local": ["local", "city", "district", "state", "assam", "guwahati", "northeast", "northeastern"],
    "india": ["india", "indian", "assam", "guwahati", "northeast", "delhi", "mumbai"],
}
#: Publishers: name, domain, region, topics, tier, in order.
FEEDS = [
    ("BBC World", "bbc.com", "GB", "world,politics,crisis", 1), ("BBC Technology", "bbc.com", "GB", "technology,ai", 1), ("The Guardian World", "theguardian.com", "GB", "world,politics", 1),
    ("Al Jazeera", "aljazeera.com", "QA", "world,crisis,politics", 1), ("NPR News", "npr.org", "US", "us,politics", 1), ("DW News", "dw.com", "DE", "world,politics", 1), ("France 24", "france24.com", "FR", "world", 1),
    ("The Hindu National", "thehindu.com", "IN", "india,politics", 1), ("The Hindu International", "thehindu.com", "IN", "world", 1), ("Indian Express India", "indianexpress.com", "IN", "india,politics", 1),
    ("Indian Express Technology", "indianexpress.com", "IN", "technology,ai", 1), ("Times of India India", "timesofindia.indiatimes.com", "IN", "india", 2), ("The Assam Tribune", "assamtribune.com", "IN-AS", "assam,northeast,local", 2),
    ("The Sentinel Assam", "sentinelassam.com", "IN-AS", "assam,northeast,local", 2), ("EastMojo", "eastmojo.com", "IN-NE", "northeast,local", 2), ("Northeast Today", "northeasttoday.in", "IN-NE", "northeast,local", 2),
    ("MIT Technology Review", "technologyreview.com", "US", "technology,ai", 1), ("TechCrunch", "techcrunch.com", "US", "technology,ai,startups", 1), ("VentureBeat AI", "venturebeat.com", "US", "ai,technology", 2),
    ("Ars Technica", "arstechnica.com", "US", "technology,science", 1), ("The Verge", "theverge.com", "US", "technology,ai", 1), ("Politico", "politico.com", "US", "politics,crisis", 1),
]


def answer_type(question: Column) -> Column:
    t = T.squeeze(F.coalesce(question, F.lit("")))
    low = F.lower(t)
    return (
        F.when(t.rlike(ERROR), "error")
        .when(low.rlike(COMPARISON), "comparison")
        .when(low.rlike(PROCEDURE), "procedure")
        .when(low.rlike(CURRENT), F.when(low.rlike(STATISTIC), "statistic").otherwise("current_event"))
        .when(low.rlike(YEAR) | low.rlike(STATISTIC), "statistic")
        .when(low.rlike(DEFINITION), F.when(low.startswith("how many"), "entity_lookup").otherwise("definition"))
        .otherwise("general")
    )


def _has(low: Column, words: list[str]) -> Column:
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    return F.exists(F.array(*[F.lit(f" {w} ") for w in words]), lambda w: F.contains(padded, w))


def region(question: Column) -> Column:
    named = lambda low: F.coalesce(*[F.when(_has(low, words), name) for name, words in REGIONS])
    return T.let(T.squeeze(F.lower(F.coalesce(question, F.lit("")))), named)


def topics(question: Column) -> Column:
    named = lambda low: F.array_compact(F.array(*[F.when(_has(low, words), name) for name, words in TOPICS.items()]))
    return T.let(T.squeeze(F.lower(F.coalesce(question, F.lit("")))), named)


def news_window_days(question: Column) -> Column:
    """The days of an explicit span or a word such as today; null without one."""
    low = T.squeeze(F.lower(F.coalesce(question, F.lit(""))))
    word, unit = F.regexp_extract(low, SPAN, 1), F.regexp_extract(low, SPAN, 2)
    named = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    n = F.coalesce(F.try_element_at(named, word), word.try_cast("int"))
    days = F.when(unit.rlike("^(hour|hr)"), F.greatest(F.lit(1), F.floor(n / 24).cast("int"))).when(unit.startswith("day"), n).when(unit.startswith("week"), n * 7).when(unit.startswith("month"), n * 30).when(unit.startswith("year"), n * 365)
    return F.coalesce(
        F.when((word != "") & (n > 0), days),
        F.when(low.rlike(r"\b(today|tonight|this morning|right now|as of today)\b"), 1).when(low.rlike(r"\byesterday\b"), 2)
        .when(low.rlike(r"\b(this|the past|the last)\s+week\b"), 7).when(low.rlike(r"\b(this|the past|the last)\s+month\b"), 30),
    )


def is_news(question: Column) -> Column:
    return T.squeeze(F.lower(F.coalesce(question, F.lit("")))).rlike(NEWS) | news_window_days(question).isNotNull()


def archive_bounds(question: Column, today: Column) -> Column:
    """(lo, hi) of an older span of dates that a question names: between or from A to B, since A, in a year; null if none."""
    low = T.squeeze(F.lower(F.coalesce(question, F.lit(""))))
    dateish = r"(?:19|20)[0-9]{2}(?:-[0-9]{2}(?:-[0-9]{2})?)?"
    span = rf"\b(?:between|from)\s+({dateish})\s+(?:and|to|until|through)\s+({dateish})\b"
    since, year = rf"\bsince\s+({dateish})\b", r"\bin\s+((?:19|20)[0-9]{2})\b"

    def lower(v: Column) -> Column:
        return F.try_to_date(F.when(F.length(v) == 4, F.concat(v, F.lit("-01-01"))).when(F.length(v) == 7, F.concat(v, F.lit("-01"))).otherwise(v), "yyyy-MM-dd")

    def upper(v: Column) -> Column:
        return F.when(F.length(v) == 4, F.try_to_date(F.concat(v, F.lit("-12-31")), "yyyy-MM-dd")).when(F.length(v) == 7, F.last_day(lower(v))).otherwise(lower(v))

    a, b, c, d = F.regexp_extract(low, span, 1), F.regexp_extract(low, span, 2), F.regexp_extract(low, since, 1), F.regexp_extract(low, year, 1)
    empty = F.lit(None).cast("date")
    return (
        F.when((a != "") & (lower(a) <= upper(b)) & (upper(b) < today), F.struct(lower(a).alias("lo"), upper(b).alias("hi")))
        .when((c != "") & (lower(c) < today) & (F.substring(c, 1, 4).try_cast("int") < F.year(today)), F.struct(lower(c).alias("lo"), empty.alias("hi")))
        .when((d != "") & (d.try_cast("int") < F.year(today)), F.struct(lower(d).alias("lo"), upper(d).alias("hi")))
    )


CAPTCHA = ["captcha", "unusual traffic", "are you a robot", "verify you are human"]
RATE = ["rate limit", "rate-limit", "too many requests"]


def block_kind(text: Column, status: Column) -> Column:
    """rate_limited or captcha by an answer's status and text; null if it is neither."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda words: low.rlike("|".join(words))
    return F.when(status == 429, "rate_limited").when(has(CAPTCHA), "captcha").when(has(RATE), "rate_limited")


def status_class(status: Column) -> Column:
    """(kind, detail): what an HTTP status says of a page."""
    kind = (
        F.when(status.isin(301, 302, 303, 307, 308), "redirect_loop").when(status == 404, "not_found").when(status.isin(401, 403), "denied").when(status == 429, "rate_limited").when(status.between(500, 599), "server_error").otherwise("unavailable")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "redirect_loop", kind).otherwise(F.concat(F.lit("http_"), status.cast("string"))).alias("detail"))
