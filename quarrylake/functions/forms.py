"""The forms in which a question is put to search engines. Expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import intent as I
from . import request as Q
from . import text as T

# Fixed values.
SYNONYMS = {"buy": "purchase", "cheap": "affordable", "car": "automobile", "doctor": "physician", "fix": "repair", "price": "cost"}


def keywords(question: Column) -> Column:
    """Quoted phrases, tokens that mean something and site scopes, each once."""
    bare = T.without_sites(question)
    phrases = F.transform(T.quoted(bare), lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    kept = F.filter(T.tokens(bare), lambda t: t.rlike(r"[+#.]") | (~t.isin(T.STOPWORDS) & ((F.length(t) > 2) | t.rlike(r"[^\x00-\x7F]"))))
    scopes = F.transform(T.site_scopes(question), lambda s: F.concat(F.lit("site:"), s))
    return F.array_distinct(F.concat(phrases, kept, scopes))


#: Kinds of answers that official sites of a place have.
OFFICIAL = ("procedure", "statistic", "current_event")
#: The fewest words that a form needs to stand for a question.
LEAST_WORDS = 3


def reformulate(question: Column, most: int = 3) -> Column:
    """Forms of a question in order of preference: (text, strategy); the same text, whatever its case, comes once. No form of
    an empty question.

    original; focus: the keywords of its subject, where it ends in a known
    request; jurisdiction: with the official site of the place that it names;
    sub_question: its parts; keywords; synonym. Scopes (site:) hold in each.
    """
    q = T.squeeze(F.coalesce(question, F.lit("")))
    bare = T.squeeze(T.without_sites(q))
    form = lambda text, name: F.struct(text.alias("text"), F.lit(name).alias("strategy"))
    scopes = F.transform(T.site_scopes(q), lambda s: F.concat(F.lit("site:"), s))
    subject = keywords(Q.known_request(bare)["subject"])
    focus = F.when(F.size(subject) >= LEAST_WORDS, form(F.array_join(F.concat(scopes, subject), " "), "focus"))
    official = F.get(Q.jurisdiction(bare)["domains"], F.lit(0))
    placed = F.when(official.isNotNull() & I.answer_type(bare).isin(*OFFICIAL), form(F.concat(q, F.lit(" site:"), official), "jurisdiction"))
    parts = F.filter(F.transform(F.split(q, r"\?|;| and | vs\.? | versus "), lambda p: F.regexp_replace(p, r"^[ ?.;:]+|[ ?.;:]+$", "")), lambda p: F.size(F.split(p, " ")) >= 3)
    scope = F.array_join(scopes, " ")
    subs = F.when(F.size(parts) > 1, F.transform(parts, lambda p: form(F.trim(F.concat(p, F.lit(" "), scope)), "sub_question"))).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<text: STRING, strategy: STRING>>)"))
    words = keywords(q)
    by_words = F.when(F.size(words) >= LEAST_WORDS, form(F.array_join(words, " "), "keywords"))
    swapped = F.lit(None).cast("string")
    for term, other in reversed(list(SYNONYMS.items())):
        at = rf"(?i)^(.*?)\b{term}\b"
        swapped = F.when(q.rlike(rf"(?i)\b{term}\b"), F.regexp_replace(q, at, f"$1{other}")).otherwise(swapped)
    by_synonym = F.when(swapped.isNotNull(), form(swapped, "synonym"))
    every = F.array_compact(F.concat(F.array(F.when(q != "", form(q, "original")), focus, placed), subs, F.array(by_words, by_synonym)))
    once = lambda forms: F.filter(forms, lambda f, i: ~F.exists(F.slice(forms, F.lit(1), i), lambda g: F.lower(g["text"]) == F.lower(f["text"])))
    return F.slice(T.let(every, once), 1, most)
