"""Language by script and marker words, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Scripts with their ranges of characters and languages, in order of precedence.
SCRIPTS = [
    ("Devanagari", "0900", "097F", "hi"), ("Bengali", "0980", "09FF", "bn"), ("Gurmukhi", "0A00", "0A7F", "pa"), ("Gujarati", "0A80", "0AFF", "gu"),
    ("Oriya", "0B00", "0B7F", "or"), ("Tamil", "0B80", "0BFF", "ta"), ("Telugu", "0C00", "0C7F", "te"), ("Kannada", "0C80", "0CFF", "kn"),
    ("Malayalam", "0D00", "0D7F", "ml"), ("Thai", "0E00", "0E7F", "th"), ("Lao", "0E80", "0EFF", "lo"), ("Myanmar", "1000", "109F", "my"),
    ("Georgian", "10A0", "10FF", "ka"), ("Ethiopic", "1200", "137F", "am"), ("Khmer", "1780", "17FF", "km"), ("Sinhala", "0D80", "0DFF", "si"),
    ("Hebrew", "0590", "05FF", "he"), ("Arabic", "0600", "06FF", "ar"), ("Armenian", "0530", "058F", "hy"), ("Greek", "0370", "03FF", "el"),
    ("Cyrillic", "0400", "04FF", "ru"), ("Hiragana", "3040", "309F", "ja"), ("Katakana", "30A0", "30FF", "ja"), ("Han", "4E00", "9FFF", "zh"), ("Hangul", "AC00", "D7AF", "ko"),
]
MARKERS = {
    "de": "der die das und ist von eine einer mit für wie funktioniert hauptstadt wärmepumpe",
    "fr": "le les des une et est pour avec à où trouver près meilleur meilleure bibliothèque capitale ville français",
    "es": "el los las una y es para con como instalar receta auténtica ciudad capital río",
    "pt": "o os uma e é para com qual do da dos brasil cidade capital",
    "it": "il lo gli della del che una quanto costa biglietto città capitale",
    "nl": "het een van voor wat zijn hoofdstad belgië nederland",
    "sv": "och är som en det vad sveriges högsta största berg",
    "tr": "ve için şehir şehri türkiye'nin türkiyenin en kalabalık başkenti",
    "id": "yang untuk dengan berapa jumlah penduduk adalah indonesia dari",
    "vi": "của là gì và những trong một với thủ đô việt nam",
}
#: Letters that tell a language at once, in order.
TELLING = [("[łęńśźżćą]", "pl"), ("[ğış]", "tr"), ("[ñ¿¡]", "es"), ("[ãõ]", "pt"), ("œ", "fr"), ("ß", "de"), ("đ", "vi"), ("å", "sv")]


def latin_language(text: Column) -> Column:
    def marked(low: Column) -> Column:
        def best(words: Column) -> Column:
            scores = []
            for rank, (lang, markers) in enumerate(MARKERS.items()):
                score = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in markers.split()])))
                if lang == "de":
                    score = score + low.rlike("[äöü]").cast("int")
                if lang in ("es", "pt", "it"):
                    score = score + low.rlike("[áéíóú]").cast("int")
                scores.append(F.struct(score.alias("score"), F.lit(-rank).alias("rank"), F.lit(lang).alias("lang")))
            return F.greatest(*scores)

        told = F.when(low.rlike(TELLING[0][0]), TELLING[0][1])
        for pattern, lang in TELLING[1:]:
            told = told.when(low.rlike(pattern), lang)
        any_telling = low.rlike("[" + "".join(p.strip("[]") for p, _ in TELLING) + "]")
        words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0)))
        return F.when(any_telling, told).otherwise(T.let(T.let(words, best), lambda b: F.when(b["score"] >= 2, b["lang"]).otherwise("en")))

    return T.let(F.lower(F.coalesce(text, F.lit(""))), marked)


def language(text: Column) -> Column:
    """(script, lang) by the most frequent script that isn't Latin; any kana makes it Japanese; else by Latin markers."""
    t = F.coalesce(text, F.lit(""))
    counts = [F.struct(F.regexp_count(t, F.lit(rf"[\x{{{a}}}-\x{{{b}}}]")).alias("n"), F.lit(-i).alias("rank"), F.lit(s).alias("script"), F.lit(lang).alias("lang")) for i, (s, a, b, lang) in enumerate(SCRIPTS)]

    def named(best: Column) -> Column:
        lang = (
            F.when((best["script"] == "Bengali") & t.rlike("[ৰৱ]"), "as")
            .when((best["script"] == "Cyrillic") & F.lower(t).rlike("[іїєґ]"), "uk")
            .when((best["script"] == "Arabic") & t.rlike("[پچژگک]"), "fa")
            .otherwise(best["lang"])
        )
        return F.when(best["n"] > 0, F.struct(best["script"].alias("script"), lang.alias("lang"))).otherwise(F.struct(F.lit("Latin").alias("script"), latin.alias("lang")))

    yoruba = t.rlike("[ẹọṣẸỌṢ]") | (F.regexp_count(t, F.lit(r"[\x{0301}\x{0300}]")) >= 2)
    latin = F.when(yoruba, "yo").otherwise(latin_language(t))
    kana = t.rlike(r"[\x{3040}-\x{30FF}]")
    # Texts without any such character, most of them, skip the counts.
    plain = ~t.rlike(r"[\x{0370}-\x{1FFF}\x{3040}-\x{D7AF}]")
    return (
        F.when(plain, F.struct(F.lit("Latin").alias("script"), latin.alias("lang")))
        .when(kana, F.struct(F.lit("Japanese").alias("script"), F.lit("ja").alias("lang")))
        .otherwise(T.let(F.greatest(*counts), named))
    )
