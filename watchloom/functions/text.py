"""Text expressions: cleaning, language, topics, URL parts. Built-in functions only, but for ``composed``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Prefixes, emoji ranges, marker words and stop words that define results.
PREFIXES = ("Watched ", "Viewed ", "Searched for ", "watched ", "viewed ", "searched for ")
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]"
AMBIGUOUS = ("me", "the", "hi", "par", "ko")
MARKERS = (
    "aur", "ya", "lekin", "par", "toh", "bhi", "hi", "na", "nahi", "nhi", "hai", "ho", "hoga", "hogi", "tha", "thi", "the", "hain", "kya", "kaise", "kyun",
    "kyu", "kyunki", "karo", "karna", "krna", "samjhao", "batao", "dekho", "suno", "jao", "aao", "chalo", "ka", "ki", "ke", "mein", "me", "se", "tak", "wala",
    "wali", "wale", "ko", "pe", "pr", "kab", "kaha", "kaun", "kitna", "sach", "jhooth", "accha", "theek", "ghar", "dost", "bhai", "yaar", "paisa", "paise",
    "kaam", "log", "rishta", "pyaar", "zindagi", "dil", "duniya",
)
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "must", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through",
    "during", "before", "after", "above", "below", "between", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just", "also",
    "now", "and", "but", "if", "or", "because", "until", "while", "this", "that", "these", "those", "what", "which", "who", "whom", "whose", "i", "you", "he",
    "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "myself", "yourself", "himself", "herself",
    "itself", "ourselves", "themselves", "am", "about", "get", "got", "go", "going", "went", "come", "came", "make", "made", "take", "took", "see", "saw",
    "know", "knew", "think", "thought", "want", "like", "look", "use", "find", "give", "tell", "say", "said", "video", "watch", "watched", "new", "first",
    "last", "best", "top", "full", "part", "episode", "ep", "vs", "ft", "feat", "official", "exclusive", "shorts", "short", "movie", "clip", "scene",
    "trailer", "teaser",
)
WEAK_NOUNS = (
    "man", "men", "woman", "women", "person", "people", "guy", "guys", "leader", "leaders", "member", "members", "player", "players", "team", "teams",
    "group", "groups", "family", "families", "death", "life", "time", "day", "days", "night", "nights", "year", "years", "month", "months", "week", "weeks",
    "thing", "things", "stuff", "way", "ways", "world", "place", "places", "area", "areas", "country", "countries", "city", "cities", "town", "towns", "home",
    "house", "end", "start", "beginning", "part", "parts", "side", "sides", "point", "points", "case", "cases", "fact", "facts", "news", "update", "updates",
    "story", "stories", "channel", "channels", "subscriber", "subscribers", "view", "views", "like", "likes", "comment", "comments", "reaction", "reactions",
    "highlight", "highlights", "moment", "moments", "episode", "episodes",
)
HINDI_STOP_WORDS = (
    "का", "के", "की", "है", "हैं", "था", "थे", "थी", "में", "से", "को", "पर", "ने", "और", "या", "एक", "यह", "वह", "इस", "उस", "जो", "तो", "भी", "कर", "हो",
    "ही", "अब", "जब", "तक", "बहुत", "कुछ", "सब", "कोई", "किसी", "अपने", "उनके", "इनके", "वाले", "वाली", "वाला",
)
LANGUAGES = ("english", "hindi", "hinglish", "unknown")
_STRIP = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _STRIP, "")


def engagement(title: Column) -> Column:
    """``active`` for titles that start with ``Watched``, else ``passive``."""
    return F.when(F.coalesce(title.startswith("Watched"), F.lit(False)), "active").otherwise("passive")


def raw_text(title: Column, kind: str) -> Column:
    own = r"^(Watched |Viewed )" if kind == "watch" else r"^Searched for "
    return F.nullif(F.regexp_replace(title, own, ""), F.lit(""))


def clean_text(c: Column) -> Column:
    """One known prefix, links and emoji removed; lower case; stripped; empty becomes null."""
    c = F.regexp_replace(c, "^(" + "|".join(PREFIXES) + ")", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)https?://\S+", ""), EMOJI, "")
    return F.nullif(strip(F.lower(c)), F.lit(""))


def language(c: Column, strict: bool = False) -> Column:
    """Struct ``type, confidence, devanagari, latin, markers, words``; ``strict`` counts unambiguous markers only."""
    high_words = tuple(m for m in MARKERS if m not in AMBIGUOUS)
    size = lambda words: F.size(words).cast("int")
    has = lambda pattern: F.coalesce(c.rlike(pattern), F.lit(False))
    # lists of one: what stands in them is worked out once, however often it is used after
    letters = F.coalesce(F.regexp_replace(F.lower(c), r"(?U)[^a-z\s]", ""), F.lit(""))
    short = F.coalesce(F.length(strip(c)) < 3, F.lit(True))
    seen = F.array(F.struct(F.filter(F.split(letters, r"(?U)\s+"), lambda w: w != "").alias("w"), has(r"[\x{0900}-\x{097F}]").alias("deva"), has("[a-zA-Z]").alias("latin"), short.alias("short")))
    marked = F.transform(seen, lambda x: F.struct(x.alias("x"), F.filter(x["w"], lambda w: w.isin(*(high_words if strict else MARKERS))).alias("m")))
    counted = F.transform(marked, lambda y: F.struct(y["x"]["deva"].alias("deva"), y["x"]["latin"].alias("latin"), y["x"]["short"].alias("short"), size(y["x"]["w"]).alias("words"), size(y["m"]).alias("hits"), size(F.filter(y["m"], lambda w: w.isin(*high_words))).alias("high")))

    def describe(n: Column) -> Column:
        plain = n["deva"] | ~n["latin"] | (n["words"] > 0)  # scripts decide, or there are words to count
        mixed = (n["deva"] & n["latin"]) | (~n["deva"] & n["latin"] & ((n["hits"] >= 2) | (n["hits"] == 1) & (n["high"] == 1)))
        kind = F.when(n["short"] | ~plain, "unknown").when(n["deva"] & ~n["latin"], "hindi").when(mixed, "hinglish").otherwise("english")
        sure = F.when(n["short"] | ~plain, "low").when(~n["deva"] & n["latin"] & (n["hits"] == 1) & (n["high"] == 1), "medium").otherwise("high")
        return F.struct(kind.alias("type"), sure.alias("confidence"), n["deva"].alias("devanagari"), n["latin"].alias("latin"), n["hits"].alias("markers"), n["words"].alias("words"))

    return F.transform(counted, describe)[0]


def hashtags(c: Column) -> Column:
    """Distinct lower-cased tags of two characters and more, in order."""
    tags = F.transform(F.regexp_extract_all(c, F.lit(r"#([\p{L}\p{N}_]+)"), 1), lambda t: F.lower(t))
    return F.array_distinct(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.length(t) >= 2))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def composed(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalise(c: Column) -> Column:
    """Composed (NFC), invisible characters dropped, white space collapsed."""
    return collapse(F.regexp_replace(composed(c), INVISIBLE, ""))


def drop_stop_words(c: Column, words: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.array_join(F.filter(F.split(c, " "), lambda w: ~F.lower(w).isin(*words)), " ")


def text_v1(c: Column) -> Column:
    """Devanagari out, normalised, stop words and pipes out."""
    c = F.regexp_replace(c, r"[\x{0900}-\x{097F}]+", " ")
    return collapse(F.regexp_replace(drop_stop_words(normalise(c)), r"\|", " "))


def sanitise_topic(c: Column) -> Column:
    """Tags out, dashes to spaces, punctuation off both ends only, white space collapsed."""
    c = F.regexp_replace(F.regexp_replace(c, r"\.?#[\p{L}\p{N}_]*", ""), r"[\x{2014}\x{2013}-]+", " ")
    ends = r"""[ #@|\[\](){}.,!?:;"'_-]+"""
    return collapse(F.regexp_replace(c, f"^{ends}|{ends}$", ""))


def merge_topics(tags: Column, entities: Column, nouns: Column) -> Column:
    """Tags, entities, nouns; lower case, distinct; one-word parts of longer entities dropped."""
    merged = F.array_distinct(F.transform(F.concat(tags, entities, nouns), lambda t: F.lower(t)))
    parts = F.flatten(F.transform(F.filter(entities, lambda e: F.contains(e, F.lit(" "))), lambda e: F.split(F.lower(e), " ")))
    return F.filter(merged, lambda t: F.contains(t, F.lit(" ")) | ~F.array_contains(parts, t))


def video_id(url: Column) -> Column:
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"[?&]v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r"/embed/([A-Za-z0-9_-]{11})")]
    return F.coalesce(*found)


def channel_id(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/channel/([A-Za-z0-9_-]+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"/(@[A-Za-z0-9_-]+)", 1), F.lit("")))


#: The variable that holds a player page's JSON, and where its fields are.
PLAYER = "ytInitialPlayerResponse"
_FORMAT = "$.microformat.playerMicroformatRenderer"
PLAYER_PATHS = {
    "category": f"{_FORMAT}.category", "title": f"{_FORMAT}.title.simpleText", "channel_name": f"{_FORMAT}.ownerChannelName",
    "description": f"{_FORMAT}.description.simpleText", "keywords": "$.videoDetails.keywords",
}


def embedded_json(html: Column, variable: str = PLAYER) -> Column:
    """The object assigned to a variable in a page, up to the first ``};`` of its line; null if there is none."""
    return F.nullif(F.regexp_extract(html, variable + r"\s*=\s*(\{.+?\});", 1), F.lit(""))


def page_metadata(json: Column, paths: dict[str, str] = PLAYER_PATHS) -> Column:
    """Struct of JSON paths, all null for text that is no JSON; a ``description`` is cut to 500 characters, ``keywords`` are a list."""

    def field(name: str, path: str) -> Column:
        found = F.get_json_object(json, path)
        if name == "description":
            return F.nullif(F.substring(found, 1, 500), F.lit(""))
        return F.from_json(found, "array<string>") if name == "keywords" else found

    return F.struct(*[field(k, p).alias(k) for k, p in paths.items()])
